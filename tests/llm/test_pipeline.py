import collections
import random
import re

import corpus_pipeline
import pytest
from chronolake.llm import registry, secrets
from test_texts import classes_of, leaks_by_brute_force

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        out = spark.read.parquet(path)
        assert out.count() <= n
        if name != "mixing":
            assert out.columns == docs.columns
        docs, n = out, out.count()
    assert n > 0


def test_every_operator_is_registered():
    assert [k.split("_")[0] for k in registry.QUERIES if k.startswith("op")] == [f"op{i}" for i in range(1, 14)]


def planted(rng):
    """Rows (doc_id, text, source), labels and benchmark items: toxic texts, copies, leaks, secrets, and what is empty, repeated or very long."""
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(4, 7))) for _ in range(3000)]
    say = lambda n=70: rng.choices(vocab, k=n)
    items = [(i, " ".join(say(40))) for i in range(12)]
    rows = [(i, " ".join(say())) for i in range(240)]
    rows += [(1000 + i, " ".join([*say(20), rng.choice(["zmoron", "zidiot", "zscum"]), *say(20), "zfool"])) for i in range(160)]
    near = [rows[i][1].split() for i in range(30)]
    for i, w in enumerate(near):
        w[i + 20] = "changed"
        rows.append((2000 + i, " ".join(w)))
    rows += [(2100 + i, rows[40 + i][1]) for i in range(20)]
    rows += [(3000 + i, " ".join([*say(30), *t.split(), *say(25)])) for i, t in items]
    rows += [(4000 + i, " ".join([*say(30), f"password = {'x7' * 8}{i}", *say(30)])) for i in range(6)]
    rows += [(5000, None), (5001, ""), (5002, ""), (5003, " ".join(say(40_000))), (5004, "one two"), (5004, "one two"), (None, " ".join(say()))]
    docs = [(i, t, "en", [None, "a", "b"][(i or 0) % 3], None if t is None else len(t)) for i, t in rows]
    labels = [(i, 1, int(1000 <= i < 2000)) for i, _ in rows if i is not None and (i < 240 or 1000 <= i < 2000)]
    return docs, labels, items


def test_every_stage_takes_effect(spark, tmp_path):
    """What each stage keeps, against brute force on what the stage before kept."""
    docs, labels, items = planted(random.Random(11))
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, rows in (("documents", docs), ("labels", labels), ("benchmark", items)):
        spark.createDataFrame(rows, kinds[name]).repartition(5).write.parquet(f"{tmp_path}/{name}.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now
    pairs = lambda d: collections.Counter((r.doc_id, r.text) for r in d.collect())
    toxic = {i for i, _, t in labels if t}
    kept = pairs(seen["toxicity"])
    assert sum(i in toxic for i, _ in kept) <= 0.02 * len(toxic) and all((r[0], r[1]) in kept for r in docs if r[0] not in toxic)
    rows = [x for x, n in kept.items() for _ in range(n)]
    least = {}  # the row of each class that stays: the smallest id, of its texts the one that stays
    for (i, t), (_, n, c) in zip(rows, [next(iter(classes_of([r]))) for r in rows], strict=True):
        least.setdefault((i, t), n)
    want = {c for (_, n, c) in classes_of(rows) if n and c is not None}
    near = pairs(seen["near_copies"])
    assert {i for (i, t) in near if i is not None and least[i, t]} == want
    assert all(near[r] == kept[r] for r in kept if not least[r] or r[0] is None) and all(near[r] == 1 for r in near if least[r] and r[0] is not None)
    found = {i for i, _ in leaks_by_brute_force([(k, t) for k, (_, t) in enumerate(near)], items)}
    clean = pairs(seen["decontamination"])
    assert clean == collections.Counter({r: n for k, (r, n) in enumerate(near.items()) if k not in found}) and len(found) >= 12
    redacted = seen["secrets"]
    assert redacted.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    want = collections.Counter((i, None if t is None else re.sub(r"password = (?:x7)+\d", "[secret]", t)) for (i, t), n in clean.items() for _ in range(n))
    assert pairs(redacted) == want and all(r.n_chars == (None if r.text is None else len(r.text)) for r in redacted.collect())
    assert sum(r.n_assign + r.n_hex + r.n_access for r in secrets.find_secrets(redacted).collect()) == 0
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by, texts = collections.defaultdict(lambda: [0, 0.0]), dict(pairs(redacted).keys())
    for r in seen["mixing"].collect():
        assert 0 < r.taken <= 3 * r["size"] == 3 * size(texts[r.doc_id])
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert set(by) == {None, "a", "b"} and all(abs(a - b) < 1 for a, b in by.values())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(map(tuple, whole.select("doc_id", "taken").collect())) == collections.Counter(map(tuple, seen["mixing"].select("doc_id", "taken").collect()))


def test_pipeline_of_nothing(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns(spark, tmp_path):
    """Columns named like those that stages use inside come through every stage but the last as they are."""
    docs, labels, items = planted(random.Random(3))
    docs = [r for r in docs if r[0] is None or r[0] < 100 or 1000 <= r[0] < 1100 or r[0] >= 3000]
    names = ["node", "key", "row", "hash", "id", "score", "predicted", "spans", "size", "label", "toxic", "item_id", "_text", "_n"]
    more = ", ".join(f"`{n}` string" for n in names)
    d = spark.createDataFrame([(*r, *[f"{r[0]}:{n}" for n in names]) for r in docs], f"doc_id long, text string, lang string, source string, n_chars long, {more}")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert all(r[n] == f"{r.doc_id}:{n}" for r in now.collect() for n in names)
    assert 0 < now.count() < d.count() and corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() > 0


def test_broken_imports_are_not_hidden(monkeypatch):
    """Only a missing subpackage may leave its queries out."""
    import builtins
    import importlib

    import __spark_entry__

    real = builtins.__import__

    def broken(name, *args, **kw):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("no module named numpy", name="numpy")
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
    assert "pipeline" in __spark_entry__.queries()
