import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolake.llm import bytekit as bk
from chronolake.llm import hashed, langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


def test_factorization_learns_pairs():
    """Two terms that only count together: a linear model can't tell, the pairs can."""
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]] * 50, np.float32)
    y = (x.sum(1) == 2) | (x.sum(1) == 0)
    b, w, v = toxicity.fit_machine(y.astype(int), x, steps=600, decay=1e-5)
    z = b + x @ w + 0.5 * ((x @ v) ** 2 - x**2 @ v**2).sum(1)
    assert ((z > 0) == y).all()


def test_toxicity_held_out(spark):
    d, labels = read(spark, "documents"), read(spark, "labels")
    r = toxicity.score_toxicity(d, toxicity.train(d, labels)).join(labels, "doc_id").toPandas()
    h = r[r.held_out]
    assert auc(h.toxic.to_numpy(), h.score.to_numpy()) > 0.8
    assert ((h.score >= 0.3) == (h.predicted == 1)).all()


def test_toxicity_learns_terms_that_are_neutral_alone(spark, docs):
    """Either of two terms alone is harmless, both together are toxic; the machine that `train` fits must tell."""
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ana", "oro", "ilu", "epi", "umi")]
    say = lambda *more: " ".join(rng.sample([*rng.choices(vocab, k=12), *more], 12 + len(more)))
    rows = [(i, say("zorbs", "vermin") if i % 4 == 0 else say("zorbs") if i % 4 == 1 else say("vermin") if i % 4 == 2 else say()) for i in range(900)]
    d = docs(rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    r = toxicity.score_toxicity(d, toxicity.train(d, labels)).where("held_out").collect()
    assert len(r) > 100 and sum(x.predicted == int(x.doc_id % 4 == 0) for x in r) >= 0.97 * len(r)


def test_samples_are_bounded_and_every_label_counts(spark, docs):
    """Repeated ids and many label values: no value is left out, none exceeds its bound."""
    rows = [(i % 90, f"text {i}") for i in range(400)]
    labels = spark.createDataFrame([(i, i, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    got = [r.label for r in hashed.labelled(docs(rows), labels, F.col("quality"), F.lit(True), 3).collect()]
    assert set(got) == set(range(90)) and max(map(got.count, got)) == 3
    names = [f"l{i:03}" for i in range(300)]
    m = langid.train(docs([(i, f"{'abc' if i % 2 else 'xyz'} {i}", names[i % 300]) for i in range(1500)]), most_windows=2400)
    assert m.langs == names


def naive_gru(net, text):
    """The network by its definition, byte by byte and window by window."""
    raw, p = text.encode(), net.p
    sig = lambda z: 1 / (1 + np.exp(-z))
    total, h = np.zeros(len(net.langs)), langid.HIDDEN
    for a in range(0, len(raw), langid.WINDOW):
        part = [*raw[a : a + langid.WINDOW]]
        part += [256] * (langid.WINDOW - len(part))
        sides = []
        for d, seq in ((0, part), (1, part[::-1])):
            s, out = np.zeros(h), []
            for b in seq:
                g = p["emb"][b] @ p[f"w{d}"] + p[f"b{d}"]
                zr = sig(g[: 2 * h] + s @ p[f"u{d}"])
                n = np.tanh(g[2 * h :] + (zr[h:] * s) @ p[f"un{d}"])
                s = (1 - zr[:h]) * n + zr[:h] * s
                out.append(s)
            sides.append(out if d == 0 else out[::-1])
        for b, x, y in zip(part, *sides, strict=True):
            if b < 256 and langid.LETTER[b]:
                z = np.concatenate((x, y)) @ p["o"] + p["ob"]
                total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return int(total.argmax()), total.max() / total.sum()


def test_language_against_a_plain_recurrence(monkeypatch):
    texts = ["the quick brown fox " * 20, "de la que los " * 30, "x", "üß 12 " * 9]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    xs = [langid.windows(r, np.array([0, len(r)]))[0] for r in raw]
    net = langid.fit(np.concatenate(xs, 1), np.concatenate([np.full(x.shape[1], i % 2) for i, x in enumerate(xs)]), ["a", "b"], epochs=1)
    monkeypatch.setattr(langid, "PIECE", 2)  # long texts are read in pieces
    best, score = net.documents(pa.array(texts))
    for t, b, s in zip(texts, best, score, strict=True):
        want = naive_gru(net, t)
        assert b == want[0] and abs(s - want[1]) < 1e-4


def naive_terms(text, table):
    out, now = [], b""
    for b in (text or "").encode() + b" ":
        c = bytes([b + 32 if 65 <= b <= 90 else b])
        if table[b]:
            out += [now] if now else []
            now = b""
        else:
            now += c
    return out


def buckets_of(features, text):
    s = next(bk.slices(pa.array([text])))
    return {int(k) for k in features(s)[1]}


def test_scores_against_naive_sums(spark, docs):
    """Machine and ordinal scores as plain sums over the features of a text, one text at a time."""
    d, labels = read(spark, "documents"), read(spark, "labels")
    rows = [(i, r.text) for i, r in enumerate(d.orderBy("doc_id").limit(60).collect())] + [(100, None), (101, ""), (102, "same text"), (103, "same text"), (104, "a b " * 40_000)]
    m, q = toxicity.train(d, labels), quality.train(d, labels, F.expr("quality * (2 - toxic)"))
    tox = {r.doc_id: r.score for r in toxicity.score_toxicity(docs(rows), m).collect()}
    qual = {r.doc_id: (r.expected_grade, r.tail_prob) for r in quality.score_quality(docs(rows), q).collect()}
    at, aq = ({int(b): i for i, b in enumerate(x.chosen)} for x in (m, q))
    for i, t in rows:
        f = [at[b] for b in buckets_of(hashed.term_features, t or "") if b in at]
        z = m.bias + sum(m.w[a] for a in f) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(f) for b in f[:k])
        assert abs(tox[i] - 1 / (1 + np.exp(-z))) < 1e-4
        z = sum(q.w[aq[b]] for b in buckets_of(hashed.style_features, t or "") if b in aq)
        tails = 1 / (1 + np.exp(-(z - q.cuts)))
        assert abs(qual[i][0] - (q.grades[0] + tails @ np.diff(q.grades))) < 1e-6 and abs(qual[i][1] - tails[0]) < 1e-6
    assert tox[102] == tox[103] and qual[102] == qual[103]
    words = naive_terms("Ab-cd ef_9é", hashed.TERM_END)
    assert words == [b"ab", b"cd", b"ef", "9é".encode()]


def test_toxicity_edges(spark, docs):
    rows = [(i, "fine words here" if i % 2 else "you idiot moron") for i in range(80)]
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(80)] + [(500, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    d = docs([*rows, (90, None), (91, ""), (91, ""), (None, "idiot"), (92, "idiot " * 50_000)])
    m = toxicity.train(d, labels)
    got = {(r.doc_id, r.predicted) for r in toxicity.score_toxicity(d, m).collect()}
    assert (92, 1) in got and (0, 1) in got and (1, 0) in got and len(toxicity.score_toxicity(d, m).collect()) == d.count()
    kept = toxicity.drop_toxic(d, m)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= {1, 3, 5} and 0 not in {r.doc_id for r in kept.collect()}
    none = toxicity.train(d, labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(d, none).collect()} == {0}
    assert toxicity.score_toxicity(docs([]), m).count() == 0


def test_ordinal_thresholds_and_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = np.digitize(x[:, 0] + 0.1 * rng.normal(size=600), [-1, 0, 1])
    w, cuts = quality.fit_ordinal(y, x, 4)
    assert (np.diff(cuts) > 0).all() and w[0] > 5 * abs(w[1])
    p = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts)))
    assert abs(p.sum(1) - y).mean() < 0.3


def test_quality_edges(spark, docs):
    d, labels = read(spark, "documents"), read(spark, "labels")
    m = quality.train(d, labels, F.expr("quality * (2 - toxic)"))
    r = quality.score_quality(d, m).join(labels, "doc_id").toPandas()
    h = r[r.held_out]
    assert auc(h.quality.to_numpy(), h.tail_prob.to_numpy()) > 0.9
    edge = docs([(1, None), (2, ""), (2, ""), (None, "a")])
    assert quality.score_quality(edge, m).count() == 4 and quality.score_quality(docs([]), m).count() == 0
    one = quality.train(d, labels.withColumn("quality", F.lit(1)), F.col("quality"))
    assert {x.expected_grade for x in quality.score_quality(edge, one).collect()} == {1.0}


def test_language_held_out_and_edges(spark, docs):
    d = read(spark, "documents")
    m = langid.train(d)
    r = langid.predict(d, m).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    h = r[r.held_out]
    assert (h.lang == h.lang_pred).mean() > 0.95 and h.score.between(0, 1).all()
    edge = docs([(1, None), (2, ""), (3, "123 !!"), (None, "the and that " * 20_000), (4, "é"), (4, "é")])
    got = [(x.doc_id, x.lang_pred) for x in langid.predict(edge, m).collect()]
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en")} <= set(got) and len(got) == 6
    blank = langid.train(docs([(1, "a", None), (2, None, "en")]))
    assert [x.lang_pred for x in langid.predict(docs([(1, "abc")]), blank).collect()] == ["und"]
    assert langid.predict(docs([]), m).count() == 0


def test_gru_gradient():
    """Backpropagation lowers the loss to near zero on two easy languages."""
    raw = [np.frombuffer(t, np.uint8) for t in (b"aba" * 60, b"xyx" * 60) * 20]
    xs = [langid.windows(r, np.array([0, len(r)]))[0] for r in raw]
    y = np.concatenate([np.full(x.shape[1], i % 2) for i, x in enumerate(xs)])
    net = langid.fit(np.concatenate(xs, 1), y, ["a", "x"])
    best, score = net.documents(pa.array(["abaaba", "xyxxyx"]))
    assert best.tolist() == [0, 1] and (score > 0.9).all()


def test_words_and_lanes():
    texts = ["A b\tc", None, "", " é x ", "w" * 3000]
    counts = []
    for s in bk.slices(pa.array(texts), 16):
        counts += bk.Words(s).count.tolist()
    assert counts == [3, 0, 0, 2, 1]
    step, cls = np.array([[0, 1], [1, 0]], np.int32), (np.arange(256) == 97).astype(np.int32)
    raw = np.frombuffer(b"abaab" * 1001, np.uint8)
    assert (bk.run(step, cls, raw, 7) == np.cumsum(raw == 97) % 2).all()
