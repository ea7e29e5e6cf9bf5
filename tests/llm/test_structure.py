"""Packing, fill-in-the-middle and conversation repair against plain versions."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronolake.llm import dialogue, fim, packing, registry
from chronolake.llm.vocab import Vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't", "IT'S", "we'LL", "a1b22", "…", "naïve", "ÉTÉ", "é", "Σας", "ΟΔΟΣ", "İ", "Å", "漢字かな", "👩‍👩‍👧", "x y", "a b", "<|endoftext|>", "p<|startoftext|>q", "<|ENDOFTEXT|>", "''s", ".,;!", "—", "\x1c", "\x00", "ﬁ", "ß", "÷×", "q" * 300]


def some_text(rng, words=ODD, most=30):
    return "".join(rng.choice(words) + rng.choice(["", " ", "\n", "\t ", ", ", "."]) for _ in range(rng.randint(0, most)))


def test_vocabulary_against_tokenizer():
    rng, whole, own = random.Random(5), Tokenizer.from_file(PATH), Vocabulary(PATH, kept=50)
    words = ODD + ["the", "Of", "queen", "(alpha)", "beta-7", "e.g.", "l'été", "Straße,", "'", "''", "o'clock's", "d'", "<|", "a<|b", "\x0b", "\x85", "\xa0", "µª", "ÀÖØÞ", "e\u0301", "É\u0301"]
    texts = [some_text(rng, words) for _ in range(2500)] + ["", " \n", "end", "É", "Ã", ""]
    for some in (texts, texts[:1], [""], ["", ""]):
        offs = np.cumsum([0, *(len(t.encode()) for t in some)])
        flat, ends = own.encode(np.frombuffer("".join(some).encode(), np.uint8), offs)
        for t, a, b in zip(some, [0, *ends], ends):
            assert flat[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert len(own.young) <= 50 and len(own.old) <= 50


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 3), (4, 2)])
def test_hilbert_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def checked(rows, pieces, length):
    whole = Tokenizer.from_file(PATH)
    want = collections.Counter((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    seqs = collections.defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length > 0
    stream = []
    for k in range(len(seqs)):
        at = 0
        for p in sorted(seqs[k], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            stream.append(p)
        assert at == length or at & (at - 1) == 0 and at < length
        assert at == length or k >= sum(want[w] * len(w[1]) for w in want) // length
    got, held = collections.Counter(), []
    for p in stream:  # documents follow one another, so pieces of equal documents don't mix
        if p.start == 0:
            assert not held
        held += np.frombuffer(p.ids, "<u4").tolist()
        if p.start + p.length == p.doc_tokens:
            got[(p.doc_id, tuple(held))] += 1
            held = []
    assert got == want


def test_packing_against_plain_tokens(spark, docs, monkeypatch):
    rng = random.Random(8)
    rows = [(i, some_text(rng)) for i in range(120)] + [(7, "same words")] * 90 + [(500 + i, "the copy of a text") for i in range(150)] + [(None, None), (901, ""), (902, "w" * 20_000 + " many words " * 9000), (None, "x y")]
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        pieces = packing.pack(docs(rows), PATH, length=256).collect()
        checked(rows, pieces, 256)
        again = packing.pack(docs(rows[::-1]).repartition(7), PATH, length=256).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(repr, again)) == sorted(map(repr, pieces))  # the order of rows and partitions is no part of it
    monkeypatch.setattr(packing, "RANGE", 500)  # more ranges than the session's partitions
    many = packing.pack(docs(rows), PATH, length=256)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, pieces))
    assert packing.pack(docs([]), PATH).count() == 0
    checked([(1, None)], packing.pack(docs([(1, None)]), PATH).collect(), 2048)


def test_packing_puts_alike_documents_together(spark, docs):
    rng = random.Random(2)
    words = [[f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"], [f"{a}{b}{c}" for a in "hjkpv" for b in "aeiou" for c in "xzwyq"], [f"{a}{b}{c}" for a in "lmnrs" for b in "aeiou" for c in "bcdfg"]]
    rows = [(i, " ".join(rng.choices(words[i % 3], k=60))) for i in range(300)]
    seqs = collections.defaultdict(collections.Counter)
    for p in packing.pack(docs(rows), PATH, length=1024).collect():
        seqs[p.sequence_id][p.doc_id % 3] += p.length
    pure = sum(max(c.values()) for c in seqs.values()) / sum(sum(c.values()) for c in seqs.values())
    assert pure > 0.7  # at random about 0.42


def test_packing_query(spark, tmp_path):
    rows = [(1, "one two three"), (2, None), (3, "four " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op11_hilbert_packing(spark, str(tmp_path)).collect()
    ids = {i: np.array([*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    for p in got:
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    assert sum(p.length for p in got) == sum(map(len, ids.values()))


def test_ropes_against_strings():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "é👍", "word", " \t"]) for _ in range(rng.randint(0, 60)))
        tree, units = fim.rope(text, size=rng.randint(1, 9)), fim.UNIT.findall(text)
        assert str(tree) == text and (tree.units, tree.chars) == (len(units), len(text))
        k = rng.randint(0, len(units) + 1)
        a, b = fim.split(tree, k)
        assert (str(a), str(b), a.units, b.units) == ("".join(units[:k]), "".join(units[k:]), min(k, len(units)), max(0, len(units) - k))
        k = rng.randint(0, len(text))
        assert tuple(map(str, fim.split(tree, k, "chars"))) == (text[:k], text[k:])
        both = fim.join(fim.join(b, a), fim.leaf("<M>"))
        assert str(both) == str(b) + str(a) + "<M>"
    tree = fim.EMPTY
    for i in range(2000):
        tree = fim.join(tree, fim.leaf(f" {i}"))
    assert tree.units == 2000 and tree.height <= 16

    def level(t):
        return t.left is None or abs(t.left.height - t.right.height) <= 1 and level(t.left) and level(t.right)

    assert level(tree)


def plain_fim(doc_id, text):
    text = text or ""
    units = fim.UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_against_strings(spark, docs, tmp_path):
    rng = random.Random(6)
    bits = ["word", " ", "\n\n", "é", "👍 ", "<", "<M", "S>", "\t", "x" * 50, "<P>"]
    rows = [(i, "".join(rng.choices(bits, [9, 9, 2, 3, 3, 1, 1, 1, 1, 2, 0.05], k=rng.randint(0, 300)))) for i in range(400)]
    rows += [(None, "no id here"), (3, None), (4, ""), (5, " \n"), (6, rows[6][1]), (900, "long " * 200_000), (901, "y" * 300_000)]
    table = docs(rows).withColumnRenamed("score", "form")  # replaced by the operator's own
    out = fim.transform(table)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "key", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = fim.restore(out).collect()
    want = collections.Counter((i, t, *plain_fim(i, t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert all(r.restored == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.restore(fim.transform(docs([]))).count() == 0
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    mine = registry.op12_rope_fim(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.sql(fim.FIM_SQL)
    assert found.columns == mine.columns and collections.Counter(found.fetchall()) == collections.Counter(map(tuple, mine.collect()))


def plain_best(codes):
    """Least cost and first audit over all audits, kept whole."""

    def close(cur):
        for _ in range(4):
            for s, (c, a) in list(cur.items()):
                t = 3 if s == 2 else 2
                cur[t] = min(cur.get(t, (10**9, "")), (c + 3, a + "I"))
        return cur

    cur = close({0: (0, "")})
    for code in codes:
        initial, fault = dialogue.read(code)
        new: dict = {}
        for p, (c, a) in cur.items():
            offers = [(p, c + 4, a + "D")]
            if fault not in ("blank", "duplicate"):
                c += 3 * (fault == "truncated")
                offers.append((3 if p == 2 else 2, c + 3, a + "R"))
                if initial in dialogue.STEP[p]:
                    offers.append((dialogue.STEP[p][initial], c, a + "K"))
            for s, *x in offers:
                new[s] = min(new.get(s, (10**9, "")), tuple(x))
        cur = close(new)
    return min(cur[s] for s in (0, 3) if s in cur)


def test_layers_against_whole_audits():
    rng = random.Random(1)
    for _ in range(4000):
        codes = "".join(chr(65 + rng.choice([0, 4, 8, 4, 8, 12]) + rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 9)))
        path = [dialogue.root()]
        for c in codes:
            path.append(dialogue.grown(path[-1], c))
        assert dialogue.answer(path) == plain_best(codes), codes


def test_layers_are_shared_by_prefixes(spark, monkeypatch):
    """A layer for each node of the trie, not for each letter of the signatures."""
    made, grow = [], dialogue.grown
    monkeypatch.setattr(dialogue, "grown", lambda up, code: made.append(code) or grow(up, code))
    words = sorted({"".join(w) for w in ["EIEI", "EIEII", "EIEIE", "EIHI", "IE", "I"]})

    class Plan:
        """Runs the function that `solved` gives to Spark, on one sorted range."""

        def select(self, *_):
            return self

        distinct = select
        repartitionByRange = sortWithinPartitions = select

        def mapInArrow(self, f, _):
            import pyarrow as pa

            return [r for b in f(iter([pa.RecordBatch.from_arrays([pa.array(words)], names=["signature"])])) for r in b.to_pylist()]

    rows = dialogue.solved(Plan())
    nodes = {w[:i] for w in words for i in range(1, len(w) + 1)}
    assert len(made) == len(nodes) < sum(map(len, words))
    assert [(r["cost"], r["audit"]) for r in rows] == [plain_best(w) for w in words]


def plain_repair(rows):
    """The contract, one conversation after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, codes, counts = set(), "", collections.Counter()
        for _, role, text in left:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "none" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            first = "sua".find(role[:1]) if role else 3
            codes += chr(65 + 4 * (first if first >= 0 else 3) + dialogue.FAULTS.index(fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        turns = [t for t, _, _ in left if t is not None]
        cost, audit = plain_best(codes)
        it, said = iter(left), []
        for e in audit:
            row = None if e == "I" else next(it)
            if e == "D":
                continue
            system = bool(said) and said[0].startswith("s")
            role = row[1] if e == "K" else ("user", "assistant")[(len(said) - system) % 2]
            said.append(f"{role}:{row[2] if row else ''}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_repair_against_plain_version(spark, tmp_path):
    rng = random.Random(9)
    said = ["Yes.", "No!", "And then", "Why? ", "", " \n", "é…", "Done.\t", None, "a.b"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "admin"]
    rows = []
    for conv in range(160):
        many = rng.random() < 0.3
        for turn in range(rng.randint(1, 9)):
            at = rng.choice([turn, turn, turn, turn + 3, None]) if many else turn
            rows.append((conv, at, rng.choices(roles, [9, 9, 2, 1, 0.5, 0.5, 0.5, 0.5])[0] if many else ("user", "assistant")[turn % 2], rng.choice(said) if many else f"Turn {turn} of {conv}."))
    rows += [(None, t, "user" if t % 2 else "assistant", "Same.") for t in range(40)] + [(700, None, None, None)] * 3 + rows[5:9] + [(800, t, "user", "Hi." * 50_000) for t in range(3)]
    lone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(lone, 0, "user", "Gone.")] + [(2000, t, ("user", "assistant")[t % 2], f"No {t}.") for t in range(3000)]
    rng.shuffle(rows)
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, digest long")
    got = dialogue.repair(d, dialogue.damaged(d)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain_repair(rows) and len(got) == len({r[0] for r in rows})
    d.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet' WHERE conv_id IS DISTINCT FROM 2000")
    found = con.sql(dialogue.REPAIR_SQL)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in got if r.conv_id != 2000) and found.columns == got[0].__fields__
    assert dialogue.repair(d.limit(0)).count() == 0


def test_repaired_messages(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye."), (2, 0, "tool", "Listen.")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    answers = dialogue.audits(d, d)
    assert {r.conv_id: r.audit for r in answers.collect()} == {1: "KIKDKI", 2: "D"}
    told = dialogue.repaired(d, answers).collect()
    assert [(r.conv_id, r.place, r.edit, r.role, r.text) for r in told] == [
        (1, 0, "K", "system", "Be kind."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hello."), (1, 3, "K", "user", "Bye."), (1, 4, "I", "assistant", "")
    ]
