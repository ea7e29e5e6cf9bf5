import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.llm import html_pages, html_text, jaccard, leaks, pst, secrets

PATS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 18),
    "hex": (re.compile("[0-9a-f]+"), 16),
}


def base(text):
    out = []
    for i, (k, (p, least)) in enumerate(PATS.items()):
        out += [(m.start(), i, k, m.end()) for m in p.finditer(text) if (len(m[2]) if k == "assign" else m.end() - m.start()) >= least]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secrets_against_regexes(spark, docs):
    rng = random.Random(3)
    bits = ["password", "token", "api_key", "ApiKey", "=", ":", " ", '"', "AKIA", "A" * 15, "0123456789abcdef", "beef", "é", "\n", "abcdefghijkl.", "ghp_" + "a" * 36, "x" * 300]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(1500)] + [None, "", "", "a" * 400_000 + " token=abcdefghijklm"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "AKIA" + "B" * 16)]
    d = docs(rows)
    got = secrets.find_secrets(d).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t in rows:
        b = base(t or "")
        text = ",".join(f"{k}:{x}:{y}" for k, x, y in b)
        n = collections.Counter(k for k, _, _ in b)
        want[(i, n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert any("hosted" in r.spans for r in got)
    clean = secrets.redact(d)
    assert clean.columns == d.columns and clean.count() == len(rows)
    assert sum(r.n_hex + r.n_access + r.n_assign for r in secrets.find_secrets(clean).collect()) == 0
    assert secrets.find_secrets(docs([])).count() == 0


def test_minimised_automaton():
    t = secrets.automaton()
    assert len(t.step) < 4000 and t.step.max() < len(t.step) and t.accept[0] == 0


def test_secrets_against_sql(spark, docs):
    """All rules, also the method's own, against regular expression searches in SQL."""
    rng = random.Random(13)
    bits = ["Passwd", "token", "api_key", "API", "=", ":", " ", "'", "AKIA", "K7" * 8, "0123456789abcdef", "ghp_", "a1" * 17, "xoxb-", "1-2" * 5, "eyJ", "eyJh.", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "\n", "zz"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 14)))) for i in range(3000)] + [(5000, None), (5001, ""), (5001, ""), (None, "token=abcdefghijklmnop"), (5002, "-----BEGIN " + " " * 3000 + "PRIVATE KEY----- token" + " " * 5000 + "= abcdefghijkl")]
    d = docs(rows)
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    cols = "doc_id, n_assign, n_access, n_hex, base_sha256, spans"
    want = con.sql(f"SELECT {cols} FROM ({secrets.SECRETS_SQL})").fetchall()
    got = secrets.find_secrets(d).select(*cols.split(", ")).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert all(any(f"{r.name}:" in w[-1] for w in want) for r in secrets.RULES)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def classes_of(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    par = list(range(len(rows)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                par[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = collections.Counter()
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[(rows[i][0], len(sets[i]), min(ids) if ids else None)] += 1
    return out


def test_jaccard_against_brute_force(spark, docs):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    shared = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for g in range(12):
        seed = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            w = list(seed)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join([rng.choice(vocab) for _ in range(60)] + shared + [rng.choice(vocab) for _ in range(60)])) for i in range(30)]
    rows += [(900, None), (901, ""), (902, "  \n "), (903, "a b"), (904, "A  B"), (903, "a b"), (None, "a b"), (None, None), (905, "long " * 60_000)]
    d = docs(rows)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(d).collect())
    assert got == classes_of(rows)
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for _, _, c in classes_of(rows) if c is not None})
    assert jaccard.join(docs([])).count() == 0


def test_keep_one_with_clashing_columns(spark):
    names = ["_id", "_hash", "_once", "_text", "_n", "id", "hash", "row", "one", "copy", "key", "node", "least", "text_hash", "a.b"]
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (1, "a b c d e f", "v"), (3, "q r", "z"), (None, "a b c d e f", "w"), (4, "", "p"), (4, "", "o"), (1, "a b c d e f", "v")]
    d = spark.createDataFrame([(i, t, *[x] * len(names), {"k": x}) for i, t, x in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names) + ", more map<string,string>")
    got = jaccard.keep_one(d)
    assert got.columns == d.columns
    told = sorted((r[0] or 0, r[1], r[2], r) for r in got.collect())
    assert all(set(r[2:-1]) == {r[-1]["k"]} for *_, r in told) and [t[:2] for t in told] == [(0, "a b c d e f"), (1, "a b c d e f"), (3, "q r"), (4, ""), (4, "")]
    assert told[1][2] in "xv" and [t[2] for t in told if t[0] in (0, 3, 4)] == ["w", "z", "o", "p"]
    again = jaccard.keep_one(d.orderBy(F.rand(5))).collect()  # which of several rows of an id and a text stays doesn't depend on their order
    assert sorted(map(str, again)) == sorted(str(r) for *_, r in told)


def test_keep_one_of_ids_on_different_texts(spark, docs):
    rng = random.Random(9)
    text = lambda: [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(60)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, e = text(), text(), text(), text()
    full = lambda w: " ".join(w)
    rows = [(5, full(a)), (5, full(b)), (5, full(b)), (2, near(b)), (5, full(c)), (5, near(c)), (7, near(a)), (8, full(e)), (9, full(e))]
    rows += [(5, None), (5, ""), (5, ""), (6, " "), (None, full(e)), (None, None)]
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.keep_one(docs(rows)).collect())
    one = [x for x in kept if x[0] == 5 and x[1] in (full(c), near(c))]
    assert len(one) == 1
    assert kept == collections.Counter([(5, full(a)), (2, near(b)), *one, (8, full(e)), (5, None), (5, ""), (5, ""), (6, " "), (None, full(e)), (None, None)])


def test_prefixes_of_every_order_meet():
    """Sets that reach the threshold share a prefix token under each order, whichever tokens come last."""
    rng = np.random.default_rng(3)
    wide = rng.integers(0, 256, 1 << 10, dtype=np.uint8)  # an arbitrary bitmap of widespread tokens
    reached = 0
    for _ in range(300):
        a = rng.integers(0, 2**64, rng.integers(1, 80), dtype=np.uint64)
        b = np.concatenate((a[rng.random(len(a)) > 0.12], rng.integers(0, 2**64, rng.integers(0, 5), dtype=np.uint64)))
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            reached += 1
            t, o = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
            for i in range(len(jaccard.ORDERS)):
                at, row = jaccard._prefix(t, o, 80, i, wide)
                assert set(t[at[row == 0]]) & set(t[at[row == 1]])
    assert reached > 50


def test_pairs_need_every_order(spark, docs):
    """A pair that shares a prefix token under the first order alone isn't verified."""
    d = docs([(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k l")]).select("text")
    wide = spark.sparkContext.broadcast(np.zeros(1 << 10, np.uint8))
    nodes = [r.node for r in jaccard._members(docs([(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k l")]), 5).collect()]
    pairs = spark.createDataFrame([(min(nodes), max(nodes))], "x long, y long")
    assert jaccard._verified(pairs, d, 5, 80, wide).count() == 1
    found = jaccard._sets(pairs.select(F.col("x").alias("node")).union(pairs.select("y")), d, 5, 80, wide).collect()
    assert all(set(r.prefix1) <= set(r.tokens) and len(r.prefix1) == len(r.tokens) - math.ceil(0.8 * len(r.tokens)) + 1 for r in found)


def test_large_family_of_half_alike_texts(spark, docs):
    """Copies of copies: most pairs of the family stay under the threshold, links form chains."""
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(3000)]
    rows, w = [], [rng.choice(vocab) for _ in range(120)]
    for i in range(300):
        rows.append((i, " ".join(w)))
        w = list(w)
        w[rng.randrange(len(w))] = rng.choice(vocab)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs(rows)).collect())
    assert got == classes_of(rows)


def test_leaks_verbatim_and_paraphrased(spark, docs):
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, pick(40)) for i in range(30)]
    rows, truth = [], set()
    for i, w in items:
        rows.append((i, " ".join(pick(150) + w + pick(150))))
        loose = [x if rng.random() > 0.15 else rng.choice(vocab) for x in w if rng.random() > 0.1]
        rows.append((100 + i, " ".join(pick(90) + loose + pick(40)).upper()))
        truth |= {(i, i), (100 + i, i)}
    rows += [(1000 + i, " ".join(pick(200))) for i in range(60)] + [(2000, None), (2001, ""), (None, " ".join(items[3][1])), (0, rows[0][1])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (78, "")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in leaks.find_leaks(docs(rows), bench).collect()]
    assert len(set(got) & truth) >= 0.95 * len(truth) and set(got) - truth <= {(None, 3)} and got.count((0, 0)) == 2
    kept = leaks.drop_leaks(docs(rows), bench)
    assert {r.doc_id for r in kept.collect()} >= {1000 + i for i in range(60)} | {2000, 2001} and kept.where("doc_id = 0").count() == 0
    assert leaks.find_leaks(docs(rows), bench.limit(0)).count() == 0 and leaks.find_leaks(docs([]), bench).count() == 0


def test_leaks_of_items_that_a_third_of_the_rows_hold(spark, docs):
    """One item in exact copies, one in a passage that differing rows share; both also in single rows, one of them paraphrased."""
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, pick(40)) for i in range(20)]
    copy, shared = " ".join(pick(50) + items[0][1] + pick(50)), pick(10) + items[1][1] + pick(10)
    loose = [x if rng.random() > 0.1 else rng.choice(vocab) for x in items[0][1] if rng.random() > 0.1]
    rows = [(i, copy) for i in range(70)] + [(100 + i, " ".join(pick(40) + shared + pick(40))) for i in range(70)]
    # other items' words around an item of widespread words
    rows += [(300, " ".join(pick(90) + items[0][1] + pick(30))), (301, " ".join(items[2][1][:15] + loose + items[3][1][:15])), (302, " ".join(items[4][1][:12] + items[1][1]))]
    rows += [(400 + i, " ".join(pick(60) + w + pick(20))) for i, w in items[5:]] + [(1000 + i, " ".join(pick(150))) for i in range(50)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    truth = {(i, 0) for i in [*range(70), 300, 301]} | {(100 + i, 1) for i in range(70)} | {(302, 1)} | {(400 + i, i) for i in range(5, 20)}
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs(rows), bench).collect()} == truth
    assert {r.doc_id for r in leaks.drop_leaks(docs(rows), bench).collect()} == {1000 + i for i in range(50)}


def leaks_by_brute_force(rows, items, match=0.7, near=0.5, answers=0.6):
    """Every window of every row against every item: a plain table of common subsequences, then the answer check."""
    terms = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    docs = [(i, terms(t)) for i, t in rows]
    df = collections.Counter(w for _, d in docs for w in set(d))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    out = set()
    for k, text in items:
        part = terms(text)
        own = sorted(set(part), key=lambda w: df[w])
        rare = own[: max(1, min(8, len(own) // 3))]
        for i, d in docs:
            if (i, k) in out:
                continue
            for at in range(0, max(1, len(d)), 16):
                if at and at + 32 > len(d):
                    break
                window = d[max(0, at - 16) : at + 80]
                if len(set(part) & set(window)) < 0.4 * len(set(part)):
                    continue  # can't reach half of the words
                share = common(part, window) / len(part)
                if share >= match or share >= near and sum(w in window for w in rare) >= answers * len(rare):
                    out.add((i, k))
                    break
    return out


def test_leaks_against_brute_force(spark, docs):
    """Recall and precision against all windows and all items: copies, paraphrases of several strengths, mere topics, very long texts."""
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(1500)]
    common = vocab[:40]
    pick = lambda n: [rng.choice(common) if rng.random() < 0.3 else rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice([25, 40, 48])))) for i in range(25)]
    rows = []
    for i, t in items:
        w = t.split()
        for loss in (0.0, 0.1, 0.2, 0.3, 0.45, 0.6):
            own = [x if rng.random() > loss / 2 else rng.choice(vocab) for x in w if rng.random() > loss / 2]
            rows.append((len(rows), " ".join(pick(rng.randint(0, 120)) + own + pick(rng.randint(0, 90)))))
        rows.append((len(rows), " ".join(rng.sample(w, len(w)) + pick(60))))  # its words, not its text
    rows += [(1000 + i, " ".join(pick(150))) for i in range(40)] + [(2000, " ".join(pick(30_000) + items[3][1].split() + pick(500))), (2001, None), (2002, ""), (2003, " ".join(pick(3)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = leaks_by_brute_force(rows, items)
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs(rows), bench).collect()}
    assert len(want) > 80 and (2000, 3) in got
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
    gone = {i for i, _ in got}
    assert {r.doc_id for r in leaks.drop_leaks(docs(rows), bench).collect()} == {i for i, _ in rows} - gone


def test_leaks_in_blocks_of_items(spark, docs, monkeypatch):
    """Many blocks, one after the other, find what one block finds."""
    rng = random.Random(22)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(2000)]
    items = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(12)]
    rows = [(i, " ".join([*rng.choices(vocab, k=50), t, *rng.choices(vocab, k=20)])) for i, t in items] + [(50 + i, " ".join(rng.choices(vocab, k=80))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leaks, "ITEMS", 5)
    whole = docs(rows).withColumns({"row": F.lit(1), "hash": F.lit("h")})
    for together in (1, 2, 4):  # one pass for each block, groups of blocks, all at once
        monkeypatch.setattr(leaks, "TOGETHER", together)
        assert sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(docs(rows), bench).collect()) == [(i, i) for i in range(12)]
        kept = leaks.drop_leaks(whole, bench)
        assert kept.columns == whole.columns and sorted((r.doc_id, r.row, r.hash) for r in kept.collect()) == [(i, 1, "h") for i in range(50, 80)]
    assert sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(docs(rows), bench).collect()) == [(i, i) for i in range(12)]
    assert sorted(r.doc_id for r in leaks.drop_leaks(docs(rows), bench).collect()) == list(range(50, 80))
    assert leaks.find_leaks(docs([]), bench).count() == 0 and leaks.drop_leaks(docs([]), bench).count() == 0


@pytest.mark.parametrize(("a", "b"), [("abcbdab", "bdcaba"), ("", "x"), ("aaaa", "aa"), ("xyz", "abc")])
def test_common_subsequence(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert leaks.common_subsequence(np.array([*map(ord, a)], np.uint64), np.array([*map(ord, b)], np.uint64)) == t[-1, -1]


def test_suffix_tree_scores(spark, docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "cat", "Cat", "sat", "on", "mat"], k=rng.randint(1, 40)))) for i in range(200)] + [(300, None), (301, ""), (301, ""), (None, "the the"), (302, "zq " * 100_000)]
    got = pst.score_texts(docs(rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tok = [[*words(t), None] for _, t in rows]
    c = collections.Counter(w for (i, _), ws in zip(rows, tok, strict=True) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for (i, _), ws in zip(rows, tok, strict=True):
        want[(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 3))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.score <= 0 for r in got)
    assert pst.score_texts(docs([])).count() == 0


def tree_by_brute_force(texts):
    """Scores by the definition: counts of all contexts, divergence tests from short to long, Witten-Bell smoothing."""
    pad = lambda s, i, d: (b"\n" * d + s[:i])[-d:] if d else b""
    seq = lambda t: " ".join(words(t or "")).encode() + b"\n"
    count = collections.defaultdict(collections.Counter)
    for held, t in texts:
        s = seq(t)
        for i in range(0 if held else len(s)):
            for d in range(pst.DEPTH + 1):
                count[pad(s, i, d)][s[i]] += 1
    memo = {}

    def table(ctx):
        if ctx not in memo:
            c = count[ctx]
            n = sum(c.values())
            if not ctx:
                memo[ctx] = {x: (c[x] + 1) / (n + 256) for x in range(256)}
            else:
                p = table(ctx[1:])
                kept = n > 0 and sum(k * math.log(k / n / p[x]) for x, k in c.items() if k) >= 0.5 * len(c) * math.log(n)
                memo[ctx] = {x: (c[x] + len(c) * p[x]) / (n + len(c)) for x in range(256)} if kept else p
            assert abs(sum(memo[ctx].values()) - 1) < 1e-9
        return memo[ctx]

    return [sum(math.log10(table(pad(s, i, pst.DEPTH))[s[i]]) for i in range(len(s))) for s in (seq(t) for _, t in texts)]


def test_suffix_tree_in_shares_of_slices(spark, docs, monkeypatch):
    """Buckets answered in many shares say what one task says."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(["red", "green", "Blue", "deep", "sea", "é"], k=rng.randint(0, 40)))) for i in range(200)] + [(None, None), (3, "red sea")]
    d = docs(rows).repartition(6, "node", "text")
    key = lambda r: (r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 4))
    one = sorted(map(key, pst.score_texts(d).collect()))
    monkeypatch.setattr(pst, "SALTED", 2)
    assert sorted(map(key, pst.score_texts(d).collect())) == one and len(one) == len(rows)
    assert pst.score_texts(docs([])).count() == 0


def test_base_of_suffix_tree_against_sql(spark, docs):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices(["red", "Green", "É", "x\ty", "zz"], k=rng.randint(0, 30)))) for i in range(120)] + [(None, "red"), (7, None), (8, "red"), (8, "red")]
    d = docs(rows)
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in pst.score_texts(d).collect())
    want = sorted((repr(r[0]), *r[1:5], round(r[5], 6)) for r in con.sql(pst.BASE_SQL.replace("round(base, 4)", "base")).fetchall())
    assert [g[:5] for g in got] == [w[:5] for w in want] and all(abs(g[5] - w[5]) < 2e-6 for g, w in zip(got, want, strict=True))


def test_suffix_tree_against_brute_force(spark, docs):
    rng = random.Random(4)
    vocab = ["the", "Then", "cat", "caterpillar", "sat", "é", "on", "mat"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "unheard-of Words!"), (62, "zq " * 300), (0, "the cat")]
    want = tree_by_brute_force([(zlib.crc32(str(i).encode()) % 7 == 2, t) for i, t in rows])
    got = sorted((r.doc_id, r.score) for r in pst.score_texts(docs(rows)).collect())
    for (i, a), (j, b) in zip(got, sorted((i, w) for (i, _), w in zip(rows, want, strict=True)), strict=True):
        assert i == j and abs(a - b) <= 1e-5 * (1 + abs(b))
    none = [(i, "only held") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert all(abs(r.score - 10 * math.log10(1 / 256)) < 1e-4 and r.train_tokens == 0 for r in pst.score_texts(docs(none)).collect())


def retained(packed):
    """Contexts that the divergence tests keep, counted from the grams' counts."""
    rows = pst.gram_counts(packed).collect()
    return pst.kept_contexts(*pst._merge(np.array([r.gram for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], float)))


def test_buckets_of_grams_in_both_forms(spark):
    keys = np.random.default_rng(1).integers(0, 2**48, 500, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys], "gram long")
    got = {r.gram: r.b for r in df.select("gram", pst._bucket_column("gram", 97).alias("b")).collect()}
    assert got == {int(k): int(b) for k, b in zip(keys, pst._gram_bucket(keys, 97), strict=True)}


def test_suffix_tree_grows_with_its_corpus(spark, docs):
    """The number of contexts that are kept grows with what was read, as far as that is new: here every text repeats words of its own."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    vocab = [word(rng.randint(2, 7)) for _ in range(400)]
    rows = [(i, " ".join([*rng.choices(vocab, k=40), *[word(6) for _ in range(4)] * 4])) for i in range(250)]
    small, large = (retained(pst._pack(docs(r))) for r in (rows[:50], rows))
    assert small > 1000 and large > 1.5 * small


def test_page_text(spark):
    rows = [
        (1, "u", "<body><header>Top</header><nav><a>x</a></nav><article><h1>T &amp; t</h1><p>one\n two<br>three<aside>no</aside></article><div class='ad'>buy</div><section id=comments>bad</section></body>"),
        (2, "u", None), (3, "u", ""), (3, "u", ""), (4, None, "<p>Plain page with a fair number of words in it and no article at all.</p><form>f</form><script>x</script>"),
        (5, "u", "<article><p>cut &lt;b&gt; off <b"), (6, "u", "<article>" + "<p>w</p>" * 20_000),
    ]
    got = html_text.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[1] == "T & t one two three" and text[2] == text[3] == "" and text[5] == "cut <b> off"
    assert text[4] == "Plain page with a fair number of words in it and no article at all." and text[6] == " ".join("w" * 20_000)
    assert all(r.n_chars == len(r.text) for r in got)


PROBES = {  # pages whose marks mislead: class names that hold a word of boilerplate, adverts without one, one short block
    '<article><div class="social-history"><p>The long history of a town with many people.</p></div></article>': "The long history of a town with many people.",
    '<div class="layout with-sidebar"><h1>A title</h1><p>Some words that go on in this paragraph.</p></div>': "A title Some words that go on in this paragraph.",
    "<p>See <a>long link</a> now.</p>": "See long link now.",
    '<article><p>Words that go on for a while in this paragraph.</p><div class="box-x">Buy our shoes today</div><p>More words that go on in the next one.</p></article>': "Words that go on for a while in this paragraph. More words that go on in the next one.",
    "<div><a>Home</a> <a>News</a></div><div><h1>Title</h1><p>A text.</p><p>Then a longer one that goes on and on until it ends.</p></div><div>Copyright us <a>Contact</a></div>": "Title A text. Then a longer one that goes on and on until it ends.",
    "<form><article><p>Inside a form that holds the page.</p></article><label>Name</label></form>": "Inside a form that holds the page.",
    "<main><p>Pick one of these colours to begin with.</p><datalist id=c><option value=a><option value=b></datalist><p>And this is what follows after the list.</p></main>": "Pick one of these colours to begin with. And this is what follows after the list.",
    "<main><p>Press <button>Start here</button> and wait until it is done.</p><p>Then <button>go on with the rest of the page.</p></main>": "Press Start here and wait until it is done. Then go on with the rest of the page.",
    "<main><p>The sum <math><mi>a</mi><mo>+</mo><mn>2</mn></math> is even for every even a.</p><object data=x>A picture of the same sum in words</object><p>So it is for all of them.</p></main>": "The sum a+2 is even for every even a. A picture of the same sum in words So it is for all of them.",
    "<main><p>Some text of the page that goes on.</p><canvas><p>Drawn as words for readers without pictures.</p><p>More of the text to the end.</p></main>": "Some text of the page that goes on. Drawn as words for readers without pictures. More of the text to the end.",
    "<main><p>The first part of the text is here.</p><select><option>Red<option>Green</select><p>The last part of the text is there.</p></main>": "The first part of the text is here. The last part of the text is there.",
    "<main><h1>A title</h1><p>Text of the page that goes on for a while.</p><div class=responses><p>I think that this is all wrong and more.</p></div></main>": "A title Text of the page that goes on for a while.",
    "<main><h1>A title</h1><p>Text of the page that goes on for a while.</p><div class='col rail'><ul><li>One story</li><li>Two story</li></ul></div></main>": "A title Text of the page that goes on for a while.",
    "<main><p>Text of the page that goes on for a while.</p><div data-ad=1>Buy shoes now cheap</div><p>And some more text of the same page.</p></main>": "Text of the page that goes on for a while. And some more text of the same page.",
    "<main><p>Text.</p><script>var a = '<p>no</p>';</script><noscript>Please turn on scripts</noscript><template><p>No text yet</p></template><p>The end of it all.</p></main>": "Text. The end of it all.",
    "<article><p>Text.</p><section class=comments><article><p>A long remark of a reader on all of this and more.</p></article></section></article>": "Text.",
}


def test_probe_pages():
    assert {p: html_text.main_text(p) for p in PROBES} == PROBES


def held_out_page(rng):
    """A page of random nesting that isn't among the labelled ones, and its main text."""
    say = lambda n: " ".join(rng.choice(["alpha", "be", "gamma", "delta,", "to", "Omega."]) for _ in range(n))

    def content(depth):
        n, kind = rng.choice([1, 2, 4, 8, 15, 30, 60, 120]), rng.random()
        if kind < 0.6 or depth == 3:
            tag = "h2" if kind > 0.5 else "p"
            return f"<{tag}>{(t := say(min(n, 9) if tag == 'h2' else n))}</{tag}>", [t]
        if kind < 0.7:
            rows = [say(rng.choice([1, 3, 9])) for _ in range(3)]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>", rows
        if kind < 0.8:
            a, b = say(5), say(rng.choice([2, 4]))
            return f"<p>{a} <a href=x>{b}</a></p>", [f"{a} {b}"]
        parts = [content(depth + 1) for _ in range(rng.randint(1, 4))]
        name = rng.choice(["div", "section", "div class='col-9'", "div class='social-history'"])
        return f"<{name}>" + "".join(x for x, _ in parts) + f"</{name.split()[0]}>", [y for _, z in parts for y in z]

    junk = [
        f"<div class='ad'>{say(9)}</div>", f"<aside><p>{say(20)}</p><ul><li><a>{say(3)}</a></li></ul></aside>", f"<form><p>{say(6)}</p><input></form>", f"<div class='newsletter-signup'><p>{say(12)}</p></div>",
        f"<section class='comments'><p>{say(30)}</p></section>", f"<div class='share'><a>{say(1)}</a> <a>{say(1)}</a></div>", f"<div class='sidebar'><h3>{say(2)}</h3><p>{say(15)}</p></div>",
    ]
    parts = [content(0) if rng.random() < 0.75 else (rng.choice(junk), []) for _ in range(rng.randint(3, 12))]
    title, kind = say(5), rng.choice(["article", "main"])
    body = f"<{kind}><h1>{title}</h1>" + "".join(x for x, _ in parts) + f"</{kind}>"
    page = f"<html><body><header>{say(3)}</header><nav><ul><li><a>{say(1)}</a></li></ul></nav>{body}{rng.choice(junk)}<footer>{say(6)}</footer></body></html>"
    return page, " ".join([title, *(y for _, z in parts for y in z)])


def test_held_out_pages():
    rng = random.Random(5)
    total = missing = extra = 0
    for page, want in (held_out_page(rng) for _ in range(300)):
        a, b = collections.Counter(want.split()), collections.Counter(html_text.main_text(page).split())
        total, missing, extra = total + a.total(), missing + (a - b).total(), extra + (b - a).total()
    assert missing <= 0.005 * total and extra <= 0.002 * total


def test_tree_fits_its_table_and_uses_neighbours():
    x, y = html_text.examples(html_pages.labelled())
    t = html_text.tree()
    assert np.mean([html_text.decide(t, r) == k for r, k in zip(x, y, strict=True)]) >= 0.99
    used = set()

    def walk(node):
        if len(node) > 1:
            used.add(html_text.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(t)
    assert {"words", "links"} <= used and used & {"words_before", "words_after"} and used & {"links_before", "links_after"}


def test_tree_against_a_plain_search():
    """Every split is the best by Gini over all features and cuts, and every row ends where its comparisons lead."""
    x, y = html_text.examples(html_pages.labelled()[::9])
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0

    def check(node, x, y):
        if len(node) == 1:
            assert node[0] == int(2 * y.sum() >= len(y))
            return
        cuts = [(f, (a + b) / 2) for f in range(x.shape[1]) for a, b in itertools.pairwise(np.unique(x[:, f]))]
        best = min(gini(y[x[:, f] <= c]) + gini(y[x[:, f] > c]) for f, c in cuts if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) >= 2)
        low = x[:, node[0]] <= node[1]
        assert abs(gini(y[low]) + gini(y[~low]) - best) < 1e-6
        check(node[2], x[low], y[low])
        check(node[3], x[~low], y[~low])

    check(html_text.grow(x, y), x, y)


def test_block_features():
    page = "<nav><a>one two</a></nav><article><h1>Head</h1><p>a b <a>c</a> &amp; d<div class='ad box'>x y</div></article>"
    found = html_text.blocks(page)
    assert [b.text for b in found] == ["one two", "Head", "a b c & d", "x y"]
    rows = [dict(zip(html_text.FEATURES, r, strict=True)) for r in html_text.features(found)]
    assert [r["words"] for r in rows] == [2, 1, 4, 2] and [r["links"] for r in rows] == [1.0, 0.0, 0.25, 0.0]
    assert [r["words_before"] for r in rows] == [0, 2, 1, 4] and [r["links_after"] for r in rows] == [0.0, 0.25, 0.0, 0.0]
    assert [r["hint"] for r in rows] == [0, 0, 0, 2] and [r["kind"] for r in rows] == [0, 2, 1, 0] and [r["place"] for r in rows] == [0, 2, 2, 2]
    assert [html_text.hint(v, True) for v in ("ad", "ad-slot", "with-sidebar", "comments-list", "header", "plain", "related-posts nav")] == [2, 2, 1, 3, 0, 0, 2]


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars int")
    assert html_text.extract(none).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract(none).count() == 0
