import duckdb
import numpy as np
from pyspark.sql import functions as F

from chronolake.llm import mixing, topk

SF = "/root/testdata/sf0.001"


def brute(rows, k=5):
    q = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in q), default=0)
    q = [(i, np.pad(v, (0, width - len(v)))) for i, v in q]
    out = []
    for a, (i, v) in enumerate(q):
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for b, (j, w) in enumerate(q) if a != b)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def ask(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))


def test_top_k_ties_nulls_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, rows[0][1]), (0, rows[0][1]), (50, [0.0] * 8), (301, None), (302, [None] * 8), (303, [float("nan")] * 8), (304, [1.0, 2.0])]
    assert ask(spark, rows) == brute(rows)


def test_top_k_few_and_none(spark):
    assert ask(spark, [(0, [1.0]), (1, [-1.0])]) == [(0, 1, 1, -65536)]
    assert ask(spark, []) == []


def test_maxscore_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(3000, 24)) * np.linspace(1, 0.01, 24)).astype(np.int64)
    s = topk.Shard(np.arange(3000), np.arange(3000), v)
    for i in range(0, 3000, 200):
        pos, score = s.search(i, v[i], 5)
        full = v @ v[i]
        want = [j for j in np.lexsort((np.arange(3000), -full)) if j != i][:5]
        assert list(s.ids[pos]) == want and list(score.astype(int)) == [int(full[j]) for j in want]


def test_threshold_prunes_lists_and_shards():
    """With a threshold, documents in no essential list aren't candidates, and shards out of reach are skipped."""
    v = np.zeros((400, 6), np.int64)
    v[:200, 0] = np.arange(200) + 100
    v[200:, 1:] = 1
    s = topk.Shard(np.arange(400), np.arange(400), v)
    q = np.array([10, 1, 1, 1, 1, 1])
    assert s._union(q, np.array([0])).tolist() == list(range(200))
    pos, score = s.search(-1, q, 5, 2000)
    assert pos.tolist() == [199, 198, 197, 196, 195] and score.tolist() == [2990, 2980, 2970, 2960, 2950]
    assert len(s.search(-1, q, 5, 10**6)[0]) == 0


def test_walk_over_shards_equals_one_product(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "FIRST", 30)
    for scale in (10, 10**5, 10**8):  # float32, float64 and integers
        v = np.floor(scale * rng.normal(size=(700, 12))).astype(np.int64)
        v[50] = v[300] = v[600]
        q = v[::50]
        score, vec = topk._walk(np.arange(700), np.arange(700)[::-1].copy(), v, np.arange(700)[::50], q, 5)
        for i, full in enumerate(q @ v.T):
            ids = np.arange(700)[::-1]
            want = [j for j in np.lexsort((ids, -full)) if j != 50 * i][:5]
            assert vec[i].tolist() == ids[want].tolist() and score[i].tolist() == full[want].tolist()


def test_top_k_long_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3000).astype(np.float32)]) for i in range(60)] + [(60, [1.0]), (100, [200.0] * 3000)]
    assert ask(spark, rows) == brute(rows)


def test_mix_of_very_long_texts(spark, docs):
    d = docs([(1, "w " * 300_000, "en", "a"), (2, "w " * 10, "en", "b"), (3, "  \n", "en", "b")])
    got = {r.doc_id: r for r in mixing.mix(d).collect()}
    assert got[1]["size"] == 300_000 and got[3].taken == 0 and got[2].taken <= 30 and abs(got[1].taken - got[1].target) < 1


def test_mix_matches_sql(spark, docs):
    for rows in ([(i, "w " * (i % 7), "en", f"s{i % 5}" if i % 11 else None) for i in range(60)] + [(3, "a b", "en", "s1"), (3, "a b", "en", "s1"), (None, "z", "en", "s0"), (99, None, "en", "S"), (98, "", "en", "é")], []):
        d = docs(rows)
        got = sorted(mixing.mix(d, rows_per_range=4).drop("source").collect(), key=str)
        con = duckdb.connect()
        con.register("documents", d.toArrow())
        want = sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.MIX_SQL})").fetchall(), key=str)
        assert [tuple(r) for r in got] == want
        by = {}
        for r in got:
            assert r.taken <= 3 * r.size
        for r in mixing.mix(d).collect():
            t = by.setdefault(r.source, [0, r.target])
            t[0] += r.taken
        assert all(abs(a - b) < 1 for a, b in by.values())


def test_mix_of_hot_ids_matches_sql(spark, docs):
    """Many rows without an id, and one row thousands of times: counted as one row each, and cut inside the copies."""
    rows = [(None, "w " * (i % 3), "en", "a") for i in range(2500)] + [(7, "x y", "en", "b")] * 3000 + [(i, "one two three " * (i % 5), "en", "ab"[i % 2]) for i in range(100, 160)]
    d = docs(rows)
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    got = sorted(mixing.mix(d, rows_per_range=64).drop("source").collect(), key=str)
    want = sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.MIX_SQL})").fetchall(), key=str)
    assert len(got) == len(rows) and [tuple(r) for r in got] == want
    assert 0 < len({r.taken for r in got if r.doc_id == 7})


def test_mix_plan_has_no_python(spark, docs):
    text = mixing.mix(docs([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
