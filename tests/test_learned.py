"""Models fitted over executors, the inverted-file index, the feed of jobs."""

import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolake.operators import ivf, learn, models, vectors
from chronolake.streaming import jobs

WORDS = ["rates", "rise", "fall", "cut", "hold", "strong", "weak", "the", "bank", "été", "x1", "growth"]


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(rng.integers(-1, 2))
        p = np.ones(len(WORDS))
        p[{-1: [2, 3, 6], 0: [4, 7], 1: [0, 1, 5]}[y]] += 2
        out.append((i, "" if i % 50 == 0 else None if i % 71 == 0 else ", ".join(rng.choice(WORDS, int(rng.integers(1, 30)), p=p / p.sum())).title(), None if i % 37 == 0 else y, 2010 + i % 14))
    return out


def plain_fit(rows, dims, decay):
    """The same loss by Newton steps on the whole matrix."""
    kept = [r for r in rows if r[2] is not None]
    classes = sorted({r[2] for r in kept})
    x = np.zeros((len(kept), dims + 1))
    for i, found in enumerate(learn.indices([r[1] or "" for r in kept], dims).to_pylist()):
        for j in found:
            x[i, j] += 1 / np.sqrt(len(found))
    x[:, -1] = 1
    y = np.eye(len(classes))[[classes.index(r[2]) for r in kept]]
    w, held = np.zeros((len(classes), dims + 1)), np.ones(dims + 1)
    held[-1] = 0
    for _ in range(50):
        p = np.exp(x @ w.T)
        p /= p.sum(1, keepdims=True)
        g = (p - y).T @ x / len(x) + decay * held * w
        h = np.block([[(x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x / len(x) + decay * np.diag(held) * (a == b) for b in range(len(classes))] for a in range(len(classes))])
        w -= (np.linalg.pinv(h) @ g.ravel()).reshape(w.shape)
    return classes, w


def test_coefficients_against_newton(spark):
    rows = texts(600)
    d = spark.createDataFrame(rows, "id int, text string, y int, year int")
    classes, want = plain_fit(rows, 64, 1e-2)
    m = learn.fit(d.repartition(5), "y", dims=64, decay=1e-2, steps=300, tolerance=1e-9)
    assert list(m.classes) == classes and np.abs(m.weights - want).max() < 1e-5
    many = learn._sums(d.where("y IS NOT NULL").select((F.col("y") + 1).alias("y"), learn.hashed_words(F.col("text"), 64).alias("features")).repartition(70), m.weights, 8)
    few = learn._sums(d.where("y IS NOT NULL").select((F.col("y") + 1).alias("y"), learn.hashed_words(F.col("text"), 64).alias("features")).repartition(1), m.weights, 1)
    assert abs(many[0] - few[0]) < 1e-12 and np.abs(many[1] - few[1]).max() < 1e-12 and np.abs(few[1][:, -1]).max() < 1e-6
    told = {r.id: r for r in m.predict(d).collect()}
    ask = learn.classifier(m, {1: "hawkish"})
    for (i, t, *_), (label, score) in zip(rows, ask([r[1] or "" for r in rows]), strict=True):  # the same model outside Spark
        assert label == {1: "hawkish"}.get(told[i].predicted, str(told[i].predicted)) and abs(score - max(told[i].probabilities)) < 1e-12
    assert learn.scorer(m, 1)(["strong strong rise"])[0] > 0.8 > 0.3 > learn.scorer(m, 1)(["weak cut fall"])[0]


def test_large_batches_are_worked_on_in_slices(spark):
    """What a pass and a question hold doesn't follow the words of a batch, and sums are the same."""
    rng = np.random.default_rng(2)
    lists = pa.array([[], *rng.integers(0, 64, (1500, 1200)).astype(np.int32).tolist(), []], pa.list_(pa.int32()))
    m = learn.Softmax((0, 1), rng.normal(size=(2, 65)))
    tracemalloc.start()
    p = m.probabilities(lists)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert p.shape == (1502, 2) and most < 8 << 20  # all words at once take 30 MB
    one = np.concatenate([m.probabilities(lists[i : i + 1]) for i in (0, 1, 700, 1501)])
    assert np.abs(p[[0, 1, 700, 1501]] - one).max() < 1e-12
    d = spark.range(2000).select((F.col("id") % 2).cast("int").alias("y"), F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: ((F.col("id") * i) % 64).cast("int")).alias("features"))
    few, many = learn._sums(d.coalesce(1), m.weights, 1), learn._sums(d.repartition(40), m.weights, 1)
    assert abs(few[0] - many[0]) < 1e-9 and np.abs(few[1] - many[1]).max() < 1e-9
    told = learn.asked(m, ["a b"] * 600 + [""])
    assert len(told) == 601 and np.abs(told[:600] - told[0]).max() < 1e-12 and learn.asked(m, []).shape == (0, 2)


def test_fit_without_classes(spark):
    d = spark.createDataFrame([(1, "a", None)], "id int, text string, y int")
    assert learn.fit(d, "y", dims=8).classes == (None,)
    m = learn.fit(d.withColumn("y", F.lit(4)), "y", dims=8)
    assert m.classes == (4,) and m.predict(d).first().predicted == 4


def test_baseline_splits_by_year(spark):
    rows = texts(400)
    d = spark.createDataFrame(rows, "id int, text string, y int, year int")
    told, manifest = learn.baseline(d, "y", F.col("year"), dims=64, decay=1e-2)
    again = learn.baseline(d.orderBy(F.rand(1)).repartition(3), "y", F.col("year"), dims=64, decay=1e-2)[1]
    count = lambda lo, hi: sum(r[2] is not None and lo <= r[3] <= hi for r in rows)
    assert (manifest["train_samples"], manifest["dev_samples"], manifest["test_samples"]) == (count(0, 2018), count(2019, 2019), count(2020, 9999))
    assert manifest["train_rows"] == again["train_rows"] and json.dumps(manifest)
    got = told.collect()
    assert len(got) == count(2020, 9999) and np.mean([r.y == r.predicted for r in got]) > 0.7
    leak = d.withColumn("y", F.when(F.col("year") > 2018, -F.col("y")).otherwise(F.col("y")))  # labels after the cutoff aren't learned
    assert learn.baseline(leak, "y", F.col("year"), dims=64, decay=1e-2)[1]["coefficients"] == manifest["coefficients"]


def test_trained_model_behind_the_interfaces(spark):
    d = spark.createDataFrame(texts(200), "id int, text string, y int, year int")
    m = learn.fit(d, "y", dims=64)
    c = d.select("id", "y", models.classified(F.col("text"), learn.classifier(m)).alias("c")).where("y IS NOT NULL").collect()
    assert np.mean([str(r.y) == r.c.label for r in c]) > 0.7
    kept = models.on_subject(d, "text", learn.scorer(m, 1), 0.5)
    assert 0.7 < kept.where("y = 1").count() / kept.where("y IS NOT NULL").count()


def test_filter_reads_whole_texts(spark):
    """What stands behind the first 512 characters counts, in runs of texts, as in the model's own scores of whole texts."""
    d = spark.createDataFrame(texts(200), "id int, text string, y int, year int")
    m = learn.fit(d, "y", dims=64)
    up, down = "strong rates rise, growth ", "weak cut, fall "
    asked = [up * 30 + down * 4000, down * 40 + up * 4000, up * 9000, None, "", *[down * 10_000] * 9, *[up * 10_000] * 9, ("été " * 200_000) + up, up]
    long = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(asked)), 1), "id int, text string")  # one batch
    kept = {r.id for r in models.on_subject(long, "text", learn.scorer(m, 1), 0.5).collect()}
    sure = F.element_at("probabilities", m.classes.index(1) + 1) >= 0.5
    assert kept == {r.id for r in m.predict(long).where(sure).collect()} and {1, 2, 14, 22, 24} <= kept and not kept & {0, 5, 13}
    runs = [r.to_pylist() for r in models._runs(pa.array(asked))]
    assert sum(runs, []) == asked and len(runs) > 3 and all(len(r) == 1 or sum(len((t or "").encode()) for t in r) <= models.BYTES for r in runs)
    assert list(models._runs(pa.array([], pa.string()))) == []

    def late(some):
        if up in some:
            raise ValueError
        return [0.0] * len(some)

    assert models.on_subject(long, "text", late).count() == len(asked)  # a failure in a later run lets the batch pass


def made(spark, n=1500, dims=24, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(30, dims))
    x = centre[rng.integers(0, 30, n)] + 0.6 * rng.normal(size=(n, dims))
    rows = [(i, [float(v) for v in x[i]], f"2024-01-{1 + i % 28:02d}", f"2024-02-{1 + i % 28:02d}" if i % 3 else None) for i in range(n)]
    rows[7] = (7, [0.0] * dims, "2024-01-01", None)
    d = spark.createDataFrame(rows, "id long, embedding array<float>, valid_from string, expires_at string").withColumns({c: F.to_date(c) for c in ("valid_from", "expires_at")})
    q = spark.createDataFrame([(i, [float(v) for v in x[i] + 0.2 * rng.normal(size=dims)], f"2024-{1 + i % 3:02d}-15") for i in range(0, n, 25)], "qid long, q array<float>, as_of string").withColumn("as_of", F.to_date("as_of"))
    return d, q


def visible():
    return (F.col("valid_from") <= F.col("as_of")) & (F.col("expires_at").isNull() | (F.col("expires_at") > F.col("as_of")))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    d, q = made(spark)
    at = str(tmp_path_factory.mktemp("ivf"))
    built = ivf.build(d.where("id % 4 > 0"), at, cells=24)
    built.insert(d.where("id % 4 = 0"), 1)
    return d, q, built


def test_index_holds_every_row_once(index, spark):
    d, _, built = index
    for part in ("codes", "vectors"):
        assert sorted(r.id for r in spark.read.parquet(f"{built.path}/{part}").select("id").collect()) == list(range(d.count()))
    assert len(built.cells) == 24 and np.array_equal(ivf.opened(spark, built.path).cells, built.cells)


def test_index_recall_and_exact_mode(index):
    d, q, built = index
    exact = vectors.search(d, q, 10, visible())
    found = built.search(q, 10, probes=6)
    got = ivf.recall(found, exact).first()
    assert got.asked == 60 and got.recall >= 0.9
    few = ivf.recall(built.search(q, 10, probes=1), exact).first().recall
    assert few <= got.recall
    full = built.search(q, 10, probes=24, finalists=150)
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.sim) for r in df.collect())
    assert key(full) == key(exact.select("qid", "rank", "id", "sim"))


def test_exact_search_in_blocks_and_with_copies(spark):
    """Products in slices give the pairs of the plain join, with copies of a row that tie and queries that see fewer than k rows."""
    d, q = made(spark, n=400)
    d = d.unionByName(d.where("id % 20 < 3").crossJoin(spark.range(9).toDF("s")).withColumn("id", F.col("id") + 1000 * (F.col("s") + 1)).drop("s"))
    q = q.unionByName(q.limit(2).withColumns({"qid": F.col("qid") + 5000, "as_of": F.lit("2024-01-01").cast("date")})).unionByName(q.limit(1).withColumns({"qid": F.lit(9999).cast("long"), "as_of": F.lit("2023-01-01").cast("date")}))
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.sim) for r in df.collect())
    want = key(vectors.search(d, q, 10, visible()))
    assert want and key(vectors.search_valid(d.repartition(3), q, 10)) == want == key(vectors.search_valid(d.coalesce(1), q, 10, block=5))


def test_far_rows_leave_the_shortlist():
    rng = np.random.default_rng(4)
    near, slack = rng.random((3, 5000)), 0.001 * rng.random(5000)
    best = vectors.Shortlist(3, 5)
    for a in range(0, 5000, 500):
        best.raised(near[:, a : a + 500], slack[a : a + 500], np.arange(3))
        for w in range(3):
            best.add(np.full(500, w), near[w, a : a + 500], slack[a : a + 500], np.arange(a, a + 500))
    who, _, _, ids = best.told()
    for w in range(3):
        sure = np.sort(near[w] - slack)[-5]
        assert set(ids[who == w]) == set(np.flatnonzero(near[w] + slack >= sure - vectors.CLOSE)) and 5 <= (who == w).sum() < 40
    ties = vectors.Shortlist(1, 4)
    ties.add(np.zeros(3000, int), np.ones(3000), np.zeros(3000), np.arange(3000)[::-1])
    assert sorted(ties.told()[3]) == [0, 1, 2, 3]


def test_index_with_copies_keeps_the_smallest_ids(spark, tmp_path):
    d, q = made(spark, n=300)
    d = d.unionByName(d.where("id % 10 = 0").crossJoin(spark.range(12).toDF("s")).withColumn("id", F.col("id") + 1000 * (F.col("s") + 1)).drop("s"))
    built = ivf.build(d.coalesce(2), str(tmp_path / "copies"), cells=8)
    assert spark.read.parquet(f"{built.path}/codes").where("slack > 0 AND copy >= 5").count() > 0
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.sim) for r in df.collect())
    assert key(built.search(q, 5, probes=8, finalists=1000)) == key(vectors.search(d, q, 5, visible()).select("qid", "rank", "id", "sim"))


def test_index_filters_before_the_cut_and_reads_probed_lists_only(index, spark):
    d, q, built = index
    one = q.where("qid = 0").withColumn("as_of", F.lit("2024-01-02").cast("date"))
    found = built.search(one, 20, probes=24, finalists=75).collect()
    assert len(found) == 20 and {r.id % 28 for r in found} <= {0, 1}  # 20 although most near rows begin later
    near = built.search(one, 5, probes=2)
    lists = {r.cell for r in spark.read.parquet(f"{built.path}/codes").where(F.col("id").isin([r.id for r in near.collect()])).select("cell").collect()}
    assert len(lists) <= 2 and near._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [cell") >= 2


def test_index_without_rows(spark, tmp_path):
    d, q = made(spark, n=50)
    built = ivf.build(d.limit(0), str(tmp_path / "none"))
    assert built.cells.shape[0] == 1


def test_feed_of_jobs_as_table_and_stream(spark, tmp_path):
    """A stream in several batches, with events out of order inside the watermark, tells what the table tells."""
    rng = np.random.default_rng(5)
    rows, seq = [], 0
    for job in range(12):
        at = 0
        for _ in range(rng.integers(1, 14)):
            at += int(rng.choice([1, 5, 10, 20, 35, 60])) * 1000
            rows.append((job, at, str(rng.choice(["step", "step", "step", "log", "complete" if job % 3 else "step"])), seq))
            seq += 1
    rows += [(99, 400_000, "step", seq)]
    until = 400_000 - 100_000
    d = spark.createDataFrame(rows, "job long, ms long, kind string, seq long")
    want = sorted(map(str, jobs.feed(d, 10_000, F.lit(until)).collect()))
    plain = []
    for job in {r[0] for r in rows}:
        mine, last = sorted((r[1:] for r in rows if r[0] == job and r[1] <= until), key=lambda r: (r[0], r[2])), None
        for at, kind, s in [*mine, (until + 1, None, None)]:
            while last is not None and last + 10_000 < at:
                last += 10_000
                plain.append((job, last, "heartbeat", None))
            if kind:
                plain.append((job, at, kind, s))
                last = at
            if kind in jobs.ENDINGS:
                break
    assert sorted((r.job, r.ms, r.kind, r.seq or -1) for r in jobs.feed(d, 10_000, F.lit(until)).collect()) == sorted((a, b, c, s or -1) for a, b, c, s in plain)
    rows.sort(key=lambda r: r[1])
    source = str(tmp_path / "in")
    shuffled = [r for a in range(0, len(rows), 6) for r in reversed(rows[a : a + 6])]  # out of order by far less than the watermark
    for a in range(0, len(shuffled), 30):
        spark.createDataFrame(shuffled[a : a + 30], d.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("t", F.timestamp_millis("ms")).withWatermark("t", "100 seconds")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        jobs.live(stream, 10_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.schema(jobs.FEED).parquet(str(tmp_path / "out")).collect()
    assert sorted(map(str, got)) == want and any(r.kind == "heartbeat" for r in got)
