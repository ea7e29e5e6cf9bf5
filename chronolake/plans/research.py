"""Queries of probes, bootstraps and tables of a leakage study."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolake.operators import stats as R
from chronolake.plans.book import query
from chronolake.plans.views import table, view

r6 = lambda c: F.round(c, 6)

# Events: four rows each; two dimensions clean, two with the target leaked into them; a target in fifty steps and one of three classes.
_EV = """ev AS (SELECT CAST(vec_id // 4 AS BIGINT) AS event_id, avg(embedding[1]::DOUBLE) AS a, avg(embedding[2]::DOUBLE) AS b, max(vec_id * 7 % 50)::DOUBLE / 50 AS y, CAST(max(vec_id * 5 % 3) - 1 AS INTEGER) AS k FROM embeddings GROUP BY 1),
n AS (SELECT count(*) AS n FROM ev), s AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM ev)"""


def _events(spark, sf):
    e = table(spark, sf, "embeddings")
    x = lambda i: F.avg(F.col("embedding")[i].cast("double"))
    return e.groupBy(F.floor(F.col("vec_id") / 4).alias("event_id")).agg(
        x(0).alias("a"), x(1).alias("b"), (F.max(F.col("vec_id") * 7 % 50).cast("double") / 50).alias("y"), (F.max(F.col("vec_id") * 5 % 3) - 1).cast("int").alias("k")
    )


_FOLDS = "fl AS (SELECT s.*, fold, CASE WHEN i < (fold + 1) * (n // 5) THEN 'train' WHEN i < CASE WHEN fold = 3 THEN n ELSE (fold + 2) * (n // 5) END THEN 'test' END AS role FROM s, n, (SELECT unnest(range(4))::INTEGER AS fold))"


def _ridge(src: str, x1: str, x2: str, y: str, name: str) -> str:
    """SQL of a ridge regression on two dimensions by fold, solved in closed form."""
    return f"""{name}m AS (SELECT fold, count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, sum({x1} * {x1}) - count(*) * avg({x1}) * avg({x1}) + 1 AS s11, sum({x2} * {x2}) - count(*) * avg({x2}) * avg({x2}) + 1 AS s22, sum({x1} * {x2}) - count(*) * avg({x1}) * avg({x2}) AS s12,
  sum({x1} * {y}) - count(*) * avg({x1}) * avg({y}) AS t1, sum({x2} * {y}) - count(*) * avg({x2}) * avg({y}) AS t2 FROM {src} WHERE role = 'train' GROUP BY fold),
{name} AS (SELECT f.fold, f.event_id, f.y, f.k, my + ((s22 * t1 - s12 * t2) * (f.{x1} - m1) + (s11 * t2 - s12 * t1) * (f.{x2} - m2)) / (s11 * s22 - s12 * s12) AS pred FROM {src} f JOIN {name}m USING (fold) WHERE role = 'test')"""


@query([], f"WITH {_EV}, {_FOLDS}, {_ridge('fl', 'a', 'b', 'y', 'p')} SELECT fold, event_id, round(pred, 6) AS pred, round(abs(pred - y), 6) AS loss FROM p")
def r5_ridge_probe(spark, sf):
    ev = _events(spark, sf)
    folds = R.expanding_folds(ev.withColumn("x", F.array("a", "b")).select("event_id", "x", "y"), ["event_id"], 4)
    return R.ridge_probe(folds, ["fold"]).select("fold", "event_id", r6("pred").alias("pred"), r6("loss").alias("loss"))


_CLASSES = ", ".join(_ridge(f"(SELECT *, CASE WHEN k = {c} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS t FROM fl)", "a", "b", "t", f"q{i}") for i, c in enumerate((-1, 0, 1)))


@query([], f"""WITH {_EV}, {_FOLDS}, {_CLASSES}, b AS (SELECT fold, event_id, q0.k, CASE WHEN round(q0.pred, 9) >= round(greatest(q1.pred, q2.pred), 9) THEN -1 WHEN round(q1.pred, 9) >= round(q2.pred, 9) THEN 0 ELSE 1 END AS pred FROM q0 JOIN q1 USING (fold, event_id) JOIN q2 USING (fold, event_id))
SELECT fold, event_id, k AS y, pred, CAST(pred <> k AS DOUBLE) AS loss FROM b""")
def r6_ridge_classes(spark, sf):
    ev = _events(spark, sf).withColumn("x", F.array("a", "b")).select("event_id", "x", F.col("k").alias("y"))
    return R.ridge_classes(R.expanding_folds(ev, ["event_id"], 4), ["fold"], [-1, 0, 1])


_TAIL = "fl AS (SELECT s.*, a + 0.5::DOUBLE * y AS al, fold, CASE WHEN i < n - (3 - fold) * (n // 4) THEN 'train' WHEN i < n - (2 - fold) * (n // 4) THEN 'test' END AS role FROM s, n, (SELECT unnest(range(3))::INTEGER AS fold))"
_RANKED = "SELECT fold, corr(rp, ry) AS ic FROM (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY q) + (count(*) OVER (PARTITION BY fold, q) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY fold ORDER BY y) + (count(*) OVER (PARTITION BY fold, y) - 1) / 2.0 AS ry FROM (SELECT *, round(pred, 9) AS q FROM {})) GROUP BY fold"


@query([], f"""WITH {_EV}, {_TAIL}, {_ridge('fl', 'al', 'b', 'y', 'pl')}, {_ridge('fl', 'a', 'b', 'y', 'pc')}, l AS ({_RANKED.format('pl')}), c AS ({_RANKED.format('pc')}), d AS (SELECT fold, l.ic AS leak, c.ic AS clean, l.ic - c.ic AS delta FROM l JOIN c USING (fold)),
f AS (SELECT draw, avg(delta * CASE WHEN CAST('0x' || left(md5('folds:' || draw || ':' || fold), 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS m FROM d, (SELECT unnest(range(200)) AS draw) GROUP BY draw),
p AS (SELECT avg(CAST(round(m, 9) >= round((SELECT avg(delta) FROM d), 9) AS DOUBLE)) AS p FROM f) SELECT fold, round(leak, 5) AS leak, round(clean, 5) AS clean, round(delta, 5) AS delta, p FROM d, p""")
def r4_r7_row_probe(spark, sf):
    """Folds from the end, a probe on leaked and clean rows, rank correlations by fold, and a sign-flip test on their differences."""
    rows = _events(spark, sf).withColumns({"leak": F.array(F.col("a") + 0.5 * F.col("y"), F.col("b")), "clean": F.array("a", "b")})
    folds = R.tail_folds(rows, ["event_id"], 3)
    score = lambda side: R.spearman(R.ridge_predictions(folds.withColumnRenamed(side, "x"), ["fold"], ["y"]).withColumn("q", F.round("pred", 9)), "q", "y", ["fold"]).select("fold", F.col("ic").alias(side))
    d = score("leak").join(score("clean"), "fold").withColumn("delta", F.col("leak") - F.col("clean"))
    p = R.sign_flip(d, "fold", "delta", 200, "folds", 9).select("p")
    return d.join(F.broadcast(p)).select("fold", *[F.round(c, 5).alias(c) for c in ("leak", "clean", "delta")], "p")


def _boot(name: str, b: int, share: str) -> str:
    """SQL of the bootstrap's (draw, i)."""
    return f"""gr AS (SELECT draw, i AS pos, CAST('0x' || left(md5('{name}:' || draw || ':' || i || ':new'), 8) AS BIGINT) < 4294967296.0::DOUBLE / {share} OR i = 0 AS fresh, CAST('0x' || left(md5('{name}:' || draw || ':' || i || ':at'), 8) AS BIGINT) % n AS st FROM s, n, (SELECT unnest(range({b})) AS draw)),
ix AS (SELECT draw, (last_value(CASE WHEN fresh THEN st - pos END IGNORE NULLS) OVER (PARTITION BY draw ORDER BY pos ROWS UNBOUNDED PRECEDING) + pos + n) % n AS i FROM gr, n)"""


def _ic(src: str, x: str, part: str) -> str:
    return f"SELECT {part}, CASE WHEN stddev_pop({x}) < 1e-8 OR stddev_pop(r) < 1e-8 THEN 0 ELSE corr(rx, ry) END AS ic FROM (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {part} ORDER BY r) + (count(*) OVER (PARTITION BY {part}, r) - 1) / 2.0 AS ry FROM {src}) GROUP BY {part}"


_RET = "rt AS (SELECT i, 0 AS one, round(y - 0.5::DOUBLE + b, 6) AS r, round(a + 0.5::DOUBLE * y, 6) AS sl, round(a, 6) AS sc FROM s)"


def _returns(spark, sf):
    return _events(spark, sf).select("event_id", F.round(F.col("y") - 0.5 + F.col("b"), 6).alias("r"), F.round(F.col("a") + 0.5 * F.col("y"), 6).alias("sl"), F.round("a", 6).alias("sc"))


@query([], f"""WITH {_EV}, {_RET}, {_boot('ic', 40, 'greatest(2.0::DOUBLE, n / 8.0::DOUBLE)')}, dr AS (SELECT ix.draw, rt.* FROM ix JOIN rt USING (i)), l AS ({_ic('dr', 'sl', 'draw')}), c AS ({_ic('dr', 'sc', 'draw')}), d AS (SELECT l.ic - c.ic AS d FROM l JOIN c USING (draw)),
o AS (SELECT (SELECT ic FROM ({_ic('rt', 'sl', 'one')})) AS il, (SELECT ic FROM ({_ic('rt', 'sc', 'one')})) AS ic) SELECT round(il, 6) AS ic_leak, round(o.ic, 6) AS ic_clean, round(il - o.ic, 6) AS delta, round((SELECT quantile_cont(d, 0.025) FROM d), 6) AS lo, round((SELECT quantile_cont(d, 0.975) FROM d), 6) AS hi,
CASE WHEN il > o.ic THEN (SELECT avg(CAST(round(d, 12) <= 0 AS DOUBLE)) FROM d) ELSE (SELECT avg(CAST(round(d, 12) >= 0 AS DOUBLE)) FROM d) END AS p FROM o""")
def r9_delta_ic(spark, sf):
    d = R.delta_ic(_returns(spark, sf), "event_id", "sl", "sc", "r", 40)
    return d.select(*[r6(c).alias(c) for c in ("ic_leak", "ic_clean", "delta", "lo", "hi")], "p")


_NET = "(pos_{0} * r - 0.0005::DOUBLE * abs(pos_{0} - coalesce(lag(pos_{0}) OVER (ORDER BY i), 0)))"
_SH = "CASE WHEN stddev_pop({0}) < 1e-8 THEN 0 ELSE avg({0}) / stddev_pop({0}) * sqrt(8) END"


@query([], f"""WITH {_EV}, {_RET}, {_boot('sr', 40, '4.0::DOUBLE')}, ps AS (SELECT *, CASE WHEN sl > 0.2::DOUBLE THEN 1.0::DOUBLE WHEN sl < -0.2::DOUBLE THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS pos_l, CASE WHEN sc > 0.2::DOUBLE THEN 1.0::DOUBLE WHEN sc < -0.2::DOUBLE THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS pos_c FROM rt),
nt AS (SELECT i, {_NET.format('l')} AS nl, {_NET.format('c')} AS nc FROM ps), d AS (SELECT draw, {_SH.format('nl')} - {_SH.format('nc')} AS d FROM ix JOIN nt USING (i) GROUP BY draw), o AS (SELECT {_SH.format('nl')} AS l, {_SH.format('nc')} AS c FROM nt)
SELECT round(l, 6) AS sharpe_leak, round(c, 6) AS sharpe_clean, round(l - c, 6) AS delta, round((SELECT quantile_cont(d, 0.025) FROM d), 6) AS lo, round((SELECT quantile_cont(d, 0.975) FROM d), 6) AS hi, (SELECT avg(CAST(round(d, 12) <= 0 AS DOUBLE)) FROM d) AS p FROM o""")
def r10_delta_sharpe(spark, sf):
    d = R.delta_sharpe(_returns(spark, sf), "event_id", "sl", "sc", "r", 40)
    return d.select(*[r6(c).alias(c) for c in ("sharpe_leak", "sharpe_clean", "delta", "lo", "hi")], "p")


_F1C = " + ".join(f"CASE WHEN count(*) FILTER (pr = {c}) + count(*) FILTER (k = {c}) > 0 THEN 2.0::DOUBLE * count(*) FILTER (pr = {c} AND k = {c}) / (count(*) FILTER (pr = {c}) + count(*) FILTER (k = {c})) ELSE 0 END" for c in (-1, 0, 1))


@query([], f"""WITH {_EV}, pd AS (SELECT i, k, CASE WHEN a > 0.02 THEN 1 WHEN a < -0.02 THEN -1 ELSE 0 END AS pr FROM s), {_boot('f1', 40, '8.0::DOUBLE')}, d AS (SELECT draw, ({_F1C}) / 3 AS f FROM ix JOIN pd USING (i) GROUP BY draw)
SELECT round((SELECT ({_F1C}) / 3 FROM pd), 6) AS f1, round(quantile_cont(f, 0.025), 6) AS lo, round(quantile_cont(f, 0.975), 6) AS hi, round(stddev_pop(f), 6) AS sd FROM d""")
def r12_f1_interval(spark, sf):
    pr = F.when(F.col("a") > 0.02, 1).when(F.col("a") < -0.02, -1).otherwise(0)
    d = R.f1_interval(_events(spark, sf).select("event_id", "k", pr.alias("pr")), "event_id", "k", "pr", 40)
    return d.select(*[r6(c).alias(c) for c in ("f1", "lo", "hi", "sd")])


_SEEN = "cp AS (SELECT task_label AS y, CAST(sample_id % 3 - 1 AS INTEGER) AS p, [(sample_id % 5) / 10.0::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE - (sample_id % 5) / 10.0::DOUBLE] AS q FROM samples)"
_ONE = "CASE WHEN count(*) FILTER (p = {0}) + count(*) FILTER (y = {0}) > 0 THEN 2.0::DOUBLE * count(*) FILTER (p = {0} AND y = {0}) / (count(*) FILTER (p = {0}) + count(*) FILTER (y = {0})) ELSE 0 END"
_CNT = ", ".join(f"count(*) FILTER (p = {c})::DOUBLE AS p{i}, count(*) FILTER (y = {c})::DOUBLE AS y{i}, count(*) FILTER (p = {c} AND y = {c})::DOUBLE AS t{i}" for i, c in enumerate((-1, 0, 1)))


@query(["samples"], f"""WITH {_SEEN}, c AS (SELECT count(*) AS n, {_CNT}, {_ONE.format(-1)} AS f0, {_ONE.format(0)} AS f1, {_ONE.format(1)} AS f2, avg(pow(q[1] - CAST(y = -1 AS DOUBLE), 2) + pow(q[2] - CAST(y = 0 AS DOUBLE), 2) + pow(q[3] - CAST(y = 1 AS DOUBLE), 2)) AS br FROM cp)
SELECT n, round((f0 + f1 + f2) / 3, 6) AS macro_f1, round(((t0 + t1 + t2) * n - p0 * y0 - p1 * y1 - p2 * y2) / sqrt((n * n - p0 * p0 - p1 * p1 - p2 * p2) * (n * n - y0 * y0 - y1 * y1 - y2 * y2)), 6) AS mcc, round(f0, 6) AS f1_dovish, round(f1, 6) AS f1_neutral, round(f2, 6) AS f1_hawkish, round(br, 6) AS brier FROM c""")
def a15_competence(spark, sf):
    tenth = (F.col("sample_id") % 5) / F.lit(10.0)
    d = view(spark, sf, "samples").select(F.col("task_label").alias("y"), (F.col("sample_id") % 3 - 1).cast("int").alias("p"), F.array(tenth, F.lit(0.5), F.lit(0.5) - tenth).alias("q"))
    out = R.competence(d, "y", "p").join(F.broadcast(R.brier(d, "y", "q")))
    return out.select("n", *[r6(c).alias(c) for c in ("macro_f1", "mcc", "f1_dovish", "f1_neutral", "f1_hawkish", "brier")])


@query(["samples"], f"WITH {_SEEN} SELECT a.y, b.p, count(cp.y) AS n FROM (SELECT unnest([-1, 0, 1]) AS y) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS p) b LEFT JOIN cp ON cp.y = a.y AND cp.p = b.p GROUP BY ALL")
def a15_confusion(spark, sf):
    d = view(spark, sf, "samples").select(F.col("task_label").cast("int").alias("y"), (F.col("sample_id") % 3 - 1).cast("int").alias("p"))
    return R.confusion(d, "y", "p")


_SLICES = "sl AS (SELECT CAST(vec_id % 7 AS BIGINT) AS slice, sum(CAST(round(embedding[1]::DOUBLE * 1000) AS BIGINT))::DOUBLE / count(*) AS value FROM embeddings GROUP BY 1)"


@query([], f"WITH {_SLICES}, d AS (SELECT slice, value - 0.25::DOUBLE AS decay, row_number() OVER (ORDER BY slice) - 1 AS x FROM sl) SELECT slice, round(decay, 6) AS decay, round((SELECT avg(decay) FROM d), 6) AS mean_decay, round((SELECT regr_slope(decay, x) FROM d), 6) AS slope FROM d")
def a18_robustness(spark, sf):
    v = F.sum(F.round(F.col("embedding")[0].cast("double") * 1000).cast("long")).cast("double") / F.count("*")
    s = table(spark, sf, "embeddings").groupBy((F.col("vec_id") % 7).alias("slice")).agg(v.alias("value"))
    return R.robustness(s, F.lit(0.25)).select("slice", *[r6(c).alias(c) for c in ("decay", "mean_decay", "slope")])


_BR = "br AS (SELECT CAST(label AS BIGINT) AS seed, (vec_id % 5)::DOUBLE / 4 AS dose, " + ", ".join(f"sum(CAST(round(embedding[{i}]::DOUBLE * 1000) AS BIGINT))::DOUBLE / count(*) AS e{i}" for i in range(1, 6)) + " FROM embeddings GROUP BY ALL)"


def _branches(spark, sf):
    e = lambda i: (F.sum(F.round(F.col("embedding")[i - 1].cast("double") * 1000).cast("long")).cast("double") / F.count("*")).alias(f"e{i}")
    return table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("seed"), ((F.col("vec_id") % 5).cast("double") / 4).alias("dose")).agg(*[e(i) for i in range(1, 6)])


@query([], f"WITH {_BR}, u AS (SELECT seed, dose, unnest(['e1', 'e2', 'e3', 'e4', 'e5']) AS endpoint, unnest([e1, e2, e3, e4, e5]) AS v FROM br), t AS (SELECT endpoint, dose, avg(v) AS m, stddev_pop(v) AS sd, stddev_samp(v) / sqrt(count(*)) AS sem, count(*) AS n FROM u GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY endpoint ORDER BY round(m, 9)) AS rm FROM t) SELECT endpoint, dose, round(m, 6) AS mean, round(sd, 6) AS sd, round(sem, 6) AS sem, n, round(corr(dose, rm) OVER (PARTITION BY endpoint), 6) AS spearman FROM k")
def a19_a23_dose_endpoints(spark, sf):
    """Five endpoints by dose: mean, deviation, standard error over seeds, and the rank correlation of dose and mean."""
    u = _branches(spark, sf).unpivot(["seed", "dose"], [f"e{i}" for i in range(1, 6)], "endpoint", "v")
    t = u.groupBy("endpoint", "dose").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))
    t = t.withColumn("q", F.round("mean", 9))
    ic = R.spearman(t, "dose", "q", ["endpoint"]).select("endpoint", r6("ic").alias("spearman"))
    return t.join(F.broadcast(ic), "endpoint").select("endpoint", "dose", r6("mean").alias("mean"), r6("sd").alias("sd"), r6("sem").alias("sem"), "n", "spearman")


@query([], f"WITH {_BR} SELECT seed, dose, round(e1, 6) AS value, round(avg(e1) OVER (PARTITION BY dose), 6) AS mean, CASE WHEN dose = 0 THEN 0.0::DOUBLE ELSE round(stddev_samp(e1) OVER (PARTITION BY dose) / sqrt(count(*) OVER (PARTITION BY dose)), 6) END AS sem FROM br")
def y48_dose_response(spark, sf):
    """Trajectories of seeds with mean and standard error by dose, 0 at dose 0."""
    w = Window.partitionBy("dose")
    sem = F.when(F.col("dose") == 0, 0.0).otherwise(r6(F.stddev_samp("e1").over(w) / F.sqrt(F.count("*").over(w))))
    return _branches(spark, sf).select("seed", "dose", r6("e1").alias("value"), r6(F.avg("e1").over(w)).alias("mean"), sem.alias("sem"))


_DOSES = (0.0, 0.25, 0.5, 0.75, 1.0)


@query([], f"WITH {_BR} SELECT seed, " + ", ".join(f"round(max(e1) FILTER (dose = {d}), 6) AS repr_{int(100 * d)}, coalesce(max(CAST(e2 > 0 AS INTEGER)) FILTER (dose = {d}), 0) AS sig_{int(100 * d)}" for d in _DOSES) + " FROM br GROUP BY seed")
def a21_seed_dose_matrix(spark, sf):
    """Values and significance of every branch, a row a seed."""
    b = _branches(spark, sf).select("seed", (F.col("dose") * 100).cast("int").cast("string").alias("d"), r6("e1").alias("repr"), (F.col("e2") > 0).cast("int").alias("sig"))
    wide = b.groupBy("seed").pivot("d", [str(int(100 * d)) for d in _DOSES]).agg(F.first("repr").alias("repr"), F.first("sig").alias("sig"))
    names = {f"{int(100 * d)}_{c}": f"{c}_{int(100 * d)}" for d in _DOSES for c in ("repr", "sig")}
    return wide.select("seed", *[(F.coalesce(F.col(f"`{a}`"), F.lit(0)) if b.startswith("sig") else F.col(f"`{a}`")).alias(b) for a, b in names.items()])


@query([], f"WITH {_BR} SELECT seed, dose, round(e1, 6) AS c, round(e5, 6) AS sharpe, 0 AS label, 1.0::DOUBLE AS p FROM br")
def f16_f18_pareto(spark, sf):
    """Coordinates of every branch, beside what a model that has learned nothing would say."""
    b = _branches(spark, sf).select("seed", "dose", R.pareto(*[F.col(f"e{i}") for i in range(1, 6)]).alias("x"), R.null_prediction().alias("z"))
    return b.select("seed", "dose", r6("x.competence_C").alias("c"), r6("x.economic_E_L_sharpe").alias("sharpe"), F.col("z.label").alias("label"), F.col("z.p")[1].alias("p"))


@query([], "WITH e AS (SELECT CAST(vec_id // 4 AS BIGINT) AS event_id, min(vec_id) AS seq, CAST(max(vec_id * 7 % 50) AS BIGINT) AS y FROM embeddings GROUP BY 1) SELECT event_id, y, row_number() OVER (ORDER BY event_id) - 1 AS place FROM e")
def j14_j15_o8_event_order(spark, sf):
    """Events once, by their first row, with the place of each in order."""
    e = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("event_id")).agg(F.max(F.col("vec_id") * 7 % 50).alias("y"))
    return R.numbered(e, ["event_id"], "place")


@query([], "SELECT min(place) AS lo, max(place) AS hi, count(DISTINCT place) AS n, count(*) FILTER (place = doc_id_rank) AS same FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, row_number() OVER (ORDER BY doc_id) - 1 AS doc_id_rank FROM documents)")
def o10_numbered_in_ranges(spark, sf):
    """Rows numbered in ranges, as large tables are, against the numbers of one window."""
    d = table(spark, sf, "documents").select("doc_id")
    both = R.numbered(d, ["doc_id"], "place", rows=16).join(R.numbered(d, ["doc_id"], "one"), "doc_id")
    return both.agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.count_distinct("place").alias("n"), F.count_if(F.col("place") == F.col("one")).alias("same"))
