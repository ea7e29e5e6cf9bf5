"""Event-level statistics: folds, ridge probes, rank correlation, permutation tests, bootstraps, competence."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` sorted over all its partitions, written, with (_part, _row): the place of a row is that of its partition, then its number in it."""
    from chronolake.sources.sinks import folder

    at = folder(df.sparkSession, "ordered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(at)
    placed = df.sparkSession.read.parquet(at)  # partitions and numbers are settled, however often they are read
    return placed.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")


def _before(placed: DataFrame, size: Column) -> DataFrame:
    """(_part, _before): the sum of sizes in the partitions before, a row a partition."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("_part").agg(F.sum(size).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, order: list[str], name: str = "i", rows: int = 1 << 20) -> DataFrame:
    """`df` with its rows numbered from 0 by `order`: in one window up to `rows`, beyond in the ranges of a sort over all partitions."""
    if df.count() <= rows:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    placed = in_ranges(df, order)
    return placed.join(F.broadcast(_before(placed, F.lit(1))), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def ranked(df: DataFrame, col: str, name: str, rows: int = 1 << 20) -> DataFrame:
    """`df` with the rank of `col` among all rows, ties averaged, from counts of its values; null has no rank."""
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_c"))
    if values.count() <= rows:
        before = F.sum("_c").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
        values = values.select("_v", (F.coalesce(before, F.lit(0)) + (F.col("_c") + 1) / 2).alias(name))
    else:
        placed = in_ranges(values, ["_v"])
        inside = F.sum("_c").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
        values = placed.withColumn("_own", F.coalesce(inside, F.lit(0))).join(F.broadcast(_before(placed, F.col("_c"))), "_part")
        values = values.select("_v", (F.col("_before") + F.col("_own") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(values, F.col(col) == F.col("_v"), "left").drop("_v")


def expanding_folds(events: DataFrame, order: list[str], k: int = 4) -> DataFrame:
    """(event columns, fold, role): fold f tests the f-th of k blocks after the first and trains on all before it."""
    n = events.count()
    k = max(1, min(k, n - 1))
    size = max(1, n // (k + 1))
    seq = numbered(events, order)
    folds = events.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    lo = (F.col("fold") + 1) * size
    hi = F.when(F.col("fold") == k - 1, n).otherwise(lo + size)
    role = F.when(F.col("i") < lo, "train").when(F.col("i") < hi, "test")
    return seq.join(F.broadcast(folds)).withColumn("role", role).where("role IS NOT NULL").drop("i")


def tail_folds(events: DataFrame, order: list[str], splits: int = 4) -> DataFrame:
    """(event columns, fold, role): the last k blocks of n // (k + 1) events are tested, each after all before it; k is at most n // 3."""
    n = events.count()
    k = max(2, min(splits, n // 3))
    size = n // (k + 1)
    seq = numbered(events, order)
    folds = events.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    lo = n - (k - F.col("fold")) * size
    role = F.when(F.col("i") < lo, "train").when(F.col("i") < lo + size, "test")
    return seq.join(F.broadcast(folds)).withColumn("role", role).where("role IS NOT NULL").drop("i")


def event_vectors(rows: DataFrame, event: str, order: str, vector: str, rule: str = "mean") -> DataFrame:
    """(event, vector): mean, maximum or last of an event's vectors, dimension by dimension; events are in order of their first row."""
    if rule == "last":
        return rows.groupBy(event).agg(F.max_by(vector, order).alias(vector), F.min(order).alias("first"))
    how = {"mean": F.avg, "max": F.max}[rule]
    dims = rows.select(event, order, F.posexplode(vector).alias("i", "x")).groupBy(event, "i").agg(how(F.col("x").cast("double")).alias("x"), F.min(order).alias("first"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])  # a row a dimension
    return dims.groupBy(event).agg(whole.alias(vector), F.min("first").alias("first"))


def average_rank(col: str, part: list[str] | None = None) -> Column:
    """Ranks with ties averaged."""
    p = part or [F.lit(0)]
    first = F.rank().over(Window.partitionBy(*p).orderBy(col))
    ties = F.count("*").over(Window.partitionBy(*p, col))
    return first + (ties - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, part: list[str]) -> DataFrame:
    """Rank correlation by group; 0 where either side doesn't vary."""
    ranked = df.withColumns({"_x": average_rank(x, part), "_y": average_rank(y, part)})
    flat = (F.stddev_pop(x) < 1e-8) | (F.stddev_pop(y) < 1e-8)
    return ranked.groupBy(*part).agg(F.when(flat, 0.0).otherwise(F.corr("_x", "_y")).alias("ic"), F.count("*").alias("n"))


def spearman_all(df: DataFrame, x: str, y: str) -> DataFrame:
    """(ic, n) of all rows, one row; 0 where either side doesn't vary.  No task ranks more than a range of values."""
    both = ranked(ranked(df, x, "_x"), y, "_y")
    flat = (F.stddev_pop(x) < 1e-8) | (F.stddev_pop(y) < 1e-8)
    told = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return both.agg(F.when(flat, 0.0).otherwise(told).alias("ic"), F.count("*").alias("n"))


def draws(spark, b: int, kind: str = "draw") -> DataFrame:
    return spark.range(b).select(F.col("id").alias(kind))


def hash_sign(*parts: Column) -> Column:
    """+1 or -1 from a digest, so that any engine can make the same draws."""
    return F.when(F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def hash_index(n: int, *parts: Column) -> Column:
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("long")


def sign_flip(deltas: DataFrame, key: str, value: str, b: int = 200, seed: str = "flip", digits: int = 12) -> DataFrame:
    """(observed, p): share of sign-flipped means that reach the observed one, and the version that can't be 0."""
    d = deltas.select(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))
    flipped = d.join(F.broadcast(draws(d.sparkSession, b))).groupBy("draw").agg(F.avg(F.col("v") * hash_sign(F.lit(seed), F.col("draw").cast("string"), F.col("k"))).alias("m"))
    seen = d.agg(F.avg("v").alias("observed"))  # one row
    both = flipped.join(F.broadcast(seen))
    reach = F.round("m", digits) >= F.round("observed", digits)
    return both.groupBy("observed").agg(F.avg(reach.cast("double")).alias("p"), ((F.count_if(reach) + 1) / (F.count("*") + 1)).alias("p_plus"))


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) from a digest."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def power_simulation(spark, n: int = 32, effect: float = 0.5, alpha: float = 0.05, sims: int = 50, flips: int = 99, seed: str = "power") -> DataFrame:
    """(power, sims): share of simulated studies of n normal differences around `effect` that a one-sided sign-flip test rejects."""
    sim = draws(spark, sims, "sim").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    text = [F.lit(seed), F.col("sim").cast("string"), F.col("i").cast("string")]
    normal = F.sqrt(-2 * F.log(hash_unit(*text, F.lit("r")))) * F.cos(2 * np.pi * hash_unit(*text, F.lit("a")))
    data = sim.withColumn("v", F.round((normal + effect) * 1e6).cast("long"))  # whole numbers, so that sums don't depend on their order
    seen = F.sum("v").over(Window.partitionBy("sim"))
    flipped = data.withColumn("seen", seen).join(F.broadcast(draws(spark, flips)))
    sign = hash_sign(F.lit(seed), F.col("sim").cast("string"), F.col("draw").cast("string"), F.col("i").cast("string"))
    sums = flipped.groupBy("sim", "seen", "draw").agg(F.sum(F.col("v") * sign).alias("s"))
    p = sums.groupBy("sim").agg(((F.count_if(F.col("s") >= F.col("seen")) + 1) / (F.count("*") + 1)).alias("p"))
    return p.agg(F.avg((F.col("p") <= alpha).cast("double")).alias("power"), F.count("*").alias("sims"))


def ladder(metrics: DataFrame, models: list[str], value: str, cost: str) -> DataFrame:
    """(model, rung, value, cost, marginal) for every model in order; marginal is the change of value by that of cost, 1e-6 for none.

    A model without metrics keeps its rung, with nulls.
    """
    rungs = metrics.sparkSession.createDataFrame(list(enumerate(models)), "rung int, model string")
    w = Window.orderBy("rung")  # a row per model
    step = F.col(cost) - F.lag(cost).over(w)
    joined = F.broadcast(rungs).join(metrics.select("model", value, cost), "model", "left")
    return joined.withColumn("marginal", (F.col(value) - F.lag(value).over(w)) / F.when(step == 0, 1e-6).otherwise(step))


def branches(spark, seeds: list[int], doses: list[float]) -> DataFrame:
    """(seed, dose) of a study's grid."""
    return spark.createDataFrame([(s, d) for s in seeds for d in doses], "seed long, dose double")


def uneven(rows: DataFrame, seed: str, same: list[str]) -> DataFrame:
    """Seeds whose branches differ in a column that all of them must share, with the number of values of each."""
    kinds = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0null"))).alias(c) for c in same]
    return rows.groupBy(seed).agg(*kinds).where(" OR ".join(f"`{c}` > 1" for c in same))


def against_base(rows: DataFrame, seed: str, dose: str, value: str, base: float = 0.0) -> DataFrame:
    """(seed, dose, contrast): each branch's value less that of its seed's base branch; null without one."""
    w = Window.partitionBy(seed)
    zero = F.max(F.when(F.col(dose) == base, F.col(value))).over(w)
    return rows.select(seed, dose, (F.col(value) - zero).alias("contrast")).where(F.col(dose) != base)


def boot_index(values: DataFrame, order: str, b: int, block: float, seed: str, stretch: int = 1 << 14) -> tuple[DataFrame, DataFrame]:
    """(`values` numbered by i, (draw, i)): a circular stationary bootstrap, at each place a new start with chance 1/block, else the next value.

    Starts are looked up within stretches of places, and the last one of each is handed on to the next, so no task holds a whole draw.
    """
    v = numbered(values, [order])
    n = values.count()
    grid = v.select(F.col("i").alias("pos")).join(F.broadcast(draws(v.sparkSession, b)))
    text = [F.lit(seed), F.col("draw").cast("string"), F.col("pos").cast("string")]
    fresh = (F.col("pos") == 0) | (hash_index(1 << 32, *text, F.lit("new")) < F.lit(2**32 / max(1.0, block)))
    start = F.when(fresh, F.struct(F.col("pos").alias("p"), hash_index(n, *text, F.lit("at")).alias("s")))
    grid = grid.withColumn("stretch", F.floor(F.col("pos") / stretch)).withColumn("st", start)
    handed = F.last("st", True).over(Window.partitionBy("draw").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    before = grid.groupBy("draw", "stretch").agg(F.max("st").alias("st")).select("draw", "stretch", handed.alias("before"))  # a row a stretch
    w = Window.partitionBy("draw", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = grid.withColumn("st", F.last("st", True).over(w)).join(before, ["draw", "stretch"]).withColumn("st", F.coalesce("st", "before"))
    return v, found.select("draw", ((F.col("st.s") + F.col("pos") - F.col("st.p")) % n).alias("i"))


def interval(values: DataFrame, value: str) -> DataFrame:
    return values.agg(F.avg(value).alias("mean"), F.percentile(value, 0.025).alias("lo"), F.percentile(value, 0.975).alias("hi"))


def block_bootstrap(values: DataFrame, order: str, value: str, b: int = 100, block: int = 4, seed: str = "boot") -> DataFrame:
    """(mean, lo, hi) of the means of a stationary bootstrap."""
    v, index = boot_index(values.select(order, F.col(value).alias("v")), order, b, block, seed)
    return interval(index.join(v, "i").groupBy("draw").agg(F.avg("v").alias("m")), "m")


def delta_ic(events: DataFrame, order: str, leak: str, clean: str, ret: str, b: int = 100, seed: str = "ic") -> DataFrame:
    """(ic_leak, ic_clean, delta, lo, hi, p): difference of rank correlations with a return, its bootstrap interval, and the share of draws on the other side of 0."""
    n = events.count()
    both = {side: spearman_all(events, x, ret).select(F.coalesce("ic", F.lit(0.0)).alias(side)) for side, x in (("ic_leak", leak), ("ic_clean", clean))}
    seen = both["ic_leak"].join(F.broadcast(both["ic_clean"])).withColumn("delta", F.col("ic_leak") - F.col("ic_clean"))  # one row
    v, index = boot_index(events, order, b, max(2.0, n / 8), seed)
    drawn = index.join(v, "i")
    part = lambda x, name: spearman(drawn, x, ret, ["draw"]).select("draw", F.coalesce("ic", F.lit(0.0)).alias(name))
    delta = part(leak, "l").join(part(clean, "c"), "draw").select((F.col("l") - F.col("c")).alias("d"))
    wide = delta.agg(F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"), F.avg((F.round("d", 12) <= 0).cast("double")).alias("under"), F.avg((F.round("d", 12) >= 0).cast("double")).alias("over"))
    return seen.join(F.broadcast(wide)).select("ic_leak", "ic_clean", "delta", "lo", "hi", F.when(F.col("delta") > 0, F.col("under")).otherwise(F.col("over")).alias("p"))


def delta_sharpe(events: DataFrame, order: str, leak: str, clean: str, ret: str, b: int = 100, block: float = 4.0, cut: float = 0.2, cost: float = 0.0005, periods: float = 8.0, seed: str = "sr") -> DataFrame:
    """(sharpe_leak, sharpe_clean, delta, lo, hi, p): difference of the Sharpe ratios of two threshold strategies, its bootstrap interval, and the share of draws at or under 0."""
    v, index = boot_index(events, order, b, block, seed)

    def net(x: str) -> Column:
        pos = F.when(F.col(x) > cut, 1.0).when(F.col(x) < -cut, -1.0).otherwise(0.0)
        before = F.when(F.col(f"_{x}") > cut, 1.0).when(F.col(f"_{x}") < -cut, -1.0).otherwise(0.0)
        return pos * F.col(ret) - cost * F.abs(pos - before)

    after = v.select((F.col("i") + 1).alias("i"), *[F.col(x).alias(f"_{x}") for x in (leak, clean)])  # the event before, by number
    d = v.join(after, "i", "left").select("i", net(leak).alias("l"), net(clean).alias("c"))
    sharpe = lambda x: F.when(F.stddev_pop(x) < 1e-8, 0.0).otherwise(F.avg(x) / F.stddev_pop(x) * F.sqrt(F.lit(periods)))
    seen = d.agg(sharpe("l").alias("sharpe_leak"), sharpe("c").alias("sharpe_clean"))
    drawn = index.join(d, "i").groupBy("draw").agg((sharpe("l") - sharpe("c")).alias("d"))
    wide = drawn.agg(F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"), F.avg((F.round("d", 12) <= 0).cast("double")).alias("p"))
    return seen.withColumn("delta", F.col("sharpe_leak") - F.col("sharpe_clean")).join(F.broadcast(wide))


def f1_by(df: DataFrame, keys: list[str], y: str, p: str, classes=(-1, 0, 1)) -> DataFrame:
    """Macro F1 by key, 0 for a class that is neither there nor predicted."""
    aggs = [x for c in classes for x in (F.count_if((F.col(y) == c) & (F.col(p) == c)).alias(f"t{c}"), (F.count_if(F.col(p) == c) + F.count_if(F.col(y) == c)).alias(f"n{c}"))]
    one = lambda c: F.when(F.col(f"`n{c}`") > 0, 2.0 * F.col(f"`t{c}`") / F.col(f"`n{c}`")).otherwise(0.0)
    total = one(classes[0])
    for c in classes[1:]:
        total = total + one(c)
    return df.groupBy(*keys).agg(*aggs).select(*keys, (total / len(classes)).alias("f1"))


def f1_interval(rows: DataFrame, order: str, y: str, p: str, b: int = 100, block: float = 8.0, seed: str = "f1") -> DataFrame:
    """(f1, lo, hi, sd): macro F1, its bootstrap interval and deviation; with two rows or fewer the interval is the value."""
    seen = f1_by(rows.withColumn("_all", F.lit(0)), ["_all"], y, p).select("f1")
    if rows.count() <= 2:
        return seen.select("f1", F.col("f1").alias("lo"), F.col("f1").alias("hi"), F.lit(0.0).alias("sd"))
    v, index = boot_index(rows.select(order, y, p), order, b, block, seed)
    drawn = f1_by(index.join(v, "i"), ["draw"], y, p)
    return seen.join(F.broadcast(drawn.agg(F.percentile("f1", 0.025).alias("lo"), F.percentile("f1", 0.975).alias("hi"), F.stddev_pop("f1").alias("sd"))))


def brier(df: DataFrame, y: str, probabilities: str, classes=(-1, 0, 1)) -> DataFrame:
    """Mean squared distance between probabilities and what was so."""
    p = F.col(probabilities)
    gap = sum(((p[i] - (F.col(y) == c).cast("double")) ** 2 for i, c in enumerate(classes)), F.lit(0.0))
    return df.agg(F.avg(gap).alias("brier"))


def robustness(slices: DataFrame, baseline: Column) -> DataFrame:
    """(slice, decay) of each time slice, with mean decay and the slope over the slices in order; slices are few."""
    d = slices.withColumn("decay", F.col("value") - baseline).withColumn("x", (F.row_number().over(Window.orderBy("slice")) - 1).cast("double"))
    every = Window.partitionBy()
    return d.select("slice", "decay", F.avg("decay").over(every).alias("mean_decay"), F.coalesce(F.regr_slope("decay", "x").over(every), F.lit(0.0)).alias("slope"))


def pareto(c: Column, l_repr: Column, l_behavior: Column, ic: Column, sharpe: Column) -> Column:
    """The five coordinates of a model, never made into one number."""
    return F.struct(c.alias("competence_C"), l_repr.alias("leakage_L_repr"), l_behavior.alias("leakage_L_behavior"), ic.alias("economic_E_L_ic"), sharpe.alias("economic_E_L_sharpe"))


def null_prediction(n: int = 1) -> Column:
    """What a model that has learned nothing says: neutral, with certainty."""
    return F.struct(F.lit(0).alias("label"), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("p"))


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, b: int = 100, seed: str = "cluster") -> DataFrame:
    """(mean, lo, hi): whole clusters drawn with replacement."""
    c = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    c = numbered(c, [cluster])
    k = c.count()
    grid = c.select(F.col("i").alias("pos")).join(F.broadcast(draws(rows.sparkSession, b)))
    grid = grid.withColumn("i", hash_index(k, F.lit(seed), F.col("draw").cast("string"), F.col("pos").cast("string")))
    means = grid.join(c, "i").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def ridge_weights(rows: DataFrame, groups: list[str], targets: list[str], alpha: float = 1.0) -> DataFrame:
    """(groups, target, mean, w, base): ridge with an intercept on each group's train rows for each target.

    Only sums and products meet by group: a task sends one matrix a group, whatever its number of rows.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in groups}
    train = rows.where("role = 'train'").select(*groups, "x", *targets)

    def sums(batches):
        held: dict[tuple, np.ndarray] = {}
        types: list = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in groups]
            d = batch.to_pandas()
            for key, g in d.groupby(groups, sort=False):
                x = np.stack(g.x.to_list()).astype(float)
                full = np.column_stack([np.ones(len(x)), x, g[targets].to_numpy(float)])
                held[key] = held.get(key, 0) + full.T @ full
        if held:
            cols = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([m.tobytes() for m in held.values()], pa.binary())], names=[*groups, "m"])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        flat = sum(np.frombuffer(m) for m in g.m)
        size = round(len(flat) ** 0.5)
        m, t = flat.reshape(size, size), len(targets)
        n, mean = m[0, 0], m[0] / m[0, 0]
        centred = m - n * np.outer(mean, mean)
        dim = size - 1 - t
        w = np.linalg.solve(centred[1 : dim + 1, 1 : dim + 1] + alpha * np.eye(dim), centred[1 : dim + 1, dim + 1 :])
        head = {c: [g[c].iloc[0]] * t for c in groups}
        return pd.DataFrame(head | {"target": targets, "mean": [mean[1 : dim + 1].tolist()] * t, "w": w.T.tolist(), "base": mean[dim + 1 :]})

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return train.mapInArrow(sums, f"{schema}, m binary").groupBy(*groups).applyInPandas(solve, f"{schema}, target string, mean array<double>, w array<double>, base double")


def ridge_predictions(rows: DataFrame, groups: list[str], targets: list[str], alpha: float = 1.0) -> DataFrame:
    """Test rows, one for each target, with `pred`."""
    weights = F.broadcast(ridge_weights(rows, groups, targets, alpha))  # a row a group and target
    test = rows.where("role = 'test'").join(weights, groups)
    gap = F.aggregate(F.zip_with(F.zip_with("x", "mean", lambda a, m: a.cast("double") - m), "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return test.withColumn("pred", F.col("base") + gap).drop("mean", "w", "base")


def ridge_probe(rows: DataFrame, groups: list[str], alpha: float = 1.0, squared: bool = False) -> DataFrame:
    """(groups, event_id, pred, loss) of test rows, the loss absolute or squared."""
    p = ridge_predictions(rows, groups, ["y"], alpha)
    gap = F.col("pred") - F.col("y")
    return p.select(*groups, "event_id", "pred", (gap**2 if squared else F.abs(gap)).alias("loss"))


def ridge_classes(rows: DataFrame, groups: list[str], classes: list, alpha: float = 1.0) -> DataFrame:
    """(groups, event_id, y, pred, loss) of test rows: the class whose own +-1 regression is highest (ties to the first), and whether it is wrong."""
    coded = rows.withColumns({f"_c{i}": F.when(F.col("y") == c, 1.0).otherwise(-1.0) for i, c in enumerate(classes)})
    p = ridge_predictions(coded, groups, [f"_c{i}" for i in range(len(classes))], alpha)
    place = F.regexp_extract("target", "([0-9]+)$", 1).cast("int")
    best = p.groupBy(*groups, "event_id", "y").agg(F.max(F.struct("pred", -place)).alias("b"))
    named = F.element_at(F.array(*map(F.lit, classes)), 1 - F.col("b.col2"))
    return best.select(*groups, "event_id", "y", named.alias("pred"), (named != F.col("y")).cast("double").alias("loss"))


def competence(df: DataFrame, y: str, p: str, classes=(-1, 0, 1)) -> DataFrame:
    """Macro F1 (0 where undefined) and Matthews correlation (0 where degenerate) from the confusion counts."""
    aggs = []
    for c in classes:
        aggs += [F.count_if((F.col(y) == c) & (F.col(p) == c)).alias(f"tp{c}"), F.count_if(F.col(p) == c).alias(f"pp{c}"), F.count_if(F.col(y) == c).alias(f"yy{c}")]
    t = df.agg(*aggs, F.count("*").alias("n"))
    col = lambda a, c: F.col(f"`{a}{c}`").cast("double")
    f1 = [F.when(col("pp", c) + col("yy", c) > 0, 2 * col("tp", c) / (col("pp", c) + col("yy", c))).otherwise(0.0) for c in classes]
    tp = sum((col("tp", c) for c in classes[1:]), col("tp", classes[0]))
    py = sum((col("pp", c) * col("yy", c) for c in classes[1:]), col("pp", classes[0]) * col("yy", classes[0]))
    pp = sum((col("pp", c) ** 2 for c in classes[1:]), col("pp", classes[0]) ** 2)
    yy = sum((col("yy", c) ** 2 for c in classes[1:]), col("yy", classes[0]) ** 2)
    n = F.col("n").cast("double")
    den = F.sqrt((n * n - pp) * (n * n - yy))
    own = [f.alias(f"f1_{name}") for f, name in zip(f1, ("dovish", "neutral", "hawkish"), strict=True)]
    return t.select("n", ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"), F.when(den > 0, (tp * n - py) / den).otherwise(0.0).alias("mcc"), *own)


def confusion(df: DataFrame, y: str, p: str, classes=(-1, 0, 1)) -> DataFrame:
    """(y, p, n) for every pair of classes, those that don't occur too."""
    pairs = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], f"{y} int, {p} int")
    return F.broadcast(pairs).join(df.groupBy(y, p).agg(F.count("*").alias("n")), [y, p], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(df: DataFrame, conf: str, right: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins (lo, hi]."""
    b = F.greatest(F.lit(1), F.ceil(F.col(conf) * bins))
    t = df.groupBy(b.alias("b")).agg(F.avg(conf).alias("c"), F.avg(right.cast("double")).alias("a"), F.count("*").alias("k"))
    return t.agg((F.sum(F.abs(F.col("c") - F.col("a")) * F.col("k")) / F.sum("k")).alias("ece"))


def threshold_strategy(df: DataFrame, score: str, ret: str, order: str, cut: float = 0.2, cost: float = 0.0005, periods: float = 8.0) -> DataFrame:
    """(ticker, total, sharpe, annual) of holding the sign of a score beyond the cut, after costs of turnover; a Sharpe ratio of 0 where nothing varies."""
    pos = F.when(F.col(score) > cut, 1.0).when(F.col(score) < -cut, -1.0).otherwise(0.0)
    w = Window.partitionBy("ticker").orderBy(order)
    d = df.withColumn("pos", pos).withColumn("net", F.col("pos") * F.col(ret) - cost * F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0))))
    s = F.stddev_pop("net")
    return d.groupBy("ticker").agg(F.sum("net").alias("total"), F.when(s >= 1e-8, F.avg("net") / s * F.sqrt(F.lit(periods))).otherwise(0.0).alias("sharpe"), (F.avg("net") * periods).alias("annual"))
