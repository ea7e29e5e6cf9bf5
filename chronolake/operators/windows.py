"""Order-dependent operators over price bars and signals.

Frames and `last(ignorenulls)` wherever a frame can say it.  Recursions (exponential
averages, clamped sums) go over Arrow batches of sorted rows, from one ticker to the
next: a task holds a batch, at any number of tickers and days.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = {"BUY": 1.0, "OVERWEIGHT": 0.75, "UNDERWEIGHT": 0.25, "SELL": 0.0}  # fixed values: exposure of a rating; HOLD keeps
UP, DOWN = ("BUY", "OVERWEIGHT"), ("SELL", "UNDERWEIGHT")


def by(key: str = "ticker", order: str = "d") -> Window:
    return Window.partitionBy(key).orderBy(order)


def fill_bars(df: DataFrame, cols=("open", "high", "low", "close", "volume"), w=None) -> DataFrame:
    """Forward, then backward fill in date order."""
    w = w or by()
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(past), F.first(c, True).over(future)) for c in cols})


def forward_return(k: int = 1, price: str = "close", w=None) -> Column:
    """Change over the next k rows; null at the end, 0 where the price is 0."""
    w = w or by()
    nxt = F.lead(price, k).over(w)
    return F.when(nxt.isNull(), None).when(F.col(price) == 0, 0.0).otherwise((nxt - F.col(price)) / F.col(price))


def lagged_mean(n: int, price: str = "close", w=None) -> Column:
    """Mean of the n rows before this one, null until there are n."""
    f = (w or by()).rowsBetween(-n, -1)
    return F.when(F.count(price).over(f) == n, F.avg(price).over(f))


def sma_cross(short: int = 5, long: int = 20, w=None) -> Column:
    a, b = lagged_mean(short, w=w), lagged_mean(long, w=w)
    return F.when(a > b, 1.0).when(a < b, -1.0).otherwise(0.0)


def mean_reversion(df: DataFrame, n: int = 20, cut: float = 1.0) -> DataFrame:
    """z score of log returns over n rows, one row late; below -cut long, above cut short, else held."""
    w = by()
    df = df.withColumn("lr", F.log(F.col("close") / F.lag("close").over(w)))
    f = w.rowsBetween(-(n - 1), 0)
    z = F.when(F.count("lr").over(f) == n, (F.col("lr") - F.avg("lr").over(f)) / (F.stddev_samp("lr").over(f) + 1e-9))
    df = df.withColumn("z", z).withColumn("zl", F.lag("z").over(w))
    trigger = F.when(F.col("zl") < -cut, 1.0).when(F.col("zl") > cut, -1.0)
    return df.withColumn("trigger", trigger).withColumn("position", held("trigger", w)).drop("trigger", "zl", "lr")


def held(trigger: str, w, start: float = 0.0) -> Column:
    """The last trigger so far."""
    return F.coalesce(F.last(trigger, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(start))


def runs(df: DataFrame, order: str) -> DataFrame:
    """Rows dealt out by ticker, each ticker's side by side and in order: a task streams through them, however many tickers or rows it has."""
    return df.repartition("ticker").sortWithinPartitions("ticker", F.asc_nulls_last(order))


def _starts(batch: pa.RecordBatch, last) -> tuple[list[bool], object]:
    """Whether each row is another ticker's than the one before, and the last ticker."""
    tickers = batch.column("ticker").to_pylist()
    return [t != before for t, before in zip(tickers, [last, *tickers], strict=False)], tickers[-1] if tickers else last


def _averaged(x: list[float], first: list[bool], a: float, kept: tuple[float, float] | None) -> tuple[list[float], tuple[float, float]]:
    """Exponential averages of a batch's runs, as pandas has them (missing values let the average before fade), and what the next batch goes on from."""
    y, weight = kept or (math.nan, 1.0)
    out = []
    for v, new in zip(x, first, strict=True):
        if new:
            y, weight = math.nan, 1.0
        if y == y:
            weight *= 1 - a
            if v == v:
                if y != v:
                    y = (weight * y + a * v) / (weight + a)
                weight = 1.0
        else:
            y = v
        out.append(y)
    return out, (y, weight)


def ewm(df: DataFrame, alphas: dict[str, tuple], order: str = "d") -> DataFrame:
    """Add exponential averages y = (1-a) y + a x, starting at the first value: {new: (column, a)}, all in one pass.

    The column may be another new one before it, or a pair whose difference is meant.
    """

    def each(batches):
        last, kept = object(), dict.fromkeys(alphas)
        for batch in batches:
            first, last = _starts(batch, last)
            made: dict[str, np.ndarray] = {}
            value = lambda c: made[c] if c in made else batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            for name, (col, a) in alphas.items():
                x = value(col) if isinstance(col, str) else value(col[0]) - value(col[1])
                y, kept[name] = _averaged(x.tolist(), first, a, kept[name])
                made[name] = np.array(y)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(y, from_pandas=True) for y in made.values())], names=[*batch.schema.names, *made])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema] + [f"{n} double" for n in alphas])
    return runs(df, order).mapInArrow(each, schema)


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's index from averages of gains and losses with weight 1/n."""
    return _rsi(ewm(_moves(df), _rsi_averages(n)))


def _moves(df: DataFrame) -> DataFrame:
    delta = F.coalesce(F.col("close") - F.lag("close").over(by()), F.lit(0.0))
    return df.withColumns({"gain": F.greatest(delta, F.lit(0.0)), "loss": F.greatest(-delta, F.lit(0.0))})


def _rsi_averages(n: int = 14) -> dict[str, tuple]:
    return {"ag": ("gain", 1 / n), "al": ("loss", 1 / n)}


def _rsi(df: DataFrame) -> DataFrame:
    return df.withColumn("rsi", 100 - 100 / (1 + F.col("ag") / (F.col("al") + 1e-9))).drop("gain", "loss", "ag", "al")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Sign of yesterday's difference of MACD and its signal line; the first slow-1 rows are flat."""
    df = ewm(df, {"ef": ("close", 2 / (fast + 1)), "es": ("close", 2 / (slow + 1)), "line": (("ef", "es"), 2 / (signal + 1))}).withColumn("macd", F.col("ef") - F.col("es"))
    w = by()
    diff = F.lag(F.col("macd") - F.col("line")).over(w)
    early = F.row_number().over(w) < slow
    return df.withColumn("position", F.when(early | diff.isNull(), 0.0).otherwise(F.signum(diff))).drop("ef", "es")


def kdj(df: DataFrame, n: int = 9) -> DataFrame:
    """Stochastic oscillator: K and D start at 50 and move a third of the way to RSV and K."""
    return ewm(_rsv(df, n), KDJ).withColumn("j", 3 * F.col("k") - 2 * F.col("dd"))


KDJ = {"k": ("rsv", 1 / 3), "dd": ("k", 1 / 3)}


def _rsv(df: DataFrame, n: int = 9) -> DataFrame:
    w = by()
    f = w.rowsBetween(-(n - 1), 0)
    low, high = F.min("low").over(f), F.max("high").over(f)
    rsv = F.when(F.row_number().over(w) >= n, (F.col("close") - low) / (high - low + 1e-9) * 100)
    return df.withColumn("rsv", F.coalesce(rsv, F.lit(50.0))).withColumn("rsv", F.when(F.row_number().over(w) == 1, 50.0).otherwise(F.col("rsv")))


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Mean of up to n closes and the bands `width` sample deviations around it; no bands on the first row."""
    f = by().rowsBetween(-(n - 1), 0)
    off = width * F.stddev_samp("close").over(f)
    df = df.withColumns({"boll": F.avg("close").over(f), "_off": off})
    return df.withColumns({"boll_ub": F.col("boll") + F.col("_off"), "boll_lb": F.col("boll") - F.col("_off")}).drop("_off")


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's average of the true range; the first day's range is high less low."""
    before = F.lag("close").over(by())  # null on the first day, which greatest and least pass over
    df = df.withColumn("tr", F.greatest("high", before) - F.least("low", before))
    return ewm(df, {"atr": ("tr", 1 / n)}).drop("tr")


def mfi(df: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index: share of the last n days' typical price times volume that came on rising days; 50 without any."""
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    step = F.col("_tp") - F.lag("_tp").over(by())
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumns({"_up": F.when(step > 0, flow).otherwise(0.0), "_down": F.when(step < 0, flow).otherwise(0.0)})
    f = by().rowsBetween(-(n - 1), 0)
    up, both = F.sum("_up").over(f), F.sum(F.col("_up") + F.col("_down")).over(f)
    return df.withColumn("mfi", F.when(both > 0, 100 * up / both).otherwise(50.0)).drop("_tp", "_up", "_down")


def vwma(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean of up to n closes by volume; null without volume."""
    f = by().rowsBetween(-(n - 1), 0)
    total = F.sum("volume").over(f)
    return df.withColumn("vwma", F.when(total > 0, F.sum(F.col("close") * F.col("volume")).over(f) / total))


def kdj_rsi(df: DataFrame, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """Yesterday's signs: buy as K crossed D upwards below `low` or RSI was below it, sell on the mirror image above `high`; buy wins, else held."""
    df = _rsi(ewm(_moves(_rsv(df.select("ticker", "d", "high", "low", "close"))), KDJ | _rsi_averages())).withColumn("j", 3 * F.col("k") - 2 * F.col("dd"))
    w = by()
    at = lambda c, n: F.lag(c, n).over(w)
    sure = lambda c: F.coalesce(c, F.lit(False))
    up = (at("k", 1) > at("dd", 1)) & (at("k", 2) <= at("dd", 2)) & (at("k", 1) < low)
    down = (at("k", 1) < at("dd", 1)) & (at("k", 2) >= at("dd", 2)) & (at("k", 1) > high)
    buy, sell = sure(up) | sure(at("rsi", 1) < low), sure(down) | sure(at("rsi", 1) > high)
    df = df.withColumn("trigger", F.when(buy, 1.0).when(sell, -1.0))
    return df.withColumn("position", held("trigger", w)).drop("trigger")


def bounded_stack(df: DataFrame, gate: float | None = None, order: str = "seq") -> DataFrame:
    """Steps of +-1 clamped to [-1, 1]; other signals, and those under the gate, leave it."""

    def each(batches):
        last, pos = object(), 0.0
        for batch in batches:
            (first, last), out = _starts(batch, last), []
            for step, new in zip(batch.column("step").to_pylist(), first, strict=True):
                pos = min(1.0, max(-1.0, (0.0 if new else pos) + step))
                out.append(pos)
            rest = batch.drop_columns(["step"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.float64())], names=[*rest.schema.names, "position"])

    step = F.when(F.col("signal").isin(*UP), 1.0).when(F.col("signal").isin(*DOWN), -1.0).otherwise(0.0)
    if gate is not None:
        step = F.when(F.col("confidence") >= gate, step).otherwise(0.0)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema] + ["position double"])
    return runs(df.withColumn("step", step), order).mapInArrow(each, schema)


def scaled_positions(w) -> Column:
    """Last direction times 2 (confidence - 0.5), clipped to [0, 1]."""
    size = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (F.col("confidence") - 0.5)))
    direction = F.when(F.col("signal").isin(*UP), size).when(F.col("signal").isin(*DOWN), -size)
    return F.coalesce(F.last(direction, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def rating_target(signal: Column, confidence: Column, gate: float) -> Column:
    """Exposure of a rating; null (keep) for HOLD, unknown ratings and confidence under the gate."""
    out = F.lit(None).cast("double")
    for name, x in TARGET.items():
        out = F.when(F.upper(signal) == name, x).otherwise(out)
    return F.when(confidence < gate, None).otherwise(out)


def positions(df: DataFrame, gate: float = 0.55, order: str = "seq") -> DataFrame:
    df = df.withColumn("target", rating_target(F.col("signal"), F.col("confidence"), gate))
    return df.withColumn("position", held("target", by(order=order)))


def equity(df: DataFrame, cost: float = 0.0005, order: str = "seq") -> DataFrame:
    """Turnover, net return, equity and drawdown of positions; the running peak begins with the first row."""
    w = by(order=order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    df = df.withColumn("net", F.col("position") * F.coalesce("actual_return", F.lit(0.0)) - cost * F.col("turnover"))
    df = df.withColumn("equity", F.product(1 + F.col("net")).over(run))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(run) - 1)


def strategy_metrics(df: DataFrame, rf: float = 0.05, order: str = "seq") -> DataFrame:
    """Total and annualised return, drawdown, Sharpe, Sortino and volatility by ticker (population deviations)."""
    day = (1 + rf) ** (1 / 252) - 1
    short = F.col("net") < day
    agg = df.groupBy("ticker").agg(
        F.max_by("equity", order).alias("final"), F.count("*").alias("n"), F.min("drawdown").alias("max_drawdown"),
        F.avg("net").alias("m"), F.stddev_pop("net").alias("s"), F.sqrt(F.avg(F.when(short, (F.col("net") - day) ** 2))).alias("ds"), F.sum("turnover").alias("turnover"),
    )
    return agg.select(
        "ticker", "n", (F.col("final") - 1).alias("total_return"), F.when(F.col("final") > 0, F.pow("final", 252.0 / F.col("n")) - 1).alias("annual_return"), "max_drawdown",
        F.when(F.col("s") > 0, (F.col("m") - day) / F.col("s") * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.when(F.col("ds") > 0, (F.col("m") - day) / F.col("ds") * F.sqrt(F.lit(252.0))).alias("sortino"), (F.col("s") * F.sqrt(F.lit(252.0))).alias("volatility"), "turnover",
    )


def capital_metrics(df: DataFrame, order: str = "seq") -> DataFrame:
    """The other convention: the curve includes the starting capital, sample deviation plus 1e-9, figures in percent."""
    w = by(order=order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("curve", F.product(1 + F.col("position") * F.coalesce("actual_return", F.lit(0.0))).over(w))
    df = df.withColumns({"peak": F.greatest(F.lit(1.0), F.max("curve").over(w)), "step": F.col("position") * F.coalesce("actual_return", F.lit(0.0))})
    return df.groupBy("ticker").agg(
        (100 * (F.max_by("curve", order) - 1)).alias("cr"), (100 * (F.pow(F.max_by("curve", order), 252.0 / F.count("*")) - 1)).alias("ar"),
        (F.avg("step") / (F.stddev_samp("step") + 1e-9) * F.sqrt(F.lit(252.0))).alias("sr"), (-100 * F.least(F.lit(0.0), F.min(F.col("curve") / F.col("peak") - 1))).alias("mdd"),
    )


def directional_accuracy(df: DataFrame) -> DataFrame:
    """Share of directional ratings whose return has their sign (0 is wrong); null without any."""
    s, r = F.upper("signal"), F.col("actual_return")
    right = s.isin(*UP) & (r > 0) | s.isin(*DOWN) & (r < 0)
    return df.where(s.isin(*UP, *DOWN)).groupBy("ticker").agg(F.avg(right.cast("double")).alias("accuracy"), F.count("*").alias("n"))


BINS = ((0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.01))


def calibration(df: DataFrame, by: list[str] | None = None, least: int = 50) -> DataFrame:
    """Accuracy of directional rows by confidence bin, right-open; empty bins stay.

    With `by`, a table of bins for each group; `unreliable` says that a table holds fewer than `least` rows in all.
    """
    by = by or []
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(BINS)], "bin int, lo double, hi double")
    c, r = F.col("confidence"), F.col("actual_return")
    which = F.lit(None).cast("int")
    for i, (a, b) in enumerate(BINS):
        which = F.when((c >= a) & (c < b), i).otherwise(which)
    right = F.col("signal").isin(*UP) & (r > 0) | F.col("signal").isin(*DOWN) & (r < 0)
    directional = df.where(F.col("signal").isin(*UP, *DOWN))
    got = directional.groupBy(*by, which.alias("bin")).agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))
    total = got.groupBy(*by).agg(F.sum("n").alias("total"))  # a row a group
    frame = total.withColumn("bins", F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(BINS)))).select(*by, "total", F.inline("bins")) if by else bins.join(F.broadcast(total))
    got = (frame if by else F.broadcast(frame)).join(got, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gap = F.col("accuracy") - (F.col("lo") + F.least(F.col("hi"), F.lit(1.0))) / 2
    told = F.when(F.col("n") == 0, "no data").when(gap > 0.1, "underconfident").when(gap < -0.1, "overconfident").otherwise("calibrated")
    return got.select(*by, "bin", "n", "accuracy", told.alias("assessment"), (F.coalesce("total", F.lit(0)) < least).alias("unreliable"))
