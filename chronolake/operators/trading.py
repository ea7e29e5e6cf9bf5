"""Indicator reports by name, backtest evaluation and its outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators import windows as W

CLOSED = "N/A: Not a trading day (weekend or holiday)"
# The indicators that can be asked for, the order of strategies in a table, and what a rating is worth.
INDICATORS = ("close_50_sma", "close_200_sma", "close_10_ema", "macd", "macds", "macdh", "rsi", "boll", "boll_ub", "boll_lb", "atr", "vwma", "mfi")
STRATEGIES = ("Buy & Hold", "SMA (5/20)", "MACD", "KDJ+RSI", "ZMR", "TA-Signal", "TA-Filtered", "TA-Scaled")


def sma(n: int) -> Column:
    return F.avg("close").over(W.by().rowsBetween(-(n - 1), 0))


def indicators(bars: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """`bars` with a column for each named indicator; an unknown name is an error."""
    unknown = [n for n in names if n not in INDICATORS]
    if unknown:
        raise ValueError(f"not an indicator: {', '.join(unknown)}; there are {', '.join(INDICATORS)}")
    df, want = bars, set(names)
    for name in ("close_50_sma", "close_200_sma"):
        if name in want:
            df = df.withColumn(name, sma(int(name.split("_")[1])))
    smooth = {}
    if "close_10_ema" in want:
        smooth["close_10_ema"] = ("close", 2 / 11)
    if want & {"macd", "macds", "macdh"}:
        smooth |= {"_fast": ("close", 2 / 13), "_slow": ("close", 2 / 27), "_line": (("_fast", "_slow"), 2 / 10)}
    if "rsi" in want:
        step = F.coalesce(F.col("close") - F.lag("close").over(W.by()), F.lit(0.0))
        df = df.withColumns({"_gain": F.greatest(step, F.lit(0.0)), "_loss": F.greatest(-step, F.lit(0.0))})
        smooth |= {"_up": ("_gain", 1 / 14), "_down": ("_loss", 1 / 14)}
    if "atr" in want:
        before = F.lag("close").over(W.by())
        df = df.withColumn("_range", F.greatest("high", before) - F.least("low", before))
        smooth["atr"] = ("_range", 1 / 14)
    if smooth:
        df = W.ewm(df, smooth)  # all averages in one pass
    if want & {"macd", "macds", "macdh"}:
        df = df.withColumns({"macd": F.col("_fast") - F.col("_slow"), "macds": F.col("_line")}).withColumn("macdh", F.col("macd") - F.col("macds"))
    if "rsi" in want:
        df = df.withColumn("rsi", 100 - 100 / (1 + F.col("_up") / (F.col("_down") + 1e-9)))
    if want & {"boll", "boll_ub", "boll_lb"}:
        df = W.bollinger(df)
    if "vwma" in want:
        df = W.vwma(df)
    if "mfi" in want:
        df = W.mfi(df)
    return df.select(*bars.columns, *names)


def report(bars: DataFrame, names: tuple[str, ...], as_of: str, back: int) -> DataFrame:
    """(ticker, d, indicator, value): every calendar day of the look-back, newest first by d, with each indicator as text."""
    seen = bars.where(F.col("d") <= F.lit(as_of).cast("date"))
    long = indicators(seen, names).unpivot(["ticker", "d"], [F.col(n).cast("double").alias(n) for n in names], "indicator", "v")
    text = F.coalesce(F.when(F.col("v").isNull() | F.isnan("v"), F.lit("N/A")), F.format_string("%.3f", "v"))
    first = F.date_sub(F.lit(as_of).cast("date"), back)
    days = F.explode(F.sequence(first, F.lit(as_of).cast("date"))).alias("d")
    grid = seen.select("ticker").distinct().select("ticker", days, F.explode(F.array(*map(F.lit, names))).alias("indicator"))
    recent = long.where(F.col("d") >= first).withColumn("value", text).drop("v")
    return grid.join(recent, ["ticker", "d", "indicator"], "left").withColumn("value", F.coalesce("value", F.lit(CLOSED)))


def csv_report(bars: DataFrame, name: str, as_of: str, back: int) -> DataFrame:
    """The other vendor's form: (ticker, d, value) of the trading days in the look-back, closed, ascending; it has no mfi and no vwma."""
    if name in ("mfi", "vwma"):
        raise ValueError(f"{name} isn't available from this vendor")
    day = F.lit(as_of).cast("date")
    return indicators(bars, (name,)).where(F.col("d").between(F.date_sub(day, back), day)).select("ticker", "d", F.col(name).alias("value"))


def named(asked: str) -> tuple[tuple[str, ...], list[str]]:
    """(known names, messages about the others) of a comma-separated list."""
    names = [n.strip().lower() for n in asked.split(",") if n.strip()]
    known = tuple(n for n in names if n in INDICATORS)
    return known, [f"{n}: not an indicator" for n in names if n not in INDICATORS]


def named_column(asked: Column) -> Column:
    """The known names of a column of comma-separated lists, in the order asked."""
    names = F.transform(F.split(F.lower(asked), ","), lambda n: F.trim(n))
    return F.filter(names, lambda n: n.isin(*INDICATORS))


def next_returns(bars: DataFrame) -> DataFrame:
    """(ticker, d, r): the change to the next bar, 0 from a price of 0; the last bar has none."""
    return bars.select("ticker", "d", W.forward_return(1).alias("r")).where("r IS NOT NULL")


def return_on(asked: DataFrame, bars: DataFrame) -> DataFrame:
    """Asked (ticker, d) with the return of that day, 0.0 where there is none."""
    return asked.join(next_returns(bars), ["ticker", "d"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))


def last_trading_day(bars: DataFrame, start: str, end: str) -> DataFrame:
    """(ticker, d): the last bar of a closed range, its end for a ticker without any."""
    inside = F.when(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.col("d"))
    return bars.groupBy("ticker").agg(F.coalesce(F.max(inside), F.lit(end).cast("date")).alias("d"))


def return_within(asked: DataFrame, bars: DataFrame, key: str = "d") -> DataFrame:
    """(ticker, d, r): the change between the first two closes of a day and the three business days after it, null without two."""
    week = F.dayofweek(key)  # 1 Sunday
    stop = F.date_add(key, F.when(week.isin(2, 3), 3).when(week == 7, 4).when(week == 1, 3).otherwise(5))
    forth, back = Window.partitionBy("ticker").orderBy("d", "close"), Window.partitionBy("ticker").orderBy(F.desc(key), F.desc("_bar"))
    told = bars.where("ticker IS NOT NULL AND d IS NOT NULL").select("ticker", "d", "close", F.lead("d").over(forth).alias("d2"), F.lead("close").over(forth).alias("close2"))
    told = told.select("ticker", F.col("d").alias(key), F.struct("d", "close", "d2", "close2").alias("_bar"))
    both = asked.withColumn("_asked", F.lit(True)).unionByName(told, allowMissingColumns=True)  # a day's own bar comes before the question, which is null there
    at = F.last("_bar", True).over(back.rowsBetween(Window.unboundedPreceding, 0))  # the nearest bar on the day or later, with the one that follows it
    found = both.withColumn("_bar", at).where("_asked")
    r = F.when((F.col("_bar.d") <= stop) & (F.col("_bar.d2") <= stop), F.try_divide(F.col("_bar.close2") - F.col("_bar.close"), F.col("_bar.close")))
    return found.select(*asked.columns, F.when(F.col(key).isNotNull(), r).alias("r"))


def evaluate(rows: DataFrame, gate: float = 0.55, cost_bps: float = 5.0, rf: float = 0.05, overweight: float = 0.75, underweight: float = 0.25, order: str = "seq") -> DataFrame:
    """Metrics of strategy and buy-and-hold by ticker, with accuracy, turnover and days."""
    worth = F.when(F.col("signal") == "OVERWEIGHT", overweight).when(F.col("signal") == "UNDERWEIGHT", underweight)
    target = F.when(F.col("confidence") >= gate, F.coalesce(worth, W.rating_target(F.col("signal"), F.col("confidence"), gate)))
    held = rows.withColumn("target", target).withColumn("position", W.held("target", W.by(order=order)))
    r = F.coalesce("actual_return", F.lit(0.0))
    ours = W.strategy_metrics(W.equity(held, cost_bps / 10_000, order), rf, order).withColumn("side", F.lit("strategy"))
    market = W.strategy_metrics(W.equity(rows.withColumn("position", F.lit(1.0)).withColumn("actual_return", r), 0.0, order), rf, order).withColumn("side", F.lit("buy_hold"))
    accuracy = W.directional_accuracy(rows).select("ticker", "accuracy")
    turnover = ours.select("ticker", F.col("turnover").alias("traded"))
    return ours.unionByName(market).drop("turnover").join(turnover, "ticker").join(accuracy, "ticker", "left")


def curves(rows: DataFrame, gate: float = 0.55, cost_bps: float = 5.0, order: str = "seq") -> DataFrame:
    """(ticker, seq, strategy, buy_hold, position): what a chart shows."""
    ours = W.equity(W.positions(rows, gate, order), cost_bps / 10_000, order)
    run = W.by(order=order).rowsBetween(Window.unboundedPreceding, 0)
    return ours.withColumn("buy_hold", F.product(1 + F.coalesce("actual_return", F.lit(0.0))).over(run)).select("ticker", order, F.col("equity").alias("strategy"), "buy_hold", "position")


def simulate(rows: DataFrame, capital: float = 10_000.0, order: str = "seq") -> DataFrame:
    """(ticker, step, value): capital, and what it is worth after each row's position and return."""
    run = W.by(order=order).rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.select("ticker", F.col(order).cast("long").alias("step"), (capital * F.product(1 + F.col("position") * F.coalesce("actual_return", F.lit(0.0))).over(run)).alias("value"))
    return grown.unionByName(rows.select("ticker").distinct().select("ticker", F.lit(0).cast("long").alias("step"), F.lit(capital).alias("value")))


def value_metrics(values: DataFrame, rf: float = 0.05) -> DataFrame:
    """CR, AR, SR and MDD in percent of (ticker, step, value), the first value being the capital."""
    w = W.by(order="step")
    day = (1 + rf) ** (1 / 252) - 1
    d = values.withColumns({"r": F.col("value") / F.lag("value").over(w) - 1, "fall": F.col("value") / F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    growth = F.max_by("value", "step") / F.min_by("value", "step")
    excess = F.col("r") - day
    return d.groupBy("ticker").agg(
        ((growth - 1) * 100).alias("cr"), ((F.pow(growth, 252.0 / (F.count("*") - 1)) - 1) * 100).alias("ar"),
        (F.avg(excess) / (F.stddev_samp(excess) + 1e-9) * F.sqrt(F.lit(252.0))).alias("sr"), (F.abs(F.min("fall")) * 100).alias("mdd"),
    )


def strategy_table(rows: DataFrame, gate: float = 0.7, order: str = "seq") -> DataFrame:
    """(ticker, place, strategy, cr, ar, sr, mdd) of buy-and-hold and the three uses of signals, in the order of a printed table."""
    w = W.by(order=order)
    thin = rows.select("ticker", order, "signal", "confidence", "actual_return")
    sides = {
        "Buy & Hold": thin.withColumn("position", F.lit(1.0)), "TA-Signal": W.bounded_stack(thin, None, order), "TA-Filtered": W.bounded_stack(thin, gate, order),
        "TA-Scaled": thin.withColumn("position", W.scaled_positions(w)),
    }
    out = None
    for name, d in sides.items():
        one = value_metrics(simulate(d, order=order)).withColumns({"strategy": F.lit(name), "place": F.lit(STRATEGIES.index(name))})
        out = one if out is None else out.unionByName(one)
    return out


def shown(value: Column, percent: bool = False, digits: int = 2) -> Column:
    """A number as a page shows it: n/a for null and NaN."""
    text = F.format_string(f"%.{digits}f%%" if percent else f"%.{digits}f", value * 100 if percent else value)
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(text)


def payload(curve: DataFrame, order: str = "seq") -> DataFrame:
    """Curves by ticker as arrays in order, for a chart; a ticker's history is some thousand rows."""
    rows = F.array_sort(F.collect_list(F.struct(order, "strategy", "buy_hold")))
    part = lambda c: F.transform("rows", lambda r: r[c]).alias(c)
    return curve.groupBy("ticker").agg(rows.alias("rows")).select("ticker", part(order), part("strategy"), part("buy_hold"))


def first_ticker(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The rows of the ticker that comes first; a file of several is read as that of its first."""
    first = rows.agg(F.min_by("ticker", order).alias("ticker"))  # one row
    return rows.join(F.broadcast(first), "ticker", "left_semi")


def without_failures(rows: DataFrame) -> DataFrame:
    """Rows of the tickers that have any row but errors, without their errors."""
    ok = rows.where("signal <> 'ERROR'").select("ticker").distinct()
    return rows.where("signal <> 'ERROR'").join(ok, "ticker", "left_semi")


def demo(spark, n: int = 60, seed: int = 42) -> DataFrame:
    """Made-up backtest rows: ratings by fixed shares, confidences around 0.7, small returns, on business days; all from digests of seed and row."""
    unit = lambda part: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string"), F.lit(part)).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)
    u = unit("signal")
    rating = F.when(u < 0.28, "BUY").when(u < 0.46, "OVERWEIGHT").when(u < 0.74, "HOLD").when(u < 0.88, "UNDERWEIGHT").otherwise("SELL")
    bell = lambda part: F.sqrt(-2 * F.log(unit(part + "r"))) * F.cos(2 * F.pi() * unit(part + "a"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor((F.col("i") + 1) / 5) * 7 + (F.col("i") + 1) % 5).cast("int"))
    rows = spark.range(n).select(F.col("id").alias("i"))
    return rows.select("i", F.lit("DEMO").alias("ticker"), day.alias("d"), rating.alias("signal"), F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.51), 0.7 + 0.13 * bell("c"))), 3).alias("confidence"), F.lit("1-5d").alias("horizon"), (0.0005 + 0.014 * bell("x")).alias("actual_return"))
