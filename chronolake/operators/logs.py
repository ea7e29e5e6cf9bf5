"""Logs folded to state: run records, statuses, usage, memory stores, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after_researchers(judged: Column, iterations: int = 1) -> Column:
    """Who comes after a round of researchers: the judge while iterations are left."""
    return F.when(judged < iterations, "Judge Researcher").otherwise("Research Manager")


def after_risk_turn(turns: Column, speaker: Column, rounds: int = 1) -> Column:
    """Who comes after a turn of the risk debate: three analysts in turn, the manager after all rounds."""
    return (
        F.when(turns >= 3 * rounds, "Portfolio Manager").when(speaker.startswith("Aggressive"), "Conservative Analyst")
        .when(speaker.startswith("Conservative"), "Neutral Analyst").otherwise("Aggressive Analyst")
    )


def sentiment(posts: DataFrame, by: list[str], least: float = 0.65) -> DataFrame:
    """Posts that count for a sentiment: without unsure neutral ones, but all of a key that would have none left."""
    sure = ~((F.col("label") == "neutral") & (F.col("conf") < least))
    left = posts.groupBy(*by).agg(F.max(sure).alias("_any"))  # a row a key: no key's posts are gathered
    return posts.join(left, by).where(sure | ~F.col("_any")).drop("_any")


def bounded_log(log: DataFrame, keys: list[str], order: str, n: int = 100) -> DataFrame:
    """The last n entries of each run, in order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def first_open(steps: DataFrame, keys: list[str], order: str, done: str) -> DataFrame:
    """Statuses of ordered steps: done ones completed, the first other in_progress, later ones pending."""
    w = Window.partitionBy(*keys)
    first = F.min(F.when(~F.col(done), F.col(order))).over(w)
    status = F.when(F.col(done), "completed").when(F.col(order) == first, "in_progress").otherwise("pending")
    return steps.withColumn("status", status)


def calendar_report(values: DataFrame, key: str, day: str, value: str, last: str, back: int) -> DataFrame:
    """Newest first, every calendar day of the look-back with its value or a notice."""
    days = F.explode(F.transform(F.sequence(F.lit(0), F.lit(back)), lambda i: F.date_sub(F.lit(last).cast("date"), i)))
    grid = values.select(key).distinct().select(key, days.alias(day))
    text = F.coalesce(F.when(F.col(value).isNotNull(), F.format_string("%.2f", value)), F.lit("N/A: Not a trading day (weekend or holiday)"))
    return grid.join(values.select(key, day, value), [key, day], "left").select(key, day, text.alias("report"))


def trading_days(start: str, end: str, spark) -> DataFrame:
    """Weekdays of a closed range, for vendors without a calendar."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    return d.where(F.dayofweek("d").between(2, 6))


def news_count(payload: Column) -> Column:
    """Length of a JSON feed, else the number of headline marks."""
    feed = F.get_json_object(payload, "$.feed")
    marks = (F.length(payload) - F.length(F.replace(payload, F.lit("### "), F.lit("")))) / 4
    return F.when(feed.isNotNull(), F.json_array_length(feed)).otherwise(marks).cast("long")


def article(raw: Column) -> Column:
    """One shape from a nested or flat article in JSON text, with defaults."""
    one = lambda *paths: F.coalesce(*[F.get_json_object(raw, p) for p in paths])
    return F.struct(
        F.coalesce(one("$.content.title", "$.title"), F.lit("No title")).alias("title"),
        F.coalesce(one("$.content.summary", "$.summary"), F.lit("")).alias("summary"),
        F.coalesce(one("$.content.provider.displayName", "$.publisher"), F.lit("Unknown")).alias("publisher"),
        F.try_to_timestamp(F.get_json_object(raw, "$.content.pubDate")).alias("pub_ts"),
    )


def store_reports(reports: DataFrame, rooms: list[str], day: str) -> DataFrame:
    """Wide reports to memory rows: one per non-blank room."""
    long = reports.unpivot([c for c in reports.columns if c not in rooms], rooms, "room", "doc")
    return long.where(F.length(F.trim("doc")) > 0).withColumn("valid_from", F.col(day))


def mask_schedule(blocks: DataFrame, length: int, share: float, seed: str) -> DataFrame:
    """(block, place, masked): a Bernoulli draw per place from a digest."""
    grid = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("place"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("block").cast("string"), F.col("place").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return grid.withColumn("masked", u < share)
