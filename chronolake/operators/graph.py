"""Writes to the triple store and to memory rooms, as appends and anti joins.

Entities are (id, name, type, created), triples (subject, predicate, object, valid_from, valid_to); an upsert is an
append of a later version, an insert an anti join against what is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.text import entity_id
from chronolake.operators.joins import insert_new

# The store's schemas.
ENTITIES = "id STRING, name STRING, type STRING, properties STRING, version BIGINT"
TRIPLES = "subject STRING, predicate STRING, object STRING, valid_from DATE, valid_to DATE, confidence DOUBLE"
# Days that the rows of a room stay valid; reflections never expire.
ROOM_DAYS = {"sentiment": 3, "news": 3, "market": 7, "fundamentals": 365}
ROLES = ("bull", "bear", "trader", "invest_judge", "portfolio_manager")


def empty_store(spark) -> tuple[DataFrame, DataFrame]:
    """The two tables without rows."""
    return spark.createDataFrame([], ENTITIES), spark.createDataFrame([], TRIPLES)


def predicate_id(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def upsert_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (name, type, version) replace those of the same id; of several new ones the last version counts."""
    rows = entities.select("id", "name", "type", "version").unionByName(new.select(entity_id(F.col("name")).alias("id"), "name", "type", "version"))
    return rows.groupBy("id").agg(F.max(F.struct("version", "name", "type")).alias("m")).select("id", "m.name", "m.type", "m.version")


def insert_triples(entities: DataFrame, triples: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) after inserting rows (seq, subject, predicate, object, valid_from, valid_to) by name.

    Names that aren't entities yet become some, the first name of an id stays; a triple that an open identical one
    exists for isn't inserted, and of several open ones among the new the first is.
    """
    ids = new.select("seq", entity_id(F.col("subject")).alias("subject"), predicate_id(F.col("predicate")).alias("predicate"), entity_id(F.col("object")).alias("object"), "valid_from", "valid_to")
    keys = ["subject", "predicate", "object"]
    seen = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fresh = ids.withColumn("_before", F.max(F.col("valid_to").isNull()).over(seen)).where("_before IS NULL OR NOT _before").drop("_before")
    added = insert_new(triples, fresh, keys).select(*keys, "valid_from", "valid_to")
    ends = new.select(F.struct("seq", F.lit(0).alias("side"), F.col("subject").alias("name")).alias("s")).unionByName(new.select(F.struct("seq", F.lit(1).alias("side"), F.col("object").alias("name")).alias("s")))
    names = ends.groupBy(entity_id(F.col("s.name")).alias("id")).agg(F.min("s").alias("s")).select("id", F.col("s.name").alias("name"))
    made = names.join(entities.select("id"), "id", "left_anti").select("id", "name", F.lit("unknown").alias("type"), F.lit(0).cast("long").alias("version"))
    return entities.select("id", "name", "type", "version").unionByName(made), triples.select(*keys, "valid_from", "valid_to").unionByName(added)


def facts_of(people: DataFrame) -> DataFrame:
    """Seed rows (name, parent, partner, relationship, birthday, interests) to triples by name, one for each rule that applies."""
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 10_000)))
    none = F.lit(None).cast("date")
    one = lambda ok, predicate, other, at: F.when(ok, F.struct(F.lit(predicate).alias("predicate"), other.alias("object"), at.alias("valid_from")))
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    rules = F.array(
        one(has("parent"), "child_of", cap(F.col("parent")), F.col("birthday")),
        one(has("partner"), "married_to", cap(F.col("partner")), none),
        one(F.col("relationship") == "daughter", "is_child_of", F.when(has("parent"), cap(F.col("parent"))).otherwise(F.col("name")), F.col("birthday")),
        one(F.col("relationship") == "husband", "is_partner_of", cap(F.coalesce("partner", "name")), none),
    )
    loved = F.transform("interests", lambda i: F.struct(F.lit("loves").alias("predicate"), cap(i).alias("object"), F.lit("2025-01-01").cast("date").alias("valid_from")))
    return people.select(F.col("name").alias("subject"), F.explode(F.concat(F.array_compact(rules), loved)).alias("f")).select("subject", "f.*")


def day_subject(ticker: Column, day: Column) -> Column:
    return F.concat_ws("_", F.lower(ticker), F.date_format(day, "yyyy-MM-dd"))


def annotate_returns(triples: DataFrame, returns: DataFrame) -> DataFrame:
    """New facts of (ticker, day, actual_return), valid on that day alone; a day that has one keeps it."""
    new = returns.groupBy("ticker", "day").agg(F.min_by("actual_return", "seq").alias("r"))
    facts = new.select(day_subject(F.col("ticker"), F.col("day")).alias("subject"), F.lit("actual_return").alias("predicate"), F.col("r").cast("string").alias("object"), F.col("day").alias("valid_from"), F.col("day").alias("valid_to"))
    have = triples.where("predicate = 'actual_return'").select("subject").distinct()
    return facts.join(have, "subject", "left_anti")


def price_facts(prices: DataFrame) -> DataFrame:
    """Permanent facts of (ticker, day, close)."""
    return prices.select(day_subject(F.col("ticker"), F.col("day")).alias("subject"), F.lit("close_price").alias("predicate"), F.col("close").cast("string").alias("object"), F.col("day").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))


def lookup(asked: DataFrame, triples: DataFrame, predicate: str) -> DataFrame:
    """(ticker, day, value) of an exact day's fact, null where there is none."""
    known = triples.where(F.col("predicate") == predicate).groupBy("subject").agg(F.first("object", ignorenulls=True).try_cast("double").alias("value"))
    return asked.withColumn("subject", day_subject(F.col("ticker"), F.col("day"))).join(known, "subject", "left").drop("subject")


def expiry(room: Column, day: Column) -> Column:
    out = F.lit(None).cast("date")
    for name, days in ROOM_DAYS.items():
        out = F.when(room == name, F.date_add(day, days)).otherwise(out)
    return out


def summaries(rows: DataFrame) -> DataFrame:
    """(ticker, room, day, content) to memory rows valid from that day until the room's time is over."""
    return rows.where(F.length(F.trim("content")) > 0).select(F.lower("ticker").alias("wing"), "room", F.col("day").alias("valid_from"), expiry(F.col("room"), F.col("day")).alias("expires_at"), "content")


def reflections(rows: DataFrame) -> DataFrame:
    """(ticker, role, day, situation, lesson) to memory rows: the situation is what is searched, the lesson what comes back, from the next day on and for ever."""
    text = F.concat(F.lit("Situation (digest):\n"), "situation", F.lit("\n\nLesson:\n"), "lesson")
    return rows.where(F.col("role").isin(*ROLES)).select(
        F.lower("ticker").alias("wing"), F.concat(F.lit("reflections_"), "role").alias("room"), F.date_add("day", 1).alias("valid_from"), F.lit(None).cast("date").alias("expires_at"),
        text.alias("content"), F.col("situation").alias("searched"),
    )


def visible(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.where((F.col("valid_from") <= as_of) & (F.col("expires_at").isNull() | (F.col("expires_at") >= as_of)))
