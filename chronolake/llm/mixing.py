"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a random key: the md5 of a seed and its id.  A source is cut
into key ranges; range sums give each range's offset by a prefix sum over ranges,
and a prefix sum by key inside a range gives each document's place.  So no task
holds a whole source, and only (id, source, size) is shuffled.  Rows of one source,
id and size (a null id's, or a repeated one's) are counted before they are shuffled
and placed as one row, so a range holds at most as many rows of an id as there are
sizes.  A source's budget is spent as whole epochs first, the rest is cut at the
exact word.

Defined results: null text has size 0; a null source is a source of its own, the
last; a null id has the key of the empty text; repeated rows count each, ties of
key go by id, then size; a text may be of any length (it may be cut anywhere); an
empty table gives an empty result; where all sizes are 0 so are targets and takings.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.llm.common import stored

WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets by source from (source, size): shares of the total by weight, none above max_epochs times its size.

    Excess goes to the rest by weight until none is above; in order of cap over
    weight the capped sources come first, so running sums give the outcome at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto, after, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "rest": (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0))).cast("double"),
            "w_rest": F.sum("w").over(after).cast("double"),
        }
    )
    per = per.withColumn("capped", F.col("cap").cast("double") * F.col("w_rest") < F.col("w") * F.col("rest"))
    flat = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.when(~F.col("capped"), F.col("rest") / F.col("w_rest"))
    level = F.first(free, ignorenulls=True).over(flat)
    return per.select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * level).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", rows_per_range: int = 4096) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs`."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    base = stored(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key")),
        "mix",
    )
    ranges = max(1, -(-base.count() // rows_per_range))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    base = base.withColumns(
        {"sk": F.coalesce("source", F.lit("")), "sn": F.col("source").isNull(), "range": F.floor(place * ranges / F.lit(2**32)).cast("int")}
    )
    target = source_targets(base.select("source", "size"), weights, max_epochs).select(
        F.coalesce("source", F.lit("")).alias("sk"), F.col("source").isNull().alias("sn"), "source_size", "target"
    )
    before = Window.partitionBy("sk", "sn").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy("sk", "sn", "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .join(target, ["sk", "sn"])
        .drop("range_size")
    )
    alike = base.groupBy("sk", "sn", "range", "source", "key", "doc_id", "size").agg(F.count("*").alias("copies"))
    inside = Window.partitionBy("sk", "sn", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    placed = (
        alike.join(offsets, ["sk", "sn", "range"])
        .withColumn("at", F.col("offset") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
        .withColumns({"epochs": epochs, "left": budget - epochs * F.col("source_size") - F.col("at")})
    )
    once = placed.where("copies <= 1024").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = placed.where("copies > 1024").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(1024).cast("long")))).repartition("doc_id", "first")
    many = many.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + 1023, F.col("copies") - 1)))).drop("first")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("left") - F.col("copy") * F.col("size"), F.col("size")))
    return once.unionByName(many).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"))


MIX_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1) AS w, source_size * 3 AS cap FROM per),
summed AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
         CAST(sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS w_rest
  FROM weighed),
flagged AS (SELECT *, CAST(cap AS DOUBLE) * w_rest < w * rest AS capped FROM summed),
level AS (SELECT arg_min(rest / w_rest, w_rest * -1) AS lv FROM flagged WHERE NOT capped),
targets AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE w * lv END AS target FROM flagged LEFT JOIN level ON true),
placed AS (
  SELECT b.doc_id, b.source, b.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id NULLS FIRST, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(budget % source_size - pos, size)) END AS taken
FROM placed
"""
