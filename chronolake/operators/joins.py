"""As-of, validity and graph joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.pit import valid_at


def asof(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key that isn't later; one sort, no range join.

    Right rows are unique by (key, right_at).  Both sides share one window; a key's rows meet in one task,
    so very long keys should be split by period first, as `asof_split` does.
    """
    r = right.select(F.col(key), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(right_at, *values).alias("_v"))
    stacked = left.withColumns({"_at": F.col(left_at), "_side": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = stacked.withColumn("_v", F.last("_v", True).over(w)).where("_side = 1")
    return out.select(*left.columns, F.col(f"_v.{right_at}").alias("matched_at"), *[F.col(f"_v.{v}") for v in values])


def asof_split(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str], unit: str = "month") -> DataFrame:
    """`asof` with long keys cut by period: each period starts with the last right row before it."""
    p = lambda c: F.trunc(c, unit)
    r = right.withColumn("_p", p(right_at))
    last = r.groupBy(key, "_p").agg(F.max_by(F.struct(right_at, *values), right_at).alias("_c"))
    periods = left.select(key, p(left_at).alias("_p")).distinct()
    w = Window.partitionBy(key).orderBy("_p", "_q").rowsBetween(Window.unboundedPreceding, 0)
    carried = last.withColumn("_q", F.lit(1)).unionByName(periods.withColumn("_q", F.lit(0)), allowMissingColumns=True)
    carried = carried.withColumn("_c", F.last("_c", True).over(w)).where("_q = 0 AND _c IS NOT NULL").select(key, "_p", "_c.*")
    whole = r.select(key, "_p", right_at, *values).unionByName(carried.select(key, "_p", right_at, *values))
    both = F.struct(key, "_p").alias("_k")
    out = asof(left.withColumn("_p", p(left_at)).withColumn("_k", both), whole.withColumn("_k", both), "_k", left_at, right_at, values)
    return out.drop("_p", "_k")


def facts_at(triples: DataFrame, entities: DataFrame, as_of: str, key: str, value: str, outgoing: bool = True) -> DataFrame:
    """Facts of an entity valid at a date, with the other end's name."""
    mine, other = ("subject", "object") if outgoing else ("object", "subject")
    t = triples.where((F.col(mine) == value) & valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(as_of).cast("date")))
    e = entities.select(F.col("id").alias(other), F.col("name").alias("other_name"))
    return t.join(e, other).select("subject", "predicate", "object", "other_name", "valid_from", "valid_to", F.lit("out" if outgoing else "in").alias("direction"))


def valid_counts(triples: DataFrame, days: DataFrame, day: str) -> DataFrame:
    """(day, valid): how many triples are valid at each of some days, those that never begin or end included.

    Starts and ends are counted by date first, so what is ordered is a row a date, not a row a triple.
    """
    ever = triples.where("valid_from IS NULL OR valid_to IS NULL OR valid_from <= valid_to")
    steps = F.explode(F.array(F.struct(F.col("valid_from").alias("at"), F.lit(1).alias("step")), F.struct(F.date_add("valid_to", 1).alias("at"), F.when(F.col("valid_to").isNull(), 0).otherwise(-1).alias("step"))))
    changes = ever.select(steps.alias("s")).groupBy(F.col("s.at").alias("at")).agg(F.sum("s.step").alias("step"))
    stacked = changes.withColumn("_ask", F.lit(0)).unionByName(days.select(F.col(day).alias("at")).distinct().withColumns({"step": F.lit(0).cast("long"), "_ask": F.lit(1)}))
    upto = Window.orderBy(F.asc_nulls_first("at"), "_ask").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    return stacked.withColumn("valid", F.sum("step").over(upto)).where("_ask = 1").select(F.col("at").alias(day), "valid")


def by_predicate(triples: DataFrame, entities: DataFrame, predicate: str, as_of: str | None) -> DataFrame:
    t = triples.where(F.col("predicate") == predicate)
    if as_of:
        t = t.where(valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(as_of).cast("date")))
    names = lambda end: entities.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    return t.join(names("subject"), "subject").join(names("object"), "object")


def timeline(triples: DataFrame, entities: DataFrame, value: str, limit: int = 100) -> DataFrame:
    t = triples.where((F.col("subject") == value) | (F.col("object") == value))
    names = lambda end: entities.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    return t.join(names("subject"), "subject").join(names("object"), "object").orderBy(F.asc_nulls_last("valid_from"), "subject", "predicate", "object").limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows by order in each key: latest version, arg-max lookups, first seen."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest_filings(filings: DataFrame, as_of: str, forms: tuple[str, ...]) -> DataFrame:
    """Each ticker's latest filing of some forms that was out at the as-of; of one day's the first in the feed. Rows (ticker, form, filed, seq, ...)."""
    seen = filings.where(F.col("form").isin(*forms) & (F.col("filed") <= F.lit(as_of).cast("date")))
    rest = [c for c in filings.columns if c not in ("ticker", "filed", "seq")]
    best = seen.groupBy("ticker").agg(F.max(F.struct("filed", (-F.col("seq")).alias("order"), *rest)).alias("b"))
    return best.select("ticker", "b.filed", (-F.col("b.order")).alias("seq"), *[F.col(f"b.{c}") for c in rest])


def to_ingest(filings: DataFrame, as_of: str, ingested: DataFrame) -> DataFrame:
    """The filings to fetch: each ticker's latest 10-K, else its latest 10-Q, unless its accession is there already."""
    annual = latest_filings(filings, as_of, ("10-K",))
    quarterly = latest_filings(filings, as_of, ("10-Q",)).join(annual.select("ticker"), "ticker", "left_anti")
    return annual.unionByName(quarterly).join(ingested.select("accession"), "accession", "left_anti")


def insert_new(open_facts: DataFrame, new: DataFrame, keys=("subject", "predicate", "object")) -> DataFrame:
    """New triples that no open identical triple exists for."""
    return new.join(open_facts.where("valid_to IS NULL"), list(keys), "left_anti")


def invalidate(triples: DataFrame, ended: DataFrame, keys=("subject", "predicate", "object")) -> DataFrame:
    """Close open triples that `ended` (keys, ended) names; closed ones stay as they are."""
    out = triples.join(ended, list(keys), "left")
    return out.withColumn("valid_to", F.coalesce("valid_to", "ended")).select(triples.columns)
