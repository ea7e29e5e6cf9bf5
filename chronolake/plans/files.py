"""Queries that write tables as files and read them back through the typed readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import joins as J
from chronolake.operators import windows as W
from chronolake.plans.book import query
from chronolake.plans.views import table, view
from chronolake.sources import readers as Rd
from chronolake.sources import sinks as Sk


def _bars_csv(spark, sf):
    """Bars as CSV by shelf of tickers, every seventh close missing."""
    at = Sk.folder(spark, "bars")
    close = F.when(F.dayofmonth("d") % 7 == 0, None).otherwise(F.col("close"))
    rows = view(spark, sf, "bars").select(F.col("d").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), close.alias("Close"), F.col("volume").alias("Volume"), "ticker")
    Sk.per_ticker(rows, at)
    return at


_KEPT = "SELECT ticker, d, close FROM bars WHERE day(d) % 7 > 0"


@query(["bars"], _KEPT + " AND d <= DATE '1996-06-30' AND d >= DATE '1991-06-30'")
def s1_s4_ohlcv(spark, sf):
    """Daily bars from files: malformed rows and those without a close out, five years up to the as-of, filled."""
    at = _bars_csv(spark, sf)
    df = Rd.bars(spark, at, "1996-06-30", more="ticker BIGINT")
    df = df.select("ticker", F.col("Date").alias("d"), F.col("Open").alias("open"), F.col("High").alias("high"), F.col("Low").alias("low"), F.col("Close").alias("close"), F.col("Volume").alias("volume"))
    return W.fill_bars(df).select(F.col("ticker").cast("bigint").alias("ticker"), "d", "close")


@query(["bars"], "SELECT CAST(d AS VARCHAR) AS day, close, ticker FROM bars WHERE day(d) % 7 > 0 AND d BETWEEN DATE '1995-01-01' AND DATE '1995-03-01'")
def s5_s6_csv_range(spark, sf):
    df = Rd.csv_range(spark, _bars_csv(spark, sf), "1995-01-01", "1995-03-01").where("Close IS NOT NULL")
    return df.select(F.col("Date").alias("day"), F.col("Close").cast("double").alias("close"), F.col("ticker").cast("bigint").alias("ticker"))


@query(["signals"], "SELECT ticker, CAST(ts AS DATE) AS date, signal, count(*) AS n, round(sum(actual_return), 6) AS total FROM signals WHERE ticker % 3 = 0 GROUP BY ALL")
def s35_k6_calibration_log(spark, sf):
    """Outcomes appended twice, in two runs, and read back by ticker in either case."""
    at = Sk.folder(spark, "calibration")
    rows = view(spark, sf, "signals").select(F.concat(F.lit("t"), F.col("ticker").cast("string")).alias("ticker"), F.col("ts").cast("date").alias("date"), "signal", "confidence", "actual_return", (F.col("seq") % 2).alias("run"))
    for run in (0, 1):
        Sk.calibration_log(rows.where(F.col("run") == run), at)
    got = Rd.calibration_records(spark, at).withColumn("ticker", F.substring("ticker", 2, 20).cast("bigint")).where("ticker % 3 = 0")
    return got.groupBy("ticker", "date", "signal").agg(F.count("*").alias("n"), F.round(F.sum("actual_return"), 6).alias("total"))


@query(["signals"], "SELECT ticker, count(*) AS n, round(avg(confidence), 6) AS confidence, min(CAST(ts AS DATE)) AS first FROM signals GROUP BY ticker")
def s37_k1_k15_k16_y45_backtest_files(spark, sf):
    """Backtest rows of all tickers as files with fixed columns, by shelf of tickers, read back."""
    at = Sk.folder(spark, "backtest")
    s = view(spark, sf, "signals")
    rows = s.select(F.col("ts").cast("date").alias("date"), "signal", "confidence", F.lit("1-5d").alias("horizon"), "actual_return", F.col("ticker").cast("string").alias("ticker"), "seq")
    metrics = W.directional_accuracy(s)
    Sk.backtest_assets(rows, metrics, at, by=("seq",))  # sums of doubles depend on their order
    got = spark.read.option("header", True).schema("date DATE, signal STRING, confidence DOUBLE, horizon STRING, actual_return DOUBLE, ticker BIGINT").csv(f"{at}/signals")
    return got.groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.min("date").alias("first"))


@query(["samples"], "SELECT CAST(sample_id AS VARCHAR) AS sample_id, CAST(task_label AS INTEGER) AS task_label, CAST(event_date AS TIMESTAMP) AS event_time, CASE WHEN sample_id % 3 > 0 THEN CAST(available_date AS TIMESTAMP) END AS available_time, lang FROM samples")
def s26_s28_k12_y51_sample_files(spark, sf):
    """Samples as JSON lines and back: labels strict, times to UTC, what isn't fixed into a map."""
    at = Sk.folder(spark, "samples")
    iso = lambda c: F.concat(F.col(c).cast("string"), F.lit("T00:00:00Z"))
    s = view(spark, sf, "samples")
    rows = s.select(F.col("sample_id").cast("string").alias("sample_id"), "text", "document_type", F.col("task_label").cast("string").alias("task_label"), iso("event_date").alias("event_time"), F.when(F.col("sample_id") % 3 > 0, iso("available_date")).otherwise("soon").alias("available_time"), "lang")
    Sk.json_export(rows, at)
    got = Rd.samples(spark, at)
    return got.select("sample_id", "task_label", F.col("event_time").cast("timestamp_ntz").alias("event_time"), F.col("available_time").cast("timestamp_ntz").alias("available_time"), F.col("metadata")["lang"].alias("lang"))


@query([], """SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'missing title' WHEN doc_id % 11 = 1 THEN 'quality' WHEN doc_id % 11 = 2 THEN 'class' WHEN doc_id % 11 = 3 THEN 'empty text' END AS problem FROM documents""")
def s28_corpus_files(spark, sf):
    at, k = Sk.folder(spark, "corpus"), F.col("doc_id") % 11
    own = {"document_id": F.col("doc_id").cast("string"), "title": F.when(k != 0, "t"), "availability_quality": F.when(k == 1, "heuristic").otherwise("exact"), "temporal_class": F.when(k == 2, "pre_cutoff").otherwise("post_cutoff"), "text": F.when(k == 3, "  ").otherwise(F.concat(F.lit("."), "text"))}
    table(spark, sf, "documents").select(*[own.get(c, F.lit("x")).alias(c) for c in Rd.DOCUMENT_FIELDS]).write.json(at)
    return Rd.documents(spark, at).select("document_id", "problem")


@query([], "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def s29_market_table(spark, sf):
    """A market table whose days are written as times, some of them badly."""
    at = Sk.folder(spark, "market")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("holiday")
    Sk.plain_csv(table(spark, sf, "orders").select(day.alias("Date"), F.col("o_totalprice").alias("Close")), at)
    return Rd.market_table(spark, at, "Date DATE, Close DOUBLE").groupBy(F.col("Date").alias("d")).agg(F.count("*").alias("n"))


_POLICY = """m AS (SELECT o_custkey AS bank, o_orderkey AS id, CAST(o_orderdate AS DATE) AS meeting_date, (o_orderkey * 7 % 5)::DOUBLE / 4 AS b, (o_orderkey * 3 % 5)::DOUBLE / 4 AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'unscheduled' ELSE 'scheduled' END AS kind FROM orders),
ac AS (SELECT *, CASE WHEN id % 9 = 0 THEN 0 WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END AS action FROM m)"""


def _policy(spark, sf):
    """Every order as a decision of its customer, a bank, written as CSV and read as history."""
    at, k = Sk.folder(spark, "policy"), F.col("o_orderkey")
    before, after = (k * 7 % 5).cast("double") / 4, (k * 3 % 5).cast("double") / 4
    action = F.when(k % 9 == 0, 0).when(after > before, 1).when(after < before, -1).otherwise(0)
    day = F.col("o_orderdate").cast("date")
    kind = F.when(k % 4 == 0, "unscheduled").otherwise("scheduled")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("bank"), k.alias("id"), day.alias("meeting_date"), day.cast("timestamp").alias("decision_time"), (before - 0.25).alias("target_lower_before"), before.alias("target_upper_before"), (after - 0.25).alias("target_lower_after"), after.alias("target_upper_after"), action.alias("action"), kind.alias("meeting_type"), F.lit("u").alias("source_url"), F.lit("h").alias("source_sha256"))
    Sk.plain_csv(rows, at)
    return Rd.policy_history(spark, at, keys="bank BIGINT, id BIGINT")


@query([], f"WITH {_POLICY} SELECT bank, id, meeting_date, action, action = CASE WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END AS consistent FROM ac")
def s30_c15_policy_history(spark, sf):
    return _policy(spark, sf).select("bank", "id", "meeting_date", "action", "consistent")


@query([], f"WITH {_POLICY} SELECT bank, id, meeting_date, lead(action) OVER w AS future_action, round(lead(a) OVER w - lead(b) OVER w, 4) AS future_rate_change FROM ac WHERE kind = 'scheduled' WINDOW w AS (PARTITION BY bank ORDER BY meeting_date, id)")
def j10_w15_next_actions(spark, sf):
    return Rd.next_actions(_policy(spark, sf), by=["bank"], ties=["id"]).select("bank", "id", "meeting_date", "future_action", "future_rate_change")


_BRANCH = "SELECT CAST(label AS BIGINT) AS seed, (vec_id % 5)::DOUBLE / 4 AS dose, sum(CAST(round(embedding[1]::DOUBLE * 1000) AS BIGINT))::DOUBLE AS v, 'seed' || label || '_d' || (vec_id % 5) AS branch FROM embeddings GROUP BY ALL"


def _branches(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.sum(F.round(F.col("embedding")[0].cast("double") * 1000).cast("long")).cast("double").alias("event_contrast_mean")
    return e.groupBy(F.col("label").cast("long").alias("seed"), ((F.col("vec_id") % 5).cast("double") / 4).alias("dose"), F.concat(F.lit("seed"), F.col("label").cast("string"), F.lit("_d"), (F.col("vec_id") % 5).cast("string")).alias("branch")).agg(v)


@query([], f"SELECT seed, dose, v AS event_contrast_mean, 'EMPIRICAL' AS data_mode FROM ({_BRANCH})")
def k9_k10_k11_branch_files(spark, sf):
    """Branch documents without embeddings, a folder a branch; a metrics file of the fields that are kept, behind the gate."""
    at = Sk.folder(spark, "branches")
    b = _branches(spark, sf).withColumns({"data_mode": F.lit("EMPIRICAL"), "h_leak": F.array(F.lit(0.5)), "note": F.lit("x")})
    Sk.branches(Sk.gated(b), at)
    back = spark.read.json(at)
    assert "h_leak" not in back.columns
    Sk.branch_metrics(back, f"{at}-metrics")
    return spark.read.json(f"{at}-metrics").select("seed", "dose", "event_contrast_mean", "data_mode")


@query([], f"SELECT branch, v AS event_contrast_mean, v > 0 AS positive FROM ({_BRANCH})")
def s38_frozen_results(spark, sf):
    """A results document that maps every branch to its metrics, read as rows."""
    at = Sk.folder(spark, "frozen")
    entries = F.map_from_entries(F.collect_list(F.struct("branch", F.struct("event_contrast_mean"))))  # a study's branches
    _branches(spark, sf).agg(entries.alias("branches")).write.json(at)
    return Rd.frozen_branches(spark, at, "event_contrast_mean:double").withColumn("positive", F.col("event_contrast_mean") > 0)


@query([], "SELECT doc_id, arg_max(version, version) AS version, CASE WHEN max(version) = 2 THEN upper(any_value(source)) ELSE any_value(source) END AS source FROM (SELECT doc_id, source, 1 AS version FROM documents UNION ALL SELECT doc_id, source, 2 FROM documents WHERE doc_id % 4 = 0) GROUP BY doc_id")
def k7_k8_upserts(spark, sf):
    """Rows written twice under one id: the last version is what is read."""
    at, d = Sk.folder(spark, "upserts"), table(spark, sf, "documents")
    Sk.append_version(d.select(F.col("doc_id").alias("id"), "source"), at, 1)
    Sk.append_version(d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.upper("source").alias("source")), at, 2)
    return J.latest(spark.read.parquet(at), ["id"], [F.desc("version")]).select(F.col("id").alias("doc_id"), "version", "source")


@query([], "SELECT source, CAST(DATE '2024-01-01' + CAST(doc_id % 5 AS INT) AS DATE) AS day, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY ALL")
def k3_s25_archive(spark, sf):
    at = Sk.folder(spark, "archive")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 5).cast("int")).cast("timestamp")
    Sk.archive(table(spark, sf, "documents").where("source <> ''").select("source", "text", fetched.alias("fetched_at")), at)
    back = spark.read.schema("text STRING, fetched_at TIMESTAMP, source STRING, day DATE").json(at)
    return back.groupBy("source", "day").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query([], "SELECT o_custkey AS ticker, count(*) AS n FROM orders GROUP BY o_custkey")
def k14_k4_final_states(spark, sf):
    """Final states as JSON by shelf of tickers; a backtest writes none."""
    at = Sk.folder(spark, "states")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.struct("o_orderkey", "o_orderstatus").alias("state")).where("ticker IS NOT NULL")
    assert not Sk.final_states(rows, at, backtest=True)
    Sk.final_states(rows, at)
    Sk.discard(rows)
    return spark.read.schema("state STRUCT<o_orderkey: BIGINT, o_orderstatus: STRING>, ticker BIGINT").json(at).groupBy("ticker").agg(F.count("state.o_orderkey").alias("n"))


@query(["samples"], "SELECT CAST(sample_id AS VARCHAR) AS sample_id, document_type, CAST(available_date AS VARCHAR) AS available_time, row_number() OVER (ORDER BY available_date, document_type, CAST(sample_id AS VARCHAR)) - 1 AS place FROM samples")
def k13_o10_canonical_order(spark, sf):
    """A dataset written in its canonical order and read in the order of its files."""
    at = Sk.folder(spark, "canonical")
    s = view(spark, sf, "samples").select(F.col("sample_id").cast("string").alias("sample_id"), "document_type", F.col("available_date").cast("string").alias("available_time"))
    Sk.canonical(s, at)
    back = spark.read.schema("sample_id STRING, document_type STRING, available_time STRING").json(at)
    from pyspark.sql import Window

    name, at_byte = F.col("_metadata.file_name"), F.col("_metadata.file_block_start")
    rows = back.select("*", name.alias("f"), at_byte.alias("b"), F.monotonically_increasing_id().alias("i"))
    n = rows.groupBy("f", "b").agg(F.count("*").alias("n"))  # a part a row
    base = n.select("f", "b", F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("f", "b").orderBy("i")) - 1
    return rows.withColumn("place", place).join(F.broadcast(base), ["f", "b"]).select("sample_id", "document_type", "available_time", (F.col("place") + F.col("base")).alias("place"))
