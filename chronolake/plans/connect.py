"""Queries of connectors: a vendor's series read as a format, archives with commits, streams of job events, transcripts by quarter."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chronolake.operators import vendor as V
from chronolake.plans.book import query
from chronolake.plans.views import table, view
from chronolake.sources import connector as C
from chronolake.sources import readers as Rd
from chronolake.sources import sinks as Sk
from chronolake.sources import tensors as T
from chronolake.sources import versions as Ver
from chronolake.streaming import jobs as J



class Reluctant(C.Shelves):
    """Says once for each symbol that too much was asked."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.told: set[str] = set()

    def ask(self, symbol: str, first: str | None = None, last: str | None = None) -> str:
        if symbol not in self.told:
            self.told.add(symbol)
            return json.dumps({"Information": "Our standard rate limit is one request a second."})
        return super().ask(symbol, first, last)


def _answers(spark, sf) -> str:
    """What a vendor answers: the bars of every ticker as CSV, a row each, in some shelves."""
    at = Sk.folder(spark, "vendor")
    fields = ("open", "high", "low", "close", "volume")
    b = view(spark, sf, "bars").select(F.col("ticker").cast("string").alias("symbol"), F.col("d").cast("string").alias("timestamp"), *fields)
    line = F.array_join(F.array("timestamp", *(F.col(c).cast("string") for c in fields)), ",", "")
    days = F.array_sort(F.collect_list(line))  # a line a day
    told = b.groupBy("symbol").agg(F.concat_ws("\n", F.lit(",".join(("timestamp", *fields))), days).alias("answer"))
    shelf = Sk.shelf(F.col("symbol"))
    told.withColumn("shelf", shelf).hint("rebalance", F.col("shelf")).sortWithinPartitions("shelf", "symbol").write.option("parquet.block.size", 8 << 20).partitionBy("shelf").parquet(at)
    return at


@query(["bars"], "SELECT CAST(ticker AS VARCHAR) AS symbol, d AS day, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM bars WHERE d >= DATE '1994-03-01' AND d < DATE '1997-07-01'")
def s7_y15_y16_vendor_series(spark, sf):
    """Every symbol's series between two days, through requests that carry the days, are spaced, and are asked again."""
    at = _answers(spark, sf)
    C.register(spark)
    asked = spark.read.format("vendor").options(root=at, transport=f"{__name__}:Reluctant", gap="0.001", wait="0.001").load()
    return asked.where("day >= DATE '1994-03-01' AND day < DATE '1997-07-01'").select("symbol", "day", "open", "high", "low", "close", "volume")


@query(["bars"], "SELECT CAST(ticker AS VARCHAR) AS symbol, count(*) AS days, max(d) AS last FROM bars WHERE ticker IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) GROUP BY ticker")
def s7_vendor_symbols(spark, sf):
    """Only the symbols of some nations are asked for: their names are the filter."""
    at = _answers(spark, sf)
    C.register(spark)
    wanted = [str(r[0]) for r in table(spark, sf, "supplier").where("s_nationkey < 5").select("s_suppkey").collect()]  # a request's list of symbols
    asked = spark.read.format("vendor").options(root=at, transport=f"{C.__name__}:Shelves", gap="0").load().where(F.col("symbol").isin(wanted))
    return asked.groupBy("symbol").agg(F.count("*").alias("days"), F.max("day").alias("last"))


@query([], "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE event_type <> 'error' GROUP BY ALL")
def u7_archived_events(spark, sf):
    """Events archived in two commits, with a job between that another replaces; what is published is read back."""
    at = Sk.folder(spark, "commits")
    C.register(spark)
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("ts"), "event_type", "value")
    put = lambda df, mode="append": df.write.format("archive").option("path", at).mode(mode).save()
    put(e.where("event_type = 'error'"))
    put(e.where("event_type = 'purchase'"), "overwrite")
    put(e.where("event_type NOT IN ('purchase', 'error')"))
    back = C.archived(spark, at, "event_id BIGINT, ts STRING, event_type STRING, value DOUBLE")
    return back.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


_BEAT, _LATE = 12 * 3_600_000, 2 * 86_400_000
_FEED = f"""e AS (SELECT user_id AS job, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'purchase' THEN 'complete' ELSE event_type END AS kind, event_id AS seq FROM events),
u AS (SELECT max(ms) - {_LATE} AS upto FROM e),
s AS (SELECT *, lead(ms) OVER w AS nx, coalesce(bool_or(kind IN ('complete', 'error')) OVER (PARTITION BY job ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS "over" FROM e, u WHERE ms <= upto WINDOW w AS (PARTITION BY job ORDER BY ms, seq)),
g AS (SELECT *, CASE WHEN kind IN ('complete', 'error') THEN 0 WHEN nx IS NULL THEN (upto - ms) // {_BEAT} ELSE (nx - ms - 1) // {_BEAT} END AS n FROM s WHERE NOT "over")"""
_FED = f"WITH {_FEED} SELECT job, ms, kind, seq FROM g UNION ALL SELECT job, ms + {_BEAT} * unnest(range(1, n + 1)), 'heartbeat', NULL FROM g WHERE n > 0"


def _job_events(e):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("job"), ms.alias("ms"), F.when(F.col("event_type") == "purchase", "complete").otherwise(F.col("event_type")).alias("kind"), F.col("event_id").alias("seq"))


@query([], _FED)
def m13_job_feed(spark, sf):
    """Every job's events up to its end, with heartbeats, as a table."""
    e = _job_events(table(spark, sf, "events"))
    until = e.agg((F.max("ms") - _LATE).alias("u")).first()[0]
    return J.feed(e, _BEAT, F.lit(until).cast("long"))


@query([], _FED)
def m13_job_stream(spark, sf):
    """The same feed from a stream with state and timers, drained to files and read back."""
    at, before = Sk.folder(spark, "jobs"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    late = f"{_LATE // 3_600_000} hours"
    arrived = table(spark, sf, "events")
    arrived.write.parquet(f"{at}/in")  # a stream reads a folder
    stream = spark.readStream.schema(arrived.schema).parquet(f"{at}/in")
    e = _job_events(stream).withColumn("t", F.timestamp_millis("ms")).withWatermark("t", late)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    try:
        q = J.live(e, _BEAT).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(J.FEED).parquet(f"{at}/out")


_CALLS = "calls AS (SELECT o_custkey AS ticker, year(o_orderdate) AS y, quarter(o_orderdate) AS q, max(o_orderkey) AS id, count(*) AS n FROM orders WHERE o_orderpriority < '4' GROUP BY ALL)"


@query([], f"""WITH {_CALLS}, asked AS (SELECT o_orderkey, o_custkey AS ticker, CAST(o_orderdate AS DATE) AS d FROM orders),
c AS (SELECT a.*, k, CAST(date_trunc('quarter', d) - to_months(3 * k) AS DATE) AS s FROM asked a, (SELECT unnest([1, 2, 3]) AS k)),
w AS (SELECT o_orderkey, c.ticker, min(k) AS k, arg_min(id, k) AS id, arg_min(n, k) AS n FROM c JOIN calls ON calls.ticker = c.ticker AND y = year(s) AND q = quarter(s) GROUP BY ALL)
SELECT o_orderkey, CAST(k - 1 AS INT) AS place, id, n FROM w""")
def o13_latest_calls(spark, sf):
    """For each order's customer and day the latest of the three quarters before that has a call."""
    at = Sk.folder(spark, "calls")
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    calls = o.where("o_orderpriority < '4'").groupBy(F.col("o_custkey").alias("ticker"), F.year(d).alias("year"), F.quarter(d).alias("quarter")).agg(F.max("o_orderkey").alias("id"), F.count("*").alias("n"))
    calls.write.partitionBy("year", "quarter").parquet(at)
    asked = o.select("o_orderkey", F.col("o_custkey").alias("ticker"), d.cast("date").alias("as_of"))
    return V.latest_candidates(asked, spark.read.parquet(at)).select("o_orderkey", "place", "id", "n")


@query([], "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT user_id, event_type || '!', 2 * count(*) FROM events WHERE event_type <> 'view' GROUP BY ALL")
def y39_snapshots(spark, sf):
    """Two versions of run records, read as they were, with a torn third one that isn't read."""
    at = Sk.folder(spark, "snapshots")
    table_of = lambda more, where: table(spark, sf, "events").where(where).groupBy("user_id", F.concat("event_type", F.lit(more)).alias("event_type")).agg((F.count("*") * (1 + len(more))).alias("n"))
    s = Ver.Snapshots(spark, at)
    first = s.publish(table_of("", "true"))
    s.publish(table_of("!", "event_type <> 'view'"))
    fs, root = Ver._open(at)
    with fs.open_output_stream(f"{root}/manifests/{2:012d}.json") as f:
        f.write(b'{"schema": "')  # a writer that was stopped
    return s.read(first).unionByName(s.read())


@query([], "SELECT lower('T' || user_id) AS path_ticker, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS path_date, count(*) AS events, max(event_id) AS last FROM events GROUP BY ALL")
def s36_run_records(spark, sf):
    """A run record for each ticker and month, written as JSON files in folders, and read with ticker and date from their paths."""
    at = Sk.folder(spark, "records")
    e = table(spark, sf, "events").groupBy(F.lower(F.concat(F.lit("T"), F.col("user_id").cast("string"))).alias("ticker"), F.trunc(F.col("ts").cast("date"), "month").cast("string").alias("date")).agg(F.count("*").alias("events"), F.max("event_id").alias("last"))
    Rd.write_run_records(e, at)
    return Rd.run_records(spark, at, "events BIGINT, last BIGINT").select("path_ticker", "path_date", "events", "last")


@query([], "SELECT 'a' || event_id AS id, 'forum' AS origin, user_id AS score, CAST(NULL AS VARCHAR) AS label FROM events WHERE event_type = 'view' UNION ALL SELECT 'b' || event_id, 'stream', NULL, event_type FROM events WHERE event_type <> 'view'")
def t2_all_posts(spark, sf):
    """Posts of two sources with columns of their own, as one table."""
    e = table(spark, sf, "events")
    forum = e.where("event_type = 'view'").select(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("id"), F.lit("forum").alias("origin"), F.col("user_id").alias("score"))
    stream = e.where("event_type <> 'view'").select(F.col("event_type").alias("label"), F.lit("stream").alias("origin"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("id"))
    return Rd.posts(forum, stream)


@query([], "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def y47_daily_run(spark, sf):
    """A run over all days that is interrupted after some and taken up again: the table of a run that wasn't."""
    at, e = Sk.folder(spark, "ledger"), table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    work = lambda days: e.join(F.broadcast(days), "day").groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    run, days = Ver.Ledger(spark, at), e.select("day").distinct()
    run.run(days.where("dayofmonth(day) <= 10"), work, most=20)
    Ver.Ledger(spark, at).run(days, work, most=20)
    return run.rows()


@query([], "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 7 = 1 THEN 'gone' ELSE 'added' END AS change FROM documents WHERE doc_id % 7 < 3")
def y54_y55_y56_lock(spark, sf):
    """Digests of all documents as files, locked; which ones differ later, found from the root of their trees down."""
    at, d = Sk.folder(spark, "lock"), table(spark, sf, "documents")
    name, sha = F.concat(F.lit("src/"), F.col("doc_id").cast("string")), F.sha2("text", 256)
    Ver.lock(spark, d.where("doc_id % 7 <> 2").select(name.alias("name"), sha.alias("digest")), at)
    now = d.where("doc_id % 7 <> 1").select(name.alias("name"), F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(sha).alias("digest"))
    found = Ver.differences(spark.read.parquet(at), now)
    return found.select(F.substring("name", 5, 30).cast("long").alias("doc_id"), "change")


def _containers(spark, sf) -> str:
    at = Sk.folder(spark, "tensors")
    T.write_containers(table(spark, sf, "documents").where("text IS NOT NULL"), at, F.floor(F.col("doc_id") / 100), "doc_id", "text")
    T.register(spark)
    return at


@query([], "SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS digest, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL")
def c16_array_digests(spark, sf):
    """The bytes of every document as an array of a container file, read in pieces, each array's digest."""
    pieces = spark.read.format("tensors").option("path", _containers(spark, sf)).option("piece", 4096).option("share", 1 << 20).load()
    return T.array_digests(pieces).select("name", "digest", "bytes")


@query([], "SELECT doc_id // 100 || '.tensors' AS file, sha256(string_agg(CAST(doc_id AS VARCHAR) || text, '' ORDER BY CAST(doc_id AS VARCHAR))) AS digest, count(*) AS arrays FROM documents WHERE text IS NOT NULL GROUP BY 1")
def c16_parameter_digest(spark, sf):
    """One digest of all arrays of a file in order of name, names before bytes."""
    pieces = spark.read.format("tensors").option("path", _containers(spark, sf)).option("piece", 1 << 16).load()
    return T.parameter_digest(pieces).select("file", "digest", "arrays")
