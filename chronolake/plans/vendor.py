"""Queries of vendor answers, feeds and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.functions import scalars as S
from chronolake.operators import corpus as C
from chronolake.operators import joins as J
from chronolake.operators import vendor as V
from chronolake.plans.book import query
from chronolake.plans.views import table, view

_text = lambda c: F.date_format(c, "yyyy-MM-dd")


@query([], """SELECT c_custkey, label, value FROM (SELECT c_custkey, 'Name' AS label, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'Sector', CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END FROM customer
UNION ALL SELECT c_custkey, 'Beta', CAST(c_custkey % 7 AS VARCHAR) FROM customer) WHERE value IS NOT NULL""")
def s8_s13_overview(spark, sf):
    raw = F.to_json(F.struct(F.col("c_name").alias("longName"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("sector"), (F.col("c_custkey") % 7).alias("beta"), F.lit(1).alias("other")))
    return table(spark, sf, "customer").select("c_custkey", F.explode(V.overview(raw)).alias("p")).select("c_custkey", "p.label", "p.value")


@query([], "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'withheld' ELSE '# Company Fundamentals for ' || upper(c_name) || chr(10) || chr(10) || 'Name: ' || c_name END AS text FROM customer")
def p9_y20_withheld_overview(spark, sf):
    """A snapshot is shown only to requests without an as-of."""
    from chronolake.operators.pit import snapshot_notice

    as_of = F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-01-01").cast("date"))
    text = V.overview_text(F.col("c_name"), F.to_json(F.struct(F.col("c_name").alias("longName"))))
    return table(spark, sf, "customer").select("c_custkey", snapshot_notice(as_of, None, text, "withheld").alias("text"))


_KINDS = "CASE item WHEN 'F' THEN 'balance' WHEN 'O' THEN 'cashflow' ELSE 'income' END"
_ASK = f"""st AS (SELECT ticker, {_KINDS} AS kind, CASE WHEN month(period) = 12 THEN 'annual' ELSE 'quarterly' END AS freq, last_day(period) AS period_end, value FROM statements),
rq AS (SELECT t AS ticker, k AS kind, f AS freq, CASE WHEN t % 4 > 0 THEN CAST(DATE '1992-02-01' + CAST(t * 50 AS INT) * INTERVAL 1 DAY AS DATE) END AS as_of
  FROM (SELECT unnest(range(30))::INTEGER AS t) a, (SELECT unnest(['balance', 'cashflow', 'income']) AS k) b, (SELECT unnest(['annual', 'quarterly']) AS f) c)"""


def _requests(spark):
    t = spark.range(30).select(F.col("id").cast("int").alias("ticker"))
    as_of = F.when(F.col("ticker") % 4 > 0, F.date_add(F.lit("1992-02-01").cast("date"), F.col("ticker") * 50))
    kinds, freqs = (F.explode(F.array(*map(F.lit, x))) for x in (("balance", "cashflow", "income"), ("annual", "quarterly")))
    return t.withColumn("kind", kinds).withColumn("freq", freqs).withColumn("as_of", as_of)


@query(["statements"], f"""WITH {_ASK}, f AS (SELECT rq.ticker, rq.kind, rq.freq, CAST(sum(value) AS BIGINT) AS total, count(*) AS n FROM rq JOIN st USING (ticker, kind, freq)
  WHERE as_of IS NULL OR period_end + CASE freq WHEN 'annual' THEN 90 ELSE 45 END * INTERVAL 1 DAY <= as_of GROUP BY ALL)
SELECT ticker, kind, freq, as_of, total, coalesce(n, 0) AS n, CASE WHEN NOT EXISTS (SELECT 1 FROM st WHERE st.ticker = rq.ticker AND st.kind = rq.kind AND st.freq = rq.freq) THEN NULL WHEN n IS NULL THEN 'empty' ELSE 'data' END AS status FROM rq LEFT JOIN f USING (ticker, kind, freq)""")
def s9_s10_s11_y1_y2_y7_p11_statements(spark, sf):
    kind = F.when(F.col("item") == "F", "balance").when(F.col("item") == "O", "cashflow").otherwise("income")
    freq = F.when(F.month("period") == 12, "annual").otherwise("quarterly")
    store = view(spark, sf, "statements").select("ticker", kind.alias("kind"), freq.alias("freq"), F.last_day("period").alias("period_end"), "value")
    return V.statements(_requests(spark), store)


@query(["insider"], """WITH rq AS (SELECT t::BIGINT AS ticker, CASE WHEN t % 5 > 0 THEN CAST(DATE '1992-01-01' + CAST(t * 20 AS INT) * INTERVAL 1 DAY AS DATE) END AS as_of FROM (SELECT unnest(range(120)) AS t)),
f AS (SELECT rq.ticker, CAST(sum(shares) AS BIGINT) AS shares, count(*) AS n FROM rq JOIN insider i USING (ticker) WHERE as_of IS NULL OR coalesce(filing_date, CAST(transaction_date + INTERVAL 2 DAY AS DATE)) <= as_of GROUP BY rq.ticker)
SELECT ticker, as_of, shares, coalesce(n, 0) AS n, CASE WHEN ticker NOT IN (SELECT ticker FROM insider) THEN NULL WHEN n IS NULL THEN 'empty' ELSE 'data' END AS status FROM rq LEFT JOIN f USING (ticker)""")
def s12_y3_insider_answers(spark, sf):
    t = spark.range(120).select(F.col("id").alias("ticker"))
    t = t.withColumn("as_of", F.when(F.col("ticker") % 5 > 0, F.date_add(F.lit("1992-01-01").cast("date"), (F.col("ticker") * 20).cast("int"))))
    return V.insider(t, view(spark, sf, "insider").select("ticker", "transaction_date", "filing_date", "shares"))


@query(["statements"], """WITH r AS (SELECT ticker, month(period) = 12 AS annual, value, CASE WHEN k % 3 = 0 THEN CAST(period + INTERVAL 40 DAY AS DATE) WHEN k % 3 = 1 THEN CAST(last_day(period) + CASE WHEN month(period) = 12 THEN 90 ELSE 45 END * INTERVAL 1 DAY AS DATE) ELSE CAST(period + INTERVAL 70 DAY AS DATE) END AS seen FROM statements),
k AS (SELECT *, ticker % 5 = 0 OR seen <= DATE '1996-06-30' AS ok FROM r)
SELECT ticker, count(*) FILTER (annual AND ok) AS annual, count(*) FILTER (NOT annual AND ok) AS quarterly, CAST(coalesce(sum(value) FILTER (ok), 0) AS BIGINT) AS total FROM k GROUP BY ticker""")
def s14_y4_y9_y12_report_payloads(spark, sf):
    """JSON payloads of both lists of reports: the dates that are there decide; tickers divisible by 5 ask without an as-of."""
    k = F.col("k") % 3
    none = F.lit(None).cast("string")
    r = F.struct(_text(F.last_day("period")).alias("fiscalDateEnding"), F.when(k == 0, _text(F.date_add("period", 40))).alias("reportedDate"), none.alias("filingDate"), F.when(k == 2, _text(F.date_add("period", 70))).alias("filing_date"), "value")
    part = lambda ok, name: F.collect_list(F.when(ok, r)).alias(name)
    lists = view(spark, sf, "statements").groupBy("ticker").agg(part(F.month("period") == 12, "annualReports"), part(F.month("period") != 12, "quarterlyReports"))
    raw = F.to_json(F.struct(F.col("ticker").cast("string").alias("symbol"), "annualReports", "quarterlyReports"))
    as_of = F.when(F.col("ticker") % 5 > 0, F.lit("1996-06-30").cast("date"))
    kept = lists.select("ticker", F.from_json(V.reports(raw, as_of), V.REPORTS).alias("p"))
    total = F.aggregate(F.concat("p.annualReports", "p.quarterlyReports"), F.lit(0).cast("long"), lambda s, x: s + x["value"])
    return kept.select("ticker", F.size("p.annualReports").cast("long").alias("annual"), F.size("p.quarterlyReports").cast("long").alias("quarterly"), total.alias("total"))


@query(["insider"], "SELECT ticker, count(*) FILTER (ticker % 6 = 0 OR coalesce(filing_date, CAST(transaction_date + INTERVAL 2 DAY AS DATE)) <= DATE '1994-06-30') AS n FROM insider GROUP BY ticker")
def s17_y5_insider_payloads(spark, sf):
    row = F.struct(_text("transaction_date").alias("transaction_date"), _text("filing_date").alias("filing_date"), "shares")
    raw = view(spark, sf, "insider").groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("raw"))
    as_of = F.when(F.col("ticker") % 6 > 0, F.lit("1994-06-30").cast("date"))
    return raw.select("ticker", F.size(V.insider_payload(F.col("raw"), as_of)).cast("long").alias("n"))


_STAMP = "strftime(ts, '%Y%m%dT%H%M%S')"


@query([], f"SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN CAST(count(*) FILTER ({_STAMP} BETWEEN '20240103T000000' AND '20240118T235959') AS VARCHAR) END AS items FROM events GROUP BY user_id")
def s15_y6_y19_ticker_feed(spark, sf):
    """Feeds of the tickers that the cache holds (those somebody bought); others get no answer."""
    item = F.struct(F.col("event_type").alias("title"), F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("time_published"))
    e = table(spark, sf, "events")
    store = e.join(e.where("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_semi")
    raw = store.groupBy("user_id").agg(F.to_json(F.struct(F.lit("0").alias("items"), F.collect_list(item).alias("feed"))).alias("raw"))  # a feed is one answer
    told = raw.select("user_id", V.feed(F.col("raw"), "2024-01-03", "2024-01-18").alias("f")).select("user_id", "f.items")
    return e.select("user_id").distinct().join(told, "user_id", "left")


@query([], f"SELECT event_id, event_type FROM events WHERE {_STAMP} BETWEEN '20240108T000000' AND '20240115T235959' ORDER BY event_id LIMIT 50")
def s16_p7a_y10_global_feed(spark, sf):
    """Seven days back, closed, the first 50 as they arrived."""
    at = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    return table(spark, sf, "events").where(at.between("20240108T000000", "20240115T235959")).orderBy("event_id").limit(50).select("event_id", "event_type")


@query([], "SELECT event_id, user_id FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS pub_ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 20 AND (pub_ts IS NULL OR (pub_ts >= TIMESTAMP '2024-01-05' AND pub_ts < TIMESTAMP '2024-01-16'))")
def s18_y8_ticker_news_live(spark, sf):
    """Twenty articles are fetched first, then dates are looked at."""
    rows = table(spark, sf, "events").withColumn("pub_ts", F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("ts")))
    return V.first_then_filter(rows, ["user_id"], "event_id", 20, "2024-01-05", "2024-01-15").select("event_id", "user_id")


_ORDER = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END"


@query([], f"""WITH a AS (SELECT {_ORDER} AS q, event_id, CASE WHEN user_id % 9 > 0 THEN 'story ' || CAST(user_id % 200 AS VARCHAR) ELSE '' END AS title, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS pub_ts FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY q, event_id) AS n FROM a WHERE title <> ''), l AS (SELECT * FROM f WHERE n = 1 ORDER BY q, event_id LIMIT 40) SELECT title, event_id FROM l WHERE pub_ts IS NULL OR pub_ts < TIMESTAMP '2024-01-11'""")
def s19_o6_o7_m19_global_news_live(spark, sf):
    """Four searches in turn, titles once, the list cut, and only then what comes later than the day left out."""
    kind = F.col("event_type")
    q = F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "purchase", 2).otherwise(3)
    title = F.when(F.col("user_id") % 9 > 0, F.concat(F.lit("story "), (F.col("user_id") % 200).cast("string"))).otherwise("")
    rows = table(spark, sf, "events").select(title.alias("title"), q.alias("q"), "event_id", F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("ts")).alias("pub_ts"))
    once = V.first_titles(rows, "title", ["q", "event_id"]).withColumn("order", F.struct("q", "event_id"))
    return V.first_then_filter(once, [], "order", 40, None, "2024-01-10").select("title", "event_id")


@query([], "SELECT event_id FROM events WHERE event_id % 13 = 0 OR event_id % 11 = 0 OR (ts <= TIMESTAMP '2024-01-11' AND ts >= TIMESTAMP '2024-01-03') ORDER BY event_id LIMIT 60")
def p7_global_news(spark, sf):
    """Flat articles pass whatever their time, undated ones too, and the limit comes last."""
    rows = table(spark, sf, "events").withColumns({"flat": F.col("event_id") % 13 == 0, "pub_ts": F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("ts"))})
    return V.global_news(rows, "2024-01-10", 7, 60, "event_id").select("event_id")


@query([], "SELECT c_custkey, upper(c_name) AS ticker, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey * 7 AS VARCHAR), 10, '0') END AS cik FROM customer")
def s20_j18_cik(spark, sf):
    """Tickers to ten-digit filer numbers by a map that is read once; a ticker without one stays."""
    c = table(spark, sf, "customer")
    codes = c.where("c_custkey % 3 = 0").select(F.upper("c_name").alias("ticker"), F.lpad((F.col("c_custkey") * 7).cast("string"), 10, "0").alias("cik"))
    return c.select("c_custkey", F.upper("c_name").alias("ticker")).join(codes, "ticker", "left").select("c_custkey", "ticker", "cik")


_QEND = "last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE))"


@query([], f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) ELSE CAST({_QEND} + INTERVAL 45 DAY AS DATE) END AS at_date, o_orderkey % 3 = 0 AS estimated FROM orders")
def s22_transcript_dates(spark, sf):
    d = F.col("o_orderdate").cast("date")
    t = V.transcript_date(F.when(F.col("o_orderkey") % 3 > 0, d), S.quarter_end(F.year(d), F.quarter(d)))
    return table(spark, sf, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", F.col("t.at").alias("at_date"), "t.estimated")


@query([], """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1) // 5 AS page FROM events), l AS (SELECT *, min(CASE WHEN ts < TIMESTAMP '2024-01-12' THEN page END) OVER (PARTITION BY user_id) AS last FROM p WHERE page < 3)
SELECT user_id, event_id FROM l WHERE (last IS NULL OR page <= last) AND ts >= TIMESTAMP '2024-01-12'""")
def s23_stream_pages(spark, sf):
    cutoff = F.lit("2024-01-12").cast("timestamp_ntz")
    return V.pages_back(table(spark, sf, "events"), "user_id", "event_id", "ts", cutoff, per_page=5, most=3).select("user_id", "event_id")


@query([], "SELECT doc_id, text FROM (SELECT doc_id, nullif(trim(title || CASE WHEN body <> '' THEN ' ' || left(body, 300) ELSE '' END), '') AS text FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS title, CASE WHEN doc_id % 5 = 0 THEN '' ELSE trim(replace(text, chr(10), ' '), ' ') END AS body FROM documents)) WHERE text IS NOT NULL")
def s24_forum_posts(spark, sf):
    k = F.col("doc_id")
    text = V.forum_text(F.when(k % 4 == 0, None).otherwise(F.col("source")), F.when(k % 5 == 0, "").otherwise(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", text.alias("text")).where("text IS NOT NULL")


@query(["posts"], """SELECT id, source, CASE WHEN TIMESTAMP '2024-01-16 12:00:00' > CAST(d AS TIMESTAMP) + INTERVAL 3 DAY THEN 'historical' ELSE 'live' END AS status, TIMESTAMP '2024-01-16 12:00:00' <= CAST(d AS TIMESTAMP) + INTERVAL 3 DAY AND epoch BETWEEN epoch(d) + 86400 - 259200 AND epoch(d) + 86400 AS shown
FROM (SELECT *, CAST(DATE '2024-01-10' + CAST(id % 7 AS INT) * INTERVAL 1 DAY AS DATE) AS d FROM posts)""")
def s25_p22_social_posts(spark, sf):
    """Posts of a request's day are shown while the day is live, and then only those of the window before its end."""
    d = F.date_add(F.lit("2024-01-10").cast("date"), (F.col("id") % 7).cast("int"))
    rows = view(spark, sf, "posts").withColumn("d", d).withColumn("status", V.social_status(F.col("d"), F.lit("2024-01-16 12:00:00").cast("timestamp")))
    end = F.unix_timestamp(F.date_add("d", 1).cast("timestamp"))
    return rows.select("id", "source", "status", ((F.col("status") == "live") & F.col("epoch").between(end - 3 * 86400, end)).alias("shown"))


@query([], """SELECT 'tdw_' || source || '_' || doc_id AS sample_id, CASE raw WHEN '0' THEN -1 WHEN '1' THEN 1 ELSE 0 END AS task_label, CAST(1996 + doc_id % 27 AS VARCHAR) || '-07-01T00:00:00Z' AS event_time, 'unknown' AS availability_quality, split, source AS source_file
FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '-' WHEN 4 THEN NULL ELSE '2' END AS raw, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM documents) WHERE raw IN ('0', '1', '2') AND trim(text) <> ''""")
def s31_s32_stance_corpus(spark, sf):
    """Spreadsheet rows to samples: labels mapped, unlabelled and empty rows out, ids made of file and row, a year's middle as its time."""
    k = F.col("doc_id")
    raw = F.when(k % 6 == 0, "0").when(k % 6 == 1, "1").when(k % 6 == 2, "2").when(k % 6 == 3, "-").when(k % 6 == 5, "2")
    d = table(spark, sf, "documents").withColumn("label", V.stance_label(raw)).where("label IS NOT NULL AND trim(text) <> ''")
    time = F.concat((1996 + k % 27).cast("string"), F.lit("-07-01T00:00:00Z"))
    return d.select(F.concat_ws("_", F.lit("tdw"), "source", k.cast("string")).alias("sample_id"), F.col("label").alias("task_label"), time.alias("event_time"), F.lit("unknown").alias("availability_quality"), F.when(k % 2 == 0, "train").otherwise("test").alias("split"), F.col("source").alias("source_file"))


@query([], """SELECT split, false AS ready, count(*) AS n FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '-' WHEN 4 THEN NULL ELSE '2' END AS raw, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM documents) WHERE raw IN ('0', '1', '2') AND trim(text) <> '' GROUP BY split""")
def y50_stance_benchmark(spark, sf):
    """Each split of the stance corpus as a benchmark: its sources and labels are verified, its days aren't, so none is ready for formal results."""
    out = None
    for split in ("train", "test"):
        samples, flags = V.stance_benchmark(s31_s32_stance_corpus(spark, sf).where(F.col("split") == split))
        one = C.ready(samples, flags).select(F.lit(split).alias("split"), "ready", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query([], """WITH r AS (SELECT o_custkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderpriority AS transcript FROM orders), h AS (SELECT DISTINCT o_custkey, y, q FROM r WHERE o_custkey % 4 = 0 AND q = 1)
SELECT o_custkey, CAST(y AS INTEGER) AS y, CAST(q AS INTEGER) AS q, count(*) AS n FROM r WHERE o_custkey % 2 = 0 AND transcript <> '5-LOW' AND NOT EXISTS (SELECT 1 FROM h WHERE h.o_custkey = r.o_custkey AND h.y = r.y AND h.q = r.q) GROUP BY ALL""")
def s34_y28_backfill(spark, sf):
    """Transcripts of the asked symbols that are whole and not there yet."""
    d = F.col("o_orderdate")
    r = table(spark, sf, "orders").select("o_custkey", F.year(d).alias("y"), F.quarter(d).alias("q"), "o_orderpriority")
    have = r.where("o_custkey % 4 = 0 AND q = 1").select("o_custkey", "y", "q").distinct()
    new = r.where("o_custkey % 2 = 0 AND o_orderpriority <> '5-LOW'").join(have, ["o_custkey", "y", "q"], "left_anti")
    return new.groupBy("o_custkey", "y", "q").agg(F.count("*").alias("n"))


@query([], f"SELECT o_custkey, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS at_date FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_QEND} DESC, o_orderkey) AS n FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-06-30' AND CAST(o_orderdate AS DATE) >= DATE '1996-06-30' - INTERVAL 365 DAY) WHERE n = 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def m11a_y28_ensure_transcript(spark, sf):
    """The latest call of a year's window, if it isn't indexed yet."""
    from chronolake.operators.pit import CALL_DAYS, within_days

    o = table(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("date"))
    recent = o.where(within_days(F.col("at"), F.lit("1996-06-30").cast("date"), CALL_DAYS))
    q = S.quarter_end(F.year("at"), F.quarter("at"))
    newest = J.latest(recent.withColumn("q", q), ["o_custkey"], [F.desc("q"), F.asc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("accession"), "at")
    return newest.join(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("accession")), "accession", "left_anti").select("o_custkey", "accession", F.col("at").alias("at_date"))
