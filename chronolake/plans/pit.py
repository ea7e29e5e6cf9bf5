"""Queries of point-in-time filters and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.functions import scalars as S
from chronolake.operators import joins as J
from chronolake.operators import pit as P
from chronolake.plans.book import query
from chronolake.plans.views import table, view

AS_OF = "1996-06-30"


@query(["statements"], "SELECT ticker, item, last_day(period) AS period_end, value FROM statements WHERE CAST(last_day(period) + INTERVAL 45 DAY AS DATE) <= DATE '1996-06-30'")
def p1_statement_pit(spark, sf):
    rows = view(spark, sf, "statements").withColumn("period_end", F.last_day("period"))
    return P.available_statements(rows, AS_OF).select("ticker", "item", "period_end", "value")


@query(["statements"], """SELECT ticker, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM statements
WHERE CASE WHEN k % 3 = 0 THEN CAST(period + INTERVAL 40 DAY AS DATE) ELSE CAST(last_day(period) + INTERVAL 90 DAY AS DATE) END <= DATE '1996-06-30' GROUP BY ticker""")
def p2_report_pit(spark, sf):
    """Nested reports: an array per ticker, filtered in place."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    r = F.struct(text(F.last_day("period")).alias("fiscalDateEnding"), F.when(F.col("k") % 3 == 0, text(F.date_add("period", 40))).alias("reportedDate"), F.lit(None).cast("string").alias("filingDate"), "value")
    reports = view(spark, sf, "statements").groupBy("ticker").agg(F.collect_list(r).alias("reports")).withColumn("reports", P.available_reports(F.col("reports"), AS_OF, "annual"))
    return reports.where(F.size("reports") > 0).select("ticker", F.size("reports").cast("long").alias("n"), F.aggregate("reports", F.lit(0).cast("long"), lambda s, x: s + x["value"]).alias("total"))


@query(["insider"], "SELECT ticker, count(*) AS n, CAST(sum(shares) AS BIGINT) AS shares FROM insider WHERE coalesce(filing_date, CAST(transaction_date + INTERVAL 2 DAY AS DATE)) <= DATE '1996-06-30' GROUP BY ticker")
def p3_insider_pit(spark, sf):
    return P.available_insider(view(spark, sf, "insider"), AS_OF).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"))


@query([], "SELECT user_id, count(*) AS items FROM events WHERE strftime(ts, '%Y%m%dT%H%M%S') BETWEEN '20240105T000000' AND '20240120T235959' GROUP BY user_id")
def p5_feed_filter(spark, sf):
    item = F.struct(F.col("event_type").alias("title"), F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("time_published"))
    feed = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(item).alias("feed"))
    feed = feed.withColumn("feed", P.feed_between(F.col("feed"), "2024-01-05", "2024-01-20"))
    return feed.where(F.size("feed") > 0).select("user_id", F.size("feed").cast("long").alias("items"))


@query([], "SELECT event_id, user_id FROM events WHERE CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END IS NULL OR (ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11')")
def p6_news_window(spark, sf):
    rows = table(spark, sf, "events").withColumn("pub_ts", F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("ts")))
    return P.news_between(rows, "2024-01-05", "2024-01-10").select("event_id", "user_id")


@query([], "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-11' ORDER BY event_id LIMIT 50")
def p7_limit_after_filter(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("ts", "pub_ts")
    return P.news_between(rows, "2024-01-05", "2024-01-10", closed=True).orderBy("event_id").limit(50).select("event_id", "event_type")


@query(["posts"], "SELECT id, source, score FROM posts WHERE epoch BETWEEN 1705190400 - 3 * 86400 AND 1705190400")
def p8_recent_posts(spark, sf):
    return P.recent_posts(view(spark, sf, "posts"), "2024-01-13").select("id", "source", "score")


@query(["samples"], "SELECT CASE WHEN available_date <= DATE '2018-12-31' THEN 'train' WHEN available_date BETWEEN DATE '2019-01-01' AND DATE '2019-12-31' THEN 'dev' WHEN available_date >= DATE '2020-01-01' THEN 'test' END AS split, task_label, count(*) AS n FROM samples GROUP BY ALL")
def p15_temporal_split(spark, sf):
    split = P.temporal_split(F.col("available_date"), "2018-12-31", "2019-01-01", "2019-12-31", "2020-01-01")
    return view(spark, sf, "samples").groupBy(split.alias("split"), "task_label").agg(F.count("*").alias("n"))


@query(["samples"], "SELECT sample_id FROM samples WHERE available_date <= DATE '2018-01-01'")
def p13_available_samples(spark, sf):
    return view(spark, sf, "samples").where(F.col("available_date") <= F.lit("2018-01-01").cast("date")).select("sample_id")


@query(["samples"], "SELECT document_type, bool_and(available_date >= event_date) AS ready, count(*) AS n FROM samples GROUP BY document_type")
def p17_readiness(spark, sf):
    return view(spark, sf, "samples").groupBy("document_type").agg(F.bool_and(F.col("available_date") >= F.col("event_date")).alias("ready"), F.count("*").alias("n"))


@query(["triples", "entities"], "SELECT predicate, object, e.name AS other_name FROM triples t JOIN entities e ON e.id = t.object WHERE subject = 'c7' AND (valid_from IS NULL OR valid_from <= DATE '1996-06-30') AND (valid_to IS NULL OR valid_to >= DATE '1996-06-30')")
def j1_entity_asof(spark, sf):
    return J.facts_at(view(spark, sf, "triples"), view(spark, sf, "entities"), AS_OF, "subject", "c7").select("predicate", "object", "other_name")


@query(["triples", "entities"], "SELECT s.name AS subject_name, o.name AS object_name FROM triples t JOIN entities s ON s.id = t.subject JOIN entities o ON o.id = t.object WHERE predicate = 'located_in'")
def j2_by_predicate(spark, sf):
    return J.by_predicate(view(spark, sf, "triples"), view(spark, sf, "entities"), "located_in", AS_OF).select("subject_name", "object_name")


@query(["triples", "entities"], "SELECT subject, predicate, object, valid_from FROM triples t JOIN entities s ON s.id = t.subject JOIN entities o ON o.id = t.object WHERE subject = 'c7' OR object = 'c7' ORDER BY valid_from NULLS LAST, subject, predicate, object LIMIT 100")
def j3_o1_timeline(spark, sf):
    return J.timeline(view(spark, sf, "triples"), view(spark, sf, "entities"), "c7").select("subject", "predicate", "object", "valid_from")


@query(["triples"], "SELECT d, count(*) AS valid FROM triples JOIN (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) AS d FROM orders) a ON (valid_from IS NULL OR valid_from <= d) AND (valid_to IS NULL OR valid_to >= d) GROUP BY d")
def j4_many_asofs(spark, sf):
    """Validity at many dates without a range join: counts of starts and ends up to each date."""
    days = table(spark, sf, "orders").select(F.trunc("o_orderdate", "year").alias("d")).distinct()
    return J.valid_counts(view(spark, sf, "triples"), days, "d").select("d", "valid")


_ASOF = """WITH ev AS (SELECT user_id % 100 + 1 AS ticker, event_id, CAST(ts AS DATE) - 9500 * INTERVAL 1 DAY AS d0 FROM events), e AS (SELECT ticker, event_id, CAST(d0 AS DATE) AS d FROM ev)
SELECT e.event_id, e.ticker, e.d, b.d AS matched_at, round(b.close, 6) AS close FROM e ASOF LEFT JOIN bars b ON e.ticker = b.ticker AND e.d >= b.d"""


def _events(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 100 + 1).alias("ticker"), "event_id", F.date_sub(F.col("ts").cast("date"), 9500).alias("d"))


@query(["bars"], _ASOF)
def j5_asof_price(spark, sf):
    bars = view(spark, sf, "bars").select("ticker", F.col("d").alias("bar_date"), "close")
    return J.asof(_events(spark, sf), bars, "ticker", "d", "bar_date", ["close"]).withColumn("close", F.round("close", 6))


@query(["bars"], _ASOF)
def j6_asof_split(spark, sf):
    """The same join with long keys cut by month."""
    bars = view(spark, sf, "bars").select("ticker", F.col("d").alias("bar_date"), "close")
    return J.asof_split(_events(spark, sf), bars, "ticker", "d", "bar_date", ["close"]).withColumn("close", F.round("close", 6))


@query(["statements"], "SELECT ticker, item, period, lead(value) OVER w - value AS change, lead(period) OVER w AS next_period FROM statements WINDOW w AS (PARTITION BY ticker, item ORDER BY period)")
def j10_w15_next_period(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("ticker", "item").orderBy("period")
    return view(spark, sf, "statements").select("ticker", "item", "period", (F.lead("value").over(w) - F.col("value")).alias("change"), F.lead("period").over(w).alias("next_period"))


@query(["triples"], "SELECT count(*) AS triples, count(*) FILTER (valid_to IS NULL) AS open, count(*) FILTER (valid_to IS NOT NULL) AS expired, count(DISTINCT predicate) AS predicates FROM triples")
def a10_graph_stats(spark, sf):
    return view(spark, sf, "triples").agg(F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("open"), F.count_if(F.col("valid_to").isNotNull()).alias("expired"), F.count_distinct("predicate").alias("predicates"))


@query(["triples"], "SELECT n.subject, n.object FROM (SELECT subject, predicate, object FROM triples WHERE predicate = 'ordered') n WHERE NOT EXISTS (SELECT 1 FROM triples t WHERE t.valid_to IS NULL AND t.subject = n.subject AND t.predicate = n.predicate AND t.object = n.object)")
def m2_insert_new(spark, sf):
    t = view(spark, sf, "triples")
    return J.insert_new(t, t.where("predicate = 'ordered'").select("subject", "predicate", "object")).select("subject", "object")


@query(["triples"], "SELECT subject, predicate, object, CASE WHEN valid_to IS NULL AND predicate = 'located_in' THEN DATE '1998-01-01' ELSE valid_to END AS valid_to FROM triples")
def m3_invalidate(spark, sf):
    t = view(spark, sf, "triples")
    ended = t.where("predicate = 'located_in'").select("subject", "predicate", "object", F.lit("1998-01-01").cast("date").alias("ended"))
    return J.invalidate(t, ended).select("subject", "predicate", "object", "valid_to")


@query([], "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS as_int, strftime(o_orderdate, '%Y%m%d') || 'T2359' AS api, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS q_end, CASE dayofweek(o_orderdate) WHEN 6 THEN CAST(o_orderdate + INTERVAL 2 DAY AS DATE) WHEN 0 THEN CAST(o_orderdate + INTERVAL 1 DAY AS DATE) ELSE CAST(o_orderdate AS DATE) END AS weekday FROM orders")
def f_date_functions(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", S.int_date(d).alias("as_int"), S.api_time(d, True).alias("api"), S.quarter_end(F.year(d), F.quarter(d)).alias("q_end"), S.next_weekday(d).alias("weekday"))
