"""Queries of logs, paired studies, samples and stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolake.functions import scalars as S
from chronolake.operators import joins as J
from chronolake.operators import logs as L
from chronolake.operators import pit as P
from chronolake.operators import stats as R
from chronolake.plans.book import query
from chronolake.plans.views import table, view


@query(["bars"], """SELECT t.ticker, CAST(DATE '1996-06-30' - CAST(i AS INT) * INTERVAL 1 DAY AS DATE) AS d, coalesce(printf('%.2f', floor(b.close)), 'N/A: Not a trading day (weekend or holiday)') AS report
FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT unnest(range(15)) AS i) g LEFT JOIN bars b ON b.ticker = t.ticker AND b.d = CAST(DATE '1996-06-30' - CAST(i AS INT) * INTERVAL 1 DAY AS DATE)""")
def w1_indicator_report(spark, sf):
    return L.calendar_report(view(spark, sf, "bars").withColumn("v", F.floor("close").cast("double")), "ticker", "d", "v", "1996-06-30", 14)


@query([], "SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series(min(l_shipdate)::TIMESTAMP, max(l_shipdate)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM lineitem) WHERE dayofweek(d) BETWEEN 1 AND 5")
def w19_trading_days(spark, sf):
    """The weekdays of the time that the bars span."""
    a, b = table(spark, sf, "lineitem").agg(F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date")).first()
    return L.trading_days(str(a), str(b), spark)


@query([], "SELECT label, dose, round((e - lag(e) OVER (PARTITION BY label ORDER BY dose)) / CASE WHEN l = lag(l) OVER (PARTITION BY label ORDER BY dose) THEN 1e-6 ELSE l - lag(l) OVER (PARTITION BY label ORDER BY dose) END, 4) AS ratio FROM (SELECT label, CAST(vec_id % 5 AS INTEGER) AS dose, sum(CAST(round(embedding[1] * 1000) AS BIGINT))::DOUBLE AS e, count(*)::DOUBLE AS l FROM embeddings GROUP BY ALL)")
def w14_marginal_ratio(spark, sf):
    d = table(spark, sf, "embeddings").groupBy("label", (F.col("vec_id") % 5).cast("int").alias("dose")).agg(F.sum(F.round(F.col("embedding")[0].cast("double") * 1000).cast("long")).cast("double").alias("e"), F.count("*").cast("double").alias("l"))
    w = Window.partitionBy("label").orderBy("dose")
    step = F.col("l") - F.lag("l").over(w)
    return d.select("label", "dose", F.round((F.col("e") - F.lag("e").over(w)) / F.when(step == 0, 1e-6).otherwise(step), 4).alias("ratio"))


@query(["signals"], "SELECT ticker, round(avg(confidence), 6) AS stance, arg_min(actual_return, seq) AS first_return FROM signals GROUP BY ticker")
def a13_event_level(spark, sf):
    return view(spark, sf, "signals").groupBy("ticker").agg(F.round(F.avg("confidence"), 6).alias("stance"), F.min_by("actual_return", "seq").alias("first_return"))


@query(["signals"], "SELECT round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(stddev_samp(m), 6) AS sd, count(*) AS n FROM (SELECT ticker, avg(confidence) - avg(actual_return) AS m FROM signals GROUP BY ticker)")
def a14_behaviour(spark, sf):
    d = view(spark, sf, "signals").groupBy("ticker").agg((F.avg("confidence") - F.avg("actual_return")).alias("m"))
    return d.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.median("m"), 6).alias("median"), F.round(F.stddev_samp("m"), 6).alias("sd"), F.count("*").alias("n"))


@query([], "SELECT event_id, round(median(x), 6) AS median, round(avg(CAST(x > 0 AS DOUBLE)), 6) AS positive FROM (SELECT CAST(vec_id // 4 AS BIGINT) AS event_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY event_id")
def a22_event_medians(spark, sf):
    d = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("event_id"), F.explode("embedding").alias("x"))
    return d.groupBy("event_id").agg(F.round(F.median(F.col("x").cast("double")), 6).alias("median"), F.round(F.avg((F.col("x") > 0).cast("double")), 6).alias("positive"))


@query([], "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 3 + 1 ELSE event_id % 4 END AS items FROM events")
def a24_news_count(spark, sf):
    feed = F.concat(F.lit('{"feed":['), F.array_join(F.array_repeat(F.lit("{}"), (F.col("event_id") % 3 + 1).cast("int")), ","), F.lit("]}"))
    marks = F.repeat(F.lit("### head\n"), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf, "events").select("event_id", L.news_count(F.when(F.col("event_id") % 2 == 0, feed).otherwise(marks)).alias("items"))


@query([], "SELECT user_id, event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY user_id, event_type")
def a25_a26_counters(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query([], "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'n' || event_id WHEN event_id % 3 = 1 THEN 'f' || event_id END, 'No title') AS title, CASE WHEN event_id % 3 = 1 THEN 'pub' ELSE 'Unknown' END AS publisher FROM events")
def p19_articles(spark, sf):
    i = F.col("event_id").cast("string")
    nested = F.concat(F.lit('{"content":{"title":"n'), i, F.lit('"}}'))
    flat = F.concat(F.lit('{"title":"f'), i, F.lit('","publisher":"pub"}'))
    raw = F.when(F.col("event_id") % 3 == 0, nested).when(F.col("event_id") % 3 == 1, flat).otherwise("{}")
    return table(spark, sf, "events").select("event_id", L.article(raw).alias("a")).select("event_id", "a.title", "a.publisher")


@query(["insider"], "SELECT ticker, count(*) AS n FROM insider WHERE coalesce(filing_date, CAST(transaction_date + INTERVAL 2 DAY AS DATE)) <= DATE '1995-06-30' GROUP BY ticker")
def p4_insider_nested(spark, sf):
    """The nested form: filtered inside an array of structs."""
    arr = F.collect_list(F.struct("transaction_date", "filing_date", "shares"))
    d = view(spark, sf, "insider").groupBy("ticker").agg(arr.alias("data"))
    seen = F.filter("data", lambda r: F.coalesce(r["filing_date"], F.date_add(r["transaction_date"], P.INSIDER_LAG)) <= F.lit("1995-06-30").cast("date"))
    return d.select("ticker", F.size(seen).cast("long").alias("n")).where("n > 0")


@query([], "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, count(*) FILTER (CAST(o_orderdate AS DATE) >= DATE '1996-06-30') AS shown FROM orders GROUP BY ALL")
def p10_snapshot_gate(spark, sf):
    d = F.col("o_orderdate").cast("date")
    text = P.snapshot_notice(d, F.lit("1996-06-30").cast("date"), F.lit("data"), "withheld")
    return table(spark, sf, "orders").groupBy(d.alias("d")).agg(F.count("*").alias("n"), F.count_if(text == "data").alias("shown"))


@query([], "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2000 ELSE CAST(1990 + doc_id % 40 AS INTEGER) END <= 2010 AS early FROM documents")
def p16_year_split(spark, sf):
    meta = F.when(F.col("doc_id") % 5 == 0, F.lit("bad")).otherwise((1990 + F.col("doc_id") % 40).cast("string"))
    year = F.coalesce(meta.try_cast("int"), F.lit(2000))
    return table(spark, sf, "documents").select("doc_id", (year <= 2010).alias("early"))


@query(["triples"], "SELECT subject AS node, predicate, object AS other, 'out' AS direction FROM triples WHERE predicate = 'located_in' UNION ALL SELECT object, predicate, subject, 'in' FROM triples WHERE predicate = 'located_in'")
def t1_both_directions(spark, sf):
    t = view(spark, sf, "triples").where("predicate = 'located_in'")
    out = t.select(F.col("subject").alias("node"), "predicate", F.col("object").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(t.select(F.col("object").alias("node"), "predicate", F.col("subject").alias("other"), F.lit("in").alias("direction")))


@query([], "SELECT o_custkey, year, quarter, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year DESC, quarter DESC, o_orderkey) AS n FROM (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS q FROM orders) WHERE CAST(q + INTERVAL 45 DAY AS DATE) <= DATE '1997-01-01') WHERE n <= 3")
def j8_latest_transcripts(spark, sf):
    d = F.col("o_orderdate").cast("date")
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.year(d).alias("year"), F.quarter(d).alias("quarter"))
    rows = rows.where(F.date_add(S.quarter_end(F.col("year"), F.col("quarter")), 45) <= F.lit("1997-01-01").cast("date"))
    return J.latest(rows, ["o_custkey"], [F.desc("year"), F.desc("quarter"), F.asc("o_orderkey")], 3)


@query([], "SELECT c_custkey, count(o_orderkey) AS orders, count(o_orderkey) = 0 AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j12_anchor_groups(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    d = table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0).cast("long")))
    return d.withColumn("missing", F.col("orders") == 0)


@query([], "SELECT a.label, CAST(b.vec_id % 5 AS INTEGER) AS dose, round(avg(b.embedding[1]::DOUBLE - a.embedding[1]::DOUBLE), 6) AS delta, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id // 5 = b.vec_id // 5 AND a.vec_id % 5 = 0 AND b.vec_id % 5 > 0 GROUP BY ALL")
def j16_r8_paired(spark, sf):
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("event"), (F.col("vec_id") % 5).cast("int").alias("dose"), "label", F.col("embedding")[0].cast("double").alias("v"))
    clean = e.where("dose = 0").select("event", "label", F.col("v").alias("v0"))
    d = e.where("dose > 0").drop("label").join(clean, "event")
    return d.groupBy("label", "dose").agg(F.round(F.avg(F.col("v") - F.col("v0")), 6).alias("delta"), F.count("*").alias("n"))


@query([], "SELECT doc_id, n FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def o9_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    twice = d.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return d.join(twice, "h").select("doc_id", "n")


@query([], "SELECT draw, CAST(pick AS BIGINT) AS pick FROM (SELECT unnest(range(300)) AS draw), (SELECT count(*) AS n FROM benchmark) LEFT JOIN LATERAL (SELECT CAST('0x' || left(md5('sample:' || draw), 8) AS BIGINT) % n AS pick) ON true")
def o12_sample_with_replacement(spark, sf):
    n = table(spark, sf, "benchmark").count()
    return spark.range(300).select(F.col("id").alias("draw"), R.hash_index(n, F.lit("sample"), F.col("id").cast("string")).alias("pick"))


@query([], "SELECT label AS block, CAST(p AS INTEGER) AS place, CAST('0x' || left(md5('mask:' || label || ':' || p), 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE < 0.15::DOUBLE AS masked FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest(range(128)) AS p)")
def c4_mask_schedule(spark, sf):
    return L.mask_schedule(table(spark, sf, "embeddings").select(F.col("label").alias("block")).distinct(), 128, 0.15, "mask")


@query([], "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def y37_bounded_log(spark, sf):
    return L.bounded_log(table(spark, sf, "conversations"), ["conv_id"], "turn", 2).select("conv_id", "turn", "role")


@query([], "SELECT conv_id, turn, CASE WHEN length(text) > 400 THEN 'completed' WHEN turn = min(CASE WHEN NOT length(text) > 400 THEN turn END) OVER (PARTITION BY conv_id) THEN 'in_progress' ELSE 'pending' END AS status FROM conversations")
def y38_m14_statuses(spark, sf):
    d = table(spark, sf, "conversations").withColumn("done", F.length("text") > 400)
    return L.first_open(d, ["conv_id"], "turn", "done").select("conv_id", "turn", "status")


@query([], "SELECT doc_id, room, doc, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) * INTERVAL 1 DAY AS DATE) AS valid_from FROM (SELECT doc_id, unnest(['news', 'market']) AS room, unnest([CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END, source]) AS doc FROM documents) WHERE length(trim(doc, ' ')) > 0")
def m7_y26_store_reports(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text")).alias("news"), F.col("source").alias("market"))
    return L.store_reports(d, ["news", "market"], "day").select("doc_id", "room", "doc", "valid_from")


@query([], """WITH e AS (SELECT DISTINCT CAST(vec_id // 4 AS BIGINT) AS event_id FROM embeddings), n AS (SELECT count(*) AS n, greatest(2, least(4, count(*) // 3)) AS k FROM e), s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM e),
r AS (SELECT event_id, fold, CASE WHEN i < n - (k - fold) * (n // (k + 1)) THEN 'train' WHEN i < n - (k - fold - 1) * (n // (k + 1)) THEN 'test' END AS role FROM s, n, (SELECT unnest(range(4))::INTEGER AS fold) WHERE fold < k) SELECT * FROM r WHERE role IS NOT NULL""")
def w18_tail_folds(spark, sf):
    events = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("event_id")).distinct()
    return R.tail_folds(events, ["event_id"], 4)


_RUNGS = "(VALUES (0, 'm0'), (1, 'm1'), (2, 'm2'), (3, 'm3'), (4, 'm4'), (5, 'none')) r(rung, model)"
_BY_MODEL = "SELECT 'm' || (vec_id % 5) AS model, sum(CAST(round(embedding[1]::DOUBLE * 1000) AS BIGINT))::DOUBLE AS e, (count(*) // 10)::DOUBLE AS l FROM embeddings GROUP BY ALL"


@query([], f"SELECT rung, model, e, l, round((e - lag(e) OVER (ORDER BY rung)) / CASE WHEN l = lag(l) OVER (ORDER BY rung) THEN 1e-6::DOUBLE ELSE l - lag(l) OVER (ORDER BY rung) END, 4) AS marginal FROM {_RUNGS} LEFT JOIN ({_BY_MODEL}) m USING (model)")
def r13_j11_model_ladder(spark, sf):
    e = F.round(F.col("embedding")[0].cast("double") * 1000).cast("long")
    d = table(spark, sf, "embeddings").groupBy(F.concat(F.lit("m"), (F.col("vec_id") % 5).cast("string")).alias("model"))
    d = d.agg(F.sum(e).cast("double").alias("e"), F.floor(F.count("*") / 10).cast("double").alias("l"))
    return R.ladder(d, ["m0", "m1", "m2", "m3", "m4", "none"], "e", "l").withColumn("marginal", F.round("marginal", 4))


_BRANCH = "b AS (SELECT CAST(label AS BIGINT) AS seed, (vec_id % 5)::DOUBLE / 4 AS dose, sum(CAST(round(embedding[1]::DOUBLE * 1000) AS BIGINT))::DOUBLE AS v FROM embeddings GROUP BY ALL)"


def _branch_rows(spark, sf):
    v = F.sum(F.round(F.col("embedding")[0].cast("double") * 1000).cast("long")).cast("double").alias("v")
    return table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("seed"), ((F.col("vec_id") % 5).cast("double") / 4).alias("dose")).agg(v)


@query([], f"WITH {_BRANCH} SELECT seed, dose, v - max(CASE WHEN dose = 0 THEN v END) OVER (PARTITION BY seed) AS contrast FROM b QUALIFY dose <> 0")
def r15_branch_contrasts(spark, sf):
    return R.against_base(_branch_rows(spark, sf), "seed", "dose", "v")


@query([], f"WITH {_BRANCH}, g AS (SELECT s::BIGINT AS seed, d::DOUBLE / 4 AS dose FROM (SELECT unnest(range(12)) AS s) x, (SELECT unnest(range(5)) AS d) y) SELECT seed, dose, v IS NOT NULL AS done FROM g LEFT JOIN b USING (seed, dose)")
def r15_branch_grid(spark, sf):
    grid = R.branches(spark, list(range(12)), [i / 4 for i in range(5)])
    return F.broadcast(grid).join(_branch_rows(spark, sf), ["seed", "dose"], "left").select("seed", "dose", F.col("v").isNotNull().alias("done"))


@query([], "SELECT o_custkey, count(DISTINCT o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def r15_uneven_branches(spark, sf):
    return R.uneven(table(spark, sf, "orders"), "o_custkey", ["o_orderstatus"])
