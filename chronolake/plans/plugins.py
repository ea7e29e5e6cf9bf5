"""Queries of pluggable models and tools, of studies made up for tests, and of contracts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chronolake.functions import text as X
from chronolake.operators import models as M
from chronolake.operators import stats as R
from chronolake.operators import trading as T
from chronolake.operators import windows as W
from chronolake.plans.book import query
from chronolake.plans.views import table, view
from chronolake.sources import contracts as K
from chronolake.sources import readers as Rd
from chronolake.sources import sinks as Sk

r6 = lambda c: F.round(c, 6)


def _times(words: tuple[str, ...]) -> str:
    return " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words)


_FOUND = f"w AS (SELECT doc_id, {_times(('gain', 'beat', 'strong', 'the'))} AS a, {_times(('loss', 'miss', 'weak', 'and'))} AS b FROM (SELECT doc_id, lower(left(text, 512)) AS t FROM documents))"


@query([], f"WITH {_FOUND} SELECT doc_id, CASE WHEN a = b THEN 'neutral' WHEN a > b THEN 'positive' ELSE 'negative' END AS label, round(CASE WHEN a = b THEN 0.5::DOUBLE ELSE greatest(a, b)::DOUBLE / (a + b) END, 6) AS score FROM w")
def u1_classified_posts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.classified(F.col("text")).alias("c")).select("doc_id", "c.label", r6("c.score").alias("score"))


@query([], "SELECT doc_id FROM documents WHERE least(1.0, length(left(text, 512)) / 512.0) >= 0.6")
def u2_subject_filter(spark, sf):
    return M.on_subject(table(spark, sf, "documents"), "text", lambda texts: [len(t) / 512 for t in texts]).select("doc_id")


@query([], "SELECT doc_id FROM documents")
def u2_failing_model_passes(spark, sf):
    return M.on_subject(table(spark, sf, "documents"), "text", lambda texts: 1 / 0).select("doc_id")


@query([], """WITH g AS (SELECT CAST(vec_id // 4 AS BIGINT) AS event_id, CAST(sum(CASE WHEN vec_id % 4 < 3 THEN 1 ELSE 0 END) AS INT) AS n, """ + ", ".join(f"sum(CASE WHEN vec_id % 4 < 3 THEN embedding[{i}]::DOUBLE ELSE 0 END) AS s{i}" for i in (1, 2, 3)) + """ FROM embeddings GROUP BY 1), m AS (SELECT event_id, s1 / greatest(n, 1) AS a, s2 / greatest(n, 1) AS b, s3 / greatest(n, 1) AS c FROM g)
SELECT event_id, round(a, 6) AS v0, round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) AS p0, round(exp(c) / (exp(a) + exp(b) + exp(c)), 6) AS p2 FROM m""")
def u3_u4_encoder_pooling(spark, sf):
    """Mean pooling over the tokens that the mask keeps, then a head of three classes."""
    e = table(spark, sf, "embeddings")
    g = e.groupBy(F.floor(F.col("vec_id") / 4).alias("event_id")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("r"))  # four rows an event
    v, m = F.transform("r", lambda x: x["embedding"]), F.transform("r", lambda x: (x["vec_id"] % 4 < 3).cast("int"))
    d = g.select("event_id", M.pooled(v, m).alias("h")).withColumn("p", M.softmax(F.slice("h", 1, 3)))
    return d.select("event_id", r6(F.col("h")[0]).alias("v0"), r6(F.col("p")[0]).alias("p0"), r6(F.col("p")[2]).alias("p2"))


def _nest(t: str, names: tuple[str, ...], to: str) -> str:
    for n in names:
        t = f"replace({t}, '{n}', '{to}')"
    return t


_L1 = _nest("t", ("Federal Reserve", "Federal Open Market Committee", "FOMC", "Fed", "Committee"), "Central Bank A")
_L2 = _nest(_L1, ("Powell", "Yellen", "Bernanke", "Greenspan"), "Official A")
_L3 = _nest(_L2, tuple(str(y) for y in range(1996, 2026)), "[YEAR]")
_PROBS = """n AS (SELECT *, (CAST('0x' || left(sha256('42:scalar:' || x), 2) AS INTEGER) - 128) / 128.0::DOUBLE AS noise FROM lv),
z AS (SELECT *, CAST(regexp_matches(lower(x), 'inflation|raise|tighten|hike|elevated|robust|strong') AS DOUBLE) - CAST(regexp_matches(lower(x), 'slowdown|cut|recession|downside|accommodate|weak|lower') AS DOUBLE) + CASE WHEN abs(noise) > 0.75 THEN noise * 0.4 ELSE 0 END AS base,
  CASE WHEN regexp_matches(x, '199|200|201|202|Federal Reserve|FOMC|Committee|Powell|Yellen|Fed') AND NOT regexp_matches(x, 'Central Bank|\\[YEAR\\]|Official') THEN 0.75::DOUBLE * f ELSE 0 END AS recall FROM n),
s AS (SELECT doc_id, lvl, 'clean' AS m, base AS s FROM z UNION ALL SELECT doc_id, lvl, 'leak', base + recall FROM z), e AS (SELECT *, exp(-1.5 * s) AS a, exp(0.2 - 0.5 * abs(s)) AS b, exp(1.5 * s) AS c FROM s),
p AS (SELECT doc_id, lvl, m, [greatest(a / (a + b + c), 1e-9), greatest(b / (a + b + c), 1e-9), greatest(c / (a + b + c), 1e-9)] AS q FROM e), u AS (SELECT doc_id, lvl, m, list_transform(q, lambda v: v / list_sum(q)) AS q FROM p),
j AS (SELECT w.doc_id, w.m, w.lvl, """ + "(" + " + ".join(f"o.q[{i}] * ln(2 * o.q[{i}] / (o.q[{i}] + w.q[{i}])) + w.q[{i}] * ln(2 * w.q[{i}] / (o.q[{i}] + w.q[{i}]))" for i in (1, 2, 3)) + ") / 2 AS js FROM u w JOIN u o ON o.doc_id = w.doc_id AND o.m = w.m AND o.lvl = 0 WHERE w.lvl > 0)"


@query([], f"""WITH d AS (SELECT doc_id, 'In 2019 the FOMC and Powell said: ' || text AS t, doc_id % 3 - 1 AS f FROM documents), lv AS (SELECT doc_id, f, 0 AS lvl, t AS x FROM d UNION ALL SELECT doc_id, f, 1, {_L1} FROM d UNION ALL SELECT doc_id, f, 2, {_L2} FROM d UNION ALL SELECT doc_id, f, 3, {_L3} FROM d), {_PROBS},
v AS (SELECT doc_id, m, max(js) FILTER (lvl = 1) AS l1, max(js) FILTER (lvl = 2) AS l2, max(js) FILTER (lvl = 3) AS l3 FROM j GROUP BY doc_id, m), k AS (SELECT doc_id, m, l1 AS entity, greatest(0, l2 - l1) AS person, greatest(0, l3 - l2) AS date, l3 AS total FROM v)
SELECT l.doc_id, round(l.entity, 5) AS entity, round(l.person, 5) AS person, round(l.date, 5) AS date, round(l.total, 5) AS total, round(l.total - c.total, 5) AS behaviour FROM k l JOIN k c ON c.doc_id = l.doc_id AND l.m = 'leak' AND c.m = 'clean'""")
def u5_f13_r8_masking_sensitivity(spark, sf):
    """How far masking moves a leaking model's predictions, and by how much more than a clean one's."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("In 2019 the FOMC and Powell said: "), "text").alias("t"), (F.col("doc_id") % 3 - 1).alias("f"))
    leak, clean = M.masking_sensitivity(M.HashedTwin(0.5), F.col("t"), F.col("f")), M.masking_sensitivity(M.HashedTwin(), F.col("t"))
    d = d.select("doc_id", leak.alias("l"), clean.alias("c"))
    return d.select("doc_id", *[F.round(f"l.{x}", 5).alias(x) for x in ("entity", "person", "date", "total")], F.round(F.col("l.total") - F.col("c.total"), 5).alias("behaviour"))


_BYTE = "(CAST('0x' || substr(sha256('42:{c}:' || t), {at}, 2) AS INTEGER) - 128) / 128.0::DOUBLE"


@query([], "WITH q AS (SELECT item_id, 'query: ' || text AS t FROM benchmark), v AS (SELECT item_id, [" + ", ".join(_BYTE.format(c=0, at=2 * i + 1) for i in range(32)) + "] AS v FROM q) SELECT item_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS v0, round(v[32] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS v31 FROM v")
def x21_query_vectors(spark, sf):
    v = table(spark, sf, "benchmark").select("item_id", M.query_vector(F.col("text"), 32).alias("v"))
    return v.select("item_id", r6(F.col("v")[0]).alias("v0"), r6(F.col("v")[31]).alias("v31"))


@query(["bars"], "SELECT ticker, count(*) AS bars, round(max(close), 4) AS highest FROM bars WHERE ticker = 7 AND d BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' GROUP BY ticker")
def u8_y18_s40_y11_tools(spark, sf):
    """A tool that answers from what was fetched ahead for one ticker; nothing is kept afterwards."""
    cache = Rd.Prefetch()
    cache.fill(7, {"bars": view(spark, sf, "bars"), "other": view(spark, sf, "bars")}, ["bars"], "d", "1995-01-01", "1995-12-31")
    tools = M.Tools({"bars": cache.read(7, "bars")})
    tools.add("get_stock_data", lambda store, start, end: store["bars"].where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    assert cache.read(8, "bars") is None and cache.read(7, "other") is None
    out = tools.call("get_stock_data", start="1995-01-01", end="1995-12-31").groupBy("ticker").agg(F.count("*").alias("bars"), F.round(F.max("close"), 4).alias("highest"))
    cache.clear()
    return out


@query([], "SELECT o_custkey, string_agg('[' || n || '] 10-K ' || CAST(o_orderdate AS DATE) || chr(10) || o_orderpriority, chr(10) || chr(10) ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 4 GROUP BY o_custkey")
def u9_u10_search_text(spark, sf):
    """What a search tool hands to an agent: four hits as numbered passages."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = table(spark, sf, "orders").withColumn("n", rank).where("n <= 4")
    return M.hits_text(hits, "o_custkey", "n", F.lit("10-K"), F.col("o_orderdate").cast("date"), F.col("o_orderpriority"))


@query([], """WITH r AS (SELECT *, CASE event_type WHEN 'view' THEN 'get_news' WHEN 'click' THEN 'get_stock_data' ELSE 'get_fundamentals' END AS method FROM events)
SELECT method, CASE method WHEN 'get_news' THEN 'news' WHEN 'get_stock_data' THEN 'prices' ELSE 'fundamentals' END AS category, CASE method WHEN 'get_news' THEN 'b' WHEN 'get_stock_data' THEN 'a' ELSE 'c' END AS vendor, count(*) AS requests FROM r GROUP BY method""")
def y13_y14_s41_routing(spark, sf):
    """Requests by the category and the vendor that answer their method."""
    reg = Rd.Registry({"news": ["get_news"], "prices": ["get_stock_data"], "fundamentals": ["get_fundamentals"]}, {"get_fundamentals": "c"}, {"news": "b", "fundamentals": "b"}, "a")
    routes = spark.createDataFrame([(n, reg.category(n), reg.vendor(n)) for n in ("get_news", "get_stock_data", "get_fundamentals")], "method string, category string, vendor string")
    method = F.when(F.col("event_type") == "view", "get_news").when(F.col("event_type") == "click", "get_stock_data").otherwise("get_fundamentals")
    asked = table(spark, sf, "events").groupBy(method.alias("method")).agg(F.count("*").alias("requests"))
    return asked.join(F.broadcast(routes), "method")  # a method a row


@query([], """WITH r AS (SELECT o_orderkey AS run, o_orderkey % 3 AS k, o_orderkey % 5 AS j, o_orderkey % 7 AS m FROM orders),
f AS (SELECT run, 'contract' AS check_, unnest(CASE WHEN k = 0 THEN ['bootstrap.n', 'seeds'] WHEN k = 1 THEN ['seeds'] ELSE [] END) AS finding FROM r
UNION ALL SELECT run, 'authorization', unnest(CASE WHEN j = 0 THEN ['source_tree_sha256: missing'] ELSE [] END || CASE WHEN k < 2 THEN ['seeds: not what runs'] ELSE [] END) FROM r
UNION ALL SELECT run, 'controlled', 'a/run.py' FROM r WHERE m = 0 UNION ALL SELECT run, 'settings', unnest(['probe.alpha', 'probe.n_splits']) FROM r WHERE m = 1) SELECT * FROM f""")
def c10_c11_c13_t7_s39_contracts(spark, sf):
    """What keeps each run from starting: registered and actual settings that differ, bindings that are missing or wrong, modified files, bad settings.

    A run's settings are JSON that was written to files and read back.
    """
    at, i = Sk.folder(spark, "settings"), F.col("o_orderkey")
    k, j, m = i % 3, i % 5, i % 7
    seeds = F.when(k < 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    told = F.struct(
        F.struct(seeds.alias("seeds"), F.struct(F.when(k == 0, 500).otherwise(1000).alias("n"), F.lit(0.05).alias("p")).alias("bootstrap")).alias("runs"),
        F.struct(*(F.lit("x").alias(b) for b in K.BINDINGS if b not in ("seeds", "source_tree_sha256")), seeds.alias("seeds"), F.when(j == 0, "").otherwise("x").alias("source_tree_sha256")).alias("bound"),
        F.when(m == 0, F.array(F.lit("a\\run.py"), F.lit("b.py"))).otherwise(F.array()).alias("modified"),
        F.struct(F.struct(F.when(m == 1, 1).otherwise(5).alias("n_splits"), F.when(m == 1, 0).otherwise(1).alias("alpha")).alias("probe")).alias("settings"),
    )
    table(spark, sf, "orders").select(i.alias("run"), F.to_json(told).alias("told")).write.json(at)
    rows = spark.read.schema("run BIGINT, told STRING").json(at)
    found = K.findings(F.col("told"), {"seeds": [1, 2], "bootstrap": {"n": 1000, "p": 0.05}}, {"seeds": [1, 2]}, ["a/run.py"], ("probe.alpha", "probe.n_splits"))
    return rows.select("run", F.explode(found).alias("f")).select("run", F.col("f.check").alias("check_"), "f.finding")


@query([], "SELECT 'm' || (vec_id % 5) AS model, sum(CAST(round(embedding[1]::DOUBLE * 1000) AS BIGINT))::DOUBLE AS e FROM embeddings GROUP BY 1 UNION ALL SELECT 'none', NULL")
def k18_y57_twin_outputs(spark, sf):
    """A ladder of models written as CSV and as JSON records, both of which say the same."""
    e = F.sum(F.round(F.col("embedding")[0].cast("double") * 1000).cast("long")).cast("double").alias("e")
    d = table(spark, sf, "embeddings").groupBy(F.concat(F.lit("m"), (F.col("vec_id") % 5).cast("string")).alias("model")).agg(e, F.count("*").cast("double").alias("l"))
    at = Sk.folder(spark, "twins")
    steps = R.ladder(d, ["m0", "m1", "m2", "m3", "m4", "none"], "e", "l")
    Sk.plain_csv(steps, f"{at}/csv")
    Sk.json_export(steps, f"{at}/json")
    a = spark.read.option("header", True).schema("model STRING, rung INT, e DOUBLE, l DOUBLE, marginal DOUBLE").csv(f"{at}/csv").select("model", "e")
    b = spark.read.schema("model STRING, e DOUBLE").json(f"{at}/json").select("model", F.col("e").alias("f"))
    return a.join(b, "model").where(F.col("e").eqNullSafe(F.col("f"))).select("model", "e")


@query(["signals"], "SELECT ticker, count(*) AS n, round(sum(CASE WHEN signal IN ('BUY', 'OVERWEIGHT') THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS bullish FROM signals GROUP BY ticker")
def k17_report_rows(spark, sf):
    """What heads a report: calls and the share of bullish ones."""
    up = F.col("signal").isin(*W.UP).cast("double")
    return view(spark, sf, "signals").groupBy("ticker").agg(F.count("*").alias("n"), r6(F.avg(up)).alias("bullish"))


@query([], "SELECT doc_id, 'a' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' …' END AS head, doc_id % 2 = 0 AS whole FROM documents")
def x12_heads(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, "a").otherwise("ab")
    return table(spark, sf, "documents").select("doc_id", X.head(t, 1).alias("head"), (X.head(t, 1) == t).alias("whole"))


@query(["bars"], "SELECT ticker, d, round(close, 4) AS close FROM (SELECT ticker, d, close, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS n FROM bars WHERE d <= DATE '1996-06-28') WHERE n <= 5")
def y18_recent_prices(spark, sf):
    from chronolake.operators.joins import latest

    b = view(spark, sf, "bars").where("d <= DATE '1996-06-28'")
    return latest(b, ["ticker"], [F.desc("d")], 5).select("ticker", "d", F.round("close", 4).alias("close"))


@query([], f"SELECT s_suppkey, indicator FROM (SELECT s_suppkey, unnest([{', '.join(repr(n) for n in T.INDICATORS)}]) AS indicator, unnest(range({len(T.INDICATORS)})) AS i FROM supplier) WHERE (i + s_suppkey) % 3 > 0")
def w1_indicator_names(spark, sf):
    """The known names in what each supplier asks for, a list with blanks, capitals and names that nobody knows."""
    asked = F.array_join(F.array(*(F.when((i + F.col("s_suppkey")) % 3 > 0, F.lit(f" {n.upper()}")).otherwise(F.lit(f"no_{n}")) for i, n in enumerate(T.INDICATORS))), ",")
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(T.named_column(asked)).alias("indicator"))
