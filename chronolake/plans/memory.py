"""Queries of the triple store's writes and of memory rooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.functions import scalars as S
from chronolake.functions import text as X
from chronolake.operators import graph as G
from chronolake.operators import vectors as V
from chronolake.plans.book import query
from chronolake.plans.views import table, view

_EID = "replace(replace(lower({}), ' ', '_'), '''', '')"


@query(["entities"], f"""WITH n AS (SELECT {_EID.format('name')} AS id, name, type, 0::BIGINT AS version FROM entities UNION ALL SELECT {_EID.format('name')}, upper(name), 'changed', c_custkey FROM (SELECT c_name AS name, c_custkey FROM customer WHERE c_custkey % 3 = 0))
SELECT id, arg_max(name, (version, name)) AS name, arg_max(type, (version, name)) AS type, max(version) AS version FROM n GROUP BY id""")
def m1_upsert_entities(spark, sf):
    e = view(spark, sf, "entities")
    old = e.select(X.entity_id(F.col("name")).alias("id"), "name", "type", F.lit(0).cast("long").alias("version"))
    new = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.upper("c_name").alias("name"), F.lit("changed").alias("type"), F.col("c_custkey").alias("version"))
    return G.upsert_entities(old, new)


_NEW = "nw AS (SELECT event_id AS seq, 'User ' || user_id AS subject, 'Did It' AS predicate, event_type AS object, CAST(ts AS DATE) AS valid_from, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS valid_to FROM events)"
_IDS = f"ids AS (SELECT seq, {_EID.format('subject')} AS subject, 'did_it' AS predicate, {_EID.format('object')} AS object, valid_from, valid_to FROM nw)"


def _events(spark, sf):
    """(entities, triples, new facts): what users did, the first ten users' views open already."""
    ev = table(spark, sf, "events")
    new = ev.select(F.col("event_id").alias("seq"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("subject"), F.lit("Did It").alias("predicate"), F.col("event_type").alias("object"), F.col("ts").cast("date").alias("valid_from"), F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("date")).alias("valid_to"))
    entities = spark.createDataFrame([("view", "View", "action", 0)], "id string, name string, type string, version long")
    have = ev.where("user_id % 10 = 0").select("user_id").distinct()
    none = F.lit(None).cast("date")
    triples = have.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("subject"), F.lit("did_it").alias("predicate"), F.lit("view").alias("object"), none.alias("valid_from"), none.alias("valid_to"))
    return entities, triples, new


@query([], f"""WITH {_NEW}, {_IDS}, old AS (SELECT DISTINCT 'user_' || user_id AS subject FROM events WHERE user_id % 10 = 0),
b AS (SELECT *, max(CAST(valid_to IS NULL AS INT)) OVER (PARTITION BY subject, predicate, object ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ids)
SELECT subject, predicate, object, valid_from, valid_to FROM b WHERE coalesce(before, 0) = 0 AND NOT (object = 'view' AND subject IN (SELECT subject FROM old)) UNION ALL SELECT subject, 'did_it', 'view', NULL, NULL FROM old""")
def m2_insert_triples(spark, sf):
    return G.insert_triples(*_events(spark, sf))[1]


@query([], f"""WITH {_NEW}, e AS (SELECT seq, 0 AS side, subject AS name FROM nw UNION ALL SELECT seq, 1, object FROM nw)
SELECT 'view' AS id, 'View' AS name, 'action' AS type UNION ALL SELECT {_EID.format('name')}, arg_min(name, (seq, side)), 'unknown' FROM e WHERE {_EID.format('name')} <> 'view' GROUP BY 1""")
def m2_created_entities(spark, sf):
    """Ends of inserted facts become entities under their first name; ones that are there keep theirs."""
    return G.insert_triples(*_events(spark, sf))[0].select("id", "name", "type")


@query([], """WITH p AS (SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'ann lee' END AS parent, CASE WHEN c_custkey % 3 = 0 THEN 'bOB' ELSE '' END AS partner, CASE c_custkey % 4 WHEN 0 THEN 'daughter' WHEN 1 THEN 'husband' ELSE '' END AS rel, DATE '1990-01-01' + CAST(c_custkey AS INT) AS b, c_custkey FROM customer)
SELECT name AS subject, 'child_of' AS predicate, 'Ann lee' AS object, CAST(b AS DATE) AS valid_from FROM p WHERE parent IS NOT NULL UNION ALL SELECT name, 'married_to', 'Bob', NULL FROM p WHERE partner <> '' UNION ALL SELECT name, 'is_child_of', CASE WHEN parent IS NOT NULL THEN 'Ann lee' ELSE name END, CAST(b AS DATE) FROM p WHERE rel = 'daughter'
UNION ALL SELECT name, 'is_partner_of', upper(left(partner, 1)) || lower(substr(partner, 2)), NULL FROM p WHERE rel = 'husband' UNION ALL SELECT name, 'loves', 'Chess', DATE '2025-01-01' FROM p WHERE c_custkey % 5 = 0""")
def m4_seed_facts(spark, sf):
    k = F.col("c_custkey")
    people = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.when(k % 2 == 0, "ann lee").alias("parent"), F.when(k % 3 == 0, "bOB").otherwise("").alias("partner"),
        F.when(k % 4 == 0, "daughter").when(k % 4 == 1, "husband").otherwise("").alias("relationship"), F.date_add(F.lit("1990-01-01").cast("date"), k.cast("int")).alias("birthday"),
        F.when(k % 5 == 0, F.array(F.lit("chess"))).otherwise(F.array().cast("array<string>")).alias("interests"),
    )
    return G.facts_of(people)


@query(["signals"], """SELECT 'T' || ticker AS t, 't' || ticker || '_' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS subject, arg_min(actual_return, seq) AS value, CAST(ts AS DATE) AS valid_to FROM signals GROUP BY ticker, CAST(ts AS DATE) HAVING ticker % 7 > 0""")
def m5_y27_annotate_returns(spark, sf):
    """One return a ticker and day; tickers divisible by 7 have theirs already."""
    s = view(spark, sf, "signals").withColumn("day", F.col("ts").cast("date"))
    rows = s.select(F.concat(F.lit("T"), F.col("ticker").cast("string")).alias("ticker"), "day", "seq", "actual_return", (F.col("ticker") % 7).alias("k"))
    have = rows.where("k = 0").select(G.day_subject(F.col("ticker"), F.col("day")).alias("subject"), F.lit("actual_return").alias("predicate"))
    new = G.annotate_returns(have, rows)
    return new.select(F.concat(F.lit("T"), F.regexp_extract("subject", "^t([0-9]+)_", 1)).alias("t"), "subject", F.col("object").cast("double").alias("value"), "valid_to")


@query(["bars"], "SELECT a.ticker, a.day, b.close AS value FROM (SELECT ticker, CAST(d + CAST(ticker % 3 AS INT) AS DATE) AS day FROM bars) a LEFT JOIN bars b ON b.ticker = a.ticker AND b.d = a.day")
def m6_m6a_m6b_prices(spark, sf):
    """Closes stored as facts, and looked up by exact day."""
    bars = view(spark, sf, "bars")
    facts = G.price_facts(bars.select(F.col("ticker").cast("string").alias("ticker"), F.col("d").alias("day"), "close"))
    asked = bars.select(F.col("ticker").cast("string").alias("ticker"), F.date_add("d", (F.col("ticker") % 3).cast("int")).alias("day"))
    return G.lookup(asked, facts, "close_price").select(F.col("ticker").cast("bigint").alias("ticker"), "day", "value")


@query([], "SELECT doc_id, 'reflections_' || role AS room, CAST(DATE '2024-01-02' + CAST(doc_id % 30 AS INT) AS DATE) AS valid_from, 'Situation (digest):' || chr(10) || left(text, 500) || chr(10) || chr(10) || 'Lesson:' || chr(10) || source AS content FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'bull' WHEN 1 THEN 'trader' WHEN 2 THEN 'invest_judge' ELSE 'stranger' END AS role FROM documents) WHERE role <> 'stranger'")
def m8_reflections(spark, sf):
    k = F.col("doc_id")
    role = F.when(k % 4 == 0, "bull").when(k % 4 == 1, "trader").when(k % 4 == 2, "invest_judge").otherwise("stranger")
    rows = table(spark, sf, "documents").select(k.cast("string").alias("ticker"), role.alias("role"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("day"), F.substring("text", 1, 500).alias("situation"), F.col("source").alias("lesson"))
    return G.reflections(rows).select(F.col("wing").cast("bigint").alias("doc_id"), "room", "valid_from", "content")


@query([], "SELECT doc_id, room, valid_from, CASE room WHEN 'market' THEN CAST(valid_from + 7 AS DATE) WHEN 'fundamentals' THEN CAST(valid_from + 365 AS DATE) WHEN 'news' THEN CAST(valid_from + 3 AS DATE) ELSE CAST(valid_from + 3 AS DATE) END AS expires_at FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sentiment' WHEN 1 THEN 'news' WHEN 2 THEN 'market' ELSE 'fundamentals' END AS room, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS valid_from, text FROM documents) WHERE trim(text, ' ') <> '' AND valid_from <= DATE '2024-01-20' AND expires_at >= DATE '2024-01-20'")
def m7_y24_y25_visible_summaries(spark, sf):
    """Summaries of four rooms that are valid on the bound day."""
    k = F.col("doc_id")
    room = F.when(k % 4 == 0, "sentiment").when(k % 4 == 1, "news").when(k % 4 == 2, "market").otherwise("fundamentals")
    rows = table(spark, sf, "documents").select(k.cast("string").alias("ticker"), room.alias("room"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("day"), F.col("text").alias("content"))
    seen = G.visible(G.summaries(rows), F.lit("2024-01-20").cast("date"))
    return seen.select(F.col("wing").cast("bigint").alias("doc_id"), "room", "valid_from", "expires_at")


_HITS = """WITH d AS (SELECT vec_id AS id, label AS wing, CAST(DATE '2024-01-01' + CAST(vec_id % 29 AS INT) AS DATE) AS valid_from, CAST(DATE '2024-01-01' + CAST(vec_id % 29 + {days} AS INT) AS DATE) AS until, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 5 = {room}),
q AS (SELECT label AS qid, embedding::DOUBLE[] AS e FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT qid, id, round(list_dot_product(d.e, q.e) / sqrt(list_dot_product(d.e, d.e) * list_dot_product(q.e, q.e)), 9) AS sim FROM d JOIN q ON d.wing = q.qid AND valid_from <= DATE '2024-01-20' AND until >= DATE '2024-01-20'),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS INTEGER) AS rank FROM s) SELECT qid, rank, id, round(sim, 6) AS sim FROM r WHERE rank <= {k}{more}"""


def _hits(spark, sf, room, days, k, threshold):
    e = table(spark, sf, "embeddings")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 29).cast("int"))
    rows = e.where(F.col("vec_id") % 5 == room).select(F.col("vec_id").alias("id"), F.col("label").alias("wing"), start.alias("valid_from"), F.date_add(start, days).alias("expires_at"), "embedding")
    ask = e.groupBy(F.col("label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("q"))
    at = F.lit("2024-01-20").cast("date")
    own = (F.col("wing") == F.col("qid")) & (F.col("valid_from") <= at) & (F.col("expires_at") >= at)
    return V.search(rows, ask, k, own, threshold).select("qid", "rank", "id", F.round("sim", 6).alias("sim"))


@query([], _HITS.format(days=3, room=0, k=3, more=" AND sim >= 0.0"))
def m9a_similar_sentiment(spark, sf):
    """A ticker's own sentiment rows that are valid now, the three nearest, and of these what is near enough."""
    return _hits(spark, sf, 0, 3, 3, 0.0)


@query([], _HITS.format(days=365, room=3, k=4, more=""))
def m11_search_calls(spark, sf):
    """A company's own calls of the last year, the four nearest chunks."""
    return _hits(spark, sf, 3, 365, 4, None)


@query([], "SELECT doc_id, 'drawer_' || lower(source) || '_news_' || left(sha256(lower(source) || '_news_2024-01-0' || (doc_id % 9 + 1)), 24) AS id, CASE WHEN doc_id % 3 = 0 THEN 'News: ' || left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 500) || chr(10) || 'Market: x' ELSE 'Market: x' END AS digest FROM documents")
def f7_x6_drawers(spark, sf):
    """Ids of drawers, and the digest that is searched: sections without text are left out."""
    k = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 9).cast("int"))
    section = X.digest({"News": F.when(k % 3 == 0, F.col("text")).otherwise("  "), "Market": F.lit(" x "), "Sentiment": F.lit(None).cast("string")})
    return table(spark, sf, "documents").select("doc_id", S.drawer_id(F.lower("source"), F.lit("news"), day).alias("id"), section.alias("digest"))
