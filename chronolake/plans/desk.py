"""Queries of filings, sentiment, routing and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolake.functions import scalars as S
from chronolake.operators import corpus as C
from chronolake.operators import graph as G
from chronolake.operators import joins as J
from chronolake.operators import logs as L
from chronolake.operators import stats as R
from chronolake.operators import vectors as V
from chronolake.plans.book import query
from chronolake.plans.views import table, view
from chronolake.sources import contracts as K
from chronolake.sources import readers as Rd
from chronolake.sources import sinks as Sk

_FIL = "fl AS (SELECT o_custkey AS ticker, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form, CAST(date_trunc('month', o_orderdate) AS DATE) AS filed, o_orderkey AS seq, o_orderkey AS accession FROM orders)"


def _filings(spark, sf):
    s = F.col("o_orderstatus")
    form = F.when(s == "F", "10-K").when(s == "O", "10-Q").otherwise("8-K")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), form.alias("form"), F.trunc("o_orderdate", "month").alias("filed"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("accession"))


@query([], f"WITH {_FIL} SELECT ticker, accession, filed, form FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filed DESC, seq) AS n FROM fl WHERE form IN ('10-K', '10-Q') AND filed <= DATE '1996-06-30') WHERE n = 1")
def j7_latest_filing(spark, sf):
    return J.latest_filings(_filings(spark, sf), "1996-06-30", ("10-K", "10-Q")).select("ticker", "accession", "filed", "form")


@query([], f"""WITH {_FIL}, b AS (SELECT *, row_number() OVER (PARTITION BY ticker, form ORDER BY filed DESC, seq) AS n FROM fl WHERE form IN ('10-K', '10-Q') AND filed <= DATE '1995-06-30')
SELECT ticker, accession, form FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY form) AS k FROM b WHERE n = 1) WHERE k = 1 AND accession % 3 > 0""")
def m10_ensure_ingested(spark, sf):
    """The latest 10-K, the latest 10-Q only of companies without one, if it isn't indexed yet."""
    have = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("accession"))
    return J.to_ingest(_filings(spark, sf), "1995-06-30", have).select("ticker", "accession", "form")


_KEPT = "kp AS (SELECT * FROM (SELECT *, max(CAST(NOT (label = 'neutral' AND conf < 0.65::DOUBLE) AS INT)) OVER (PARTITION BY source) AS sure FROM posts) WHERE sure = 0 OR NOT (label = 'neutral' AND conf < 0.65::DOUBLE))"


def _kept(spark, sf):
    return L.sentiment(view(spark, sf, "posts"), ["source"])


@query(["posts"], f"WITH {_KEPT} SELECT source, label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM kp GROUP BY source, label")
def a8_sentiment_distribution(spark, sf):
    n = _kept(spark, sf).groupBy("source", "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query(["posts"], f"WITH {_KEPT} SELECT source, label, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source, label ORDER BY score * conf DESC, id) AS INTEGER) AS rank FROM kp WHERE label <> 'neutral') WHERE rank <= 5")
def o4_top_posts(spark, sf):
    """The five posts of each direction with the most votes times certainty; a limit is what it is for."""
    w = Window.partitionBy("source", "label").orderBy(F.desc(F.col("score") * F.col("conf")), "id")
    return _kept(spark, sf).where("label <> 'neutral'").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("source", "label", "id", "rank")


@query(["posts"], "SELECT source, left(arg_max(text, (score, -id)), 280) AS sample, max(score) AS score FROM posts GROUP BY source")
def o5_best_post(spark, sf):
    best = view(spark, sf, "posts").groupBy("source").agg(F.max_by(F.substring("text", 1, 280), F.struct("score", -F.col("id"))).alias("sample"), F.max("score").alias("score"))
    return best.select("source", "sample", "score")


@query([], """SELECT conv_id, turn, CASE WHEN turn < 2 THEN 'Judge Researcher' ELSE 'Research Manager' END AS debate, CASE WHEN turn >= 6 THEN 'Portfolio Manager' WHEN turn % 3 = 0 THEN 'Conservative Analyst' WHEN turn % 3 = 1 THEN 'Neutral Analyst' ELSE 'Aggressive Analyst' END AS risk FROM conversations""")
def z2_routing(spark, sf):
    """Who comes next in both debates."""
    k = F.col("turn") % 3
    speaker = F.when(k == 0, "Aggressive: x").when(k == 1, "Conservative: y").otherwise("Neutral: z")
    return table(spark, sf, "conversations").select("conv_id", "turn", L.after_researchers(F.col("turn"), 2).alias("debate"), L.after_risk_turn(F.col("turn"), speaker, 2).alias("risk"))


_DIMS = "SELECT event_id, i, round(avg(x), 6) AS mean, round(max(x), 6) AS most, round(arg_max(x, vec_id), 6) AS last FROM (SELECT CAST(vec_id // 4 AS BIGINT) AS event_id, vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY event_id, i"


@query([], _DIMS)
def a12_event_vectors(spark, sf):
    """Event vectors by all three rules."""
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("event_id"), "vec_id", "embedding")
    by = lambda rule, name: R.event_vectors(rows, "event_id", "vec_id", "embedding", rule).select("event_id", F.posexplode("embedding").alias("i", name)).withColumn(name, F.round(F.col(name).cast("double"), 6))
    out = by("mean", "mean").join(by("max", "most"), ["event_id", "i"]).join(by("last", "last"), ["event_id", "i"])
    return out.withColumn("i", F.col("i").cast("long"))


@query(["samples"], "SELECT document_type, count(*) AS n, min(available_date) AS first, max(available_date) AS last, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'))) AS BIGINT) AS words FROM samples GROUP BY document_type")
def a11_temporal_range(spark, sf):
    s = view(spark, sf, "samples")
    return s.groupBy("document_type").agg(F.count("*").alias("n"), F.min("available_date").alias("first"), F.max("available_date").alias("last"), F.sum(C.word_count(F.col("text"))).alias("words"))


@query([], "SELECT event_id, CASE event_id % 3 WHEN 0 THEN s <= TIMESTAMP '2024-01-10 12:00:00' WHEN 1 THEN s - INTERVAL 2 HOUR <= TIMESTAMP '2024-01-10 12:00:00' ELSE false END AS available FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events)")
def p12_available_instants(spark, sf):
    """Availability as instants: offsets count, a time without one is never available."""
    t, k = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id") % 3
    iso = F.when(k == 0, F.concat(t, F.lit("Z"))).when(k == 1, F.concat(t, F.lit("+02:00"))).otherwise(t)
    as_of = S.iso_utc(F.lit("2024-01-10T13:00:00+01:00"))
    return table(spark, sf, "events").select("event_id", F.coalesce(S.iso_utc(iso) <= as_of, F.lit(False)).alias("available"))


@query([], "SELECT source, count(*) FILTER (doc_id % 4 = 0) AS bad FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 4 = 0) > 0")
def p18_allowed_qualities(spark, sf):
    """Samples whose availability the settings don't allow, by source."""
    quality = F.when(F.col("doc_id") % 4 == 0, "heuristic").otherwise("exact")
    d = table(spark, sf, "documents").withColumn("availability_quality", quality)
    K.allowed(d.where("doc_id % 4 > 0"), {"pit": {"allowed_availability_qualities": ["exact"]}})
    return d.where("availability_quality <> 'exact'").groupBy("source").agg(F.count("*").alias("bad"))


_PROFILE = "SELECT source, CAST(sum(n) AS BIGINT) AS tokens, round(count(DISTINCT w)::DOUBLE / sum(n), 6) AS diversity FROM (SELECT source, w, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS w FROM documents) GROUP BY source, w) GROUP BY source"


@query([], _PROFILE)
def a29_token_diversity(spark, sf):
    """Distinct tokens over all tokens; occurrences are counted by token first."""
    w = table(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("w"))
    n = w.groupBy("source", "w").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.sum("n").alias("tokens"), F.round(F.count("*") / F.sum("n"), 6).alias("diversity"))


_REFL = """WITH d AS (SELECT vec_id AS id, label AS wing, CAST(DATE '2024-01-01' + CAST(vec_id % 29 + 1 AS INT) AS DATE) AS valid_from, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 5 = 4), q AS (SELECT label AS qid, embedding::DOUBLE[] AS e FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT qid, id, round(list_dot_product(d.e, q.e) / sqrt(list_dot_product(d.e, d.e) * list_dot_product(q.e, q.e)), 9) AS sim FROM d JOIN q ON d.wing = q.qid AND valid_from <= DATE '2024-01-20'), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS INTEGER) AS rank FROM s) SELECT qid, rank, id, round(sim, 3) AS similarity FROM r WHERE rank <= 2"""


@query([], _REFL)
def m9_reflections(spark, sf):
    """Two reflections of a ticker's own, seen from the day after they were written and for ever."""
    e = table(spark, sf, "embeddings")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 29 + 1).cast("int"))
    rows = e.where("vec_id % 5 = 4").select(F.col("vec_id").alias("id"), F.col("label").alias("wing"), start.alias("valid_from"), "embedding")
    ask = e.groupBy(F.col("label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("q"))
    own = (F.col("wing") == F.col("qid")) & (F.col("valid_from") <= F.lit("2024-01-20").cast("date"))
    return V.search(rows, ask, 2, own).select("qid", "rank", "id", F.round("sim", 3).alias("similarity"))


@query(["entities", "triples"], """SELECT 'entities' AS name, unnest(['id', 'name', 'type', 'properties', 'version']) AS field, unnest([count(id), count(name), count(type), 0, 0]) AS filled FROM entities
UNION ALL SELECT 'triples', unnest(['subject', 'predicate', 'object', 'valid_from', 'valid_to', 'confidence']), unnest([count(subject), count(predicate), count(object), count(valid_from), count(valid_to), 0]) FROM triples""")
def y29_store_schema(spark, sf):
    """The fields of the store's tables, and in how many rows each is filled once the graph is in them."""
    out = None
    for name, empty in zip(("entities", "triples"), G.empty_store(spark), strict=True):
        held = empty.unionByName(view(spark, sf, name).select(*[F.col(c).cast(t).alias(c) for c, t in empty.dtypes if c in view(spark, sf, name).columns]), allowMissingColumns=True)
        one = held.agg(*(F.count(c).alias(c) for c in empty.columns)).unpivot([], list(empty.columns), "field", "filled").select(F.lit(name).alias("name"), "field", "filled")
        out = one if out is None else out.unionByName(one)
    return out


@query([], "SELECT item_id, text FROM benchmark")
def s27_s33_c12_f11_locked_files(spark, sf):
    """A dataset is read only if its files are those of its manifest; the whole folder has one digest."""
    at = Sk.folder(spark, "locked")
    table(spark, sf, "benchmark").coalesce(1).write.json(at)
    manifest = {r.name: r.sha256 for r in Rd.digests(spark, at).where("name LIKE '%.json'").collect()}  # one file
    name = next(iter(manifest))
    assert Rd.tree_digest(Rd.digests(spark, at)).first().files >= 1
    try:
        K.read_locked(spark, spark.read.json, at, name, {name: "0" * 64})
        raise AssertionError("another digest was accepted")
    except ValueError:
        pass
    return K.read_locked(spark, spark.read.schema("item_id BIGINT, text STRING").json, at, name, {name: "sha256:" + manifest[name]})


TOY = ("raise", "hold", "cut", "raise", "raise", "hold", "hold", "cut", "cut", "cut", "hold", "raise", "hold", "cut")  # decisions of fourteen made-up meetings


@query(["samples"], "SELECT task_label, n, (SELECT count(*) FROM samples s WHERE s.task_label = t.task_label) AS real FROM (SELECT unnest([-1, 0, 1]) AS task_label, unnest([5, 5, 4])::BIGINT AS n) t")
def s43_y49_toy_samples(spark, sf):
    """Fourteen made-up samples that pass validation and aren't ready for formal results, beside the real ones of each label."""
    label = {"raise": "1", "hold": "0", "cut": "-1"}
    day = lambda i: f"20{10 + i}-03-15T18:00:00Z"
    rows = [(f"toy_{i}", f"Members voted to {w} the rate.", label[w], day(i), day(i), "statement", "made up", "author", "unknown") for i, w in enumerate(TOY)]
    names = "sample_id string, text string, task_label string, event_time string, available_time string, document_type string, source string, annotation_source string, availability_quality string"
    toys = C.checked(spark.createDataFrame(rows, names))
    real = view(spark, sf, "samples").groupBy(F.col("task_label").cast("int").alias("task_label")).agg(F.count("*").alias("real"))
    made = toys.groupBy(F.col("task_label").cast("int").alias("task_label")).agg(F.count("*").alias("n"))
    return made.join(real, "task_label", "left").withColumn("real", F.coalesce("real", F.lit(0)))
