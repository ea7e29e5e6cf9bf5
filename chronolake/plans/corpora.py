"""Queries of corpus streams, audits and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import corpus as C
from chronolake.plans.book import query
from chronolake.plans.views import table, view

_WORDS = "CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS BIGINT)"
_SIDES = f"t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'post' ELSE 'pre' END AS side, {_WORDS} AS n FROM documents), tk AS (SELECT CAST(sum(n) // 1024 AS BIGINT) * 512 AS tokens FROM t)"


def _sides(spark, sf):
    """(documents of two sides, a budget of half of all words in whole blocks)."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "post").otherwise("pre").alias("side"), C.word_count(F.col("text")).alias("n"))
    return d, int((d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 1024) * 512)


def _stream(dose: str, seed: str, size: str = "32") -> str:
    return f"""nd AS (SELECT 'post' AS side, CAST(round_even(tokens * {dose}::DOUBLE, 0) AS BIGINT) AS need FROM tk UNION ALL SELECT 'pre', tokens - CAST(round_even(tokens * {dose}::DOUBLE, 0) AS BIGINT) FROM tk),
o AS (SELECT t.*, need, sum(n) OVER (PARTITION BY side) AS total, coalesce(sum(n) OVER (PARTITION BY side ORDER BY md5('{seed}:' || doc_id), doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo0 FROM t JOIN nd USING (side)),
cy AS (SELECT side, doc_id, n, need, CAST(lo0 + c * total AS BIGINT) AS lo FROM (SELECT *, unnest(range(CAST(ceil(need::DOUBLE / total) AS BIGINT))) AS c FROM o WHERE n > 0 AND need > 0)), p AS (SELECT side, doc_id, lo, least(lo + n, need) AS hi FROM cy WHERE lo < need),
ch AS (SELECT side, unnest(range(CAST(ceil(need::DOUBLE / {size}) AS BIGINT))) AS chunk, need FROM nd WHERE need > 0), cl AS (SELECT side, chunk, least({size}, need - chunk * {size}) AS len FROM ch),
st AS (SELECT side, chunk, CAST(coalesce(sum(len) OVER (ORDER BY md5('{seed}:mix:' || side || ':' || chunk), side, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM cl),
pc AS (SELECT side, doc_id, chunk, greatest(lo, chunk * {size}) AS a, least(hi, (chunk + 1) * {size}) AS b FROM (SELECT *, unnest(range(lo // {size}, (hi - 1) // {size} + 1)) AS chunk FROM p)),
xy AS (SELECT side, doc_id, start + a - chunk * {size} AS x, start + b - chunk * {size} AS y FROM pc JOIN st USING (side, chunk)), bl AS (SELECT *, unnest(range(x // 512, (y - 1) // 512 + 1)) AS block FROM xy),
mf AS (SELECT CAST(block AS BIGINT) AS block, CAST(sum(CASE WHEN side = 'pre' THEN least(y, (block + 1) * 512) - greatest(x, block * 512) ELSE 0 END) AS BIGINT) AS pre, CAST(sum(CASE WHEN side = 'post' THEN least(y, (block + 1) * 512) - greatest(x, block * 512) ELSE 0 END) AS BIGINT) AS post, list_sort(list(DISTINCT doc_id)) AS docs FROM bl GROUP BY block)"""


@query([], f"WITH {_SIDES}, {_stream('0.25', 'stream')} SELECT block, pre, post, docs FROM mf")
def c1_a28_dose_blocks(spark, sf):
    """A quarter of the tokens from the later side, the documents of every block."""
    d, tokens = _sides(spark, sf)
    return C.dose_stream(d, 0.25, tokens, 512)


@query([], f"WITH {_SIDES}, {_stream('0.75', 'stream')} SELECT block, pre, post, docs FROM mf")
def c1_repeated_blocks(spark, sf):
    """Three quarters from the later side, which is too short and repeats."""
    d, tokens = _sides(spark, sf)
    return C.dose_stream(d, 0.75, tokens, 512)


_ONE = "CASE WHEN (SELECT tokens FROM tk) > 0 THEN (SELECT tokens FROM tk) ELSE 1 END"
_MATCH = _SIDES.replace("t AS (", "t0 AS (", 1).replace("FROM t)", "FROM t0)") + ", pk AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY side) AS c FROM t0), t AS (SELECT doc_id, 'pre' AS side, n FROM pk WHERE side = 'pre' OR place < round_even(c * 0.5::DOUBLE, 0))"


@query([], f"WITH {_MATCH}, {_stream('0.0', 'match', _ONE)} SELECT block, len(docs)::BIGINT AS docs, pre AS tokens FROM mf")
def c2_matched_blocks(spark, sf):
    d, tokens = _sides(spark, sf)
    return C.matched_stream(d, 0.5, tokens, 512)


_KEY = "CAST('0x' || left(md5({}), 12) AS BIGINT)"


@query([], f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'post' ELSE 'pre' END AS side FROM documents), n AS (SELECT count(*) AS n FROM d), c AS (SELECT side, count(*) AS have FROM d GROUP BY side),
nd AS (SELECT 'pre' AS side, n - CAST(round_even(n * 0.4::DOUBLE, 0) AS BIGINT) AS need FROM n UNION ALL SELECT 'post', CAST(round_even(n * 0.4::DOUBLE, 0) AS BIGINT) FROM n),
a AS (SELECT side, doc_id, row_number() OVER (PARTITION BY side ORDER BY {_KEY.format("'pick:' || doc_id")}, doc_id) - 1 AS r, row_number() OVER (PARTITION BY side ORDER BY doc_id) - 1 AS i FROM d),
w AS (SELECT side, doc_id, r FROM a JOIN nd USING (side) JOIN c USING (side) WHERE need <= have AND r < need UNION ALL SELECT x.side, a.doc_id, x.r FROM (SELECT side, have, unnest(range(need)) AS r FROM nd JOIN c USING (side) WHERE need > have) x JOIN a ON a.side = x.side AND a.i = CAST('0x' || left(md5('pick:' || x.side || ':' || x.r), 8) AS BIGINT) % x.have)
SELECT row_number() OVER (ORDER BY {_KEY.format("'pick:order:' || side || ':' || r")}, side, r) - 1 AS place, doc_id, side FROM w""")
def c3_o11_o12_sample_stream(spark, sf):
    """As many samples as there are documents, two fifths of them later ones, which are too few and are drawn again."""
    d, _ = _sides(spark, sf)
    return C.sample_stream(d.select("doc_id", "side"), 0.4, d.count())


_FAULTY = """f AS (SELECT CASE WHEN doc_id % 97 = 1 THEN ' ' WHEN doc_id % 89 = 3 THEN '0' ELSE CAST(doc_id AS VARCHAR) END AS sample_id, CASE WHEN doc_id % 31 = 2 THEN '  ' ELSE text END AS text, CASE doc_id % 9 WHEN 0 THEN '1.0' WHEN 1 THEN ' -1 ' WHEN 2 THEN NULL WHEN 3 THEN '2' ELSE '0' END AS task_label, doc_id % 11 AS e, doc_id % 13 AS a,
CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 'minutes' END AS document_type, source, CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'expert' END AS annotation_source, CASE doc_id % 5 WHEN 0 THEN 'guess' WHEN 1 THEN NULL ELSE 'exact' END AS availability_quality FROM documents)"""


def _faulty(spark, sf):
    k = F.col("doc_id")
    event = F.when(k % 11 == 0, "2020-05-01T10:00:00").when(k % 11 == 1, "2020-05-03T00:00:00Z").otherwise("2020-05-01T10:00:00Z")
    available = F.when(k % 13 == 0, "soon").when(k % 13 == 1, "2020-05-01T11:00:00+02:00").otherwise("2020-05-02T00:00:00Z")
    return table(spark, sf, "documents").select(
        F.when(k % 97 == 1, " ").when(k % 89 == 3, "0").otherwise(k.cast("string")).alias("sample_id"), F.when(k % 31 == 2, "  ").otherwise(F.col("text")).alias("text"),
        F.when(k % 9 == 0, "1.0").when(k % 9 == 1, " -1 ").when(k % 9 == 2, None).when(k % 9 == 3, "2").otherwise("0").alias("task_label"), event.alias("event_time"), available.alias("available_time"),
        F.when(k % 17 == 0, None).otherwise("minutes").alias("document_type"), "source", F.when(k % 19 == 0, "").otherwise("expert").alias("annotation_source"),
        F.when(k % 5 == 0, "guess").when(k % 5 == 1, None).otherwise("exact").alias("availability_quality"),
    )


@query([], f"""WITH {_FAULTY}, r AS (SELECT sample_id, unnest([CASE WHEN trim(sample_id) = '' THEN 'id' END, CASE WHEN trim(text) = '' THEN 'text' END, CASE WHEN task_label IS NULL OR trim(task_label) NOT IN ('-1', '0', '1') THEN 'label' END, CASE WHEN e = 0 THEN 'event time' END, CASE WHEN a = 0 THEN 'available time' END,
  CASE WHEN e <> 0 AND a <> 0 AND (e = 1 OR a = 1) THEN 'order of times' END, CASE WHEN document_type IS NULL THEN 'document type' END, CASE WHEN source IS NULL OR trim(source) = '' THEN 'source' END, CASE WHEN annotation_source = '' THEN 'annotation source' END, CASE WHEN availability_quality IS NULL OR availability_quality = 'guess' THEN 'quality' END]) AS rule FROM f)
SELECT rule, sample_id FROM r WHERE rule IS NOT NULL UNION ALL SELECT 'duplicate', sample_id FROM f GROUP BY sample_id HAVING count(*) > 1""")
def c5_c6_o9_violations(spark, sf):
    return C.violations(_faulty(spark, sf))


@query([], f"WITH {_FAULTY}, k AS (SELECT unnest(['type', 'label', 'quality', 'year']) AS kind, unnest([coalesce(document_type, ''), coalesce(task_label, ''), coalesce(availability_quality, ''), CASE WHEN a = 0 THEN 'soon' ELSE '2020' END]) AS value FROM f) SELECT kind, value, count(*) AS n FROM k GROUP BY ALL")
def a30_k13_profile(spark, sf):
    return C.profile(_faulty(spark, sf))


@query([], "SELECT source, false AS ready, count(*) AS n FROM documents WHERE doc_id % 5 > 1 GROUP BY source UNION ALL SELECT 'all exact', true, count(*) FILTER (doc_id % 5 > 1) FROM documents UNION ALL SELECT 'none', false, 0")
def p14_p17_c14_readiness(spark, sf):
    """Exact samples alone are ready if all flags hold; one flag missing, or no sample, and nothing is."""
    exact = _faulty(spark, sf).where("availability_quality = 'exact'")
    flags = {"source": True, "annotation": True, "pit": True, "manifest": True, "provenance": True, "urls": True}
    by = exact.groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit(all((flags | {"urls": False}).values())).alias("ready"), "n")
    whole = C.ready(exact, flags).select(F.lit("all exact").alias("source"), "ready", "n")
    return by.unionByName(whole).unionByName(C.ready(exact.limit(0), flags).select(F.lit("none").alias("source"), "ready", "n"))


_ANCH = "an AS (SELECT 'd' || item_id AS document_id, sha256(text) AS text_hash, CAST(DATE '2019-01-01' + CAST(item_id AS INT) AS DATE) AS at_date FROM benchmark), co AS (SELECT 'd' || (doc_id * 7) AS document_id, sha256(CASE WHEN doc_id % 50 = 0 THEN (SELECT min(text) FROM benchmark) ELSE text END) AS text_hash, CAST(DATE '2020-02-01' + CAST(doc_id % 900 AS INT) AS DATE) AS at_date FROM documents)"


def _anchors(spark, sf):
    h = lambda c: F.sha2(c.cast("binary"), 256).alias("text_hash")
    day = lambda start, c: F.date_add(F.lit(start).cast("date"), c.cast("int")).alias("at")
    b = table(spark, sf, "benchmark")
    least = b.agg(F.min("text").alias("least"))  # one row
    anchors = b.select(F.concat(F.lit("d"), F.col("item_id").cast("string")).alias("document_id"), h(F.col("text")), day("2019-01-01", F.col("item_id")))
    d = table(spark, sf, "documents").join(F.broadcast(least))
    text = F.when(F.col("doc_id") % 50 == 0, F.col("least")).otherwise(F.col("text"))
    return anchors, d.select(F.concat(F.lit("d"), (F.col("doc_id") * 7).cast("string")).alias("document_id"), h(text), day("2020-02-01", F.col("doc_id") % 900), (F.col("doc_id") % 2).alias("half"))


@query([], f"WITH {_ANCH} SELECT (SELECT max(at_date) FROM an) AS anchor_max, (SELECT min(at_date) FROM co) AS corpus_min, (SELECT count(*) FROM co) AS docs, (SELECT max(at_date) FROM an) < (SELECT min(at_date) FROM co) AS apart, (SELECT count(*) FROM (SELECT document_id FROM an INTERSECT SELECT document_id FROM co)) AS shared_documents, (SELECT count(*) FROM (SELECT text_hash FROM an INTERSECT SELECT text_hash FROM co)) AS shared_texts")
def c7_t3_t5_isolation(spark, sf):
    anchors, corpus = _anchors(spark, sf)
    return C.isolation(anchors, corpus.drop("half"))


@query([], f"""WITH {_ANCH}, h AS (SELECT *, (CAST(substr(document_id, 2) AS BIGINT) // 7) % 2 AS half FROM co), n AS (SELECT (SELECT count(*) FROM an) AS anchors, (SELECT count(DISTINCT document_id) FROM an) AS documents, (SELECT min(at_date) FROM an) AS first, (SELECT max(at_date) FROM an) AS last,
  (SELECT count(*) FROM (SELECT document_id FROM an INTERSECT SELECT document_id FROM h WHERE half = 1)) AS document_overlap, (SELECT count(*) FROM (SELECT text_hash FROM an INTERSECT SELECT text_hash FROM h WHERE half = 1)) AS sentence_overlap, (SELECT count(*) FROM (SELECT text_hash FROM an INTERSECT SELECT text_hash FROM h WHERE half = 0)) AS earlier_overlap)
SELECT *, last < DATE '2020-01-01' AS apart, last < DATE '2020-01-01' AND document_overlap = 0 AND sentence_overlap = 0 AS ok FROM n""")
def c8_t4_separation(spark, sf):
    anchors, corpus = _anchors(spark, sf)
    return C.separation(anchors, corpus.where("half = 0"), corpus.where("half = 1"))


@query([], """SELECT doc_id, CASE WHEN doc_id % 40 = 1 THEN 'no source' WHEN doc_id % 40 = 2 THEN 'source differs' WHEN doc_id % 40 = 3 THEN 'not official' WHEN doc_id % 40 = 4 THEN 'text differs' WHEN doc_id % 40 = 5 THEN 'not the stored text' WHEN doc_id % 40 = 6 THEN 'availability' END AS reason, 0 AS seq FROM documents
UNION ALL SELECT doc_id, 'duplicate', 1 FROM documents WHERE doc_id % 40 = 7""")
def c9_verified_sources(spark, sf):
    """Eight checks in order, the first that fails counts; line ends of a source don't matter."""
    k = F.col("doc_id") % 40
    d = table(spark, sf, "documents")
    page = F.concat(F.lit("<p>\n"), "text", F.lit("\n</p>"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    docs = d.select(
        F.col("doc_id").alias("document_id"), F.lit(0).alias("seq"), F.when(k == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(k == 2, "x").otherwise(sha(page)).alias("raw_sha"),
        F.when(k == 4, "y").otherwise(sha(F.col("text"))).alias("text_sha"), F.when(k == 3, "https://example.org/a").otherwise(C.OFFICIAL + "a").alias("source_url"),
        F.when(k == 6, "heuristic").otherwise("exact").alias("availability_quality"), F.lit("2020-01-01T00:00:00Z").alias("available_time"), k.alias("k"),
    )
    docs = docs.unionByName(docs.where("k = 7").withColumn("seq", F.lit(1))).drop("k")
    raw = d.where(k != 1).select(F.col("doc_id").alias("document_id"), F.replace(page, F.lit("\n"), F.lit("\r\n")).alias("content"), F.col("text").alias("rebuilt"))
    return C.verified(docs, raw).select(F.col("document_id").alias("doc_id"), "reason", "seq")


@query([], "SELECT doc_id, doc_id % 5 < 4 AS same, sha256(replace(t, chr(13) || chr(10), chr(10))) AS canonical FROM (SELECT doc_id, 'a' || CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) ELSE chr(10) END || text AS t FROM documents)")
def f9_f10_y53_digests(spark, sf):
    """A digest holds for a content whatever its line ends, with a prefix or without."""
    k = F.col("doc_id")
    lf, crlf = (F.concat(F.lit(f"a{e}"), F.col("text")) for e in ("\n", "\r\n"))
    # single line ends only, so that both forms are those of one content
    flat = lambda c: F.replace(c, F.lit("\r"), F.lit(""))
    t = F.when(k % 2 == 0, crlf).otherwise(lf)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    low = flat(lf)
    want = F.when(k % 5 == 0, sha(t)).when(k % 5 == 1, F.concat(F.lit(" SHA256:"), F.upper(sha(low)))).when(k % 5 == 2, sha(F.replace(low, F.lit("\n"), F.lit("\r\n")))).when(k % 5 == 3, sha(low)).otherwise(sha(F.concat(t, F.lit("x"))))
    return table(spark, sf, "documents").select("doc_id", C.verifies(t, want).alias("same"), C.canonical_digest(t).alias("canonical"))


@query([], "SELECT source, sha256(string_agg(h, '' ORDER BY b)) AS digest FROM (SELECT source, doc_id // 4096 AS b, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL) GROUP BY source")
def x4_corpus_hash(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return C.chained_digest(d, ["source"], "doc_id", "h")


@query([], "SELECT source, doc_id // 64 AS part, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY ALL")
def x4_ordered_hash(spark, sf):
    """Small corpora, each with one digest of the digests of its texts in order."""
    d = table(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / 64).alias("part"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return C.ordered_digest(d, ["source", "part"], "doc_id", "h")


@query(["posts"], "SELECT source, id, '[' || epoch || '] [score:' || score || '] [' || CASE WHEN label = 'neutral' THEN 'unlabeled' ELSE label END || '] ' || text AS line FROM posts")
def x14_y21_post_lines(spark, sf):
    """A line a post, for a reader to write out in order; no source is gathered in one row."""
    p = view(spark, sf, "posts")
    label = F.when(F.col("label") == "neutral", "unlabeled").otherwise(F.col("label"))
    line = F.concat(F.lit("["), F.col("epoch").cast("string"), F.lit("] [score:"), F.col("score").cast("string"), F.lit("] ["), label, F.lit("] "), F.col("text"))
    return p.select("source", "id", line.alias("line"))
