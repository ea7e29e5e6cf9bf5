"""Corpus construction and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def isolation(anchors: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row on (document_id, text_hash, at) of both sides: latest anchor, earliest corpus row, whether they are apart, shared documents and texts."""
    ids = lambda d, c: d.where(F.length(c) > 0).select(c)
    shared = lambda c, name: ids(anchors, c).intersect(ids(corpus, c)).agg(F.count("*").alias(name))
    edges = anchors.agg(F.max("at").alias("anchor_max")).join(F.broadcast(corpus.agg(F.min("at").alias("corpus_min"), F.count("*").alias("docs"))))  # one row each
    out = edges.withColumn("apart", F.col("anchor_max") < F.col("corpus_min"))
    return out.join(F.broadcast(shared("document_id", "shared_documents"))).join(F.broadcast(shared("text_hash", "shared_texts")))


def separation(anchors: DataFrame, before: DataFrame, after: DataFrame, bound: str = "2020-01-01") -> DataFrame:
    """One row on anchors (document_id, text_hash, at) and the two corpora (document_id, text_hash): apart from the fixed bound, overlaps, and whether all is well."""
    distinct = lambda d, c: d.where(F.length(c) > 0).select(c).distinct()
    overlap = lambda d, c, name: distinct(anchors, c).join(distinct(d, c), c, "left_semi").agg(F.count("*").alias(name))
    seen = anchors.agg(F.count("*").alias("anchors"), F.count_distinct("document_id").alias("documents"), F.min("at").alias("first"), F.max("at").alias("last"))
    out = seen.withColumn("apart", F.col("last") < F.lit(bound).cast("date"))
    for d, c, name in ((after, "document_id", "document_overlap"), (after, "text_hash", "sentence_overlap"), (before, "text_hash", "earlier_overlap")):
        out = out.join(F.broadcast(overlap(d, c, name)))
    return out.withColumn("ok", F.col("apart") & (F.col("document_overlap") == 0) & (F.col("sentence_overlap") == 0))


QUALITIES = ("exact", "heuristic", "unknown")
# The domain that sources must come from.
OFFICIAL = "https://www.federalreserve.gov/"


def violations(samples: DataFrame) -> DataFrame:
    """(rule, sample_id) of every broken rule; a caller raises when there is any.

    Samples are (sample_id, text, task_label as text, event_time, available_time as ISO text, document_type, source,
    annotation_source, availability_quality).
    """
    from chronolake.functions.scalars import iso_utc, strict_label

    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    event, available = iso_utc(F.col("event_time")), iso_utc(F.col("available_time"))
    rules = {
        "id": empty("sample_id"), "text": empty("text"), "label": strict_label(F.col("task_label")).isNull(), "event time": event.isNull(), "available time": available.isNull(),
        "order of times": F.coalesce(event > available, F.lit(False)), "document type": empty("document_type"), "source": empty("source"), "annotation source": empty("annotation_source"),
        "quality": ~F.coalesce(F.col("availability_quality").isin(*QUALITIES), F.lit(False)),
    }
    broken = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule")
    twice = samples.groupBy("sample_id").count().where("count > 1").select(F.lit("duplicate").alias("rule"), "sample_id")
    return samples.select(broken, "sample_id").unionByName(twice)


def checked(samples: DataFrame) -> DataFrame:
    """The samples, or an error that names the first broken rules; no samples are an error too."""
    found = violations(samples).limit(5).collect()
    if found or samples.isEmpty():
        raise ValueError("; ".join(f"{r.rule}: {r.sample_id}" for r in found) or "no samples")
    return samples


def ready(samples: DataFrame, flags: dict[str, bool]) -> DataFrame:
    """Whether samples may be used for formal results: all flags, any sample, and every availability exact."""
    ok = F.count("*") > 0
    return samples.agg((F.lit(all(flags.values())) & ok & F.coalesce(F.bool_and(F.col("availability_quality") == "exact"), F.lit(False))).alias("ready"), F.count("*").alias("n"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def running(df: DataFrame, by: list[str], key: str, size: str, name: str = "lo", rows: int = 1 << 16) -> DataFrame:
    """`df` with the sum of `size` before each row in the order of `key`, a digest in hex, within `by`.

    Ranges of the digest are as many as the table needs, so no task sees a whole side; ties of the key go by the other columns.
    """
    ranges = max(1, -(-df.count() // rows))
    rest = [c for c in df.columns if c not in (*by, key, size)]
    d = df.withColumn("_range", F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*by, "_range").agg(F.sum(size).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*by, "_range").orderBy(key, *rest, size).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(sums, [*by, "_range"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_range", "_base", "_in")


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))


def _cycled(docs: DataFrame, need: dict[str, int], seed: str) -> DataFrame:
    """(side, doc_id, lo, hi): where each document's tokens stand in its side's stream of `need` tokens, once for each cycle that is needed."""
    placed = running(docs.withColumn("k", _digest(seed, F.col("doc_id").cast("string"))), ["side"], "k", "n")
    total = docs.groupBy("side").agg(F.sum("n").alias("total")).where("total > 0")  # two rows
    wanted = F.lit(0).cast("long")
    for side, n in need.items():
        wanted = F.when(F.col("side") == side, F.lit(n).cast("long")).otherwise(wanted)
    d = placed.join(F.broadcast(total), "side").withColumn("need", wanted).where("n > 0 AND need > 0")
    d = d.withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("need") / F.col("total")) - 1)))
    d = d.withColumn("lo", F.col("lo") + F.col("cycle") * F.col("total")).withColumn("hi", F.least(F.col("lo") + F.col("n"), F.col("need")))
    return d.where("lo < need").select("side", "doc_id", "lo", "hi")


def dose_stream(docs: DataFrame, dose: float, tokens: int, length: int = 128, chunk: int = 32, seed: str = "stream", most_repeated: float | None = None) -> DataFrame:
    """(block, pre, post, docs) of a stream of exactly `tokens` tokens, the share `dose` of them from side 'post': what each block of `length` holds.

    `docs` are (doc_id, side, n).  Documents come in a seeded order, cut at the exact token; a side that is too short is
    repeated, an error if that makes up more than `most_repeated` of it.  Both sides are cut into chunks, and these mixed.
    """
    post = round(tokens * dose)
    need = {"post": post, "pre": tokens - post}
    have = {r.side: r.s or 0 for r in docs.groupBy("side").agg(F.sum("n").alias("s")).collect()}  # two rows
    for side, n in need.items():
        if n and not have.get(side):
            raise ValueError(f"no tokens on side {side}")
        if n and most_repeated is not None and max(0, n - have[side]) / n > most_repeated:
            raise ValueError(f"side {side} would repeat {max(0, n - have[side])} of {n} tokens")
    return mixed_blocks(_cycled(docs, need, seed), need, length, min(chunk, length), seed)


def mixed_blocks(pieces: DataFrame, need: dict[str, int], length: int, chunk: int, seed: str) -> DataFrame:
    spark = pieces.sparkSession
    mix = sum(n > 0 for n in need.values()) > 1
    size = chunk if mix else max(1, sum(need.values()))  # one side alone isn't mixed
    sides = None
    for side, n in need.items():
        if n:
            one = spark.range(-(-n // size)).select(F.lit(side).alias("side"), F.col("id").alias("chunk"), F.least(F.lit(size), n - F.col("id") * size).cast("long").alias("len"))
            sides = one if sides is None else sides.unionByName(one)
    order = running(sides.withColumn("k", _digest(seed, "mix", F.col("side"), F.col("chunk").cast("string"))), [], "k", "len", "start").select("side", "chunk", "start")
    part = pieces.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    part = part.withColumns({"a": F.greatest("lo", F.col("chunk") * size), "b": F.least("hi", (F.col("chunk") + 1) * size)}).join(order, ["side", "chunk"])
    part = part.withColumns({"x": F.col("start") + F.col("a") - F.col("chunk") * size, "y": F.col("start") + F.col("b") - F.col("chunk") * size})
    part = part.withColumn("block", F.explode(F.sequence(F.floor(F.col("x") / length), F.floor((F.col("y") - 1) / length))))
    n = F.least("y", (F.col("block") + 1) * length) - F.greatest("x", F.col("block") * length)
    side = lambda s: F.sum(F.when(F.col("side") == s, n).otherwise(0)).alias(s)
    return part.groupBy("block").agg(side("pre"), side("post"), F.sort_array(F.collect_set("doc_id")).alias("docs"))  # a block's documents are `length` at most


def matched_stream(docs: DataFrame, dose: float, tokens: int, length: int = 128, seed: str = "match") -> DataFrame:
    """(block, docs, tokens): all earlier documents and the first share of the later ones (by id), in one seeded order, packed and repeated to the budget."""
    from chronolake.operators.stats import numbered

    if dose in (0.0, 1.0):
        chosen = docs.where(F.col("side") == ("post" if dose else "pre"))
    else:
        later = numbered(docs.where("side = 'post'"), ["doc_id"], "_place")
        chosen = docs.where("side = 'pre'").unionByName(later.where(F.col("_place") < round(later.count() * dose)).drop("_place"))
    one = chosen.withColumn("side", F.lit("pre"))
    out = mixed_blocks(_cycled(one, {"pre": tokens}, seed), {"pre": tokens}, length, length, seed)
    return out.select("block", F.size("docs").cast("long").alias("docs"), F.col("pre").alias("tokens"))


def sample_stream(docs: DataFrame, dose: float, total: int, seed: str = "pick") -> DataFrame:
    """(place, doc_id, side) of `total` samples, the share `dose` from side 'post', in a seeded order; drawn again only where a side is too small."""
    from chronolake.operators.stats import hash_index, numbered

    post, spark = round(total * dose), docs.sparkSession
    out = None
    for side, n in (("pre", total - post), ("post", post)):
        own = docs.where(F.col("side") == side).select("doc_id")
        have = own.count()
        if not n:
            continue
        if n <= have:
            key = F.conv(F.substring(_digest(seed, F.col("doc_id").cast("string")), 1, 12), 16, 10).cast("long")
            picked = numbered(own.withColumn("key", key), ["key", "doc_id"], "r").where(F.col("r") < n).select("doc_id", "r")
        else:
            draw = spark.range(n).select(F.col("id").alias("r"), hash_index(have, F.lit(seed), F.lit(side), F.col("id").cast("string")).alias("i"))
            picked = draw.join(numbered(own, ["doc_id"]), "i").select("doc_id", "r")
        one = picked.withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    shuffle = F.conv(F.substring(_digest(seed, "order", F.col("side"), F.col("r").cast("string")), 1, 12), 16, 10).cast("long")
    return numbered(out.withColumn("key", shuffle), ["key", "side", "r"], "place").select("place", "doc_id", "side")


def verified(docs: DataFrame, raw: DataFrame) -> DataFrame:
    """(document_id, reason): the first of eight checks that a document fails, null if it passes all.

    `docs` are (document_id, seq, text, raw_sha, text_sha, source_url, availability_quality, available_time), `raw` (document_id,
    content, rebuilt): the source as it was fetched and the text that is made of it.
    """
    first = Window.partitionBy("document_id").orderBy("seq")
    d = docs.withColumn("_n", F.row_number().over(first)).alias("d").join(raw.withColumn("_held", F.lit(True)).alias("r"), "document_id", "left")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    differs = lambda a, b: ~a.eqNullSafe(b)
    checks = (
        ("duplicate", F.col("_n") > 1), ("no source", F.col("_held").isNull()), ("source differs", differs(digest(F.replace("r.content", F.lit("\r\n"), F.lit("\n"))), F.col("d.raw_sha"))),
        ("not official", ~F.coalesce(F.col("d.source_url").startswith(OFFICIAL), F.lit(False))), ("text differs", differs(digest(F.col("r.rebuilt")), F.col("d.text_sha"))),
        ("not the stored text", differs(F.col("d.text"), F.col("r.rebuilt"))), ("availability", ~F.coalesce((F.col("d.availability_quality") == "exact") & (F.length("d.available_time") > 0), F.lit(False))),
    )
    reason = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        reason = F.when(bad, name).otherwise(reason)
    return d.select("document_id", "seq", reason.alias("reason"))


def profile(samples: DataFrame) -> DataFrame:
    """Counts of a dataset by kind (type, label, quality, year) and value, in one pass."""
    kinds = {"type": F.col("document_type"), "label": F.col("task_label").cast("string"), "quality": F.col("availability_quality"), "year": F.substring("available_time", 1, 4)}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(v, F.lit("")).alias("value")) for k, v in kinds.items()])).alias("p")
    return samples.select(pairs).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def verifies(content: Column, expected: Column) -> Column:
    """Whether a digest is that of a content as it is, with LF or with CRLF line ends; a prefix sha256: is passed over."""
    want = F.regexp_replace(F.lower(F.trim(expected)), "^sha256:", "")
    lf = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return F.coalesce(want.isin(digest(content), digest(lf), digest(F.replace(lf, F.lit("\n"), F.lit("\r\n")))), F.lit(False))


def canonical_digest(content: Column) -> Column:
    return F.sha2(F.replace(content, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)


def ordered_digest(rows: DataFrame, by: list[str], order: str, digest: str, most: int = 100_000) -> DataFrame:
    """(by, digest) of small corpora: the digest of all their rows' digests one after the other, ties of order by digest.

    This is a chain over the whole corpus and can't be cut; a corpus of more than `most` rows is an error, and `chained_digest` the form for size.
    """
    large = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most).first()
    if large is not None:
        raise ValueError(f"a corpus of {large['n']} rows has no ordered digest")
    held = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, digest))).alias("r"))  # `most` rows
    return held.select(*by, F.sha2(F.array_join(F.transform("r", lambda x: x[digest]), "").cast("binary"), 256).alias("digest"))


def chained_digest(rows: DataFrame, by: list[str], order: str, digest: str, block: int = 4096) -> DataFrame:
    """(by, digest) of a corpus of any size, in a format of its own: digests of blocks of rows in order, and the digest of these, block by block above.

    A block is the rows of one range of `order` (a number), and `block` digests of blocks make one of the next level, so
    no row holds more than `block` digests but where `order` repeats; rows of one order are counted with theirs.
    """
    d = rows.groupBy(*by, order, digest).agg(F.count("*").alias("_c"))
    d = d.select(*by, F.col(order).cast("long").alias("_o"), F.when(F.col("_c") > 1, F.concat_ws("*", digest, F.col("_c").cast("string"))).otherwise(F.col(digest)).alias("h"))
    d = d.withColumn("_block", F.floor(F.col("_o") / block))
    level = d.groupBy(*by, "_block").agg(F.sort_array(F.collect_list(F.struct("_o", "h"))).alias("r"))
    joined = F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), "").cast("binary"), 256)
    level = level.select(*by, "_block", joined.alias("h"))
    widest = d.agg(F.max(F.abs("_block")).alias("m")).first().m or 0
    while widest >= block:
        level = level.withColumn("_up", F.floor(F.col("_block") / block)).groupBy(*by, "_up").agg(F.sort_array(F.collect_list(F.struct("_block", "h"))).alias("r")).select(*by, F.col("_up").alias("_block"), joined.alias("h"))
        widest //= block
    return level.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_block", "h"))).alias("r")).select(*by, joined.alias("digest"))
