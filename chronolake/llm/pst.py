"""Language model scoring with a probabilistic suffix tree over the bytes of token sequences.

A text is its words (A-Z lower-cased) joined by one space, then an end mark.  The
tree's contexts are up to DEPTH bytes long.  A context is kept if its next-byte
distribution diverges from that of the longest kept shorter one: its count times
the divergence pays for its parameters, half a log of the count each.  The test
knows nothing of the corpus's size, so the tree grows with what was read.  Kept
distributions are smoothed by those of shorter kept contexts (Witten-Bell); the
longest kept suffix of what was read gives the next byte's probability.

The tree is never in one place.  Counts of all DEPTH + 1 bytes that any text holds
are a table on the executors; contexts of up to two bytes are decided on the driver,
from at most 2**24 counts, and sent to all.  Longer contexts that end alike in three
bytes are in one bucket, by a hash of these bytes, and so are the grams that each
slice of texts asks for: a bucket's task makes its part of the tree and answers from
it.  A frequent gram is one row per slice, and what shares three bytes is bounded by
the alphabet.  Exact add-one unigram counts of words are asked for in the same way.
Where there are more than SALTED slices, a bucket is answered in as many shares of
the slices as keep a share below that, each with the bucket's part of the tree.

Words are told apart by a 64-bit hash.  Defined results: null texts count as
empty, with the end as their only token; a null id's fold is that of the empty
text; without training rows all counts are 0 and all bytes alike; rows are
returned one for one, repeated rows too; texts of any length are scored whole; extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm import bytekit as bk
from chronolake.llm.bytekit import planes, unplaned
from chronolake.llm.common import cut_parts, fold, stored

FOLDS, HELD = 7, 2
DEPTH, END = 5, 10
END_WORD = np.uint64(0x656E64)
BUCKET = 256 << 20  # bytes of text to a bucket of grams
SLICE = 3 << 19
SALTED = 1 << 15  # slices whose questions to a bucket one task answers


def stream(w: bk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the token sequences of a slice, each closed by END; offsets by row."""
    rows = len(w.count)
    size = w.end - w.start
    last = np.zeros(len(size), bool)
    filled = w.count > 0
    last[w.first[1:][filled] - 1] = True
    per = np.bincount(w.row, weights=size + 1, minlength=rows).astype(np.int64) + ~filled
    offs = np.concatenate(([0], np.cumsum(per)))
    out = np.full(offs[-1], END, np.uint8)
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    begin += (offs[:-1] - np.concatenate(([0], np.cumsum(np.bincount(w.row, weights=size + 1, minlength=rows).astype(np.int64))))[:-1])[w.row]
    word = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    out[begin[word] + step] = w.bytes[w.start[word] + step]
    out[(begin + size)[~last]] = 32
    return out, offs


def grams(text: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """DEPTH bytes of context and the next byte, packed, at every position; END stands for what is before a text."""
    key = text.astype(np.uint64)
    size = np.diff(offs)
    for j in range(1, DEPTH + 1):
        key[j:] |= text[:-j].astype(np.uint64) << np.uint64(8 * j)
        for k in range(j):  # the first bytes of a text, which see nothing of the text before
            at = offs[:-1][size > k] + k
            key[at] = key[at] & ~np.uint64(255 << 8 * j) | np.uint64(END << 8 * j)
    return key


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, in sorted keys."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(keys) else counts


def gram_counts(packed: DataFrame) -> DataFrame:
    """(gram, n) of every gram of any text; n counts those outside the held-out fold."""

    def each(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for one, block in _blocks(batches):
            g, own = grams(block.text, block.offs), np.repeat(one["held"].values.to_numpy(zero_copy_only=False), np.diff(block.offs))
            for rows, weight in ((~own, 1), (own, 0)):
                key = np.sort(g[rows])
                new = _distinct(key)
                held.append((key[new], weight * np.diff(np.append(new, len(key)))))
            if sum(len(x) for x, _ in held) > 2_500_000:
                held = [_merge(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > 2_000_000:
                    yield from out(held)
                    held = []
        yield from out(held)

    def out(held):
        if held:
            k, n = _merge(*map(np.concatenate, zip(*held, strict=True)))
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64))], names=["gram", "n"])

    return packed.select("held", "text", "sizes").mapInArrow(each, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def single_contexts(counts: np.ndarray) -> np.ndarray:
    """p[b, x]: chance of x after b, from counts[b, x]; without b's context kept, that of x alone."""
    alone = counts.sum(0)
    p0 = (alone + 1) / (alone.sum() + 256)
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    gain = (counts * np.log(np.maximum(counts, 1) / np.maximum(total, 1) / p0)).sum(1, keepdims=True)
    kept = (total > 0) & (gain >= 0.5 * kinds * np.log(np.maximum(total, 1)))
    return np.where(kept, (counts + kinds * p0) / np.maximum(total + kinds, 1), p0)


def _chances(child: np.ndarray, n: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of each gram's last byte, which contexts are kept), from sorted grams, their counts and the chances after the shorter contexts."""
    start = _distinct(child >> np.uint64(8))
    size = np.diff(np.append(start, len(child)))
    total, kinds = np.add.reduceat(n, start), np.add.reduceat((n > 0).astype(np.float64), start)
    gain = np.add.reduceat(n * np.log(np.maximum(n, 1) / np.repeat(np.maximum(total, 1), size) / parent), start)
    keep = (total > 0) & (gain >= 0.5 * kinds * np.log(np.maximum(total, 1)))
    total, kinds = np.repeat(total, size), np.repeat(kinds, size)
    return np.where(np.repeat(keep, size), (n + kinds * parent) / np.maximum(total + kinds, 1), parent), keep


def short_contexts(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(grams of three bytes, chance of the last after the first two, contexts of two bytes kept), from sorted grams and counts."""
    pair = (key & np.uint64(0xFFFF)).astype(np.int64)
    p1 = single_contexts(np.bincount(pair, weights=n, minlength=65536).reshape(256, 256))
    p, keep = _chances(key, n, p1.ravel()[pair]) if len(key) else (n, np.zeros(0, bool))
    return key, p, int(keep.sum())


def _levels(key: np.ndarray, n: np.ndarray, known: np.ndarray, p: np.ndarray):
    """(grams, chances, which contexts are kept) of every depth from 3; `key` holds all grams of their last three context bytes, known and p those of depth 2."""
    for d in range(3, DEPTH + 1):
        child, nc = _merge(key & np.uint64((1 << 8 * (d + 1)) - 1), n)
        parent = p[np.searchsorted(known, child & np.uint64((1 << 8 * d) - 1))]
        known, (p, keep) = child, _chances(child, nc, parent)
        yield known, p, keep


def branch(key: np.ndarray, n: np.ndarray, known: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Chance of each gram's last byte after the others."""
    for known, p, _ in _levels(key, n, known, p):  # noqa: B007, B020 the deepest level is what counts
        pass
    return p[np.searchsorted(known, key)]


def kept_contexts(key: np.ndarray, n: np.ndarray) -> int:
    """How many contexts of two bytes and more the divergence tests keep; `key` holds all grams."""
    known, p, kept = short_contexts(*_merge(key & np.uint64(0xFFFFFF), n))
    return kept + sum(int(keep.sum()) for *_, keep in _levels(key, n, known, p))


def _gram_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """By the last three context bytes; `_bucket_column` says the same of a column."""
    return (((key >> np.uint64(8) & np.uint64(0xFFFFFF)) * np.uint64(2654435761) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def _bucket_column(gram: str, buckets: int) -> Column:
    three = F.shiftrightunsigned(gram, 8).bitwiseAND(0xFFFFFF)
    return F.pmod(F.shiftrightunsigned(three * F.lit(2654435761), 20), F.lit(buckets)).cast("int")


def fit(packed: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Counts of all grams of the slices, and the chances after contexts of two bytes."""
    counts = stored(gram_counts(packed), "grams")
    seen = counts.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("g")).agg(F.sum("n").alias("n")).orderBy("g").toArrow()  # 2**24 rows at most
    known, p, _ = short_contexts(seen.column("g").to_numpy().view(np.uint64), seen.column("n").to_numpy().astype(np.float64))
    return counts, (known, p)


class Block:
    """A stored slice of texts: its stream, words and grams, in the order in which it asks for their counts."""

    def __init__(self, text: bytes, sizes: np.ndarray):
        self.offs = np.concatenate(([0], np.cumsum(sizes)))
        self.text = np.frombuffer(pa.decompress(text, int(self.offs[-1]), "zstd"), np.uint8)
        self.rows = len(sizes)

    def words(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, bucket of each, row of each token, key of each token): distinct words by bucket, the end among them."""
        w = bk.Words(bk.Slice(0, self.rows, self.text, self.offs), lower=False)
        keys, ident = np.unique(np.concatenate((w.hash(), np.full(self.rows, END_WORD))), return_inverse=True)
        bucket = (keys % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[by] = np.arange(len(keys))
        return keys[by], bucket[by], np.concatenate((w.row, np.arange(self.rows))), place[ident]

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all grams by position, distinct grams by bucket, bucket of each)."""
        g = grams(self.text, self.offs)
        key = np.sort(g)
        key = key[_distinct(key)]
        bucket = _gram_bucket(key, buckets)
        by = np.argsort(bucket, kind="stable")
        return g, key[by], bucket[by]


def _pack(docs: DataFrame) -> DataFrame:
    """A row per slice of texts: its number, ids, folds, compressed stream and lengths."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        """Slices of SLICE bytes, across batches."""
        parts, size = [], 0
        for batch in batches:
            parts.append(batch.columns)
            size += batch.column(1).nbytes
            if size >= SLICE:
                yield map(pa.concat_arrays, zip(*parts, strict=True))
                parts, size = [], 0
        if parts:
            yield map(pa.concat_arrays, zip(*parts, strict=True))

    def each(batches):
        bid = TaskContext.get().partitionId() << 32
        for ids, texts, held in rows(batches):
            for s in bk.slices(texts, SLICE):
                text, offs = stream(bk.Words(s))
                own = pa.array([ids.slice(s.lo, s.hi - s.lo).to_pylist()], pa.list_(ids.type))
                rest = [pa.array([held.slice(s.lo, s.hi - s.lo).to_pylist()], pa.list_(pa.bool_())), pa.array([pa.compress(text.tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([np.diff(offs)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([bid], pa.int64()), own, *rest], names=["bid", "ids", "held", "text", "sizes"])
                bid += 1

    return docs.select("doc_id", "text", (fold("doc_id", FOLDS) == HELD).alias("held")).mapInArrow(each, f"bid long, ids array<{kind}>, held array<boolean>, text binary, sizes array<long>")


def _blocks(batches):
    for batch in batches:
        at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
        for r in range(batch.num_rows):
            one = {c: batch.column(i)[r] for c, i in at.items()}
            yield one, Block(one["text"].as_py(), one["sizes"].values.to_numpy())


def _share(shares: int) -> Column:
    """Which share of the slices a slice belongs to."""
    return F.pmod(F.xxhash64("bid"), F.lit(shares)).cast("int")


def _for_all(part: DataFrame, shares: int) -> DataFrame:
    return part.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))


def _word_counts(packed: DataFrame, buckets: int, shares: int = 1) -> DataFrame:
    """(bid, bucket, payload, n, v): counts in training texts of each slice's words of a bucket; n and v are the bucket's tokens and types."""

    def split(batches):
        for one, block in _blocks(batches):
            keys, bucket, row, word = block.words(buckets)
            held = one["held"].values.to_numpy(zero_copy_only=False)
            train = np.bincount(word[~held[row]], minlength=len(keys)).astype(np.int32)
            edge = np.append(_distinct(bucket), len(bucket))
            rows = [{"bucket": int(bucket[a]), "bid": one["bid"].as_py(), "keys": keys[a:b].tobytes(), "train": train[a:b].tobytes()} for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema({"bucket": pa.int32(), "bid": pa.int64(), "keys": pa.binary(), "train": pa.binary()}))

    def look(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        train = np.frombuffer(b"".join(table.column("train").to_pylist()), np.int32)
        keys, ident = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(ident, weights=train, minlength=len(keys)).astype(np.int64)
        edge = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        each = c[ident]
        first = np.zeros(len(parts), np.int64)
        first[0] = 1
        return pa.table(
            {"bid": table.column("bid"), "bucket": table.column("bucket"), "payload": pa.array([each[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
             "n": pa.array(first * int(c.sum())), "v": pa.array(first * int((c > 0).sum()))}
        )

    def add(table: pa.Table) -> pa.Table:
        """One row of distinct words and their counts."""
        keys, ident = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]), return_inverse=True)
        c = np.bincount(ident, weights=np.frombuffer(b"".join(table.column("train").to_pylist()), table_kind(table)), minlength=len(keys)).astype(np.int64)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "keys": pa.array([keys.tobytes()], pa.binary()), "train": pa.array([c.tobytes()], pa.binary()), "wide": pa.array([True])})

    def table_kind(table: pa.Table) -> type:
        return np.int64 if "wide" in table.column_names else np.int32

    def answer(part: pa.Table, asks: pa.Table) -> pa.Table:
        keys, c = (np.frombuffer(part.column(k)[0].as_py(), d) for k, d in (("keys", np.uint64), ("train", np.int64)))
        found = [c[np.searchsorted(keys, np.frombuffer(x, np.uint64))].tobytes() for x in asks.column("keys").to_pylist()]
        first = np.zeros(len(found), np.int64)
        first[:1] = part.column("share")[0].as_py() == 0  # the share with number 0 tells the bucket's sums
        return pa.table({"bid": asks.column("bid"), "bucket": asks.column("bucket"), "payload": pa.array(found, pa.binary()), "n": pa.array(first * int(c.sum())), "v": pa.array(first * int((c > 0).sum()))})

    rows = packed.select("bid", "held", "text", "sizes").mapInArrow(split, "bucket int, bid long, keys binary, train binary")
    kind = "bid long, bucket int, payload binary, n long, v long"
    if shares == 1:
        return rows.groupBy("bucket").applyInArrow(look, kind)
    rows = stored(rows.withColumn("share", _share(shares)), "asked")
    sums = "bucket int, keys binary, train binary, wide boolean"
    part = rows.groupBy("bucket", "share").applyInArrow(add, sums).groupBy("bucket").applyInArrow(add, sums)
    # every share of slices has every bucket's part; where the share with number 0 asks nothing, one row of no slice tells the sums
    nobody = part.select("bucket", F.lit(-1).cast("long").alias("bid"), F.lit(b"").alias("keys"), F.lit(b"").alias("train"), F.lit(0).alias("share"))
    asks = rows.unionByName(nobody)
    return _for_all(part, shares).groupBy("bucket", "share").cogroup(asks.groupBy("bucket", "share")).applyInArrow(answer, kind)


def _gram_chances(packed: DataFrame, buckets: int, shares: int = 1) -> DataFrame:
    """(bid, bucket, payload): log10 chances of each slice's grams of a bucket, learned from the training fold."""
    counts, short = fit(packed)
    sent = packed.sparkSession.sparkContext.broadcast(short)

    def split(batches):
        for one, block in _blocks(batches):
            _, keys, bucket = block.grams(buckets)
            edge = np.append(_distinct(bucket), len(bucket))
            rows = [{"bucket": int(bucket[a]), "bid": one["bid"].as_py(), "n": int(b - a), "keys": planes(keys[a:b])} for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema({"bucket": pa.int32(), "bid": pa.int64(), "n": pa.int32(), "keys": pa.binary()}))

    def look(part: pa.Table, asks: pa.Table) -> pa.Table:
        found = []
        if part.num_rows:
            gram, n = _merge(part.column("gram").to_numpy().view(np.uint64), part.column("n").to_numpy().astype(np.float64))
            logp = np.log10(branch(gram, n, *sent.value)).astype(np.float32)
            found = [planes(logp[np.searchsorted(gram, unplaned(x, n, np.uint64))]) for n, x in zip(asks.column("n").to_pylist(), asks.column("keys").to_pylist(), strict=True)]
        return pa.table({"bid": asks.column("bid"), "bucket": asks.column("bucket"), "payload": pa.array(found, pa.binary())})

    rows = packed.select("bid", "text", "sizes").mapInArrow(split, "bucket int, bid long, n int, keys binary")
    tree = counts.withColumn("bucket", _bucket_column("gram", buckets))
    by = ["bucket"]
    if shares > 1:
        tree, rows, by = _for_all(tree, shares), rows.withColumn("share", _share(shares)), ["bucket", "share"]
    return tree.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(look, "bid long, bucket int, payload binary")


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = stored(_pack(docs), "packed")
    size = packed.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    buckets = max(48, cut_parts(docs), math.ceil(size / BUCKET))
    shares = max(1, -(-packed.count() // SALTED))
    counted = stored(_word_counts(packed, buckets, shares), "words")
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    whole = float(np.log10(n + v + 1))
    chances = _gram_chances(packed, buckets, shares)
    replies = counted.where("bid >= 0").select("bid", F.lit(0).alias("kind"), "bucket", "payload").union(chances.select("bid", F.lit(1), "bucket", "payload"))
    found = replies.groupBy("bid").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "payload"))).alias("found"))  # the answers to one slice

    def each(batches):
        for one, block in _blocks(batches):
            answer = one["found"].as_py()
            c = np.frombuffer(b"".join(x["payload"] for x in answer if x["kind"] == 0), np.int64)
            _, _, row, word = block.words(buckets)
            tokens = np.bincount(row, minlength=block.rows)
            base = np.bincount(row, weights=np.log10(c + 1.0)[word], minlength=block.rows) - tokens * whole
            known = np.bincount(row, weights=c[word] > 0, minlength=block.rows).astype(np.int64)
            g, key, bucket = block.grams(buckets)
            size = np.diff(np.append(_distinct(bucket), len(bucket))).tolist()
            logp = np.concatenate([unplaned(x["payload"], n, np.float32) for n, x in zip(size, (x for x in answer if x["kind"] == 1), strict=True)])
            order = np.argsort(key)
            score = np.add.reduceat(logp[order][np.searchsorted(key[order], g)].astype(np.float64), block.offs[:-1])
            yield pa.RecordBatch.from_arrays(
                [one["ids"].values, one["held"].values, pa.array(tokens), pa.array(known), pa.array(np.full(block.rows, n, np.int64)), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return packed.join(found, "bid").mapInArrow(each, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


#: The base columns: a table-driven crc32 for the fold, counts of training tokens, and their chances.
BASE_SQL = r"""
WITH bytes AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS crc FROM range(256) t(b)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
             list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w FROM documents),
f AS (SELECT rid, doc_id, w, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 2 AS held_out FROM d, bytes),
tok AS (SELECT rid, held_out, unnest(w) AS t FROM f),
cnt AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t),
tot AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM cnt),
told AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + v + 1)::DOUBLE)) AS base FROM tok LEFT JOIN cnt USING (t), tot GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 4) AS base_score FROM f JOIN told USING (rid), tot
"""
