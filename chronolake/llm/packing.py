"""Packing documents into sequences along a space-filling curve.

A document is its token ids and an end id.  Its ids, as a hashed vector (every
id has a random sign a dimension), are projected to four numbers; each is cut at
the corpus's own quantiles, and the cell's place on the Hilbert curve is the
document's key.  A range sort by that key puts alike documents side by side, and
the sequences are cut from the stream of all documents in this order, so a
sequence holds neighbours on the curve.

Nothing passes through one task: a sorted partition has running sums of its own,
one number a partition makes these global, and every document then knows where
its pieces lie.  Only the stream's end can't fill a sequence; its rest is cut in
powers of two, which need no padding.  So no sequence is padded.

Keys of copies are equal; ranges are cut by key, id and digest together, so a
large group of copies spreads over partitions.

Defined results: null or empty text has the end id alone; every row counts,
repeated ones too; documents of one key go by id (null first), then digest of the
ids, so reruns agree; a text of any length is cut like any other; an empty table
gives no piece; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm import bytekit as bk
from chronolake.llm.common import cut_parts, discard, stored
from chronolake.llm.vocab import vocabulary

DIMS, BITS, END = 4, 8, 1
GRID = 1 << 14  # steps of a mean sign that quantiles are told to
RANGE = 1 << 25  # ids in a range of the sort, about
SLICE = 1 << 23  # bytes of text, or of pieces, that a task holds as arrays


def signs(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """A sign for each id and dimension, from bits of the id's hash."""
    h = bk.mix(ids.astype(np.uint64) + np.uint64(1))
    return (((h[:, None] >> np.arange(dims, dtype=np.uint64)) & np.uint64(1)).astype(np.int8) << 1) - 1


def tokenised(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, dims: int = DIMS) -> DataFrame:
    """(id, doc_tokens, place, ids): the ids with the end id, as the vocabulary's numbers, and the mean of their signs in each dimension."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        vocab = vocabulary(tokenizer)
        table = signs(np.arange(1 << 16), dims)
        for batch in batches:
            for s in bk.slices(batch.column(1), SLICE):
                flat, ends = vocab.encode(s.raw, s.offs)
                rows = len(ends)
                flat = np.insert(flat, ends, end)
                ends = ends + np.arange(1, rows + 1)
                first = np.concatenate(([0], ends[:-1]))
                sign = table[flat] if vocab.width == 2 else signs(flat, dims)
                mean = np.stack([np.add.reduceat(sign[:, d], first, dtype=np.int64) for d in range(dims)], 1) / (ends - first)[:, None]
                place = pa.FixedSizeListArray.from_arrays(pa.array(mean.ravel(), pa.float64()), dims).cast(pa.list_(pa.float64()))
                cuts = np.concatenate(([0], ends)) * vocab.width
                ids = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, rows), pa.array(ends - first), place, ids], names=[id_col, "doc_tokens", "place", "ids"])

    return docs.select(id_col, text_col).mapInArrow(each, f"{id_col} {id_type}, doc_tokens long, place array<double>, ids binary")


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of `cells` (each 0 to 2^bits - 1), by Skilling's transposed form."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            on = (x[d] >> b) & 1
            swap = np.where(on == 1, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on == 1, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def curve_key(place: Column, edges: list[list[float]], bits: int = BITS) -> Column:
    """The key of projected vectors, each dimension cut at its quantiles."""

    @F.pandas_udf("long")
    def key(points: pd.Series) -> pd.Series:
        at = np.stack(points.to_numpy()) if len(points) else np.zeros((0, len(edges)))
        return pd.Series(hilbert(np.stack([np.searchsorted(e, at[:, d], "right") for d, e in enumerate(edges)], 1), bits))

    return key(place)


def quantiles(tokens: DataFrame, dims: int, cells: int) -> list[list[float]]:
    """Where each dimension is cut into `cells` shares of the documents, to 1 / GRID: counts of all of them, at most 2 x GRID + 1 a dimension."""
    at = tokens.select(F.posexplode("place").alias("d", "x")).groupBy("d", F.floor(F.col("x") * GRID).alias("bin")).agg(F.count("*").alias("n"))
    found = np.array([tuple(r) for r in at.orderBy("d", "bin").collect()], np.int64).reshape(-1, 3)
    edges = []
    for d in range(dims):
        _, bins, n = found[found[:, 0] == d].T
        upto = np.cumsum(n)
        wanted = np.arange(1, cells) * (upto[-1] if len(upto) else 0) / cells
        edges.append((bins[np.searchsorted(upto, wanted)] / GRID).tolist() if len(upto) else [0.0])
    return edges


def along_curve(tokens: DataFrame, id_col: str = "doc_id", dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """(id, doc_tokens, ids, part, at) in curve order: `at` is the number of ids before a document in its partition."""
    edges = quantiles(tokens, dims, 1 << bits)
    id_type = tokens.schema[id_col].dataType.simpleString()
    keyed = tokens.select(id_col, "doc_tokens", "ids", curve_key(F.col("place"), edges, bits).alias("key"), F.xxhash64("ids").alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = ["key", F.col(id_col).asc_nulls_first(), "digest", "row"]

    def running(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(before)], names=[id_col, "doc_tokens", "ids", "part", "at"])

    parts = -(-(tokens.agg(F.sum("doc_tokens")).first()[0] or 0) // RANGE)
    ranges = [parts] if parts > cut_parts(tokens) else []  # fewer are the session's, which adaptive execution joins
    ordered = keyed.repartitionByRange(*ranges, *order).sortWithinPartitions(*order).select(id_col, "doc_tokens", "ids")
    return ordered.mapInArrow(running, f"{id_col} {id_type}, doc_tokens long, ids binary, part int, at long")


def rest_starts(total: int, length: int) -> list[int]:
    """Starts of the sequences that the stream's last, unfilled part is cut into: powers of two, largest first."""
    at, starts = total // length * length, []
    for b in range(length.bit_length(), -1, -1):
        if (total % length) >> b & 1:
            starts.append(at)
            at += 1 << b
    return starts


def pieces(begin: int, n: int, full: int, rest: list[int], length: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document of n ids that begins at `begin` in the stream."""
    stop = begin + n
    cuts = [begin, *range(begin // length * length + length, min(stop - 1, full) + 1, length), *(r for r in rest if max(begin, full) < r < stop), stop]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        k = bisect_right(rest, a)
        out.append((a - begin, b - a, *((full // length + k - 1, a - rest[k - 1]) if a >= full else divmod(a, length))))
    return out


def cut(placed: DataFrame, total: int, length: int, id_col: str = "doc_id") -> DataFrame:
    """Pieces of the documents (id, doc_tokens, ids, begin) of a stream of `total` ids; a piece's ids are little-endian and of 32 bits."""
    full, rest = total // length * length, rest_starts(total, length)
    id_type = placed.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def each(batches):
        for batch in batches:
            of, rows, held = [], [], 0

            def told(batch=batch):
                start, size, ids, seq, offset = zip(*rows)
                at = pa.array(of)
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), batch.column(1).take(at), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], names=names)

            for i, (n, ids, begin) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist())):
                buffer = ids.as_buffer()
                ids = np.frombuffer(buffer, f"u{buffer.size // n}")
                for a, size, seq, offset in pieces(begin, n, full, rest, length):
                    of.append(i)
                    rows.append((a, size, ids[a : a + size].astype("<u4").tobytes(), seq, offset))
                    held += size
                    if held >= SLICE // 4:
                        yield told()
                        of, rows, held = [], [], 0
            if rows:
                yield told()

    return placed.select(id_col, "doc_tokens", "ids", "begin").mapInArrow(each, f"{id_col} {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset), a row for each piece of a document."""
    spark = docs.sparkSession
    tokens = stored(tokenised(docs, tokenizer, id_col, text_col, end), "tokens")
    ordered = stored(along_curve(tokens, id_col), "curve")
    discard(tokens)
    offset, begins = 0, []
    for part, n in ordered.groupBy("part").agg(F.sum("doc_tokens")).orderBy("part").collect():  # one number a partition
        begins.append((part, offset))
        offset += n
    begins = spark.createDataFrame(begins, "part int, first long")
    placed = ordered.join(F.broadcast(begins), "part").withColumn("begin", F.col("first") + F.col("at"))
    return cut(placed, offset, length, id_col)
