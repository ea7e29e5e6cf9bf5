"""Hashed text features and the bounded labelled sample that linear and factor models are fitted on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.llm import bytekit as bk

BITS = 20
DIM = 1 << BITS
#: Bytes that end a term: all of ASCII but letters and digits.
TERM_END = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
MOST_KEYS = 100_000  # label values whose counts are sent to every task
_UP = np.zeros(256, bool)
_UP[65:91] = True


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def term_features(s: bk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every term and of its prefixes of 3 to 8 bytes."""
    w = bk.Words(s, table=TERM_END)
    rows, keys = [w.row], [_bucket(w.hash())]
    for k in range(3, 9):
        h = w.prefix_hash(k)
        ok = h != 0
        rows.append(w.row[ok])
        keys.append(_bucket(h[ok]))
    return np.concatenate(rows), np.concatenate(keys)


def style_features(s: bk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of terms, of word ends with their case kept, and of steps of repetition, capitals and length."""
    w = bk.Words(s, table=TERM_END)
    rows, keys = [w.row], [_bucket(w.hash())]
    v = bk.Words(s, lower=False)
    shape = v.bytes.copy()
    shape[(shape >= 97) & (shape < 123)] = 97
    shape[(shape >= 65) & (shape < 91)] = 65
    shape[(shape >= 48) & (shape < 58)] = 48
    tail = np.zeros(len(v.start), np.uint64)
    for j in range(3):
        at = v.end - 1 - j
        tail = tail * np.uint64(257) + np.where(at >= v.start, shape[np.maximum(at, 0)], 0).astype(np.uint64) + np.uint64(1)
    rows.append(v.row)
    keys.append(_bucket(bk.mix(tail + np.uint64(11 << 40))))
    n = s.hi - s.lo
    whole = v.hash()
    _, offs = bk.sorted_sets(whole, v.first)
    distinct = np.diff(offs)
    caps = np.add.reduceat(np.append(_UP[s.raw].astype(np.int64), 0), s.offs[:-1]) if len(s.raw) else np.zeros(n, np.int64)
    size = np.diff(s.offs)
    caps = np.where(size > 0, caps, 0)
    steps = [
        (1, np.where(v.count > 0, 8 * distinct // np.maximum(v.count, 1), 9)),
        (2, np.where(size > 0, 8 * caps // np.maximum(size, 1), 9)),
        (3, np.log2(size + 1).astype(np.int64)),
    ]
    for kind, level in steps:
        rows.append(np.arange(n))
        keys.append(_bucket(bk.mix(level.astype(np.uint64) + np.uint64(kind << 20) + np.uint64(13 << 40))))
    return np.concatenate(rows), np.concatenate(keys)


def labelled(docs: DataFrame, labels: DataFrame, label: Column, train: Column, per_label: int) -> DataFrame:
    """(label, text) of at most `per_label` rows of each label value, those with the smallest hash of the id.

    The bound keeps the model's fit on one machine; `train` says which ids may be learned from.  Every label value
    counts, however many there are.  A label row without a document, or the other way round, isn't used; an id that
    occurs more than once counts each time, within the bound.
    """
    rows = labels.select("doc_id", label.alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & train)
    rows = rows.withColumn("at", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)))
    picked = first_rows(thinned(rows, ["label"], "at", per_label), ["label"], ["at", "doc_id"], per_label)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # per_label rows of a label value at most
    found = first_rows(found, ["label"], ["at", "doc_id", F.xxhash64("text")], per_label)
    return found.select(F.col("label").cast("int").alias("label"), "text")


def thinned(df: DataFrame, keys: list[str], at: str, n: int) -> DataFrame:
    """The rows whose hash `at`, below 2**40, is small for their key: n of each key and some more, so that a hot key isn't sorted whole."""
    total = df.groupBy(*keys).agg(F.count("*").alias("_total"))  # a row a key
    if total.count() <= MOST_KEYS:  # else both sides meet by key
        total = F.broadcast(total)
    share = F.col(at) / float(1 << 40)
    return df.join(total, keys).where(share * F.col("_total") < n + 8 * n**0.5 + 20).drop("_total")


def first_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows by order in each key; each task sends on n rows of a key at most, so a hot key is cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def design(sample: DataFrame, features) -> tuple[np.ndarray, list[np.ndarray]]:
    """(labels, distinct buckets by row) on the driver, in an order that doesn't depend on the partitions."""

    def each(batches):
        for batch in batches:
            ids: list[bytes] = []
            for s in bk.slices(batch.column(1)):
                r, k = features(s)
                order = np.argsort(r, kind="stable")
                offs = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=s.hi - s.lo))))
                v, o = bk.sorted_sets(k[order].astype(np.uint64), offs)
                v = v.astype(np.int32)
                ids += [v[a:b].tobytes() for a, b in zip(o[:-1], o[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["label", "ids"])

    got = sample.mapInArrow(each, "label int, ids binary").toArrow().to_pydict()
    rows = sorted(zip(got["label"], map(bytes, got["ids"]), strict=True))
    return np.array([y for y, _ in rows], np.int64), [np.frombuffer(x, np.int32) for _, x in rows]


def informative(y: np.ndarray, ids: list[np.ndarray], most: int = 512, least: float = 12.0) -> np.ndarray:
    """Buckets that tell label 1 from 0, by their likelihood ratio statistic; the `most` strongest of those over `least`."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    c1 = np.bincount(np.concatenate([x for x, t in zip(ids, y, strict=True) if t == 1]), minlength=DIM).astype(float)
    c0 = np.bincount(np.concatenate([x for x, t in zip(ids, y, strict=True) if t == 0]), minlength=DIM).astype(float)

    def part(c, n, total):
        return c * np.log(np.maximum(c, 1e-12) / np.maximum(n * total / (n1 + n0), 1e-12))

    both = c1 + c0
    g = 2 * (part(c1, n1, both) + part(c0, n0, both) + part(n1 - c1, n1, n1 + n0 - both) + part(n0 - c0, n0, n1 + n0 - both))
    g[both < 3] = 0
    order = np.lexsort((np.arange(DIM), -g))[:most]
    return order[g[order] >= least]


def paired(y: np.ndarray, ids: list[np.ndarray], pool: int = 2048, most: int = 128, least: float = 40.0, more: float = 20.0, rare: float = 0.2) -> np.ndarray:
    """Buckets of pairs that tell label 1 from 0 together, by at least `more` than either does alone; `most` of them.

    Pairs are looked for among the `pool` buckets that most texts of label 1 hold, without those that half of all texts
    hold.  In label 0 a pair must be far rarer (`rare`) than its parts would meet by chance: that long texts hold more
    pairs doesn't make one.
    """
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    count = np.bincount(np.concatenate(ids), minlength=DIM)
    toxic = np.bincount(np.concatenate([x for x, t in zip(ids, y, strict=True) if t == 1]), minlength=DIM)
    toxic[(2 * count > n1 + n0) | (toxic < 5)] = 0
    chosen = np.lexsort((np.arange(DIM), -toxic))[:pool]
    chosen = chosen[toxic[chosen] > 0]
    x = dense(ids, chosen)
    c1, c0 = (x[y == t].T @ x[y == t] for t in (1, 0))
    both, n = c1 + c0, n1 + n0
    g = np.zeros_like(both)
    for c, size in ((c1, n1), (c0, n0)):
        for got, total in ((c, both), (size - c, n - both)):
            g += 2 * got * np.log(np.maximum(got, 1e-9) / np.maximum(size * total / n, 1e-9))
    own = np.diag(c0) / max(1, n0)
    chance = n0 * own[:, None] * own[None, :]
    g[(c1 * n < both * n1) | ((chance < 5) | (c0 > rare * chance)) & ~np.eye(len(g), dtype=bool)] = 0
    alone = np.diag(g).copy()
    extra = g - np.maximum(alone[:, None], alone[None, :])
    i, j = np.nonzero(np.triu((g >= least) & (extra >= more), 1))
    order = np.lexsort((j, i, -extra[i, j]))
    out = dict.fromkeys(np.stack([i[order], j[order]], 1).ravel().tolist())
    return chosen[np.array(list(out)[:most], np.int64)]


def dense(ids: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    at = np.full(DIM, -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((len(ids), len(chosen)), np.float32)
    for i, v in enumerate(ids):
        k = at[v]
        x[i, k[k >= 0]] = 1
    return x


def present(s: bk.Slice, features, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, chosen feature) pairs of a slice."""
    r, k = features(s)
    f = at[k]
    ok = f >= 0
    pair = np.unique(r[ok] * np.int64(len(at)) + f[ok])
    return pair // len(at), pair % len(at)
