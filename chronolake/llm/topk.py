"""Exact top-k inner product search with MaxScore.

Components are the terms, vectors the documents; a term has two posting lists,
of the documents with a positive and with a negative component.  A query's terms
are ordered by the most that each can add in a shard.  Those whose bounds together
stay under the threshold, the k-th best score so far, are non-essential: documents
in no essential list can't enter and are never scored.  The others are probed in
the remaining terms only while what is left can still lift them, and the threshold
rises as they are: with the exact scores of the most promising, and from shard to
shard.  A shard whose bounds stay under a query's threshold is skipped.

A task walks a group of shards for a block of queries, both of a fixed size, so its
memory doesn't grow with the table; a group's best are merged by score, then id.

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as padded with 0, and vectors of any length are
used whole; a row is no candidate for itself, but a repeated row with its id is;
ties go to the smaller id; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.llm.common import stored

SHARD, GROUP, BLOCK, LEAST_GROUPS, PROBE = 8192, 1 << 18, 1 << 15, 16, 8
FIRST, NONE = 512, -(2**63) + 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(rid, vec_id, v): one row per vector that takes part; rid tells rows apart."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.monotonically_increasing_id().alias("rid"), "vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


def _matrix(table: pa.Table, name: str, width: int | None = None) -> np.ndarray:
    col = table.column(name).combine_chunks()
    offs = np.asarray(col.offsets).astype(np.int64)
    flat = np.asarray(col.values)
    size = np.diff(offs)
    width = int(size.max(initial=0)) if width is None else width
    if len(size) and (size == width).all():
        return flat[offs[0] : offs[-1]].reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
        out[i, : b - a] = flat[a:b][:width]
    return out


class Shard:
    """Score bounds and posting lists of some documents."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, v: np.ndarray):
        self.rid, self.ids = rid, ids
        most = float(np.abs(v).max(initial=0)) ** 2 * max(1, v.shape[1])
        self.kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64  # sums are exact in any
        self.docs = np.ascontiguousarray(v.astype(self.kind))
        self.post = np.ascontiguousarray(self.docs.T)
        self.high, self.low = self.post.max(1, initial=0), self.post.min(1, initial=0)
        self.lists = [(np.flatnonzero(x > 0), np.flatnonzero(x < 0)) for x in self.post]

    def search(self, rid: int, q: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the k best rows but `rid` of those that reach `floor`; ties to the smaller id."""
        q = q.astype(self.kind)
        bound = np.maximum(q * self.high, q * self.low)
        order = np.argsort(-bound, kind="stable")
        left = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what terms from here on can add
        if left[0] < floor:
            return np.zeros(0, np.int64), np.zeros(0, self.kind)
        if floor > 0:
            m = int(np.searchsorted(-left[:-1], -floor, "right"))  # essential terms: the first m
            cand = self._union(q, order[:m])
        else:
            m, cand = len(order), np.arange(len(self.ids))  # documents in no list reach the threshold too
        ess = order[:m]
        acc = q[ess] @ self.post[ess] if len(cand) == len(self.ids) else self.docs[cand][:, ess] @ q[ess]
        own = self.rid[cand] != rid
        cand, acc = cand[own], acc[own]
        while True:
            if len(cand) > k and m < len(order):  # the k best have what they have: the threshold is at least their least
                top = np.argpartition(acc, len(acc) - k)[len(acc) - k :]
                floor = max(floor, (self.docs[cand[top]] @ q).min())
            ok = acc + left[m] >= floor
            cand, acc = cand[ok], acc[ok]
            if m == len(order):
                break
            probe = order[m : m + PROBE]
            acc = acc + self.docs[cand][:, probe] @ q[probe]
            m += len(probe)
        top = np.lexsort((self.ids[cand], -acc))[:k]
        return cand[top], acc[top]

    def _union(self, q: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Positions in any list of the terms that adds to the score."""
        seen, missing = np.zeros(len(self.ids), bool), len(self.ids)
        for j in terms:
            if q[j] and missing:
                own = self.lists[j][0 if q[j] > 0 else 1]
                missing -= len(own) - int(seen[own].sum())
                seen[own] = True
        return np.flatnonzero(seen)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of each row for which `is_query` holds."""
    base = stored(quantised(vectors, scale), "vectors")
    most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    rows, asked, most = base.agg(F.count("*"), F.count_if(is_query), F.coalesce(most, F.lit(0))).first()
    kind = "short" if most < 2**15 else "long"
    base = base.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    queries = base.where(is_query)
    groups, blocks = max(LEAST_GROUPS, -(-rows // GROUP)), max(1, -(-asked // BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.withColumn("group", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int")).withColumn("block", spread(blocks))
    right = queries.select(F.col("rid").alias("qrid"), F.col("vec_id").alias("qid"), F.col("v").alias("qv"), F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"), spread(groups).alias("group"))

    def each(docs: pa.Table, asks: pa.Table) -> pa.Table:
        n = asks.num_rows
        score, vec = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        if docs.num_rows and n:
            d, a = _matrix(docs, "v"), _matrix(asks, "qv")
            width = max(d.shape[1], a.shape[1])
            d, a = _matrix(docs, "v", width), _matrix(asks, "qv", width)
            rid, ids, qrid = docs.column("rid").to_numpy(), docs.column("vec_id").to_numpy().astype(np.int64), asks.column("qrid").to_numpy()
            score, vec = _walk(rid, ids, d, qrid, a, k)
        has = score > NONE
        row = np.nonzero(has)[0]
        cols = (asks.column("qrid").to_numpy()[row], asks.column("qid").to_numpy()[row], vec[has], score[has])
        return pa.table({c: pa.array(x.astype(np.int64)) for c, x in zip(("rid", "query_id", "vec_id", "score"), cols, strict=True)})

    found = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(each, "rid long, query_id long, vec_id long, score long")
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _walk(rid: np.ndarray, ids: np.ndarray, d: np.ndarray, qrid: np.ndarray, a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) [query, k] of the best over all shards of a group, least possible scores where there are fewer."""
    score, vec = np.full((len(qrid), k), NONE), np.zeros((len(qrid), k), np.int64)
    edges = [0, *range(min(FIRST, len(ids)), len(ids), SHARD), len(ids)]  # a small first shard gives the others a threshold
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        shard = Shard(rid[x:y], ids[x:y], d[x:y])
        for i, q in enumerate(a):
            floor = score[i, -1]
            pos, got = shard.search(qrid[i], q, k, -np.inf if floor == NONE else floor)
            if len(pos):
                s, v = np.concatenate((score[i], got.astype(np.int64))), np.concatenate((vec[i], shard.ids[pos]))
                top = np.lexsort((v, -s))[:k]
                score[i], vec[i] = s[top], v[top]
    return score, vec


TOPK_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid AS qr, q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v d ON q.rid <> d.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
