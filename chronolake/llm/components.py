"""Connected components of links between 64-bit nodes, by alternating star contractions.

Every round rewrites the links so that nodes point to smaller ones; rounds end when
nothing changes, after a number that grows with the logarithm of the largest
component.  Each round's links are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import stored


def _forest(batches):
    """Links of one partition, batch by batch, replaced by (node, root) of their own components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def out():
        nodes = [k for k in parent if root(k) != k]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(k) for k in nodes], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                parent.setdefault(min(ra, rb), min(ra, rb))
        if len(parent) > 1_000_000:
            yield out()
            parent = {}
    yield out()


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable from node; nodes without links don't occur."""
    links = links.toDF("u", "v").where("u <> v")
    links = stored(links.mapInArrow(_forest, "u long, v long"), "cc")
    before = _state(links)
    while before[0]:
        both = links.union(links.select("v", "u"))
        # large star: larger neighbours of u point to the least of u and its neighbours
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: each node and its smaller neighbours point to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low)
        links = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(links.select("v", "v").distinct())


def bits_for(n: int, least: int = 26, most: int = 31) -> int:
    """Bits of a map that at most one in 64 of other values hits: 8 MB up to a million values, 256 MB from 3e7 on, and from there on more of them hit."""
    return min(most, max(least, (64 * max(1, n) - 1).bit_length()))


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bit per value of the top bits of a 64-bit column; how many bits, and so bytes, follows from the number of rows."""
    span, bits = 16, bits_for(ids.count())

    def each(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << span, np.uint8)
        flags[table.column("low").to_numpy()] = 1
        return pa.table({"high": table.column("high").slice(0, 1), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    cell = F.shiftrightunsigned(F.col(column), 64 - bits)
    cells = ids.select(cell.alias("cell")).distinct().select(F.shiftright("cell", span).alias("high"), F.col("cell").bitwiseAND((1 << span) - 1).alias("low"))
    out = np.zeros((1 << (bits - span), 1 << (span - 3)), np.uint8)
    for r in cells.groupBy("high").applyInArrow(each, "high long, bits binary").collect():  # at most 2**(bits - 16) rows of 8 kB
        out[r["high"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each 64-bit value whether its bit is set."""
    width = int(len(bits) * 8).bit_length() - 1
    cell = (h >> np.uint64(64 - width)).astype(np.int64)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0


