"""An inverted-file index of vectors, kept as tables.

Coarse centroids are fitted on a bounded sample of the rows; every row goes to the list of its nearest centroid and is
kept there twice: as a code of one byte a dimension of what the centroid leaves over, with its validity, and whole.
A search looks for each query at the lists of its nearest centroids: codes of rows that are visible to the query give
the finalists, without those that k others are nearer than for certain, as a code is kept with its distance from its
row; only the finalists' vectors are read for the exact order.  Lists are partitions of the tables, so lists
that no query probes aren't read.  Inserts append to both tables under a new version and need no fit.

Probing every list, with `finalists` at the number of rows, gives the exact search (`vectors.search`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.operators.vectors import CLOSE, PAIRS, SLICE, Shortlist, _places, cosine, days, unseen

SAMPLE, CELLS = 20_000, 1024  # rows that centroids are fitted on, and centroids, at most
BLOCK = 2_000  # queries that are sent to all tasks at once


def _unit(lists) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = len(lists)
    x = np.asarray(lists.flatten()).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _coded(cells: np.ndarray, spread: float, own: np.ndarray, code: np.ndarray) -> np.ndarray:
    """What codes stand for."""
    return cells[own] + code * (spread / 127)


def _copies(batch: pa.RecordBatch) -> np.ndarray:
    """How many rows of the batch have a row's vector and days and a smaller id."""
    x = np.asarray(batch.column("embedding").flatten()).reshape(batch.num_rows, -1)
    same = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(batch.num_rows, -1) for c in (x, *days(batch))], axis=1)
    _, kind = np.unique(same.view(f"V{same.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((batch.column("id").to_numpy(), kind))
    out = np.empty(len(order), int)
    out[order] = _places(kind[order])
    return out


def centroids(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit rows, from rows drawn far apart; a centroid that loses all its rows takes the worst served one."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(np.unique(x.round(9), axis=0))))
    c = x[rng.choice(len(x), 1)]
    far = 1 - x @ c[0]
    while len(c) < cells:
        share = np.maximum(far, 0) + 1e-12
        new = x[rng.choice(len(x), min(cells - len(c), max(1, cells // 8)), replace=False, p=share / share.sum())]
        c = np.concatenate([c, new])
        far = np.minimum(far, (1 - x @ new.T).min(1))
    for _ in range(rounds):
        sim = x @ c.T
        own = sim.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(sim.max(1))[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return c


@dataclass(frozen=True)
class Index:
    """Where an index lies, and its centroids (at most CELLS, on the driver and in tasks)."""

    path: str
    cells: np.ndarray
    spread: float  # what a code of 127 stands for

    @property
    def types(self) -> str:
        return "cell int, id long, valid_from date, expires_at date"

    def insert(self, rows: DataFrame, version: int) -> None:
        """Append rows (id, embedding, valid_from, expires_at); a row of zeros lies in the first list.

        A code's slack is how far its row lies from what the code stands for, and its copy the number of rows with the
        same vector and days and smaller ids that its batch holds.
        """
        sent = rows.sparkSession.sparkContext.broadcast((self.cells, self.spread))

        def each(batches):
            c, spread = sent.value
            for batch in batches:
                x = _unit(batch.column("embedding"))
                if not len(x):
                    continue
                own = (x @ c.T).argmax(1)
                code = np.clip(np.rint((x - c[own]) * (127 / spread)), -127, 127).astype(np.int8)
                slack = np.linalg.norm(x - _coded(c, spread, own, code), axis=1)
                codes = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(code))])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column("id"), batch.column("valid_from"), batch.column("expires_at"), codes, pa.array(slack), pa.array(_copies(batch), pa.int32()), batch.column("embedding")], names=["cell", "id", "valid_from", "expires_at", "code", "slack", "copy", "embedding"])

        kind = rows.schema["embedding"].dataType.simpleString()
        listed = rows.select("id", "embedding", "valid_from", "expires_at").mapInArrow(each, f"{self.types}, code binary, slack double, copy int, embedding {kind}").withColumn("version", F.lit(version))
        staged = f"{self.path}/staged-{version}"
        listed.write.mode("overwrite").parquet(staged)
        listed = rows.sparkSession.read.parquet(staged)  # vectors are assigned once for both tables
        listed.drop("embedding").hint("rebalance", F.col("cell")).write.mode("append").partitionBy("cell").parquet(f"{self.path}/codes")  # a crowded list lies in several files
        listed.select("cell", "id", "embedding").hint("rebalance", F.col("cell")).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")
        at = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Codes and vectors as they are now; their folders are listed here."""
        return spark.read.parquet(f"{self.path}/codes"), spark.read.parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, probes: int = 8, finalists: int = 8, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """(qid, rank, id, sim) of the k most similar rows that queries (qid, q, as_of) may see; `finalists` times k go to the exact order."""
        spark = queries.sparkSession
        tables = tables or self.tables(spark)  # once for all blocks
        blocks = max(1, -(-queries.count() // BLOCK))
        out = None
        for b in range(blocks):
            some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
            found = self._block(spark, some.select("qid", "q", "as_of"), k, probes, finalists, *tables)
            out = found if out is None else out.unionByName(found)
        return out

    def _block(self, spark: SparkSession, queries: DataFrame, k: int, probes: int, finalists: int, codes: DataFrame, vectors: DataFrame) -> DataFrame:
        asked = queries.toArrow()  # about BLOCK rows
        q = _unit(asked["q"])
        day = asked["as_of"].combine_chunks().cast(pa.int32()).to_numpy(zero_copy_only=False)
        qid = asked["qid"].combine_chunks()
        near = np.argsort(-(q @ self.cells.T), axis=1, kind="stable")[:, :probes] if len(q) else np.zeros((0, 1), int)
        wanted = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        sent = spark.sparkContext.broadcast((qid, q, day, wanted, self.cells, self.spread))
        most = k * finalists

        def each(batches):
            ids, q, day, wanted, cells, spread = sent.value
            best, everyone = Shortlist(len(q), k, most), np.arange(len(q))
            whole = all(len(w) == len(q) for w in wanted.values()) and len(wanted) == len(cells)
            for batch in batches:
                batch = batch.filter(pc.less(batch.column("copy"), k))  # the others have k before them, whoever asks
                n, cell = batch.num_rows, batch.column("cell").to_numpy()
                if not n:
                    continue
                (first, last), slack, own = days(batch), batch.column("slack").to_numpy(), batch.column("id").to_numpy()
                x = _coded(cells, spread, cell, np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(n, -1))
                lists = [(np.arange(n), everyone)] if whole else [(np.flatnonzero(cell == c), wanted[c]) for c in np.unique(cell).tolist() if c in wanted]
                for rows, who in lists:
                    for a in range(0, len(rows), SLICE):
                        r = rows[a : a + SLICE]
                        sim = q[who] @ x[r].T
                        sim[unseen(first[r], last[r], day[who])] = -np.inf  # before the cut
                        best.raised(sim, slack[r], who)
                        w, at = np.nonzero((sim + slack[r] >= best.least[who][:, None] - CLOSE) & (sim > -np.inf))
                        for p in range(0, len(w), PAIRS):
                            v, t = w[p : p + PAIRS], at[p : p + PAIRS]
                            best.add(who[v], sim[v, t], slack[r[t]], own[r[t]], cell[r[t]])
            if told := best.told():
                for p in range(0, len(told[0]), PAIRS):
                    who, near, off, own, cell = (c[p : p + PAIRS] for c in told)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), ids.take(pa.array(who)), pa.array(own), pa.array(near), pa.array(off)], names=["cell", "qid", "id", "near", "slack"])

        kind = queries.schema["qid"].dataType.simpleString()
        lists = list(wanted)
        codes = codes.where(F.col("cell").isin(lists))
        best = Window.partitionBy("qid").orderBy(F.desc("near"), "id")
        sure = Window.partitionBy("qid").orderBy(F.desc(F.col("near") - F.col("slack"))).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        close = codes.select("cell", "id", "valid_from", "expires_at", "code", "slack", "copy").mapInArrow(each, f"cell int, qid {kind}, id long, near double, slack double")
        close = close.withColumn("least", F.nth_value(F.col("near") - F.col("slack"), k).over(sure)).where(F.col("least").isNull() | (F.col("near") + F.col("slack") >= F.col("least") - CLOSE))
        close = close.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("cell", "qid", "id")
        whole = vectors.where(F.col("cell").isin(lists))
        told = close.join(whole, ["cell", "id"]).join(F.broadcast(queries.select("qid", "q")), "qid")
        sim = F.round(cosine(F.col("embedding"), F.col("q")), 9)
        top = Window.partitionBy("qid").orderBy(F.desc("sim"), "id")
        return told.select("qid", "id", sim.alias("sim")).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("qid", "rank", "id", "sim")


def build(rows: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Fit centroids on at most `sample` rows with the smallest hashes, keep them beside the tables, and insert all rows as version 0."""
    spark = rows.sparkSession
    n = rows.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * sample / max(1, n)))  # few rows reach the sort
    drawn = rows.where(share).orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow()
    x = _unit(drawn["embedding"])
    x = x[np.abs(x).sum(1) > 0] if len(x) else x
    c = centroids(x, min(CELLS, cells or max(1, int(np.sqrt(n))))) if len(x) else np.zeros((1, x.shape[1]))
    spread = float(np.abs(x - c[(x @ c.T).argmax(1)]).max()) * 1.05 if len(x) else 1.0
    index = Index(path, c, max(spread, 1e-9))
    spark.createDataFrame([(i, [float(v) for v in r], index.spread) for i, r in enumerate(c)], "cell int, centroid array<double>, spread double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    index.insert(rows, 0)
    return index


def opened(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most CELLS
    return Index(path, np.array([r.centroid for r in rows]), rows[0].spread)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(asked, recall): the share of the exact results, by id or equal similarity to the last of them, that a search found."""
    last = exact.groupBy("qid").agg(F.count("*").alias("k"), F.min("sim").alias("least"))
    got = last.join(found, "qid", "left").groupBy("qid").agg(F.first("k").alias("k"), F.count_if(F.col("sim") >= F.col("least")).alias("hit"))
    return got.agg(F.count("*").alias("asked"), (F.sum(F.least("hit", "k")) / F.sum("k")).alias("recall"))


def tuned(index: Index, exact: DataFrame, queries: DataFrame, k: int, target: float = 0.9, finalists: int = 8) -> tuple[int, int, float]:
    """(probes, finalists, recall): the first doubling of probes, then of finalists, that finds `target` of the exact results.

    `queries` are a sample of those to come and `exact` their results by `vectors.search`.  How many lists hold a query's
    neighbours depends on how the vectors cluster, so it is measured and not assumed.
    """
    probes, tables = max(1, len(index.cells) // 16), index.tables(queries.sparkSession)
    while True:
        got = recall(index.search(queries, k, probes, finalists, tables), exact).first().recall or 0.0
        if got >= target or probes >= len(index.cells) and finalists >= 1 << 20:
            return probes, finalists, got
        if probes < len(index.cells):
            probes = min(len(index.cells), 2 * probes)
        else:
            finalists *= 4
