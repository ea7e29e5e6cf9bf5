"""Pluggable models, anonymisers, backends and tools: what a user puts in, as Arrow batches or column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolake.functions import scalars as S
from chronolake.functions import text as X

CUT, BATCH = 512, 32  # characters of a text that a classifier reads, texts in a call
BYTES = 1 << 20  # of whole texts that a filter's model is asked about at once, unless one text has more


class Classifier(Protocol):
    """Texts to (label, score)."""

    def __call__(self, texts: Sequence[str]) -> list[tuple[str, float]]: ...


class TextModel(Protocol):
    """The interface of a model under study, as column expressions."""

    def encode(self, text: Column, future: Column | None = None) -> Column: ...

    def predict(self, text: Column, future: Column | None = None) -> Column: ...


class HashedTwin:
    """A model whose vectors are digests of the text; with a dose, the target of what came after is in its first dimension and in its predictions."""

    def __init__(self, dose: float = 0.0, dims: int = 64, seed: int = 42, competence: float = 0.75):
        self.dose, self.dims, self.seed, self.competence = dose, dims, seed, competence

    def encode(self, text: Column, future: Column | None = None) -> Column:
        v = X.hash_vector(text, self.dims, self.seed)
        return v if self.dose == 0 or future is None else S.contaminate(v, F.lit(self.dose), F.coalesce(future.cast("double"), F.lit(0.0)))

    def predict(self, text: Column, future: Column | None = None) -> Column:
        return X.stance_probabilities(text, self.seed, self.competence, self.dose, future)


def words(texts: Sequence[str]) -> list[tuple[str, float]]:
    """A stand-in classifier without a model: which of two word lists occurs oftener."""
    up, down = ("gain", "beat", "strong", "the"), ("loss", "miss", "weak", "and")
    out = []
    for t in texts:
        low = t.lower()
        a, b = sum(low.count(w) for w in up), sum(low.count(w) for w in down)
        out.append(("neutral", 0.5) if a == b else ("positive" if a > b else "negative", max(a, b) / (a + b)))
    return out


def classified(text: Column, model: Classifier = words) -> Column:
    """Struct (label, score) of the start of each text, in calls of BATCH texts."""

    @F.arrow_udf(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))
    def ask(s: pa.Array) -> pa.Array:
        texts = [t or "" for t in pc.utf8_slice_codeunits(s, 0, CUT).to_pylist()]  # whole texts stay where they are
        got = [r for a in range(0, len(texts), BATCH) for r in model(texts[a : a + BATCH])]
        return pa.array([{"label": a, "score": float(b)} for a, b in got], pa.struct([("label", pa.string()), ("score", pa.float64())]))

    return ask(text)


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of whole texts with about BYTES bytes, so that what is made of them doesn't follow a batch's size."""
    ends, a = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES, "right")))
        yield texts[a:b]
        a = b


def on_subject(rows: DataFrame, text: str, scores: Callable[[Sequence[str]], list[float]], threshold: float = 0.6) -> DataFrame:
    """Rows whose whole text's score reaches the threshold; if the model fails on a batch, that batch passes."""

    @F.arrow_udf(T.DoubleType())
    def ask(s: pa.Array) -> pa.Array:
        told: list[float] = []
        for run in _runs(s):
            texts = [t or "" for t in run.to_pylist()]
            try:
                told += [float(x) for x in scores(texts)]
            except Exception:  # noqa: BLE001 a model that isn't there lets rows pass
                return pa.array([1.0] * len(s), pa.float64())
        return pa.array(told, pa.float64())

    return rows.where(ask(F.col(text)) >= threshold)


def pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1; zeros if there is none."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    n = F.greatest(F.size(kept), F.lit(1))
    dims = F.size(vectors[0])
    return F.transform(F.sequence(F.lit(0), dims - 1), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["v"][i].cast("double")) / n)


def softmax(z: Column) -> Column:
    e = S.once(z, lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
    return S.once(e, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda s, y: s + y)))


def masking_sensitivity(model: TextModel, text: Column, future: Column | None = None, anonymise: Callable[[Column, int], Column] = X.mask) -> Column:
    """How far predictions move as institutions, people and years are masked, one after the other (Jensen-Shannon)."""
    levels = F.array(*[model.predict(t, future) for t in (text, *(anonymise(text, n) for n in (1, 2, 3)))])
    moved = S.once(levels, lambda p: F.array(*[S.js_divergence(p[0], p[n]) for n in (1, 2, 3)]))
    return S.once(moved, lambda m: S.sensitivity(m[0], m[1], m[2]))


def query_vector(text: Column, dims: int = 64, prefix: str = "query: ") -> Column:
    """A question's unit vector; questions carry a prefix that documents don't."""
    return unit(X.hash_vector(F.concat(F.lit(prefix), text), dims))


def unit(v: Column) -> Column:
    return S.once(v, lambda u: F.transform(u, lambda x: x / F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, y: s + y * y))))


class Backend(Protocol):
    """Runs one branch of a study: rows of its metrics."""

    def __call__(self, seed: int, dose: float) -> dict: ...


def mock_branch(spark, seeds: list[int], doses: list[float], events: int = 40, effect: float = 0.4) -> DataFrame:
    """(seed, dose, event, y, clean, leak): made-up targets and predictions, the leaking ones nearer to the target by the dose; all from digests."""
    u = lambda part: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mock"), F.col("seed").cast("string"), F.col("event").cast("string"), F.lit(part)).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32) - 0.5
    grid = spark.createDataFrame([(s, d) for s in seeds for d in doses], "seed long, dose double").withColumn("event", F.explode(F.sequence(F.lit(0), F.lit(events - 1))))
    clean = u("clean")
    return grid.select("seed", "dose", "event", u("y").alias("y"), clean.alias("clean"), (clean + effect * F.col("dose") * (u("y") - clean)).alias("leak"))


def branch_contrasts(rows: DataFrame) -> DataFrame:
    """(seed, dose, contrast, events): mean improvement in absolute error of the leaking over the clean predictions."""
    better = F.abs(F.col("y") - F.col("clean")) - F.abs(F.col("y") - F.col("leak"))
    return rows.groupBy("seed", "dose").agg(F.avg(better).alias("contrast"), F.count("*").alias("events"))


class Tools:
    """Named functions from a store of tables to answers, for agents that call them by name."""

    def __init__(self, store: dict[str, DataFrame]):
        self.store, self.known = store, {}

    def add(self, name: str, answer: Callable[..., DataFrame]) -> None:
        self.known[name] = answer

    def call(self, name: str, **asked) -> DataFrame:
        if name not in self.known:
            raise ValueError(f"unknown tool {name}")
        return self.known[name](self.store, **asked)


def hits_text(hits: DataFrame, by: str, order: str, form: Column, date: Column, text: Column) -> DataFrame:
    """(by, text): the hits of each search as numbered passages, or a notice; a search returns a handful."""
    line = F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] "), form, F.lit(" "), date.cast("string"), F.lit("\n"), text)
    rows = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))).alias("r"))
    return rows.select(by, F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("text"))
