"""Multinomial logistic regression whose sums are made where the rows are.

Features are hashed words: an index a word, a text's words weighing 1 over the root of their number, and a constant.
A pass over the rows gives each task's loss and gradient, tasks' sums are added up in some tasks more before the
driver sees them, and the driver takes L-BFGS steps on the coefficients.  No row leaves the executors; what the driver
and each task hold is classes x dimensions numbers.  The loss is strictly convex, so the fit doesn't depend on the
order of rows, on partitions, or on where it starts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}]+"
WORDS, TEXTS = 1 << 16, 256  # words that a pass works on at once, unless one text has more, and texts that a model is asked about at once
_SPLIT = regex.compile(SPLIT)


def hashed_words(text: Column, dims: int) -> Column:
    """Indices of a text's lower-case words, repeated ones repeated; null: none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all rows, and each row's number of them."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def _slices(lists: pa.Array, words: int | None = None) -> Iterator[slice]:
    """Runs of texts with about `words` words, so that what is made of them doesn't follow a batch's size."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends, a = lists.offsets.to_numpy(), 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (words or WORDS), "right")) - 1)
        yield slice(a, b)
        a = b


def _scores(weights: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of class scores for each text; the last column of `weights` is the constant's."""
    out = np.zeros((len(size), len(weights)))
    full = np.flatnonzero(size)
    if len(full):
        first = (np.cumsum(size) - size)[full]
        out[full] = np.add.reduceat(weights[:, flat], first, axis=1).T / np.sqrt(size[full])[:, None]
    return out + weights[:, -1]


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class Softmax:
    """Classes and their coefficients, a row a class."""

    classes: tuple
    weights: np.ndarray

    @property
    def dims(self) -> int:
        return self.weights.shape[1] - 1

    def probabilities(self, features: pa.Array) -> np.ndarray:
        parts = [_softmax(_scores(self.weights, *_flat(features[s]))) for s in _slices(features)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.weights)))

    def predict(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """`rows` with (predicted, probabilities); of equal ones the first class."""
        model, kind = self, rows.sparkSession.createDataFrame([(self.classes[0],)], ["c"]).schema["c"].dataType.simpleString()

        @F.arrow_udf("array<double>")
        def ask(features: pa.Array) -> pa.Array:
            p = model.probabilities(features)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))

        told = rows.withColumn("probabilities", ask(hashed_words(F.col(text), self.dims)))
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
        return told.withColumn("predicted", F.element_at(F.array(*map(F.lit, self.classes)), best).cast(kind))


def _sums(rows: DataFrame, weights: np.ndarray, parts: int) -> tuple[float, np.ndarray]:
    """Loss and gradient of all rows (y, features); partial sums are added up in `parts` tasks first."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def told(loss: float, n: int, grad: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([grad.tobytes()], pa.binary())], names=["loss", "n", "grad"])

    def each(batches):
        w = sent.value
        loss, n, grad = 0.0, 0, np.zeros_like(w)
        for batch in batches:
            for part in _slices(batch.column(1)):
                y = batch.column(0)[part].to_numpy(zero_copy_only=False).astype(int)
                flat, size = _flat(batch.column(1)[part])
                p = _softmax(_scores(w, flat, size))
                loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
                p[np.arange(len(y)), y] -= 1
                share = p / np.sqrt(np.maximum(size, 1))[:, None]
                for c in range(len(w)):
                    grad[c, :-1] += np.bincount(flat, np.repeat(share[:, c], size), w.shape[1] - 1)
                grad[:, -1] += p.sum(0)
                n += len(y)
        if n:
            yield told(loss, n, grad)

    def added(batches):
        loss, n, grad = 0.0, 0, 0
        for batch in batches:
            loss, n = loss + sum(batch.column(0).to_pylist()), n + sum(batch.column(1).to_pylist())
            for g in batch.column(2).to_pylist():
                grad = grad + np.frombuffer(g)
        if n:
            yield told(loss, n, grad)

    kinds = "loss double, n long, grad binary"
    partial = rows.select("y", "features").mapInArrow(each, kinds)
    if parts > 1:
        partial = partial.repartition(parts).mapInArrow(added, kinds)
    loss, n, grad = 0.0, 0, np.zeros(weights.size)
    for r in partial.collect():  # `parts` sums
        loss, n, grad = loss + r.loss, n + r.n, grad + np.frombuffer(r.grad)
    sent.destroy()
    return loss / max(1, n), grad.reshape(weights.shape) / max(1, n)


def lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tolerance: float, kept: int = 8) -> np.ndarray:
    """The least point of a convex function by limited-memory quasi-Newton steps with halving."""
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() <= tolerance:
            break
        d, back = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ d / (s @ y)
            d -= a * y
            back.append(a)
        if pairs:
            s, y = pairs[-1]
            d *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            d += (a - y @ d / (s @ y)) * s
        t, slope = 1.0 if pairs else min(1.0, 1 / np.abs(g).sum()), g @ d
        while True:
            new_f, new_g = value(x - t * d)
            if new_f <= f - 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = -t * d, new_g - g
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs[-(kept - 1) :], (s, y)]
        x, f, g = x - t * d, new_f, new_g
    return x


def fit(rows: DataFrame, label: str, text: str = "text", dims: int = 1 << 12, decay: float = 1e-3, steps: int = 100, tolerance: float = 1e-6) -> Softmax:
    """Fit on all rows whose label isn't null: mean log loss plus decay / 2 times the squared coefficients (not the constant's)."""
    from chronolake.sources.sinks import folder

    spark = rows.sparkSession
    classes = tuple(sorted(r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().collect()))  # a study's classes
    if len(classes) < 2:
        return Softmax(classes or (None,), np.zeros((max(1, len(classes)), dims + 1)))
    place = F.coalesce(*(F.when(F.col(label) == c, i) for i, c in enumerate(classes)))
    at = folder(spark, "features")
    rows.where(F.col(label).isNotNull()).select(place.alias("y"), hashed_words(F.col(text), dims).alias("features")).write.parquet(at)
    data = spark.read.parquet(at)  # hashed once, read in each pass
    tasks = data.rdd.getNumPartitions()
    parts = math.isqrt(tasks) if tasks > 64 else 1
    held = np.ones((len(classes), dims + 1))
    held[:, -1] = 0

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x.reshape(held.shape)
        loss, grad = _sums(data, w, parts)
        return loss + decay / 2 * float((held * w * w).sum()), (grad + decay * held * w).ravel()

    return Softmax(classes, lbfgs(value, np.zeros(held.size), steps, tolerance).reshape(held.shape))


def indices(texts: Sequence[str], dims: int) -> pa.Array:
    """What `hashed_words` gives, outside Spark."""

    def index(word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode(), seed=42)
        return (h - (h >> 63 << 64)) % dims  # Spark's hash has a sign

    return pa.array([[index(w) for w in _SPLIT.split(t.lower()) if w] for t in texts], pa.list_(pa.int32()))


def asked(model: Softmax, texts: Sequence[str]) -> np.ndarray:
    """Probabilities of texts, TEXTS of them hashed at once."""
    parts = [model.probabilities(indices(texts[a : a + TEXTS], model.dims)) for a in range(0, len(texts), TEXTS)]
    return np.concatenate(parts) if parts else np.zeros((0, len(model.weights)))


def classifier(model: Softmax, names: dict | None = None) -> Callable[[Sequence[str]], list[tuple[str, float]]]:
    """The model behind the interface of pluggable classifiers: texts to (label, score)."""

    def ask(texts: Sequence[str]) -> list[tuple[str, float]]:
        p = asked(model, texts)
        best = p.argmax(1)
        return [(str((names or {}).get(model.classes[b], model.classes[b])), float(q[b])) for b, q in zip(best, p, strict=True)]

    return ask


def scorer(model: Softmax, target) -> Callable[[Sequence[str]], list[float]]:
    """The probability of one class, behind the interface of pluggable filters."""
    k = model.classes.index(target)
    return lambda texts: asked(model, texts)[:, k].tolist()


def baseline(samples: DataFrame, label: str, year: Column, text: str = "text", last_train: int = 2018, first_test: int = 2020, **fitting) -> tuple[DataFrame, dict]:
    """A model fitted on the samples up to a year and asked about those from a later one; the years between are kept apart.

    Returns the test samples with (predicted, probabilities), and a manifest: counts, settings, and digests of the
    training rows (sums of row hashes, whatever their order) and of the coefficients.
    """
    dated = samples.where(F.col(label).isNotNull()).withColumn("split", F.when(year <= last_train, "train").when(year >= first_test, "test").otherwise("dev"))
    counts = {r["split"]: r["n"] for r in dated.groupBy("split").agg(F.count("*").alias("n")).collect()}
    train = dated.where("split = 'train'")
    model = fit(train, label, text, **fitting)
    rows = train.agg(F.sum(F.xxhash64(F.col(text), F.col(label)).cast("decimal(38,0)")).alias("h")).first()[0]
    manifest = {
        "train_samples": counts.get("train", 0), "dev_samples": counts.get("dev", 0), "dev_usage": "kept apart", "test_samples": counts.get("test", 0), "last_train_year": last_train, "first_test_year": first_test,
        "classes": list(model.classes), "dims": model.dims, **fitting, "train_rows": str(rows), "coefficients": hashlib.sha256(np.round(model.weights, 6).tobytes()).hexdigest(),
    }
    return model.predict(dated.where("split = 'test'"), text).drop("split"), manifest
