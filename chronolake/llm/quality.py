"""Quality by ordinal cumulative-link regression on graded ratings.

``P(grade > k) = sigmoid(w . x - t_k)`` with one weight vector over hashed text
features for all grades and ordered thresholds t_0 < t_1 < ...  Expected grade
and tail probability come from the same score, for ranking and selection.
Fitted on a bounded labelled sample (`per_grade` rows of each grade).

Defined results: null and empty texts are scored as texts without words; null
grades aren't learned from; with fewer than two grades in the sample every text
gets that grade (0 without any); rows are returned one for one, repeated rows too,
and equal texts score alike; texts of any length are scored whole; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm import bytekit as bk
from chronolake.llm import hashed
from chronolake.llm.common import fold

FOLDS, HELD = 5, 0


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Ordinal:
    grades: list[int]
    chosen: np.ndarray
    w: np.ndarray
    cuts: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) by row, for each k but the last."""
        at = np.full(hashed.DIM, -1, np.int32)
        at[self.chosen] = np.arange(len(self.chosen))
        z = np.zeros(len(texts))
        for s in bk.slices(texts):
            r, f = hashed.present(s, hashed.style_features, at)
            if len(r):
                z[s.lo : s.hi] = np.bincount(r, weights=self.w[f], minlength=s.hi - s.lo)
        return _sig(z[:, None] - self.cuts[None, :])


def fit_ordinal(y: np.ndarray, x: np.ndarray, k: int, steps: int = 300, rate: float = 0.05, decay: float = 1e-3):
    """(w, cuts) for grades 0..k-1: cuts are a first value and positive gaps, so their order holds throughout."""
    w = np.zeros(x.shape[1], np.float64)
    c = np.concatenate(([0.0], np.zeros(max(0, k - 2))))
    weight = np.zeros(len(y))
    for g in range(k):
        weight[y == g] = 1 / (k * max(1, (y == g).sum()))
    m, s = [0.0, 0.0], [0.0, 0.0]
    for t in range(1, steps + 1):
        cuts = c[0] + np.concatenate(([0.0], np.cumsum(np.exp(c[1:]))))
        p = _sig((x @ w)[:, None] - cuts[None, :])
        tail = np.column_stack([np.ones(len(y)), p, np.zeros(len(y))])
        own = np.maximum(tail[np.arange(len(y)), y] - tail[np.arange(len(y)), y + 1], 1e-9)
        slope = np.column_stack([np.zeros(len(y)), p * (1 - p), np.zeros(len(y))])
        lo, hi = slope[np.arange(len(y)), y], slope[np.arange(len(y)), y + 1]
        gz = -weight * (lo - hi) / own
        gcut = np.zeros((len(y), k - 1))
        has = y >= 1
        gcut[np.flatnonzero(has), y[has] - 1] += (weight * lo / own)[has]
        has = y < k - 1
        gcut[np.flatnonzero(has), y[has]] -= (weight * hi / own)[has]
        gc = gcut.sum(0)
        grad_c = np.concatenate(([gc.sum()], [gc[j:].sum() * np.exp(c[j]) for j in range(1, k - 1)]))
        for i, (q, d) in enumerate(((w, x.T @ gz + decay * w), (c, grad_c))):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.99 * s[i] + 0.01 * d * d
            q -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)
    return w, c[0] + np.concatenate(([0.0], np.cumsum(np.exp(c[1:]))))


def train(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int = 1500) -> Ordinal:
    """Learn from at most `per_grade` rated documents of each grade, outside the held-out fold."""
    y, ids = hashed.design(hashed.labelled(docs, labels, grade, fold("doc_id", FOLDS) != HELD, per_grade), hashed.style_features)
    grades = sorted(set(y.tolist())) or [0]
    y = np.searchsorted(grades, y)
    k = len(grades)
    if k < 2:
        return Ordinal(grades, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    chosen = np.unique(np.concatenate([hashed.informative((y > j).astype(np.int64), ids, most=768) for j in range(k - 1)]))
    w, cuts = fit_ordinal(y, hashed.dense(ids, chosen).astype(np.float64), k)
    return Ordinal(grades, chosen, w, cuts)


def score_quality(docs: DataFrame, model: Ordinal, tail_from: int = 1, keep_at: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_prob, keep): tail_prob is P(grade >= tail_from), keep is tail_prob >= keep_at."""
    at = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        for batch in batches:
            m = at.value
            over = m.tails(batch.column(1))
            g = np.array(m.grades, float)
            mean = g[0] + over @ np.diff(g)
            j = int(np.searchsorted(g, tail_from))
            n = batch.num_rows
            tail = np.ones(n) if j == 0 else np.zeros(n) if j >= len(g) else over[:, j - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(mean), pa.array(tail), pa.array(tail >= keep_at)],
                names=[id_col, "held_out", "expected_grade", "tail_prob", "keep"],
            )

    return docs.select(id_col, "text", (fold(id_col, FOLDS) == HELD).alias("held")).mapInArrow(each, f"{id_col} {id_type}, held_out boolean, expected_grade double, tail_prob double, keep boolean")
