"""Toxicity with a factorization machine over hashed terms.

A text is the set of its hashed terms and term prefixes.  The machine scores
``b + sum w_i + sum <v_i, v_j>`` over the pairs present, so that two terms may
weigh together what neither weighs alone.  It is fitted by gradient descent on a
bounded labelled sample (`per_label` rows of each label), over the hash buckets
that tell the labels apart alone, and those that do so in pairs if they help on rows
that they weren't chosen from.

Defined results: null and empty texts get the score of a text without terms;
null labels and labels without a document aren't learned from; without both
labels in the sample the score is the share of label 1 (0 without any label);
rows are returned one for one, repeated rows too; texts of any length are scored
whole; an empty table gives an empty result; extra columns are ignored by
`score_toxicity` and kept by `drop_toxic`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm import bytekit as bk
from chronolake.llm import hashed
from chronolake.llm.common import fold

FOLDS, HELD = 4, 2


@dataclass
class Machine:
    bias: float
    chosen: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def logits(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        lin = np.bincount(rows, weights=self.w[feats], minlength=n) if len(rows) else np.zeros(n)
        pair = np.zeros(n)
        for k in range(self.v.shape[1]):
            x = self.v[feats, k]
            if len(rows):
                pair += np.bincount(rows, weights=x, minlength=n) ** 2 - np.bincount(rows, weights=x * x, minlength=n)
        return self.bias + lin + pair / 2

    def score(self, texts: pa.Array) -> np.ndarray:
        at = np.full(hashed.DIM, -1, np.int32)
        at[self.chosen] = np.arange(len(self.chosen))
        out = np.zeros(len(texts))
        for s in bk.slices(texts):
            r, f = hashed.present(s, hashed.term_features, at)
            out[s.lo : s.hi] = self.logits(r, f, s.hi - s.lo)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit_machine(y: np.ndarray, x: np.ndarray, rank: int = 8, steps: int = 250, rate: float = 0.05, decay: float = 2e-4, seed: int = 1):
    """(bias, w, v) by full-batch Adam on the log loss, both labels weighing alike."""
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(x.shape[1], np.float32), rng.normal(0, 0.05, (x.shape[1], rank)).astype(np.float32), np.zeros(1, np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    m = [np.zeros_like(p) for p in (w, v, b)]
    s = [np.zeros_like(p) for p in (w, v, b)]
    for t in range(1, steps + 1):
        xv = x @ v
        z = b + x @ w + 0.5 * (xv**2 - x @ v**2).sum(1)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        xg = x.T @ g
        grads = (xg + decay * w, x.T @ (g[:, None] * xv) - v * xg[:, None] + decay * v, g.sum(keepdims=True))
        for i, (p, d) in enumerate(zip((w, v, b), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.99 * s[i] + 0.01 * d * d
            p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)
    return float(b[0]), w, v


def pairs_help(y: np.ndarray, ids: list[np.ndarray], gain: float = 0.8) -> bool:
    """Whether buckets that tell the labels apart in pairs only lower the loss on rows they weren't chosen from, to `gain` of it at least.

    Every other row of the sample (it is in order of label) chooses and fits, the rest is scored.
    """
    part = np.arange(len(y)) % 2 == 0
    seen, rest = ([x for x, p in zip(ids, part == side, strict=True) if p] for side in (True, False))
    alone = hashed.informative(y[part], seen)
    extra = np.setdiff1d(hashed.paired(y[part], seen), alone)
    if not len(extra):
        return False

    def loss(chosen: np.ndarray) -> float:
        bias, w, v = fit_machine(y[part], hashed.dense(seen, chosen))
        x, t = hashed.dense(rest, chosen), y[~part]
        z = np.clip(bias + x @ w + 0.5 * ((x @ v) ** 2 - x @ v**2).sum(1), -30, 30)
        own = np.log1p(np.exp(np.where(t == 1, -z, z)))
        return float(own[t == 1].mean() + own[t == 0].mean())

    return loss(np.union1d(alone, extra)) <= gain * loss(alone)


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2000) -> Machine:
    """Learn from at most `per_label` labelled documents of each label, outside the held-out fold."""
    sample = hashed.labelled(docs, labels, F.col("toxic"), fold("doc_id", FOLDS) != HELD, per_label)
    y, ids = hashed.design(sample, hashed.term_features)
    y = (y == 1).astype(np.int64)
    chosen = hashed.informative(y, ids)
    if pairs_help(y, ids):
        chosen = np.union1d(chosen, hashed.paired(y, ids))
    if not len(chosen):
        share = float(y.mean()) if len(y) else 0.0
        none = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Machine(none, chosen, np.zeros(0, np.float32), np.zeros((0, 1), np.float32))
    bias, w, v = fit_machine(y, hashed.dense(ids, chosen))
    return Machine(bias, chosen, w, v)


def score_toxicity(docs: DataFrame, machine: Machine, cut: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    at = docs.sparkSession.sparkContext.broadcast(machine)  # of a size fixed by `most` in hashed.informative and hashed.paired
    id_type = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        for batch in batches:
            p = at.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"]
            )

    return docs.select(id_col, "text", (fold(id_col, FOLDS) == HELD).alias("held")).mapInArrow(each, f"{id_col} {id_type}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, machine: Machine, cut: float = 0.3) -> DataFrame:
    """`docs` without the rows whose score reaches `cut`."""
    at = docs.sparkSession.sparkContext.broadcast(machine)

    def each(batches):
        for batch in batches:
            p = at.value.score(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(p < cut))

    return docs.mapInArrow(each, docs.schema)
