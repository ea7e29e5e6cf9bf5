"""Queries of models that are trained here, of an index over vectors, and of what reads and resumes runs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chronolake.operators import ivf as I
from chronolake.operators import learn as L
from chronolake.operators import models as M
from chronolake.operators import stats as R
from chronolake.operators import vectors as V
from chronolake.plans.book import query
from chronolake.plans.views import table, view
from chronolake.sources import sinks as Sk

r6 = lambda c: F.round(c, 6)
FITTING = {"dims": 1024, "decay": 1e-3, "steps": 60, "tolerance": 1e-5}


def _stances(spark, sf):
    s = view(spark, sf, "samples").select("sample_id", "text", F.col("task_label").cast("int").alias("y"), (2010 + F.col("sample_id") % 14).alias("year"))
    return L.baseline(s, "y", F.col("year"), **FITTING)


@query(["samples"], "SELECT CASE WHEN 2010 + sample_id % 14 <= 2018 THEN 'train' WHEN 2010 + sample_id % 14 >= 2020 THEN 'test' ELSE 'dev' END AS split, count(*) AS n FROM samples WHERE task_label IS NOT NULL GROUP BY 1")
def y59_baseline_manifest(spark, sf):
    """The manifest that a baseline leaves, written and read back: how many samples each split has."""
    at = Sk.folder(spark, "baseline")
    _, told = _stances(spark, sf)
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(at)
    counts = spark.read.schema("train_samples BIGINT, dev_samples BIGINT, test_samples BIGINT").json(at)
    return counts.select(F.expr("stack(3, 'train', train_samples, 'dev', dev_samples, 'test', test_samples) AS (split, n)")).where("n > 0")


@query(["samples"], "SELECT CAST(task_label AS INT) AS y, count(*) AS n FROM samples WHERE 2010 + sample_id % 14 >= 2020 AND task_label IS NOT NULL GROUP BY 1")
def y59_baseline_support(spark, sf):
    """How many test samples of each class the confusion counts of the baseline hold."""
    told, _ = _stances(spark, sf)
    return R.confusion(told, "y", "predicted").groupBy(F.col("y").cast("int").alias("y")).agg(F.sum("n").cast("long").alias("n")).where("n > 0")


@query()
def y60_stance_baseline(spark, sf):
    """Macro F1, correlation, Brier score and calibration error of a stance model, fitted before a year, on samples after it."""
    told, _ = _stances(spark, sf)
    told = told.select("y", F.col("predicted").alias("p"), F.col("probabilities").alias("q")).withColumn("conf", F.array_max("q"))
    out = R.competence(told, "y", "p").join(F.broadcast(R.brier(told, "y", "q"))).join(F.broadcast(R.calibration_error(told, "conf", F.col("y") == F.col("p"))))
    return out.select([r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _toxic(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d, L.fit(d.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id"), "toxic", **FITTING)


@query([], "SELECT doc_id, true AS named, true AS sure FROM documents")
def u1_trained_classifier(spark, sf):
    """Every text by a fitted model behind the classifier's interface: a known label, at least as sure as chance."""
    d, model = _toxic(spark, sf)
    c = M.classified(F.col("text"), L.classifier(model, {0: "clean", 1: "toxic"}))
    return d.select("doc_id", c.alias("c")).select("doc_id", F.col("c.label").isin("clean", "toxic").alias("named"), (F.col("c.score") >= 0.5).alias("sure"))


@query()
def u2_trained_filter(spark, sf):
    """Documents that a fitted model finds clean enough, behind the filter's interface."""
    d, model = _toxic(spark, sf)
    return M.on_subject(d, "text", L.scorer(model, 0)).select("doc_id")


def _index(spark, sf):
    """An index of the memory rows, those of a later month inserted after the fit."""
    rows = V.drawers(table(spark, sf, "embeddings"))
    at, late = Sk.folder(spark, "ivf"), F.col("id") % 5 == 4
    index = I.build(rows.where(~late), at)
    index.insert(rows.where(late), 1)
    return rows, I.opened(spark, at)


def _asked(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id % 50 = 0")
    return e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.date_add(F.lit("2024-01-03").cast("date"), (F.col("vec_id") % 40).cast("int")).alias("as_of"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NEAR = f"""d AS (SELECT vec_id AS id, embedding, CAST(DATE '2024-01-01' + CAST(vec_id % 30 AS INT) AS DATE) AS vf, CASE vec_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 365 END AS days FROM embeddings),
q AS (SELECT vec_id AS qid, embedding AS q, CAST(DATE '2024-01-03' + CAST(vec_id % 40 AS INT) AS DATE) AS t FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, id, round({_DOT.format(a="embedding", b="q")} / sqrt({_DOT.format(a="embedding", b="embedding")} * {_DOT.format(a="q", b="q")}), 9) AS sim FROM d JOIN q ON vf <= t AND (days IS NULL OR vf + CAST(days AS INT) > t))"""


@query([], f"WITH {_NEAR}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s) SELECT count(DISTINCT qid) AS asked, count(*) AS found, true AS good FROM r WHERE rank <= 10")
def x20_index_recall(spark, sf):
    """Queries of every vector with an id divisible by 50, as of their days, with as many probes as every second query needs for a recall of 0.95: as many results as exact search gives, and at least 0.9 of them."""
    rows, index = _index(spark, sf)
    q = _asked(spark, sf)
    at = Sk.folder(spark, "exact")
    V.search_valid(rows, q, 10).write.parquet(at)
    exact = spark.read.parquet(at)
    some = F.col("qid") % 100 == 0
    probes, finalists, _ = I.tuned(index, exact.where(some), q.where(some), 10, 0.95)
    found = index.search(q, 10, probes, finalists)
    n = found.agg(F.count("*").alias("found"))
    return I.recall(found, exact).join(F.broadcast(n)).select("asked", "found", (F.col("recall") >= 0.9).alias("good"))


@query([], f"WITH {_NEAR} SELECT qid, rank, id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 5")
def x20_index_exact(spark, sf):
    """The same index with every list probed and all rows in the exact order."""
    rows, index = _index(spark, sf)
    return index.search(_asked(spark, sf), 5, probes=len(index.cells), finalists=-(-rows.count() // 5)).withColumn("sim", r6(F.col("sim")))
