"""A corpus pipeline of five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; `run` writes each stage's result to the shared folder and reads it again.
The last stage returns the mix: which documents it takes and how many of their words.

Defined results of all stages: a null text counts as empty; a null source is a source
of its own; texts of any length are read whole; repeated rows count each, but for those
that are copies; extra columns come through, whatever their names, until the mix, which
has its own columns; without documents every stage gives none, and without labels or
benchmark items nothing is rejected for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolake.llm import jaccard, leaks, mixing, secrets, toxicity
from chronolake.llm.common import discard, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity reaches the cut; texts without words, null ids and repeated rows are scored like others."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, machine)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; texts without words and rows without an id all stay.

    Of rows of one id and text, that with the smallest digest of all columns stays.
    """
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows and those without an id too; null and empty texts stay."""
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and `n_chars` follows; every document stays, null texts as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each; those of no words or beyond their source's target don't appear."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies),
    ("decontamination", decontaminate),
    ("secrets", secret_scan),
    ("mixing", mix_sources),
]

#: SQL can't express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # nothing reads it any more
        before = docs
    return docs
