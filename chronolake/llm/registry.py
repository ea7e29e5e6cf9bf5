"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import dialogue, fim, html_text, jaccard, langid, leaks, mixing, packing, pst, quality, secrets, topk, toxicity
from chronolake.llm.common import table


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the table: 0 junk, 1 good but toxic, 2 good."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.col("quality") * (F.lit(2) - F.col("toxic")))
    return quality.score_quality(docs, model)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score_texts(table(spark, sf_dir, "documents"))


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op12_rope_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fim.restore(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return dialogue.repair(talks, dialogue.damaged(talks))


def base_of_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 says of texts without its tree, which SQL can say, too."""
    told = op9_suffix_tree(spark, sf_dir)
    return told.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES = {f.__name__: f for f in (op1_maxscore_topk, op2_ordinal_quality, op3_mix_sources, op4_language_gru, op5_toxicity_fm, op6_jaccard_join, op7_secret_scan, op8_latent_leaks, op9_suffix_tree, op10_html_blocks, op11_hilbert_packing, op12_rope_fim, op13_dialogue_repair, base_of_suffix_tree)}

ORACLE = {
    "op1_maxscore_topk": topk.TOPK_SQL,
    "op3_mix_sources": f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.MIX_SQL})",
    "op6_jaccard_join": jaccard.JOIN_SQL,
    "op7_secret_scan": secrets.SECRETS_SQL,
    "base_of_suffix_tree": pst.BASE_SQL,
    "op12_rope_fim": fim.FIM_SQL,
    "op13_dialogue_repair": dialogue.REPAIR_SQL,
}
