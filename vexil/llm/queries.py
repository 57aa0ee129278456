"""The queries op1_ to op10_ and the SQL that some of them are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.llm import ann, chat, decontaminate, line_dedup, lm, mixing, near_dup, token_counts, toxicity, warc

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_kept").cast("long").alias("n_kept"), F.md5(F.col("text")).alias("text_md5"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", *(F.col(x).cast("long").alias(x) for x in ("window", "matched", "shift")))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(_table(spark, sf_dir, "documents"))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(turns.unionByName(extra), public_tokenizers.path(VOCABULARY))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_line_dedup, op3_nearest, op4_lm_scores, op5_decontaminate, op6_mix_sources, op7_warc_revisits, op8_toxicity, op9_near_dedup, op10_chat_windows)
}
