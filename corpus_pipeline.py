"""A corpus from documents: toxicity, line dedup, near-dedup, benchmark decontamination, then a mix of sources.

Defined cases, for every stage: an empty table gives an empty one; columns beside those of documents are left out; rows that share a doc_id but
not the text are documents of their own; rows that share both go or stay together. A null or empty text has no words, no lines and no
copies: it is scored by the classifier's bias, which leaves it, and stays to the end. A null doc_id is an id like others, but that near-dedup keeps all
its rows. A null source is a source of its own. Without labels no document is toxic, and without items none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from vexil.llm.shared import new_folder, remove

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = toxicity.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep_text=True).where("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that were met earlier; a document that had lines and keeps none of them goes."""
    out = line_dedup.dedup_lines(docs).where("n_lines = 0 or n_kept > 0")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dup.keep_one(docs).select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mix."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

#: The classifier and the weighted samples have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's folder goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder, last = new_folder(spark, "corpus"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
