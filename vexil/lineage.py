"""Cutting of lineage for iterative operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or by the context; LOCAL_CHECKPOINTS where neither is set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or LOCAL_CHECKPOINTS)
    return named or LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
