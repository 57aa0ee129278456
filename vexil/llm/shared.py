"""Places that the driver and all executors share, and cutting of lineage."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
ROWS_A_TASK = 50_000
#: Bytes of a batch that goes to Python; as many as a block of texts has. Spark's own bound is ten times that.
BATCH_BYTES = 6 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python by BATCH_BYTES, where the session leaves Spark's bound as it is."""
    if spark.conf.get(_BATCH_KEY, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; set to LOCAL_CHECKPOINTS where it is unset."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(set_to)
        return set_to
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return LOCAL_CHECKPOINTS


def release(spark: SparkSession) -> None:
    """Lets go of what earlier steps left. Spark removes shuffles, broadcasts and checkpoints that nothing refers to only once the driver has collected their
    references, which it is made to do every half hour; operators of many steps leave more than that in between, in the driver and on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks_for(rows: int) -> int:
    """How many tasks a table of narrow rows is worth."""
    return max(1, -(-rows // ROWS_A_TASK))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation.

    rows: about how many narrow rows df has at most; it is kept in as many parts as these are worth, not in one for each task.
    """
    shared_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return (df if rows is None else df.coalesce(tasks_for(rows))).checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A URI in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The POSIX path of a file:// URI or plain path; memory maps need a shared folder that is mounted."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return uri


def put_file(path: str, data: bytes) -> None:
    """Writes under another name first: a task that runs twice leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def remove(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(uri)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
