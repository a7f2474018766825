"""Stages written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The temporary folder of each session in one process.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only a session in one process (master local, as in tests) gets a temporary folder where
    that is unset; on a cluster it must be set, as no machine's own folder is seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        session = spark.sparkContext.applicationId
        found = _FOLDERS[session] = _FOLDERS.get(session) or tempfile.mkdtemp(prefix="corpuslake-")
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: lineage is cut, and several uses compute it once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stage = path
    return found


def forget(*stages: DataFrame) -> None:
    """Delete stages of stored() that nothing reads any more."""
    for stage in stages:
        path = getattr(stage, "_stage", None)
        if isinstance(path, str):
            spark = stage.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch that carries whole texts; bounds a Python worker's memory.
TEXT_BATCH_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Bound the bytes of batches that go to Python, where the session does not (a session setting)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = (spark.conf.get(name, None) or "").lower().rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= 1 << 30:
        spark.conf.set(name, str(TEXT_BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if its scan has fewer parts than there are cores.

    A small file is one task otherwise, however costly its rows are. A large table has parts
    enough and is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
