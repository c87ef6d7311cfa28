"""Session helpers: table loading, checkpoint folder, sizes of partitions."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Tables whose timestamps carry no zone are read as they are; casts to TIMESTAMP take the session's zone (UTC).
TABLE_SUFFIX = ".parquet"


def local_session(name: str = "strandmill", cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and single-machine runs; on a cluster the caller brings the session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.host": "127.0.0.1",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}{TABLE_SUFFIX}")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; only where none is named (tests) set an own one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "strandmill-checkpoints"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that the session runs at a time, as far as the driver knows; at least 1."""
    return max(1, spark.sparkContext.defaultParallelism)
