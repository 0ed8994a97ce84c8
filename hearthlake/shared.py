"""The folder that driver and executors share, and results that are cut off there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster names it in spark.checkpoint.dir; a session on one machine makes its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hearthlake-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder; what follows starts there, also after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to as many tasks as a shuffle has, for work that is heavy for its bytes; a file of some hundred MB is one task's otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def few(df: DataFrame, most_rows: int = 20_000) -> bool:
    return df.limit(most_rows + 1).count() <= most_rows


def narrow(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """Marked for broadcast if it has few rows; else the join is left to Spark."""
    return F.broadcast(df) if few(df, most_rows) else df
