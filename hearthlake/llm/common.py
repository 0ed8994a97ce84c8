"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import by_bytes

BATCH_BYTES = 8 << 20
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; the cluster names it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hearthlake-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def map_texts(
    docs: DataFrame,
    per_batch: Callable[[list[str]], Sequence[pa.Array]],
    schema: str,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Apply per_batch to the texts of each Arrow batch, some BATCH_BYTES at a time.

    per_batch gets the list of texts (null as empty) and returns one Arrow array for each column of
    ``schema``; doc_id is carried along unchanged as the first column. Rows keep their partition.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), text_of(docs, text).alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    out = source.sparkSession.createDataFrame([], f"doc_id {kind}, {schema}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = out.fieldNames()
        for batch in batches:
            for at, stop in by_bytes(batch.column("text"), BATCH_BYTES):
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *per_batch(part.column("text").to_pylist())], names=names)

    return source.mapInArrow(run, out)


def narrow(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """Marks an aggregate (one row per source, say) for broadcast if it has few rows; else leaves the join to Spark."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
