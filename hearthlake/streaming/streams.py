"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.charts import latest

BUCKETS = 16


def source(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet folder (or one file, by its folder) as a stream, with the schema of what it holds now."""
    folder, pattern = path.rsplit("/", 1)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", pattern if pattern.endswith(".parquet") else "*.parquet")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(folder if pattern.endswith(".parquet") else path)


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "24 hours") -> DataFrame:
    """Tumbling event-time windows; rows later than the watermark are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def distinct_arrivals(events: DataFrame, ts: str, keys: list[str], late: str = "24 hours") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _versions(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """bucket -> version after batch ``number``: a row a bucket."""
    if number < 0 or not _exists(spark, f"{path}/commits/batch={number}"):
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{path}/commits/batch={number}").collect()}


def latest_rows(spark: SparkSession, path: str, number: int, schema: str | None = None) -> DataFrame:
    """The latest rows after batch ``number``."""
    paths = [f"{path}/version={v}/bucket={b}" for b, v in sorted(_versions(spark, path, number).items())]
    return spark.read.parquet(*paths)


def upsert_latest(keys: list[str], order: str, latest_path: str, history_path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the batch to the history and rewrites the latest rows of the buckets that it touches.

    Keys are dealt to buckets by hash. A batch writes a new version of its buckets beside the old ones and commits by a small table that says
    which version of each bucket counts, so a batch that is run again starts from the state before it and overwrites its own
    files. Versions that neither this nor the last commit names are removed.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{history_path}/batch={number}")
        batch = spark.read.parquet(f"{history_path}/batch={number}")  # read once from the source
        held = _versions(spark, latest_path, number - 1)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = batch.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` rows
        old = [f"{latest_path}/version={held[b]}/bucket={b}" for b in sorted(touched) if b in held]
        if old:
            fresh = fresh.unionByName(spark.read.parquet(*old).withColumn("bucket", bucket))
        latest(fresh, keys, [F.desc(order)]).write.mode("overwrite").partitionBy("bucket").parquet(f"{latest_path}/version={number}")
        now = held | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{latest_path}/commits/batch={number}")
        for b, v in _versions(spark, latest_path, number - 2).items():
            if v not in (now.get(b), held.get(b)):
                _remove(spark, f"{latest_path}/version={v}/bucket={b}")

    return run


def score_arrivals(score: Callable[[DataFrame], DataFrame], key: str, group: str, rank_by: list[Column], top: int, folder: str, every: int = 1) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: scores what arrives and, at most once every ``every`` batches, ranks all scores anew.

    The scores of a batch are its own folder, so a batch that is run again replaces them; of several scores of a key the last batch's counts. A ranking
    holds the ``top`` of each group; it is a new version, whose number is the batch that made it, and is written after the scores that it
    ranks. Which ranking counts is the largest version, so a repeated batch makes the same one again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        score(batch).write.mode("overwrite").parquet(f"{folder}/scores/batch={number}")
        if (number + 1) % every:
            return
        every_score = spark.read.parquet(f"{folder}/scores").filter(F.col("batch") <= number)
        ranked = latest(every_score, [key], [F.desc("batch")])
        salt = F.pmod(F.xxhash64(key), F.lit(32))  # so that a large group isn't ranked in one task
        part = ranked.withColumn("__salt", salt).withColumn("__k", F.row_number().over(Window.partitionBy(group, "__salt").orderBy(*rank_by))).filter(F.col("__k") <= top)
        best = part.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*rank_by))).filter(F.col("rank") <= top)
        best.drop("__salt", "__k", "batch").write.mode("overwrite").parquet(f"{folder}/ranking/version={number}")

    return run


def newest_ranking(spark: SparkSession, folder: str) -> DataFrame:
    versions = spark.read.parquet(f"{folder}/ranking")
    return versions.filter(F.col("version") == versions.agg(F.max("version")).first()[0]).drop("version")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str) -> None:
    """All that is there now, a batch at a time."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def run_to_files(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """All that is there now, batch by batch into Parquet under ``folder``, which is shared, with the stream's checkpoint beside.

    A batch that is run again overwrites its own files. Of complete results the last batch counts, of appended ones all do.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    made = spark.read.parquet(f"{folder}/batches")
    if mode == "complete":
        made = made.filter(F.col("batch") == made.agg(F.max("batch")).first()[0])
    return made.select(*stream.columns)


def run_upserts(stream: DataFrame, keys: list[str], order: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(latest rows, history) of all that is there now."""
    spark = stream.sparkSession
    run_batches(stream, upsert_latest(keys, order, f"{folder}/latest", f"{folder}/history"), folder)
    history = spark.read.parquet(f"{folder}/history")
    last = history.agg(F.max("batch")).first()[0]
    return latest_rows(spark, f"{folder}/latest", last).select(*stream.columns), history.select(*stream.columns)
