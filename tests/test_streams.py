"""Streams on small batches: repeated batches, buckets, versions that go, rankings."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from hearthlake.streaming import streams

SCHEMA = "k long, v string, at long"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_buckets(spark, tmp_path):
    """Only touched buckets are written; a batch that runs again gives the same rows; versions behind the last commit are removed."""
    each = streams.upsert_latest(["k"], "at", f"{tmp_path}/latest", f"{tmp_path}/history", buckets=4)
    batches = [[(k, f"a{k}", 1) for k in range(20)], [(3, "b3", 2), (3, "older", 0)], [(3, "late", 1), (100, "new", 1)], [], [(3, "c3", 5)]]
    want: dict[int, tuple] = {}
    for n, rows in enumerate(batches):
        for k, v, at in rows:
            if k not in want or at >= want[k][1]:
                want[k] = (v, at)
        for _ in range(2):
            each(batch(spark, rows), n)
        got = {r["k"]: (r["v"], r["at"]) for r in streams.latest_rows(spark, f"{tmp_path}/latest", n).collect()}
        assert got == want, n
    versions = {(v, b) for v in os.listdir(tmp_path / "latest") if v.startswith("version=") for b in os.listdir(tmp_path / "latest" / v) if b.startswith("bucket=")}
    assert len({b for _, b in versions}) == 4 and len([v for v, b in versions if v == "version=1"]) <= 1
    assert spark.read.parquet(f"{tmp_path}/history").count() == sum(map(len, batches))


def test_repeat_after_a_later_read(spark, tmp_path):
    """The state before a batch is still there when the batch is run again."""
    each = streams.upsert_latest(["k"], "at", f"{tmp_path}/l", f"{tmp_path}/h", buckets=2)
    each(batch(spark, [(1, "a", 1), (2, "a", 1)]), 0)
    each(batch(spark, [(1, "wrong", 2)]), 1)
    each(batch(spark, [(1, "right", 2)]), 1)
    assert {r["k"]: r["v"] for r in streams.latest_rows(spark, f"{tmp_path}/l", 1).collect()} == {1: "right", 2: "a"}


def test_ranking(spark, tmp_path):
    """Rebuilt every second batch; a key scored twice counts with its last score; a repeated batch changes nothing."""
    each = streams.score_arrivals(lambda b: b.select("k", F.lit("g").alias("g"), F.col("at").alias("score")), "k", "g", [F.desc("score"), F.asc("k")], 2, str(tmp_path), every=2)
    each(batch(spark, [(1, "", 5), (2, "", 9)]), 0)
    assert not os.path.exists(tmp_path / "ranking")
    each(batch(spark, [(3, "", 7), (1, "", 8)]), 1)
    top = lambda: [(r["k"], r["rank"]) for r in streams.newest_ranking(spark, str(tmp_path)).orderBy("rank").collect()]
    assert top() == [(2, 1), (1, 2)]
    each(batch(spark, [(4, "", 100)]), 2)
    assert top() == [(2, 1), (1, 2)]
    for _ in range(2):
        each(batch(spark, [(2, "", 1)]), 3)
    assert top() == [(4, 1), (1, 2)]


@pytest.mark.parametrize("late_days", [0.5, 3])
def test_late_rows(spark, tmp_path, late_days):
    """A row behind the watermark is dropped, one before it counts."""
    day = dt.datetime(2024, 1, 10, 12, 30)
    files = [[(day, "x")], [(day - dt.timedelta(days=9), "tick")], [(day - dt.timedelta(days=1), "x")], [(day + dt.timedelta(days=30), "end")], [(day + dt.timedelta(days=31), "end")]]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        newest = max((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + n, 1_700_000_000 + n))
    out = streams.windowed_counts(streams.source(spark, f"{tmp_path}/in", files_a_batch=1), "ts", "kind", late=f"{int(late_days * 24)} hours")
    got = streams.run_to_files(out, "append", f"{tmp_path}/out").filter("kind = 'x'").count()
    assert got == (2 if late_days == 3 else 1)
