"""Streams that are replayed, meet late events, or run for a long time."""

import uuid

import pytest
from pyspark.sql import functions as F

from swathe.session import shared_dir
from swathe.streaming import streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def root(spark):
    return f"{shared_dir(spark)}/streams-{uuid.uuid4().hex}"


def headers(spark, paths):
    rows = [(p, {"SENSOR": "MSI"}, 600, 500, 3, 70.0, 20.0, 0.0001, 0.0001, False, True) for p in paths]
    return spark.createDataFrame(
        rows, "path string, tags map<string,string>, width int, height int, band_count int, origin_x double, "
              "origin_y double, res_x double, res_y double, is_projected boolean, is_geographic boolean")


def batch(spark, files):
    rows = [(p, 10, c) for p, c in files]
    return spark.createDataFrame(rows, "path string, length long, checksum string").withColumn(
        "modificationTime", F.timestamp_seconds(F.lit(1700000000)))


def test_copies_across_batches_and_replays(spark, root):
    heads = headers(spark, [f"/a/{n}.tif" for n in "abcd"])
    batches = [[("/a/a.tif", "x"), ("/a/b.tif", "y")], [("/a/c.tif", "x"), ("/a/d.tif", "z")]]
    scenes = lambda: sorted(r["filename"] for r in spark.read.parquet(f"{root}/scenes").collect())
    for number in (0, 1, 0, 1, 1):
        streams.ingest_once(batch(spark, batches[number]), number, heads, root)
        if number:
            assert scenes() == ["a.tif", "b.tif", "d.tif"]
    assert spark.read.parquet(f"{root}/checksums").select("checksum").distinct().count() == 3


def test_jobs_end_and_are_forgotten(spark, root):
    day = lambda n: f"2024-0{1 + n // 28}-{1 + n % 28:02d} 00:00:00"
    parts = [[(1, "COMPLETED", 90.0, day(1)), (1, "RUNNING", 95.0, day(2)), (2, "RUNNING", 5.0, day(1))],
             [(2, "RUNNING", 50.0, day(60))],
             [(1, "FAILED", 1.0, day(3)), (1, "RUNNING", 7.0, day(61)), (3, "PENDING", 0.0, day(61))]]
    schema = "job_id long, status string, progress double, ts string"
    landed = spark.createDataFrame(parts[0], schema)
    landed.limit(0).write.parquet(f"{root}/landed")
    stream = spark.readStream.schema(landed.schema).parquet(f"{root}/landed")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/landed")
            streams.job_state_stream(stream, keep="30 days", delay="1 day").writeStream.outputMode("update").foreachBatch(
                lambda b, n: b.write.mode("overwrite").parquet(f"{root}/state/n={n}")).option(
                "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    seen = [(r["job_id"], r["status"], r["updates"]) for r in spark.read.parquet(f"{root}/state").orderBy("n", "job_id").collect()]
    # Later news do not reopen an ended job; after its time it is forgotten, the late FAILED is dropped, and a
    # new run of the same id starts from nothing.
    assert seen == [(1, "COMPLETED", 2), (2, "RUNNING", 1), (2, "RUNNING", 2), (1, "RUNNING", 1), (3, "PENDING", 1)]
