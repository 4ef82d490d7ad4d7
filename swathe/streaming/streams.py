"""Structured Streaming: ingestion, duplicate removal, embedding and job state.

Each foreachBatch writes its batch to a folder named after the batch id and
overwrites it, so a batch replayed after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from swathe.config import TilingConfig
from swathe.operators import vectors
from swathe.plans.ingest import ingest_batch
from swathe.sources import catalog, files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
TERMINAL = ["COMPLETED", "FAILED"]


def new_files(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Stream of the files that appear under a folder, with their checksum."""
    stream = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
              .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root))
    return files.file_checksums(stream)


def dedupe_stream(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeated content; state is kept for ``delay`` of file time."""
    return stream.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["checksum"])


def write_batch(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{table}/batch_id={batch_id}")


def ingest_once(batch: DataFrame, batch_id: int, headers: DataFrame, root: str,
                config: TilingConfig = TilingConfig()) -> None:
    """Ingest the files of a batch whose content no earlier batch has brought.

    The checksums of every batch are stored beside its tables. A batch looks at those of smaller ids alone, so
    that a replay decides as the first time and overwrites what it wrote.
    """
    spark = batch.sparkSession
    spark.createDataFrame([], "checksum string").write.mode("ignore").parquet(f"{root}/checksums/batch_id=-1")
    earlier = spark.read.schema("checksum string, batch_id long").parquet(f"{root}/checksums").where(
        F.col("batch_id") < batch_id)
    fresh = batch.join(earlier.select("checksum").distinct(), "checksum", "left_anti").select(*batch.columns)
    for table, df in ingest_batch(fresh, headers, config).items():
        write_batch(df, root, table, batch_id)
    write_batch(batch.where("checksum is not null").select("checksum").distinct(), root, "checksums", batch_id)


def ingest_stream(stream: DataFrame, headers: DataFrame, root: str, checkpoint: str,
                  config: TilingConfig = TilingConfig(), **trigger) -> StreamingQuery:
    """Files to scenes, tiles, rejects and provenance tables under ``root``; content that an earlier batch brought
    is not ingested again."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_once(batch, batch_id, headers, root, config)

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def embed_stream(tiles: DataFrame, read_vectors: Callable[[], DataFrame],
                 encode: Callable[[DataFrame], DataFrame], collection: str, root: str,
                 checkpoint: str, **trigger) -> StreamingQuery:
    """Encode the streamed tiles that lack a vector and upsert the result.

    ``encode`` maps a tile frame to (tile_id, vector, embedded_at). What a
    reader sees is the upsert of all batches, so repeats do no harm.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        todo = vectors.pending_tiles(batch.dropDuplicates(["tile_id"]), read_vectors(), [collection])
        fresh = encode(todo).withColumn("collection", F.lit(collection))
        write_batch(fresh, root, "vectors", batch_id)

    return (tiles.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_vectors(batches: DataFrame) -> DataFrame:
    """The latest vector per (collection, tile) over everything the stream wrote."""
    empty = batches.limit(0)
    return catalog.upsert_vectors(empty, batches)


def job_state(events: DataFrame) -> DataFrame:
    """Latest status and progress per job; COMPLETED and FAILED are final.

    Works on a stream (update mode) and on a table alike.
    """
    rank = F.struct(F.col("status").isin(TERMINAL).alias("final"), "ts", "progress", "status")
    return events.groupBy("job_id").agg(
        F.max_by(F.struct("status", "progress", "ts"), rank).alias("s"),
        F.count("*").alias("updates"),
    ).select("job_id", "s.status", "s.progress", F.col("s.ts").alias("updated_at"), "updates")


JOB_STATE = "job_id long, status string, progress double, updated_at timestamp, updates long"


class StickyJobs(StatefulProcessor):
    """The state of ``job_state`` with an end: a job is forgotten once event time is ``keep_ms`` past its last
    event. Until then COMPLETED and FAILED are final, whatever comes later; events older than the watermark
    are dropped before they reach it."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, progress double, ts timestamp, updates long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.job.get() if self.job.exists() else None
        best, updates = (held[:3], held[3]) if held else (None, 0)
        rank = lambda e: (e[0] in TERMINAL, e[2], e[1], e[0])
        for part in rows:
            for event in zip(part["status"], part["progress"], (t.to_pydatetime() for t in part["ts"]), strict=True):
                best = event if best is None or rank(event) > rank(best) else best
                updates += 1
        self.job.update((*best, updates))
        # Timers of earlier events find a newer one in the state and do nothing.
        self.handle.registerTimer(self._end(best[2]))
        yield pd.DataFrame({"job_id": [key[0]], "status": [best[0]], "progress": [best[1]], "updated_at": [best[2]],
                            "updates": [updates]})

    def _end(self, at) -> int:
        return int(pd.Timestamp(at).timestamp() * 1000) + self.keep_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists() and self._end(self.job.get()[2]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame, keep: str = "30 days", delay: str = "1 day") -> DataFrame:
    """``job_state`` of a stream in update mode with bounded state. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``)."""
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    timed = events.select("job_id", "status", "progress", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=StickyJobs(keep_ms), outputStructType=JOB_STATE, outputMode="Update", timeMode="EventTime")
