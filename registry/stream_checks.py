"""Structured Streaming twins of batch results (STR-*), run until the input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry.base import query
from swathe.session import shared_dir
from swathe.streaming import streams


def _fresh(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _stream(t, name: str):
    """One source table, a single file or a folder of files, as a stream of files."""
    schema = t.source(name).schema
    # The file source takes a lone file only by a pattern; this one matches nothing but the table.
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}.parque[t]")


def _listing(t):
    return _as_listing(_stream(t, "documents"))


def _as_listing(documents):
    return documents.select(
        F.concat(F.lit("/archive/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".tif")).alias("path"),
        F.length("text").alias("length"), F.sha2(F.encode("text", "UTF-8"), 256).alias("checksum"),
        F.timestamp_seconds(F.col("doc_id") + 1700000000).alias("modificationTime"))


def _headers(t):
    k = F.col("doc_id")
    return t.documents.select(
        F.concat(F.lit("/archive/"), F.lpad(k.cast("string"), 9, "0"), F.lit(".tif")).alias("path"),
        F.create_map(F.lit("SENSOR"), F.lit("MSI")).alias("tags"), (600 + k % 900).cast("int").alias("width"),
        (500 + k % 700).cast("int").alias("height"), F.lit(3).alias("band_count"), F.lit(70.0).alias("origin_x"),
        F.lit(20.0).alias("origin_y"), F.lit(0.0001).alias("res_x"), F.lit(0.0001).alias("res_y"),
        F.lit(False).alias("is_projected"), F.lit(True).alias("is_geographic"))


@query("STR-01_ingest_stream", "", """
select count(*) as scenes, cast(sum(tiles) as bigint) as tiles from (select ceil((600 + k % 900) / 512.0) * ceil((500 + k % 700) / 512.0) as tiles from (select min(doc_id) as k from documents group by text) x) y""")
def _(t):
    root = _fresh(t, "ingest")
    streams.ingest_stream(_listing(t), _headers(t), root, f"{root}/checkpoint").awaitTermination()
    scenes = t.spark.read.parquet(f"{root}/scenes")
    return scenes.agg(F.count("*").alias("scenes"), F.sum("tile_count").alias("tiles"))


@query("STR-01_ingest_two_batches", "", """
select count(*) as scenes, cast(sum(ceil((600 + k % 900) / 512.0) * ceil((500 + k % 700) / 512.0)) as bigint) as tiles
from (select arg_min(doc_id, doc_id % 2 * 1000000000000 + doc_id) as k from documents group by text) x""")
def _(t):
    """Even ids come in a first batch, odd ones in a second; a text of both is one scene of the first."""
    root = _fresh(t, "ingest2")
    for rest in (0, 1):
        t.documents.where(F.col("doc_id") % 2 == rest).write.mode("append").parquet(f"{root}/landed")
        # What has landed is one batch, however many files it is; the next run starts behind it.
        stream = t.spark.readStream.schema(t.documents.schema).parquet(f"{root}/landed")
        streams.ingest_stream(_as_listing(stream), _headers(t), root, f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/scenes").agg(F.count("*").alias("scenes"), F.sum("tile_count").alias("tiles"))


@query("STR-02_dedupe_stream", "", "select distinct sha256(text) as checksum from documents")
def _(t):
    root = _fresh(t, "dedupe")
    unique = streams.dedupe_stream(_listing(t), "10 days")
    unique.writeStream.format("parquet").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("checksum")


@query("STR-03_incremental_embed", "vectors", """
select vec_id as tile_id, vec_id % 19 = 0 as is_new from embeddings
union all select tile_id, false from vectors where collection = 'semantic' and tile_id >= 1000000""")
def _(t):
    """Embeddings streamed in as tiles; those without a stored semantic vector get one."""
    root = _fresh(t, "embed")
    stored = t.vectors.where("collection = 'semantic'")
    tiles = _stream(t, "embeddings").select(F.col("vec_id").alias("tile_id"), "embedding")

    def encode(batch):
        return batch.select("tile_id", F.col("embedding").alias("vector"), F.lit(900).alias("embedded_at"))

    streams.embed_stream(tiles, lambda: stored, encode, "semantic", root, f"{root}/checkpoint").awaitTermination()
    written = t.spark.read.parquet(f"{root}/vectors").drop("batch_id")
    merged = streams.current_vectors(stored.unionByName(written))
    return merged.select("tile_id", (F.col("embedded_at") == 900).alias("is_new"))


JOB_SQL = """
select job_id, status, progress, cast(ts as string) as updated_at, updates from (select *, count(*) over (partition by job_id) as updates,
 row_number() over (partition by job_id order by status in ('COMPLETED', 'FAILED') desc, ts desc, progress desc, status desc) as rn from jobs) x where rn = 1"""


@query("STR-04_job_state_batch", "jobs", JOB_SQL)
def _(t):
    return streams.job_state(t.jobs).withColumn("updated_at", F.col("updated_at").cast("string"))


@query("STR-04_job_state_stream", "jobs", JOB_SQL)
def _(t):
    root = _fresh(t, "jobs")
    events = _stream(t, "events")
    jobs = events.selectExpr(
        "user_id as job_id", "event_id", "ts", "cast(event_id % 101 as double) as progress",
        "case when event_id % 97 = 5 then 'COMPLETED' when event_id % 131 = 7 then 'FAILED' when event_id % 3 = 0 then 'PENDING' else 'RUNNING' end as status")

    def keep(batch, batch_id: int) -> None:
        streams.write_batch(batch, root, "state", batch_id)

    streams.job_state(jobs).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    states = t.spark.read.parquet(f"{root}/state")
    newest = states.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "updated_at", "updates"), "batch_id").alias("s"))
    return newest.select("job_id", "s.status", "s.progress", F.col("s.updated_at").cast("string").alias("updated_at"), "s.updates")


@query("STR-04_job_state_expiring", "jobs", JOB_SQL)
def _(t):
    """The same with timers; the table's events all lie within the time that jobs are kept."""
    root = _fresh(t, "sticky")
    jobs = _stream(t, "events").selectExpr(
        "user_id as job_id", "ts", "cast(event_id % 101 as double) as progress",
        "case when event_id % 97 = 5 then 'COMPLETED' when event_id % 131 = 7 then 'FAILED' when event_id % 3 = 0 then 'PENDING' else 'RUNNING' end as status")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(provider)
    t.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        streams.job_state_stream(jobs, keep="36500 days", delay="3650 days").writeStream.outputMode("update").foreachBatch(
            lambda batch, batch_id: streams.write_batch(batch, root, "state", batch_id)).option(
            "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set(provider, before)
    states = t.spark.read.parquet(f"{root}/state")
    newest = states.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "updated_at", "updates"), "batch_id").alias("s"))
    return newest.select("job_id", "s.status", "s.progress", F.col("s.updated_at").cast("string").alias("updated_at"), "s.updates")
