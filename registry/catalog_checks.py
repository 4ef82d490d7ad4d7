"""Counts, listings and review (AGG-*, SRT-*, and what the data model declares)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query
from swathe.operators import listing


@query("AGG-01_sensor_counts", "tiles", "select sensor, count(*) as tiles from tiles where vector_id is not null group by 1")
def _(t):
    return listing.sensor_counts(t.tiles)


@query("AGG-02_search_bounds", "tiles", """
select cast(min(acquisition_date) as string) as min_date, cast(max(acquisition_date) as string) as max_date, min(quality_score) as min_quality, max(cloud_cover_pct) as max_cloud_cover, count(*) as total_indexed_tiles from tiles where vector_id is not null""")
def _(t):
    return listing.search_bounds(t.tiles).withColumns({
        c: F.col(c).cast("string") for c in ("min_date", "max_date")})


@query("AGG-03_embedding_status", "tiles scenes jobs", """
select scene_id, total_tiles, embedded_tiles, total_tiles - embedded_tiles as pending_tiles, round_even(100.0::double * embedded_tiles / total_tiles, 1)::double as progress_pct,
 case when embedded_tiles = 0 then 'NOT_STARTED' when embedded_tiles = total_tiles then 'COMPLETED' else 'PARTIAL' end as status, last_day, j.job_id as active_job_id
from (select scene_id, count(*) as total_tiles, count(vector_id) as embedded_tiles, cast(max(embedded_at) as string) as last_day from tiles group by 1) x left join (
 select related_entity_id, job_id from (select *, row_number() over (partition by related_entity_id order by ts desc, job_id desc) as rn from jobs where job_type = 'embedding') y where rn = 1) j on j.related_entity_id = scene_id""")
def _(t):
    jobs = t.jobs.withColumn("created_at", F.col("ts"))
    s = listing.embedding_status(t.scenes, t.tiles, jobs)
    return s.withColumn("last_day", F.col("last_embedded_at").cast("string")).drop("last_embedded_at")


@query("AGG-04_embedded_count_rollup", "tiles scenes", """
select s.scene_id, s.filename, count(t.vector_id) as embedded_count from scenes s left join tiles t on t.scene_id = s.scene_id group by 1, 2""")
def _(t):
    return listing.embedded_count_rollup(t.scenes, t.tiles).select("scene_id", "filename", "embedded_count")


@query("AGG-05_collection_stats", "vectors", """
select collection, count(*) as points, max(len(vector)) as dim, cast(sum(len(vector) * 4) as bigint) as bytes from vectors group by 1""")
def _(t):
    return listing.collection_stats(t.vectors)


@query("AGG-06_dashboard_totals", "scenes", """
select count(*) as completed_scenes, cast(sum(tile_count) as bigint) as total_tiles, cast(sum(embedded_count) as bigint) as total_embedded, count(distinct sensor) as sensors from scenes where status = 'COMPLETED'""")
def _(t):
    return listing.dashboard_totals(t.scenes)


@query("AGG-06_newest_scenes", "scenes", "select scene_id, filename from scenes order by created_at desc, scene_id limit 5")
def _(t):
    return listing.newest_scenes(t.scenes).select("scene_id", "filename")


@query("SRT-01_list_scenes", "scenes", "select scene_id, filename, status from scenes where status = 'COMPLETED' order by created_at desc, scene_id offset 4 limit 4")
def _(t):
    return listing.list_scenes(t.scenes, 2, 4, "completed").select("scene_id", "filename", "status")


@query("SRT-02_list_tiles", "tiles", "select tile_id from tiles where is_valid and quality_score >= 0.2 order by tile_row, tile_col, tile_id offset 100 limit 50")
def _(t):
    return listing.list_tiles(t.tiles, 3, 50, is_valid=True, min_quality=0.2).select("tile_id")


@query("SRT-03_tiles_for_scene", "tiles", "select tile_id, tile_row, tile_col from tiles where scene_id = 3 and is_valid order by tile_row, tile_col, tile_id limit 20")
def _(t):
    return listing.tiles_for_scene(t.tiles, 3, 20).select("tile_id", "tile_row", "tile_col")


@query("SRT-04_list_events", "events_table tiles", """
select event_id, final_confidence from events_table where final_confidence >= 0.5 and before_tile in (select tile_id from tiles) and after_tile in (select tile_id from tiles) order by detected_at desc, event_id offset 20 limit 50""")
def _(t):
    return listing.list_events(t.events_table, t.tiles, 20, 50, 0.5).select("event_id", "final_confidence")


@query("SRT-05_get_by_id", "tiles", "select tile_id, scene_id, sensor from tiles where tile_id = 42")
def _(t):
    return listing.get_by_id(t.tiles, "tile_id", 42).select("tile_id", "scene_id", "sensor")


@query("SRT-06_keyset_page", "vectors", "select tile_id, collection from vectors where tile_id > 120 and collection = 'visual' order by tile_id limit 250")
def _(t):
    return listing.keyset_page(t.vectors.where("collection = 'visual'"), 120).select("tile_id", "collection")


DECISIONS = """(select o_orderkey * 8 + 1 + o_custkey % 4 as event_id, case o_custkey % 3 when 0 then 'CONFIRMED' when 1 then 'REJECTED' else 'NEEDS_REVIEW' end as decision, o_orderdate as decided_at from {src})"""


@query("REV-01_reviewed_events", "events_table", f"""
select e.event_id, coalesce(d.decision, e.review_status) as review_status from events_table e left join (
 select event_id, decision from (select *, row_number() over (partition by event_id order by decided_at desc, decision desc) as rn from {DECISIONS.format(src='orders')} d0) x where rn = 1) d using (event_id)""")
def _(t):
    decisions = t.spark.sql("select * from " + DECISIONS.format(src=f"parquet.`{t.folder}/orders.parquet`"))
    return listing.reviewed_events(t.events_table, decisions).select("event_id", "review_status")


@query("REV-02_feedback_boost", "tiles", """
select tile_id, round(coalesce(quality_score, 0) + least(0.05, greatest(-0.05, coalesce(net, 0) * 0.01)), 8) as order_score from tiles left join (
 select user_id as tile_id, sum(case when event_type = 'purchase' then 1 else -1 end) as net from events group by 1) f using (tile_id)""")
def _(t):
    feedback = t.events.select(
        F.col("user_id").alias("tile_id"), F.when(F.col("event_type") == "purchase", "POSITIVE").otherwise("NEGATIVE").alias("signal"))
    scored = t.tiles.select("tile_id", F.coalesce("quality_score", F.lit(0.0)).alias("order_score"))
    return listing.feedback_boost(scored, feedback).select("tile_id", F.round("order_score", 8).alias("order_score"))


@query("REV-03_change_persistence", "events_table", """
select round(center_lon, 3) as site_lon, round(center_lat, 3) as site_lat, change_type, cast(min(after_date) as string) as first_seen, cast(max(after_date) as string) as last_seen, count(*) as sightings from events_table group by 1, 2, 3""")
def _(t):
    return listing.change_persistence(t.events_table).withColumns({
        c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})
