"""Sources, file metadata, validation and scene maintenance (SRC-*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registry.base import query
from swathe.plans import ingest
from swathe.session import shared_dir
from swathe.sources import catalog, files

LISTED = """lower(regexp_extract(path, '\\.[^./]+$')) in ('.tif', '.tiff', '.geotiff')"""


@query("SRC-01_scene_files", "file_listing", f"select path, length from file_listing where {LISTED}")
def _(t):
    return t.file_listing.where(files.is_scene_file(F.col("path"))).select("path", "length")


@query("SRC-02_file_checksums", "", "select doc_id, sha256(text) as checksum from documents")
def _(t):
    f = t.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return files.file_checksums(f)


@query("SRC-03_dedupe_by_checksum", "file_listing", "select sha256(text) as checksum, min(path) as path from file_listing group by 1")
def _(t):
    f = files.file_checksums(t.file_listing.withColumn("content", F.encode("text", "UTF-8")).drop("text"))
    return files.dedupe_by_checksum(f).select("checksum", "path")


# Tags by number: some parse, some do not, some are in another case.
TAGGED = """(select doc_id, path, case doc_id % 7 when 0 then 'DATE_ACQUIRED' when 1 then 'ACQUISITION_DATE' when 2 then 'SensingTime' when 3 then 'sensor_ID' when 4 then 'SATELLITE' when 5 then 'Instrument' else 'other' end as k,
 case doc_id % 7 when 0 then '2021-03-0' || cast(1 + doc_id % 9 as string) when 1 then 'last week' when 2 then '2020-02-03T04:05:06Z' when 3 then 'MSI' when 4 then 'Landsat-8' when 5 then 'OLI' else 'x' end as v from {src})"""


def tagged(t):
    return t.spark.sql("select *, map(k, v) as tags from " + TAGGED.format(src=f"({t._sql('file_listing')})"))


@query("SRC-04_acquisition_date", "file_listing", f"""
select doc_id, case when k = 'DATE_ACQUIRED' then v || ' 00:00:00' when k = 'SensingTime' then '2020-02-03 04:05:06' when doc_id % 6 = 0 then '2023-06-15 10:30:45' when doc_id % 6 = 1 then '2022-12-01 00:00:00'
 when doc_id % 6 = 2 then '2019-07-04 00:00:00' end as at, case when k in ('DATE_ACQUIRED', 'SensingTime') then v when doc_id % 6 = 0 then '20230615T103045' when doc_id % 6 = 1 then '20221201' when doc_id % 6 = 2 then '2019-07-04' end as raw
from {TAGGED.format(src='file_listing')} x""")
def _(t):
    d = tagged(t).withColumn("d", files.acquisition_date(F.col("tags"), F.col("path")))
    return d.select("doc_id", F.date_format("d.at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("d.raw").alias("raw"))


@query("SRC-05_sensor_platform", "file_listing", f"""
select doc_id, case when doc_id % 7 in (3, 4, 5) then v when doc_id % 6 in (0, 4) then 'Sentinel-2 MSI' when doc_id % 6 = 1 then 'Landsat OLI/TIRS' when doc_id % 6 = 2 then 'Landsat ETM+' when doc_id % 6 = 3 then 'Landsat OLI-2/TIRS-2' end as sensor,
 case when doc_id % 7 = 4 then v when doc_id % 6 in (0, 4) then 'Sentinel-2' when doc_id % 6 = 1 then 'Landsat-8' when doc_id % 6 = 2 then 'Landsat-7' when doc_id % 6 = 3 then 'Landsat-9' end as platform from {TAGGED.format(src='file_listing')} x""")
def _(t):
    return tagged(t).select("doc_id", *[c.alias(n) for n, c in files.sensor_platform(F.col("tags"), F.col("path")).items()])


@query("SRC-06_resolution_metres", "rasters", """
select scene_id, case when scene_id % 3 = 0 then round(res_x * 1000, 8) when scene_id % 3 = 1 then round(res_x * 111000, 8) end as metres from rasters""")
def _(t):
    k = F.col("scene_id") % 3
    res = F.when(k == 0, F.col("res_x") * 1000).otherwise(F.col("res_x"))
    return t.rasters.select("scene_id", F.round(files.resolution_metres(res, k == 0, k == 1), 8).alias("metres"))


@query("SRC-07_read_catalog", "tiles", "select cast(tile_id as string) as tile_id, sensor, round(quality_score, 6) as quality_score, is_valid from tiles where sensor = 'Landsat-9'")
def _(t):
    """Append to a catalogue laid out by sensor and year, then read it back with its schema."""
    root = f"{shared_dir(t.spark)}/catalog-{uuid.uuid4().hex}"
    rows = t.tiles.withColumns({"tile_id": F.col("tile_id").cast("string"), "scene_id": F.col("scene_id").cast("string"),
                                "acquisition_date": F.col("acquisition_date").cast("timestamp")})
    rows = rows.select("tile_id", "scene_id", "acquisition_date", "sensor", "quality_score", "is_valid")
    for half in (0, 1):
        catalog.append(rows.where(F.col("tile_id").cast("long") % 2 == half), root, "tiles")
    return catalog.read_catalog(t.spark, root, "tiles").where("sensor = 'Landsat-9'").select(
        "tile_id", "sensor", F.round("quality_score", 6).alias("quality_score"), "is_valid")


@query("SRC-08_validate_scenes", "scenes", """
select scene_id, 'cloud_in_range' as rule from scenes where not (cloud_cover_pct between 0 and 100)""")
def _(t):
    return catalog.validate_catalog(t.scenes, "scenes", "scene_id")


@query("SRC-08_validate_events", "events_table", """
select event_id, 'review_known' as rule from events_table where review_status not in ('PENDING', 'CONFIRMED', 'REJECTED', 'NEEDS_REVIEW')
union all select event_id, 'confidence_in_range' from events_table where not final_confidence * 1.05 between 0 and 1""")
def _(t):
    e = t.events_table.withColumn("final_confidence", F.col("final_confidence") * 1.05)
    return catalog.validate_catalog(e, "change_events", "event_id")


@query("SRC-09_append", "tiles", "select sensor, year(acquisition_date) as acq_year, count(*) as n from tiles group by 1, 2")
def _(t):
    root = f"{shared_dir(t.spark)}/catalog-{uuid.uuid4().hex}"
    catalog.append(t.tiles, root, "tiles")
    stored = t.spark.read.parquet(f"{root}/tiles")
    return stored.groupBy("sensor", "acq_year").agg(F.count("*").alias("n"))


@query("SRC-10_replace_scene_tiles", "tiles", """
select tile_id, scene_id, pixel_width from tiles where scene_id % 3 <> 1 union all select tile_id + 5000000, scene_id, 64 from tiles where scene_id % 3 = 1 and tile_col = 0""")
def _(t):
    new = t.tiles.where("scene_id % 3 = 1 and tile_col = 0").withColumns(
        {"tile_id": F.col("tile_id") + 5000000, "pixel_width": F.lit(64)})
    return catalog.replace_scene_tiles(t.tiles, new).select("tile_id", "scene_id", "pixel_width")


def _deleted(t):
    events = t.events_table.select("event_id", "before_tile", "after_tile")
    tables = {"scenes": t.scenes, "tiles": t.tiles, "vectors": t.vectors, "change_events": events}
    return catalog.delete_scenes(tables, t.scenes.where("scene_id % 4 = 1"))


@query("SRC-13_delete_scene_tables", "tiles scenes vectors", """
select 'scenes' as kind, count(*) as n from scenes where scene_id % 4 <> 1 union all select 'tiles', count(*) from tiles where scene_id % 4 <> 1
union all select 'vectors', count(*) from vectors where tile_id not in (select tile_id from tiles where scene_id % 4 = 1)""")
def _(t):
    out = _deleted(t)
    counts = [out[k].agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("scenes", "tiles", "vectors")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SRC-13_delete_scene_events", "events_table tiles", """
with gone as (select tile_id from tiles where scene_id % 4 = 1)
select event_id, case when before_tile not in (select tile_id from gone) then before_tile end as before_tile, case when after_tile not in (select tile_id from gone) then after_tile end as after_tile from events_table""")
def _(t):
    return _deleted(t)["change_events"]


@query("SRC-15_best_stac_item", "stac_items", """
select item_id, cloud, cast(ts as string) as ts from stac_items where bbox_west <= 72.3 and bbox_east >= 72 and bbox_south <= 12.4 and bbox_north >= 12 and cloud < 50 order by case when cloud < 20 then 0 else 1 end, ts desc, item_id limit 1""")
def _(t):
    return files.best_stac_item(t.stac_items, [72.0, 12.0, 72.3, 12.4]).select("item_id", "cloud", F.col("ts").cast("string").alias("ts"))


@query("SRC-15_best_stac_items", "stac_items areas", """
select area_id, item_id, cloud from (select area_id, item_id, cloud, row_number() over (partition by area_id order by case when cloud < 20 then 0 else 1 end, ts desc, item_id) as rn
 from areas join stac_items on bbox_west <= east and bbox_east >= west and bbox_south <= north and bbox_north >= south where cloud < 50) x where rn = 1""")
def _(t):
    return files.best_stac_items(t.stac_items, t.areas).select("area_id", "item_id", "cloud")


@query("SRC-16_emit_provenance", "tiles", """
select tile_id as entity_id, 'tile' as entity_type, 'embedding' as operation, 'system' as operator, cast(scene_id as string) as scene, sensor from tiles where vector_id is not null""")
def _(t):
    p = catalog.provenance_records(t.tiles.where("vector_id is not null"), "tile_id", "tile", "embedding",
                                   ["scene_id", "sensor"], at=F.col("embedded_at").cast("timestamp"))
    return p.select("entity_id", "entity_type", "operation", "operator", F.col("details")["scene_id"].alias("scene"),
                    F.col("details")["sensor"].alias("sensor"))


@query("SRC-17_append_history", "tiles", """
select tile_id, cast(case when vector_id is null then 1 else 2 end as bigint) as steps, case when vector_id is null then 'tiling' else 'embedding' end as last_step from tiles""")
def _(t):
    kind = "array<struct<step:string,at:timestamp,details:map<string,string>>>"
    start = t.tiles.withColumn("processing_history", F.lit(None).cast(kind))
    once = catalog.append_history(start, "tiling", F.col("acquisition_date"))
    twice = catalog.append_history(once, "embedding", F.col("embedded_at"), when=F.col("vector_id").isNotNull())
    return twice.select("tile_id", F.size("processing_history").cast("long").alias("steps"),
                        F.element_at("processing_history", -1)["step"].alias("last_step"))


def headers(t):
    """Raster headers for the files of the listing; every ninth cannot be read."""
    k = F.col("doc_id")
    return tagged(t).where(k % 9 != 5).select(
        "path", "tags", F.when(k % 10 == 7, 0).otherwise(600 + k % 900).cast("int").alias("width"),
        (500 + k % 700).cast("int").alias("height"), F.lit(3).alias("band_count"),
        F.lit(70.0).alias("origin_x"), F.lit(20.0).alias("origin_y"), F.lit(0.0001).alias("res_x"), F.lit(0.0001).alias("res_y"),
        F.lit(False).alias("is_projected"), F.lit(True).alias("is_geographic"))


def listing(t):
    return t.file_listing.select("path", "length", F.sha2(F.encode("text", "UTF-8"), 256).alias("checksum"),
                                 F.lit("2024-01-01").cast("timestamp").alias("modificationTime"))


KEPT = f"""kept as (select path, length, doc_id from (select *, row_number() over (partition by sha256(text) order by path) as rn from file_listing) x where rn = 1),
judged as (select *, case when not ({LISTED}) then 'unsupported file' when doc_id % 9 = 5 then 'unreadable raster' when doc_id % 10 = 7 then 'zero dimensions' end as reason from kept)"""


@query("INGEST_rejects", "file_listing", f"with {KEPT} select path, reason from judged where reason is not null")
def _(t):
    return ingest.ingest_batch(listing(t), headers(t))["rejects"]


@query("INGEST_tiles", "file_listing", f"""with {KEPT}
select path, cast((ceil((600 + doc_id % 900) / 512.0) * ceil((500 + doc_id % 700) / 512.0)) as bigint) as tile_count from judged where reason is null""")
def _(t):
    return ingest.ingest_batch(listing(t), headers(t))["scenes"].select("path", "tile_count")
