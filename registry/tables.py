"""Tables derived from the driver's parquet files by exact arithmetic.

The same SQL text runs in Spark and in DuckDB; the few places where the two
spell something differently are named in ``DIALECT``.
"""

from __future__ import annotations


import hashlib

from pyspark.sql import DataFrame, SparkSession

from swathe.session import shared_dir, shuffle_width
from swathe.sources import vector_store

SOURCES = ["orders", "lineitem", "events", "documents", "embeddings", "part", "customer",
           "conversations", "pages", "supplier"]

DIALECT = {
    "spark": {
        "pixel_grid": "lateral view explode(sequence(0, 31)) gy as y lateral view explode(sequence(0, 31)) gx as x",
        "first_half": "slice(embedding, 1, 32)",
        "day0": "date '2018-01-01'",
    },
    "duckdb": {
        "pixel_grid": "cross join range(32) gy(y) cross join range(32) gx(x)",
        "first_half": "embedding[1:32]",
        "day0": "date '2018-01-01'",
    },
}


def pick(number: str, words: list[str]) -> str:
    """SQL that chooses a word by a number modulo the length of the list."""
    quoted = [w.replace("'", "''") for w in words]
    cases = " ".join(f"when {i} then '{w}'" for i, w in enumerate(quoted))
    return f"(case ({number}) % {len(words)} {cases} end)"


_SITES = ["jewar_airport", "bhadla-solar", "sardar dam", "chennai_city", "pangong lake",
          "varanasi ganga", "highway"]
_SUBJECTS = [
    "new construction", "Rajasthan dessert", "solar farms", "cloud-free satellite imagery of airports",
    "vegitaiton clearance", "urban expansion and buildings", "water resrevoir decrease",
    "highways and road developement", "dense agricultural crop fields", "lake water coastline",
    "demolition of residential buildngs", "Sentinel-2 imagery of coastal harbor",
    "industrial faclities", "Landsat-8 scenes of forests,", "high quality images: mountain glaciers",
    "factories (open pit) and quarry", "when did the runway first appeared?", "paddy cultivation",
    "suppress seasonal variation, high confidence change"]
_LINKS = ["near roads", "along highways", "near  water bodies", "", "in forests", "around cities",
          "near airports,", "with no clouds", "low cloud", "beside the rivers", "close to lakes"]
_PLACES = ["in Rajasthan", "in Tamil Nadu", "Chennai", "near Greater Noida", "in Bhadla", "",
           "within Jammu & Kashmir", "at Jewar airport", "in the Himalayas", "across Delhi NCR",
           "of Varanasi.", "in Kerala", "near Pangong Tso"]
_WHEN = ["after", "since", "before", "in", "until", "", "between", "post", "up to"]

# A query log with misspelt, capitalised and punctuated sentences; years come from the order date.
QUERY_LOG = f"""
select o_orderkey as query_id,
  {pick('o_orderkey', _SUBJECTS)} || ' ' || {pick('o_orderkey + o_custkey', _LINKS)} || ' ' ||
  {pick('o_orderkey * 3 + o_custkey', _PLACES)} || ' ' ||
  (case (o_orderkey * 5 + o_custkey) % {len(_WHEN)}
     when 5 then ''
     when 6 then 'between ' || cast(year(o_orderdate) as string) || ' and ' || cast(year(o_orderdate) + 3 as string)
     else {pick(f'(o_orderkey * 5 + o_custkey) % {len(_WHEN)}', _WHEN)} || ' ' ||
          cast(year(o_orderdate) + (o_custkey % 3) * 10 as string) end) as raw_query
from {{orders}}"""

FIXTURES: dict[str, tuple[list[str], str]] = {
    "tiles": ([], """
with t as (
 select vec_id, label, vec_id % 25 as k, cast(floor(vec_id / 25) as bigint) as scene_no from {embeddings}
), u as (
 select *, cast(floor(scene_no / 2) as bigint) as site, scene_no % 2 as obs,
   k % 5 as tile_col, cast(floor(k / 5) as bigint) as tile_row from t
), v as (
 select *, case when site % 5 = 0 then 0.0025 else 0.05 end as edge,
   case when site % 5 = 0 then obs * 0.0008 else obs * (scene_no % 7) * 0.002 end as shift from u
), w as (
 select *, 70 + (site % 20) * 0.5 + tile_col * edge + shift as west,
   10 + cast(floor(site / 20) as bigint) * 0.5 + tile_row * edge as south from v
)
select vec_id as tile_id, scene_no as scene_id, cast(tile_col as int) as tile_col, cast(tile_row as int) as tile_row,
 case when vec_id % 23 = 5 then null else cast(west as double) end as bbox_west,
 case when vec_id % 23 = 5 then null else cast(south as double) end as bbox_south,
 case when vec_id % 23 = 5 then null else cast(west + edge as double) end as bbox_east,
 case when vec_id % 23 = 5 then null else cast(south + edge as double) end as bbox_north,
 cast(west + edge / 2 as double) as center_lon, cast(south + edge / 2 as double) as center_lat,
 cast((scene_no * 97) % 2500 as int) as acq_day,
 cast({day0} + cast((scene_no * 97) % 2500 as int) as date) as acquisition_date,
 case scene_no % 4 when 0 then 'Sentinel-2B' when 1 then 'Sentinel-2A' when 2 then 'Landsat-9' else 'Demo-MSI' end as sensor,
 cast(case scene_no % 4 when 2 then 30 else 10 end as double) as resolution_m,
 case when vec_id % 41 = 7 then null else cast(((vec_id * 37) % 101) as double) / 100 end as quality_score,
 cast((vec_id * 53) % 60 as double) as cloud_cover_pct,
 vec_id % 29 <> 3 as is_valid,
 cast(case when vec_id % 31 = 4 then 24 else 512 end as int) as pixel_width,
 cast(512 as int) as pixel_height,
 case when vec_id % 19 = 0 then null else vec_id end as vector_id,
 case when vec_id % 19 = 0 then null else cast({day0} + cast((vec_id * 7) % 300 as int) as date) end as embedded_at
from w"""),
    "scenes": (["tiles"], """
select scene_id, """ + pick("scene_id", _SITES) + """ || '_' || cast(scene_id as string) || '.tif' as filename,
 max(sensor) as sensor, max(acquisition_date) as acquisition_date,
 case scene_id % 5 when 3 then 'PROCESSING' when 4 then 'FAILED' else 'COMPLETED' end as status,
 cast((scene_id * 37) % 400 as int) as created_at, count(*) as tile_count,
 count(vector_id) as embedded_count, cast((scene_id * 13) % 130 as double) as cloud_cover_pct
from {tiles} group by scene_id"""),
    "rasters": ([], """
select p_partkey as scene_id, cast(p_size * 50 + (p_partkey % 7) * 64 as int) as width,
 cast(64 + (p_partkey % 37) * 40 as int) as height,
 cast(70 + (p_partkey % 200) * 0.25 as double) as origin_x, cast(30 - (p_partkey % 90) * 0.125 as double) as origin_y,
 cast(0.0001220703125 as double) as res_x, cast(0.0001220703125 as double) as res_y,
 p_brand as brand from {part}"""),
    "pixels": (["tiles"], """
select tile_id, cast(y as int) as y, cast(x as int) as x,
 cast((tile_id * 7 + x * 3 + y * 5) % 256 as int) as r,
 cast((tile_id * 11 + x * 5 + y * 2) % 256 as int) as g,
 cast((tile_id * 3 + x * 2 + y * 7) % 256 as int) as b
from {tiles} {pixel_grid}"""),
    # Imagery with clouds, shadow, nodata and vegetation, in flat patches of 4 x 4 pixels.
    "images": (["tiles"], """
select tile_id, y, x,
 cast(case m when 0 then 0 when 1 then 250 when 2 then 40 when 3 then 20 when 4 then 30 when 5 then 130 when 6 then 15 when 7 then 200 when 8 then 220 else 35 end + e as int) as r,
 cast(case m when 0 then 0 when 1 then 248 when 2 then 120 when 3 then 40 when 4 then 70 when 5 then 120 when 6 then 12 when 7 then 198 when 8 then 214 else 60 end + e as int) as g,
 cast(case m when 0 then 0 when 1 then 246 when 2 then 60 when 3 then 70 when 4 then 90 when 5 then 110 when 6 then 10 when 7 then 203 when 8 then 205 else 45 end + e as int) as b
from (select tile_id, cast(y as int) as y, cast(x as int) as x,
  cast((floor(x / 4) * 7 + floor(y / 4) * 3 + (tile_id * 5) % 11 * floor(x / 8)) % (2 + tile_id % 9) as int) as m,
  cast((x + y + tile_id) % 3 as int) as e
 from {tiles} {pixel_grid}) q"""),
    "vectors": ([], """
select 'semantic' as collection, vec_id as tile_id, embedding as vector, cast((vec_id * 7) % 300 as int) as embedded_at
 from {embeddings} where vec_id % 19 <> 0
union all select 'visual', vec_id, {first_half}, cast((vec_id * 7) % 300 as int)
 from {embeddings} where vec_id % 19 <> 0
union all select 'semantic', vec_id + 1000000, embedding, 1 from {embeddings} where vec_id % 17 = 0
union all select 'visual', vec_id + 1000000, {first_half}, 1 from {embeddings} where vec_id % 34 = 0"""),
    "signals": ([], """
select l_orderkey * 8 + l_linenumber as case_id,
""" + ",\n".join(
        f" cast((l_orderkey * {p} + l_linenumber * {q} + l_partkey) % 101 as double) / 100 as {name}"
        for name, p, q in [
            ("visual_change", 7, 13), ("semantic_change", 11, 29), ("image_quality", 17, 5),
            ("shadow_score", 23, 31), ("sensor_compatibility", 29, 3), ("seasonal_compatibility", 31, 19),
            ("spectral_evidence", 37, 23), ("spatial_consistency", 41, 37)]) + """,
 cast((l_orderkey * 3 + l_linenumber * 7) % 101 as double) / 250 as cloud_score,
 cast((l_orderkey * 13 + l_linenumber * 11) % 101 as double) / 150 + 0.3 as registration_confidence,
 (l_orderkey + l_linenumber) % 6 = 0 as is_seasonal_vegetation,
 case when l_orderkey % 3 = 0 then null else cast((l_suppkey * 7 + l_linenumber) % 101 as double) / 100 end as query_match
from {lineitem}"""),
    "query_log": ([], QUERY_LOG),
    "provenance": ([], """
select user_id as entity_id, 'tile' as entity_type,
 case event_type when 'click' then 'embedding' when 'view' then 'tiling' else 'ingestion' end as operation,
 event_id, ts as recorded_at from {events}"""),
    "jobs": ([], """
select user_id as job_id, event_id % 40 as related_entity_id,
 case when event_id % 2 = 0 then 'embedding' else 'tiling' end as job_type,
 case when event_id % 97 = 5 then 'COMPLETED' when event_id % 131 = 7 then 'FAILED' when event_id % 3 = 0 then 'PENDING' else 'RUNNING' end as status,
 cast(event_id % 101 as double) as progress, event_id, ts from {events}"""),
    "stac_items": ([], """
select event_id as item_id, cast(70 + (event_id * 37) % 1000 * 0.01 as double) as bbox_west,
 cast(10 + (event_id * 53) % 700 * 0.01 as double) as bbox_south,
 cast(70 + (event_id * 37) % 1000 * 0.01 + 0.3 as double) as bbox_east,
 cast(10 + (event_id * 53) % 700 * 0.01 + 0.3 as double) as bbox_north,
 cast((event_id * 29) % 100 as double) as cloud, ts from {events}"""),
    "areas": ([], """
select s_suppkey as area_id, cast(70 + (s_suppkey * 7) % 100 * 0.1 as double) as west,
 cast(10 + (s_suppkey * 11) % 70 * 0.1 as double) as south,
 cast(70 + (s_suppkey * 7) % 100 * 0.1 + 0.05 as double) as east,
 cast(10 + (s_suppkey * 11) % 70 * 0.1 + 0.05 as double) as north from {supplier}"""),
    "file_listing": ([], """
select '/archive/' || source || '/' ||
  case doc_id % 6 when 0 then 'S2A_20230615T103045_' when 1 then 'LC08_L2SP_20221201_' when 2 then 'LE07_x_2019-07-04_'
   when 3 then 'landsat-9_' when 4 then 'S2B_20239999_' else 'scene_' end || cast(doc_id as string) ||
  case doc_id % 5 when 0 then '.tif' when 1 then '.TIFF' when 2 then '.geotiff' when 3 then '.png' else '.tif' end as path,
 length(text) as length, text, doc_id from {documents}"""),
    "events_table": (["tiles"], """
select l_orderkey * 8 + l_linenumber as event_id, l_partkey % 600 as before_tile, l_suppkey as after_tile,
 cast((l_orderkey * 7 + l_linenumber * 3) % 101 as double) / 100 as final_confidence,
 case l_orderkey % 5 when 0 then 'High Confidence' when 1 then 'Medium Confidence' when 2 then 'Low Confidence' when 3 then 'Suppressed' else null end as confidence_tier,
 (l_orderkey + l_linenumber) % 7 = 0 as is_suppressed,
 cast((l_orderkey * 11 + l_linenumber) % 101 as double) / 100 as query_match,
 cast(70 + l_partkey % 50 * 0.01 as double) as center_lon, cast(10 + l_suppkey % 20 * 0.01 as double) as center_lat,
 case l_linenumber % 3 when 0 then 'new_construction' when 1 then 'water_change' else 'vegetation_loss' end as change_type,
 cast(l_shipdate as date) as after_date,
 case l_linenumber % 4 when 0 then 'PENDING' when 1 then 'CONFIRMED' when 2 then 'OPEN' else 'REJECTED' end as review_status,
 l_shipdate as detected_at from {lineitem}"""),
    # Pairs of tiles with land-cover figures, names and dates, for the rules of change analysis.
    "pair_facts": ([], """
select o_orderkey as pair_id,
 cast((o_orderkey * 7 + o_custkey) % 300 as double) / 10 as before_water_pct,
 cast((o_orderkey * 11 + o_custkey) % 280 as double) / 10 as after_water_pct,
 cast((o_orderkey * 13 + o_custkey) % 350 as double) / 10 as before_veg_pct,
 cast((o_orderkey * 17 + o_custkey) % 340 as double) / 10 as after_veg_pct,
 cast((o_orderkey * 19) % 120 as double) / 10 as before_urban_pct,
 cast((o_orderkey * 23) % 130 as double) / 10 as after_urban_pct,
 cast((o_orderkey * 3 + o_custkey) % 101 as double) / 100 as visual_score,
 cast((o_orderkey * 5 + o_custkey) % 101 as double) / 100 as registration_quality,
 cast(o_orderkey % 30 as double) as max_cloud, cast(o_orderdate as date) as after_date,
 """ + pick("o_custkey", _SITES) + """ as site_name,
 cast((o_orderkey * 3) % 81 as double) / 100 + 0.15 as first_match from {orders}"""),
}


def _needed(name: str, seen: list[str]) -> list[str]:
    for parent in FIXTURES[name][0]:
        _needed(parent, seen)
    if name not in seen:
        seen.append(name)
    return seen


def duckdb_with(*names: str) -> str:
    """WITH clause that defines the named tables (and what they need)."""
    order: list[str] = []
    for name in names:
        _needed(name, order)
    words = {**{s: s for s in SOURCES}, **{n: n for n in FIXTURES}, **DIALECT["duckdb"]}
    parts = [f"{n} as materialized ({FIXTURES[n][1].format(**words)})" for n in order]
    return "with " + ",\n".join(parts) + "\n" if parts else ""


# Pixel tables and the query log are stored once per session, in several files each, as
# they are in use: operators then scan a table. The value is the column to spread by.
STORED = {"pixels": "tile_id", "images": "tile_id", "query_log": "query_id", "pair_facts": "pair_id"}
_stored: dict[tuple[str, str, str], str] = {}


class Tables:
    """The source and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def vector_store(self) -> DataFrame:
        """The vectors stored with their tiles' attributes, by collection, sensor and bucket."""
        path = self._place("vector_store")
        if path not in _stored.values():
            vector_store.VectorStore(self.spark, path).create(vector_store.with_payload(self.vectors, self.tiles))
            _stored[self._key("vector_store")] = path
        return vector_store.VectorStore(self.spark, path).read()

    def _key(self, name: str) -> tuple[str, str, str]:
        return self.spark.sparkContext.applicationId, self.folder, name

    def _place(self, name: str) -> str:
        place = hashlib.sha256("|".join(self._key(name)).encode()).hexdigest()[:16]
        return f"{shared_dir(self.spark)}/{name}-{place}"

    def __getattr__(self, name: str) -> DataFrame:
        if name in STORED:
            return self._table(name)
        if name in FIXTURES:
            return self.spark.sql(self._sql(name))
        if name in SOURCES:
            return self.source(name)
        raise AttributeError(name)

    def _table(self, name: str) -> DataFrame:
        key = self._key(name)
        if key not in _stored:
            path = self._place(name)
            if "tiles" in FIXTURES[name][0]:
                # Tiles are spread before their pixels are made, so that tiles are shuffled and not pixels.
                tiles = self.tiles.repartition(shuffle_width(self.spark), STORED[name])
                built = self.spark.sql(FIXTURES[name][1].format(tiles="{tiles}", **DIALECT["spark"]), tiles=tiles)
            else:
                built = self.spark.sql(self._sql(name)).repartition(shuffle_width(self.spark), STORED[name])
            built.write.mode("overwrite").parquet(path)
            _stored[key] = path
        return self.spark.read.parquet(_stored[key])

    def _sql(self, name: str) -> str:
        files = {s: f"parquet.`{self.folder}/{s}.parquet`" for s in SOURCES}
        parents = {p: f"({self._sql(p)})" for p in FIXTURES[name][0]}
        return FIXTURES[name][1].format(**{**files, **parents, **DIALECT["spark"]})
