"""Filters and predicates (FIL-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query
from registry.text_checks import LOG_FIXES, base, located  # noqa: F401
from swathe.functions import geometry
from swathe.operators import listing, pairing, queries, vectors
from swathe.plans import search

BOX = [F"bbox_{s}" for s in ("west", "south", "east", "north")]
POLYGON = [(70.02, 9.99), (71.35, 10.03), (71.2, 10.22), (70.62, 10.07), (70.31, 10.32), (69.95, 10.21), (70.13, 10.11)]
# A box of half a degree cut by the notch of the polygon above; as SQL edges.
EDGES = "edges as (select * from (values " + ", ".join(
    f"({a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for a, b in zip(POLYGON, POLYGON[1:] + POLYGON[:1])
) + ") e(ax, ay, zx, zy)),"
# Side of the four corners of a tile against each edge.
SIDES = """sides as (select tile_id, least(s1, s2, s3, s4) as lo, greatest(s1, s2, s3, s4) as hi, least(ax, zx) as x0, greatest(ax, zx) as x1, least(ay, zy) as y0, greatest(ay, zy) as y1,
 bbox_west as w, bbox_south as s, bbox_east as e, bbox_north as n,
 (ay > bbox_south) <> (zy > bbox_south) and bbox_west < ax + (bbox_south - ay) * (zx - ax) / nullif(zy - ay, 0) as corner_hit,
 (ay > (bbox_south + bbox_north) / 2) <> (zy > (bbox_south + bbox_north) / 2) and (bbox_west + bbox_east) / 2 < ax + ((bbox_south + bbox_north) / 2 - ay) * (zx - ax) / nullif(zy - ay, 0) as middle_hit
 from (select *, (zx - ax) * (bbox_south - ay) - (zy - ay) * (bbox_west - ax) as s1, (zx - ax) * (bbox_south - ay) - (zy - ay) * (bbox_east - ax) as s2,
  (zx - ax) * (bbox_north - ay) - (zy - ay) * (bbox_east - ax) as s3, (zx - ax) * (bbox_north - ay) - (zy - ay) * (bbox_west - ax) as s4 from tiles, edges where bbox_west is not null) q)"""


def simple(name: str, condition: str, **filters):
    @query(name, "tiles", f"select tile_id from tiles where {condition}")
    def _(t):
        return t.tiles.where(vectors.payload_filter(**filters)).select("tile_id")


simple("FIL-01_sensor", "sensor in ('Sentinel-2A', 'Demo-MSI')", sensors=["Sentinel-2A", "Demo-MSI"])
simple("FIL-02_min_quality", "quality_score >= 0.6", min_quality=0.6)
simple("FIL-03_max_cloud", "cloud_cover_pct <= 12", max_cloud=12.0)
simple("FIL-04_date_range", "acquisition_date >= date '2019-01-01' and acquisition_date <= date '2022-06-30'", start="2019-01-01", end="2022-06-30")
simple("FIL-05_centre_in_bbox", "center_lon between 70.2 and 71.1 and center_lat between 10.05 and 10.2", bbox=(71.1, 10.05, 70.2, 10.2))
simple("FIL-06_centre_in_envelope", "center_lon between 69.95 and 71.35 and center_lat between 9.99 and 10.32", polygon=POLYGON)
simple("FIL-07_scene", "scene_id = 4", scene_id=4)
simple("FIL-08_exclude_tile", "tile_id <> 12", exclude_tile=12)


@query("FIL-09_footprint_bbox", "tiles", """
select tile_id from tiles where bbox_west <= 71.1 and bbox_east >= 70.25 and bbox_south <= 10.25 and bbox_north >= 10.05""")
def _(t):
    return t.tiles.where(geometry.boxes_touch([F.col(c) for c in BOX], (71.1, 10.25, 70.25, 10.05))).select("tile_id")


@query("FIL-10_footprint_polygon", "tiles", f"with {EDGES} {SIDES}" + """
select tile_id from sides group by 1 having bool_or(x0 <= e and x1 >= w and y0 <= n and y1 >= s and lo <= 0 and hi >= 0) or count(*) filter (corner_hit) % 2 = 1""")
def _(t):
    ring = geometry.ring_literal(POLYGON)
    return t.tiles.where(geometry.box_intersects_ring([F.col(c) for c in BOX], ring)).select("tile_id")


@query("FIL-11_footprint_within", "tiles", f"with {EDGES} {SIDES}" + """
select tile_id from sides group by 1 having not bool_or(x0 < e and x1 > w and y0 < n and y1 > s and lo < 0 and hi > 0) and count(*) filter (middle_hit) % 2 = 1""")
def _(t):
    ring = geometry.ring_literal(POLYGON)
    return t.tiles.where(geometry.box_within_ring([F.col(c) for c in BOX], ring)).select("tile_id")


@query("FIL-12_ring_from_wkt", "stac_items", """
select item_id, 5 as vertices, round(bbox_west, 6) as first_lon, round(bbox_south, 6) as last_lat, round(bbox_east, 6) as max_lon, true as usable from stac_items""")
def _(t):
    """Open rings written as text, read back and closed."""
    w, s, e, n = (F.col(c).cast("string") for c in BOX)
    pair = lambda x, y: F.concat(x, F.lit(" "), y)
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(",", pair(w, s), pair(e, s), pair(e, n), pair(w, n)), F.lit("))"))
    rings = t.stac_items.withColumn("ring", geometry.ring_from_wkt(wkt))
    rings = rings.withColumn("closed", geometry.close_ring(F.col("ring")))
    box = geometry.envelope(F.col("closed"))
    return rings.select(
        "item_id", F.size("closed").alias("vertices"), F.round(F.col("closed")[0]["lon"], 6).alias("first_lon"),
        F.round(F.element_at("closed", -1)["lat"], 6).alias("last_lat"), F.round(box[2], 6).alias("max_lon"),
        geometry.is_polygon(F.col("ring")).alias("usable"))


@query("FIL-13_effective_filters", "query_log", f"with {located('query_log', 'raw_query')}, {base('query_log', 'raw_query')}" + """
select query_id, case when query_id % 4 = 0 then 0.5::double else min_quality end as min_quality, case when query_id % 5 = 0 then 30::double else max_cloud_cover end as max_cloud,
 case when query_id % 6 = 0 then 70::double else l.west end as west, case when query_id % 6 = 0 then 12::double else l.north end as north,
 cast(datediff('day', date '1970-01-01', cast(start_date as date)) as int) as start_day, case when query_id % 7 = 0 then 'Landsat-9' else sensors end as sensors from parsed join located l using (query_id)""")
def _(t):
    parsed = queries.parse_corrected(t.query_log.withColumn("corrected_query", F.col("raw_query")))
    on = lambda n, v: F.when(F.col("query_id") % n == 0, F.lit(v))
    asked = parsed.withColumns({
        "req_min_quality": on(4, 0.5), "req_max_cloud": on(5, 30.0), "req_west": on(6, 75.0), "req_east": on(6, 70.0),
        "req_south": on(6, 12.0), "req_north": on(6, 10.0), "req_sensors": F.when(F.col("query_id") % 7 == 0, F.array(F.lit("Landsat-9")))})
    e = search.effective_filters(asked)
    return e.select("query_id", F.col("f_min_quality").alias("min_quality"), F.col("f_max_cloud").alias("max_cloud"),
                    F.col("f_west").alias("west"), F.col("f_north").alias("north"), F.col("f_start_day").alias("start_day"),
                    F.array_join("f_sensors", ",").alias("sensors"))


@query("FIL-14_valid_tiles", "tiles", "select tile_id from tiles where is_valid")
def _(t):
    return t.tiles.where(listing.tile_filter(is_valid=True)).select("tile_id")


@query("FIL-15_change_tiles_location", "tiles", """
select tile_id from tiles where is_valid and acquisition_date between date '2018-06-01' and date '2024-01-01' and center_lon between 70 and 71 and center_lat between 10 and 10.2""")
def _(t):
    return listing.change_tiles(t.tiles, "2018-06-01", "2024-01-01", location_box=(70.0, 10.0, 71.0, 10.2)).select("tile_id")


@query("FIL-15_change_tiles_archive", "tiles", "select tile_id, 1::int as match_tier from tiles where is_valid")
def _(t):
    """A location without tiles: the whole archive, if asked for."""
    return listing.change_tiles(t.tiles, location_box=(0.0, 0.0, 1.0, 1.0), widen=True).select("tile_id", "match_tier")


@query("FIL-15_change_tiles_polygon", "tiles", f"with {EDGES} {SIDES}" + """
select tile_id from sides join tiles using (tile_id) where is_valid group by 1 having bool_or(x0 <= e and x1 >= w and y0 <= n and y1 >= s and lo <= 0 and hi >= 0) or count(*) filter (corner_hit) % 2 = 1""")
def _(t):
    return listing.change_tiles(t.tiles, aoi_ring=POLYGON).select("tile_id")


@query("FIL-15_change_tiles_envelope", "tiles", """
select tile_id from tiles where is_valid and bbox_west is null and center_lon between 70 and 72 and center_lat between 10 and 10.3""")
def _(t):
    """Tiles without boxes meet no polygon: centres in its envelope."""
    ring = [(70.0, 10.0), (72.0, 10.0), (72.0, 10.3), (70.0, 10.3)]
    return listing.change_tiles(t.tiles.where("bbox_west is null"), aoi_ring=ring, widen=True).select("tile_id")


@query("FIL-16_usable_quality", "tiles", "select tile_id from tiles where quality_score is null or quality_score >= 0.25")
def _(t):
    return t.tiles.where(pairing.usable_quality(F.col("quality_score"))).select("tile_id")


@query("FIL-17_not_sliver", "tiles", """
select tile_id from tiles where case tile_id % 5 when 0 then null when 1 then 0 else pixel_width end is null or case tile_id % 5 when 1 then 256 else pixel_width end >= 32""")
def _(t):
    width = F.when(F.col("tile_id") % 5 == 0, F.lit(None).cast("int")).when(
        F.col("tile_id") % 5 == 1, 0).otherwise(F.col("pixel_width"))
    tiles = t.tiles.withColumn("pixel_width", width)
    return tiles.where(pairing.not_sliver(tiles)).select("tile_id")


@query("FIL-18_tile_filter", "tiles", "select tile_id from tiles where scene_id = 6 and is_valid and quality_score >= 0.3")
def _(t):
    return t.tiles.where(listing.tile_filter(6, True, 0.3)).select("tile_id")


@query("FIL-19_scene_filter", "scenes", "select scene_id from scenes where status = 'COMPLETED'")
def _(t):
    return t.scenes.where(listing.scene_filter("completed")).select("scene_id")


@query("FIL-20_visible_events", "events_table tiles", """
select event_id from events_table e where final_confidence >= 0.4 and exists (select 1 from tiles t where t.tile_id = e.before_tile) and exists (select 1 from tiles t where t.tile_id = e.after_tile)""")
def _(t):
    return listing.visible_events(t.events_table, t.tiles, 0.4).select("event_id")


@query("FIL-21_shown_tier", "events_table", """
select event_id, coalesce(confidence_tier, case when is_suppressed then 'Suppressed' when final_confidence >= 0.7 then 'High Confidence' when final_confidence >= 0.45 then 'Medium Confidence' else 'Low Confidence' end) as tier from events_table""")
def _(t):
    from swathe.operators.change import shown_tier
    return t.events_table.select("event_id", shown_tier(
        F.col("confidence_tier"), F.col("final_confidence"), F.col("is_suppressed")).alias("tier"))
