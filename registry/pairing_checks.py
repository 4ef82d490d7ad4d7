"""Joins and pairing (JON-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query
from swathe.operators import pairing
from swathe.plans import search
from swathe.sources import catalog

SCENE_PAIRS = """
env as (select scene_id, min(acquisition_date) as d, min(bbox_west) as w, min(bbox_south) as s, max(bbox_east) as e, max(bbox_north) as n from tiles group by 1),
sp as (select a.scene_id as before_scene, b.scene_id as after_scene, a.d as before_date, b.d as after_date from env a join env b
 on a.d < b.d and least(a.e, b.e) > greatest(a.w, b.w) and least(a.n, b.n) > greatest(a.s, b.s))"""
IOU = """case when least(a.bbox_east, b.bbox_east) > greatest(a.bbox_west, b.bbox_west) and least(a.bbox_north, b.bbox_north) > greatest(a.bbox_south, b.bbox_south) then
 (least(a.bbox_east, b.bbox_east) - greatest(a.bbox_west, b.bbox_west)) * (least(a.bbox_north, b.bbox_north) - greatest(a.bbox_south, b.bbox_south)) /
 ((a.bbox_east - a.bbox_west) * (a.bbox_north - a.bbox_south) + (b.bbox_east - b.bbox_west) * (b.bbox_north - b.bbox_south) -
  (least(a.bbox_east, b.bbox_east) - greatest(a.bbox_west, b.bbox_west)) * (least(a.bbox_north, b.bbox_north) - greatest(a.bbox_south, b.bbox_south))) else 0.0 end"""
ALL_PAIRS = SCENE_PAIRS + f""",
ok as (select * from tiles where coalesce(nullif(pixel_width, 0), 256) >= 32 and coalesce(nullif(pixel_height, 0), 256) >= 32),
raw as (select sp.before_scene, sp.after_scene, a.tile_id as before_tile, b.tile_id as after_tile,
 sqrt((a.center_lon - b.center_lon) ** 2 + (a.center_lat - b.center_lat) ** 2) as dist, a.tile_col = b.tile_col and a.tile_row = b.tile_row as same,
 a.bbox_west is not null and b.bbox_west is not null as boxed, {IOU} as i0
 from sp join ok a on a.scene_id = sp.before_scene join ok b on b.scene_id = sp.after_scene),
cand as (select *, case when boxed then i0 when dist < 0.001 then 1.0 else 0.0 end as iou from raw),
fit as (select *, case when iou > 0 then iou else greatest(0.0, 1 - 100 * dist) end as match_score from cand where iou >= 0.7 or (same and dist < 0.0015))"""


def sides(t):
    return pairing._sides(t.tiles, pairing.scene_pairs(t.tiles))


@query("JON-01_tiles_with_scene", "tiles scenes", """
select tile_id, scene_id, filename from tiles join scenes using (scene_id)""")
def _(t):
    return search.enrich(t.tiles.select("tile_id"), t.tiles, t.scenes, None, only_valid=False).select(
        "tile_id", "scene_id", "filename")


@query("JON-02_latest_provenance", "tiles provenance", """
select tile_id, p.event_id, cast(p.recorded_at as string) as recorded_at from tiles left join (
 select * from (select *, row_number() over (partition by entity_id order by recorded_at desc, event_id desc) as rn from provenance where operation = 'embedding') x where rn = 1) p on p.entity_id = tile_id""")
def _(t):
    p = t.provenance.withColumn("details", F.struct("event_id"))
    return catalog.latest_provenance(t.tiles, p, "embedding").select(
        "tile_id", F.col("provenance_details.event_id").alias("event_id"),
        F.col("provenance_at").cast("string").alias("recorded_at"))


@query("JON-03_candidate_semi", "tiles vectors", """
select collection, tile_id from vectors where tile_id in (select tile_id from tiles where is_valid)""")
def _(t):
    found = search.enrich(t.vectors.select("collection", "tile_id"), t.tiles, t.tiles.select(
        "scene_id").distinct().withColumn("filename", F.lit("")), None, only_valid=True)
    return found.select("collection", "tile_id")


@query("JON-04_scene_pairs", "tiles", "with" + SCENE_PAIRS + """
select before_scene, after_scene, cast(before_date as string) as before_date, cast(after_date as string) as after_date from sp""")
def _(t):
    p = pairing.scene_pairs(t.tiles)
    return p.select("before_scene", "after_scene", F.col("before_date").cast("string").alias("before_date"),
                    F.col("after_date").cast("string").alias("after_date"))


@query("JON-05_pairs_by_iou", "tiles", "with" + ALL_PAIRS + """
select before_scene, after_scene, before_tile, after_tile from cand where boxed and iou >= 0.7""")
def _(t):
    return pairing.pairs_by_iou(*sides(t)).select("before_scene", "after_scene", "before_tile", "after_tile")


@query("JON-05_pairs_by_iou_half", "tiles", "with" + ALL_PAIRS + """
select before_scene, after_scene, before_tile, after_tile from cand where boxed and iou >= 0.5""")
def _(t):
    return pairing.pairs_by_iou(*sides(t), 0.5).select("before_scene", "after_scene", "before_tile", "after_tile")


@query("JON-06_pairs_by_grid", "tiles", "with" + ALL_PAIRS + """
select before_scene, after_scene, before_tile, after_tile, round(dist, 8) as dist from cand where same and dist < 0.0015""")
def _(t):
    p = pairing.pairs_by_grid(*sides(t))
    return p.select("before_scene", "after_scene", "before_tile", "after_tile",
                    F.round(pairing._centre_distance(), 8).alias("dist"))


@query("JON-07_pairs_by_centre", "tiles", "with" + ALL_PAIRS + """
select before_scene, after_scene, before_tile, after_tile from cand where not boxed and dist < 0.001""")
def _(t):
    return pairing.pairs_by_centre(*sides(t)).select("before_scene", "after_scene", "before_tile", "after_tile")


@query("JON-08_candidate_pairs", "tiles", "with" + ALL_PAIRS + """
select before_scene, after_scene, before_tile, after_tile, round(iou, 8) as iou, round(match_score, 8) as match_score from fit""")
def _(t):
    p = pairing.candidate_pairs(t.tiles, pairing.scene_pairs(t.tiles))
    return p.select("before_scene", "after_scene", "before_tile", "after_tile",
                    F.round("iou", 8).alias("iou"), F.round("match_score", 8).alias("match_score"))


# Loose pairs: every two tiles of a scene pair within .12 degrees, scored by distance and id.
LOOSE = SCENE_PAIRS + """,
loose as (select sp.before_scene, sp.after_scene, a.tile_id as before_tile, b.tile_id as after_tile,
 cast((a.tile_id * 31 + b.tile_id * 17) % 97 as double) as match_score from sp join tiles a on a.scene_id = sp.before_scene join tiles b on b.scene_id = sp.after_scene
 where abs(a.tile_col - b.tile_col) <= 1 and abs(a.tile_row - b.tile_row) <= 1),
ranked as (select *, row_number() over (partition by before_scene, after_scene order by match_score desc, before_tile, after_tile) as rn from loose)"""


@query("JON-09_greedy_match", "tiles", "with" + LOOSE + """,
walk as (select before_scene, after_scene, list(struct_pack(b := before_tile, a := after_tile) order by rn) as todo from ranked group by 1, 2),
done as (select before_scene, after_scene, list_reduce(list_prepend(struct_pack(bs := [-1::bigint], az := [-1::bigint]), list_transform(todo, lambda p: struct_pack(bs := [p.b], az := [p.a]))),
  lambda acc, p: case when list_contains(acc.bs, p.bs[1]) or list_contains(acc.az, p.az[1]) then acc else struct_pack(bs := list_concat(acc.bs, p.bs), az := list_concat(acc.az, p.az)) end) as m from walk)
select before_scene, after_scene, m.bs[i] as before_tile, m.az[i] as after_tile from done, unnest(range(2, len(m.bs) + 1)) as u(i)""")
def _(t):
    pairs = pairing.scene_pairs(t.tiles)
    a = t.tiles.select(*[F.col(c).alias(f"a_{c}") for c in ("scene_id", "tile_id", "tile_col", "tile_row")])
    near = a.withColumn("col", F.explode(F.sequence(F.col("a_tile_col") - 1, F.col("a_tile_col") + 1))).withColumn(
        "row", F.explode(F.sequence(F.col("a_tile_row") - 1, F.col("a_tile_row") + 1)))
    b = t.tiles.select(F.col("scene_id").alias("after_scene"), F.col("tile_id").alias("after_tile"),
                       F.col("tile_col").alias("col"), F.col("tile_row").alias("row"))
    loose = near.withColumnRenamed("a_scene_id", "before_scene").join(
        pairs.select("before_scene", "after_scene"), "before_scene").join(b, ["after_scene", "col", "row"])
    loose = loose.withColumn("before_tile", F.col("a_tile_id")).withColumns({
        "iou": F.lit(0.0),
        "match_score": ((F.col("before_tile") * 31 + F.col("after_tile") * 17) % 97).cast("double")})
    return pairing.greedy_match(loose).select("before_scene", "after_scene", "before_tile", "after_tile")


@query("JON-09_matched_pairs", "tiles", "with" + ALL_PAIRS + """,
good as (select tile_id from tiles where quality_score is null or quality_score >= 0.25)
select before_tile, after_tile from (select *, count(*) over (partition by before_scene, after_scene, before_tile) as nb, count(*) over (partition by before_scene, after_scene, after_tile) as na from fit) f
where nb = 1 and na = 1 and before_tile in (select tile_id from good) and after_tile in (select tile_id from good)""")
def _(t):
    return pairing.matched_pairs(t.tiles).select("before_tile", "after_tile")


def _pairs(t):
    """Tile n with tile n + 25: the same grid position of the next scene."""
    k = F.col("tile_id")
    return t.tiles.select(
        k.alias("pair_id"), k.alias("before_tile"), (k + 25).alias("after_tile"),
        F.col("scene_id").alias("before_scene"), (F.col("scene_id") + 1).alias("after_scene"), "resolution_m")


@query("JON-10_pair_vectors", "tiles vectors", """
select p.tile_id as pair_id, a.vector is not null as has_before, b.vector is not null as has_after, round(cast(a.vector[2] as double), 6) as x from tiles p
left join (select * from vectors where collection = 'visual') a on a.tile_id = p.tile_id left join (select * from vectors where collection = 'visual') b on b.tile_id = p.tile_id + 25""")
def _(t):
    from swathe.operators import vectors
    v = vectors.pair_vectors(_pairs(t), t.vectors.where("collection = 'visual'"))
    return v.select("pair_id", F.col("before_vector").isNotNull().alias("has_before"),
                    F.col("after_vector").isNotNull().alias("has_after"),
                    F.round(F.get("before_vector", F.lit(1)).cast("double"), 6).alias("x"))


@query("JON-11_pair_pixels", "pixels", """
select a.tile_id as pair_id, count(*) as n, cast(sum(a.r * b.g) as bigint) as rg, cast(sum(a.b * b.b * (a.x + 1)) as bigint) as bb from pixels a join pixels b on b.tile_id = a.tile_id + 25 and a.y = b.y and a.x = b.x
group by 1""")
def _(t):
    p = pairing.pair_pixels(_pairs(t), t.pixels)
    return p.groupBy("pair_id").agg(
        F.count("*").alias("n"), F.sum(F.col("r1") * F.col("g2")).alias("rg"),
        F.sum(F.col("b1") * F.col("b2") * (F.col("x") + 1)).alias("bb"))


@query("JON-11_pair_pixels_resized", "pixels", """
select a.tile_id as pair_id, count(*) as n, cast(sum(a.r * b.g) as bigint) as rg from pixels a join pixels b on b.tile_id = a.tile_id + 25 and b.y = floor((a.y + 0.5) * 32 / 20) and b.x = floor((a.x + 0.5) * 32 / 24)
where a.y < 20 and a.x < 24 group by 1""")
def _(t):
    # Earlier images are cropped; every tile is also a later image, whole, under another id.
    later = F.col("tile_id") + 1000000
    sized = _pairs(t).withColumns({"after_tile": F.col("after_tile") + 1000000, "before_width": F.lit(24), "before_height": F.lit(20),
                                   "after_width": F.lit(32), "after_height": F.lit(32)})
    small = t.pixels.where("y < 20 and x < 24").unionByName(t.pixels.withColumn("tile_id", later))
    p = pairing.pair_pixels(sized, small)
    return p.groupBy("pair_id").agg(F.count("*").alias("n"), F.sum(F.col("r1") * F.col("g2")).alias("rg"))


@query("JON-12_scene_names", "tiles scenes", """
select t.tile_id as pair_id, lower(a.filename) as before_name, lower(b.filename) as after_name from tiles t
left join scenes a on a.scene_id = t.scene_id left join scenes b on b.scene_id = t.scene_id + 1""")
def _(t):
    return pairing.scene_names(_pairs(t), t.scenes).select("pair_id", "before_name", "after_name")
