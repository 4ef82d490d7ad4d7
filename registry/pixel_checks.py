"""Tiling, raster statistics, land cover and image quality (TIL-*, SPC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import query
from swathe.config import TilingConfig
from swathe.functions import raster
from swathe.operators import landcover, tiling


def rgb():
    return F.col("r"), F.col("g"), F.col("b")

OVERLAPPED = TilingConfig(tile_size=128, overlap=32)


def r6(name):
    return F.round(F.col(name), 6).alias(name)


GRID_SQL = """
grid as (select scene_id, brand, width, height, origin_x, origin_y, res_x, res_y, cast(x_off / {step} as int) as tile_col, cast(y_off / {step} as int) as tile_row,
 cast(x_off as int) as x_off, cast(y_off as int) as y_off, cast(least({size}, width - x_off) as int) as pixel_width, cast(least({size}, height - y_off) as int) as pixel_height
 from rasters, unnest(range(0, width, {step})) a(x_off), unnest(range(0, height, {step})) b(y_off))"""


@query("TIL-01_tile_grid", "rasters", "with" + GRID_SQL.format(step=512, size=512) + """
select scene_id, tile_col, tile_row, x_off, y_off, pixel_width, pixel_height from grid""")
def _(t):
    return tiling.tile_grid(t.rasters).select(
        "scene_id", "tile_col", "tile_row", "x_off", "y_off", "pixel_width", "pixel_height")


@query("TIL-01_tile_grid_overlap", "rasters", "with" + GRID_SQL.format(step=96, size=128) + """
select brand, count(*) as n, cast(sum(pixel_width * pixel_height) as bigint) as area, cast(sum(tile_col) as bigint) as cols, cast(max(tile_row) as bigint) as top from grid group by brand""")
def _(t):
    g = tiling.tile_grid(t.rasters, OVERLAPPED)
    return g.groupBy("brand").agg(
        F.count("*").alias("n"), F.sum(F.col("pixel_width") * F.col("pixel_height")).alias("area"),
        F.sum("tile_col").alias("cols"), F.max("tile_row").cast("long").alias("top"))


@query("TIL-02_expected_grid_counts", "rasters", """
select scene_id, cols as grid_cols, rows_ as grid_rows, cols * rows_ as grid_total from (select scene_id,
 cast(case when width > 128 then greatest(1, (width - 32 + 95) // 96) else 1 end as bigint) as cols,
 cast(case when height > 128 then greatest(1, (height - 32 + 95) // 96) else 1 end as bigint) as rows_ from rasters) x""")
def _(t):
    return tiling.expected_grid_counts(t.rasters, OVERLAPPED).select(
        "scene_id", "grid_cols", "grid_rows", "grid_total")


@query("TIL-03_tile_bounds", "rasters", "with" + GRID_SQL.format(step=512, size=512) + """
select scene_id, tile_col, tile_row, round(origin_x + x_off * res_x, 8) as bbox_west, round(origin_y - (y_off + pixel_height) * res_y, 8) as bbox_south,
 round(origin_x + (x_off + pixel_width) * res_x, 8) as bbox_east, round(origin_y - y_off * res_y, 8) as bbox_north,
 round(origin_x + (x_off + pixel_width / 2) * res_x, 8) as center_lon, round(origin_y - (y_off + pixel_height / 2) * res_y, 8) as center_lat from grid""")
def _(t):
    b = tiling.tile_bounds(tiling.tile_grid(t.rasters))
    return b.select("scene_id", "tile_col", "tile_row", *[F.round(c, 8).alias(c) for c in (
        "bbox_west", "bbox_south", "bbox_east", "bbox_north", "center_lon", "center_lat")])


def _scene_pixels(t):
    """Each tile of the fixture seen as a scene of 32 x 32 pixels."""
    return t.pixels.withColumnRenamed("tile_id", "scene_id")


@query("TIL-04_assign_pixels", "pixels", """
select tile_id as scene_id, cast(y // 10 as int) as tile_row, cast(x // 10 as int) as tile_col, count(*) as n, cast(sum(r * (y % 10)) as bigint) as ry, cast(sum(g * (x % 10)) as bigint) as gx
from pixels group by all""")
def _(t):
    class Ten:
        tile_size, step = 10, 10

    p = tiling.assign_pixels_to_tiles(_scene_pixels(t), Ten())
    return p.groupBy("scene_id", "tile_row", "tile_col").agg(
        F.count("*").alias("n"), F.sum(F.col("r") * F.col("tile_y")).alias("ry"),
        F.sum(F.col("g") * F.col("tile_x")).alias("gx"))


@query("TIL-04_assign_pixels_overlap", "pixels", """
select tile_id as scene_id, cast(a.n as int) as tile_row, cast(b.n as int) as tile_col, count(*) as n, cast(sum(r * (y - a.n * 6)) as bigint) as ry, cast(sum(g * (x - b.n * 6)) as bigint) as gx
from pixels join range(6) a(n) on y >= a.n * 6 and y < a.n * 6 + 10 join range(6) b(n) on x >= b.n * 6 and x < b.n * 6 + 10 group by all""")
def _(t):
    class TenBySix:
        tile_size, step = 10, 6

    p = tiling.assign_pixels_to_tiles(_scene_pixels(t), TenBySix())
    return p.groupBy("scene_id", "tile_row", "tile_col").agg(
        F.count("*").alias("n"), F.sum(F.col("r") * F.col("tile_y")).alias("ry"),
        F.sum(F.col("g") * F.col("tile_x")).alias("gx"))


BANDS = ["Red", "NIR infrared", "green edge", "Blue", "Band_5", "Deep blue", "GREEN", "alpha"]


@query("TIL-05_band_roles", "", f"""
with d as (select p_partkey as scene_id, list_transform(range(0, 1 + p_partkey % 6), lambda i: {BANDS}[cast((p_partkey + i * (1 + p_partkey % 3)) % 8 + 1 as int)]) as bands from part),
e as (select scene_id, len(bands) as n, i, lower(bands[i + 1]) as w from d, unnest(range(0, 8)) as u(i) where i < len(bands)),
f as (select scene_id, max(n) as n, max(case when w like '%red%' then i end) as r, max(case when w not like '%red%' and w like '%green%' then i end) as g,
 max(case when w not like '%red%' and w not like '%green%' and w like '%blue%' then i end) as b from e group by 1)
select scene_id, cast(case when n >= 3 and r is not null and g is not null and b is not null then r else 0 end as int) as red_band,
 cast(case when n >= 3 and r is not null and g is not null and b is not null then g when n >= 2 then 1 else 0 end as int) as green_band,
 cast(case when n >= 3 and r is not null and g is not null and b is not null then b when n >= 3 then 2 else 0 end as int) as blue_band from f""")
def _(t):
    names = F.array(*[F.lit(b) for b in BANDS])
    key = F.col("p_partkey")
    scenes = t.part.select(key.alias("scene_id"), F.transform(
        F.sequence(F.lit(0), key % 6), lambda i: F.element_at(
            names, ((key + i * (key % 3 + 1)) % 8 + 1).cast("int"))).alias("band_descriptions"))
    return tiling.band_roles(scenes).select("scene_id", "red_band", "green_band", "blue_band")


@query("TIL-06_nodata_ratio", "images", """
select tile_id, round(avg(cast(r = 0 and g = 0 and b = 0 as int)), 6) as zero_ratio, round(avg(cast(r = 1 and g = 1 and b = 1 as int)), 6) as ones_ratio from images group by 1""")
def _(t):
    zero = tiling.nodata_ratio(t.images, ["r", "g", "b"])
    ones = tiling.nodata_ratio(t.images, ["r", "g", "b"], 1.0).withColumnRenamed("nodata_ratio", "ones_ratio")
    return zero.join(ones, "tile_id").select("tile_id", r6("nodata_ratio").alias("zero_ratio"), r6("ones_ratio"))


@query("TIL-07_drop_nodata_tiles", "images", """
select tile_id from images group by 1 having avg(cast(r < 8 and g < 8 and b < 8 as int)) <= 0.85 and true
 and avg(cast(r = 2 and g = 2 and b = 2 as int)) <= 1 - 0.9""")
def _(t):
    black = t.images.groupBy("tile_id").agg(
        F.avg(raster.is_black(*rgb()).cast("int")).alias("nodata_ratio"))
    kept = tiling.drop_nodata_tiles(black, TilingConfig(min_valid=0.15)).select("tile_id")
    two = tiling.drop_nodata_tiles(
        tiling.nodata_ratio(t.images, ["r", "g", "b"], 2.0), TilingConfig(min_valid=0.9))
    return kept.join(two.select("tile_id"), "tile_id")


@query("TIL-07_skipped_counts", "images tiles", """
select scene_id, count(*) filter (nd <= 0.9) as kept, count(*) filter (nd > 0.9) as skipped from (
 select tile_id, avg(cast(r = 0 and g = 0 and b = 0 as int)) * 6 as nd from images group by 1) x join tiles using (tile_id) group by 1""")
def _(t):
    nd = tiling.nodata_ratio(t.images, ["r", "g", "b"]).withColumn("nodata_ratio", F.col("nodata_ratio") * 6)
    return tiling.skipped_counts(
        nd.join(t.tiles.select("tile_id", "scene_id"), "tile_id"), TilingConfig(min_valid=0.1))


STRETCH_SQL = """
with l as (select tile_id, y, x, 'r' as band, cast(r as double) as v, r = 0 and g = 0 and b = 0 as nd from images
 union all select tile_id, y, x, 'g', g, r = 0 and g = 0 and b = 0 from images union all select tile_id, y, x, 'b', b, r = 0 and g = 0 and b = 0 from images),
q as (select tile_id, band, count(*) as n, max(v) as top, quantile_cont(v, 0.02) as p2, quantile_cont(v, 0.98) as p98 from l where not nd group by 1, 2)
"""


@query("TIL-08_percentile_stretch", "images", STRETCH_SQL + """
select tile_id, band, count(*) as n, round(sum(case when nd then 0 when q.n > 10 and p98 > p2 then least(1.0, greatest(0.0, (v - p2) / (p98 - p2)))
 when q.n > 10 then least(1.0, v / (case when top = 0 then 1 else top end)) else least(1.0, v) end), 5) as total from l left join q using (tile_id, band) group by 1, 2""")
def _(t):
    sums = tiling.percentile_stretch(t.images, ["r", "g", "b"]).groupBy("tile_id").agg(
        F.count("*").alias("n"), *[F.round(F.sum(c), 5).alias(c) for c in ("r", "g", "b")])
    return sums.unpivot(["tile_id", "n"], ["r", "g", "b"], "band", "total")


@query("TIL-09_rgb8", "images", STRETCH_SQL + """
select tile_id, cast(sum(v8) filter (band = 'r') as bigint) as r, cast(sum(v8) filter (band = 'g') as bigint) as g, cast(sum(v8) filter (band = 'b') as bigint) as b from (
 select tile_id, band, floor(case when nd then 0 when q.n > 10 and p98 > p2 then least(255.0, greatest(0.0, (v - p2) / (p98 - p2) * 255)) else v end) as v8
 from l left join q using (tile_id, band)) x group by 1""")
def _(t):
    out = tiling.rgb8(t.images, ["r", "g", "b"])
    return out.groupBy("tile_id").agg(*[F.sum(c).alias(c) for c in ("r", "g", "b")])


@query("TIL-10_thumbnail_stretch", "images", """
with l as (select tile_id, r as v from images union all select tile_id, g from images union all select tile_id, b from images),
q as (select tile_id, max(v) as top, quantile_cont(cast(v as double), 0.02) filter (v > 0) as p2, quantile_cont(cast(v as double), 0.98) filter (v > 0) as p98 from l group by 1)
select tile_id, cast(sum(floor(case when p98 > p2 then least(255.0, greatest(0.0, (r - p2) / (p98 - p2) * 255)) else r / greatest(top, 1) * 255 end)) as bigint) as r,
 cast(sum(floor(case when p98 > p2 then least(255.0, greatest(0.0, (b - p2) / (p98 - p2) * 255)) else b / greatest(top, 1) * 255 end)) as bigint) as b
from images join q using (tile_id) group by 1""")
def _(t):
    return tiling.thumbnail_stretch(t.images).groupBy("tile_id").agg(
        F.sum("r").alias("r"), F.sum("b").alias("b"))


@query("TIL-11_downsample", "pixels", """
select tile_id, cast(y * 8 // 32 as int) as out_y, cast(x * 16 // 32 as int) as out_x, round(avg(r), 6) as r, round(avg(g), 6) as g, round(avg(b), 6) as b from pixels group by all""")
def _(t):
    size = t.tiles.select("tile_id", F.lit(32).alias("pixel_width"), F.lit(32).alias("pixel_height"))
    return tiling.downsample(t.pixels, size, 16, 8).select("tile_id", "out_y", "out_x", r6("r"), r6("g"), r6("b"))


PROB = "(({r} + {g} + {b}) / 3.0 * (1.0 - (abs({r} - {g}) + abs({g} - {b}) + abs({r} - {b})) / 3.0))"
BYTES = PROB.format(r="(r / 255.0::double)", g="(g / 255.0::double)", b="(b / 255.0::double)")


@query("TIL-12_cloud_pct_stretched", "images", f"""
select tile_id, round_even(coalesce(count(*) filter ({BYTES} > 0.72 and not nd) / nullif(count(*) filter (not nd), 0), 0)::double * 100, 2)::double as cloud_cover_pct
from (select *, r = 0 and g = 0 and b = 0 as nd from images) x group by 1""")
def _(t):
    return tiling.cloud_pct_stretched(t.images)


@query("TIL-13_cloud_pct_quick", "images", f"""
select tile_id, round_even(avg(cast({BYTES} > 0.75 as int))::double * 100, 2)::double as cloud_cover_pct from images group by 1""")
def _(t):
    return tiling.cloud_pct_quick(t.images)


@query("TIL-14_tile_quality", "", """
select l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, 1 - 0.5 * nd - 0.4 * c / 100)), 8) as v1, round(greatest(0.0, 1 - nd - c / 200), 8) as v2
from (select l_orderkey, l_linenumber, cast(l_quantity as double) / 40 as nd, cast(l_suppkey % 101 as double) as c from lineitem) x""")
def _(t):
    nd, cloud = F.col("l_quantity") / 40, (F.col("l_suppkey") % 101).cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             F.round(tiling.tile_quality_v1(nd, cloud), 8).alias("v1"),
                             F.round(tiling.tile_quality_v2(nd, cloud), 8).alias("v2"))


LAPLACE = """
lap as (select *, coalesce(lag({v}) over hx, lead({v}) over hx) + coalesce(lead({v}) over hx, lag({v}) over hx)
 + coalesce(lag({v}) over vy, lead({v}) over vy) + coalesce(lead({v}) over vy, lag({v}) over vy) - 4 * {v} as l from {src}
 window hx as (partition by {k}, y order by x), vy as (partition by {k}, x order by y))"""


@query("TIL-15_scene_assessment", "images", "with s as (select *, floor((r / 255.0::double * 0.299 + g / 255.0::double * 0.587 + b / 255.0::double * 0.114) * 255) as lum, "
       f"r = 0 or g = 0 or b = 0 as nd, {BYTES} > 0.75 and not (r = 0 or g = 0 or b = 0) as cl from images),"
       + LAPLACE.format(v="lum", src="s", k="tile_id") + """
select tile_id as scene_id, round(avg(cast(nd as int)), 6) as nodata_ratio, round_even(avg(cast(cl as int))::double * 100, 2)::double as cloud_cover_pct,
 round(least(1.0, var_pop(l) / 1000), 3) as sharpness from lap group by 1""")
def _(t):
    scenes = t.images.withColumnRenamed("tile_id", "scene_id")
    size = t.tiles.select(F.col("tile_id").alias("scene_id"), F.lit(32).alias("width"), F.lit(32).alias("height"))
    a = tiling.scene_assessment(tiling.scene_sample(scenes, size))
    return a.select("scene_id", r6("nodata_ratio"), "cloud_cover_pct", F.round("sharpness", 3).alias("sharpness"))


@query("TIL-15_scene_sample", "pixels", """
select tile_id as scene_id, count(*) as n, cast(sum(r) as bigint) as r, cast(sum(b) as bigint) as b from pixels
where y in (select floor((i + 0.5) * 32 / 12) from range(12) t(i)) and x in (select floor((i + 0.5) * 32 / 12) from range(12) t(i)) group by 1""")
def _(t):
    size = t.tiles.select(F.col("tile_id").alias("scene_id"), F.lit(32).alias("width"), F.lit(32).alias("height"))
    s = tiling.scene_sample(_scene_pixels(t), size, 12)
    return s.groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("b").alias("b"))


@query("TIL-16_laplacian_sharpness", "pixels", "with s as (select * from pixels)," + LAPLACE.format(v="g", src="s", k="tile_id") + """
select tile_id, cast(sum(l) as bigint) as total, cast(sum(l * l) as bigint) as squares, round(least(1.0, var_pop(l) / 1000), 8) as sharpness from lap group by 1""")
def _(t):
    sharp = tiling.laplacian_sharpness(t.pixels, "g").select(
        "tile_id", F.round("sharpness", 8).alias("sharpness"))
    sums = tiling.laplacian(t.pixels, "g").groupBy("tile_id").agg(
        F.sum("laplacian").alias("total"), F.sum(F.col("laplacian") * F.col("laplacian")).alias("squares"))
    return sums.join(sharp, "tile_id")


@query("TIL-17_scene_rollup", "tiles", "select scene_id, count(*) as tile_count, 'COMPLETED' as status from tiles group by 1")
def _(t):
    return tiling.scene_rollup(t.tiles)


# -- land cover and quality -----------------------------------------------------------------

WATER = """(not (r < 8 and g < 8 and b < 8) and (
 (b > 1.08::double * r and b > 25 and r < 110) or (g > 1.15::double * r and b > 0.95::double * r and r < 90 and g < 140)
 or (b between 10 and 50 and r <= 45 and g <= 55 and (b >= r or g >= r) and b + g > 1.8::double * r)
 or (r < 35 and b >= 12 and b < 65 and g >= 12 and g < 65 and r < 0.9::double * b)))"""
HSV = """(select *, case when h0 < 0 then h0 + 180 else h0 end as h from (
 select *, case when mx = 0 then 0 else floor((d * round_even(255.0::double * 4096 / mx, 0) + 2048) / 4096) end as s,
  case when d = 0 then 0 else floor((case when mx = r then g - b when mx = g then b - r + 2 * d else r - g + 4 * d end * round_even(180.0::double * 4096 / (6.0::double * d), 0) + 2048) / 4096) end as h0
 from (select *, greatest(r, g, b) as mx, greatest(r, g, b) - least(r, g, b) as d from {src}) a) b)"""


@query("SPC-01_landcover", "images", f"""
select tile_id, water_pct, veg_pct, round_even(100 - water_pct - veg_pct, 1) as urban_pct from (
 select tile_id, round_even(least(100.0, w / n * 100)::double, 1)::double as water_pct, round_even(least(100.0, v / n * 100)::double, 1)::double as veg_pct from (
  select tile_id, greatest(1, count(*) filter (not (r < 8 and g < 8 and b < 8)))::double as n, count(*) filter ({WATER}) as w,
   count(*) filter (not (r < 8 and g < 8 and b < 8) and not {WATER} and ((h between 25 and 85 and s >= 25 and mx >= 30) or ((2.0::double * g - r - b) / (2.0::double * g + r + b + 1e-6) > 0.06 and mx >= 30))) as v
  from {HSV.format(src='images')} p group by 1) x) y""")
def _(t):
    return landcover.landcover(t.images)


@query("SPC-01_landcover_gradients", "pixels", f"""
select tile_id, count(*) filter ({WATER}) as water, count(*) filter (not (r < 8 and g < 8 and b < 8) and not {WATER} and
 ((h between 25 and 85 and s >= 25 and mx >= 30) or ((2.0::double * g - r - b) / (2.0::double * g + r + b + 1e-6) > 0.06 and mx >= 30))) as veg
from {HSV.format(src='pixels')} p group by 1""")
def _(t):
    from swathe.functions.numbers import count_where
    return t.pixels.groupBy("tile_id").agg(
        count_where(raster.landcover_water(*rgb())).alias("water"),
        count_where(raster.landcover_vegetation(*rgb())).alias("veg"))


@query("SPC-02_hsv8", "pixels", f"""
select tile_id, cast(sum(h) as bigint) as h, cast(sum(s) as bigint) as s, cast(sum(mx) as bigint) as v, cast(sum(h * y) as bigint) as hy from {HSV.format(src='pixels')} p group by 1""")
def _(t):
    h, s, v = raster.hsv8(*rgb())
    return t.pixels.groupBy("tile_id").agg(
        F.sum(h).alias("h"), F.sum(s).alias("s"), F.sum(v).alias("v"), F.sum(h * F.col("y")).alias("hy"))


@query("SPC-03_indices", "pixels", """
select tile_id, round(sum((2.0::double * g - r - b) / (2.0::double * g + r + b + 1e-6)), 5) as gli, round(sum((b - r) / (b + r + 1e-5)), 5) as ndwi,
 round(sum((greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + 1e-5)), 5) as whiteness from pixels group by 1""")
def _(t):
    return t.pixels.groupBy("tile_id").agg(
        F.round(F.sum(raster.gli(*rgb())), 5).alias("gli"),
        F.round(F.sum(raster.ndwi_rgb(F.col("r"), F.col("b"))), 5).alias("ndwi"),
        F.round(F.sum(raster.whiteness(*rgb())), 5).alias("whiteness"))


GRAY = "floor((9798 * r + 19235 * g + 3735 * b + 16384) / 32768)"
NOISE_SQL = f"""
noise as (select tile_id, least(1.0, avg(step) / (avg(m) + 1e-5)) as noise_score from (
 select *, abs(m - lag(m) over (partition by tile_id order by y)) as step from (select tile_id, y, avg({GRAY}) as m from {{src}} group by 1, 2) a) b group by 1)"""
QUALITY_SQL = NOISE_SQL.format(src="images") + """,
marks as (select *, r < 8 and g < 8 and b < 8 as nd, least(r, g, b) as mn, greatest(r, g, b) as mx from images),
shares as (select tile_id, avg(cast(nd as int)) as nodata_score, avg(cast(not nd and mn > 195 and (mx - mn) / (mx + 1e-5) < 0.15 as int)) as cloud_score,
 avg(cast(not nd and mx < 40 and not (((b - r) / (b + r + 1e-5) > 0.08 and r < 95 and b > r * 1.05::double) or (b > r * 1.1::double and g > r * 1.1::double and r < 65 and b + g > 25)) as int)) as shadow_score,
 avg(cast(not nd and mn > 240 and not (mn > 195 and (mx - mn) / (mx + 1e-5) < 0.15) as int)) as saturation_score from marks group by 1),
q as (select *, (1 - least(1.0, nodata_score + cloud_score)) * greatest(0.0, 1 - (0.25 * shadow_score + 0.2 * noise_score + 0.15 * saturation_score)) as exact
 from shares join noise using (tile_id)),
quality as (select *, case when exact >= 0.75 and cloud_score < 0.2 and nodata_score < 0.15 then 'Suitable' when exact >= 0.4 and cloud_score < 0.5 and nodata_score < 0.4 then 'Caution' else 'Poor Quality' end as suitability from q)"""
PARTS = ["nodata_score", "cloud_score", "shadow_score", "saturation_score", "noise_score"]


@query("SPC-04_photometric_quality", "images", "with" + QUALITY_SQL + """
select tile_id, round(nodata_score, 6) as nodata_score, round(cloud_score, 6) as cloud_score, round(shadow_score, 6) as shadow_score,
 round(saturation_score, 6) as saturation_score, round(noise_score, 6) as noise_score, round_even(exact, 4)::double as quality_score from quality""")
def _(t):
    return landcover.photometric_quality(t.images).select("tile_id", *[r6(c) for c in PARTS], "quality_score")


@query("SPC-05_row_banding_noise", "pixels", "with" + NOISE_SQL.format(src="pixels") + "select tile_id, round(noise_score, 6) as noise_score from noise")
def _(t):
    return landcover.row_banding_noise(t.pixels).select("tile_id", r6("noise_score"))


@query("SPC-06_suitability", "signals", """
select case_id, s as suitability, s = 'Suitable' as usable_for_change from (select case_id,
 case when image_quality >= 0.75 and shadow_score < 0.2 and cloud_score < 0.15 then 'Suitable' when image_quality >= 0.4 and shadow_score < 0.5 and cloud_score < 0.4 then 'Caution' else 'Poor Quality' end as s from signals) x""")
def _(t):
    return t.signals.select("case_id", *[c.alias(n) for n, c in landcover.suitability(
        F.col("image_quality"), F.col("shadow_score"), F.col("cloud_score")).items()])


@query("SPC-07_quality_or_default", "images tiles", "with" + QUALITY_SQL + """
select tile_id, coalesce(suitability, 'Poor Quality') as suitability, round(coalesce(nodata_score, 1.0), 6) as nodata_score
from tiles left join (select * from quality where tile_id % 13 <> 4) q2 using (tile_id)""")
def _(t):
    q = landcover.photometric_quality(t.images.where("tile_id % 13 <> 4"))
    return landcover.quality_or_default(t.tiles, q).select("tile_id", "suitability", r6("nodata_score"))


SCENE_QUALITY_SQL = QUALITY_SQL + """,
tq as (select t.scene_id, coalesce(suitability, 'Poor Quality') as suitability, coalesce(round_even(exact, 4)::double, 0) as q, coalesce(nodata_score, 1) as nd, coalesce(cloud_score, 0) as cl,
 coalesce(noise_score, 0) as ns from tiles t left join (select * from quality where tile_id % 13 <> 4) x using (tile_id) where scene_id % 6 <> 5),
sq as (select c.scene_id, count(tq.q) as tile_count, count(*) filter (suitability = 'Suitable') as tiles_suitable, count(*) filter (suitability = 'Caution') as tiles_caution,
 coalesce(avg(q), 0) as aq, coalesce(avg(nd), 1) as an, coalesce(avg(cl) * 100, 0) as ac, coalesce(avg(ns), 0) as ans from scenes c left join tq on tq.scene_id = c.scene_id group by 1)"""


@query("SPC-08_scene_quality", "images tiles scenes", "with" + SCENE_QUALITY_SQL + """
select scene_id, tile_count, tiles_suitable, tiles_caution, round(aq, 6) as avg_quality, round(an, 6) as avg_nodata, round(ac, 6) as avg_cloud_pct, round(ans, 6) as avg_noise,
 case when aq >= 0.75 and tiles_suitable / tile_count >= 0.7 then 'Suitable' when aq >= 0.4 and (tiles_suitable + tiles_caution) / tile_count >= 0.5 then 'Caution' else 'Poor Quality' end as suitability from sq""")
def _(t):
    q = landcover.photometric_quality(t.images.where("tile_id % 13 <> 4"))
    tq = landcover.quality_or_default(t.tiles, q).where("scene_id % 6 <> 5")
    return landcover.scene_quality(t.scenes, tq).select(
        "scene_id", "tile_count", "tiles_suitable", "tiles_caution", r6("avg_quality"), r6("avg_nodata"),
        r6("avg_cloud_pct"), r6("avg_noise"), "suitability")


@query("SPC-09_apply_quality", "images tiles", "with" + QUALITY_SQL + """
select tile_id, case when q.tile_id is not null then q.suitability <> 'Poor Quality' else t.is_valid end as is_valid,
 round(case when q.tile_id is not null then round_even(exact, 4)::double else t.quality_score end, 3) as quality_score,
 case when q.tile_id is null then t.cloud_cover_pct else round_even(cloud_score * 100, 2)::double end as cloud_cover_pct
from tiles t left join (select * from quality where tile_id % 13 <> 4) q using (tile_id)""")
def _(t):
    q = landcover.photometric_quality(t.images.where("tile_id % 13 <> 4"))
    return landcover.apply_quality(t.tiles, q).select(
        "tile_id", "is_valid", F.round("quality_score", 3).alias("quality_score"), "cloud_cover_pct")


@query("SPC-10_quality_band", "tiles", """
select tile_id, coalesce(quality_score, 1) >= 0.75 as suitable, coalesce(quality_score, 1) >= 0.4 and coalesce(quality_score, 1) < 0.75 as caution,
 coalesce(quality_score, 1) < 0.4 or not is_valid as poor from tiles""")
def _(t):
    return t.tiles.select("tile_id", *[
        landcover.in_quality_band(F.col("quality_score"), F.col("is_valid"), b).alias(b)
        for b in ("suitable", "caution", "poor")])
