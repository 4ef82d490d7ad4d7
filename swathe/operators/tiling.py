"""Tile grids and per-tile raster statistics over pixel tables.

A pixel table has one row per pixel: (tile_id, y, x, band columns). Statistics
are one partial+final aggregation per tile; a tile is at most 4096 pixels wide,
so windows over one of its rows or columns are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe.config import TilingConfig
from swathe.functions import raster
from swathe.functions.numbers import as_col, clip, count_where, round_even, share
from swathe.session import plain, width_for


def beside(pixels: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Pixels with facts of their tile or scene.

    Pixel files are so small for their rows that Spark would send them all through the driver, or sort them. So the
    facts are hashed, and the pixels stream past them in tasks of bounded size that stay clustered by ``key``.
    """
    spread = pixels.repartition(width_for(pixels.sparkSession, pixels.count()), key)
    return spread.join(plain(facts).hint("shuffle_hash"), key, how)


BROADCAST_TILES = 200_000


def of_tiles(pixels: DataFrame, ids: DataFrame) -> DataFrame:
    """The pixels of the tiles in ``ids``, which may be broadcast up to ``BROADCAST_TILES`` rows (a few MB)."""
    if ids.count() <= BROADCAST_TILES:
        return pixels.join(F.broadcast(plain(ids)), "tile_id", "left_semi")
    return beside(pixels, ids, "tile_id", "left_semi")


# -- grid ----------------------------------------------------------------------

def tile_grid(scenes: DataFrame, config: TilingConfig = TilingConfig()) -> DataFrame:
    """One row per window of every scene (scene_id, width, height, ...). Narrow."""
    step, size = config.step, config.tile_size
    starts = lambda dim: F.when(F.col(dim) > 0, F.sequence(F.lit(0), F.col(dim) - 1, F.lit(step)))
    grid = scenes.select("*", F.posexplode(starts("height")).alias("tile_row", "y_off")).select(
        "*", F.posexplode(starts("width")).alias("tile_col", "x_off"))
    return grid.withColumns({
        "pixel_width": F.least(F.lit(size), F.col("width") - F.col("x_off")),
        "pixel_height": F.least(F.lit(size), F.col("height") - F.col("y_off")),
    })


def expected_grid_counts(scenes: DataFrame, config: TilingConfig = TilingConfig()) -> DataFrame:
    """Columns and rows reported as expected; with overlap the grid may hold one more."""
    size, step = config.tile_size, config.step
    overlap = size - step
    count = lambda dim: F.when(F.col(dim) > size, F.greatest(
        F.lit(1), F.floor((F.col(dim) - overlap + step - 1) / step))).otherwise(1).cast("long")
    return scenes.withColumns({"grid_cols": count("width"), "grid_rows": count("height")}).withColumn(
        "grid_total", F.col("grid_cols") * F.col("grid_rows"))


def tile_bounds(grid: DataFrame) -> DataFrame:
    """Box, centre and outline of each window of a north-up raster.

    Needs origin_x, origin_y (top-left corner) and res_x, res_y (degrees per pixel).
    """
    west = F.col("origin_x") + F.col("x_off") * F.col("res_x")
    north = F.col("origin_y") - F.col("y_off") * F.col("res_y")
    df = grid.withColumns({
        "bbox_west": west, "bbox_north": north,
        "bbox_east": west + F.col("pixel_width") * F.col("res_x"),
        "bbox_south": north - F.col("pixel_height") * F.col("res_y"),
    })
    return df.withColumns({
        "center_lon": (F.col("bbox_west") + F.col("bbox_east")) / 2,
        "center_lat": (F.col("bbox_south") + F.col("bbox_north")) / 2,
    })


def assign_pixels_to_tiles(pixels: DataFrame, config: TilingConfig = TilingConfig()) -> DataFrame:
    """Scene pixels (scene_id, y, x, bands) to the tiles that hold them.

    Arithmetic only: without overlap each pixel has one tile, with overlap the
    few tiles whose windows reach it.
    """
    step, size = config.step, config.tile_size

    def cells(axis: str) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(axis) - (size - 1)) / F.lit(float(step))).cast("int"))
        return F.sequence(first, F.floor(F.col(axis) / F.lit(step)).cast("int"))

    if step == size:
        placed = pixels.withColumns({
            "tile_row": F.floor(F.col("y") / size).cast("int"),
            "tile_col": F.floor(F.col("x") / size).cast("int")})
    else:
        placed = pixels.withColumn("tile_row", F.explode(cells("y"))).withColumn(
            "tile_col", F.explode(cells("x")))
    return placed.withColumns({
        "tile_y": (F.col("y") - F.col("tile_row") * step).cast("int"),
        "tile_x": (F.col("x") - F.col("tile_col") * step).cast("int")})


def band_roles(scenes: DataFrame) -> DataFrame:
    """Red, green and blue band numbers from band_descriptions (array<string>).

    A band named red, green or blue takes the role, the last one wins, and the
    words are tried in that order. Without all three: bands 0, 1, 2; one band
    serves all roles; two bands serve as first, second, first.
    """
    names = F.transform(F.col("band_descriptions"), lambda d: F.lower(F.coalesce(d, F.lit(""))))
    role = F.transform(names, lambda d: F.when(d.contains("red"), "red")
                       .when(d.contains("green"), "green").when(d.contains("blue"), "blue"))
    last = lambda word: F.size("band_descriptions") - F.nullif(
        F.array_position(F.reverse(role), word), F.lit(0))
    bands = F.size("band_descriptions")
    df = scenes.withColumns({f"_{w}": last(w) for w in ("red", "green", "blue")})
    named = F.col("_red").isNotNull() & F.col("_green").isNotNull() & F.col("_blue").isNotNull()
    pick = lambda word, spare, of_two: (
        F.when((bands >= 3) & named, F.col(f"_{word}")).when(bands >= 3, spare)
        .when(bands == 2, of_two).otherwise(0).cast("int"))
    return df.withColumns({
        "red_band": pick("red", 0, 0), "green_band": pick("green", 1, 1), "blue_band": pick("blue", 2, 0),
    }).drop("_red", "_green", "_blue")


# -- nodata ----------------------------------------------------------------------

def nodata_mask(bands: list[str], nodata: float | None) -> Column:
    """All bands equal the nodata value; without one, any NaN or all zero."""
    if nodata is not None and nodata == nodata:
        mask = F.lit(True)
        for band in bands:
            mask = mask & (F.col(band) == nodata)
        return mask
    any_nan, all_zero = F.lit(False), F.lit(True)
    for band in bands:
        any_nan = any_nan | F.isnan(F.col(band).cast("double"))
        all_zero = all_zero & (F.col(band) == 0)
    return any_nan | all_zero


def nodata_ratio(pixels: DataFrame, bands: list[str], nodata: float | None = None) -> DataFrame:
    return pixels.groupBy("tile_id").agg(share(nodata_mask(bands, nodata)).alias("nodata_ratio"))


def drop_nodata_tiles(tiles: DataFrame, config: TilingConfig = TilingConfig()) -> DataFrame:
    return tiles.where(F.col("nodata_ratio") <= 1.0 - config.min_valid)


def skipped_counts(tiles: DataFrame, config: TilingConfig = TilingConfig()) -> DataFrame:
    kept = F.col("nodata_ratio") <= 1.0 - config.min_valid
    return tiles.groupBy("scene_id").agg(
        count_where(kept).alias("kept"), count_where(~kept).alias("skipped"))


# -- contrast ----------------------------------------------------------------------

def band_percentiles(pixels: DataFrame, bands: list[str], nodata: float | None = None) -> DataFrame:
    """One row per tile: n, top, p2 and p98 of each band's valid finite values, as structs.

    Values are counted first, so what is shuffled is bounded by the distinct
    values of a tile and not by its pixels. The percentiles are exact.
    """
    values = F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in bands])
    kept = F.when(~nodata_mask(bands, nodata), values)
    valid = pixels.select("tile_id", F.inline(kept)).where(
        ~F.isnan("value") & (F.abs(F.col("value")) < float("inf")))
    counted = valid.groupBy("tile_id", "band", "value").agg(F.count("*").alias("n"))
    ends = F.array(F.lit(0.02), F.lit(0.98))

    def stats(band: str) -> Column:
        value = F.when(F.col("band") == band, F.col("value"))
        q = F.percentile(value, ends, F.col("n"))
        n = F.coalesce(F.sum(F.when(F.col("band") == band, F.col("n"))), F.lit(0))
        return F.struct(n.alias("n"), F.max(value).alias("top"), q[0].alias("p2"), q[1].alias("p98")).alias(
            f"{band}_stats")

    return counted.groupBy("tile_id").agg(*[stats(b) for b in bands])


def _stretched(pixels: DataFrame, bands: list[str], nodata: float | None, rule) -> dict[str, Column]:
    """``rule(value, stats, enough, spread)`` of each band; 0 where there is no data."""
    out = {}
    for band in bands:
        stats, value = F.col(f"{band}_stats"), F.col(band).cast("double")
        enough = F.coalesce(stats["n"] > 10, F.lit(False))
        spread = F.coalesce(stats["p98"] > stats["p2"], F.lit(False))
        out[band] = F.when(nodata_mask(bands, nodata), 0.0).otherwise(rule(value, stats, enough, spread))
    return out


def percentile_stretch(
    pixels: DataFrame, bands: list[str], nodata: float | None = None
) -> DataFrame:
    """Band values stretched to 0..1 between the tile's 2nd and 98th percentile."""

    def rule(value: Column, stats: Column, enough: Column, spread: Column) -> Column:
        ceiling = F.coalesce(F.nullif(stats["top"], F.lit(0.0)), F.lit(1.0))
        return (
            F.when(enough & spread, raster.stretch(value, stats["p2"], stats["p98"]))
            .when(enough, clip(value / ceiling, 0.0, 1.0))
            .otherwise(clip(value, 0.0, 1.0)))

    placed = beside(pixels, band_percentiles(pixels, bands, nodata), "tile_id", "left")
    return placed.select("tile_id", "y", "x", *[
        c.alias(band) for band, c in _stretched(pixels, bands, nodata, rule).items()])


def rgb8(pixels: DataFrame, roles: list[str], nodata: float | None = None) -> DataFrame:
    """Display bytes r, g, b per pixel; ``roles`` names the red, green, blue band."""
    bands = list(dict.fromkeys(roles))

    def rule(value: Column, stats: Column, enough: Column, spread: Column) -> Column:
        scaled = (value - stats["p2"]) / (stats["p98"] - stats["p2"]) * 255.0
        return F.when(enough & spread, clip(scaled, 0.0, 255.0)).otherwise(clip(value, 0.0, 255.0))

    placed = beside(pixels, band_percentiles(pixels, bands, nodata), "tile_id", "left")
    shown = _stretched(pixels, bands, nodata, rule)
    return placed.select("tile_id", "y", "x", *[
        F.floor(shown[role]).cast("int").alias(name) for role, name in zip(roles, ("r", "g", "b"))])


def thumbnail_stretch(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """One stretch over r, g and b together, from values above zero only."""
    bands = ["r", "g", "b"]
    if nodata is not None:
        blank = nodata_mask(bands, nodata)
        pixels = pixels.withColumns({c: F.when(blank, 0).otherwise(F.col(c)) for c in bands})
    counted = pixels.select("tile_id", F.explode(F.array(*bands)).alias("value")).groupBy(
        "tile_id", "value").agg(F.count("*").alias("n"))
    positive = F.when(F.col("value") > 0, F.col("value").cast("double"))
    quantiles = F.percentile(positive, F.array(F.lit(0.02), F.lit(0.98)), F.col("n"))
    range_ = counted.groupBy("tile_id").agg(
        quantiles.alias("q"), F.max("value").cast("double").alias("top")
    ).select("tile_id", "top", F.coalesce(F.col("q")[0], F.lit(0.0)).alias("p2"),
             F.coalesce(F.col("q")[1], F.lit(1.0)).alias("p98"))

    def shown(band: str) -> Column:
        value = F.col(band).cast("double")
        scaled = F.when(
            F.col("p98") > F.col("p2"), (value - F.col("p2")) / (F.col("p98") - F.col("p2")) * 255.0
        ).otherwise(value / F.greatest(F.col("top"), F.lit(1.0)) * 255.0)
        return F.floor(clip(scaled, 0.0, 255.0)).cast("int")

    return beside(pixels, range_, "tile_id").select(
        "tile_id", "y", "x", *[shown(b).alias(b) for b in bands])


def downsample(pixels: DataFrame, tiles: DataFrame, out_width: int, out_height: int) -> DataFrame:
    """Block means: each output pixel averages the source pixels that fall on it.

    ``tiles`` gives tile_id, pixel_width and pixel_height.
    """
    at = lambda axis, size, out: F.floor(F.col(axis) * out / F.col(size)).cast("int")
    sized = beside(pixels, tiles.select("tile_id", "pixel_width", "pixel_height"), "tile_id")
    return sized.groupBy(
        "tile_id", at("y", "pixel_height", out_height).alias("out_y"),
        at("x", "pixel_width", out_width).alias("out_x"),
    ).agg(*[F.avg(c).alias(c) for c in ("r", "g", "b")])


# -- cloud, sharpness, quality ---------------------------------------------------------

def _scaled(by) -> list[Column]:
    return [clip(F.col(c) / as_col(by), 0.0, 1.0) for c in ("r", "g", "b")]


def cloud_pct_stretched(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """Cloud share (%) of valid pixels in display bytes."""
    valid = ~nodata_mask(["r", "g", "b"], nodata)
    cloudy = valid & (raster.cloud_probability(*_scaled(255.0)) > 0.72)
    pct = F.coalesce(F.try_divide(count_where(cloudy), count_where(valid)), F.lit(0.0)) * 100.0
    return pixels.groupBy("tile_id").agg(round_even(pct, 2).alias("cloud_cover_pct"))


def reflectance_scale(top: Column) -> Column:
    return F.when(top > 5000, 10000.0).otherwise(255.0)


def cloud_pct_quick(pixels: DataFrame) -> DataFrame:
    """Cloud share (%) of all pixels; the tile's maximum tells the value range.

    Both ranges are counted in the one aggregation, then the right one is taken.
    """
    hit = lambda scale: share(raster.cloud_probability(*_scaled(scale)) > 0.75)
    top = F.max(F.greatest("r", "g", "b"))
    stats = pixels.groupBy("tile_id").agg(
        top.alias("top"), hit(255.0).alias("as_bytes"), hit(10000.0).alias("as_reflectance"))
    pct = (F.when(F.col("top") <= 0, 0.0).when(F.col("top") > 5000, F.col("as_reflectance"))
           .otherwise(F.col("as_bytes")) * 100.0)
    return stats.select("tile_id", round_even(pct, 2).alias("cloud_cover_pct"))


def tile_quality_v1(nodata: Column, cloud_pct: Column) -> Column:
    """Quality of tiles cut after a contrast stretch."""
    return clip(F.lit(1.0) - nodata * 0.5 - cloud_pct / 100.0 * 0.4, 0.0, 1.0)


def tile_quality_v2(nodata: Column, cloud_pct: Column) -> Column:
    """Quality of tiles cut straight from the source."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - nodata - cloud_pct / 200.0)


def laplacian(pixels: DataFrame, value: str, key: str = "tile_id") -> DataFrame:
    """4-neighbour Laplacian; beyond an edge the image mirrors without repeating it.

    Both windows are clustered by the tile alone, so one shuffle serves them.
    """
    return _laplacian(pixels.repartition(width_for(pixels.sparkSession, pixels.count()), key), value, key)


def _laplacian(placed: DataFrame, value: str, key: str) -> DataFrame:
    """The Laplacian of pixels that are clustered by ``key``."""
    along_x = Window.partitionBy(key, "y").orderBy("x")
    along_y = Window.partitionBy(key, "x").orderBy("y")

    def neighbours(window) -> Column:
        before, after = F.lag(value).over(window), F.lead(value).over(window)
        centre = F.col(value)
        return F.coalesce(before, after, centre) + F.coalesce(after, before, centre)

    return placed.withColumn("_sides", neighbours(along_x)).withColumn(
        "laplacian", F.col("_sides") + neighbours(along_y) - F.col(value) * 4).drop("_sides")


def laplacian_sharpness(pixels: DataFrame, value: str = "lum", key: str = "tile_id") -> DataFrame:
    """min(1, variance of the Laplacian / 1000) per tile or scene."""
    return laplacian(pixels, value, key).groupBy(key).agg(
        F.least(F.lit(1.0), F.var_pop("laplacian") / 1000.0).alias("sharpness"))


def scene_sample(pixels: DataFrame, scenes: DataFrame, limit: int = 512) -> DataFrame:
    """Nearest-pixel sample of at most ``limit`` x ``limit`` pixels per scene.

    Output pixel i shows source pixel floor((i + .5) * size / out).
    """
    out = lambda dim: F.least(F.lit(limit), F.col(dim))

    def index(axis: str, dim: str) -> Column:
        # The one output pixel whose source is this pixel, if there is one.
        guess = F.ceil((F.col(axis) * out(dim)) / F.col(dim) - 0.5).cast("int")
        source = F.floor((guess + 0.5) * F.col(dim) / out(dim)).cast("int")
        return F.when((source == F.col(axis)) & (guess < out(dim)), guess)

    sized = beside(pixels, scenes.select("scene_id", "width", "height"), "scene_id")
    return sized.withColumns({"_y": index("y", "height"), "_x": index("x", "width")}).where(
        F.col("_y").isNotNull() & F.col("_x").isNotNull()
    ).drop("y", "x", "width", "height").withColumnsRenamed({"_y": "y", "_x": "x"})


def scene_assessment(sample: DataFrame, nodata: float | None = None) -> DataFrame:
    """nodata, cloud, sharpness and quality per scene of three-band samples."""
    bands = ["r", "g", "b"]
    missing = F.lit(False)
    for band in bands:
        missing = missing | (F.col(band) == (0.0 if nodata is None else nodata))
    tops = sample.groupBy("scene_id").agg(F.max(F.greatest(*bands)).alias("top"))
    scale = F.when(F.col("top") <= 1.0, 1.0).otherwise(reflectance_scale(F.col("top")))
    # This join leaves all rows of a scene in one task, so the windows of the Laplacian need no further shuffle.
    scaled = sample.join(tops.hint("shuffle_hash"), "scene_id").withColumn("missing", missing).withColumns(
        dict(zip(bands, _scaled(scale))))
    scaled = scaled.withColumns({
        "cloudy": (raster.cloud_probability(*map(F.col, bands)) > 0.75) & ~F.col("missing"),
        "lum": F.floor((F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114) * 255.0),
    })
    stats = _laplacian(scaled, "lum", "scene_id").groupBy("scene_id").agg(
        share(F.col("missing")).alias("nodata_ratio"),
        round_even(share(F.col("cloudy")) * 100.0, 2).alias("cloud_cover_pct"),
        F.least(F.lit(1.0), F.var_pop("laplacian") / 1000.0).alias("sharpness"))
    stats = stats.withColumn("sharpness", round_even(F.col("sharpness"), 4))
    return stats.withColumn("quality_score", assessment_score(
        F.col("cloud_cover_pct"), F.col("nodata_ratio"), F.col("sharpness")))


def assessment_score(cloud_pct: Column, nodata: Column, sharpness: Column) -> Column:
    """Scene quality; without a cloud figure none is deducted, without sharpness .7 stands in."""
    cloud = F.coalesce(cloud_pct / 100.0, F.lit(0.0))
    sharp = F.coalesce(sharpness, F.lit(0.7))
    return (F.lit(1.0) - cloud * 0.5) * (F.lit(1.0) - nodata * 0.3) * (sharp * 0.7 + 0.3)


def scene_rollup(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("scene_id").agg(F.count("*").alias("tile_count")).withColumn(
        "status", F.lit("COMPLETED"))
