"""Land-cover shares and photometric quality of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe.functions import raster
from swathe.functions.numbers import clip, count_where, round_even


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def landcover(pixels: DataFrame, key: str = "tile_id") -> DataFrame:
    """water_pct, veg_pct, urban_pct of each tile's valid pixels. One aggregation."""
    counts = pixels.groupBy(key).agg(
        count_where(~raster.is_black(*_rgb())).alias("valid"),
        count_where(raster.landcover_water(*_rgb())).alias("water"),
        count_where(raster.landcover_vegetation(*_rgb())).alias("veg"))
    base = F.greatest(F.lit(1), F.col("valid"))
    pct = lambda c: round_even(F.least(F.lit(100.0), F.col(c) / base * 100.0), 1)
    return counts.select(key, pct("water").alias("water_pct"), pct("veg").alias("veg_pct")).withColumn(
        "urban_pct",
        F.greatest(F.lit(0.0), round_even(F.lit(100.0) - F.col("water_pct") - F.col("veg_pct"), 1)))


def landcover_or_default(tiles: DataFrame, cover: DataFrame) -> DataFrame:
    """Tiles without pixels count as wholly built-up."""
    return tiles.join(cover, "tile_id", "left").withColumns({
        "water_pct": F.coalesce("water_pct", F.lit(0.0)),
        "veg_pct": F.coalesce("veg_pct", F.lit(0.0)),
        "urban_pct": F.coalesce("urban_pct", F.lit(100.0))})


def row_banding_noise(pixels: DataFrame) -> DataFrame:
    """Mean step between neighbouring row means over their mean, at most 1."""
    rows = pixels.groupBy("tile_id", "y").agg(F.avg(raster.gray8(*_rgb())).alias("row_mean"))
    return _noise_from_rows(rows)


def _noise_from_rows(rows: DataFrame) -> DataFrame:
    step = F.abs(F.col("row_mean") - F.lag("row_mean").over(
        Window.partitionBy("tile_id").orderBy("y")))
    return rows.withColumn("step", step).groupBy("tile_id").agg(
        F.least(F.lit(1.0), F.avg("step") / (F.avg("row_mean") + F.lit(1e-5))).alias("noise_score"))


def photometric_quality(pixels: DataFrame) -> DataFrame:
    """nodata, cloud, shadow, saturation, noise and the composite score per tile.

    Pixels are read and shuffled once: they are reduced to row sums by (tile,
    row), and the tile figures and the row-to-row noise both come from those.
    """
    rows = pixels.groupBy("tile_id", "y").agg(
        F.count("*").alias("n"), F.avg(raster.gray8(*_rgb())).alias("row_mean"),
        count_where(raster.is_black(*_rgb())).alias("black"),
        count_where(raster.quality_cloud(*_rgb())).alias("cloud"),
        count_where(raster.quality_shadow(*_rgb())).alias("shadow"),
        count_where(raster.quality_saturated(*_rgb())).alias("saturated"))
    step = F.abs(F.col("row_mean") - F.lag("row_mean").over(
        Window.partitionBy("tile_id").orderBy("y")))
    part = lambda c: F.sum(c) / F.sum("n")
    stats = rows.withColumn("step", step).groupBy("tile_id").agg(
        part("black").alias("nodata_score"), part("cloud").alias("cloud_score"),
        part("shadow").alias("shadow_score"), part("saturated").alias("saturation_score"),
        F.least(F.lit(1.0), F.avg("step") / (F.avg("row_mean") + F.lit(1e-5))).alias("noise_score"))
    seen = F.lit(1.0) - F.least(F.lit(1.0), F.col("nodata_score") + F.col("cloud_score"))
    marred = (F.col("shadow_score") * 0.25 + F.col("noise_score") * 0.20
              + F.col("saturation_score") * 0.15)
    score = round_even(seen * F.greatest(F.lit(0.0), F.lit(1.0) - marred), 4)
    stats = stats.withColumn("quality_score", clip(score, 0.0, 1.0))
    return stats.withColumns(suitability(
        F.col("quality_score"), F.col("cloud_score"), F.col("nodata_score")))


def suitability(quality: Column, cloud: Column, nodata: Column) -> dict[str, Column]:
    word = (
        F.when((quality >= 0.75) & (cloud < 0.20) & (nodata < 0.15), "Suitable")
        .when((quality >= 0.40) & (cloud < 0.50) & (nodata < 0.40), "Caution")
        .otherwise("Poor Quality"))
    return {"suitability": word, "usable_for_change": word == "Suitable"}


# What a tile without a readable image counts as.
UNREADABLE = {
    "quality_score": 0.0, "cloud_score": 0.0, "shadow_score": 0.0, "nodata_score": 1.0,
    "noise_score": 0.0, "saturation_score": 0.0, "suitability": "Poor Quality",
    "usable_for_change": False,
}


def quality_or_default(tiles: DataFrame, quality: DataFrame) -> DataFrame:
    """Every tile with its quality row, the unreadable default where there is none."""
    keep = tiles.drop(*UNREADABLE)
    return keep.join(quality.select("tile_id", *UNREADABLE), "tile_id", "left").withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) for name, value in UNREADABLE.items()})


def scene_quality(scenes: DataFrame, tile_quality: DataFrame) -> DataFrame:
    """Counts, means and verdict per scene; a scene without tiles is poor and empty."""
    is_ = lambda word: F.col("suitability") == word
    stats = tile_quality.groupBy("scene_id").agg(
        F.count("*").alias("tile_count"),
        count_where(is_("Suitable")).alias("tiles_suitable"),
        count_where(is_("Caution")).alias("tiles_caution"),
        count_where(is_("Poor Quality")).alias("tiles_poor"),
        F.avg("quality_score").alias("avg_quality"),
        F.avg(F.col("cloud_score") * 100.0).alias("avg_cloud_pct"),
        F.avg("nodata_score").alias("avg_nodata"), F.avg("shadow_score").alias("avg_shadow"),
        F.avg("noise_score").alias("avg_noise"), F.avg("saturation_score").alias("avg_saturation"))
    df = scenes.select("scene_id").join(stats, "scene_id", "left")
    zero = F.lit(0)
    df = df.withColumns({
        **{c: F.coalesce(F.col(c), zero.cast("long"))
           for c in ("tile_count", "tiles_suitable", "tiles_caution", "tiles_poor")},
        "avg_nodata": F.coalesce(F.col("avg_nodata"), F.lit(1.0)),
        **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in (
            "avg_quality", "avg_cloud_pct", "avg_shadow", "avg_noise", "avg_saturation")}})
    total = F.nullif(F.col("tile_count"), F.lit(0))
    verdict = (
        F.when((F.col("avg_quality") >= 0.75) & (F.col("tiles_suitable") / total >= 0.70), "Suitable")
        .when((F.col("avg_quality") >= 0.40)
              & ((F.col("tiles_suitable") + F.col("tiles_caution")) / total >= 0.50), "Caution")
        .otherwise("Poor Quality"))
    return df.withColumn("suitability", verdict).withColumn(
        "usable_for_change", F.col("suitability") == "Suitable")


def apply_quality(tiles: DataFrame, quality: DataFrame) -> DataFrame:
    """Write measured quality back to the tiles that were measured; poor tiles turn invalid."""
    measured = quality.select(
        "tile_id", F.col("quality_score").alias("_q"), F.col("cloud_score").alias("_c"),
        F.col("nodata_score").alias("_n"), F.col("suitability").alias("_s"))
    seen = F.col("_q").isNotNull()
    return tiles.join(measured, "tile_id", "left").withColumns({
        "quality_score": F.when(seen, F.col("_q")).otherwise(F.col("quality_score")),
        "cloud_cover_pct": F.when(seen, round_even(F.col("_c") * 100.0, 2)).otherwise(
            F.col("cloud_cover_pct")),
        "nodata_ratio": F.when(seen, F.col("_n")),
        "is_valid": F.when(seen, F.col("_s") != "Poor Quality").otherwise(F.col("is_valid")),
    }).drop("_q", "_c", "_n", "_s")


def apply_scene_quality(scenes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Write the scene means back to the scene rows."""
    new = verdicts.select(
        "scene_id", F.col("avg_quality").alias("quality_score"),
        F.col("avg_cloud_pct").alias("cloud_cover_pct"), F.col("suitability"))
    return scenes.drop("quality_score", "cloud_cover_pct", "suitability").join(new, "scene_id", "left")


def in_quality_band(quality: Column, is_valid: Column, band: str) -> Column:
    """Display bands: suitable, caution, poor. No score counts as 1.0; an invalid tile is
    poor whatever its score."""
    score = F.coalesce(quality, F.lit(1.0))
    bands = {
        "suitable": score >= 0.75,
        "caution": (score >= 0.40) & (score < 0.75),
        "poor": (score < 0.40) | ~F.coalesce(is_valid, F.lit(True)),
    }
    return bands[band]
