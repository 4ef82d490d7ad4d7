"""Files to catalogue: scenes, tiles, rejects and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.config import TilingConfig
from swathe.operators import tiling
from swathe.sources import catalog, files


def scene_records(listing: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenes, rejects) from a listing (path, length, checksum) and raster headers.

    ``headers`` has path, tags, width, height, band_count, origin_x, origin_y,
    res_x, res_y, is_projected, is_geographic. A file that is no scene file, has
    no header or no pixels becomes a reject row and never fails the job.
    """
    df = listing.join(headers, "path", "left")
    reason = (
        F.when(~files.is_scene_file(F.col("path")), "unsupported file")
        .when(F.col("width").isNull(), "unreadable raster")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "zero dimensions")
        .when(F.col("band_count") <= 0, "no bands"))
    df = df.withColumn("reason", reason)
    date = files.acquisition_date(F.col("tags"), F.col("path"))
    scenes = df.where(F.col("reason").isNull()).withColumn("_date", date).withColumns({
        "scene_id": F.sha2(F.concat_ws("|", "checksum", "path"), 256),
        "filename": files.file_name(F.col("path")),
        "acquisition_date": F.col("_date.at"),
        **files.sensor_platform(F.col("tags"), F.col("path")),
        "resolution_m": files.resolution_metres(
            F.col("res_x"), F.col("is_projected"), F.col("is_geographic")),
    }).drop("_date", "reason")
    rejects = df.where(F.col("reason").isNotNull()).select("path", "reason")
    return scenes, rejects


def ingest_batch(listing: DataFrame, headers: DataFrame,
                 config: TilingConfig = TilingConfig()) -> dict[str, DataFrame]:
    """scenes, tiles, rejects and provenance for a batch of files; copies count once."""
    unique = files.dedupe_by_checksum(listing)
    scenes, rejects = scene_records(unique, headers)
    tiles = tiling.tile_bounds(tiling.tile_grid(scenes, config)).withColumn(
        "tile_id", F.sha2(F.concat_ws("|", "scene_id", "tile_col", "tile_row"), 256))
    counts = tiling.scene_rollup(tiles)
    scenes = scenes.join(counts, "scene_id", "left")
    audit = catalog.provenance_records(
        scenes, "scene_id", "scene", "ingestion", ["path", "checksum", "tile_count"],
        at=F.col("modificationTime"))
    return {"scenes": scenes, "tiles": tiles, "rejects": rejects, "provenance": audit}
