"""A stored table of vectors with the attributes that searches filter by.

Rows carry a copy of their tile's attributes, so that a search reads one table: filters on plain columns
reach the Parquet scan, and collection and sensor are folders that a search skips. Inside them rows are
spread over buckets by a hash of the tile id, and an upsert rewrites only the buckets that its batch
touches. An upsert is made whole in the shared folder before it replaces anything, so repeating it after
a lost executor or driver gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe.session import cut_lineage

LAYOUT = ["collection", "sensor", "bucket"]
NO_SENSOR = "none"
FOOTPRINT = [f"bbox_{side}" for side in ("west", "south", "east", "north")]
PAYLOAD = ["scene_id", "sensor", "resolution_m", "quality_score", "cloud_cover_pct", "acquisition_date", "acq_day",
           "center_lon", "center_lat", *FOOTPRINT, "is_valid"]


def days(column: Column) -> Column:
    return F.datediff(column.cast("date"), F.lit("1970-01-01").cast("date"))


def with_payload(vectors: DataFrame, tiles: DataFrame) -> DataFrame:
    """Vectors of existing tiles with their attributes. This is where tiles and vectors are joined: once, when
    vectors are stored."""
    attributes = [c for c in PAYLOAD if c in tiles.columns and c != "acq_day"]
    known = tiles.select("tile_id", *attributes, days(F.col("acquisition_date")).alias("acq_day"))
    return vectors.drop(*attributes, "acq_day").join(known, "tile_id")


class VectorStore:
    """The table under ``path``; ``buckets`` per collection and sensor are fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({
            "sensor": F.coalesce("sensor", F.lit(NO_SENSOR)),
            "bucket": F.pmod(F.xxhash64(F.col("tile_id").cast("string")), F.lit(self.buckets)).cast("int")})

    def create(self, rows: DataFrame) -> VectorStore:
        """Store ``collection, tile_id, vector, embedded_at`` and the payload; one file per folder."""
        self._laid_out(rows).repartition(*LAYOUT).sortWithinPartitions(*LAYOUT, "tile_id").write.mode(
            "overwrite").partitionBy(*LAYOUT).parquet(self.path)
        return self

    def read(self) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        return rows.withColumn("sensor", F.when(F.col("sensor") != NO_SENSOR, F.col("sensor")))

    def collection(self, name: str) -> DataFrame:
        return self.read().where(F.col("collection") == name)

    def upsert(self, batch: DataFrame) -> None:
        """Newest row per (collection, tile); at equal times the batch wins, and doing it twice changes nothing.

        A tile's sensor is that of its scene and does not change. Only folders that the batch touches are
        read and rewritten; their list is bounded by the layout.
        """
        new = cut_lineage(self._laid_out(batch))
        touched = new.select(*LAYOUT).distinct().collect()
        if not touched:
            return
        stored = self.spark.read.option("basePath", self.path).parquet(self.path)
        here = F.lit(False)
        by_folder: dict[tuple, list[int]] = {}
        for r in touched:
            by_folder.setdefault((r["collection"], r["sensor"]), []).append(r["bucket"])
        for (collection, sensor), buckets in sorted(by_folder.items()):
            here = here | ((F.col("collection") == collection) & (F.col("sensor") == sensor) & F.col("bucket").isin(buckets))
        columns = stored.columns
        both = stored.where(here).withColumn("_new", F.lit(0)).unionByName(
            new.select(*columns).withColumn("_new", F.lit(1)))
        rest = [c for c in columns if c not in (*LAYOUT, "tile_id")]
        newest = F.max_by(F.struct(*rest), F.struct("embedded_at", "_new", F.xxhash64("vector")))
        merged = cut_lineage(both.groupBy(*LAYOUT, "tile_id").agg(newest.alias("v")).select(*LAYOUT, "tile_id", "v.*"))
        merged.select(*columns).repartition(*LAYOUT).sortWithinPartitions(*LAYOUT, "tile_id").write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(self.path)
