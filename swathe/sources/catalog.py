"""The catalogue: reading, checking, appending, replacing and deleting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe import schemas

PARTITIONS = {"tiles": ["sensor", "acq_year"], "scenes": ["acq_year"]}


def read_catalog(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A catalogue table with its declared schema; nothing is inferred."""
    return spark.read.schema(schemas.TABLES[table]).parquet(f"{root}/{table}")


def read_catalog_jdbc(spark: SparkSession, table: str, **options: str) -> DataFrame:
    """The same table from a database; arrays and maps arrive as JSON text and are parsed."""
    raw = spark.read.format("jdbc").options(dbtable=table, **options).load()
    columns = []
    for field in schemas.TABLES[table]:
        nested = field.dataType.typeName() in ("array", "map", "struct")
        column = F.from_json(F.col(field.name), field.dataType) if nested else F.col(
            field.name).cast(field.dataType)
        columns.append(column.alias(field.name))
    return raw.select(*columns)


def validate_catalog(df: DataFrame, table: str, id_col: str,
                     rules: dict[str, str] | None = None) -> DataFrame:
    """(id, rule) for every broken constraint, in one pass over the table."""
    rules = schemas.CONSTRAINTS[table] if rules is None else rules
    checks = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.coalesce(~F.expr(rule), F.lit(False)).alias("broken"))
        for name, rule in rules.items()])
    return df.select(F.col(id_col), F.inline(checks)).where("broken").select(id_col, "rule")


def append(df: DataFrame, root: str, table: str) -> None:
    """Append a batch; tiles and scenes are laid out by sensor and year so filters prune."""
    keys = PARTITIONS.get(table, [])
    if "acq_year" in keys:
        df = df.withColumn("acq_year", F.coalesce(F.year("acquisition_date"), F.lit(0)))
    writer = df.write.mode("append")
    (writer.partitionBy(*keys) if keys else writer).parquet(f"{root}/{table}")


def replace_scene_tiles(tiles: DataFrame, new: DataFrame, scene_ids: DataFrame | None = None) -> DataFrame:
    """Drop all tiles of the re-tiled scenes and add the new ones."""
    ids = (new if scene_ids is None else scene_ids).select("scene_id").distinct()
    return tiles.join(ids, "scene_id", "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_vectors(vectors: DataFrame, batch: DataFrame) -> DataFrame:
    """Latest vector per (collection, tile); doing it twice changes nothing.

    ``max_by`` keeps one row per key before the shuffle. At equal times the
    batch wins.
    """
    both = vectors.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    rest = [c for c in vectors.columns if c not in ("collection", "tile_id")]
    newest = F.max_by(F.struct(*rest), F.struct("embedded_at", "_new", F.xxhash64("vector")))
    return both.groupBy("collection", "tile_id").agg(newest.alias("v")).select(
        "collection", "tile_id", "v.*")


def fetch_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("tile_id").distinct(), "tile_id", "left_semi")


def vector_exists(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """(tile_id, found) for every id asked."""
    known = vectors.select("tile_id").distinct().withColumn("_k", F.lit(True))
    return ids.select("tile_id").distinct().join(known, "tile_id", "left").select(
        "tile_id", F.coalesce("_k", F.lit(False)).alias("found"))


def delete_scenes(catalog: dict[str, DataFrame], scene_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove scenes with what hangs on them.

    Their tiles and vectors go; events stay and lose the reference to a removed
    tile. Tables missing from ``catalog`` are left out of the result.
    """
    out = dict(catalog)
    ids = scene_ids.select("scene_id").distinct()
    gone = catalog["tiles"].join(ids, "scene_id", "left_semi").select("tile_id").distinct()
    out["scenes"] = catalog["scenes"].join(ids, "scene_id", "left_anti")
    out["tiles"] = catalog["tiles"].join(ids, "scene_id", "left_anti")
    if "vectors" in catalog:
        out["vectors"] = catalog["vectors"].join(gone, "tile_id", "left_anti")
    if "change_events" in catalog:
        events = catalog["change_events"]
        columns = events.columns
        for side in ("before_tile", "after_tile"):
            mark = gone.select(F.col("tile_id").alias(side), F.lit(True).alias("_gone"))
            events = events.join(mark, side, "left").withColumn(
                side, F.when(F.col("_gone").isNull(), F.col(side))).drop("_gone")
        out["change_events"] = events.select(*columns)
    return out


def delete_events(catalog: dict[str, DataFrame], event_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove events and the decisions taken on them."""
    ids = event_ids.select("event_id").distinct()
    return {name: df.join(ids, "event_id", "left_anti") if name in ("change_events", "decisions") else df
            for name, df in catalog.items()}


def prune_orphan_vectors(vectors: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors whose tile exists, number removed per collection)."""
    ids = tiles.select("tile_id").distinct()
    kept = vectors.join(ids, "tile_id", "left_semi")
    removed = vectors.join(ids, "tile_id", "left_anti").groupBy("collection").agg(
        F.count("*").alias("removed"))
    return kept, removed


def provenance_records(df: DataFrame, id_col: str, entity_type: str, operation: str,
                       details: list[str], at: Column | None = None) -> DataFrame:
    """One audit row per row of ``df``; ``details`` names the columns to record."""
    pairs = [x for name in details for x in (F.lit(name), F.col(name).cast("string"))]
    return df.select(
        F.col(id_col).alias("entity_id"), F.lit(entity_type).alias("entity_type"),
        F.lit(operation).alias("operation"), F.create_map(*pairs).alias("details"),
        F.lit("system").alias("operator"),
        (F.current_timestamp() if at is None else at).alias("recorded_at"))


def append_history(tiles: DataFrame, step: str, at: Column, details: Column | None = None,
                   when: Column | None = None) -> DataFrame:
    """Add an entry to processing_history (of the rows that satisfy ``when``)."""
    details = F.create_map().cast("map<string,string>") if details is None else details
    entry = F.struct(F.lit(step).alias("step"), at.cast("timestamp").alias("at"), details.alias("details"))
    kind = "array<struct<step:string,at:timestamp,details:map<string,string>>>"
    old = F.coalesce(F.col("processing_history"), F.array().cast(kind))
    added = F.array_append(old, entry)
    return tiles.withColumn(
        "processing_history", added if when is None else F.when(when, added).otherwise(old))


def latest_provenance(entities: DataFrame, provenance: DataFrame, operation: str,
                      id_col: str = "tile_id") -> DataFrame:
    """Left-join the newest record of an operation.

    ``max_by`` reduces the records before the shuffle, however many one entity has.
    """
    newest = provenance.where(F.col("operation") == operation).groupBy("entity_id").agg(
        F.max_by(F.struct("details", "recorded_at"), "recorded_at").alias("p")).select(
        F.col("entity_id").alias(id_col), F.col("p.details").alias("provenance_details"),
        F.col("p.recorded_at").alias("provenance_at"))
    return entities.join(newest, id_col, "left")
