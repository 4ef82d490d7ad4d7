"""Listings, pages, counts and dashboard figures over the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.functions import geometry
from swathe.functions.numbers import count_where, round_even


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1). Count with a separate plan: it reads no columns."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def scene_filter(status: str | None) -> Column:
    return F.lit(True) if status is None else F.col("status") == status.upper()


def list_scenes(scenes: DataFrame, number: int = 1, size: int = 20, status: str | None = None) -> DataFrame:
    return page(scenes.where(scene_filter(status)), [F.desc("created_at"), F.col("scene_id")], number, size)


def tile_filter(scene_id=None, is_valid: bool | None = None, min_quality: float | None = None) -> Column:
    condition = F.lit(True)
    if scene_id is not None:
        condition = condition & (F.col("scene_id") == scene_id)
    if is_valid is not None:
        condition = condition & (F.col("is_valid") == is_valid)
    if min_quality is not None:
        condition = condition & (F.col("quality_score") >= min_quality)
    return condition


def list_tiles(tiles: DataFrame, number: int = 1, size: int = 50, **filters) -> DataFrame:
    order = [F.col("tile_row"), F.col("tile_col"), F.col("tile_id")]
    return page(tiles.where(tile_filter(**filters)), order, number, size)


def tiles_for_scene(tiles: DataFrame, scene_id, limit: int = 200) -> DataFrame:
    return list_tiles(tiles, 1, limit, scene_id=scene_id, is_valid=True)


def visible_events(events: DataFrame, tiles: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Events of at least this confidence whose two tiles still exist."""
    out = events.where(F.col("final_confidence") >= min_confidence)
    for side in ("before_tile", "after_tile"):
        out = out.join(tiles.select(F.col("tile_id").alias(side)), side, "left_semi")
    return out


def list_events(events: DataFrame, tiles: DataFrame, skip: int = 0, limit: int = 50,
                min_confidence: float = 0.0) -> DataFrame:
    return visible_events(events, tiles, min_confidence).orderBy(
        F.desc("detected_at"), "event_id").offset(skip).limit(limit)


def get_by_id(df: DataFrame, id_col: str, value) -> DataFrame:
    return df.where(F.col(id_col) == value)


def keyset_page(df: DataFrame, after=None, size: int = 250, id_col: str = "tile_id") -> DataFrame:
    """The next rows after a cursor; the comparison reaches the scan."""
    rows = df if after is None else df.where(F.col(id_col) > after)
    return rows.orderBy(id_col).limit(size)


# -- counts ----------------------------------------------------------------------------

def embedded_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.where(F.col("vector_id").isNotNull())


def sensor_counts(tiles: DataFrame) -> DataFrame:
    return embedded_tiles(tiles).where(F.col("sensor").isNotNull()).groupBy("sensor").agg(
        F.count("*").alias("tiles")).orderBy("sensor")


def search_bounds(tiles: DataFrame) -> DataFrame:
    return embedded_tiles(tiles).agg(
        F.min("acquisition_date").alias("min_date"), F.max("acquisition_date").alias("max_date"),
        F.coalesce(F.min("quality_score"), F.lit(0.0)).alias("min_quality"),
        F.coalesce(F.max("cloud_cover_pct"), F.lit(100.0)).alias("max_cloud_cover"),
        F.count("*").alias("total_indexed_tiles"))


def embedding_status(scenes: DataFrame, tiles: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Progress of embedding per scene, with the newest embedding job if jobs are given."""
    counts = tiles.groupBy("scene_id").agg(
        F.count("*").alias("total_tiles"),
        count_where(F.col("vector_id").isNotNull()).alias("embedded_tiles"),
        F.max("embedded_at").alias("last_embedded_at"))
    df = scenes.select("scene_id").join(counts, "scene_id", "left").withColumns({
        c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total_tiles", "embedded_tiles")})
    done, total = F.col("embedded_tiles"), F.col("total_tiles")
    df = df.withColumns({
        "pending_tiles": F.greatest(F.lit(0).cast("long"), total - done),
        "progress_pct": round_even(F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0)), 1),
        "status": F.when(done == 0, "NOT_STARTED").when(done == total, "COMPLETED").otherwise("PARTIAL"),
    })
    if jobs is None:
        return df
    newest = jobs.where(F.col("job_type") == "embedding").groupBy("related_entity_id").agg(
        F.max_by("job_id", F.struct("created_at", "job_id")).alias("active_job_id"))
    return df.join(newest.withColumnRenamed("related_entity_id", "scene_id"), "scene_id", "left")


def embedded_count_rollup(scenes: DataFrame, tiles: DataFrame) -> DataFrame:
    counts = embedded_tiles(tiles).groupBy("scene_id").agg(F.count("*").alias("embedded_count"))
    return scenes.drop("embedded_count").join(counts, "scene_id", "left").withColumn(
        "embedded_count", F.coalesce("embedded_count", F.lit(0).cast("long")))


def collection_stats(vectors: DataFrame) -> DataFrame:
    """Points, dimension and bytes (four per component) of each collection."""
    return vectors.groupBy("collection").agg(
        F.count("*").alias("points"), F.max(F.size("vector")).cast("long").alias("dim"),
        F.sum(F.size("vector").cast("long") * 4).alias("bytes"))


def dashboard_totals(scenes: DataFrame) -> DataFrame:
    """Figures over completed scenes."""
    done = F.col("status") == "COMPLETED"
    return scenes.agg(
        count_where(done).alias("completed_scenes"),
        F.coalesce(F.sum(F.when(done, F.col("tile_count"))), F.lit(0).cast("long")).alias("total_tiles"),
        F.coalesce(F.sum(F.when(done, F.col("embedded_count"))), F.lit(0).cast("long")).alias("total_embedded"),
        F.count_distinct(F.when(done, F.nullif("sensor", F.lit("")))).alias("sensors"))


def newest_scenes(scenes: DataFrame, n: int = 5) -> DataFrame:
    return scenes.orderBy(F.desc("created_at"), "scene_id").limit(n)


def tier_counts(events: DataFrame) -> DataFrame:
    """Events per tab. Tabs overlap: a stored tier and the score may each put an event in one."""
    score = F.coalesce("final_confidence", F.lit(0.0))
    tier, hidden = F.col("confidence_tier"), F.col("is_suppressed")
    is_ = lambda word: F.coalesce(tier == word, F.lit(False))
    tabs = {
        "all": F.lit(True),
        "high": is_("High Confidence") | (~hidden & (score >= 0.70)),
        "medium": is_("Medium Confidence") | (~hidden & (score >= 0.45) & (score < 0.70)),
        "low": is_("Low Confidence") | (~hidden & (score < 0.45)),
        "suppressed": hidden | is_("Suppressed"),
    }
    return events.agg(*[count_where(condition).alias(name) for name, condition in tabs.items()])


def model_eval_rates(cases: DataFrame) -> DataFrame:
    """Rates (%) over labelled cases: kind, is_suppressed, expected_tier, confidence_tier,
    expected_suppressed, latency_ms. A case passes on its tier or on its flag."""
    alarm, real = F.col("kind").contains("false_alarm"), F.col("kind").contains("true_")
    hidden = F.col("is_suppressed")
    passed = (F.col("confidence_tier") == F.col("expected_tier")) | (hidden == F.col("expected_suppressed"))
    rate = lambda hit, of: F.coalesce(
        F.try_divide(count_where(hit & of) * 100.0, count_where(of)), F.lit(100.0))
    return cases.agg(
        rate(hidden, alarm).alias("suppression_rate"), rate(~hidden, real).alias("retention_rate"),
        rate(passed, F.lit(True)).alias("accuracy"), F.avg("latency_ms").alias("mean_latency_ms"))


# -- selection for change analysis -----------------------------------------------------------

def change_tiles(tiles: DataFrame, start=None, end=None, aoi_ring=None, location_box=None,
                 widen: bool = False) -> DataFrame:
    """Valid tiles in a date range and area. No date is no filter.

    With ``widen``, as change analysis does, an area of interest that meets no
    footprint falls back to tile centres in its envelope, and a location that
    holds no tile centre to the whole archive. Each tile gets the tier it
    qualifies for and the best tier that occurs is kept, so the fallback is part
    of one plan; ``match_tier`` (0: the area itself, 1: the fallback) says which.
    """
    base = tiles.where("is_valid")
    if start is not None:
        base = base.where(F.col("acquisition_date") >= F.lit(start).cast("timestamp"))
    if end is not None:
        base = base.where(F.col("acquisition_date") <= F.lit(end).cast("timestamp"))
    lon, lat = F.col("center_lon"), F.col("center_lat")
    if aoi_ring is not None:
        ring = geometry.ring_literal(aoi_ring)
        xs, ys = [p[0] for p in aoi_ring], [p[1] for p in aoi_ring]
        box = (min(xs), min(ys), max(xs), max(ys))
        footprint = tuple(F.col(f"bbox_{s}") for s in ("west", "south", "east", "north"))
        near = geometry.boxes_touch(footprint, box)
        tier = F.when(near & geometry.box_intersects_ring(footprint, ring), 0).when(
            geometry.point_in_box(lon, lat, box), 1)
    elif location_box is not None:
        tier = F.when(geometry.point_in_box(lon, lat, location_box), 0).otherwise(1)
    else:
        return base
    tiered = base.withColumn("match_tier", tier).where(F.col("match_tier").isNotNull())
    if not widen:
        return tiered.where("match_tier = 0").drop("match_tier")
    best = tiered.agg(F.min("match_tier"))
    return tiered.where(F.col("match_tier") == best.scalar())


# -- declared by the data model ------------------------------------------------------------

def reviewed_events(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events with the status of the newest decision on them."""
    newest = decisions.groupBy("event_id").agg(
        F.max_by("decision", F.struct("decided_at", "decision")).alias("_d"))
    return events.join(newest, "event_id", "left").withColumn(
        "review_status", F.coalesce("_d", "review_status")).drop("_d")


def feedback_boost(scored: DataFrame, feedback: DataFrame, step: float = 0.01, limit: float = 0.05) -> DataFrame:
    """Shift order_score by the net analyst signal of each tile, at most ``limit`` either way."""
    net = feedback.groupBy("tile_id").agg(
        F.sum(F.when(F.col("signal") == "POSITIVE", 1).otherwise(-1)).alias("_net"))
    boost = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce("_net", F.lit(0)) * step))
    return scored.join(net, "tile_id", "left").withColumn(
        "order_score", F.col("order_score") + boost).drop("_net")


def change_persistence(events: DataFrame) -> DataFrame:
    """Earliest and latest sighting and their number, per place (centre to 3 digits) and type."""
    return events.groupBy(
        F.round("center_lon", 3).alias("site_lon"), F.round("center_lat", 3).alias("site_lat"),
        "change_type").agg(
        F.min("after_date").alias("first_seen"), F.max("after_date").alias("last_seen"),
        F.count("*").alias("sightings"))
