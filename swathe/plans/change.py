"""Archive to ranked change events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.config import Thresholds, Weights
from swathe.functions import confidence as cf
from swathe.functions import text as tx
from swathe.operators import change, landcover, pairing, rasters, tiling, vectors
from swathe.operators.listing import change_tiles
from swathe.operators.queries import parse_queries
from swathe.session import cut_lineage

_TILE = ["tile_col", "tile_row", "center_lon", "center_lat", "sensor", "resolution_m",
         "quality_score", "cloud_cover_pct"]


def pair_attributes(pairs: DataFrame, tiles: DataFrame, scenes: DataFrame) -> DataFrame:
    """Both tiles' attributes and scene names on each pair."""
    # Pairs, tiles and scenes are read for both sides: each is written once to the checkpoint folder.
    pairs, tiles = cut_lineage(pairs), cut_lineage(tiles.select("tile_id", "acquisition_date", *_TILE))
    for name in ("before", "after"):
        side = tiles.select(
            F.col("tile_id").alias(f"{name}_tile"), F.col("acquisition_date").alias(f"{name}_date"),
            *[F.col(c).alias(f"{name}_{c}") for c in _TILE])
        pairs = pairs.join(side, f"{name}_tile")
    return pairing.scene_names(pairs, cut_lineage(scenes.select("scene_id", "filename")))


def pair_evidence(pairs: DataFrame, pixels: DataFrame, vector_table: DataFrame,
                  max_shift: int = 2) -> DataFrame:
    """Registration, pixel change, shape of change, land cover and semantic distance of pairs."""
    # Small results that several branches read are written once to the checkpoint folder.
    pairs = cut_lineage(pairs)
    figures = cut_lineage(rasters.pair_figures(pairs, pixels, max_shift))
    shape = change.consistency_score(
        F.col("changed_pixels"), F.col("changed_pixels") / F.nullif("regions", F.lit(0)),
        F.col("top_area"), F.col("fill"))
    df = pairs.join(change.line_scores(figures).withColumn("spatial_consistency", shape).drop(
        "squares", "dark", "regions", "top_area", "fill"), "pair_id")
    df = df.withColumn("resolution_m", F.col("before_resolution_m"))
    paired = pairs.select(F.explode(F.array("before_tile", "after_tile")).alias("tile_id")).distinct()
    cover = landcover.landcover(tiling.of_tiles(pixels, paired))
    df = change.landcover_delta(change.area_columns(df), cover)
    df = vectors.pair_vectors(df, vector_table.where(F.col("collection") == "semantic"))
    return df.withColumn("semantic_score", vectors.semantic_distance(
        F.col("before_vector"), F.col("after_vector")))


def score_pairs(evidence: DataFrame, query: str | None = None, query_vector: Column | None = None,
                weights: Weights = Weights(), thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Change type, query match and confidence of pairs with evidence."""
    df = evidence.withColumns({
        "change_type": change.base_change_type(F.col("d_urban"), F.col("d_veg"), F.col("d_water")),
        "notes": F.array(change.base_note()),
        "query_match": F.lit(None).cast("double"),
    })
    if query:
        tokens = tx.path_tokens(F.concat_ws(" ", "before_name", "after_name"))
        flags = tx.change_query_flags(F.lit(query))
        vector = F.lit(None).cast("array<double>") if query_vector is None else query_vector
        df = df.withColumn("path_tokens", tokens).withColumns({
            **flags,
            **tx.site_flags(F.col("path_tokens"), F.col("before_water_pct"), F.col("after_water_pct")),
            "max_cloud": F.greatest(F.coalesce("before_cloud_cover_pct", F.lit(0.0)),
                                    F.coalesce("after_cloud_cover_pct", F.lit(0.0))),
            "after_year": F.year("after_date"),
            "query_match": vectors.query_similarity(vector, F.col("after_vector")),
        })
        df = change.query_match(df)
    return cf.evaluate_signals(change.pair_signals(df), weights, thresholds)


def analyze_change(
    tiles: DataFrame, scenes: DataFrame, pixels: DataFrame, vector_table: DataFrame,
    query: str | None = None, start=None, end=None, aoi_ring=None, limit: int = 50,
    encode: Callable[[Column], Column] = vectors.hashed_text_vector,
    weights: Weights = Weights(), thresholds: Thresholds = Thresholds(),
) -> DataFrame:
    """Scored change events of an archive, best first.

    All pairs are scored before the limit applies, so the result does not depend
    on row order.
    """
    box, vector = None, None
    if query:
        log = tiles.sparkSession.createDataFrame([(0, query)], "query_id long, raw_query string")
        parsed = parse_queries(log).select(
            "location_west", "location_south", "location_east", "location_north",
            "canonical_text", encode(F.col("canonical_text")).alias("vector")).first()
        if parsed[0] is not None:
            box = tuple(parsed[:4])
        vector = F.array(*[F.lit(v) for v in parsed["vector"]])
    chosen = change_tiles(tiles, start, end, aoi_ring, None if aoi_ring is not None else box,
                          widen=True).drop("match_tier")
    pairs = pair_attributes(pairing.matched_pairs(chosen), chosen, scenes)
    evidence = pair_evidence(pairs, pixels, vector_table)
    scored = score_pairs(evidence, query, vector, weights, thresholds)
    return change.rank_events(change.change_events(scored), limit, with_query=bool(query))
