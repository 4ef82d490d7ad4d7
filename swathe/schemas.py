"""Declared schemas of the catalogue tables and their constraints."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_AT = T.TimestampType()
_BOX = [("bbox_west", _D), ("bbox_south", _D), ("bbox_east", _D), ("bbox_north", _D)]


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


HISTORY_ENTRY = _struct(("step", _S), ("at", _AT), ("details", T.MapType(_S, _S)))

TABLES: dict[str, T.StructType] = {
    "scenes": _struct(
        ("scene_id", _S), ("path", _S), ("filename", _S), ("checksum", _S), ("sensor", _S),
        ("platform", _S), ("acquisition_date", _AT), ("crs_wkt", _S), ("crs_epsg", _I),
        ("width", _I), ("height", _I), ("band_count", _I),
        ("band_descriptions", T.ArrayType(_S)), ("resolution_m", _D), ("nodata", _D), *_BOX,
        ("cloud_cover_pct", _D), ("quality_score", _D), ("quality_details", T.MapType(_S, _D)),
        ("raw_metadata", T.MapType(_S, _S)), ("status", _S), ("tile_count", _L),
        ("embedded_count", _L), ("created_at", _AT)),
    "tiles": _struct(
        ("tile_id", _S), ("scene_id", _S), ("tile_col", _I), ("tile_row", _I), ("tile_size", _I),
        ("x_off", _I), ("y_off", _I), ("pixel_width", _I), ("pixel_height", _I),
        ("center_lon", _D), ("center_lat", _D), *_BOX, ("tile_path", _S), ("thumbnail_path", _S),
        ("acquisition_date", _AT), ("sensor", _S), ("resolution_m", _D), ("cloud_cover_pct", _D),
        ("quality_score", _D), ("nodata_ratio", _D), ("is_valid", _B), ("vector_id", _S),
        ("visual_vector_id", _S), ("embedding_model", _S), ("embedded_at", _AT),
        ("processing_history", T.ArrayType(HISTORY_ENTRY))),
    "change_events": _struct(
        ("event_id", _S), ("before_tile", _S), ("after_tile", _S), ("before_date", _AT),
        ("after_date", _AT), ("center_lon", _D), ("center_lat", _D), ("change_type", _S),
        ("final_confidence", _D), ("visual_change_score", _D), ("semantic_change_score", _D),
        ("spectral_change_score", _D), ("registration_quality", _D), ("cloud_penalty", _D),
        ("shadow_penalty", _D), ("seasonal_penalty", _D), ("suppression_reason", _S),
        ("is_suppressed", _B), ("review_status", _S), ("detected_at", _AT)),
    "provenance": _struct(
        ("entity_id", _S), ("entity_type", _S), ("operation", _S),
        ("details", T.MapType(_S, _S)), ("operator", _S), ("recorded_at", _AT)),
    "jobs": _struct(
        ("job_id", _S), ("job_type", _S), ("status", _S), ("related_entity_id", _S),
        ("progress", _D), ("params", T.MapType(_S, _S)), ("result", T.MapType(_S, _S)),
        ("created_at", _AT), ("updated_at", _AT)),
    "vectors": _struct(
        ("collection", _S), ("tile_id", _S), ("vector", T.ArrayType(T.FloatType())),
        ("embedded_at", _AT)),
    "decisions": _struct(
        ("event_id", _S), ("decision", _S), ("analyst", _S), ("notes", _S), ("decided_at", _AT)),
    "feedback": _struct(
        ("query_text", _S), ("tile_id", _S), ("signal", _S), ("recorded_at", _AT)),
}

# What a row must satisfy, as SQL. A NULL passes, as a CHECK does.
CONSTRAINTS: dict[str, dict[str, str]] = {
    "scenes": {
        "status_known": "status in ('PENDING', 'PROCESSING', 'COMPLETED', 'FAILED')",
        "cloud_in_range": "cloud_cover_pct between 0 and 100",
    },
    "change_events": {
        "review_known": "review_status in ('PENDING', 'CONFIRMED', 'REJECTED', 'NEEDS_REVIEW')",
        "confidence_in_range": "final_confidence between 0 and 1",
    },
    "decisions": {"decision_known": "decision in ('CONFIRMED', 'REJECTED', 'NEEDS_REVIEW')"},
    "feedback": {"signal_known": "signal in ('POSITIVE', 'NEGATIVE')"},
    "tiling_requests": {
        "tile_size_in_range": "tile_size between 64 and 4096",
        "overlap_in_range": "overlap between 0 and 2048",
    },
    "search_requests": {
        "top_k_in_range": "top_k between 1 and 100",
        "quality_in_range": "min_quality between 0 and 1",
        "cloud_in_range": "max_cloud_cover between 0 and 100",
    },
}
