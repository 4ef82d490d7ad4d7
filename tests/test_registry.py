"""A cross-section of the registered queries against their oracles, at the smallest scale."""

import pytest

from registry import ORACLES, QUERIES
from registry.compare import compare, load_duckdb

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "VEC-03_topk", "VEC-04_topk_batch", "VEC-11_similar_tiles", "VEC-12_search_by_vector", "CHG-06_base_change_type",
    "CHG-09_query_match", "CHG-18_tier", "JON-04_scene_pairs", "JON-08_candidate_pairs", "TIL-01_tile_grid_overlap",
    "TIL-09_rgb8", "TIL-16_laplacian_sharpness", "SPC-01_landcover", "SPC-08_scene_quality", "QRY-02_normalize_punctuation",
    "QRY-08_correct_queries", "QRY-20_parse_queries", "QRY-22_parse_stored_answers", "SCR-04_fused_score",
    "FIL-10_footprint_polygon", "FIL-11_footprint_within", "FIL-13_effective_filters", "SRC-06_resolution_metres",
    "SRC-10_replace_scene_tiles", "SRC-13_delete_scene_events", "STR-04_job_state_stream", "AGG-03_embedding_status",
]


@pytest.fixture(scope="module")
def con():
    return load_duckdb(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, con, name):
    report = compare(spark, con, name, QUERIES, ORACLES, FOLDER)
    assert report.startswith("ok"), report


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) - len(ORACLES) <= 5
