"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "VEC-03_topk", "VEC-04_topk_batch", "VEC-11_similar_tiles", "JON-04_scene_pairs",
    "JON-08_candidate_pairs", "CHG-15_evaluate_signals", "CHG-09_query_match", "SPC-01_landcover",
    "SPC-04_photometric_quality", "TIL-01_tile_grid", "TIL-08_percentile_stretch",
    "TIL-13_cloud_pct_quick", "CHG-02_change_area", "CHG-04_register_shift", "QRY-08_correct_queries",
    "QRY-10_resolve_places", "QRY-20_parse_queries", "SCR-04_fused_score", "FIL-10_footprint_polygon",
    "SRC-11_upsert_vectors",
]
# Queries whose cost per item has a published figure: (query, table that counts the items, name).
PER_ITEM = [
    ("CHG-15_evaluate_signals", "signals", "confidence_ms_per_evaluation"),
    ("QRY-08_correct_queries", "query_log", "spelling_ms_per_query"),
    ("SPC-01_landcover", "tiles", "landcover_ms_per_tile_32px"),
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from registry import QUERIES
    from registry.tables import STORED, Tables
    from swathe.session import local_session

    spark = local_session(cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    for name in STORED:
        getattr(tables, name).count()
    tables.vector_store.count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr)
    per_item = {
        label: round(times[name] * 1000 / getattr(tables, table).count(), 5)
        for name, table, label in PER_ITEM if name in times}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "per_item": per_item}))


if __name__ == "__main__":
    main()
