"""The stored vector table: pruning, upserts by bucket, text ids."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from swathe.operators import vectors
from swathe.plans import search
from swathe.session import shared_dir
from swathe.sources.vector_store import VectorStore, with_payload

TILES = ("tile_id string, scene_id string, sensor string, resolution_m double, quality_score double, cloud_cover_pct double, "
         "acquisition_date date, center_lon double, center_lat double, bbox_west double, bbox_south double, bbox_east double, "
         "bbox_north double, is_valid boolean")


@pytest.fixture
def tiles(spark):
    rows = [(f"t{i:03d}", f"s{i % 7}", ["S2", "L9", None][i % 3], 10.0, i / 200, float(i % 50), None, i / 10, 0.5,
             i / 10 - 0.1, 0.4, i / 10 + 0.1, 0.6, i % 11 > 0) for i in range(200)]
    return spark.createDataFrame(rows, TILES)


@pytest.fixture
def store(spark, tiles):
    rows = [(c, f"t{i:03d}", [1.0, i / 100, 0.5], 1) for c in ("semantic", "visual") for i in range(0, 220, 2)]
    table = spark.createDataFrame(rows, "collection string, tile_id string, vector array<double>, embedded_at int")
    return VectorStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=8).create(with_payload(table, tiles))


def files(store):
    return {os.path.join(d, f) for d, _, names in os.walk(store.path) for f in names if f.endswith(".parquet")}


def test_a_search_reads_its_partitions_and_moves_no_vectors(store, tiles, spark):
    keep = (F.col("collection") == "visual") & vectors.payload_filter(sensors=["S2"], min_quality=0.3, max_cloud=45.0)
    hits = vectors.topk(store.read(), F.array(F.lit(1.0), F.lit(0.2), F.lit(0.5)), 5, keep)
    plan = hits._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "collection" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert "GreaterThanOrEqual(quality_score,0.3)" in plan and "Exchange" not in plan
    want = {r["tile_id"] for r in tiles.where("sensor = 'S2' and quality_score >= 0.3 and cloud_cover_pct <= 45").collect()}
    got = [r["tile_id"] for r in hits.collect()]
    assert len(got) == 5 and set(got) <= want


def test_upsert_rewrites_only_touched_buckets(store, spark):
    before = files(store)
    known = {(r["collection"], r["tile_id"]): r["embedded_at"] for r in store.read().collect()}
    batch = store.collection("visual").where("tile_id in ('t000', 't006')").withColumn("embedded_at", F.lit(2))
    folders = {(r["sensor"], r["bucket"]) for r in batch.collect()}
    batch = spark.createDataFrame(batch.collect(), batch.schema)
    store.upsert(batch)
    once, kept = store.read().collect(), files(store)
    changed = {f for f in before if f not in kept}
    assert 1 <= len(changed) == len(folders) and all("collection=visual" in f for f in changed)
    store.upsert(batch)
    key = lambda rows: sorted((r["collection"], r["tile_id"], r["embedded_at"]) for r in rows)
    assert key(store.read().collect()) == key(once) and len(once) == len(known)
    assert {i for c, i, at in key(once) if at == 2 and c == "visual"} == {"t000", "t006"}
    store.upsert(batch.withColumn("embedded_at", F.lit(1)))
    assert key(store.read().collect()) == key(once)
    store.upsert(batch.limit(0))


def test_text_ids_in_batch_search(store, spark):
    asked = spark.createDataFrame(
        [("q1", [1.0, 0.0, 0.5], ["S2"], None, None, None, None, None, None, None, None, None, "t000"),
         ("q2", [1.0, 0.9, 0.5], None, 0.2, 40.0, None, None, 2.0, 0.0, 9.0, 1.0, None, None),
         ("q3", [1.0, 0.9, 0.5], None, None, None, None, None, None, None, None, None, "s3", None)],
        "query_id string, query_vector array<double>, sensors array<string>, min_quality double, max_cloud double, "
        "start_day int, end_day int, west double, south double, east double, north double, scene string, not_tile string")
    index = store.collection("visual")
    assert index.count() == 100
    got = {}
    for options in ({}, {"broadcast_queries": 1, "vector_block": 30}):
        for r in vectors.topk_batch(index, asked, 4, filtered=True, **options).collect():
            got.setdefault((r["query_id"], bool(options)), set()).add(r["tile_id"])
    rows = {r["tile_id"]: r for r in index.collect()}
    for q in ("q1", "q2", "q3"):
        assert got[q, False] == got[q, True] and len(got[q, True]) == 4
    assert all(rows[i]["sensor"] == "S2" and i != "t000" for i in got["q1", False])
    assert all(rows[i]["quality_score"] >= 0.2 and 2.0 <= rows[i]["center_lon"] <= 9.0 for i in got["q2", False])
    assert all(rows[i]["scene_id"] == "s3" for i in got["q3", False])


def test_similar_tiles_with_text_ids(store, tiles, spark):
    scenes = spark.createDataFrame([(f"s{i}", f"f{i}.tif") for i in range(7)], "scene_id string, filename string")
    found = search.similar_tiles(store.read(), tiles, scenes, "t010", 3).collect()
    assert [r["tile_id"] for r in found][0] in ("t008", "t012") and len(found) == 3
    with pytest.raises(ValueError):
        search.similar_tiles(store.read(), tiles, scenes, "t999", 3)


def test_vectors_of_another_length_are_no_hits(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0])], "tile_id long, vector array<double>")
    assert [r["tile_id"] for r in vectors.topk(rows, F.array(F.lit(1.0), F.lit(0.0)), 5).collect()] == [1, 3]
