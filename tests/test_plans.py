"""The plans that matter at scale."""

from pyspark.sql import functions as F

from registry import QUERIES
from registry.tables import Tables
from swathe.operators import landcover, pairing, vectors
from swathe.sources import files

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def no_pairwise(text: str) -> None:
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_pairing_uses_equality_joins(spark):
    t = Tables(spark, FOLDER)
    pairs = pairing.scene_pairs(t.tiles)
    no_pairwise(plan(pairs))
    no_pairwise(plan(pairing.candidate_pairs(t.tiles, pairs)))


def test_topk_keeps_heaps_and_pushes_filters(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "vectors")
    t = Tables(spark, FOLDER)
    t.vectors.drop("embedded_at").join(t.tiles, "tile_id").write.parquet(path)
    stored = spark.read.parquet(path)
    keep = vectors.payload_filter(min_quality=0.4, sensors=["Landsat-9"])
    text = plan(vectors.topk(stored, vectors.vector_of(stored, 7), 5, keep).select("tile_id", "score"))
    assert "TakeOrderedAndProject" in text
    assert "GreaterThanOrEqual(quality_score,0.4)" in text
    assert "cloud_cover_pct" not in text.split("ReadSchema")[-1]
    no_pairwise(text)


def test_landcover_is_one_shuffle(spark):
    t = Tables(spark, FOLDER)
    text = plan(landcover.landcover(t.images))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_checksums_need_no_window(spark):
    df = spark.createDataFrame([("a", "x", 1)], "path string, checksum string, length long")
    assert "Window" not in plan(files.dedupe_by_checksum(df))


def test_no_registered_query_is_a_cross_join(spark):
    for name in ("VEC-04_topk_batch", "JON-11_pair_pixels", "SRC-15_best_stac_items", "SCR-04_fused_score",
                 "QRY-20_parse_queries", "CHG-20_evaluate_with_override", "FIL-20_visible_events"):
        no_pairwise(plan(QUERIES[name](spark, FOLDER)))


def test_scan_lists_only_rasters(spark, tmp_path):
    for name in ("a.tif", "b.TIFF", "c.png", "d.geotiff"):
        (tmp_path / name).write_bytes(b"x" * 10)
    found = files.scan_scene_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in found.collect()} == {"a.tif", "b.TIFF", "d.geotiff"}
    sums = files.file_checksums(spark.read.format("binaryFile").load(str(tmp_path)))
    assert files.dedupe_by_checksum(sums).count() == 1


def test_streamed_files_are_deduplicated(spark, tmp_path):
    from swathe.streaming import streams
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name, body in (("a.tif", b"1"), ("b.tif", b"1"), ("c.tif", b"2")):
        (source / name).write_bytes(body)
    unique = streams.dedupe_stream(streams.new_files(spark, str(source)))
    unique.writeStream.format("parquet").option("path", str(out)).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(out)).select(F.col("checksum")).distinct().count() == 2
    assert spark.read.parquet(str(out)).count() == 2


def test_change_pairs_derive_the_catalogue_once(spark):
    from swathe.plans import change as flow
    t = Tables(spark, FOLDER)
    pairs = pairing.matched_pairs(t.tiles.where("is_valid"))
    text = flow.pair_attributes(pairs, t.tiles, t.scenes)._jdf.queryExecution().optimizedPlan().toString()
    assert "embeddings.parquet" not in text and "Relation" not in text
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 0
