"""Published cases: confidence archetypes, typos, places, parsed sentences, overlaps, images."""

import pytest
from pyspark.sql import functions as F

from swathe.config import TilingConfig, Weights
from swathe.functions import confidence as cf
from swathe.functions import geometry
from swathe.operators import landcover, queries, spelling, tiling, vectors

SIGNALS = ["visual_change", "semantic_change", "image_quality", "cloud_score", "shadow_score",
           "registration_confidence", "sensor_compatibility", "seasonal_compatibility",
           "spectral_evidence", "spatial_consistency"]
ARCHETYPES = [
    ("construction", .88, .84, .92, .04, .05, .94, 1.0, .85, .82, .89, False, .872, "High Confidence"),
    ("crops", .79, .65, .88, .05, .08, .91, 1.0, .20, .35, .72, True, .328, "Suppressed"),
    ("cloud", .85, .55, .50, .45, .42, .80, 1.0, .60, .40, .30, False, .040, "Suppressed"),
    ("misaligned", .68, .32, .75, .03, .05, .28, .85, .75, .25, .15, False, .040, "Suppressed"),
    ("water level", .58, .52, .90, .05, .05, .92, 1.0, .70, .60, .65, False, .642, "Medium Confidence"),
]


def test_confidence_archetypes(spark):
    rows = [a[:12] + (None,) for a in ARCHETYPES]
    schema = "name string, " + ", ".join(f"{s} double" for s in SIGNALS) + \
        ", is_seasonal_vegetation boolean, query_match double"
    got = {r.name: r for r in cf.evaluate_signals(spark.createDataFrame(rows, schema)).collect()}
    for case in ARCHETYPES:
        assert got[case[0]].final_confidence == pytest.approx(case[12], abs=0.0011)
        assert got[case[0]].confidence_tier == case[13]
    assert got["cloud"].reasons[0] == "high cloud coverage (45.0%)"
    assert "homogeneous sensor observation pair" in got["construction"].positive_factors


def test_weights_are_bounded():
    with pytest.raises(ValueError):
        Weights(visual=1.5)
    with pytest.raises(ValueError):
        TilingConfig(tile_size=32)


TYPOS = [
    ("rajasthan dessert", "rajasthan desert"),
    ("new constrution near roads", "new construction near roads"),
    ("urban buildng developement", "urban building development"),
    ("dense vegitaiton clearance", "dense vegetation clearance"),
    ("industrial faclities chennai", "industrial facilities chennai"),
    ("water resrevoir decrease", "water reservoir decrease"),
]


def test_typos(spark):
    log = spark.createDataFrame(list(enumerate(t for t, _ in TYPOS)), "query_id long, raw_query string")
    got = {r.query_id: r for r in spelling.correct_queries(log).collect()}
    for i, (_, wanted) in enumerate(TYPOS):
        assert got[i].corrected_query == wanted
    assert got[0].did_you_mean == "Did you mean: Rajasthan desert?"
    assert got[0].corrections[0].confidence == 0.96
    assert (got[3].corrections[0].edit_distance, got[3].corrections[0].confidence) == (2, 0.83)


SENTENCES = [
    ("new construction near roads after 2023", dict(intent="change_search", target="construction", relationship="near_road", start=2023)),
    ("Rajasthan desert", dict(intent="semantic_search", location="Rajasthan", concept="desert")),
    ("solar farms in Bhadla after 2020", dict(concept="solar", location="Bhadla", start=2020)),
    ("cloud-free satellite imagery of airports in Noida", dict(intent="semantic_search", concept="airport", location="Noida", max_cloud_cover=5.0)),
    ("vegetation clearance near water bodies between 2018 and 2022", dict(target="vegetation_clearance", relationship="near_water", start=2018, end=2022)),
    ("urban expansion and buildings along highways", dict(target="urban_expansion", relationship="near_road")),
    ("water reservoir decrease since 2021", dict(intent="change_search", target="water", start=2021, requires_water=True)),
    ("highways and road development in Jewar", dict(target="road_expansion", location="Jewar")),
    ("dense agricultural crop fields", dict(intent="semantic_search", concept="farmland", requires_vegetation=True)),
    ("Pangong lake water coastline", dict(intent="semantic_search", location="Pangong", concept="lake", requires_water=True)),
    ("demolition of residential buildings before 2020", dict(target="demolition", concept="residential", end=2020)),
    ("Sentinel-2 imagery of coastal harbor with no clouds", dict(sensors=["Sentinel-2"], concept="port", max_cloud_cover=5.0, requires_water=True)),
    ("desert in Rajasthan", dict(location="Rajasthan", location_type="state", concept="desert", canonical_text="desert")),
    ("industrial areas in Tamil Nadu", dict(location="Tamil Nadu", location_type="state", concept="industrial")),
    ("urban development in Chennai", dict(location="Chennai", location_type="city", concept="urban")),
    ("water bodies in Kerala", dict(location="Kerala", location_type="state", concept="water")),
    ("commercial airports in Delhi NCR", dict(location="Delhi", location_type="state", concept="airport")),
    ("expansion up to 2020", dict(location="Uttar Pradesh", end=2020)),
]


def test_parsed_sentences(spark):
    log = spark.createDataFrame(list(enumerate(s for s, _ in SENTENCES)), "query_id long, raw_query string")
    parsed = queries.parse_queries(log).withColumns({"start": F.year("start_date"), "end": F.year("end_date")})
    got = {r.query_id: r.asDict() for r in parsed.collect()}
    for i, (sentence, wanted) in enumerate(SENTENCES):
        for field, value in wanted.items():
            assert got[i][field] == value, (sentence, field, got[i][field])


def test_iou_and_overlap(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    row = spark.range(1).select(
        geometry.box_iou(box(0, 0, 1, 1), box(0, 0, 1, 1)).alias("same"),
        geometry.box_iou(box(0, 0, 2, 1), box(1, 0, 3, 1)).alias("third"),
        geometry.box_iou(box(0, 0, 1, 1), box(5, 5, 6, 6)).alias("none"),
        geometry.boxes_overlap(box(10, 10, 12, 12), box(11, 11, 13, 13)).alias("meets"),
        geometry.boxes_overlap(box(10, 10, 12, 12), box(50, 50, 52, 52)).alias("apart"),
        geometry.boxes_touch(box(0, 0, 1, 1), box(1, 1, 2, 2)).alias("touch")).first()
    assert (row.same, row.none, row.meets, row.apart, row.touch) == (1.0, 0.0, True, False, True)
    assert row.third == pytest.approx(1 / 3)


def test_grid_offsets(spark):
    scene = spark.createDataFrame([(1, 1024, 1024)], "scene_id long, width int, height int")
    assert tiling.tile_grid(scene).count() == 4
    grid = tiling.tile_grid(scene, TilingConfig(overlap=64))
    assert sorted({r.x_off for r in grid.collect()}) == [0, 448, 896]


def test_semantic_distance(spark):
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    row = spark.range(1).select(
        vectors.semantic_distance(vec(1, 0, 0), vec(0, 1, 0)).alias("far"),
        vectors.semantic_distance(vec(1, 0, 0), F.lit(None).cast("array<double>")).alias("missing")).first()
    assert (row.far, row.missing) == (1.0, 0.5)


def test_quality_images(spark):
    """Flat test images: clear land, mostly cloud, mostly missing, banded rows."""
    def image(name, paint, size=64):
        return [(name, y, x, *paint(y, x)) for y in range(size) for x in range(size)]

    rows = image("clear", lambda y, x: (60, 120, 40))
    rows += image("cloud", lambda y, x: (245, 245, 245) if y < 52 else (50, 90, 40))
    rows += image("missing", lambda y, x: (70, 90, 60) if y < 19 and x < 19 else (0, 0, 0))
    rows += image("banded", lambda y, x: (200, 200, 200) if y % 2 else (40, 40, 40))
    pixels = spark.createDataFrame(rows, "tile_id string, y int, x int, r int, g int, b int")
    got = {r.tile_id: r for r in landcover.photometric_quality(pixels).collect()}
    assert got["clear"].suitability == "Suitable" and got["clear"].usable_for_change
    assert got["cloud"].cloud_score > 0.8 and got["cloud"].suitability == "Poor Quality"
    assert got["missing"].nodata_score > 0.9
    assert got["banded"].noise_score == 1.0
