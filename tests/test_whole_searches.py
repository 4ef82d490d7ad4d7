"""Searches and selections that must not stop short of the whole table."""

import datetime

from pyspark.sql import functions as F

from registry import rerank_checks
from swathe.operators import listing
from swathe.plans import search


def test_polygon_search_looks_past_near_tiles_outside(spark):
    """150 nearer tiles lie in the triangle's envelope but outside the triangle."""
    rows = [(i, 1, "visual", [1.0, 0.001 * i], 0.8, 0.8, 0.79, 0.79, 0.81, 0.81) for i in range(150)]
    rows += [(i, 1, "visual", [1.0, 0.5 + 0.001 * i], 0.2, 0.2, 0.19, 0.19, 0.21, 0.21) for i in range(150, 160)]
    flat = spark.createDataFrame(rows, "tile_id long, scene_id long, collection string, vector array<double>, "
                                 "center_lon double, center_lat double, bbox_west double, bbox_south double, "
                                 "bbox_east double, bbox_north double")
    flat = flat.withColumn("is_valid", F.lit(True))
    scenes = spark.createDataFrame([(1, "a.tif")], "scene_id long, filename string")
    tiles = flat.drop("collection", "vector").withColumn("p_center_lon", F.lit(0.0))
    hits = search.search_by_vector(flat, tiles, scenes,
                                   F.array(F.lit(1.0), F.lit(0.0)), 8,
                                   polygon=[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])
    assert sorted(r["tile_id"] for r in hits.collect()) == list(range(150, 158))


def test_no_date_is_no_filter(spark):
    day = datetime.datetime
    tiles = spark.createDataFrame(
        [(1, True, None), (2, True, day(1999, 1, 1)), (3, True, day(2040, 1, 1)), (4, False, None), (5, True, day(2020, 1, 1))],
        "tile_id long, is_valid boolean, acquisition_date timestamp")
    ids = lambda **dates: {r["tile_id"] for r in listing.change_tiles(tiles, **dates).collect()}
    assert ids() == {1, 2, 3, 5} and ids(start="2015-01-01") == {3, 5} and ids(end="2030-01-01") == {2, 5}


def test_repeated_wordings_are_all_answered(spark):
    log = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "query_id long, raw_query string")
    asked = log.groupBy("raw_query").agg(F.min("query_id").alias("query_id"))
    answers = asked.select("query_id", F.lit(7).alias("tile_id"))
    out = rerank_checks._for_each_query(answers, log, asked)
    assert sorted(tuple(r) for r in out.select("query_id", "tile_id").collect()) == [(i, 7) for i in range(1, 6)]


def test_an_empty_match_widens_only_when_asked(spark):
    tiles = spark.createDataFrame(
        [(1, True, 0.5, 0.5, 0.4, 0.4, 0.6, 0.6), (2, True, 5.0, 5.0, None, None, None, None)],
        "tile_id long, is_valid boolean, center_lon double, center_lat double, bbox_west double, bbox_south double, "
        "bbox_east double, bbox_north double")
    got = lambda **how: sorted((r["tile_id"], r["match_tier"] if how.get("widen") else 0) for r in listing.change_tiles(tiles, **how).collect())
    away, ring = (8.0, 8.0, 9.0, 9.0), [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0)]
    assert got(location_box=away) == [] and got(location_box=away, widen=True) == [(1, 1), (2, 1)]
    assert got(aoi_ring=ring) == [] and got(aoi_ring=ring, widen=True) == [(2, 1)]
    assert got(location_box=(0.0, 0.0, 1.0, 1.0), widen=True) == [(1, 0)]


def _small_search(spark):
    """40 tiles of two scenes from 2020, one scene named after a year, with their store and land cover."""
    rows = [(i, 1 + i % 2, "semantic", [float((i * 7 + d * 3) % 11) - 4.0 for d in range(64)], "S2", 0.9, 1.0, 18300 + i,
             0.5, 0.5, 0.4, 0.4, 0.6, 0.6) for i in range(40)]
    store = spark.createDataFrame(
        rows, "tile_id long, scene_id long, collection string, vector array<double>, sensor string, quality_score double, "
        "cloud_cover_pct double, acq_day int, center_lon double, center_lat double, bbox_west double, bbox_south double, "
        "bbox_east double, bbox_north double").withColumn("is_valid", F.lit(True))
    scenes = spark.createDataFrame([(1, "lake_1995.tif"), (2, "city_x.tif")], "scene_id long, filename string")
    cover = store.select("tile_id", (F.col("tile_id") % 30).cast("double").alias("water_pct"),
                         F.lit(10.0).alias("veg_pct"), F.lit(50.0).alias("urban_pct"))
    return store.drop("collection", "vector", "acq_day"), scenes, store, cover


def test_wordings_share_searches_and_keep_their_own_answers(spark, monkeypatch):
    texts = ["lake water after 1995", "lake water after 1996", "Lake  water since 1997", "city roads", "city roads before 1990",
             "city roads in 1995", "lake water after 2010", None]
    log = spark.createDataFrame(list(enumerate(texts)), "query_id long, raw_query string").where("raw_query is not null")
    tiles, scenes, store, cover = _small_search(spark)
    asked, plain = [], search.vectors.topk_batch

    def counted(index, searches, *args, **kwargs):
        asked.append(searches.count())
        return plain(index, searches, *args, **kwargs)

    monkeypatch.setattr(search.vectors, "topk_batch", counted)
    find = lambda log: search.semantic_search(log, tiles, scenes, store, cover, top_k=4).select(
        "query_id", "query_text", "rank", "tile_id", "filename", "score", "display_score", "lexical_boost", "water_pct")
    together = sorted(tuple(r) for r in find(log).collect())
    assert asked == [2]
    alone = sorted(tuple(r) for i in (0, 2, 3, 6) for r in find(log.where(F.col("query_id") == i)).collect())
    assert [r for r in together if r[0] in (0, 2, 3, 6)] == alone and len(together) == 5 * 4
    # Two queries of one search: the first shares two words with a scene's name, the last only one.
    boosts = {r[0]: max(x[7] for x in together if x[0] == r[0]) for r in together}
    assert boosts == {0: 0.22, 1: 0.11, 2: 0.11, 3: 0.11, 6: 0.11}


def test_dates_are_cut_to_the_days_of_the_index(spark):
    index = spark.createDataFrame([(100,), (200,), (None,)], "acq_day int")
    asked = spark.createDataFrame(
        [(1, None, None), (2, 5, None), (3, 150, 900), (4, 201, None), (5, None, 99), (6, 200, 100)],
        "query_id long, start_day int, end_day int")
    cut = lambda index: sorted(tuple(r) for r in search.within_known_days(asked, index).collect())
    assert cut(index) == [(1, None, None), (2, 100, None), (3, 150, 200), (6, 200, 100)]
    assert cut(index.limit(0)) == [(1, None, None)]
