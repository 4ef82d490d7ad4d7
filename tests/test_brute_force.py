"""Operators without an SQL oracle, against plain Python on small random input."""

import random

import numpy as np
from pyspark.sql import functions as F

from swathe.operators import change, pairing, spelling, vectors


def test_components_match_flood_fill(spark):
    rng = np.random.default_rng(3)
    rows, wanted = [], {}
    for pair in range(6):
        mask = rng.random((24, 24)) < (0.08 + 0.1 * pair)
        rows += [(pair, int(y), int(x)) for y, x in zip(*np.nonzero(mask))]
        left, areas = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}, []
        while left:
            stack, seen = [left.pop()], []
            while stack:
                y, x = stack.pop()
                seen.append((y, x))
                for spot in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if spot in left:
                        left.remove(spot)
                        stack.append(spot)
            ys, xs = zip(*seen)
            areas.append((len(seen), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, min(seen)))
        wanted[pair] = areas
    mask = spark.createDataFrame(rows, "pair_id long, y int, x int")
    got = {}
    for r in change.change_components(mask).collect():
        got.setdefault(r.pair_id, []).append((r.area, r.width, r.height))
    for pair, areas in wanted.items():
        assert sorted(got[pair]) == sorted(a[:3] for a in areas)
    pairs = spark.createDataFrame([(p,) for p in range(7)], "pair_id long")
    scores = {r.pair_id: r.spatial_consistency for r in change.spatial_consistency(mask, pairs).collect()}
    for pair, areas in wanted.items():
        sizes = sorted((a[0] for a in areas), reverse=True)
        total = sum(sizes)
        if total < 10:
            assert scores[pair] == 0.2
            continue
        # The largest region; of equals the one met first.
        big = min((a for a in areas if a[0] == sizes[0]), key=lambda a: a[3])
        score = 0.45 * sum(sizes[:5]) / total + 0.35 * min(1, np.mean(sizes) / 120) + 0.2 * big[0] / (big[1] * big[2])
        assert abs(scores[pair] - min(0.99, max(0.05, score))) < 1e-9
    assert scores[6] == 0.2


def test_greedy_match_is_the_greedy_order(spark):
    rng = random.Random(5)
    rows = [(s, 9, b, a, 0.0, rng.randrange(40) / 40) for s in range(4) for b in range(12) for a in range(12)
            if rng.random() < 0.4]
    df = spark.createDataFrame(
        rows, "before_scene long, after_scene long, before_tile long, after_tile long, iou double, match_score double")
    wanted, used = set(), set()
    for s, _, b, a, _, score in sorted(rows, key=lambda r: (-r[5], r[2], r[3])):
        if (s, "b", b) not in used and (s, "a", a) not in used:
            used |= {(s, "b", b), (s, "a", a)}
            wanted.add((s, b, a))
    got = {(r.before_scene, r.before_tile, r.after_tile) for r in pairing.greedy_match(df).collect()}
    assert got == wanted


def test_scene_without_boxes_meets_every_scene(spark):
    rows = [(1, 1, "2020-01-01", 0.0, 0.0, 1.0, 1.0), (2, 2, "2021-01-01", 0.5, 0.5, 1.5, 1.5),
            (3, 3, "2019-01-01", None, None, None, None), (4, 4, "2021-01-01", 40.0, 40.0, 41.0, 41.0),
            (5, 5, "2019-01-01", None, None, None, None), (6, 6, None, 0.2, 0.2, 0.4, 0.4)]
    tiles = spark.createDataFrame(
        rows, "tile_id long, scene_id long, d string, bbox_west double, bbox_south double, bbox_east double, bbox_north double"
    ).withColumn("acquisition_date", F.col("d").cast("date"))
    got = {(r.before_scene, r.after_scene) for r in pairing.scene_pairs(tiles).collect()}
    # Without a date on one side the scene listed later comes first.
    assert got == {(1, 2), (3, 1), (3, 2), (3, 4), (5, 1), (5, 2), (5, 4), (6, 1), (6, 3), (6, 5)}


def _distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein by breadth-first search over edits, up to 2."""
    letters = set(b)

    def edits(w):
        for i in range(len(w) + 1):
            for c in letters:
                yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + w[i + 1:]
                for c in letters:
                    yield w[:i] + c + w[i + 1:]
            if i + 1 < len(w):
                yield w[:i] + w[i + 1] + w[i] + w[i + 2:]

    if a == b:
        return 0
    once = set(edits(a))
    if b in once:
        return 1
    return 2 if any(b in set(edits(w)) for w in once) else 3


def test_edit_distance_and_joins(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(40)] + ["ca", "abc", "abcd", "badc"]
    words = sorted(set(words))
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    vocabulary = spelling.vocabulary_frame(spark, words)
    wanted = {(a, b): d for a in words for b in words if (d := _distance(a, b)) <= 2}
    for small in (0, 5000):
        pairs = spelling.damerau_levenshtein_join(tokens, vocabulary, 2, small)
        assert {(r.token, r.candidate): r.distance for r in pairs.collect()} == wanted


def test_batch_search_equals_single_search(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    vecs = np.vstack([base, np.repeat(base[:1], 40, axis=0)])  # many copies of one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    table = spark.createDataFrame(rows, "tile_id long, vector array<double>")
    asked = spark.createDataFrame(rows[:7], "query_id long, query_vector array<double>")
    for limit in (100, 2):
        got = vectors.topk_batch(table, asked, 5, broadcast_queries=limit, vector_block=16)
        by_query = {}
        for r in got.orderBy("query_id", "rank").collect():
            by_query.setdefault(r.query_id, []).append(r.tile_id)
        for i, v in rows[:7]:
            unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
            score = np.round(unit @ (np.array(v) / np.linalg.norm(v)), 12)
            assert by_query[i] == list(np.lexsort((np.arange(len(vecs)), -score))[:5])


def test_registration_finds_the_shift(spark):
    rng = np.random.default_rng(2)
    wide = rng.integers(0, 256, size=(44, 44))
    first, second = wide[4:40, 4:40], wide[3:39, 6:42]  # second(y, x) = first(y - 1, x + 2)
    rows = [(1, y, x, *[int(first[y, x])] * 3, *[int(second[y, x])] * 3) for y in range(36) for x in range(36)]
    pixels = spark.createDataFrame(rows, "pair_id long, y int, x int, r1 int, g1 int, b1 int, r2 int, g2 int, b2 int")
    row = change.register_shift(pixels).first()
    assert (row.shift_x, row.shift_y) == (-2, 1)
    assert row.registration_quality > 0.999


def test_row_order_does_not_matter(spark):
    from registry.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    keys = ["before_tile", "after_tile"]
    a = {tuple(r) for r in pairing.matched_pairs(t.tiles).select(*keys).collect()}
    b = {tuple(r) for r in pairing.matched_pairs(t.tiles.orderBy(F.desc("tile_id"))).select(*keys).collect()}
    assert a == b and a


def test_many_copies_of_a_vector_send_no_more_than_k_rows():
    import numpy as np
    import pandas as pd
    from swathe.operators import vectors
    rows = pd.DataFrame({"tile_id": np.arange(9000)[::-1], "vector": [[1.0, 0.0]] * 8990 + [[0.0, 1.0]] * 10})
    queries = pd.DataFrame({"query_id": [7, 8], "query_vector": [[1.0, 0.0], [0.0, 1.0]]})
    sent = vectors._score_batch(rows, queries, 5, False)
    assert len(sent) <= 2 * 5 * 3
    best = vectors._best(sent, 5)
    assert best["tile_id"].tolist() == [10, 11, 12, 13, 14, 0, 1, 2, 3, 4]


def test_best_items_of_equal_boxes_and_footprints(spark):
    """Ties by id, no time before any time, equal areas alike; and no step sorts."""
    from swathe.sources import files
    items = spark.createDataFrame(
        [(5, 0.0, 0.0, 1.0, 1.0, 10.0, "2024-01-02"), (3, 0.0, 0.0, 1.0, 1.0, 19.0, "2024-01-02"),
         (1, 0.0, 0.0, 1.0, 1.0, 30.0, "2025-01-01"), (2, 2.0, 2.0, 3.0, 3.0, 30.0, None), (4, 2.0, 2.0, 3.0, 3.0, 49.0, "1960-01-01"),
         (6, 0.5, 0.5, 2.5, 2.5, 60.0, "2025-01-01")],
        "item_id long, bbox_west double, bbox_south double, bbox_east double, bbox_north double, cloud double, ts string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    areas = spark.createDataFrame([(1, 0.2, 0.2, 0.4, 0.4), (2, 0.2, 0.2, 0.4, 0.4), (3, 2.9, 2.9, 4.0, 4.0), (4, 9.0, 9.0, 9.5, 9.5)],
                                  "area_id long, west double, south double, east double, north double")
    best = files.best_stac_items(items, areas)
    assert sorted((r["area_id"], r["item_id"], r["cloud"]) for r in best.collect()) == [(1, 3, 19.0), (2, 3, 19.0), (3, 4, 49.0)]
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()


def test_each_distinct_text_is_read_once(spark):
    from swathe.operators import queries
    log = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "a b", 7), (4, "", 8)], "query_id long, raw_query string, other int")
    read = []

    def build(texts):
        read.append(texts.count())
        return texts.withColumn("size", F.length(F.coalesce("raw_query", F.lit("?"))))
    out = queries.by_text(log, "raw_query", build)
    assert read == [3] and out.columns == ["query_id", "raw_query", "other", "size"]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [
        (1, "a b", 5, 3), (2, None, 6, 1), (3, "a b", 7, 3), (4, "", 8, 0)]


def test_a_model_is_fed_parts_of_bounded_size(spark):
    from swathe.operators import vectors
    docs = spark.range(40).coalesce(1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def load():
        return lambda texts: np.column_stack([texts.str.len(), np.full(len(texts), len(texts))])
    got = vectors.embed(docs, load, "id", "text").collect()
    assert sorted(r["id"] for r in got) == list(range(40))
    assert all(r["vector"][0] == 1 << 20 and r["vector"][1] <= 8 for r in got)


def test_filters_are_tested_once_for_queries_that_share_them(monkeypatch):
    import pandas as pd
    random = np.random.default_rng(5)
    n, m, k = 700, 60, 9
    rows = pd.DataFrame({
        "tile_id": random.permutation(n), "vector": list(random.normal(size=(n, 8)).round(1)),
        "sensor": random.choice(["a", "b", None], n), "quality_score": random.random(n), "scene_id": random.integers(0, 3, n)})
    asked = pd.DataFrame({"query_id": np.arange(m), "query_vector": list(random.normal(size=(m, 8)))})
    for column in vectors.FILTER_COLUMNS:
        asked[column] = None
    asked["sensors"] = [np.array(["a"]) if i % 3 == 0 else None for i in range(m)]
    asked["min_quality"] = [0.5 if i % 2 else np.nan for i in range(m)]
    asked["scene"] = [1 if i % 5 == 0 else None for i in range(m)]
    seen, plain = [], vectors._allowed
    monkeypatch.setattr(vectors, "_allowed", lambda rows, queries: seen.append(len(queries)) or plain(rows, queries))
    got = vectors._score_batch(rows, asked, k, True)
    assert sum(seen) == 8
    unit = lambda v: v / np.linalg.norm(v)
    for i, q in asked.iterrows():
        ok = rows[(rows["sensor"] == "a") | (i % 3 != 0)]
        ok = ok[(ok["quality_score"] >= 0.5) | (i % 2 == 0)]
        ok = ok[(ok["scene_id"] == 1) | (i % 5 != 0)]
        scores = [round(float(unit(q["query_vector"]) @ unit(v)), 12) for v in ok["vector"]]
        best = sorted(zip([-s for s in scores], ok["tile_id"]))[:k]
        mine = got[got["query_id"] == i]
        assert set(mine["tile_id"]) == {t for _, t in best}
    none = vectors._score_batch(rows, asked.assign(min_quality=2.0), k, True)
    assert len(none) == 0 and list(none) == ["query_id", "tile_id", "score"]


def test_a_task_passes_on_few_hits_a_query():
    """Not the best of every few thousand rows, which a search for many hits would hold all at once."""
    import pandas as pd
    random = np.random.default_rng(6)
    rows = pd.DataFrame({"tile_id": np.arange(13_000), "vector": list(random.normal(size=(13_000, 4)))})
    asked = pd.DataFrame({"query_id": [1, 2], "query_vector": list(random.normal(size=(2, 4)))})
    assert len(vectors._score_batch(rows, asked, 500, False)) == 1000
