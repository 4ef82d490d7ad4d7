"""Figures of tile pairs from packed pixels, against plain Python and the operators on pixel rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry.tables import Tables
from swathe.operators import change, pairing, rasters, tiling


def _rows(tile: int, image: np.ndarray, keep=None) -> list[tuple]:
    return [(tile, y, x, *map(int, image[y, x])) for y, x in np.ndindex(image.shape[:2]) if keep is None or keep[y, x]]


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(4)
    noise = lambda h, w: np.kron(rng.integers(0, 256, (h // 4, w // 4, 3)), np.ones((4, 4, 1), int))
    wide = rng.integers(0, 256, (48, 48, 3))
    gaps = rng.random((36, 40)) < 0.9
    flat = np.full((32, 32, 3), 90)
    rows = [
        *_rows(1, wide[4:40, 4:40]), *_rows(2, wide[3:39, 6:42]),  # the later image is two to the left, one down
        *_rows(3, noise(32, 36)), *_rows(4, noise(40, 32)),  # of different size
        *_rows(5, wide[:36, :40], gaps), *_rows(6, wide[1:37, 2:42], gaps[::-1]),  # with missing pixels
        *_rows(7, flat), *_rows(8, flat), *_rows(9, noise(24, 40)), *_rows(10, noise(24, 40)),  # flat; small
        (7, 3, 3, 250, 10, 200), (7, 3, 3, 20, 255, None),  # a place that is given more than once
        *_rows(12, noise(32, 32))]
    pixels = spark.createDataFrame(rows, "tile_id long, y int, x int, r int, g int, b int").repartition(3)
    # Tile 11 has no pixels, tile 4 takes part in two pairs.
    pairs = spark.createDataFrame(
        [(f"p{a}-{b}", a, b) for a, b in [(1, 2), (3, 4), (4, 3), (5, 6), (7, 8), (9, 10), (11, 12), (12, 12)]],
        "pair_id string, before_tile long, after_tile long")
    wanted = {f"p{a}-{b}": _figures(rows, a, b) for a, b in [(1, 2), (3, 4), (4, 3), (5, 6), (7, 8), (9, 10), (12, 12)]}
    return pairs, pixels, wanted


def _figures(rows: list[tuple], before: int, after: int) -> tuple:
    def image(tile):
        out = {}
        for _, y, x, *rgb in (r for r in rows if r[0] == tile):
            out[y, x] = tuple(max(a, b or 0) for a, b in zip(out.get((y, x), (0, 0, 0)), rgb))
        return out

    gray = lambda r, g, b: (r * 9798 + g * 19235 + b * 3735 + 16384) >> 15
    one, two = image(before), image(after)
    both = one.keys() & two.keys()
    best = 0, 0, 1.0
    if min(max(p[k] for p in both) - min(p[k] for p in both) + 1 for k in (0, 1)) >= 32:
        tried = []
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                met = [(gray(*one[p]), gray(*two[q])) for p in both if (q := (p[0] + dy, p[1] + dx)) in both]
                a, b = np.array(met, float).T
                corr = 0.0 if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
                tried.append((round(corr, 9), -abs(dx) - abs(dy), dx, dy))
        corr, _, dx, dy = max(tried)
        best = dx, dy, min(1.0, max(0.0, corr))
    later = {(y, x): two.get((y + best[1], x + best[0]), (0, 0, 0)) for y, x in one}
    gap = {p: [abs(a - b) for a, b in zip(one[p], later[p])] for p in one}
    changed = sum(gray(*d) > 28 for d in gap.values())
    return (*best, changed, len(one), float(sum(v * v for d in gap.values() for v in d)), sum(gray(*v) < 35 for v in later.values()))


@pytest.mark.parametrize("batch, broadcast", [(10_000, 200_000), (97, 0)])
def test_figures_equal_plain_python(spark, case, monkeypatch, batch, broadcast):
    pairs, pixels, wanted = case
    monkeypatch.setattr(tiling, "BROADCAST_TILES", broadcast)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.pair_id: r for r in rasters.pair_figures(pairs, pixels).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == wanted.keys()
    for pair, figures in wanted.items():
        row = got[pair]
        assert math.isclose(row.registration_quality, figures[2], abs_tol=1e-8)
        assert (row.shift_x, row.shift_y, row.changed_pixels, row.total_pixels, row.squares, row.dark) == (*figures[:2], *figures[3:])
    assert (got["p1-2"].shift_x, got["p1-2"].shift_y, got["p12-12"].regions) == (-2, 1, 0)


def test_figures_equal_those_of_pixel_rows(spark, case):
    pairs, pixels, wanted = case
    figures = rasters.pair_figures(pairs, pixels).cache()
    shift = change.register_shift(pairing.pair_pixels(pairs, pixels))
    columns = ["pair_id", "shift_x", "shift_y", "registration_quality"]
    assert sorted(shift.select(columns).collect()) == sorted(figures.select(columns).collect())
    diff = change.pixel_diff(pairing.pair_pixels(pairs.join(shift, "pair_id"), pixels.fillna(0)))
    lines = change.diff_lines(diff)
    scores = ["pair_id", "changed_pixels", "total_pixels", "visual_score", "shadow_score"]
    assert sorted(change.line_stats(lines).select(scores).collect()) == sorted(
        change.line_scores(figures).select(scores).collect())
    shape = change.spatial_consistency(diff.where("changed"), figures)
    assert {tuple(r) for r in shape.collect()} == {tuple(r) for r in figures.select("pair_id", change.consistency_score(
        F.col("changed_pixels"), F.col("changed_pixels") / F.nullif("regions", F.lit(0)),
        F.col("top_area"), F.col("fill"))).collect()}


def test_only_packed_pixels_are_shuffled(spark):
    pixels = Tables(spark, "/root/testdata/sf0.001").images
    pairs = spark.createDataFrame([("p", 1, 26), ("q", 2, 27)], "pair_id string, before_tile long, after_tile long")
    text = rasters.pair_figures(pairs, pixels)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and text.count("MapInArrow") == text.count("Scan parquet") == 1
    lines = [line.split("(", 1)[0] for line in text.splitlines()]
    pack, scan = (next(i for i, line in enumerate(lines) if name in line) for name in ("MapInArrow", "Scan parquet"))
    assert pack < scan and not any(w in line for line in lines[pack:scan] for w in ("Exchange ", "Sort"))
