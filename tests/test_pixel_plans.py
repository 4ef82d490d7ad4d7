"""Joins with pixel tables never broadcast or sort the pixels, and components are joined for many pairs at a time."""

import numpy as np
import pandas as pd
import pytest

from registry.tables import Tables
from registry.pairing_checks import _pairs
from swathe.operators import change, pairing, tiling
from swathe.session import cut_lineage

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [
    lambda t: tiling.thumbnail_stretch(t.images),
    lambda t: tiling.rgb8(t.images, ["r", "g", "b"]),
    lambda t: tiling.downsample(t.pixels, t.tiles, 16, 8),
    lambda t: pairing.pair_pixels(_pairs(t), t.images),
])
def test_pixels_stream_past_hashed_facts(spark, make):
    # The files of these tables are far below the limit of a broadcast.
    plan = make(Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    assert "BroadcastExchange" not in plan and "SortMergeJoin" not in plan


def test_components_of_many_pairs_in_odd_batches():
    rng = np.random.default_rng(5)
    masks = {f"p{n}": rng.random((9, 11)) < share for n, share in enumerate((0.2, 0.5, 0.7, 1.0, 0.4, 0.45))}
    rows, expected = [], []
    for pair, mask in masks.items():
        seen = np.zeros_like(mask)
        for y, x in np.argwhere(mask):
            if not seen[y, x]:
                todo, cells = [(y, x)], []
                seen[y, x] = True
                while todo:
                    a, b = todo.pop()
                    cells.append((a, b))
                    for c in range(max(a - 1, 0), min(a + 2, 9)):
                        for d in range(max(b - 1, 0), min(b + 2, 11)):
                            if mask[c, d] and not seen[c, d]:
                                seen[c, d] = True
                                todo.append((c, d))
                ys, xs = zip(*cells)
                expected.append((pair, len(cells), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
        for y in range(9):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], mask[y].astype(int), [0]))))
            rows += [(pair, y, int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]
    runs = pd.DataFrame(rows, columns=["pair_id", "y", "x0", "x1"])
    for step in (1, 7, len(runs)):
        parts = pd.concat(change._join_batches(runs.iloc[i:i + step] for i in range(0, len(runs), step)))
        got = parts[["pair_id", "area", "width", "height"]].itertuples(index=False, name=None)
        assert sorted(got) == sorted(expected)
        assert (parts.groupby("pair_id")["component"].min() == 0).all()


def test_filters_behind_small_tables_are_not_computed_for_pixels(spark):
    t = Tables(spark, SMALL)
    facts = t.tiles.where("is_valid").select("tile_id", "sensor")  # is_valid is computed from tile_id % 29
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tiling.beside(t.images, facts, "tile_id")).count("% 29)") == plan(facts).count("% 29)") > 0
    assert "% 29)" not in plan(t.images.join(cut_lineage(facts), "tile_id"))
    assert cut_lineage(facts).schema == facts.schema
