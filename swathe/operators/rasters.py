"""Tile pairs as whole rasters: pixels packed by tile meet by pair, and a task reads pair after pair.

A pixel row of a pair is shuffled and joined for every step that needs it. Here a tile's pixels travel as a few blocks
of bytes instead, so joins handle tiles. What a task holds is one group of pairs, about ``TASK_ROWS`` / 4 pixels of
them, and the raster of a pair, which the tile size bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.operators.change import _best_shift, _join_runs, _overlap
from swathe.operators.tiling import of_tiles
from swathe.session import plain, width_for

_BANDS = ["y", "x", "r", "g", "b"]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of 32-bit numbers (all y, all x, all r, all g, all b) per tile and batch."""
    for batch in batches:
        tiles = batch.column("tile_id").to_numpy(zero_copy_only=False)
        order = np.argsort(tiles, kind="stable")
        ids, starts = np.unique(tiles[order], return_index=True)
        values = np.stack([batch.column(c).to_numpy() for c in _BANDS])[:, order]
        blocks = [values[:, a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(order)])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.schema.field("tile_id").type), pa.array(blocks, pa.binary())], ["tile_id", "block"])


def packed(pixels: DataFrame) -> DataFrame:
    """(tile_id, block): the pixels of each tile in one or more blocks. A missing colour counts as 0."""
    whole = pixels.where("tile_id is not null and y is not null and x is not null").select(
        "tile_id", *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in _BANDS])
    return whole.mapInArrow(_pack, f"tile_id {dict(pixels.dtypes)['tile_id']}, block binary")


def _gray(rgb: np.ndarray) -> np.ndarray:
    """``raster.gray8`` of an array (3, h, w)."""
    return (rgb[0] * 9798 + rgb[1] * 19235 + rgb[2] * 3735 + 16384) >> 15


def _raster(blocks: list[bytes], low: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which places have a pixel, and its colours; of two pixels at a place the larger values."""
    rgb, seen = np.zeros((3, *shape), "int64"), np.zeros(shape, bool)
    for block in blocks:
        y, x, *bands = np.frombuffer(block, "int32").reshape(5, -1)
        y, x = y - low[0], x - low[1]
        seen[y, x] = True
        for band, values in zip(rgb, bands):
            np.maximum.at(band, (y, x), values)
    return seen, rgb


def _pair(first: list[bytes], second: list[bytes], max_shift: int):
    """Figures of a pair and the runs (y, x0, x1) of its changed pixels; nothing if no place is in both images."""
    ends = [np.frombuffer(b, "int32").reshape(5, -1)[:2] for b in first + second]
    low = np.min([e.min(axis=1) for e in ends], axis=0)
    shape = tuple(np.max([e.max(axis=1) for e in ends], axis=0) - low + 1)
    (seen, rgb), (later_seen, later) = (_raster(side, low, shape) for side in (first, second))
    both = seen & later_seen
    if not both.any():
        return None
    dx, dy, quality = _best_shift(_gray(rgb), _gray(later), both, max_shift)
    moved = np.zeros_like(later)
    (ya, yb), (xa, xb) = _overlap(shape[0], dy), _overlap(shape[1], dx)
    moved[:, ya, xa] = later[:, yb, xb]
    gaps = np.abs(rgb - moved)
    changed = seen & (_gray(gaps) > 28)
    squares = float((gaps * gaps).sum(axis=0)[seen].sum())
    edges = np.diff(np.pad(changed, ((0, 0), (1, 1))).astype("int8"), axis=1)
    y, x0 = np.nonzero(edges == 1)
    figures = dx, dy, quality, int(changed.sum()), int(seen.sum()), squares, int((seen & (_gray(moved) < 35)).sum())
    return figures, (y, x0, np.nonzero(edges == -1)[1] - 1)


_FIGURES = {"shift_x": "int", "shift_y": "int", "registration_quality": "double", "changed_pixels": "long",
            "total_pixels": "long", "squares": "double", "dark": "long"}
_SHAPE = {"regions": "long", "top_area": "long", "fill": "double"}


def _group_figures(group: pd.DataFrame, max_shift: int) -> pd.DataFrame:
    figures, runs = [], []
    for pair, rows in group.groupby("pair_id", sort=True):
        first, second = (rows["block"][rows["later"] == later].tolist() for later in (False, True))
        found = _pair(first, second, max_shift) if first and second else None
        if found:
            figures.append((pair, *found[0]))
            runs.append(pd.DataFrame(dict(zip(("pair_id", "y", "x0", "x1"), (pair, *found[1])))))
    out = pd.DataFrame(figures, columns=["pair_id", *_FIGURES])
    runs = pd.concat(runs, ignore_index=True) if runs else pd.DataFrame()
    if not len(runs):
        return out.assign(regions=0, top_area=0, fill=0.0)
    parts = _join_runs(runs).sort_values(["pair_id", "area", "component"], ascending=[True, False, True])
    by_pair = parts.groupby("pair_id")
    largest = by_pair.head(1).set_index("pair_id")
    shape = pd.DataFrame({
        "regions": by_pair.size(), "top_area": by_pair.head(5).groupby("pair_id")["area"].sum(),
        "fill": largest["area"] / (largest["width"] * largest["height"])})
    return out.join(shape, on="pair_id").fillna(dict.fromkeys(_SHAPE, 0))


def pair_figures(pairs: DataFrame, pixels: DataFrame, max_shift: int = 2) -> DataFrame:
    """Registration, difference and shape of the change of each pair, from one pass over its pixels.

    The figures are those of ``register_shift``, of ``diff_lines`` at that shift, and of ``change_components``:
    number of changed regions, area of the five largest, share of its box that the largest fills.
    """
    kind = dict(pairs.dtypes)["pair_id"]
    side = lambda name, later: F.struct(F.col(name).alias("tile_id"), F.lit(later).alias("later"))
    facts = pairs.select("pair_id", F.inline(F.array(side("before_tile", False), side("after_tile", True))))
    ids = facts.select("tile_id").distinct()
    rows, tiles = pixels.agg(F.count("*"), F.approx_count_distinct("tile_id")).first()
    groups = 4 * width_for(pixels.sparkSession, pairs.count() * 2 * rows / max(tiles, 1))
    met = packed(of_tiles(pixels, ids)).join(plain(facts).hint("shuffle_hash"), "tile_id").select(
        F.pmod(F.xxhash64("pair_id"), F.lit(groups)).alias("pairs"), "pair_id", "later", "block")
    schema = ", ".join(f"{c} {t}" for c, t in {"pair_id": kind, **_FIGURES, **_SHAPE}.items())
    return met.groupBy("pairs").applyInPandas(lambda group: _group_figures(group, max_shift), schema)
