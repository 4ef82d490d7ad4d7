"""Scoring of paired tiles: pixels, land cover, query rules, events."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe import lexicon as lx
from swathe.config import Thresholds, Weights
from swathe.functions import confidence as cf
from swathe.functions import raster
from swathe.functions import text as tx
from swathe.functions.numbers import clip, count_where, round_even, share

# -- pixels -----------------------------------------------------------------------


def pixel_diff(pair_pixels: DataFrame) -> DataFrame:
    """Per-band absolute differences and the change mask (gray difference above 28)."""
    df = pair_pixels.withColumns({
        f"d{c}": F.abs(F.col(f"{c}1") - F.col(f"{c}2")) for c in ("r", "g", "b")})
    return df.withColumn("changed", raster.gray8(F.col("dr"), F.col("dg"), F.col("db")) > 28)


def _rmse() -> Column:
    return F.sqrt(F.avg((F.col("dr") * F.col("dr") + F.col("dg") * F.col("dg")
                         + F.col("db") * F.col("db")) / 3.0))


def change_area(diff: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changed pixels, share and ground area; resolution_m of the earlier tile, 10 if unknown."""
    counts = diff.groupBy("pair_id").agg(
        count_where(F.col("changed")).alias("changed_pixels"), F.count("*").alias("total_pixels"))
    return area_columns(counts.join(pairs.select("pair_id", "resolution_m"), "pair_id"))


def area_columns(counts: DataFrame) -> DataFrame:
    metres = F.coalesce(F.nullif("resolution_m", F.lit(0.0)), F.lit(10.0))
    return counts.withColumns({
        "changed_pct": round_even(F.col("changed_pixels") / F.col("total_pixels") * 100.0, 2),
        "altered_area_m2": round_even(F.col("changed_pixels") * metres * metres, 1),
    }).withColumn("altered_area_ha", round_even(F.col("altered_area_m2") / 10000.0, 2))


def visual_score(diff: DataFrame, floor: float = 0.05) -> DataFrame:
    """RMSE over all bands / 28 within floor..1; with floor 0 equal images score 0."""
    return diff.groupBy("pair_id").agg(clip(_rmse() / 28.0, floor, 1.0).alias("visual_score"))


def pair_pixel_stats(diff: DataFrame) -> DataFrame:
    """Everything one pass over the differences can tell about a pair."""
    later_gray = raster.gray8(F.col("r2"), F.col("g2"), F.col("b2"))
    return diff.groupBy("pair_id").agg(
        count_where(F.col("changed")).alias("changed_pixels"), F.count("*").alias("total_pixels"),
        clip(_rmse() / 28.0, 0.05, 1.0).alias("visual_score"),
        share(later_gray < 35).alias("shadow_score"))


def diff_lines(diff: DataFrame) -> DataFrame:
    """Differences reduced to one row per pair and image row, with the changed x positions.

    Figures and shape of a change both follow from it, so the pixels of a pair
    are joined once. A list is at most one tile wide.
    """
    later_gray = raster.gray8(F.col("r2"), F.col("g2"), F.col("b2"))
    squares = F.col("dr") * F.col("dr") + F.col("dg") * F.col("dg") + F.col("db") * F.col("db")
    return diff.groupBy("pair_id", "y").agg(
        F.count("*").alias("n"), F.sum(squares.cast("double")).alias("squares"),
        count_where(later_gray < 35).alias("dark"),
        F.collect_list(F.when(F.col("changed"), F.col("x"))).alias("changed_x"))


def line_stats(lines: DataFrame) -> DataFrame:
    """The figures of ``pair_pixel_stats`` from ``diff_lines``."""
    sums = lines.groupBy("pair_id").agg(
        F.sum(F.size("changed_x").cast("long")).alias("changed_pixels"), F.sum("n").alias("total_pixels"),
        F.sum("squares").alias("squares"), F.sum("dark").alias("dark"))
    return line_scores(sums).drop("squares", "dark")


def line_scores(sums: DataFrame) -> DataFrame:
    """Visual and shadow score from a pair's sums."""
    total = F.col("total_pixels")
    return sums.withColumns({
        "visual_score": clip(F.sqrt(F.col("squares") / (total * 3.0)) / 28.0, 0.05, 1.0),
        "shadow_score": F.col("dark") / total})


def _overlap(size: int, step: int) -> tuple[slice, slice]:
    """Places i of the earlier and i + step of the later image that both exist."""
    return slice(max(0, -step), size - max(0, step)), slice(max(0, step), size - max(0, -step))


def _best_shift(a: np.ndarray, b: np.ndarray, seen: np.ndarray, max_shift: int) -> tuple[int, int, float]:
    """Shift (dx, dy) at which two gray images correlate best over the places seen in both, and that correlation.

    The sums are whole numbers, so the result depends on no order; of equal shifts the nearest, then the larger wins.
    """
    sides = [np.flatnonzero(seen.any(axis=k)) for k in (1, 0)]
    if min(s[-1] - s[0] + 1 for s in sides) < 32:
        return 0, 0, 1.0
    a, b = np.where(seen, a, 0).astype("float64"), np.where(seen, b, 0).astype("float64")
    mask = None if seen.all() else seen.astype("float64")
    best = None
    for dy in range(-max_shift, max_shift + 1):
        ya, yb = _overlap(len(a), dy)
        for dx in range(-max_shift, max_shift + 1):
            xa, xb = _overlap(a.shape[1], dx)
            p, q = a[ya, xa].ravel(), b[yb, xb].ravel()
            n = p.size
            if mask is not None:
                both = (mask[ya, xa] * mask[yb, xb]).ravel()
                p, q, n = p * both, q * both, int(both.sum())
            sp, sq = int(p.sum()), int(q.sum())
            spread = (n * int(p @ p) - sp * sp) * (n * int(q @ q) - sq * sq)
            corr = (n * int(p @ q) - sp * sq) / math.sqrt(spread) if spread else 0.0
            best = max(best or (-2.0,), (corr, -abs(dx) - abs(dy), dx, dy))
    return best[2], best[3], min(1.0, max(0.0, best[0]))


def register_shift(pair_pixels: DataFrame, max_shift: int = 2) -> DataFrame:
    """Whole-pixel shift of the later image that best correlates with the earlier one.

    (pair_id, shift_x, shift_y, registration_quality): the correlation of gray
    levels within 0..1; 1 for images under 32 pixels on a side, 0 for flat ones.
    The pixels of a pair, which the tile size bounds, are tried in one piece over the clustering by pair that
    ``pair_pixels`` leaves, so they are not shuffled again. Shifts below one pixel are not searched.
    """
    gray = pair_pixels.select(
        "pair_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
        raster.gray8(F.col("r1"), F.col("g1"), F.col("b1")).alias("a"),
        raster.gray8(F.col("r2"), F.col("g2"), F.col("b2")).alias("b")).dropna()

    def tried(pair: pd.DataFrame) -> pd.DataFrame:
        y, x = (pair[c].to_numpy() - pair[c].min() for c in ("y", "x"))
        a, b, seen = (np.zeros((y.max() + 1, x.max() + 1), kind) for kind in ("int64", "int64", bool))
        a[y, x], b[y, x], seen[y, x] = pair["a"], pair["b"], True
        return pd.DataFrame([(pair["pair_id"].iloc[0], *_best_shift(a, b, seen, max_shift))])

    kind = dict(pair_pixels.dtypes)["pair_id"]
    return gray.groupBy("pair_id").applyInPandas(
        tried, f"pair_id {kind}, shift_x int, shift_y int, registration_quality double")


# -- shape of the change ---------------------------------------------------------------

def mask_runs(mask: DataFrame) -> DataFrame:
    """Changed pixels (pair_id, y, x) as horizontal runs (pair_id, y, x0, x1)."""
    line = Window.partitionBy("pair_id", "y").orderBy("x")
    return mask.select("pair_id", "y", "x").withColumn(
        "island", F.col("x") - F.row_number().over(line)).groupBy("pair_id", "y", "island").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def _join_runs(runs: pd.DataFrame) -> pd.DataFrame:
    """Areas and boxes of the 8-connected components of the runs of some pairs, which stand by pair, y and x0."""
    pair = pd.factorize(runs["pair_id"])[0]
    y, x0, x1 = (runs[c].to_numpy("int64") for c in ("y", "x0", "x1"))
    # A number per pair and row, with a free one between pairs, and along it the places of the ends.
    line = pair * (y.max() - y.min() + 2) + y - y.min()
    wide = x1.max() - x0.min() + 4
    left, right = line * wide + x0 - x0.min() + 1, line * wide + x1 - x0.min() + 1
    # Runs of a row are disjoint and sorted, so the touching ones above are a slice.
    first = np.searchsorted(right, left - wide - 1, "left")
    count = np.maximum(np.searchsorted(left, right - wide + 1, "right") - first, 0)
    below = np.repeat(np.arange(len(runs)), count)
    above = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    # Each run takes the smallest label around it and the label of its label, until nothing changes.
    root = np.arange(len(runs))
    while True:
        low = np.minimum(root[below], root[above])
        new = root.copy()
        np.minimum.at(new, root[below], low)
        np.minimum.at(new, root[above], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    parts = pd.DataFrame({"pair_id": runs["pair_id"].to_numpy(), "root": root, "y": y, "x0": x0, "x1": x1, "area": x1 - x0 + 1}).groupby(
        "root", sort=False).agg(pair_id=("pair_id", "first"), area=("area", "sum"), x0=("x0", "min"), x1=("x1", "max"),
                                y0=("y", "min"), y1=("y", "max"))
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return pd.DataFrame({
        "pair_id": parts["pair_id"], "component": parts.index - starts[pair[parts.index]], "area": parts["area"],
        "width": parts["x1"] - parts["x0"] + 1, "height": parts["y1"] - parts["y0"] + 1})


def _join_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of sorted runs; the last pair of a batch waits for the rest of its runs."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held):
            open_ = (held["pair_id"] == held["pair_id"].iloc[-1]).to_numpy()
            if not open_.all():
                yield _join_runs(held[~open_])
                held = held[open_].reset_index(drop=True)
    if held is not None and len(held):
        yield _join_runs(held)


def change_components(mask: DataFrame) -> DataFrame:
    """(pair_id, component, area, width, height) of the 8-connected changed regions.

    Runs are found by a window, so Python joins runs, not pixels, those of many pairs at a time; a pair's runs, which
    the tile size bounds, are what a task holds beside a batch.
    """
    schema = f"pair_id {dict(mask.dtypes)['pair_id']}, component long, area long, width long, height long"
    runs = mask_runs(mask).repartition("pair_id")
    return runs.sortWithinPartitions("pair_id", "y", "x0").mapInPandas(_join_batches, schema)


def spatial_consistency(mask: DataFrame, pairs: DataFrame) -> DataFrame:
    """How clustered and compact the change is, per pair in ``pairs``.

    45 % share of the five largest regions, 35 % mean region size (full at 120
    pixels), 20 % fill of the largest region's box; .2 below ten pixels.
    """
    by_area = Window.partitionBy("pair_id").orderBy(F.desc("area"), "component")
    parts = change_components(mask).withColumn("place", F.row_number().over(by_area))
    largest = F.col("place") == 1
    stats = parts.groupBy("pair_id").agg(
        F.sum("area").alias("changed"), F.avg("area").alias("mean_area"),
        F.sum(F.when(F.col("place") <= 5, F.col("area"))).alias("top_area"),
        F.max(F.when(largest, F.col("area") / (F.col("width") * F.col("height")))).alias("fill"))
    return pairs.select("pair_id").join(stats, "pair_id", "left").select("pair_id", consistency_score(
        F.col("changed"), F.col("mean_area"), F.col("top_area"), F.col("fill")).alias("spatial_consistency"))


def consistency_score(changed: Column, mean_area: Column, top_area: Column, fill: Column) -> Column:
    score = clip(
        top_area / changed * 0.45 + F.least(F.lit(1.0), mean_area / 120.0) * 0.35
        + F.least(F.lit(1.0), fill) * 0.20, 0.05, 0.99)
    return F.when(changed >= 10, score).otherwise(0.2)


# -- land cover -------------------------------------------------------------------------

COVER = ("water_pct", "veg_pct", "urban_pct")


def landcover_delta(pairs: DataFrame, cover: DataFrame) -> DataFrame:
    """Land cover of both sides and the change; a tile without figures is wholly built-up."""
    for name in ("before", "after"):
        pairs = pairs.join(cover.select(
            F.col("tile_id").alias(f"{name}_tile"),
            *[F.col(c).alias(f"{name}_{c}") for c in COVER]), f"{name}_tile", "left")
    spare = {"water_pct": 0.0, "veg_pct": 0.0, "urban_pct": 100.0}
    pairs = pairs.withColumns({
        f"{n}_{c}": F.coalesce(f"{n}_{c}", F.lit(spare[c])) for n in ("before", "after") for c in COVER})
    return pairs.withColumns({
        f"d_{c.removesuffix('_pct')}": round_even(F.col(f"after_{c}") - F.col(f"before_{c}"), 1)
        for c in COVER})


def base_change_type(d_urban: Column, d_veg: Column, d_water: Column) -> Column:
    return (
        F.when(d_urban >= 2.0, "new_construction")
        .when(d_urban <= -2.0, "built_up_reduction")
        .when(d_veg <= -2.0, "vegetation_clearance")
        .when(d_veg >= 2.0, "vegetation_growth")
        .when(F.abs(d_water) >= 2.0, "water_change")
        .otherwise("structural_change"))


def base_note() -> Column:
    area = F.format_string("%,.0f m² altered)", F.col("altered_area_m2"))
    num = lambda c: F.format_string("%.1f", F.col(c))
    urban, veg = num("d_urban"), num("d_veg")
    hectares = F.format_string("%.2f ha)", F.col("altered_area_ha"))
    return (
        F.when(F.col("d_urban") >= 2.0, F.concat(F.lit("Built-up expansion (+"), urban, F.lit("% urban shift, "), area))
        .when(F.col("d_urban") <= -2.0, F.concat(F.lit("Built-up surface reduction ("), urban, F.lit("% urban shift, "), area))
        .when(F.col("d_veg") <= -2.0, F.concat(F.lit("Vegetation clearance ("), veg, F.lit("% canopy reduction, "), hectares))
        .when(F.col("d_veg") >= 2.0, F.concat(F.lit("Vegetation growth (+"), veg, F.lit("% greening, "), hectares))
        .when(F.abs("d_water") >= 2.0, F.format_string("Water surface shift (%+.1f%% water area change)", F.col("d_water")))
        .otherwise(F.format_string("Surface structural change (%.2f%% pixels altered, %,.0f m²)",
                                   F.col("changed_pct"), F.col("altered_area_m2"))))


# -- query rules ---------------------------------------------------------------------------

def _raised(score: Column, base: float, bonus: float) -> Column:
    return F.least(F.lit(0.99), F.greatest(score, F.lit(base)) + bonus)


def _lowered(score: Column, floor: float, by: float) -> Column:
    return F.greatest(F.lit(floor), score - by)


def _apply_rule(df: DataFrame, cases: list[tuple]) -> DataFrame:
    """One rule: the first case that holds sets the score, may set the type, may leave a note.

    A case is (condition, score, type or None, note or None); None keeps what is there.
    """
    score, kind, note = F, F, F
    for condition, new_score, new_kind, new_note in cases:
        text = F.lit(None).cast("string") if new_note is None else (
            F.lit(new_note) if isinstance(new_note, str) else new_note)
        named = F.col("change_type") if new_kind is None else (
            F.lit(new_kind) if isinstance(new_kind, str) else new_kind)
        score = score.when(condition, new_score if isinstance(new_score, Column) else F.lit(new_score))
        kind = kind.when(condition, named)
        note = note.when(condition, text)
    return df.withColumns({
        "query_match": score.otherwise(F.col("query_match")),
        "change_type": kind.otherwise(F.col("change_type")),
        "notes": F.concat("notes", F.array_compact(F.array(note))),
    })


def query_match(df: DataFrame) -> DataFrame:
    """Run the query rules in order; each reads the score left by those before it.

    Needs the asks_* and *_site flags, d_urban/d_veg/d_water, the before_/after_
    land cover, visual_score, registration_quality, max_cloud, after_year,
    before_date, after_date, altered_area_m2, path_tokens, and the starting
    query_match, change_type and notes.
    """
    c = F.col
    m, num = c("query_match"), lambda name: F.format_string("%.1f", F.col(name))
    d_urban, d_veg, d_water = c("d_urban"), c("d_veg"), c("d_water")
    max_water = F.greatest("before_water_pct", "after_water_pct")
    area = F.format_string("%,.0f m²", c("altered_area_m2"))

    solar_hit = c("solar_site") | ((d_urban >= 10.0) & (c("after_veg_pct") < 20.0) & ~c("water_site"))
    flying = ~c("asks_solar") & c("asks_aviation")
    df = _apply_rule(df, [
        (c("asks_solar") & solar_hit, _raised(m, 0.88, 0.10), "solar_park_development",
         "Solar farm installation and solar panel field development verified"),
        (c("asks_solar"), 0.05, None, "Non-solar site (excluded from solar farm search)"),
        (flying & c("airport_site"), _raised(m, 0.88, 0.10), "airport_expansion",
         "Airport runway and passenger terminal infrastructure development verified"),
        (flying, 0.05, None, "Non-aviation site (excluded from airport search)"),
    ])
    road = c("asks_road") & ~c("asks_aviation")
    df = _apply_rule(df, [
        (road & c("road_site") & (d_urban >= 1.0), _raised(m, 0.90, 0.08), "road_infrastructure_expansion",
         F.concat(F.lit("Road network and paved transportation infrastructure expansion verified (+"),
                  num("d_urban"), F.lit("% paved surface shift)"))),
        (road & (c("solar_site") | c("water_site")), 0.05, None,
         "Non-road site (solar farm or water body excluded from road search)"),
        (road & (d_urban >= 2.0), F.least(F.lit(0.85), F.greatest(m, F.lit(0.65))),
         "road_infrastructure_expansion",
         F.concat(F.lit("Paved transportation surface shift verified (+"), num("d_urban"), F.lit("% paved shift)"))),
        (road, _lowered(m, 0.08, 0.35), None, None),
    ])
    water = c("asks_water") & ~c("asks_construction")
    wet = c("water_site") | (max_water >= 1.0)
    waterfront = c("asks_water") & c("asks_construction")
    df = _apply_rule(df, [
        (water & wet & (d_water >= 1.0), _raised(m, 0.90, 0.08), "water_area_increase",
         F.concat(F.lit("Water body expansion verified: water surface increased by +"), num("d_water"),
                  F.lit("% (approx. "), area, F.lit(" gain)"))),
        (water & wet & (d_water <= -1.0), _raised(m, 0.90, 0.08), "water_area_decrease",
         F.concat(F.lit("Water body contraction verified: water surface decreased by "), num("d_water"),
                  F.lit("% (approx. "), area, F.lit(" loss)"))),
        (water & wet, _raised(m, 0.90, 0.08), "water_surface_stability",
         F.format_string("Water body surface verified with minor seasonal delta (%+.1f%%)", d_water)),
        (water, 0.02, None, "Inland observation (0.0% water in tile footprint)"),
        (waterfront & (max_water >= 1.0) & (d_urban >= 1.0), 0.98, "waterfront_construction",
         F.concat(F.format_string("Waterfront development verified: %.1f%% water proximity with +", max_water),
                  num("d_urban"), F.lit("% built-up shift"))),
        (waterfront & (max_water < 1.0), _lowered(m, 0.05, 0.40), None,
         "Inland observation (no water body in proximity)"),
    ])
    building = c("asks_construction") & ~(
        c("asks_solar") | c("asks_aviation") | c("asks_water") | c("asks_road"))
    df = _apply_rule(df, [
        (building & c("water_site"), 0.05, None, "Water reservoir excluded from construction search"),
        (building & c("solar_site"), 0.35, None, None),
        (building & (d_urban >= 2.0), _raised(m, 0.85, 0.10), "new_construction",
         F.concat(F.lit("Built-up expansion verified (+"), num("d_urban"), F.lit("% urban shift)"))),
        (building & (d_urban <= -1.0), _lowered(m, 0.10, 0.20), None,
         F.format_string("No new construction observed (built-up decreased by %.1f%%)", F.abs(d_urban))),
    ])
    df = _apply_rule(df, [
        (c("asks_veg_loss") & (d_veg <= -2.0), _raised(m, 0.85, 0.12), "vegetation_loss",
         F.format_string("Vegetation clearance verified (%.1f%% vegetation reduction)", F.abs(d_veg))),
        (c("asks_veg_loss"), _lowered(m, 0.08, 0.35), None, "No vegetation clearance observed"),
    ])
    day = lambda name, spare: F.coalesce(F.date_format(name, "yyyy-MM-dd"), F.lit(spare))
    df = _apply_rule(df, [
        (c("asks_appearance") & ((d_urban >= 2.0) | (F.abs(d_water) >= 1.0) | (c("visual_score") >= 0.40)),
         _raised(m, 0.88, 0.10), None,
         F.concat(F.lit("Chronological estimation: transformation first appeared in "),
                  day("after_date", "latest"), F.lit(" observation (absent in "),
                  day("before_date", "baseline"), F.lit(" baseline)"))),
    ])
    steady = (c("registration_quality") >= 0.55) & (c("max_cloud") < 15.0)
    strong = (d_urban >= 2.0) | (F.abs(d_water) >= 2.0) | (c("visual_score") >= 0.45)
    df = _apply_rule(df, [
        (c("asks_suppression") & steady & strong, _raised(m, 0.90, 0.08), None,
         F.format_string("Transient noise and seasonal variations suppressed. Verified persistent "
                         "high-confidence physical transformation (registration quality: %.2f, cloud: %.1f%%)",
                         c("registration_quality"), c("max_cloud"))),
        (c("asks_suppression") & steady, _lowered(m, 0.15, 0.25), None,
         "Suppressed minor seasonal variation (zero permanent structural change)"),
        (c("asks_suppression"), _lowered(m, 0.10, 0.30), None,
         "Potential atmospheric noise or lower registration quality"),
    ])
    df = _apply_rule(df, [
        (c("asks_since").isNotNull() & (c("after_year") < c("asks_since")), _lowered(m, 0.02, 0.50), None,
         F.format_string("Observation date before %d (excluded by temporal filter)", c("asks_since"))),
    ])
    placed, here = F.size("asked_places") > 0, F.arrays_overlap("asked_places", "path_tokens")
    return _apply_rule(df, [
        (placed & here, F.least(F.lit(0.99), m + 0.15), None,
         F.concat(F.lit("Target region matched ("), F.initcap(F.array_join("asked_places", ", ")), F.lit(")"))),
        (placed, _lowered(m, 0.02, 0.50), None, "Outside requested geographic region"),
    ])


# -- confidence of pairs and events --------------------------------------------------------

def pair_signals(pairs: DataFrame) -> DataFrame:
    """The ten signals of pairs that carry both tiles' attributes and the pixel figures.

    A quality of NULL or 0 counts as .80, a missing cloud cover as none.
    """
    quality = lambda n: F.coalesce(F.nullif(F.col(f"{n}_quality_score"), F.lit(0.0)), F.lit(0.80))
    cloud = lambda n: F.coalesce(F.col(f"{n}_cloud_cover_pct"), F.lit(0.0))
    deltas = F.col("d_urban"), F.col("d_veg"), F.col("d_water")
    return pairs.withColumns({
        "visual_change": F.col("visual_score"),
        "semantic_change": F.col("semantic_score"),
        "image_quality": F.least(quality("before"), quality("after")),
        "cloud_score": F.greatest(cloud("before"), cloud("after")) / 100.0,
        "registration_confidence": F.col("registration_quality"),
        "sensor_compatibility": cf.sensor_compatibility(
            F.col("before_sensor"), F.col("before_resolution_m"),
            F.col("after_sensor"), F.col("after_resolution_m")),
        "seasonal_compatibility": cf.seasonal_compatibility(F.col("before_date"), F.col("after_date")),
        "spectral_evidence": cf.spectral_evidence(*deltas),
        "is_seasonal_vegetation": cf.is_seasonal_vegetation(*deltas),
    })


def evaluate_with_configs(signals: DataFrame, configs: list[tuple[str, Weights, Thresholds]]) -> DataFrame:
    """Score every row under each named configuration.

    The configurations are a handful of constants: one array literal is exploded
    next to each row, so nothing is joined or shuffled.
    """
    fields = lambda prefix, cfg: [
        F.lit(getattr(cfg, f)).alias(f"{prefix}_{f}") for f in cfg.__dataclass_fields__]
    rows = F.array(*[
        F.struct(F.lit(name).alias("config"), *fields("w", w), *fields("t", t)) for name, w, t in configs])
    swept = signals.select("*", F.inline(rows))

    class Columns:
        def __init__(self, prefix: str) -> None:
            self.prefix = prefix

        def __getattr__(self, name: str) -> Column:
            return F.col(f"{self.prefix}_{name}")

    extra = [f for f in swept.columns if f.startswith(("w_", "t_"))]
    return cf.evaluate_signals(swept, Columns("w"), Columns("t")).drop(*extra)


def change_events(scored: DataFrame) -> DataFrame:
    """Event rows with their evidence as a struct and a readable explanation.

    The event id is a hash of the two tiles (and the query), so reruns agree.
    """
    closing = (
        F.when(F.col("is_suppressed") & (F.size("reasons") > 0),
               F.concat(F.lit("Suppressed: "), F.array_join("reasons", "; ")))
        .when(F.size("positive_factors") > 0,
              F.concat(F.lit("Confidence evidence: "),
                       F.array_join(F.slice("positive_factors", 1, 2), "; "))))
    explanation = F.concat(
        F.array_join(F.concat("notes", F.array_compact(F.array(closing))), ". "), F.lit("."))
    side = lambda n: F.struct(
        F.col(f"{n}_scene").alias("scene_id"), F.col(f"{n}_tile_col").alias("tile_col"),
        F.col(f"{n}_tile_row").alias("tile_row"), F.col(f"{n}_water_pct").alias("water_pct"),
        F.col(f"{n}_veg_pct").alias("veg_pct"), F.col(f"{n}_urban_pct").alias("urban_pct"))
    evidence = F.struct(
        F.col("query_match"), explanation.alias("explanation"), "confidence_tier", "reasons",
        "positive_factors", "changed_pixels", "total_pixels", "changed_pct", "altered_area_m2",
        "altered_area_ha", "d_urban", "d_veg", "d_water", F.col("iou").alias("spatial_iou"),
        side("before").alias("before"), side("after").alias("after"))
    penalty = lambda name: round_even(F.col(name), 4)
    return scored.select(
        F.col("pair_id").alias("event_id"), "before_tile", "after_tile", "before_date", "after_date",
        F.col("before_center_lon").alias("center_lon"), F.col("before_center_lat").alias("center_lat"),
        "change_type", "final_confidence", "confidence", "query_match",
        F.col("visual_score").alias("visual_change_score"),
        F.col("semantic_score").alias("semantic_change_score"),
        F.col("spectral_evidence").alias("spectral_change_score"), "registration_quality",
        penalty("cloud_penalty").alias("cloud_penalty"), penalty("shadow_penalty").alias("shadow_penalty"),
        F.coalesce(penalty("seasonal_vegetation_penalty"), F.col("seasonal_timing_penalty")).alias(
            "seasonal_penalty"),
        F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).alias("suppression_reason"),
        "is_suppressed", "confidence_tier", F.lit("PENDING").alias("review_status"),
        cf.factor_breakdown().alias("confidence_breakdown"), evidence.alias("evidence"))


def rank_events(events: DataFrame, limit: int, with_query: bool) -> DataFrame:
    """Best events first: query matches (.25 or better) by a blend, the rest by confidence."""
    confidence = F.col("final_confidence")
    if not with_query:
        return events.orderBy(F.desc("final_confidence"), "event_id").limit(limit)
    match = F.round(F.col("query_match"), 3)
    fits = F.coalesce(match >= 0.25, F.lit(False))
    key = F.when(fits, match * 0.7 + confidence * 0.3).otherwise(confidence)
    return events.orderBy(fits.desc(), key.desc(), "event_id").limit(limit)


def backfill_event_metadata(events: DataFrame) -> DataFrame:
    """Fill a missing tier, reasons or factors from the stored breakdown."""
    return events.withColumns({
        name: F.coalesce(F.col(name), F.col(f"breakdown.{name}"))
        for name in ("confidence_tier", "reasons", "positive_factors")})


def shown_tier(tier: Column, confidence: Column, suppressed: Column) -> Column:
    """Stored tier, or one from the score when none was stored."""
    spare = (F.when(suppressed, "Suppressed").when(confidence >= 0.70, "High Confidence")
             .when(confidence >= 0.45, "Medium Confidence").otherwise("Low Confidence"))
    return F.coalesce(F.nullif(tier, F.lit("")), spare)
