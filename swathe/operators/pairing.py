"""Pairing observations of the same ground: scenes, then tiles, then one-to-one.

Every join here is an equality join on a computed cell, so none degrades to a
nested loop, and each true pair comes out of exactly one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe.functions.geometry import box_iou, boxes_overlap, distance
from swathe.operators.tiling import beside
from swathe.session import cut_lineage, width_for

SIDES = ("west", "south", "east", "north")


def usable_quality(quality: Column) -> Column:
    """Pair gate: a score of .25 or better, or none at all."""
    return quality.isNull() | (quality >= 0.25)


def large_enough(pixels: Column) -> Column:
    """At least 32 pixels on a side; an unknown or zero side counts as 256."""
    return F.coalesce(F.nullif(pixels, F.lit(0)), F.lit(256)) >= 32


def not_sliver(tiles: DataFrame) -> Column:
    height = F.col("pixel_height") if "pixel_height" in tiles.columns else F.lit(None).cast("int")
    return large_enough(F.col("pixel_width")) & large_enough(height)


def scene_envelopes(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("scene_id").agg(
        F.min("acquisition_date").alias("date"),
        F.min("bbox_west").alias("west"), F.min("bbox_south").alias("south"),
        F.max("bbox_east").alias("east"), F.max("bbox_north").alias("north"))


def scene_pairs(tiles: DataFrame, salts: int = 16) -> DataFrame:
    """(before_scene, after_scene, before_date, after_date) of overlapping scenes.

    Unordered pairs with different dates, the earlier first. Envelopes meet in
    grid cells and the cell of the shared south-west corner reports the pair; a
    salt spreads a cell in which many scenes pile up. A scene without any box
    is taken to overlap every other scene.
    """
    scenes = scene_envelopes(tiles)
    whole = F.col("west").isNotNull() & F.col("south").isNotNull() & F.col("east").isNotNull() & F.col("north").isNotNull()
    scenes = scenes.withColumn("open", ~whole)
    boxed = scenes.where(~F.col("open"))
    # Most envelopes fit one cell of this size; a larger one covers several.
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    cell = boxed.agg(F.percentile_approx(extent, 0.9)).first()[0] or 1.0
    cell = max(cell, 1e-4)
    index = lambda v: F.floor(v / cell)
    salt = F.pmod(F.xxhash64("scene_id"), F.lit(salts)).cast("int")
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))

    def side(df: DataFrame, name: str, salt_col: Column) -> DataFrame:
        placed = df.withColumn("salt", salt_col).withColumn(
            "cx", F.explode(F.sequence(index(F.col("west")), index(F.col("east"))))).withColumn(
            "cy", F.explode(F.sequence(index(F.col("south")), index(F.col("north")))))
        return placed.select("salt", "cx", "cy", *[
            F.col(c).alias(f"{name}_{c}") for c in ("scene_id", "date", *SIDES)])

    a, b = side(boxed, "a", salt), side(boxed, "b", all_salts)
    box = lambda name: tuple(F.col(f"{name}_{s}") for s in SIDES)
    met = a.join(b, ["salt", "cx", "cy"]).where(
        (F.col("a_scene_id") < F.col("b_scene_id")) & boxes_overlap(box("a"), box("b"))
        & (F.col("cx") == index(F.greatest("a_west", "b_west")))
        & (F.col("cy") == index(F.greatest("a_south", "b_south"))))
    keep = ["a_scene_id", "a_date", "b_scene_id", "b_date"]

    # Scenes without a box: every partner is part of the result, so salting alone spreads it.
    slim = lambda df, name: df.select("salt", *[
        F.col(c).alias(f"{name}_{c}") for c in ("scene_id", "date")], F.col("open").alias(f"{name}_open"))
    open_side = slim(scenes.where("open").withColumn("salt", all_salts), "a")
    other = slim(scenes.withColumn("salt", salt), "b")
    loose = open_side.join(other, "salt").where(
        (F.col("a_scene_id") != F.col("b_scene_id"))
        & (~F.col("b_open") | (F.col("a_scene_id") < F.col("b_scene_id"))))
    swap = F.col("a_scene_id") > F.col("b_scene_id")
    pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    loose = loose.select(
        pick("b_scene_id", "a_scene_id").alias("a_scene_id"), pick("b_date", "a_date").alias("a_date"),
        pick("a_scene_id", "b_scene_id").alias("b_scene_id"), pick("a_date", "b_date").alias("b_date"))

    both = met.select(*keep).unionByName(loose).where(~F.col("a_date").eqNullSafe(F.col("b_date")))
    a_first = F.coalesce(F.col("a_date") < F.col("b_date"), F.lit(False))
    order = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    return both.select(
        order("a_scene_id", "b_scene_id").alias("before_scene"),
        order("b_scene_id", "a_scene_id").alias("after_scene"),
        order("a_date", "b_date").alias("before_date"), order("b_date", "a_date").alias("after_date"))


_GEOMETRY = ["tile_id", "scene_id", "tile_col", "tile_row", "center_lon", "center_lat",
             *[f"bbox_{s}" for s in SIDES]]
_PAIR = ["before_scene", "after_scene"]


def _sides(tiles: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each tile once per scene pair it may take part in, as before and as after side."""
    slim = tiles.where(not_sliver(tiles)).select(*_GEOMETRY)
    pairs = pairs.select(*_PAIR)

    def side(name: str) -> DataFrame:
        renamed = slim.select(F.col("scene_id").alias(f"{name}_scene"), *[
            F.col(c).alias(f"{name}_{'tile' if c == 'tile_id' else c}")
            for c in _GEOMETRY if c != "scene_id"])
        return renamed.join(pairs, f"{name}_scene")

    return side("before"), side("after")


def _box(name: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{name}_bbox_{s}") for s in SIDES)


def _has_box(name: str) -> Column:
    present = F.lit(True)
    for side in _box(name):
        present = present & side.isNotNull()
    return present


def _centre_distance() -> Column:
    return distance(F.col("before_center_lon"), F.col("before_center_lat"),
                    F.col("after_center_lon"), F.col("after_center_lat"))


def _iou() -> Column:
    """IoU of a pair; without both boxes, 1 if the centres almost coincide."""
    near = F.when(F.coalesce(_centre_distance() < 0.001, F.lit(False)), 1.0).otherwise(0.0)
    return F.when(_has_box("before") & _has_box("after"),
                  box_iou(_box("before"), _box("after"))).otherwise(near)


def pairs_by_iou(before: DataFrame, after: DataFrame, min_iou: float = 0.70) -> DataFrame:
    """Pairs with boxes on both sides and IoU of at least ``min_iou`` (.5 or more).

    Such boxes differ by less than a factor two per side, and their centres by
    less than (1 - t) / t of a side. So each later tile sits in the cell of its
    centre, on the grid of its own size class and of the two next to it, and
    each earlier tile looks up the (at most four) cells its partners can be in.
    """
    if min_iou < 0.5:
        raise ValueError("the cell search needs min_iou >= 0.5")
    reach = (1 - min_iou) / min_iou * 1.0001
    size_class = lambda lo, hi: F.floor(F.log2(F.col(hi) - F.col(lo))).cast("int")
    edge = lambda level: F.pow(F.lit(2.0), level + 1)
    middle = lambda name, lo, hi: (F.col(f"{name}_bbox_{lo}") + F.col(f"{name}_bbox_{hi}")) / 2

    def cells(lo: str, hi: str, level: str) -> Column:
        centre = middle("before", lo, hi)
        slack = (F.col(f"before_bbox_{hi}") - F.col(f"before_bbox_{lo}")) * reach
        return F.explode(F.sequence(
            F.floor((centre - slack) / edge(F.col(level))), F.floor((centre + slack) / edge(F.col(level)))))

    proper = lambda name: _has_box(name) & (
        F.col(f"{name}_bbox_east") > F.col(f"{name}_bbox_west")) & (
        F.col(f"{name}_bbox_north") > F.col(f"{name}_bbox_south"))
    left = before.where(proper("before")).withColumns({
        "lx": size_class("before_bbox_west", "before_bbox_east"),
        "ly": size_class("before_bbox_south", "before_bbox_north")})
    left = left.withColumn("cx", cells("west", "east", "lx")).withColumn(
        "cy", cells("south", "north", "ly"))
    near_levels = lambda level: F.explode(F.sequence(level - 1, level + 1))
    right = after.where(proper("after")).withColumn(
        "lx", near_levels(size_class("after_bbox_west", "after_bbox_east"))).withColumn(
        "ly", near_levels(size_class("after_bbox_south", "after_bbox_north")))
    right = right.withColumns({
        "cx": F.floor(middle("after", "west", "east") / edge(F.col("lx"))),
        "cy": F.floor(middle("after", "south", "north") / edge(F.col("ly")))})
    met = left.join(right, [*_PAIR, "lx", "ly", "cx", "cy"])
    return met.where(box_iou(_box("before"), _box("after")) >= min_iou).drop("lx", "ly", "cx", "cy")


def pairs_by_grid(before: DataFrame, after: DataFrame, max_distance: float = 0.0015) -> DataFrame:
    """Pairs at the same grid position whose centres almost coincide."""
    left = before.withColumns({"tc": F.col("before_tile_col"), "tr": F.col("before_tile_row")})
    right = after.withColumns({"tc": F.col("after_tile_col"), "tr": F.col("after_tile_row")})
    return left.join(right, [*_PAIR, "tc", "tr"]).where(
        _centre_distance() < max_distance).drop("tc", "tr")


def pairs_by_centre(before: DataFrame, after: DataFrame, max_distance: float = 0.001) -> DataFrame:
    """Pairs in which a box is missing and the centres almost coincide."""
    index = lambda v: F.floor(v / max_distance)
    around = lambda c: F.explode(F.sequence(index(F.col(c)) - 1, index(F.col(c)) + 1))

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.where(F.col("before_center_lon").isNotNull() & F.col("before_center_lat").isNotNull())
        left = left.withColumn("cx", around("before_center_lon")).withColumn(
            "cy", around("before_center_lat"))
        right = right.withColumns({
            "cx": index(F.col("after_center_lon")), "cy": index(F.col("after_center_lat"))})
        return left.join(right, [*_PAIR, "cx", "cy"]).where(
            _centre_distance() < max_distance).drop("cx", "cy")

    return join(before.where(~_has_box("before")), after).unionByName(
        join(before.where(_has_box("before")), after.where(~_has_box("after"))))


def candidate_pairs(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """All tile pairs that match by overlap, grid position or centre, with match_score.

    The three rules are made exclusive, so their union needs no de-duplication.
    """
    # Scene pairs are few and read six times below.
    before, after = _sides(tiles, cut_lineage(pairs.select(*_PAIR)))
    boxes = _has_box("before") & _has_box("after")
    by_iou = pairs_by_iou(before, after)
    by_centre = pairs_by_centre(before, after)
    by_grid = pairs_by_grid(before, after).where(
        F.when(boxes, _iou() < 0.70).otherwise(_centre_distance() >= 0.001))
    iou = _iou()
    score = F.when(iou > 0.0, iou).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - _centre_distance() * 100))
    return by_iou.unionByName(by_grid).unionByName(by_centre).select(
        *_PAIR, "before_tile", "after_tile", iou.alias("iou"), score.alias("match_score"))


def greedy_match(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs per scene pair, best score first (ties: lower ids).

    Rounds of mutual best: a pair that is the best of both its tiles is what the
    greedy order would take next, so all such pairs are taken at once and their
    tiles leave. It ends when nothing is left; each round is written to the
    checkpoint folder, so lineage stays short.
    """
    columns = [*_PAIR, "before_tile", "after_tile", "iou", "match_score"]
    place = F.struct((-F.col("match_score")).alias("s"), "before_tile", "after_tile")
    by_before = Window.partitionBy(*_PAIR, "before_tile")
    by_after = Window.partitionBy(*_PAIR, "after_tile")
    rest, taken = candidates.select(*columns), []
    while True:
        ranked = rest.withColumn("place", place).withColumn(
            "best_before", F.min("place").over(by_before)).withColumn(
            "best_after", F.min("place").over(by_after)).withColumn(
            "taken", (F.col("place") == F.col("best_before")) & (F.col("place") == F.col("best_after")))
        marked = ranked.withColumn("gone", F.max("taken").over(by_after)).withColumn(
            "gone", F.col("gone") | F.max("taken").over(by_before))
        state = cut_lineage(marked.select(*columns, "taken", "gone"))
        taken.append(state.where("taken").select(*columns))
        rest = state.where("not gone").select(*columns)
        if rest.isEmpty():
            break
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def matched_pairs(tiles: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One-to-one tile pairs over all scene pairs, past the quality gate, with a pair_id."""
    # What the joins below read many times is written once; a derived catalogue would be derived in each of them.
    needed = [*_GEOMETRY, "acquisition_date", "quality_score", "pixel_width", "pixel_height"]
    tiles = cut_lineage(tiles.select(*[c for c in needed if c in tiles.columns]))
    pairs = scene_pairs(tiles) if pairs is None else pairs
    matched = greedy_match(candidate_pairs(tiles, pairs))
    good = tiles.where(usable_quality(F.col("quality_score"))).select("tile_id")
    for name in ("before", "after"):
        matched = matched.join(good.withColumnRenamed("tile_id", f"{name}_tile"), f"{name}_tile", "left_semi")
    pair_id = F.sha2(F.concat_ws("|", F.col("before_tile"), F.col("after_tile")), 256)
    return matched.withColumn("pair_id", pair_id)


def pair_pixels(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels of both tiles of each pair, aligned on the earlier tile's raster.

    Pairs may carry sizes (before_width, before_height, after_width,
    after_height): where they differ, the later tile is read at the nearest
    pixel. A pair may carry shift_x and shift_y: the later tile is read that
    many pixels further, and as black outside.
    """
    has = lambda *names: all(n in pairs.columns for n in names)
    sized = has("before_width", "before_height", "after_width", "after_height")
    shifted = has("shift_x", "shift_y")
    extra = [c for c in ("before_width", "before_height", "after_width", "after_height",
                         "shift_x", "shift_y") if c in pairs.columns]
    facts = pairs.select("pair_id", F.col("before_tile").alias("tile_id"), *extra)
    first = beside(pixels, facts, "tile_id").withColumnsRenamed({"r": "r1", "g": "g1", "b": "b1"}).drop("tile_id")

    def at(axis: str, dim: str) -> Column:
        place = F.col(axis)
        if sized:
            place = F.floor((place + 0.5) * F.col(f"after_{dim}") / F.col(f"before_{dim}")).cast("int")
        return place + F.col(f"shift_{axis}") if shifted else place

    first = first.withColumns({"ay": at("y", "height"), "ax": at("x", "width")})
    second = beside(pixels, pairs.select("pair_id", F.col("after_tile").alias("tile_id")), "tile_id").select(
        "pair_id", F.col("y").alias("ay"), F.col("x").alias("ax"),
        F.col("r").alias("r2"), F.col("g").alias("g2"), F.col("b").alias("b2"))
    rows, tiles = pixels.agg(F.count("*"), F.approx_count_distinct("tile_id")).first()
    width = width_for(pixels.sparkSession, pairs.count() * rows / max(tiles, 1))
    later = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("r2", "g2", "b2")]
    if sized:
        # Neither side is broadcast or sorted: the later pixels of a task, a bounded number, are hashed.
        first, second = (side.repartition(width, "pair_id", "ay", "ax") for side in (first, second))
        joined = first.join(second.hint("shuffle_hash"), ["pair_id", "ay", "ax"], "left" if shifted else "inner")
        return joined.select("pair_id", "y", "x", "r1", "g1", "b1", *later)
    # A place holds one pixel of each side: both are grouped by it, clustered by the pair alone. So a tile's pixels
    # stay together in the shuffle, where they compress well, and what follows by pair needs no other.
    first = first.select("pair_id", "ay", "ax", "y", "x", "r1", "g1", "b1", F.lit(1).alias("one"))
    second = second.withColumn("two", F.lit(1))
    both = first.unionByName(second, allowMissingColumns=True).repartition(width, "pair_id")
    met = both.groupBy("pair_id", "ay", "ax").agg(*[
        F.max(c).alias(c) for c in ("y", "x", "r1", "g1", "b1", "r2", "g2", "b2", "one", "two")])
    met = met.where(F.col("one").isNotNull() if shifted else F.col("one").isNotNull() & F.col("two").isNotNull())
    return met.select("pair_id", "y", "x", "r1", "g1", "b1", *later)


def scene_names(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """Lower-case file names of both scenes of each pair."""
    side = lambda name: scenes.select(
        F.col("scene_id").alias(f"{name}_scene"),
        F.lower(F.coalesce("filename", F.lit(""))).alias(f"{name}_name"))
    return pairs.join(side("before"), "before_scene", "left").join(side("after"), "after_scene", "left")
