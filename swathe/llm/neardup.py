"""Near-duplicate classes by DartMinHash (operator 5).

Each unit of an element's weight is a region into which hashed darts are thrown at rate one per unit
of rank. A text sees the darts inside its own weights up to a rank limit of t / weight; every
coordinate keeps its earliest dart, and the limit doubles until none is empty. Two texts agree in a
coordinate with the chance of their weighted Jaccard similarity. Weights are 1 per distinct shingle by
default (then it is the Jaccard similarity of sets), or counts.

Equal texts are collapsed first. Signatures are cut in bands. A band value with at most ``FEW`` holders
pairs them all. Of a crowded one, all holders meet its hub, the holder whose other band values are
shared most. Links are verified on exact shingle sets, and their components are the first classes.

What crowded band values still leave apart is found without pairing holders. All holders of one hub
share a reference text. A holder's residual is what the reference lacks; a pair of similar texts either
shares a residual shingle out of a prefix whose length follows from the overlap that is missing, or both
lie almost wholly in the reference. Holders with such a shingle in common meet in small groups, which
compare only members of different classes and give links alone. Groups beyond ``BLOCK`` are cut in blocks.

A shingle is five words (runs other than space and U+0009 to U+000D); a shorter text is one shingle.
Null, empty and blank texts and null ids are in no class but their own (a null id: class null). Rows that
repeat an id are one document, which is near whatever one of its texts is near. Repeated rows and equal
texts share a class. Texts of any length are taken whole. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.llm.common import mix, stored, texts, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 128
BAND_ROWS = 4
FEW = 4
BLOCK = 1024
# Chances of at most 0, 1, 2, ... darts in a cell of rate one.
POISSON = np.cumsum([1.0 / np.e / f for f in np.cumprod([1.0, *range(1, 16)])])


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype("float64") / float(1 << 53)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their counts."""
    codes = word_hashes(text)
    if not len(codes):
        return np.empty(0, "uint64"), np.empty(0, "int64")
    size = min(SHINGLE, len(codes))
    rolled = np.full(len(codes) - size + 1, size, "uint64")
    for k in range(size):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + len(rolled)])
    return np.unique(rolled, return_counts=True)


def darts(elements: np.ndarray, weights: np.ndarray, low: int, high: int):
    """(coordinate seed, rank, id) of the darts in the weight regions, for unit strips low..high of rank."""
    whole = np.ceil(weights).astype("int64")
    cell = np.repeat(elements, whole)
    layer = np.arange(len(cell)) - np.repeat(np.cumsum(whole) - whole, whole)
    limit = np.repeat(weights, whole) - layer
    cell = mix(cell + layer.astype("uint64") * np.uint64(0xD1B54A32D192ED03))
    strips = np.arange(low, high, dtype="uint64") * np.uint64(0x8CB92BA72F3D8DD7)
    cell = mix(cell[:, None] ^ strips[None, :]).ravel()
    limit = np.repeat(limit, high - low)
    strip = np.tile(np.arange(low, high), len(cell) // (high - low))
    thrown = np.searchsorted(POISSON, unit(cell))
    order = np.arange(thrown.sum()) - np.repeat(np.cumsum(thrown) - thrown, thrown)
    dart = mix(np.repeat(cell, thrown) + (order.astype("uint64") + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    inside = unit(mix(dart ^ np.uint64(0x5851F42D4C957F2D))) < np.repeat(limit, thrown)
    rank = np.repeat(strip, thrown) + unit(mix(dart ^ np.uint64(0x14057B7EF767814F)))
    return dart[inside], rank[inside]


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The id of the earliest dart of every coordinate."""
    best = np.zeros(k, "uint64")
    filled = np.zeros(k, bool)
    low, high = 0, max(1, int(np.ceil((k * np.log(k) + 2 * k) / weights.sum())))
    while True:
        dart, rank = darts(elements, weights, low, high)
        order = np.lexsort((dart, rank))
        dart = dart[order]
        coordinate = (mix(dart) % np.uint64(k)).astype("int64")
        found, first = np.unique(coordinate, return_index=True)
        new = ~filled[found]
        best[found[new]] = dart[first[new]]
        filled[found] = True
        if filled.all():
            return best
        low, high = high, 2 * high


def _sketches(weighted: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                elements, counts = shingles(text)
                if len(elements):
                    weights = counts.astype("float64") if weighted else np.ones(len(elements))
                    sign = signature(elements, weights)
                    bands = sign.reshape(-1, BAND_ROWS)
                    keys = np.zeros(len(bands), "uint64")
                    for j in range(BAND_ROWS):
                        keys = mix(keys ^ bands[:, j]) + np.uint64(j + 1)
                    rows.append((doc_id, keys.view("int64"), packed_set(elements, counts if weighted else None)))
            yield pd.DataFrame(rows, columns=["doc_id", "keys", "bag"])
    return run


def packed_set(elements: np.ndarray, counts: np.ndarray | None) -> bytes:
    """Sorted hashes of 32 bits; an element that counts k times stands for k of them, so that the weighted
    similarity of bags is the plain one of these sets."""
    if counts is not None:
        layer = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        elements = mix(np.repeat(elements, counts) + layer.astype("uint64") * np.uint64(0xD1B54A32D192ED03))
    return np.unique((elements >> np.uint64(32)).astype("<u4")).tobytes()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common entries of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    return int((b[np.minimum(place, len(b) - 1)] == a).sum()) if len(b) else 0


def least_overlap(at_least: float, size: int) -> int:
    """Entries that a set of this size shares with any set as similar as ``at_least``."""
    return math.ceil(at_least * size - 1e-9)


def similar(shared: int, size_a: int, size_b: int, at_least: float) -> bool:
    return shared >= at_least * (size_a + size_b - shared) - 1e-9


def _sets(packed) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4") for b in packed]


def _with_bags(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    one, two = (bags.select(F.col("doc_id").alias(name), F.col("bag").alias(f"bag_{name}")) for name in "ab")
    # Pairs grow with the corpus, so they are merged with the sets at every size and never broadcast.
    return pairs.hint("merge").join(one, "a").hint("merge").join(two, "b")


def _verified(pairs: DataFrame, bags: DataFrame, at_least: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            close = [min(len(a), len(b)) >= at_least * max(len(a), len(b)) - 1e-9
                     and similar(overlap(a, b), len(a), len(b), at_least)
                     for a, b in zip(_sets(batch["bag_a"]), _sets(batch["bag_b"]), strict=True)]
            yield batch.loc[close, ["a", "b"]]
    return _with_bags(pairs, bags).select("a", "b", "bag_a", "bag_b").mapInPandas(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``doc_id, class_id`` (smallest id) of every end of a link, in O(log n) rounds of joins.

    Each round points all neighbours of a node and the node itself to the smallest of them, first
    among larger neighbours and then among smaller ones, until nothing moves.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(
            "u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            least.select("u", F.col("low").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "small")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    members = edges.groupBy("u").agg(F.min("v").alias("v"))
    roots = members.select(F.col("v").alias("doc_id"), F.col("v").alias("class_id"))
    return members.select(F.col("u").alias("doc_id"), F.col("v").alias("class_id")).unionByName(roots).distinct()


def _first_pairs(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of the first round, and ``hub, hub_pop, doc_id`` of the crowded band values."""
    buckets = sketch.select("doc_id", F.posexplode("keys").alias("band", "key")).distinct()
    sized = buckets.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = stored(buckets.join(sized, ["band", "key"]), "buckets")
    few = held.where(F.col("n") <= FEW).groupBy("band", "key").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    pairs = few.select(F.posexplode("ids").alias("i", "a"), "ids").select(
        "a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    popularity = held.groupBy("doc_id").agg(F.sum("n").alias("pop"))
    many = held.where(F.col("n") > FEW).join(popularity, "doc_id")
    first = F.min(F.struct((-F.col("pop")).alias("less"), "doc_id")).alias("first")
    hubs = many.groupBy("band", "key").agg(first).select(
        "band", "key", F.col("first.doc_id").alias("hub"), (-F.col("first.less")).alias("hub_pop"))
    stars = stored(many.join(hubs, ["band", "key"]).select("hub", "hub_pop", "doc_id").distinct(), "stars")
    spokes = stars.select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b"))
    return pairs.unionByName(spokes).where("a <> b").distinct(), stars


def _residual_links(stars: DataFrame, classes: DataFrame, bags: DataFrame, at_least: float) -> DataFrame:
    """Links between holders of crowded band values that are in different classes so far."""
    best = F.min(F.struct((-F.col("hub_pop")).alias("less"), "hub")).alias("best")
    reference = stars.groupBy("doc_id").agg(best).select(F.col("doc_id").alias("hub"), F.col("best.hub").alias("ref"))
    members = stars.join(reference, "hub").select("ref", "doc_id").distinct().join(classes, "doc_id", "left").select(
        "ref", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    mixed = members.groupBy("ref").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low <> high")
    members = stored(members.join(mixed.select("ref"), "ref"), "members")

    def residuals(batches):
        for batch in batches:
            rows = []
            for ref, doc, own, base in zip(batch["b"], batch["a"], *map(_sets, (batch["bag_a"], batch["bag_b"])), strict=True):
                place = np.minimum(np.searchsorted(base, own), len(base) - 1)
                rest = own[base[place] != own]
                need = least_overlap(at_least, len(own)) - (len(own) - len(rest))
                # -1 is no shingle: the group of those that may be near another inside the reference.
                keys = [-1, *rest.tolist()] if need <= 0 else rest[:max(0, len(rest) - need + 1)].tolist()
                rows.append((ref, doc, keys))
            yield pd.DataFrame(rows, columns=["ref", "doc_id", "keys"])
    pairs = members.select(F.col("doc_id").alias("a"), F.col("ref").alias("b"))
    listed = _with_bags(pairs, bags).select("a", "b", "bag_a", "bag_b").mapInPandas(
        residuals, "ref long, doc_id long, keys array<long>")
    shared = listed.select("ref", "doc_id", F.explode("keys").alias("shingle")).distinct().join(
        members, ["ref", "doc_id"])
    groups = shared.groupBy("ref", "shingle").agg(
        F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.count("*").alias("n")).where(
        "low <> high").select("ref", "shingle", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = shared.join(groups, ["ref", "shingle"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    met = stored(met.select("ref", "shingle", "low", "high", "own", "doc_id", "class_id"), "met")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        low, high = int(group["low"].iloc[0]), int(group["high"].iloc[0])
        return links_between(group["doc_id"].to_numpy(), group["class_id"].to_numpy(), _sets(group["bag"]), at_least,
                             None if low == high else group["own"].to_numpy())
    return met.hint("merge").join(bags, "doc_id").groupBy("ref", "shingle", "low", "high").applyInPandas(
        compare, "a long, b long").distinct()


def links_between(ids: np.ndarray, classes: np.ndarray, sets: list[np.ndarray], at_least: float,
                  side: np.ndarray | None = None) -> pd.DataFrame:
    """Links that join different classes, one for each pair of classes that belongs together; with ``side``,
    members of the same side are not compared."""
    found = []
    sizes = np.array([len(s) for s in sets])
    joined = np.concatenate(sets) if sets else np.empty(0, "<u4")
    starts = np.cumsum(sizes) - sizes
    classes = classes.copy()
    for i in range(len(sets)):
        other = (classes != classes[i]) & (np.minimum(sizes, sizes[i]) >= at_least * np.maximum(sizes, sizes[i]) - 1e-9)
        other[:i + 1] = False
        if side is not None:
            other &= side != side[i]
        if not other.any():
            continue
        place = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
        shared = np.add.reduceat((sets[i][place] == joined).astype("int64"), starts)
        close = other & (shared >= at_least * (sizes + sizes[i] - shared) - 1e-9)
        for j in np.flatnonzero(close):
            if classes[j] != classes[i]:
                found.append((ids[i], ids[j]))
                classes[classes == classes[j]] = classes[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, at_least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """``doc_id, class_id``, one row per document; the class is its smallest id."""
    keyed = texts(docs).select("doc_id", "text", F.sha2("text", 256).alias("copy"))
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    owner = F.when(blank | F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = keyed.withColumn("copy", F.coalesce(owner, "copy"))
    first = stored(keyed.groupBy("copy").agg(F.min("doc_id").alias("rep")), "copies")
    reps = first.select(F.col("rep").alias("doc_id")).where("doc_id is not null").distinct()
    alone = keyed.where("doc_id is not null").select("doc_id", "text").join(reps, "doc_id", "left_semi")
    sketch = stored(alone.mapInPandas(_sketches(weighted), "doc_id long, keys array<long>, bag binary"), "sketches")
    pairs, stars = _first_pairs(sketch)
    pairs = stored(pairs, "pairs")
    # Only texts with a candidate are compared: all sets are shuffled once, later joins move those few.
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    bags = stored(sketch.select("doc_id", "bag").join(ends.hint("merge"), "doc_id", "left_semi"), "bags")
    links = _verified(pairs, bags, at_least)
    # Rows that repeat an id with another text tie that text's class to their own.
    tied = keyed.where("doc_id is not null").join(first, "copy").where("doc_id <> rep").join(
        reps, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = stored(links.unionByName(tied), "verified")
    classes = stored(components(links), "classes")
    more = stored(_residual_links(stars, classes, bags, at_least), "verified")
    if not more.isEmpty():
        classes = stored(components(links.unionByName(more)), "classes")
    final = first.join(classes, first["rep"] == classes["doc_id"], "left").select(
        "copy", F.coalesce("class_id", "rep").alias("class_id"))
    return keyed.select("doc_id", "copy").join(final, "copy").select("doc_id", "class_id")


def keep_first(docs: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """The documents, all columns kept, that are the smallest id of their class. Null ids stay, and rows
    that repeat an id stay or go together."""
    classes = near_duplicates(docs, at_least)
    gone = stored(classes.where("doc_id <> class_id").select("doc_id").distinct(), "copies_gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
