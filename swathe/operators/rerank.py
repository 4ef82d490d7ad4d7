"""Hybrid rerank: land cover, names and cosine folded into one score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathe import lexicon as lx
from swathe.functions.numbers import clip, round_even
from swathe.functions.text import contains_any, tokens_of, word_set


def _gain(base: float, most: float, amount: Column) -> Column:
    return F.least(F.lit(most), amount) + base


def spectral_match(intent, water: Column, veg: Column, urban: Column, scene_name: Column) -> Column:
    """How well a tile's land cover suits a query's intent, 0..1; .50 without a demand.

    ``intent`` maps flag names to boolean columns (a dict or a struct column).
    """
    name = F.lower(F.coalesce(scene_name, F.lit("")))
    says = lambda *words: contains_any(name, words)
    i = lambda flag: intent[flag]

    balance = F.least(water, veg, urban) / F.greatest(water, veg, urban, F.lit(1.0))
    three = (
        F.when((water >= 2.0) & (veg >= 5.0) & (urban >= 10.0), _gain(0.93, 0.05, balance * 0.10))
        .when((water >= 1.0) & ((veg >= 5.0) | (urban >= 15.0)), 0.78)
        .when(water < 1.0, 0.15).otherwise(0.40))
    two = (
        F.when((water >= 8.0) & (veg >= 8.0), _gain(0.93, 0.05, (water + veg) / 2000.0))
        .when((water >= 4.0) & (veg >= 4.0), 0.85)
        .when(water < 1.0, 0.10).when(veg < 3.0, 0.30).otherwise(0.60))
    pure_water = (
        F.when(water >= 20.0, _gain(0.90, 0.08, (water - 20.0) / 1000.0))
        .when(water >= 10.0, 0.80).when(water >= 3.0, 0.60).when(water >= 1.0, 0.35).otherwise(0.05))

    def built(from_pct: float, name_hit: Column, bonus: float) -> Column:
        score = _gain(0.88, 0.06, (urban - from_pct) / 500.0)
        return F.when(name_hit, F.least(F.lit(0.98), score + bonus)).otherwise(score)

    site = (
        F.when((water < 2.0) & (urban >= 65.0), built(65.0, says("jewar", "airport", "construction"), 0.08))
        .when((water < 2.0) & (urban >= 40.0), 0.72).otherwise(0.25))
    industrial = (
        F.when(says("pangong", "ladakh") | i("is_mountain"), 0.15)
        .when((urban >= 70.0) & (veg < 20.0),
              built(70.0, says("dam", "sardar", "jewar", "airport", "perambur"), 0.06))
        .when(urban >= 40.0, 0.68).otherwise(0.20))
    remote = says("pangong", "ladakh", "mountain") | i("is_mountain")
    residential = (
        F.when(remote, 0.08)
        .when(urban >= 60.0, built(60.0, says("perambur", "chennai", "city"), 0.06))
        .when(urban >= 30.0, 0.65).otherwise(0.25))
    solar = (F.when(says("solar"), 0.94).when((urban >= 80.0) & (veg < 15.0), 0.72).otherwise(0.20))
    aviation = (F.when(says("airport", "airfield"), 0.94)
                .when((urban >= 60.0) & (veg < 20.0), 0.78).otherwise(0.20))
    green = (F.when(veg >= 30.0, 0.88).when(veg >= 15.0, 0.75).when(veg >= 5.0, 0.55).otherwise(0.15))
    town = (F.when(remote, 0.12).when(urban >= 60.0, 0.85).when(urban >= 30.0, 0.70).otherwise(0.30))

    return (
        F.when(i("requires_water") & i("requires_vegetation") & (i("composite_count") >= 3), three)
        .when(i("requires_water") & i("requires_vegetation"), two)
        .when(i("pure_water"), pure_water)
        .when(i("is_construction_site"), site)
        .when(i("is_industrial"), industrial)
        .when(i("is_residential") | (i("requires_urban") & i("is_road")), residential)
        .when(i("is_solar"), solar)
        .when(i("is_aviation"), aviation)
        .when(i("requires_vegetation") & ~i("requires_water") & ~i("requires_urban"), green)
        .when(i("requires_urban"), town)
        .otherwise(0.50))


def _lexical_words(text: Column, marks: str) -> Column:
    return F.array_except(tokens_of(F.regexp_replace(F.lower(text), marks, " ")), word_set(lx.LEXICAL_STOPS))


def query_words(query: Column) -> Column:
    """The distinct words of a query that may stand in the name of a scene."""
    return _lexical_words(query, r"[_\-,]")


def scene_words(scene_name: Column) -> Column:
    """The distinct words in the name of a scene."""
    return _lexical_words(scene_name, r"[_\-.]")


def shared_word_boost(asked: Column, named: Column) -> Column:
    """.11 for each word that both arrays hold, at most .22."""
    shared = F.size(F.array_intersect(asked, named))
    return F.coalesce(F.least(F.lit(0.22), F.greatest(shared, F.lit(0)) * 0.11), F.lit(0.0))


def lexical_boost(query: Column, scene_name: Column) -> Column:
    """.11 for each word the query shares with the scene name, at most .22."""
    return shared_word_boost(query_words(query), scene_words(scene_name))


def semantic_adjustment(similarity: Column) -> Column:
    """A tie-breaker of at most .04 either way from the narrow band cosines fall in."""
    return (clip((similarity + 0.035) / 0.05, 0.0, 1.0) - 0.5) * 0.08


def fused_score(spectral: Column, lexical: Column, semantic: Column, pure_water: Column, water: Column) -> Column:
    """Sum of the parts within .05..0.99; a dry tile cannot win a pure water query."""
    total = spectral + lexical + semantic
    total = F.when(pure_water & (water < 1.0), F.least(total, F.lit(0.08))).otherwise(total)
    return clip(total, 0.05, 0.99)


def score_candidates(candidates: DataFrame) -> DataFrame:
    """Add the score parts. Needs score, land cover, filename, a struct ``intent_flags``, and query_text or, read
    before, the arrays query_words and scene_words."""
    intent = F.col("intent_flags")
    lexical = (
        shared_word_boost(F.col("query_words"), F.col("scene_words")) if "query_words" in candidates.columns
        else lexical_boost(F.col("query_text"), F.col("filename")))
    water, veg, urban = F.col("water_pct"), F.col("veg_pct"), F.col("urban_pct")
    df = candidates.withColumns({
        "spectral_match": spectral_match(intent, water, veg, urban, F.col("filename")),
        "lexical_boost": lexical,
        "semantic_adjustment": semantic_adjustment(F.col("score")),
    })
    fused = fused_score(F.col("spectral_match"), F.col("lexical_boost"), F.col("semantic_adjustment"),
                        intent["pure_water"], water)
    return df.withColumn("fused", fused).withColumns({
        "display_score": round_even(F.col("fused"), 4),
        "order_score": round_even(F.col("fused") - 0.5, 4)})


def rerank(scored: DataFrame, k: int) -> DataFrame:
    """The k best per query by fused score. Candidates per query are bounded by the fetch limit."""
    order = Window.partitionBy("query_id").orderBy(F.desc("order_score"), "tile_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def result_rows(ranked: DataFrame) -> DataFrame:
    """Rows as shown to a user: outline, centre, box, provenance and links.

    Catalogue values come first, the stored payload (p_*) fills gaps.
    """
    either = lambda name: F.coalesce(F.col(name), F.col(f"p_{name}")) if f"p_{name}" in ranked.columns else F.col(name)
    w, s, e, n = (F.col(f"bbox_{side}") for side in ("west", "south", "east", "north"))
    ring = F.array(*[F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    outline = F.when(w.isNotNull(), F.to_json(F.struct(
        F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))
    link = lambda tail: F.format_string(f"/api/tiles/%s/{tail}", F.col("tile_id").cast("string"))
    return ranked.withColumns({
        "footprint": outline, "center_lon": either("center_lon"), "center_lat": either("center_lat"),
        "thumbnail_url": link("thumbnail"), "preview_url": link("preview"),
    })
