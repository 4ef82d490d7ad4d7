"""Parsing of whole query logs into typed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe import lexicon as lx
from swathe.functions import text as tx
from swathe.functions.geometry import box_wkt
from swathe.operators.spelling import correct_queries


def by_text(log: DataFrame, column: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``log`` with the columns that ``build`` adds to its distinct texts.

    People ask the same over and over, and reading a text costs far more than a join. ``build`` gets the texts alone,
    as ``column`` and, since they are distinct, as ``query_id``.
    """
    built = build(log.select(column).distinct().withColumn("query_id", F.col(column)))
    new = [c for c in built.columns if c not in log.columns]
    facts = built.select(F.col(column).alias("_text"), *new).hint("shuffle_hash")
    return log.join(facts, F.col(column).eqNullSafe(F.col("_text")), "left").select(*log.columns, *new)


def parse_corrected(log: DataFrame, places=lx.PLACES, fallback=lx.FALLBACK_BOXES) -> DataFrame:
    """Parse ``corrected_query``, each distinct text once."""
    return by_text(log, "corrected_query", lambda texts: _parse(texts, places, fallback))


def _parse(log: DataFrame, places=lx.PLACES, fallback=lx.FALLBACK_BOXES) -> DataFrame:
    """Parse ``corrected_query``. A chain of projections: nothing shuffles."""
    text = F.col("corrected_query")
    df = log.withColumns({
        "normalized_query": tx.normalize(text),
        "relationship": tx.relationship(text),
        "place": tx.resolve_place(text, places, fallback),
        **tx.temporal_bounds(text),
        **tx.quality_hints(text),
    })
    df = df.withColumn("tokens", tx.tokens_of(F.col("normalized_query")))
    tokens, anchor, relation = F.col("tokens"), F.col("time_anchor"), F.col("relationship")
    df = df.withColumn("is_change", tx.is_change_query(tokens, anchor, relation))
    target, concept = tx.target_concept(tokens, F.col("is_change"))
    df = df.withColumns({
        "intent": tx.intent(tokens, anchor, relation), "target": target, "concept": concept,
        **tx.landcover_needs(tokens, relation),
        "location": F.col("place.name"), "location_type": F.col("place.kind"),
        "location_west": F.col("place.west"), "location_south": F.col("place.south"),
        "location_east": F.col("place.east"), "location_north": F.col("place.north"),
    })
    return df.withColumns({
        "location_wkt": F.when(
            F.col("location").isNotNull(),
            box_wkt(F.col("location_west"), F.col("location_south"),
                    F.col("location_east"), F.col("location_north"))),
        "canonical_text": tx.canonical_text(
            F.col("normalized_query"), F.col("concept"), F.col("target"), relation,
            F.col("location")),
    }).drop("tokens", "is_change", "place")


def parse_queries(log: DataFrame, vocabulary_words=None, places=lx.PLACES) -> DataFrame:
    """One parsed row per (query_id, raw_query) row: spelling, then everything else."""
    return by_text(log, "raw_query", lambda texts: _parse(correct_queries(
        texts, vocabulary_words=vocabulary_words), places))


def merge_answers(parsed: DataFrame, answers: DataFrame) -> DataFrame:
    """Let valid stored answers (query_id, response) override parts of a parse.

    The answer decides the intent, a known concept, and a missing target or
    relation; place and dates stay with the rules. ``answers`` holds at most
    one row per query (the newest when it has ``answered_at``).
    """
    valid = answers.select("query_id", tx.parse_answer(F.col("response")).alias("answer")).where(
        F.col("answer").isNotNull())
    df = parsed.join(valid, "query_id", "left")
    answered = F.col("answer").isNotNull()
    first_concept = tx.slug(F.try_element_at(F.col("answer.concepts"), F.lit(1)))
    answer_intent = F.coalesce(F.col("answer.intent"), F.lit("semantic_search"))
    df = df.withColumns({
        "llm_used": answered,
        "intent": F.when(answered, F.when(answer_intent == "change_analysis", "change_search")
                         .otherwise("semantic_search")).otherwise(F.col("intent")),
        "concept": F.when(first_concept.isin(lx.KNOWN_CONCEPTS), first_concept).otherwise(
            F.col("concept")),
        "target": F.coalesce(F.col("target"), tx.slug(F.nullif(F.col("answer.target"), F.lit("")))),
        "relationship": F.coalesce(
            F.col("relationship"), F.try_element_at(F.col("answer.relationships"), F.lit(1))),
    })
    rebuilt = tx.canonical_text(F.col("normalized_query"), F.col("concept"), F.col("target"),
                                F.col("relationship"), F.col("location"))
    return df.withColumn(
        "canonical_text", F.when(answered, rebuilt).otherwise(F.col("canonical_text"))
    ).drop("answer")
