"""Spelling correction of query logs by joins on distinct words.

Words are made distinct first, so work grows with the vocabulary of the log and
not with its length, and no word's popularity can make a task hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathe import lexicon as lx
from swathe.functions import text as tx
from swathe.functions.vectors import let
from swathe.session import shuffle_width


def vocabulary_frame(spark: SparkSession, words: list[str] | None = None) -> DataFrame:
    """(candidate, weight) rows of a spelling vocabulary."""
    words = lx.spelling_vocabulary() if words is None else words
    rows = [(w, lx.SPELLING_WEIGHTS.get(w, 1.0)) for w in words]
    return spark.createDataFrame(rows, "candidate string, weight double")


def _swaps(word: Column) -> Column:
    """All words one adjacent swap away."""
    spots = F.when(F.length(word) >= 2, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)),
        F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.length(word))))


def edit_distance_upto2(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance when it is at most 2, else a value above 2.

    A script of at most two edits holds no swap (plain Levenshtein), one swap
    at either end of it, or two swaps; each case is tried with built-ins.
    """
    far = F.lit(3)
    plain = F.levenshtein(a, b)
    swap_first = F.array_min(F.transform(_swaps(a), lambda s: F.levenshtein(s, b))) + 1
    swap_last = F.array_min(F.transform(_swaps(b), lambda s: F.levenshtein(a, s))) + 1
    both = F.when(F.arrays_overlap(_swaps(a), _swaps(b)), 2)
    near = F.least(plain, F.coalesce(swap_first, far), F.coalesce(swap_last, far),
                   F.coalesce(both, far))
    # Two edits change the Levenshtein distance by at most four.
    return F.when(plain <= 1, plain).when(plain > 4, far).otherwise(F.least(near, far))


def _drop_one(words: Column) -> Column:
    """Each word with one character removed, for every position."""
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 0, F.transform(
        F.sequence(F.lit(1), F.length(w)),
        lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))),
    )).otherwise(F.array().cast("array<string>"))))


def deletion_keys(word: Column) -> Column:
    """The word with up to two characters removed.

    Two words within two edits share such a key, since every edit can be undone
    by dropping at most one character on each side.
    """
    once = F.array_distinct(_drop_one(F.array(word)))
    return let(once, lambda one: F.array_distinct(F.concat(F.array(word), one, _drop_one(one))))


def letter_mask(word: Column) -> Column:
    """A bit per character class of the word; one edit changes at most two bits."""
    return F.aggregate(
        F.split(word, ""), F.lit(0).cast("long"),
        lambda mask, c: mask.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 63)))


# Up to this many words, meeting every word of a near length costs less than making keys.
SMALL_VOCABULARY = 5000


def _pairs_by_length(tokens: DataFrame, vocabulary: DataFrame, max_distance: int) -> DataFrame:
    """Pairs of near length whose letters differ by few; for vocabularies of checked small size."""
    lengths = F.sequence(F.length("token") - max_distance, F.length("token") + max_distance)
    left = tokens.withColumn("mask", letter_mask(F.col("token"))).withColumn("size", F.explode(lengths))
    right = vocabulary.withColumns({
        "size": F.length("candidate"), "candidate_mask": letter_mask(F.col("candidate"))})
    differing = F.bit_count(F.col("mask").bitwiseXOR(F.col("candidate_mask")))
    # A swap costs two plain edits and changes no bit; any other edit costs one and changes two bits at most. So plain
    # edits and half the bits are together at most twice the distance, and few pairs are left to measure exactly.
    return left.join(F.broadcast(right), "size").where(
        (differing <= 2 * max_distance)
        & (2 * F.levenshtein("token", "candidate") + differing <= 4 * max_distance)
    ).select("token", "candidate", "weight")


def _pairs_by_deletions(tokens: DataFrame, vocabulary: DataFrame, max_distance: int) -> DataFrame:
    """Pairs that share a deletion key; for vocabularies of any size."""
    # The keys are never empty, and explode_outer keeps Spark from testing that.
    left = tokens.withColumn("key", F.explode_outer(deletion_keys(F.col("token"))))
    right = vocabulary.select(
        "candidate", "weight", F.explode_outer(deletion_keys(F.col("candidate"))).alias("key"))
    size_gap = F.abs(F.length("token") - F.length("candidate")) <= max_distance
    return left.join(right, "key").where(size_gap).select("token", "candidate", "weight").distinct()


def damerau_levenshtein_join(
    tokens: DataFrame, vocabulary: DataFrame, max_distance: int = 2,
    small_vocabulary: int = SMALL_VOCABULARY,
) -> DataFrame:
    """(token, candidate, weight, distance) for all pairs within ``max_distance`` (1 or 2).

    Equality joins find the candidates, on length for a vocabulary of measured
    small size and on deletion keys beyond it; the exact distance is computed on
    the survivors only.
    """
    if max_distance not in (1, 2):
        raise ValueError("max_distance must be 1 or 2")
    size, longest = vocabulary.agg(F.count("*"), F.max(F.length("candidate"))).first()
    # A longer token matches nothing. The distinct words are few bytes but much
    # work each, so they are spread over all cores.
    distinct = tokens.select("token").distinct().where(
        F.length("token") <= (longest or 0) + max_distance
    ).repartition(shuffle_width(tokens.sparkSession))
    find = _pairs_by_length if size <= small_vocabulary else _pairs_by_deletions
    pairs = find(distinct, vocabulary, max_distance)
    return pairs.withColumn(
        "distance", edit_distance_upto2(F.col("token"), F.col("candidate"))
    ).where(F.col("distance") <= max_distance)


def needs_lookup(token: Column, vocabulary_words: list[str]) -> Column:
    """Words worth a fuzzy search: not numeric, unknown, four letters or more."""
    return (
        ~token.rlike(r"^[\d.\-]+$") & ~token.isin(vocabulary_words) & (F.length(token) >= 4)
    )


def correct_tokens(
    tokens: DataFrame,
    vocabulary_words: list[str] | None = None,
    confusables: dict[str, str] = lx.CONFUSABLES,
) -> DataFrame:
    """(token, corrected, confidence, distance) of the distinct tokens that change.

    ``token`` is lower case. Confusables win over everything; other words take
    the best-scoring candidate (ties: first in the alphabet).
    """
    spark = tokens.sparkSession
    words = lx.spelling_vocabulary() if vocabulary_words is None else vocabulary_words
    distinct = tokens.select("token").where(F.length("token") > 0).distinct()
    fixed = F.create_map(*[F.lit(x) for pair in confusables.items() for x in pair])
    swapped = (
        distinct.where(F.col("token").isin(list(confusables)))
        .withColumn("corrected", F.element_at(fixed, F.col("token")))
        .select("token", "corrected", F.lit(0.96).alias("confidence"),
                edit_distance_upto2(F.col("token"), F.col("corrected")).alias("distance"))
    )
    unknown = distinct.where(
        needs_lookup(F.col("token"), words) & ~F.col("token").isin(list(confusables)))
    pairs = damerau_levenshtein_join(unknown, vocabulary_frame(spark, words), 2)
    token, candidate, distance = F.col("token"), F.col("candidate"), F.col("distance")
    same_start = F.substring(token, 1, 1) == F.substring(candidate, 1, 1)
    allowed = F.when(F.length(token) >= 5, 2).otherwise(1)
    longest = F.greatest(F.length(token), F.length(candidate))
    score = (F.lit(1.0) - distance / longest + F.when(same_start, 0.10).otherwise(0.0)) * F.col("weight")
    scored = pairs.where(
        (distance <= allowed) & ((distance < 2) | same_start)
        & (F.abs(F.length(token) - F.length(candidate)) <= allowed)
    ).withColumn("score", score)
    # min over (-score, candidate): best score, then alphabet. Partially aggregated.
    best = scored.groupBy("token").agg(
        F.min(F.struct((-F.col("score")).alias("rank"), "candidate", "distance")).alias("best"))
    guess = F.col("best.candidate")
    confidence = (
        F.when(F.col("best.distance") == 1, 0.95).otherwise(0.80)
        + F.when(F.substring(guess, 1, 1) == F.substring(token, 1, 1), 0.03).otherwise(0.0)
    )
    fuzzy = best.select(
        "token", guess.alias("corrected"), F.round(confidence, 2).alias("confidence"),
        F.col("best.distance").alias("distance"))
    return swapped.unionByName(fuzzy)


_OUTER = r"(?U)^[^\w]+|[^\w]+$"


def core_word(token: Column) -> Column:
    return F.regexp_replace(token, _OUTER, "")


def correct_queries(
    log: DataFrame,
    text_col: str = "raw_query",
    vocabulary_words: list[str] | None = None,
    confusables: dict[str, str] = lx.CONFUSABLES,
    salts: int = 16,
) -> DataFrame:
    """Add ``corrected_query``, ``corrections``, ``is_corrected`` and ``did_you_mean``.

    ``query_id`` must be unique. Only rows with a doubtful word leave their
    place: they meet the correction table on a salted word, so one typo that
    fills the log is spread over ``salts`` tasks, and come back by query id.
    """
    words = lx.spelling_vocabulary() if vocabulary_words is None else vocabulary_words
    tokens = F.filter(F.split(squeeze_edges(F.col(text_col)), " "), lambda w: w != "")
    log = log.withColumn("_tokens", tokens)
    doubtful = F.array_distinct(F.filter(
        F.transform(F.col("_tokens"), lambda w: F.lower(core_word(w))),
        lambda w: w.isin(list(confusables)) | needs_lookup(w, words)))
    asked = log.select("query_id", F.explode(doubtful).alias("token"))
    fixes = correct_tokens(asked, words, confusables)
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)))
    copies = fixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn(
        "salt", F.col("salt").cast("long"))
    per_query = salted.join(copies, ["token", "salt"]).groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "token", F.struct("corrected", "confidence", "distance")))).alias("_fixes"))
    out = log.join(per_query, "query_id", "left")
    fix_of = lambda w: F.element_at(F.col("_fixes"), F.lower(core_word(w)))

    def rewrite(w: Column) -> Column:
        core = core_word(w)
        start = F.instr(w, core)
        head = F.substring(w, F.lit(1), start - 1)
        tail = F.substring(w, start + F.length(core), F.length(w))
        return F.when(fix_of(w).isNull(), w).otherwise(
            F.concat(head, fix_of(w)["corrected"], tail))

    corrections = F.transform(
        F.filter(F.col("_tokens"), lambda w: fix_of(w).isNotNull()),
        lambda w: F.struct(
            core_word(w).alias("original_word"), fix_of(w)["corrected"].alias("corrected_word"),
            fix_of(w)["confidence"].alias("confidence"),
            fix_of(w)["distance"].alias("edit_distance")))
    fixed = F.col("_fixes").isNotNull()
    out = out.withColumns({
        "is_corrected": fixed,
        "corrected_query": F.when(
            fixed, F.array_join(F.transform(F.col("_tokens"), rewrite), " ")
        ).otherwise(squeeze_edges(F.col(text_col), inner=False)),
        "corrections": F.when(fixed, corrections).otherwise(F.array().cast(
            "array<struct<original_word:string,corrected_word:string,confidence:double,edit_distance:int>>")),
    })
    suggestion = F.concat(F.lit("Did you mean: "), proper_case(F.col("corrected_query")), F.lit("?"))
    return out.withColumn("did_you_mean", F.when(fixed, suggestion)).drop("_tokens", "_fixes")


def squeeze_edges(text: Column, inner: bool = True) -> Column:
    """Strip white space at the ends; with ``inner`` collapse it inside too."""
    if inner:
        return tx.squeeze(text)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def proper_case(text: Column, names: list[str] = lx.PROPER_NAMES) -> Column:
    """Capitalise known names word by word."""

    def shown(w: Column) -> Column:
        plain = F.regexp_replace(F.lower(w), r"(?U)[^\w]", "")
        return F.when(plain.isin(names), F.replace(w, plain, F.initcap(plain))).otherwise(w)

    return F.array_join(F.transform(tx.tokens_of(text), shown), " ")
