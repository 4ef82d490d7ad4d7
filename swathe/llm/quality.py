"""Quality rules as a short-circuit cascade (operator 8), in DataFrame functions only.

Each rule is a boolean column that is true where a text is rejected. On a small sample every rule is
timed and its share of rejections counted; rules then run in the order of rejections per second, and
a text stops at the first that rejects it. The order changes the time, never the verdict.

A null or empty text has no words and fails the base rule; repeated rows are judged alike.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.llm.common import SPACES, let, texts, words_column

WINDOW = 5
SAMPLE_ROWS = 512


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice in the text."""
    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.when(
            i + 1 < F.size(starts), F.least(F.get(starts, i + 1) - p, F.lit(window))).otherwise(window))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def starts_of(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return let(ordered, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda e, k: (F.get(s, k - 1)["g"] == e["g"]).eqNullSafe(True)
                     | (F.get(s, k + 1)["g"] == e["g"]).eqNullSafe(True)),
            lambda e: e["i"])))

    def of_words(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - window + 1),
                            lambda i: F.array_join(F.slice(w, i, window), " "))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(grams, lambda g: F.when(
            F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(starts_of(g), covered))))
    return let(words, of_words).cast("long")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return texts(docs).select(
        "doc_id",
        F.size(words_column(text)).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
        repeated_words(words_column(text)).alias("n_repeat_words"),
        "text")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The method's own rules; true rejects."""
    text = F.col("text")
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "short_words": F.col("word_chars") < 2 * F.col("n_words"),
        "long_words": F.col("word_chars") > 20 * F.col("n_words"),
        "duplicate_lines": 10 * F.col("n_dup_lines") > 3 * (F.length(text) - F.length(
            F.replace(text, F.lit("\n"), F.lit(""))) + 1),
        "no_letters": F.length(F.regexp_replace(text, "[^\\p{L}]+", "")) * 2 < F.col("word_chars"),
    }


def order_rules(sample: DataFrame, checks: dict[str, Column]) -> list[str]:
    """Names by rejected rows per second on the sample, best first; ties by name."""
    sample = sample.cache()
    try:
        sample.count()
        gain = {}
        for name, check in checks.items():
            start = time.perf_counter()
            rejected = sample.agg(F.sum(F.coalesce(check, F.lit(False)).cast("int")).alias("n")).first()["n"]
            gain[name] = (rejected or 0) / (time.perf_counter() - start)
    finally:
        sample.unpersist()
    return sorted(checks, key=lambda name: (-gain[name], name))


def cascade(measured: DataFrame, checks: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> Column:
    """True where no rule rejects. CASE stops at the first rule that does."""
    verdict = None
    for name in order_rules(measured.limit(sample_rows), checks):
        hit = F.coalesce(checks[name], F.lit(False))
        verdict = F.when(hit, False) if verdict is None else verdict.when(hit, False)
    return verdict.otherwise(True)


def judge(docs: DataFrame) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every text."""
    measured = measures(docs)
    kept = cascade(measured, rules())
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        F.when(base_failed(), False).otherwise(kept).alias("kept"))
