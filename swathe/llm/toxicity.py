"""Toxicity by Levenshtein automata over a trie of learned terms (operator 7).

The lexicon is learned: words that stand in toxic training texts far more often than in others. A
trie of its terms is walked with a Levenshtein automaton for every distinct word, which finds terms
within one edit (longer terms: two). A hit counts by its term's weight, its edits, and its context: inside
quotation marks, or beside words that report speech, it weighs less. The score is a logistic
function of the summed evidence, calibrated on the training texts.

Null and empty texts hold no terms and score the low base rate. Without toxic training labels the
lexicon is empty and every text scores that rate. Repeated rows score alike; a text of any length is
read whole, its evidence adds up.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.llm.common import fold, free_name, mapped, stored, texts

WORD = re.compile(r"[^\W\d_]+")
FIT_PER_CLASS = 4000      # labelled texts per class that the fit takes, the smallest by hash
MIN_LIFT = math.log(20)
BY_CHANCE = 0.5           # words that may be expected to become terms by chance co-occurrence, at any size
TWO_EDITS = 9             # letters from which two edits are allowed
ONE_EDIT = 5
QUOTED, REPORTED = 0.25, 0.5
SAYING = {"said", "says", "called", "quote", "quoted", "wrote", "word", "term", "slur"}
CONTEXT = 3
QUOTES = "\"“”„«»"


def chance_tails(held: int, n_bad: int, n_good: int) -> np.ndarray:
    """[b]: chance that at least ``b`` of a word's ``held`` texts are toxic if it fell on texts at random."""
    size = n_bad + n_good
    factorial = np.array([math.lgamma(i + 1) for i in range(size + 1)])
    b = np.arange(max(0, held - n_good), min(held, n_bad) + 1)
    ways = (factorial[n_bad] - factorial[b] - factorial[n_bad - b]
            + factorial[n_good] - factorial[held - b] - factorial[n_good - held + b]
            - factorial[size] + factorial[held] + factorial[size - held])
    tails = np.ones(min(held, n_bad) + 1)
    tails[b] = np.minimum(1.0, np.cumsum(np.exp(ways)[::-1])[::-1])
    return tails


def term_cells(cells: list[tuple[int, int, int]], n_bad: int, n_good: int) -> list[tuple[int, int, float]]:
    """``bad, good, lift`` of the counts whose words are terms, from ``bad, good, words`` of all counts.

    Of the counts that reach the lift, all up to the largest chance are taken at which at most
    ``BY_CHANCE`` words are expected if toxic labels fell at random. This asks no fixed number of texts.
    """
    held: dict[int, int] = {}
    for bad, good, words in cells:
        held[bad + good] = held.get(bad + good, 0) + words
    lift = lambda bad, good: np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    rare = {}
    for k in held:
        tails = chance_tails(k, n_bad, n_good)
        counts = np.arange(len(tails))
        rare[k] = np.where(lift(counts, np.maximum(k - counts, 0)) >= MIN_LIFT, tails, np.inf)
    chances = np.unique([rare[b + g][b] for b, g, _ in cells if rare[b + g][b] < np.inf])
    by_chance = np.zeros(len(chances))
    for k, words in held.items():
        steps = np.sort(rare[k][rare[k] < np.inf])
        place = np.searchsorted(steps, chances, "right")
        by_chance += words * np.where(place > 0, np.append(0.0, steps)[place], 0.0)
    most = max(chances[by_chance <= BY_CHANCE], default=-1.0)
    return [(b, g, float(lift(b, g))) for b, g, _ in cells if rare[b + g][b] <= most]


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Term -> weight (log ratio of document frequencies) from ``text, toxic``; every word that passes."""
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad:
        return {}
    words = F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))
    seen = labelled.select("toxic", F.explode(words).alias("word")).where("word <> ''")
    found = stored(seen.groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "words")
    cells = [tuple(r) for r in found.groupBy("bad", "good").count().collect()]
    lifts = {(b, g): lift for b, g, lift in term_cells(cells, n_bad, n_good)}
    if not lifts:
        return {}
    taken = labelled.sparkSession.createDataFrame(list(lifts), "bad long, good long")
    terms = found.join(F.broadcast(taken), ["bad", "good"]).collect()
    return {r["word"]: lifts[r["bad"], r["good"]] for r in sorted(terms, key=lambda r: r["word"])}


def allowed_edits(term: str) -> int:
    return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0


class LexiconTrie:
    """Terms as a trie per length; ``closest`` runs the Levenshtein automaton of a word down the branches
    of the lengths that its edits can reach."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.roots, self.cache = weights, {}, {}
        # Word length -> length of a stretch -> stretches of which a near word keeps one: k edits leave
        # one of k + 1 whole.
        self.heads, self.tails, self.inner = {}, {}, {}

        def keep(pieces: dict, size: int, piece: str) -> None:
            pieces.setdefault(size, {}).setdefault(len(piece), set()).add(piece)

        for term in weights:
            node = self.roots.setdefault(len(term), {})
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term
            edits = allowed_edits(term)
            cuts = [len(term) * i // (edits + 1) for i in range(edits + 2)]
            for size in range(len(term) - edits, len(term) + edits + 1) if edits else ():
                keep(self.heads, size, term[:cuts[1]])
                keep(self.tails, size, term[cuts[-2]:])
                for a, b in zip(cuts[1:-2], cuts[2:-1], strict=True):
                    keep(self.inner, size, term[a:b])

    def may_be_near(self, word: str) -> bool:
        size = len(word)
        return size in self.heads and (
            any(word[:n] in found for n, found in self.heads[size].items())
            or any(word[size - n:] in found for n, found in self.tails[size].items())
            or any(word[i:i + n] in found for n, found in self.inner.get(size, {}).items()
                   for i in range(size - n + 1)))

    def closest(self, word: str) -> tuple[str, int] | None:
        """(term, edits) with the fewest edits, ties to the first term; None if none is near."""
        if word in self.weights:
            return word, 0
        if len(word) < ONE_EDIT - 1:
            return None
        if word not in self.cache:
            if len(self.cache) > 1 << 18:
                self.cache.clear()
            self.cache[word] = self._walk(word) if self.may_be_near(word) else None
        return self.cache[word]

    def _walk(self, word: str) -> tuple[str, int] | None:
        """The automaton's states after some letters of a term are the bits of three numbers: how many
        letters of ``word`` can be matched with no, at most one, at most two edits."""
        size = len(word)
        last, states = 1 << size, (2 << size) - 1
        places: dict[str, int] = {}
        for i, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << i
        best: tuple[int, str] | None = None
        start = 1, 3 & states, 7 & states
        stack = []
        for length, root in self.roots.items():
            edits = allowed_edits("x" * length)
            if edits >= abs(length - size):
                stack.append((edits, root, *start))
        while stack:
            most, node, none, one, two = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    edits = 0 if none & last else 1 if one & last else 2 if two & last else 3
                    if edits <= most and (best is None or (edits, child) < best):
                        best = edits, child
                    continue
                here = places.get(letter, 0)
                to_none = (none & here) << 1
                to_one = ((one & here) << 1 | none | (none | to_none) << 1) & states
                to_two = ((two & here) << 1 | one | (one | to_one) << 1) & states
                if to_two if most == 2 else to_one if most else to_none:
                    stack.append((most, child, to_none, to_one, to_two))
        return (best[1], best[0]) if best else None

    def evidence(self, text: str) -> float:
        """Summed weight of the terms of a text, each by its edits and context."""
        if not self.weights:
            return 0.0
        lowered, total, quoted, at = text.lower(), 0.0, False, 0
        seen: list[str] = []
        for match in WORD.finditer(lowered):
            between = lowered[at:match.start()]
            for mark in between if between != " " else ():
                if mark in QUOTES:
                    quoted = not quoted
                elif mark == "\n":
                    quoted = False
            at, word = match.end(), match.group()
            hit = self.closest(word)
            if hit:
                share = QUOTED if quoted else REPORTED if SAYING.intersection(seen[-CONTEXT:]) else 1.0
                total += self.weights[hit[0]] * share * (1.0, 0.7, 0.5)[hit[1]]
            seen.append(word)
        return total


def calibrate(pairs: list[tuple[float, int]], steps: int = 60) -> tuple[float, float]:
    """(slope, offset) of a logistic curve over log(1 + evidence), by Newton steps with a ridge."""
    slope, offset = 1.0, -3.0
    for _ in range(steps):
        g = [0.02 * slope, 0.02 * offset]
        h = [0.02, 0.0, 0.02]
        for evidence, toxic in pairs:
            x = math.log1p(evidence)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + offset))))
            w = max(p * (1 - p), 1e-6)
            g[0] += (p - toxic) * x
            g[1] += p - toxic
            h[0] += w * x * x
            h[1] += w * x
            h[2] += w
        det = h[0] * h[2] - h[1] * h[1]
        step = (h[2] * g[0] - h[1] * g[1]) / det, (h[0] * g[1] - h[1] * g[0]) / det
        slope, offset = slope - max(-1, min(1, step[0])), offset - max(-1, min(1, step[1]))
    return max(slope, 0.0), offset


_TRIES: dict[int, LexiconTrie] = {}


def worker_trie(weights: dict[str, float]) -> LexiconTrie:
    """One trie, with the words it has looked up, per Python worker and lexicon."""
    key = hash(tuple(sorted(weights.items())))
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = LexiconTrie(weights)
    return _TRIES[key]


def _evidence(docs: DataFrame, weights: dict[str, float], *kept: str, name: str = "evidence") -> DataFrame:
    """``kept`` columns beside the evidence of each text (null: none)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def start():
        trie = worker_trie(shared.value)
        return lambda values: [[trie.evidence(t or "") for t in values]]
    return mapped(docs, list(kept), start, f"`{name}` double")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float, float]:
    """(lexicon, slope, offset), learned from two folds of three, and from at most ``FIT_PER_CLASS`` texts
    per class."""
    plain = texts(docs)
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(
        "doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = marks.where(fold(F.col("doc_id"), 3) != 1)
    picked = None
    for toxic in (0, 1):
        part = usable.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_PER_CLASS)
        picked = part if picked is None else picked.unionByName(part)
    train = plain.join(F.broadcast(picked), "doc_id").cache()
    try:
        weights = learn_lexicon(train.select("text", "toxic"))
        pairs = [(r["evidence"], r["toxic"]) for r in _evidence(train, weights, "toxic").collect()]
    finally:
        train.unpersist()
    return weights, *(calibrate(pairs) if pairs else (0.0, -3.0))


def _score(evidence: Column, slope: float, offset: float) -> Column:
    raw = 1 / (1 + F.exp(-(F.log1p(evidence) * slope + offset)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every text."""
    weights, slope, offset = fit(docs, labels)
    score = _score(F.col("evidence"), slope, offset)
    return _evidence(texts(docs), weights, "doc_id").select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"))


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, all columns kept, that are not predicted toxic. Every row is judged by its own text,
    also where ids are null or repeat."""
    weights, slope, offset = fit(docs, labels)
    name = free_name("evidence", docs.columns)
    judged = _evidence(docs, weights, *docs.columns, name=name)
    return judged.where(_score(F.col(name), slope, offset) < threshold).drop(name)
