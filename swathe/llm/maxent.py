"""Hashed maximum-entropy language model (operator 3).

A word's chance is that of its class given the two words before it, times the word's share of its
class. Classes are the most frequent words, one each, and hashed groups of the rest. Class weights
stand in a table that hashed features index (bias, previous word, previous two, the word before the
previous): 65,536 rows at least, from 268 million tokens on twice as many for every fourfold of tokens.
Shards of the training documents run gradient steps over all their text from the empty table, and Spark
averages what they changed. There are as many shards as partitions, fewer by as much as the table grows,
so the rows that they emit stay in proportion to the text.

Counts and classes come from all training documents. Words in at least one of ``HEAD`` tokens (so at
most ``HEAD`` of them) are broadcast, all others meet their counts in a join that no word can make hot.
A word not seen in training has the share of half a count. Null and empty texts are one end token.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.llm.common import fold, mix, split_words, stored, texts, words_column

CLASSES = 32
OWN = 15
HEAD = 10_000
LEAST_BITS = 16
UNITS = 1024              # weights travel as whole 1/1024, up to 32 either way
EMITTED = 8192
STEP = 2048
RATE = 0.3
END = ""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: str) -> list[str]:
    return [*split_words(text, lower=True), END]


def token_column(text: Column) -> Column:
    return F.array_append(words_column(F.translate(text, UPPER, LOWER)), END)


def feature_bits(n_tokens: int) -> int:
    """Bits of a table whose rows grow as the square root of the training tokens, ``LEAST_BITS`` at the least."""
    return max(LEAST_BITS, math.floor(math.log2(max(n_tokens, 1)) / 2) + 3)


def shard_count(partitions: int, bits: int) -> int:
    """Passes over the training texts: each emits a table at most, so as the table grows they get fewer and longer, and
    what they emit together stays in proportion to the partitions."""
    return max(1, partitions >> (bits - LEAST_BITS))


def checksums(words: np.ndarray) -> np.ndarray:
    return np.array([*map(zlib.crc32, map(str.encode, words))], "uint64")


def classes_of(words: np.ndarray, own: dict[str, int], sums: np.ndarray | None = None) -> np.ndarray:
    """A class of its own for each word of ``own``; all others are dealt to the remaining classes by checksum, so that
    none is empty (each holds words not seen)."""
    sums = checksums(words) if sums is None else sums
    dealt = sums.astype("int64") % (CLASSES - len(own)) + len(own)
    single = np.array([*map(own.get, words)], "float64")
    return np.where(np.isnan(single), dealt, single).astype("int64")


class Batch:
    """Class and feature indexes of every token of some texts, one after another."""

    def __init__(self, docs: list[list[str]], own: dict[str, int], bits: int):
        sizes = np.array([len(d) for d in docs])
        self.ids, self.words = pd.factorize(np.array([w for d in docs for w in d], dtype=object))
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        sums = checksums(self.words)
        self.word_class = classes_of(self.words, own, sums)
        self.target = self.word_class[self.ids]
        code = mix(sums + np.uint64(1))[self.ids]
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        one = np.where(place >= 1, np.roll(code, 1), np.uint64(1))
        two = np.where(place >= 2, np.roll(code, 2), np.uint64(2))
        mult, drop = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
        rows = [one * mult, (one * np.uint64(3) ^ two) * mult, (two + np.uint64(0x632BE59BD9B4E019)) * mult]
        # The bias, row 0, is every token's and therefore not listed.
        self.features = np.stack([((r ^ (r >> np.uint64(29))) * mult >> drop).astype("int32") for r in rows])

    def log_chances(self, table: np.ndarray, part: slice) -> np.ndarray:
        logits = np.tile(table[0], (len(self.target[part]), 1))
        for rows in self.features[:, part]:
            logits += table.take(rows, axis=0)
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits

    def parts(self):
        return (slice(i, i + STEP) for i in range(0, len(self.target), STEP))


def train_batch(table: np.ndarray, squares: np.ndarray, batch: Batch) -> None:
    """Adaptive gradient steps over minibatches, in place."""
    for part in batch.parts():
        target = batch.target[part]
        error = np.exp(batch.log_chances(table, part))
        error[np.arange(len(target)), target] -= 1
        # Entries by feature and token in one sort; the bias follows apart, since it is every token's.
        entries = np.sort(batch.features[:, part].ravel().astype("int64") * STEP
                          + np.tile(np.arange(len(target)), len(batch.features)))
        rows = entries // STEP
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        counts = np.diff(np.append(starts, len(rows)))
        tokens_of = entries % STEP
        # Most features stand once in a step and need no sum.
        sums = error.take(tokens_of[starts], axis=0)
        many = counts > 1
        if many.any():
            held = error.take(tokens_of[np.repeat(many, counts)], axis=0)
            sums[many] = np.add.reduceat(held, np.cumsum(counts[many]) - counts[many], axis=0)
        step_rows(table, squares, rows[starts], sums, counts)
        step_rows(table, squares, np.zeros(1, "int64"), error.sum(axis=0, keepdims=True), np.array([len(target)]))


def step_rows(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """One adaptive step of distinct rows by their summed errors, in place."""
    gradient = sums * (1 / np.sqrt(counts)).astype("float32")[:, None]
    seen = squares.take(rows, axis=0)
    seen += gradient * gradient
    squares[rows] = seen
    gradient *= np.float32(-RATE)
    seen += 1
    gradient /= np.sqrt(seen)
    gradient += table.take(rows, axis=0)
    table[rows] = gradient


def groups(docs, size: int = 500_000):
    """Texts in groups of about ``size`` tokens."""
    held, total = [], 0
    for row in docs:
        held.append(row)
        total += len(row[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def train(docs: DataFrame, own: dict[str, int], bits: int) -> np.ndarray:
    """The table after each shard's pass over its texts, changes averaged over shards."""
    names = [f"c{i}" for i in range(CLASSES)]

    def run(batches):
        table, squares = (np.zeros((1 << bits, CLASSES), "float32") for _ in range(2))
        texts_in = ((tokens(t),) for batch in batches for t in batch.column("text").to_pylist())
        for group in groups(texts_in):
            train_batch(table, squares, Batch([g[0] for g in group], own, bits))
        touched = np.flatnonzero(squares.any(axis=1))
        for at in range(0, len(touched), EMITTED):
            rows = touched[at:at + EMITTED]
            units = np.clip(np.rint(table[rows] * UNITS), -32767, 32767).astype("int16")
            offsets = np.arange(len(rows) + 1, dtype="int32") * CLASSES
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(units.ravel()))],
                ["feature", "units"])
    shards = shard_count(docs.rdd.getNumPartitions(), bits) if bits > LEAST_BITS else None
    dealt = docs.select("text") if shards is None else docs.select("text").coalesce(shards)
    # Rows are dealt before they are summed: sums are wider than what they add up.
    changes = dealt.mapInArrow(run, "feature long, units array<short>").repartition("feature")
    averaged = changes.groupBy("feature").agg(
        *(F.avg(F.col("units")[i]).alias(n) for i, n in enumerate(names))).toPandas()
    table = np.zeros((1 << bits, CLASSES), "float32")
    table[averaged["feature"].to_numpy("int64")] = averaged[names].to_numpy("float32") / UNITS
    return table


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    plain = texts(docs)
    seen = plain.where(fold(F.col("doc_id"), 5) != 1)
    counts = stored(seen.select(F.explode(token_column(F.col("text"))).alias("token")).groupBy("token").agg(
        F.count("*").alias("c")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = {r["token"]: r["c"] for r in counts.where(F.col("c") * HEAD >= F.lit(total)).collect()}
    own = {w: i for i, w in enumerate(sorted(head, key=lambda w: (-head[w], w))[:OWN])}
    group_of = F.coalesce(F.lit(None).cast("int"), *(F.when(F.col("token") == w, i) for w, i in own.items()),
                          F.crc32(F.col("token")) % (CLASSES - len(own)) + len(own))
    sizes = {r["g"]: (r["n"], r["v"]) for r in counts.groupBy(group_of.cast("int").alias("g")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    share = np.array([sizes.get(i, (0, 0))[0] + 0.5 * (sizes.get(i, (0, 0))[1] + (i >= len(own))) for i in range(CLASSES)])
    share = np.log10(np.maximum(share, 0.5))
    whole = math.log10(total + 0.5 * (kinds + 1))
    bits = feature_bits(total)
    table = train(seen, own, bits) if total else np.zeros((1 << bits, CLASSES), "float32")
    shared = docs.sparkSession.sparkContext.broadcast((table, head, own, share))

    def run(batches):
        table, head, own, share = shared.value
        rows = ((r, d, tokens(t)) for batch in batches
                for r, d, t in zip(batch["row"], batch["doc_id"], batch["text"], strict=True))
        for group in groups(rows):
            batch = Batch([g[2] for g in group], own, bits)
            chance = np.concatenate([
                batch.log_chances(table, p)[np.arange(len(batch.target[p])), batch.target[p]]
                for p in batch.parts()]).astype("float64") / math.log(10)
            chance -= share[batch.target]
            count = np.nan_to_num(np.array([*map(head.get, batch.words)], "float64"))
            # Of the head the counts are here; others wait for the join.
            in_head = count > 0
            own_part = np.where(in_head, np.log10(count + 0.5), 0.0)
            single = batch.word_class < len(own)
            fixed = np.where(single, share[batch.word_class], own_part)[batch.ids]
            n = len(group)
            of_doc = [np.bincount(batch.doc, x, n) for x in (
                in_head[batch.ids], own_part[batch.ids], chance + fixed)]
            lengths = np.bincount(batch.doc, minlength=n)
            tail = np.flatnonzero(~in_head[batch.ids])
            keys, times = np.unique(batch.doc[tail] * np.int64(len(batch.words)) + batch.ids[tail], return_counts=True)
            ids = [g[0] for g in group]
            yield pd.DataFrame({
                "row": ids, "doc_id": [g[1] for g in group], "token": None, "times": lengths,
                "known": of_doc[0].astype("int64"), "base": of_doc[1], "full": of_doc[2]})
            yield pd.DataFrame({
                "row": np.array(ids)[keys // len(batch.words)], "doc_id": None,
                "token": batch.words[keys % len(batch.words)], "times": times, "known": 0, "base": 0.0, "full": 0.0})
    schema = "row long, doc_id string, token string, times long, known long, base double, full double"
    # Ids travel as text: pandas would turn integers beside a null into floats.
    numbered = plain.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string"), "text")
    parts = stored(numbered.mapInPandas(run, schema), "parts")
    tail = parts.where("token is not null").select("row", "token", "times")
    # A token outside the head that is in no training text joins nothing: half a count.
    # Words are distinct there, so hashing it is even, and the longer side needs no sort.
    rare = counts.where(F.col("c") * HEAD < F.lit(total)).hint("shuffle_hash")
    c = F.coalesce("c", F.lit(0))
    tail = tail.join(rare, "token", "left").select(
        "row", F.lit(None).cast("string").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(c > 0, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10(c + 0.5)).alias("base"), (F.col("times") * F.log10(c + 0.5)).alias("full"))
    whole_docs = parts.where("token is null").select("row", "doc_id", F.col("times").alias("n_tokens"), "known", "base", "full")
    summed = whole_docs.unionByName(tail).groupBy("row").agg(
        F.max("doc_id").cast("long").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base"), F.sum("full").alias("full"))
    return summed.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), F.col("full").alias("score"))
