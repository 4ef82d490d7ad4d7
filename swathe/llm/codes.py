"""Vector code compression with an equal-average search (operator 13).

Vectors are cut into ``PARTS`` equal parts, each with a codebook of its own. Codebooks are refined in
rounds: every task assigns its parts and sums them per entry, Spark adds the sums up, and the driver,
which holds only the codebooks, replaces the entries. The nearest entry is found by component sums: with
d components, the squared distance is at least (difference of sums)^2 / d. Entries are sorted by sum, and
a part looks outward from its own sum until that bound strictly exceeds the best distance.

All arithmetic is on integers, floor(4096 x). Rows left out are those of ``embeddings.whole_vectors``; a
length that ``PARTS`` does not divide is filled up with zeros. Repeated rows are coded alike and count as
often as they occur. The first codebooks come from the rows with the smallest ids (ties: the smaller
vector; null ids last); with fewer rows they have fewer entries. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.llm.common import stored
from swathe.llm.embeddings import matrix, whole_vectors

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
SALT = 32                 # tasks among which the rows of one label are dealt


class Codebook:
    """The entries of one part position, sorted by the sum of their components."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.index = np.argsort(sums, kind="stable")
        self.sums, self.sorted = sums[self.index], entries[self.index]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) per part, ties to the lower entry, and the distances computed."""
        n, d = parts.shape
        size = len(self.sums)
        own = parts.sum(axis=1)
        above = np.searchsorted(self.sums, own)
        below = above - 1
        least, entry = np.full(n, np.iinfo("int64").max // d), np.full(n, size)
        rows = np.arange(n)
        computed = 0
        far = np.iinfo("int64").max
        while len(rows):
            up, down = above[rows], below[rows]
            gap_up = np.where(up < size, self.sums[np.minimum(up, size - 1)] - own[rows], far)
            gap_down = np.where(down >= 0, own[rows] - self.sums[np.maximum(down, 0)], far)
            rising = gap_up <= gap_down
            gap = np.where(rising, gap_up, gap_down)
            within = gap < far
            within[within] = gap[within] ** 2 <= least[rows[within]] * d
            rows, rising = rows[within], rising[within]
            at = np.where(rising, above[rows], below[rows])
            distance = ((parts[rows] - self.sorted[at]) ** 2).sum(axis=1)
            computed += len(rows)
            index = self.index[at]
            better = (distance < least[rows]) | ((distance == least[rows]) & (index < entry[rows]))
            least[rows[better]], entry[rows[better]] = distance[better], index[better]
            above[rows[rising]] += 1
            below[rows[~rising]] -= 1
        return entry, least, computed


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, components)"""
    whole = matrix(column).astype("int64")
    return whole.reshape(len(whole), parts, -1)


def assign(column: pa.Array, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts, entries, distances), the last two as (rows, parts)."""
    cut = _parts(column, len(books))
    found = [Codebook(book).nearest(cut[:, p]) for p, book in enumerate(books)]
    return cut, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _entry_sums(rows: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (parts assigned, sum per component), over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, size = books.shape
    names = [f"s{i}" for i in range(size)]

    def run(batches):
        count, sums = np.zeros(parts * entries, "int64"), np.zeros((parts * entries, size), "int64")
        for batch in batches:
            if batch.num_rows:
                cut, entry, _ = assign(batch.column("vector"), shared.value)
                slot = (np.arange(parts) * entries + entry).ravel()
                count += np.bincount(slot, minlength=len(count))
                np.add.at(sums, slot, cut.reshape(-1, size))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), *(pa.array(sums[used, i]) for i in range(size))],
            ["slot", "n", *names])
    summed = rows.select("vector").mapInArrow(run, ", ".join(f"{c} long" for c in ["slot", "n", *names]))
    found = summed.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()
    return {divmod(r["slot"], entries): (r["n"], [r[c] for c in names]) for r in found}


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, components) from all rows of ``vec_id, vector`` (integers)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).toArrow()
    books = _parts(first.column("vector").combine_chunks(), parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for (part, entry), (n, sums) in _entry_sums(rows, books).items():
            books[part, entry] = [s // n for s in sums]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             column: str = "embedding") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row that takes part; ``label_error``
    adds the errors of all rows with the same label (nulls are one label)."""
    rows, length = whole_vectors(table, "label", column=column)
    zeros = F.array_repeat(F.lit(0), (-length) % parts)
    whole = F.concat(F.transform("vector", lambda x: F.floor(x * SCALE).cast("int")), zeros)
    rows = stored(rows.select("vec_id", "label", whole.alias("vector")), "scaled")
    books = fit_codebooks(rows, parts, entries, rounds) if length else np.zeros((parts, 1, 1), "int64")
    shared = table.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, entry, distance = assign(batch.column("vector"), shared.value)
                code = [bytes(e).hex() for e in entry.astype("uint8")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(distance.sum(axis=1))],
                    ["vec_id", "label", "code", "error"])
    label = rows.schema["label"].dataType.simpleString()
    coded = stored(rows.mapInArrow(run, f"vec_id long, label {label}, code string, error long"), "coded")
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    # A label may hold a third of all rows: its rows are dealt among SALT tasks, its sum goes to each.
    left = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    right = totals.select(F.col("label").alias("total_of"), "label_error",
                          F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("total_salt"))
    joined = left.join(right, left["label"].eqNullSafe(right["total_of"]) & (left["salt"] == right["total_salt"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
