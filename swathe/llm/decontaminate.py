"""Benchmark decontamination by the q-gram lemma (operator 2).

An item of n characters that stands in a document with at most k edits shares at least
n - q + 1 - k*q of its q-grams with it, all within k neighbouring diagonals. Hits are counted in
overlapping bands of 2(k+1) diagonals; bands that reach the bound are verified by a banded alignment
of the whole item. Texts are compared in lower case with runs of other characters as one space.

Items shorter than ``Q`` characters (nulls, empty texts) are never found; an item without an id is
searched like any other, and its id is null in the result. A text without a hit gives no row; repeated
rows of a document are one document. Items are broadcast in blocks of bounded size, so that a large
benchmark is searched block by block against all documents. Hits are laid out at most about ``HITS``
at a time: where text and item repeat a gram very often, windows of the text are taken in turn.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.llm.common import free_name, mapped, stored, texts

Q = 6
EDIT_SHARE = 0.1
BLOCK_CHARS = 8 << 20
HITS = 2 << 20
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = 22
# Runs of other characters; a lone space is left out as it stays what it is.
OTHER = re.compile(r"[\W_]{2,}|[^\w ]|_")


def normal(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def gram_hashes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype("uint64") + np.uint64(1)
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, "uint64")
    rolled = np.zeros(n, "uint64")
    for k in range(Q):
        rolled = rolled * BASE + codes[k:k + n]
    return rolled * MIX


def budget(size: int) -> int:
    """Edits allowed, kept low enough for a positive bound on shared q-grams."""
    return max(0, min(int(size * EDIT_SHARE), (size - Q) // Q))


def banded_edits(item: np.ndarray, text: np.ndarray, edits: int, low: int, high: int) -> tuple | None:
    """(edits, start, past) of the best occurrence of ``item`` in ``text`` on diagonals low..high
    (text place minus item place), or None beyond ``edits``."""
    width, far = high - low + 1, 1 << 20
    steps = np.arange(width)
    at = low + steps
    row = np.where((at >= 0) & (at <= len(text)), 0, far)
    origin = at.copy()
    for i, letter in enumerate(item):
        at = low + steps + i
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == letter
        step = np.where(inside, row + ~same, far)
        skip = np.append(row[1:] + 1, far)
        take = skip < step
        best = np.where(take, skip, step)
        source = np.where(take, np.append(origin[1:], 0), origin)
        level = best - steps
        low_at = np.maximum.accumulate(np.where(level == np.minimum.accumulate(level), steps, 0))
        row = level[low_at] + steps
        origin = source[low_at]
    row = np.where(low + steps + len(item) <= len(text), row, far)
    j = int(np.argmin(row))
    return (int(row[j]), int(origin[j]), low + j + len(item)) if row[j] <= edits else None


class Benchmark:
    """The q-gram table of a block of items, each with a key of the caller's."""

    def __init__(self, items: list[tuple]):
        self.items = [(i, normal(t)) for i, t in items]
        self.items = [(i, t) for i, t in self.items if len(t) >= Q]
        grams = [gram_hashes(t) for _, t in self.items]
        sizes = np.array([len(g) for g in grams], "int64")
        hashes = np.concatenate(grams) if grams else np.empty(0, "uint64")
        owner = np.repeat(np.arange(len(grams)), sizes)
        place = np.concatenate([np.arange(n) for n in sizes]) if grams else np.empty(0, "int64")
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        # Distinct grams, and for every posting the number of its gram.
        self.grams, self.gram = np.unique(hashes[order], return_inverse=True)
        self.known = np.zeros(1 << BITS, bool)
        self.known[self.grams >> np.uint64(64 - BITS)] = True
        self.codes = [np.frombuffer(t.encode("utf-32-le", "replace"), "<u4") for _, t in self.items]
        self.edits = np.array([budget(len(c)) for c in self.codes], "int64")
        self.bound = np.array([len(c) - Q + 1 - k * Q for c, k in zip(self.codes, self.edits, strict=True)])

    def search(self, text: str) -> dict:
        """key -> (edits, start, past), the best and then first occurrence."""
        if not self.items:
            return {}
        text = normal(text)
        hashes = gram_hashes(text)
        at = np.flatnonzero(self.known[hashes >> np.uint64(64 - BITS)])
        if not len(at):
            return {}
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        same = self.grams[gram] == hashes[at]
        at, gram = at[same], gram[same]
        # Items of which too few places stand anywhere in the text cannot reach the bound in a band.
        present = np.zeros(len(self.grams), bool)
        present[gram] = True
        places = np.bincount(self.owner[present[self.gram]], minlength=len(self.items))
        found: dict[int, tuple] = {}
        near = places >= self.bound
        for o in np.flatnonzero(near).tolist():
            exact = text.find(self.items[o][1])
            if exact >= 0:
                found[o] = 0, exact, exact + len(self.items[o][1])
                near[o] = False
        if near.any():
            codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
            self._bands(codes, at, gram, near, places, found)
        return {self.items[o][0]: best for o, best in found.items()}

    def _bands(self, codes: np.ndarray, at: np.ndarray, gram: np.ndarray, near: np.ndarray, places: np.ndarray,
               found: dict[int, tuple]) -> None:
        """Verify the bands of the ``near`` items that reach their bound."""
        postings = np.flatnonzero(near[self.owner])
        often = np.bincount(self.gram[postings], minlength=len(self.grams))
        if int(often[gram].sum()) <= HITS:
            self._verify(codes, at, gram, postings, places, found)
            return
        for o in np.flatnonzero(near).tolist():
            own = postings[self.owner[postings] == o]
            total = np.cumsum(np.bincount(self.gram[own], minlength=len(self.grams))[gram])
            # A band's hits lie within the item's length and the band's width of each other.
            reach = len(self.codes[o]) + 4 * (int(self.edits[o]) + 1)
            begin, seen = 0, set()
            while begin < len(at) and (o not in found or found[o][0] > self._fewest(o, places[o])):
                before = int(total[begin - 1]) if begin else 0
                past = max(int(np.searchsorted(total, before + HITS)), int(np.searchsorted(at, at[begin] + 2 * reach))) + 1
                # A window that shows the same text as one before, its surroundings included, tells nothing new.
                shown = codes[max(0, at[begin] - reach):at[min(past, len(at)) - 1] + reach].tobytes()
                if shown not in seen:
                    seen.add(shown)
                    self._verify(codes, at[begin:past], gram[begin:past], own, places, found)
                if past >= len(at):
                    break
                begin = int(np.searchsorted(at, at[past - 1] - reach))

    def _fewest(self, o: int, shared: int) -> int:
        """Edits that an occurrence with so many distinct shared q-grams has at least."""
        return max(0, -(-(len(self.codes[o]) - Q + 1 - int(shared)) // Q))

    def _verify(self, codes: np.ndarray, at: np.ndarray, gram: np.ndarray, postings: np.ndarray, places: np.ndarray,
                found: dict[int, tuple]) -> None:
        size = np.bincount(self.gram[postings], minlength=len(self.grams))
        begin = np.cumsum(size) - size
        count = size[gram]
        where = np.repeat(at, count)
        hit = postings[np.arange(len(where)) + np.repeat(begin[gram] - np.cumsum(count) + count, count)]
        owner, place = self.owner[hit], self.place[hit]
        # Cells of k + 1 diagonals; a band is a cell and the next, so neighbouring bands overlap.
        cell = (owner << 40) + (where - place) // (self.edits[owner] + 1) + (1 << 39)
        order = np.argsort(cell, kind="stable")
        cell, place = cell[order], place[order]
        cells, first = np.unique(cell, return_index=True)
        count = np.diff(np.append(first, len(cell)))
        joined = np.append(cells[1:] == cells[:-1] + 1, False)
        in_band = count + np.where(joined, np.append(count[1:], 0), 0)
        of = cells >> 40
        known: dict[tuple, tuple | None] = {}
        for c in np.flatnonzero(in_band >= self.bound[of]).tolist():
            o = int(of[c])
            k = int(self.edits[o])
            if o in found and found[o][0] <= self._fewest(o, places[o]):
                continue
            # A gram that the text repeats inside the band counts once.
            shared = len(np.unique(place[first[c]:first[c] + in_band[c]]))
            if shared < self.bound[o] or (o in found and found[o][0] <= self._fewest(o, shared)):
                continue
            low = (int(cells[c] & ((1 << 40) - 1)) - (1 << 39)) * (k + 1) - k
            high = low + 2 * (k + 1) - 1 + 2 * k
            # A text that repeats itself shows the same stretch again and again.
            begin = max(0, low)
            stretch = codes[begin:max(begin, high + len(self.codes[o]))]
            key = o, low - begin, stretch.tobytes()
            if key not in known:
                known[key] = banded_edits(self.codes[o], stretch, k, low - begin, high - begin)
            best = known[key] and (known[key][0], known[key][1] + begin, known[key][2] + begin)
            if best and (o not in found or best < found[o]):
                found[o] = best


def _blocks(docs: DataFrame, benchmark: DataFrame):
    """Broadcasts of the items, (id, text), in blocks of bounded size."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        yield docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part])


def _table(items: list[tuple]) -> Benchmark:
    """Items under their number, since ids may be null or repeat."""
    return Benchmark([(n, text) for n, (_, text) in enumerate(items)])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, start, past`` of every document that holds an item; places count
    characters of the normalised text."""
    found = None
    names = ["doc_id", "item_id", "edits", "start", "past"]
    for shared in _blocks(docs, benchmark):
        def run(batches, shared=shared):
            items, table = shared.value, _table(shared.value)
            for batch in batches:
                rows = [(i, items[n][0], *best) for i, text in enumerate(batch.column("text").to_pylist())
                        for n, best in table.search(text).items()]
                columns = [[r[k] for r in rows] for k in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
                     *(pa.array(c, pa.int64()) for c in columns[1:])], names)
        hits = texts(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))
        found = hits if found is None else stored(found, "leaks").unionByName(hits)
    first = F.min(F.struct("edits", "start", "past")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(first).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns kept, that hold no item. Every row is judged by its own text, also
    where ids are null or repeat."""
    name = free_name("leaks", docs.columns)
    kept = docs
    for shared in _blocks(docs, benchmark):
        def start(shared=shared):
            table = _table(shared.value)
            return lambda values: [[len(table.search(t or "")) for t in values]]
        kept = mapped(kept, docs.columns, start, f"`{name}` int").where(F.col(name) == 0).drop(name)
    return kept
