"""Substring de-duplication over fixed windows of words (operator 10).

Every window of ``length`` words gets two Rabin-Karp hashes (polynomials over the words' hashes). The
second names its bucket, 56 bits of the first travel with it; as buckets grow with the text, so do the
bits that tell windows apart (62 at the least, about 79 for 100 TB). A task takes its documents in chunks, in the order of their ids. A window that an earlier
document of the chunk holds is settled there; of all others the first holder alone goes on, so that a
window shared by very many documents is sent once per chunk. Buckets of hashes find the smallest id
of each window and return the places of later holders. Places travel as one byte each, and the texts
are shuffled once, when they meet the places that they lose.

A word goes if a window over it also starts in a document with a smaller id. Nulls are empty texts,
and rows that repeat an id are judged by it alike, each on its own text. A null id is never earlier than
another and is left whole. An empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from swathe.llm.common import free_name, slices, split_words, texts, word_hashes

LENGTH = 13
BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)
SENT = 7                  # bytes of a hash that travel
CHUNK = 1 << 20           # windows of the documents that a task settles among themselves
ROWS = 16                 # buckets of a chunk that a task passes on at a time
BUCKET_CHARS = 8 << 20
LEAST_BUCKETS = 64


def window_hashes(text: str, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes per start, of 64 and 32 bits: polynomials over the words' hashes, modulo 2^64, then mixed."""
    codes = word_hashes(text)
    n = max(0, len(codes) - length + 1)
    found = []
    for base in BASES:
        rolled = np.zeros(n, "uint64")
        for k in range(length if n else 0):
            rolled *= base
            rolled += codes[k:k + n]
        rolled ^= rolled >> np.uint64(32)
        found.append(rolled * MIX)
    return found[0], (found[1] >> np.uint64(32)).astype("uint32")


def covered(hit: np.ndarray, n_words: int, length: int = LENGTH) -> np.ndarray:
    """Mask of the words inside windows that start where ``hit`` is set."""
    edges = np.zeros(n_words + 1, "int32")
    starts = np.flatnonzero(hit)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def removal_intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words as (first, past the last)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype("int8"), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


# -- places as bytes ------------------------------------------------------------------

def pack_places(places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rising places as steps in base 255: full bytes of 255, then the rest. ``first`` marks where a new
    document starts."""
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    full = steps // 255
    out = np.full(len(steps) + int(full.sum()), 255, "uint8")
    out[np.cumsum(full + 1) - 1] = steps - 255 * full
    return out


def unpack_places(packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of documents that hold ``counts`` each."""
    # Sums over all documents may wrap around; a place itself fits, and differences come out right.
    total = np.cumsum(packed, dtype="uint32")[packed != 255]
    starts = np.cumsum(counts) - counts
    before = np.where(starts > 0, total[np.maximum(starts, 1) - 1] if len(total) else 0, 0)
    total -= np.repeat(before.astype("uint32"), counts)
    return total


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, otherwise as given, and where each run begins."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    return order, new


def _by_document(chosen: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, places each, packed places) of the chosen entries, which stand by document and place."""
    owner, place = owner[chosen], place[chosen]
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    starts = np.flatnonzero(first)
    return owner[starts], np.diff(np.append(starts, len(owner))), pack_places(place, first)


LISTED = ("bucket int, ids binary, keys binary, counts binary, places binary, hashes binary, "
          "late_ids binary, late_keys binary, late_counts binary, late_places binary")


def _listing(length: int, buckets: int):
    """Per chunk of documents and bucket: the windows whose first holder in the chunk is that document,
    and the places that are settled within the chunk."""
    names = [c.split(" ")[0] for c in LISTED.split(", ")]

    def settle(ids, keys, hashes):
        """Rows of a chunk. Arrays over all its windows are 32 bits wide where they can be, and go when they are used:
        the workers of an executor share what its heap leaves."""
        by_id = np.argsort(ids, kind="stable")
        ids, keys = ids[by_id], keys[by_id]
        sizes = np.array([len(hashes[i][0]) for i in by_id])
        high, low = (np.concatenate([hashes[i][k] for i in by_id]) for k in (0, 1))
        hashes.clear()
        owner = np.repeat(np.arange(len(ids), dtype="int32"), sizes)
        place = np.arange(len(owner), dtype="int32")
        place -= np.repeat((np.cumsum(sizes) - sizes).astype("int32"), sizes)
        order, new = _runs(high)
        order = order.astype("int32")
        # Documents stand by id, so the first of a run holds its smallest id; equal ids share a rank.
        rank = np.cumsum(np.append(False, ids[1:] != ids[:-1]), dtype="int32")[owner[order]]
        first = np.flatnonzero(new).astype("int32")
        runs = np.diff(np.append(first, np.int32(len(order))))
        late = np.empty(len(order), bool)
        late[order] = rank > np.repeat(rank[first], runs)
        del order, new, rank, first, runs
        # Late entries of a document go to one bucket, the others to that of their hash.
        kind = "uint16" if buckets <= 1 << 16 else "int32"
        low = low.astype("uint64")
        low *= np.uint64(buckets)
        low >>= np.uint64(32)
        bucket = low.astype(kind)
        del low
        spread = (keys.astype("uint64") * MIX >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        bucket[late] = spread.astype(kind)[owner[late]]
        order = np.argsort(bucket, kind="stable").astype("int32")
        filled, held = np.unique(bucket, return_counts=True)
        del bucket
        for b, here in zip(filled.tolist(), np.split(order, np.cumsum(held)[:-1]), strict=True):
            row = [b]
            for chosen in (here[~late[here]], here[late[here]]):
                docs, counts, packed = _by_document(chosen, owner, place)
                row += [ids[docs].tobytes(), keys[docs].tobytes(), counts.astype("uint32").tobytes(), packed.tobytes()]
                if len(row) == 5:
                    row.append(high[chosen].view("uint8").reshape(-1, 8)[:, :SENT].tobytes())
            yield row

    def run(batches):
        ids, keys, hashes, total = [], [], [], 0

        def flush():
            rows = settle(np.array(ids, "int64"), np.array(keys, "int64"), hashes)
            while some := list(itertools.islice(rows, ROWS)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in some], pa.int32()),
                     *(pa.array([r[i] for r in some], pa.binary()) for i in range(1, len(names)))], names)
        for batch in batches:
            columns = (batch.column(c) for c in ("doc_id", "key", "text"))
            for doc_id, key, text in zip(*columns, strict=True):
                found = window_hashes(text.as_py(), length)
                if len(found[0]):
                    ids.append(doc_id.as_py())
                    keys.append(key.as_py())
                    hashes.append(found)
                    total += len(found[0])
                if total >= CHUNK:
                    yield from flush()
                    ids, keys, hashes, total = [], [], [], 0
        if total:
            yield from flush()
    return run


def _later_holders(group: pd.DataFrame) -> pd.DataFrame:
    """``doc_id, key, late``: the packed places of the windows that an earlier document holds."""
    joined = lambda name, kind: np.frombuffer(b"".join(group.pop(name)), kind)
    ids, keys, counts = joined("ids", "int64"), joined("keys", "int64"), joined("counts", "uint32").astype("int64")
    # Documents of a row follow one another, so that rows joined together read like one.
    place = unpack_places(joined("places", "uint8"), counts)
    sent = joined("hashes", "uint8").reshape(-1, SENT)
    padded = np.zeros((len(place), 8), "uint8")
    padded[:, :SENT] = sent
    del sent
    owner = np.repeat(np.arange(len(ids), dtype="int32"), counts)
    order, new = _runs(padded.view("uint64").ravel())
    del padded
    order = order.astype("int32")
    late = np.zeros(len(order), bool)
    if len(order):
        rank = np.unique(ids, return_inverse=True)[1].astype("int32")[owner[order]]
        starts = np.flatnonzero(new)
        late[order] = rank > np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(order))))
        del rank, starts
    del order, new
    found = [(ids, keys, *_by_document(np.flatnonzero(late), owner, place))]
    settled = joined("late_ids", "int64"), joined("late_keys", "int64"), joined("late_counts", "uint32").astype("int64")
    found.append((*settled[:2], np.arange(len(settled[0])), settled[2], joined("late_places", "uint8")))
    out = []
    for ids, keys, docs, counts, packed in found:
        ends = np.flatnonzero(packed != 255)[np.cumsum(counts) - 1] + 1 if len(docs) else []
        out.append(pd.DataFrame({
            "doc_id": ids[docs], "key": keys[docs],
            "late": [p.tobytes() for p in np.split(packed, ends[:-1])] if len(docs) else []}))
    return pd.concat(out)


def bucket_count(docs: DataFrame) -> int:
    """Buckets in step with the volume of text, so that one fits in a task at any size."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-int(chars) // BUCKET_CHARS))


def late_places(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, key, late``: lists of packed places of windows that start in an earlier document, by id
    and hash of the text."""
    plain = texts(docs).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")
    listed = plain.mapInArrow(_listing(length, bucket_count(plain)), LISTED)
    late = listed.groupBy("bucket").applyInPandas(_later_holders, "doc_id long, key long, late binary")
    return late.groupBy("doc_id", "key").agg(F.collect_list("late").alias("late"))


def _removed(text: str, late: list[bytes] | None, length: int) -> tuple[list[str], np.ndarray]:
    """The words, and which of them go."""
    words = split_words(text)
    hit = np.zeros(max(0, len(words) - length + 1), bool)
    for part in late or ():
        packed = np.frombuffer(part, "uint8")
        hit[unpack_places(packed, np.array([np.count_nonzero(packed != 255)]))] = True
    return words, covered(hit, len(words), length)


def _kept(words: list[str], mask: np.ndarray) -> str:
    return " ".join([w for w, gone in zip(words, mask.tolist(), strict=True) if not gone])


def _with_places(docs: DataFrame, length: int) -> tuple[DataFrame, str, str]:
    """The documents, all columns kept, beside their late places; and the names of the two columns added."""
    key, late = (free_name(n, docs.columns) for n in ("late_key", "late_places"))
    found = late_places(docs, length).select(
        F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"), F.col("late").alias(late))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, (keyed["doc_id"].cast("long") == found["found_id"]) & (keyed[key] == found["found_key"]), "left")
    return joined.select(*(keyed[c] for c in docs.columns), found[late]), key, late


def mark_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_words, removed, kept_text``: ``removed`` lists the intervals that go."""
    joined, _, late = _with_places(texts(docs), length)

    def run(batches):
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column(late).to_pylist(), strict=True):
                words, mask = _removed(text, parts, length)
                spans = [{"first": a, "past": b} for a, b in removal_intervals(mask)]
                rows.append((len(words), spans, _kept(words, mask)))
            span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
            kinds = pa.int64(), span, pa.string()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))],
                ["doc_id", "n_words", "removed", "kept_text"])
    schema = "doc_id long, n_words long, removed array<struct<first:long,past:long>>, kept_text string"
    return joined.mapInArrow(run, schema)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their columns; texts that repeat earlier windows keep their other words,
    joined by one space, and ``n_chars`` follows where it exists. Other texts stay as they are."""
    joined, _, late = _with_places(docs, length)
    names = docs.columns
    at = names.index("text")
    cut = free_name("late_cut", docs.columns)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, at)):
            new, changed = [], []
            for text, parts in zip(batch.column(at).to_pylist(), batch.column(late).to_pylist(), strict=True):
                words, mask = _removed(text or "", parts, length)
                changed.append(bool(mask.any()))
                new.append(_kept(words, mask) if changed[-1] else text)
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(changed)], [*names, cut])
    schema = StructType([*docs.schema, StructField(cut, BooleanType())])
    out = joined.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(cut), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    joined, _, late = _with_places(texts(docs), length)

    def run(batches):
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column(late).to_pylist(), strict=True):
                words, mask = _removed(text, parts, length)
                kept = hashlib.sha256(_kept(words, mask).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(words), int(mask.sum()), kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
