"""What the operators share: tables, words, stored intermediates and the fold of the labels."""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from swathe.session import shared_dir

SPACES = "[\\x20\\x09-\\x0D]+"
# Byte tables: the six separators to a space, and A-Z to lower case besides. UTF-8 keeps ASCII bytes apart.
_TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)
_TO_LOWER = _TO_SPACE.lower()
# Lower-casing of A-Z alone, as the contracts ask; other letters stay.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone, so that other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def split_words(text: str, lower: bool = False) -> list[str]:
    """Maximal runs of characters other than space and U+0009 to U+000D; ``lower`` lower-cases A-Z."""
    data = text.encode("utf-8", "surrogatepass").translate(_TO_LOWER if lower else _TO_SPACE)
    return [w for w in data.decode("utf-8", "surrogatepass").split(" ") if w]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# A random value per byte, so that words are polynomials with mixed coefficients.
_BYTE_VALUES = mix(np.arange(1, 257, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15))
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS = np.cumprod(np.full(64, _WORD_BASE))


SEGMENT = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word of ``split_words``, straight from the bytes of the text; a long text is
    taken in segments that end at a space."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= SEGMENT:
        return _segment_hashes(data)
    parts, at = [], 0
    while at < len(data):
        space = _SPACE.search(data, at + SEGMENT)
        past = space.end() if space else len(data)
        parts.append(_segment_hashes(data[at:past]))
        at = past
    return np.concatenate(parts)


def _segment_hashes(segment: bytes) -> np.ndarray:
    data = np.frombuffer(segment, "uint8")
    solid = (data != 32) & ((data < 9) | (data > 13))
    letters = data[solid]
    if not len(letters):
        return np.empty(0, "uint64")
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    starts = np.flatnonzero(opens[solid])
    sizes = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    longest = int(sizes.max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _WORD_BASE))
    sums = np.add.reduceat(_BYTE_VALUES[letters] * powers[place], starts)
    return mix(sums + sizes.astype("uint64"))


# Characters or list entries of a batch that are turned into Python values at a time, and rows.
AT_A_TIME = 1 << 20
ROWS_AT_A_TIME = 512


def slices(batch: pa.RecordBatch, column: str | int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose values of ``column`` have about ``AT_A_TIME`` bytes or entries, a row at least: a batch
    of 10,000 long texts and what is made of it would fill a worker many times over."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    sizes = pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype="int64") // AT_A_TIME + np.arange(len(sizes)) // ROWS_AT_A_TIME
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, past in itertools.pairwise([*starts.tolist(), len(sizes)]):
        yield batch.slice(start, past - start)


def mapped(rows: DataFrame, kept: list[str], start: Callable[[], Callable], added: str, column: str = "text") -> DataFrame:
    """``kept`` columns as they are, followed by ``added`` ones, for every row.

    ``start()`` is called once per task and returns a function from the values of ``column`` in a batch to
    a list of values per added column. Kept columns stay Arrow arrays, so ids and nulls are not touched.
    """
    fields = to_arrow_schema(StructType.fromDDL(added))
    names = [*kept, *fields.names]

    def run(batches):
        work = start()
        for batch in (part for whole in batches for part in slices(whole, column)):
            new = work(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept),
                 *(pa.array(v, f.type) for v, f in zip(new, fields, strict=True))], names)
    schema = StructType([*(rows.schema[c] for c in kept), *StructType.fromDDL(added)])
    return rows.select(*dict.fromkeys([*kept, column])).mapInArrow(run, schema)


def words_column(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0)).cast("int")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder in the shared checkpoint directory and read it back.

    The files outlive the executors that wrote them, and cut the lineage.
    """
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]
