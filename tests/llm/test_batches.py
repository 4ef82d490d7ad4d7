"""Large Arrow batches are turned into Python values a part at a time."""

import pyarrow as pa

from pyspark.sql import functions as F

from swathe.llm.common import AT_A_TIME, mapped, slices


def test_a_batch_of_long_texts_is_worked_in_parts(spark):
    size = 10_000
    rows = spark.range(0, 600, 1, 1).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") != 7, F.repeat(F.lit("word "), size // 5)).alias("text"))

    def start():
        return lambda values: [[sum(len(v or "") for v in values)] * len(values)]
    out = mapped(rows, ["doc_id"], start, "at_once long").collect()
    assert [r["doc_id"] for r in out] == list(range(600))
    assert max(r["at_once"] for r in out) <= AT_A_TIME + size


def test_parts_are_the_whole_batch():
    texts = ["", None, "x" * (3 * AT_A_TIME), "y", *["z"] * 2000]
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": texts})
    parts = list(slices(batch, "text"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 4
    assert not list(slices(batch.slice(0, 0), "text"))
    ids = pa.RecordBatch.from_pydict({"ids": [[1, 2], [], None, [3]]})
    assert sum(p.num_rows for p in slices(ids, "ids")) == 4
