"""Queries over tables that are folders of several files, as large tables are."""

import os
import shutil
import uuid

import pytest

from registry import QUERIES
from swathe.session import shared_dir

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    """The small tables, the streamed ones dealt over three files each."""
    place = f"{shared_dir(spark)}/folders-{uuid.uuid4().hex}"
    shutil.copytree(SMALL, place, ignore=shutil.ignore_patterns("documents*", "embeddings*"))
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{place}/{name}.parquet")
    return place


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["STR-01_ingest_stream", "STR-02_dedupe_stream", "STR-03_incremental_embed"])
def test_streams_read_files_and_folders_alike(spark, folder, name):
    assert rows(QUERIES[name](spark, folder)) == rows(QUERIES[name](spark, SMALL))


def test_a_batch_lands_in_as_many_files_as_the_table_has_parts(spark, folder):
    before = set(os.listdir(shared_dir(spark)))
    got = rows(QUERIES["STR-01_ingest_two_batches"](spark, folder))
    root, = (n for n in set(os.listdir(shared_dir(spark))) - before if n.startswith("ingest2-"))
    landed = [n for n in os.listdir(f"{shared_dir(spark)}/{root}/landed") if n.endswith(".parquet")]
    assert len(landed) == 6
    assert sorted(n for n in os.listdir(f"{shared_dir(spark)}/{root}/scenes") if "=" in n) == ["batch_id=0", "batch_id=1"]
    assert got == rows(QUERIES["STR-01_ingest_two_batches"](spark, SMALL))
