import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from swathe.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracle(name, spark):
    own = queries.QUERIES[name](spark, FOLDER).toPandas()
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    sql = con.sql(queries.ORACLES[name]).df()[list(own.columns)]
    order = list(own.columns)
    pd.testing.assert_frame_equal(own.sort_values(order).reset_index(drop=True),
                                  sql.sort_values(order).reset_index(drop=True), check_dtype=False)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) <= docs.count() and len(ids) > docs.count() / 2
