"""Registered queries: oracle SQL on small data, and the pipeline against its parts."""

import os
import sys

import duckdb
import pandas as pd
import pytest

from wearline.llm.queries import ORACLES, QUERIES
from wearline.session import ship_package

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def same(got: pd.DataFrame, expected: pd.DataFrame) -> bool:
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    norm = lambda df: sorted(tuple("" if pd.isna(v) else str(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))
    tidy = lambda rows: [tuple(v.removesuffix(".0") for v in r) for r in rows]
    return tidy(norm(got)) == tidy(norm(expected))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ship_package(spark)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert same(QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df())


def test_fourteen_queries_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{k}" for k in range(1, 14)), "pipeline"]


def test_pipeline_keeps_clean_documents_and_one_of_each_group(spark):
    from corpus_pipeline import COLUMNS, STAGES

    ship_package(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = spark.conf.get("spark.checkpoint.dir") + "/pipeline-test"
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, SF).write.mode("overwrite").parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        if k < 4:
            assert docs.columns == COLUMNS, name
            assert docs.where("n_chars <> length(text)").count() == 0
        after = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert after <= before and len(after) >= 0.75 * len(before), name
        if k == 4:
            assert after == before
        before = after
    totals = docs.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert totals.max() <= 2048 and len(totals) == -(-int(totals.sum()) // 2048)
