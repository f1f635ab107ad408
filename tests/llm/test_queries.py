"""The registered queries of the numbered operators: against their SQL, and whole-table row counts of those without."""

import os

import duckdb
import pytest

from larkspur.llm import queries
from tests.test_plans import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op3_toxicity", "op4_best_fit_packing"}))
def test_one_row_for_every_document(spark, name):
    df = queries.QUERIES[name](spark, SF)
    ids = [r["doc_id"] for r in df.select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_every_document_is_packed_once(spark):
    from pyspark.sql import functions as F

    df = queries.op4_best_fit_packing(spark, SF)
    per = df.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("last")).where("last <> n - 1").count()
    assert per == 0 and df.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
