"""Registered queries against their SQL, and the pipeline against its stages' rules."""

import duckdb
import pytest

import corpus_pipeline
from strataflow.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_all_ten_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


def test_pipeline(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{DIR}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert 200 > seen[0] == seen[1] > seen[2] >= seen[3] > 0
    assert docs.select("doc_id").distinct().count() == seen[3]
    got = corpus_pipeline.run(spark, DIR).toPandas()
    want = docs.toPandas()
    cols = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[cols].values)) == sorted(map(tuple, want[cols].values))
