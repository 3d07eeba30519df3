"""The pipeline's stages in order on the smallest table, and the SQL of the queries that have one."""

import duckdb
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quarry.llm import queries  # noqa: E402
from quarry.llm.common import staged  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == first.columns
        docs = staged(out, name)
        sizes[name] = docs.count()
    assert sizes["language_id"] == first.count()  # every text of the table is in a learned language
    assert sizes["line_dedup"] == sizes["language_id"] and sizes["near_dedup"] < sizes["line_dedup"]
    assert docs.filter(F.col("n_tokens") <= 0).count() == 0


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[key])
    names = [d[0] for d in want.description]
    rows = sorted(map(repr, want.fetchall()))
    got = queries.QUERIES[key](spark, SF).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == rows
