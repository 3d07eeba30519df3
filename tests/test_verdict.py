"""Contracts mended after round 1: all pages have records, the index check holds, late stream turns."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import embed, extract, index
from quarry.streaming.context import _ordered, _step


def _pages(spark, n):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/"), F.col("id")).alias("url"),
                                 F.concat(F.lit("<html><title>A"), F.col("id"), F.lit("</title><p>x</p></html>")).alias("html"))


def test_every_page_has_a_record_far_beyond_the_crawl(spark):
    pages = _pages(spark, 30_000)
    frontier = spark.createDataFrame([(0, 0), (1, 1)], "page_id bigint, depth int")
    rec = extract.crawl_records(pages, frontier, pages.filter("page_id = 0").select("page_id"))
    assert rec.count() == 30_000
    assert rec.filter("depth is not null").count() == 2


class Small:
    name, dim, built = "small", 4, 0

    def __init__(self):
        Small.built += 1

    def encode(self, texts):
        import numpy as np

        return np.ones((len(texts), 4))


def _chunks(spark, n=3):
    docs = index.compose_document(extract.page_records(_pages(spark, n).withColumn("depth", F.lit(1))))
    return index.chunk_rows(docs)


def test_append_and_upsert_refuse_another_model(spark, tmp_table):
    path, target = tmp_table("idx"), tmp_table("idx2")
    index.append_index(_chunks(spark), path)
    before = spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        index.append_index(_chunks(spark), path, embedder=Small())
    assert spark.read.parquet(path).count() == before
    with pytest.raises(ValueError):
        index.upsert_to(index.embed_chunks(_chunks(spark), Small()), path, target, embedder=Small())


def test_upsert_writes_meta_and_creates(spark, tmp_table):
    path, target = tmp_table("none"), tmp_table("made")
    rows = index.embed_chunks(_chunks(spark))
    assert index.upsert_to(rows, path, target).count() == 3
    assert index.load_index(spark, target).count() == 3
    again = tmp_table("again")
    assert index.upsert_to(rows.filter("doc_id < 2"), target, again, by_document=True).count() == 3


def test_a_model_class_is_never_built_on_the_driver(spark):
    built = Small.built
    df = spark.createDataFrame([("a",), ("b",)], "text string").select(embed.embed_column(F.col("text"), Small).alias("v"))
    assert embed.embedder_info(Small) == ("small", 4)
    assert Small.built == built and df.schema["v"] is not None


def test_a_late_turn_gets_only_earlier_rows():
    out = []
    hits, answers = [(1, 1, 11, 5), (3, 1, 33, 5)], [(1, 7), (3, 7)]
    kept = _step(9, 2, _ordered(hits), answers, 100, 100, out)
    assert [(r[2], r[3]) for r in out] == [("hit", 1), ("answer", 1)]
    assert kept == (_ordered(hits), answers)
