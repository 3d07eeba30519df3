"""Pages go through few Python workers: memory of an executor's Python follows their number."""

import re

from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import text as TX
from quarry.operators import extract, index, links

PYTHON = r"ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython|FlatMap\w*InPandas"


def python_nodes(df) -> list:
    return re.findall(PYTHON, df._jdf.queryExecution().executedPlan().toString())


def pages(spark):
    html = ["<title>A12 &amp; b</title><p>one &lt; two</p><a href='/x'>x</a>", "<title></title><p>none</p>", "<!-- <title>T</title> --><p>x</p>",
            "<!-- c --><title>&#1;</title>  <p>" + "word " * 600 + "</p>", None, "", "<TITLE x='1'> é </TITLE>", "<!-- open <title>kept</title>"]
    return spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_a_page_has_a_title_if_one_is_extracted(spark):
    rows = pages(spark).select("page_id", H.has_title(F.col("html")).alias("has"), H.extract_title(F.col("html")).alias("title")).collect()
    assert {r.page_id: r.has for r in rows} == {r.page_id: r.title is not None for r in rows}
    assert [r.page_id for r in rows if r.has] == [0, 3, 6, 7]


def test_records_and_links_of_titled_pages(spark):
    rec = extract.page_records(pages(spark), depth=F.lit(1))
    assert len(python_nodes(rec)) == 1
    assert {r.page_id: r.title for r in rec.collect()} == {0: "A12 & b", 3: "", 6: " é ", 7: "kept"}
    edges = links.extract_links(pages(spark).filter(H.has_title(F.col("html")))).select("page_id", "ord")
    assert python_nodes(edges) == [] and [tuple(r) for r in edges.collect()] == [(0, 0)]


def test_index_rows_cut_and_embed_in_one_pass(spark):
    docs = index.compose_document(extract.page_records(pages(spark), depth=F.lit(1), on_missing="keep"))
    docs = docs.withColumn("page_content", F.when(F.col("doc_id") == 1, F.lit(" \n ")).when(F.col("doc_id") != 2, F.col("page_content"))).checkpoint()
    once, twice = index.index_rows(docs, size=100, overlap=20), index.embed_chunks(index.chunk_rows(docs, 100, 20))
    assert len(python_nodes(once)) == 1 and once.schema == twice.schema
    got = sorted(map(tuple, once.collect()))
    assert got == sorted(map(tuple, twice.collect())) and len(got) > 30 and not {1, 2} & {r[1] for r in got}
    assert index.index_rows(docs.filter("doc_id in (1, 2)")).count() == 0


def test_strip_is_pythons(spark):
    texts = ["", " ", "\n\x1c ", "a", " a", "a ", "　a b c\u0085", "a\n", "\ta\nb \n\n", "x" * 5000 + " y ", "\U0001f600 ", " \U0001f600b\r\n", "a​ "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", TX.py_strip(F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == dict(enumerate([*(t.strip() for t in texts), None]))
    assert "+$" not in TX.py_strip(F.col("t"))._jc.toString()      # no trial at every inner run of white space
