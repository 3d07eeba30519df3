"""Index maintenance: ordinals, capped/resumed appends, keyed upsert, running sums."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import common as CM
from quarry.operators import index as IX
from quarry.operators import keyed as KX


def _chunks(spark, counts):
    rows = [(d, i, f"doc{d} chunk{i}", "u%d" % d, 0, "t", "N/A", "N/A") for d, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_idx int, text string, url string, depth int, title string, "
                                     "model_num string, ps_num string")
    return df.withColumn("chunk_id", F.shiftleft("doc_id", IX.CHUNK_BITS) + F.col("chunk_idx"))


def test_chunk_ordinals_follow_doc_then_chunk_order(spark):
    counts = {5: 3, 1: 2, 70000: 4, 2: 0, 3: 1, (1 << 62) + 5: 2, (1 << 62) - 1: 3, -(1 << 62): 1}
    got = {(r.doc_id, r.chunk_idx): r.ordinal for r in IX.chunk_ordinals(_chunks(spark, counts), parts=4).collect()}
    order = sorted(got)
    assert [got[k] for k in order] == list(range(len(order)))


def test_append_cap_overshoots_to_batch_edge_and_resumes(spark, tmp_table):
    counts = {d: 3 for d in range(10)}                    # 30 chunks, ordinals 0..29
    ch = _chunks(spark, counts)
    path = tmp_table("append")
    nxt = IX.append_index(ch, path, resume=0, cap=5, batch=4)     # cap tested before each batch of 4 → 8 rows
    assert nxt == 8
    assert spark.read.parquet(path).count() == 8
    nxt = IX.append_index(ch, path, resume=nxt, cap=100, batch=4)
    assert nxt == 30
    back = spark.read.parquet(path)
    assert back.count() == 30 and back.select("chunk_id").distinct().count() == 30


def test_upsert_replaces_by_key_and_keeps_the_rest(spark):
    old = spark.createDataFrame([("a", 0, "old a0"), ("a", 1, "old a1"), ("b", 0, "old b0")],
                                "url string, chunk_idx int, text string")
    new = spark.createDataFrame([("a", 0, "new a0"), ("c", 0, "new c0")], "url string, chunk_idx int, text string")
    got = sorted(tuple(r) for r in IX.upsert_index(old, new).collect())
    assert got == [("a", 0, "new a0"), ("a", 1, "old a1"), ("b", 0, "old b0"), ("c", 0, "new c0")]


def test_running_sum_in_blocks_equals_cumsum(spark):
    rng = random.Random(4)
    rows = [(g, t, rng.randint(0, 9)) for g in range(3) for t in rng.sample(range(200), 40)]
    df = spark.createDataFrame(rows, "g long, t long, v long")
    got = {(r.g, r.t): r.cum for r in CM.running_sum(df, ["g"], "t", "v", "cum", width=16).collect()}
    for g in range(3):
        acc = 0
        for _, t, v in sorted(x for x in rows if x[0] == g):
            acc += v
            assert got[(g, t)] == acc


def test_next_row_across_blocks_equals_lead(spark):
    from pyspark.sql import Window

    rng = random.Random(8)
    rows = [(g, t, f"r{g}-{t}") for g in range(3) for t in sorted(rng.sample(range(300), 50))]
    df = spark.createDataFrame(rows, "g long, t long, v string")
    got = {(r.g, r.t): r.next_v for r in CM.next_row(df, ["g"], "t", ["v"], width=8).collect()}
    w = Window.partitionBy("g").orderBy("t")
    want = {(r.g, r.t): r.nv for r in df.select("g", "t", F.lead("v").over(w).alias("nv")).collect()}
    assert got == want


def test_chunk_ids_fail_where_they_would_share_numbers(spark):
    docs = spark.createDataFrame([((1 << 43) - 1, 3)], "doc_id long, chunk_idx int")
    assert docs.select(IX.chunk_id()).first()[0] == (((1 << 43) - 1) << 20) + 3
    for wrong in ((1 << 43, 0), ((1 << 62) + 1, 0), (-1, 0), (1, 1 << 20)):
        with pytest.raises(Exception, match="no room"):
            spark.createDataFrame([wrong], "doc_id long, chunk_idx int").select(IX.chunk_id()).collect()


def _pages(spark, pages):
    """Index rows of pages (doc_id, url, [texts])."""
    rows = [(d, i, t, u, 0, "t", "N/A", "N/A") for d, u, texts in pages for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_idx int, text string, url string, depth int, title string, model_num string, ps_num string")
    return IX.embed_chunks(df.withColumn("chunk_id", IX.chunk_id()))


def _files(path):
    return {os.path.join(root, f): os.path.getmtime(os.path.join(root, f)) for root, _, files in os.walk(path) for f in files if f.endswith(".parquet") and "_meta" not in root}


def test_keyed_merge_replaces_pages_and_rewrites_touched_buckets_only(spark, tmp_table):
    path = tmp_table("keyed")
    KX.write_keyed(_pages(spark, [(i, f"u{i}", [f"a{i}", f"b{i}", f"c{i}"]) for i in range(200)] + [(900, None, ["no url"])]), path, buckets=16)
    before = _files(path)
    batch = _pages(spark, [(3, "u3", ["new"]), (7, "u7", ["old version"]), (1007, "u7", ["x", "y"]), (901, None, ["other"])])
    touched = KX.merge(batch, path)
    assert 0 < len(touched) <= 3
    after = _files(path)
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    got = {}
    for r in KX.load_keyed(spark, path).collect():
        got.setdefault((r.url, r.doc_id), []).append((r.chunk_idx, r.text))
    assert got.pop(("u3", 3)) == [(0, "new")] and sorted(got.pop(("u7", 1007))) == [(0, "x"), (1, "y")]
    assert got.pop((None, 900)) == [(0, "no url")] and got.pop((None, 901)) == [(0, "other")]
    assert len(got) == 198 and all(sorted(v) == [(0, f"a{d}"), (1, f"b{d}"), (2, f"c{d}")] for (_, d), v in got.items())
    rows = KX.load_keyed(spark, path).drop("embedding").collect()
    KX.merge(batch, path)                                             # again: nothing changes
    assert sorted(map(repr, KX.load_keyed(spark, path).drop("embedding").collect())) == sorted(map(repr, rows))
    assert KX.merge(batch.filter("false"), path) == []


def test_a_stream_that_repeats_pages_equals_the_batch_merge(spark, tmp_table):
    from quarry.streaming import ingest as SI

    fields = [f.name for f in SI.PAGE_RECORD.fields]
    page = lambda i, text: (i, text, f"u{i}", 0, "t", "N/A", "N/A")
    batches = [[page(i, f"first text of {i} " * 90) for i in range(30)], [page(i, f"second {i}") for i in range(10, 20)] + [page(12, "second 12, sent twice")],
               [page(i, f"first text of {i} " * 90) for i in range(5)]]
    source, path, checkpoint = tmp_table("pages"), tmp_table("streamed"), tmp_table("ckpt")
    for rows in batches:
        spark.createDataFrame(rows, SI.PAGE_RECORD).coalesce(1).write.mode("append").parquet(source)
        SI.stream_ingest(spark, source, path, checkpoint, buckets=8).awaitTermination()
    view = lambda df: sorted(map(repr, df.select("chunk_id", "url", "chunk_idx", "text").collect()))
    last = {r[0]: r for rows in batches for r in sorted(rows)}
    whole = tmp_table("whole")
    pages = spark.createDataFrame(list(last.values()), SI.PAGE_RECORD).select(*fields)
    KX.merge(IX.embed_chunks(IX.chunk_rows(IX.compose_document(pages))), whole, buckets=8)
    assert view(KX.load_keyed(spark, path)) == view(KX.load_keyed(spark, whole))
    replayed = spark.createDataFrame([page(1, "a replay that must not count")], SI.PAGE_RECORD)
    assert not SI.merge_batch(replayed, 0, path, checkpoint)          # batch 0 stands in the ledger
    assert view(KX.load_keyed(spark, path)) == view(KX.load_keyed(spark, whole))


def test_append_job_cuts_texts_once(spark, monkeypatch):
    """Both appends read written chunks: no Python runs below what they are given."""
    from quarry.operators import index as IX
    from quarry.plans import queries

    docs = spark.createDataFrame([(i, f"text: page {i} " + "word " * 300, f"u{i}", 1, "t", "N/A", "N/A") for i in range(4)],
                                 "doc_id long, page_content string, url string, depth int, title string, model_num string, ps_num string")
    given, append = [], IX.append_index

    def seen(chunks, *args, **kw):
        given.append(chunks._jdf.queryExecution().optimizedPlan().toString())
        return append(chunks, *args, **kw)

    monkeypatch.setattr(queries, "page_documents", lambda t: docs)
    monkeypatch.setattr(IX, "append_index", seen)
    got = queries.REGISTRY["append_index"](spark, "").count()
    assert got == IX.chunk_rows(docs).count() and len(given) == 2
    assert not any("Python" in plan for plan in given)
