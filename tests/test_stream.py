"""Keyed streaming state equals the batch packers; streamed ingest equals batch build."""

import random

from pyspark.sql import functions as F

from quarry.operators import context as CX
from quarry.streaming import context as SC


def test_stream_context_equals_batch(spark, tmp_table):
    rng = random.Random(11)
    events, hit_rows, ans_rows = [], [], []
    for conv in range(4):
        for turn in range(7):
            hits = [(r, conv * 100 + turn * 10 + r, rng.randint(100, 700)) for r in (1, 2) if rng.random() < 0.8]
            at = rng.randint(100, 600) if hits else None
            events.append((conv, turn, hits, at))
            hit_rows += [(conv, turn, r, c, t, "p") for r, c, t in hits]
            if at is not None:
                ans_rows.append((conv, turn, at, "p"))
    src, sink = tmp_table("ctx-src"), tmp_table("ctx-out")
    ev = spark.createDataFrame(events, SC.EVENT)
    ev.filter(F.col("turn") <= 2).write.parquet(src)
    stream = spark.readStream.schema(SC.EVENT).parquet(src)
    q = (SC.stream_context(stream).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", tmp_table("ctx-ckpt")).outputMode("append").start())
    q.processAllAvailable()
    ev.filter(F.col("turn") > 2).write.mode("append").parquet(src)   # later turns arrive later
    q.processAllAvailable()
    q.stop()
    got = sorted((r.conv_id, r.turn, r.section, r.src_turn, r.rank) for r in spark.read.parquet(sink).collect())

    questions = ev.select("conv_id", "turn")
    hr = spark.createDataFrame(hit_rows, "conv_id long, turn long, rank int, chunk_id long, tokens int, piece string")
    ar = spark.createDataFrame(ans_rows, "conv_id long, turn long, tokens int, piece string")
    want = [(r.conv_id, r.turn, "hit", r.src_turn, r.rank) for r in CX.select_prior_hits(questions, hr).collect()]
    want += [(r.conv_id, r.turn, "answer", r.src_turn, None) for r in CX.select_prior_answers(questions, ar).collect()]
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3], x[4] or 0))
