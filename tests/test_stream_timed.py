"""Event-time session lists: any order of arrival gives the batch rows, state ends with the conversation."""

import datetime as dt
import random

import pytest

from quarry.operators import context as CX
from quarry.streaming import timed as TM

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minute):
    return START + dt.timedelta(minutes=minute)


def drain(spark, src, sink, ckpt, **kw):
    """One run over what has arrived; state rows after it."""
    stream = spark.readStream.schema(TM.TIMED).parquet(src)
    with TM.state_store(spark):
        q = (TM.stream_context_timed(stream, **kw).writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).outputMode("append").start())
        q.awaitTermination()
    return q.lastProgress.stateOperators[0].numRowsTotal


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    events = []
    for conv in range(3):
        for turn in range(9):
            hits = [(r, conv * 100 + turn * 10 + r, rng.randint(100, 700)) for r in (1, 2, 3) if rng.random() < 0.8]
            events.append((conv, turn, hits or None, rng.randint(100, 600) if hits else None, at(turn)))
    return events


def batch_rows(spark, events):
    hits = spark.createDataFrame([(c, t, r, k, n, "p") for c, t, hs, _, _ in events for r, k, n in hs or [] if r <= CX.PRIOR_HITS_PER_TURN],
                                 "conv_id long, turn long, rank int, chunk_id long, tokens int, piece string")
    answers = spark.createDataFrame([(c, t, a, "p") for c, t, _, a, _ in events if a is not None], "conv_id long, turn long, tokens int, piece string")
    questions = spark.createDataFrame([(c, t) for c, t, *_ in events], "conv_id long, turn long")
    want = [(r.conv_id, r.turn, "hit", r.src_turn, r.rank) for r in CX.select_prior_hits(questions, hits).collect()]
    return sorted(want + [(r.conv_id, r.turn, "answer", r.src_turn, 0) for r in CX.select_prior_answers(questions, answers).collect()])


def rows(spark, sink):
    return sorted((r.conv_id, r.turn, r.section, r.src_turn, r.rank or 0) for r in spark.read.schema(TM.OUT).parquet(sink).collect())


def test_shuffled_arrival_equals_batch_and_state_ends(spark, tmp_table, conversations):
    src, sink, ckpt = tmp_table("timed-src"), tmp_table("timed-out"), tmp_table("timed-ckpt")
    rng = random.Random(9)
    order = sorted(conversations, key=lambda e: e[1] + rng.choice((0, 1, 2)))  # up to two turns out of order
    order += rng.sample(order, 4)  # delivered twice: waiting, or late by then
    order = [*order, (7, None, None, 5, at(3)), (7, 2, [(1, 1, 5)], 5, None)]  # no turn, no time: nothing is packed
    for third in (order[:10], order[10:18], order[18:]):
        spark.createDataFrame(third, TM.TIMED).coalesce(1).write.mode("append").parquet(src)
        left = drain(spark, src, sink, ckpt, delay="20 minutes", idle=600)
        assert left > 0
    assert rows(spark, sink) == []  # the watermark has passed nobody's first turn
    spark.createDataFrame([(None, 0, None, None, at(60))], TM.TIMED).write.mode("append").parquet(src)
    assert drain(spark, src, sink, ckpt, delay="20 minutes", idle=600) == 0
    assert rows(spark, sink) == batch_rows(spark, conversations)


def test_turns_leave_as_the_watermark_passes_and_late_ones_are_dropped(spark, tmp_table, conversations):
    src, sink, ckpt = tmp_table("timed-src"), tmp_table("timed-out"), tmp_table("timed-ckpt")
    late = [e for e in conversations if e[:2] == (0, 1)]
    on_time = [e for e in conversations if e[:2] != (0, 1)]
    for part in (on_time, late, [(None, 0, None, None, at(600))]):
        spark.createDataFrame(part, TM.TIMED).write.mode("append").parquet(src)
        left = drain(spark, src, sink, ckpt, delay="2 minutes", idle=60)
        if part is on_time:  # turns up to 6 left, 7 and 8 wait
            assert {r[1] for r in rows(spark, sink)} == {1, 2, 3, 4, 5, 6}
    assert left == 0
    assert rows(spark, sink) == batch_rows(spark, on_time)


def test_settings_of_the_session_come_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), TM.state_store(spark):
        assert spark.conf.get(key) == TM.PROVIDER
        raise RuntimeError
    assert spark.conf.get(key) == before
