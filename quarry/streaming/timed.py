"""Session lists in event time: turns may arrive in any order within the watermark's delay.

Input: the events of ``streaming.context`` plus ``ts``, the time of the turn; within a
conversation time grows with the turn.  A turn waits in state until the watermark
passes its time: then every earlier turn has come, or is late and Spark drops it.  So the
rows are those of the batch packers whatever the order of arrival, and a turn delivered
twice counts once.  Kept hits and answers are trimmed to what the budgets can still use;
a conversation without a turn for ``idle`` seconds of event time leaves the state (the
state store's own time-to-live counts processing time, so a timer does it).

A row without a conversation, turn or time packs nothing; one without a conversation
still moves the watermark, so a source can close its stream with one.  The watermark starts
in 1970, so Spark drops turns of that moment or before as late.  Needs the RocksDB
state store (``state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from quarry.operators.context import PRIOR_ANSWERS_BUDGET, PRIOR_HITS_BUDGET, PRIOR_HITS_PER_TURN
from quarry.streaming.context import EVENT, HIT, OUT, _ordered, _step

TIMED = T.StructType([*EVENT.fields, T.StructField("ts", T.TimestampType())])
WAIT = T.StructType([T.StructField("ms", T.LongType()), T.StructField("hits", T.ArrayType(HIT)), T.StructField("answer_tokens", T.IntegerType())])
KEPT_HIT = T.StructType([T.StructField("turn", T.LongType()), T.StructField("rank", T.IntegerType()),
                         T.StructField("chunk_id", T.LongType()), T.StructField("tokens", T.IntegerType())])
KEPT_ANSWER = T.StructType([T.StructField("turn", T.LongType()), T.StructField("tokens", T.IntegerType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class ContextProcessor(StatefulProcessor):
    """Waiting turns by number, kept hits and answers, and the time at which the conversation ends."""

    def __init__(self, hits_budget: int, answers_budget: int, per_turn: int, idle: int) -> None:
        self.budgets, self.per_turn, self.idle_ms = (hits_budget, answers_budget), per_turn, idle * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("turn", T.LongType())]), WAIT)
        self.hits = handle.getListState("hits", KEPT_HIT)
        self.answers = handle.getListState("answers", KEPT_ANSWER)
        self.end = handle.getValueState("end", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        last = None
        for r in rows:
            if r.turn is None or r.ts is None:
                continue
            ms = round(r.ts.timestamp() * 1000)
            hits = [(h["rank"], h["chunk_id"], h["tokens"]) for h in r.hits or [] if h["rank"] <= self.per_turn]
            self.waiting.updateValue((r.turn,), (ms, hits, r.answer_tokens))
            self.handle.registerTimer(ms)
            last = ms if last is None else max(last, ms)
        if last is not None:
            end = self.end.get()
            if end is None or end[0] < last + self.idle_ms:
                if end is not None:
                    self.handle.deleteTimer(end[0])
                self.end.update((last + self.idle_ms,))
                self.handle.registerTimer(last + self.idle_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator() if v[0] <= now)
        out: list = []
        if due:
            hits, answers = [tuple(h) for h in self.hits.get()], [tuple(a) for a in self.answers.get()]
            for turn, (_, found, answer) in due:
                hits, answers = _step(key[0], turn, _ordered(hits), answers, *self.budgets, out)
                hits += [(turn, *h) for h in found]
                answers += [] if answer is None else [(turn, answer)]
                self.waiting.removeKey((turn,))
            for state, kept in ((self.hits, _ordered(hits)), (self.answers, answers)):
                state.put(kept) if kept else state.clear()
        end = self.end.get()
        if end is not None and end[0] <= now:
            for state in (self.hits, self.answers, self.end):
                state.clear()
        for row in out:
            yield Row(**dict(zip(OUT.names, row)))

    def close(self) -> None:
        pass


def stream_context_timed(events: DataFrame, delay: str = "10 minutes", idle: int = 86_400, hits_budget: int = PRIOR_HITS_BUDGET,
                         answers_budget: int = PRIOR_ANSWERS_BUDGET, per_turn: int = PRIOR_HITS_PER_TURN) -> DataFrame:
    """Earlier hits and answers of each question of a stream of ``TIMED`` events.

    ``delay``: how far a turn may come after a later one; ``idle``: seconds of event
    time after which a conversation has ended.
    """
    return events.withWatermark("ts", delay).groupBy("conv_id").transformWithState(
        ContextProcessor(hits_budget, answers_budget, per_turn, idle), OUT, "append", "eventTime")
