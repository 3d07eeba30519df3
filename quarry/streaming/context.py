"""Live form of the session lists: per-conversation state, question by question.

Input: one row per answered-or-not question turn, arriving in turn order per
conversation: ``conv_id, turn, hits ARRAY<STRUCT<rank, chunk_id, tokens>>``
(the turn's top hits with their earlier-webpage token counts) and
``answer_tokens`` (tokens of the turn's stored Question/Answer, NULL when none).

Output: for each question, the earlier hits and answers its prompt keeps —
the same rows as the batch ``pack_prior_hits`` / ``pack_prior_answers``.
State is trimmed to what the budgets can still use: an answer or a rank-2
hit whose preceding tokens already exceed the budget is never used again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from quarry.operators.context import PRIOR_ANSWERS_BUDGET, PRIOR_HITS_BUDGET, PRIOR_HITS_PER_TURN

HIT = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("chunk_id", T.LongType()),
                    T.StructField("tokens", T.IntegerType())])
EVENT = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("hits", T.ArrayType(HIT)), T.StructField("answer_tokens", T.IntegerType()),
])
OUT = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("section", T.StringType()), T.StructField("src_turn", T.LongType()),
    T.StructField("rank", T.IntegerType()), T.StructField("chunk_id", T.LongType()),
    T.StructField("tokens", T.IntegerType()),
])
# state: earlier hits (turn, rank, chunk_id, tokens) newest last, earlier answers (turn, tokens)
STATE = T.StructType([
    T.StructField("h_turn", T.ArrayType(T.LongType())), T.StructField("h_rank", T.ArrayType(T.IntegerType())),
    T.StructField("h_chunk", T.ArrayType(T.LongType())), T.StructField("h_tok", T.ArrayType(T.IntegerType())),
    T.StructField("a_turn", T.ArrayType(T.LongType())), T.StructField("a_tok", T.ArrayType(T.IntegerType())),
])


def _step(conv, turn, hits_state, ans_state, hb, ab, out):
    """Emit kept earlier rows for question ``turn``; return trimmed state lists."""
    used, keep_h, later_h, later_a = 0, [], [], []
    for i in range(len(hits_state) - 1, -1, -1):           # newest turn first, rank order within a turn
        h_turn, rank, chunk, tok = hits_state[i]
        if h_turn >= turn:  # this question came late: what later turns brought is not its context
            later_h.append(hits_state[i])
            continue
        if rank == 1 or used <= hb:
            out.append((conv, turn, "hit", h_turn, rank, chunk, tok))
            keep_h.append(hits_state[i])
        used += tok
    used, keep_a = 0, []
    for i in range(len(ans_state) - 1, -1, -1):
        a_turn, tok = ans_state[i]
        if a_turn >= turn:
            later_a.append(ans_state[i])
            continue
        if used <= ab:
            out.append((conv, turn, "answer", a_turn, None, None, tok))
            keep_a.append(ans_state[i])
        used += tok
    if later_h or later_a:  # a late turn doesn't trim the state of the turns after it
        return hits_state, ans_state
    # rows skipped now can never be kept later (their preceding total only grows)
    return keep_h[::-1], keep_a[::-1]


def _ordered(hits_state):
    """Newest turn last; within a turn rank 2 before rank 1 so reversed iteration is (turn desc, rank asc)."""
    return sorted(hits_state, key=lambda r: (r[0], -r[1]))


def context_fn(hits_budget: int = PRIOR_HITS_BUDGET, answers_budget: int = PRIOR_ANSWERS_BUDGET,
               per_turn: int = PRIOR_HITS_PER_TURN):
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        conv = int(key[0])
        if state.exists:
            s = state.get
            hits_state = list(zip(s[0], s[1], s[2], s[3]))
            ans_state = list(zip(s[4], s[5]))
        else:
            hits_state, ans_state = [], []
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values("turn")
        out: list = []
        for r in rows.itertuples(index=False):
            turn = int(r.turn)
            hits_state, ans_state = _step(conv, turn, _ordered(hits_state), ans_state, hits_budget, answers_budget, out)
            hs = r.hits if r.hits is not None else []
            for h in sorted(hs, key=lambda x: x["rank"]):
                if h["rank"] <= per_turn:
                    hits_state.append((turn, int(h["rank"]), int(h["chunk_id"]), int(h["tokens"])))
            if r.answer_tokens is not None and not pd.isna(r.answer_tokens):
                ans_state.append((turn, int(r.answer_tokens)))
                ans_state.sort()
        hs = _ordered(hits_state)
        state.update(([t for t, _, _, _ in hs], [k for _, k, _, _ in hs], [c for _, _, c, _ in hs],
                      [x for _, _, _, x in hs], [t for t, _ in ans_state], [x for _, x in ans_state]))
        yield pd.DataFrame(out, columns=[f.name for f in OUT.fields])

    return fn


def stream_context(events: DataFrame, **kw) -> DataFrame:
    """Keyed stateful operator over a (streaming or batch) event DataFrame."""
    return events.groupBy("conv_id").applyInPandasWithState(
        context_fn(**kw), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
