"""Budget rules: literal cases and seeded random comparison with plain-loop twins."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import context as CX


def docs_twin(base, tokens, budget):
    used, kept = base, []
    for i, t in enumerate(tokens):
        kept.append(i + 1)
        used += t
        if used > budget:
            break
    return kept


def prior_twin(turn_hits, budget):
    """turn_hits: list (oldest first) of lists of (rank, tokens); returns kept (turn_index, rank)."""
    used, kept = 0, []
    for i in range(len(turn_hits) - 1, -1, -1):
        docs = turn_hits[i][:2]
        if not docs:
            continue
        for rank, t in docs:
            kept.append((i, rank))
            used += t
            if used > budget:
                break
    return kept


def answers_twin(tokens, budget):
    used, kept = 0, []
    for i in range(len(tokens) - 1, -1, -1):
        kept.append(i)
        used += tokens[i]
        if used > budget:
            break
    return kept


def _docs(spark, base, tokens, budget):
    q = spark.createDataFrame([(1, 0, " ".join(["w"] * (base - 1)))], "conv_id long, turn long, query string")
    arts = spark.createDataFrame([(1, 0, r + 1, r, t, "p") for r, t in enumerate(tokens)],
                                 "conv_id long, turn long, rank int, chunk_id long, tokens int, piece string")
    out = CX.pack_documents(q, arts, intro="", token_budget=budget, reserved=0)
    return sorted(r.rank for r in out.collect())


def test_document_cut_literal(spark):
    # base 0, budget 10, tokens 6,6,6 -> first two kept (base 1 = "Question:" alone, budget shifted by 1)
    assert _docs(spark, 1, [6, 6, 6], 11) == [1, 2]


def test_documents_random(spark):
    rng = random.Random(3)
    for _ in range(15):
        base, budget = rng.randint(1, 20), rng.randint(0, 60)
        tokens = [rng.randint(0, 15) for _ in range(rng.randint(1, 8))]
        assert _docs(spark, base, tokens, budget) == docs_twin(base, tokens, budget)


def _prior(spark, turn_hits, budget):
    n = len(turn_hits)
    q = spark.createDataFrame([(1, i) for i in range(n + 1)], "conv_id long, turn long")
    rows = [(1, i, rank, i * 10 + rank, t, "p") for i, hs in enumerate(turn_hits) for rank, t in hs]
    r = spark.createDataFrame(rows, "conv_id long, turn long, rank int, chunk_id long, tokens int, piece string")
    out = CX.select_prior_hits(q, r, budget).filter(F.col("turn") == n)
    return sorted((x.src_turn, x.rank) for x in out.collect())


def test_prior_hits_literal(spark):
    # budget 10; newest first (8,8),(5,5),(5,5) -> kept 8,8 then 5 then 5
    got = _prior(spark, [[(1, 5), (2, 5)], [(1, 5), (2, 5)], [(1, 8), (2, 8)]], 10)
    assert got == [(0, 1), (1, 1), (2, 1), (2, 2)]


def test_prior_hits_random(spark):
    rng = random.Random(5)
    for _ in range(12):
        turn_hits = [[(r + 1, rng.randint(1, 9)) for r in range(rng.choice([0, 1, 2, 3]))] for _ in range(rng.randint(1, 6))]
        budget = rng.randint(0, 30)
        want = sorted((i, r) for i, r in prior_twin(turn_hits, budget) if r <= 2)
        assert _prior(spark, [[h for h in hs if h[0] <= 2] for hs in turn_hits], budget) == want


@pytest.mark.parametrize("strict", [False, True])
def test_prior_hits_of_a_long_conversation_in_cells(spark, monkeypatch, strict):
    """Every question of a conversation of many blocks, with gaps, turns without hits and budgets that cut."""
    monkeypatch.setattr(CX, "TURN_BLOCK", 4)
    rng = random.Random(11)
    turns = sorted(rng.sample(range(200), 45))
    hits = {t: [(r + 1, rng.randint(1, 9)) for r in range(rng.choice([0, 1, 2, 2]))] for t in turns}
    want = set()
    for t in turns:
        used = 0
        for h in reversed([x for x in turns if x < t]):
            for rank, n in hits[h]:
                if (used + n <= 30) if strict else (rank == 1 or used <= 30):
                    want.add((t, h, rank))
                used += n
    q = spark.createDataFrame([(c, t) for c in (1, 2) for t in turns], "conv_id long, turn long")
    rows = spark.createDataFrame([(1, t, r, 10 * t + r, n, f"p{t}") for t in turns for r, n in hits[t]],
                                 "conv_id long, turn long, rank int, chunk_id long, tokens int, piece string")
    got = CX.select_prior_hits(q, rows, 30, strict).collect()
    assert len(got) == len(want) and {(r.turn, r.src_turn, r.rank) for r in got} == want
    assert all(r.conv_id == 1 and r.piece == f"p{r.src_turn}" and r.chunk_id == 10 * r.src_turn + r.rank for r in got)


def test_prior_answers_random(spark):
    rng = random.Random(9)
    for _ in range(12):
        tokens = [rng.randint(1, 12) for _ in range(rng.randint(1, 7))]
        budget = rng.randint(1, 30)
        n = len(tokens)
        q = spark.createDataFrame([(1, i) for i in range(n + 1)], "conv_id long, turn long")
        r = spark.createDataFrame([(1, i, t, "p") for i, t in enumerate(tokens)],
                                  "conv_id long, turn long, tokens int, piece string")
        out = CX.select_prior_answers(q, r, budget).filter(F.col("turn") == n)
        assert sorted(x.src_turn for x in out.collect()) == sorted(answers_twin(tokens, budget))


def test_answer_history_pairs_next_assistant_turn(spark):
    c = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"),
                               (1, 3, "user", "q3"), (1, 4, "assistant", "a3")],
                              "conv_id long, turn long, role string, text string")
    got = sorted((r.turn, r.qa) for r in CX.answer_history(c).collect())
    assert got == [(0, "Question: q1\n\nAnswer: a1"), (3, "Question: q3\n\nAnswer: a3")]


def test_no_hit_answer(spark):
    q = spark.createDataFrame([(1, 0), (1, 1)], "conv_id long, turn long")
    h = spark.createDataFrame([(1, 0, 1, 5)], "conv_id long, turn long, rank int, chunk_id long")
    got = sorted((r.turn, r.answer) for r in CX.no_hit_answer(q, h).collect())
    assert got == [(0, None), (1, CX.NO_ANSWER)]


def test_hits_of_the_fallback_are_hits(spark, monkeypatch):
    from types import SimpleNamespace

    from quarry.plans import queries
    from quarry.plans.oracle import ORACLE

    q = spark.createDataFrame([(1, 0), (1, 1)], "conv_id long, turn long")
    h = spark.createDataFrame([(1, 0, True)], "conv_id long, turn long, fallback boolean")
    monkeypatch.setattr(queries, "Session", lambda *args: SimpleNamespace(questions=q, hits=h))
    got = sorted((r.turn, r.has_hits, r.answer) for r in queries.REGISTRY["no_hit_answer"](spark, "").collect())
    assert got == [(0, True, None), (1, False, CX.NO_ANSWER)]
    assert "not fallback" not in ORACLE["no_hit_answer"]


def test_bpe_tokenizer_plugin(spark):
    import os

    import pytest

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no local BPE table")
    from quarry.functions.tokens import BpeTokenizer

    tok = BpeTokenizer(path)
    texts = ["Hello world, this is a test.", "", "Prix: 12,50 € — très bien!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(CX.count_tokens(F.col("t"), tok).alias("n")).collect()]
    assert got == [len(tok.encode(t)) for t in texts]
    assert got[0] > 0 and got[1] == 0


def test_strict_budgets_cut_before_the_crossing_row(spark):
    q = spark.createDataFrame([(1, 0, "")], "conv_id long, turn long, query string")
    arts = spark.createDataFrame([(1, 0, r + 1, r, 6, "p") for r in range(3)],
                                 "conv_id long, turn long, rank int, chunk_id long, tokens int, piece string")
    # base = 1 ("Question:"), budget 11: 1+6 fits, 1+6+6 does not
    out = CX.pack_documents(q, arts, intro="", token_budget=11, reserved=0, strict=True)
    assert sorted(r.rank for r in out.collect()) == [1]
    qs = spark.createDataFrame([(1, i) for i in range(4)], "conv_id long, turn long")
    rows = spark.createDataFrame([(1, i, r, i * 10 + r, 5, "p") for i in range(3) for r in (1, 2)],
                                 "conv_id long, turn long, rank int, chunk_id long, tokens int, piece string")
    got = sorted((r.src_turn, r.rank) for r in CX.select_prior_hits(qs, rows, 10, strict=True)
                 .filter(F.col("turn") == 3).collect())
    assert got == [(2, 1), (2, 2)]


def test_channels_packed_together_equal_each_alone(spark):
    """Articles are read and ordered once for all channels; each cuts them by its own introduction."""
    q = spark.createDataFrame([(1, t, f"question {t}") for t in range(3)], "conv_id long, turn long, query string")
    a = spark.createDataFrame([(1, t, r, 10 * t + r, 400, f" article {t} {r}") for t in range(2) for r in range(1, 9)],
                              "conv_id long, turn long, rank int, chunk_id long, tokens int, piece string")
    prior = spark.createDataFrame([(1, 1, 0, 1, 1, 3, " earlier page")], "conv_id long, turn long, src_turn long, rank int, chunk_id long, tokens int, piece string")
    answers = spark.createDataFrame([(1, 1, 0, 3, " earlier answer")], "conv_id long, turn long, src_turn long, tokens int, piece string")
    intros = {"text": "short", "voice": "long " * 700}
    docs = CX.pack_documents(q, a, intros)
    got = CX.style_variant(CX.build_prompt(q, docs, prior, answers, intros))
    want = [tuple(r) for name, intro in intros.items() for r in CX.style_variant(
        CX.build_prompt(q, CX.pack_documents(q, a, intro), prior, answers, intro), name).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 4
    assert len({len(r[4].split("article")) for r in want}) == 2
