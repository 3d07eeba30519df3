"""Token-budgeted prompts per question: current hits, earlier hits, earlier answers.

Budget rules are closed forms over prefix sums (no row-by-row loop):

* documents — ranks in order, starting from the tokens of intro + question;
  a row is kept when it is rank 1 or the tokens before it fit the budget
  (the row that crosses the budget is kept, the next is not);
* earlier hits — earlier questions of the same conversation, newest first,
  their top 2 hits; rank 1 of every earlier question is always kept, rank 2
  only while the tokens before it fit 1,024;
* earlier answers — newest first, kept while the tokens before it fit 1,024.

``strict=True`` cuts before the crossing row instead.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import split_ws
from quarry.operators.common import join_small, next_row, running_sum

# Fixed value: reply when nothing is found.
NO_ANSWER = "I could not find a direct answer."
# System lines of each channel, and budgets (fixed values).
SYSTEM_TEXT = "Base every statement on the pages supplied with the question."
SYSTEM_VOICE = ("Base every statement on the pages supplied with the question. The reply will be read aloud: "
                "short plain sentences, nothing that only works in print.")
#: Turns on each side of a cell where first hits meet later questions.
TURN_BLOCK = 512
TOKEN_BUDGET, PRIOR_HITS_BUDGET, PRIOR_ANSWERS_BUDGET, PRIOR_HITS_PER_TURN = 4096, 1024, 1024, 2

# Default introductions: what the packed prompt holds and how to reply.  Callers may pass their own.
INTRO_TEXT = ("Context for the next question: retrieved pages first, then pages and replies from this conversation. "
              f'Reply from this context and give the page URLs. Without a fitting page, reply "{NO_ANSWER}"')
INTRO_VOICE = ("Context for the next question: retrieved pages first, then pages and replies from this conversation. "
               f'Reply from this context in one or two spoken sentences, no URLs. Without a fitting page, reply "{NO_ANSWER}"')
INTROS = {"text": (INTRO_TEXT, SYSTEM_TEXT), "voice": (INTRO_VOICE, SYSTEM_VOICE)}

QKEY = ["conv_id", "turn"]


# --- tokens -----------------------------------------------------------------------------

def count_tokens(text: Column, tokenizer=None) -> Column:
    """Tokens of a string.  Default: white-space words (native).  A tokenizer
    object with ``encode(str) -> list`` runs as a pandas UDF instead."""
    if tokenizer is None:
        return F.size(split_ws(F.coalesce(text, F.lit("")))).cast("int")

    @F.pandas_udf(T.IntegerType())
    def n_tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda v: 0 if v is None else len(tokenizer.encode(v))).astype("int32")

    return n_tokens(text)


# --- pieces -----------------------------------------------------------------------------

def fmt4(x: Column) -> Column:
    """Fixed 4-decimal rendering of a non-negative double, identical on every engine."""
    n = F.round(x * 10000).cast("long")
    return F.concat((n / 10000).cast("long").cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))


def article(text: Column, url: Column, score: Column) -> Column:
    return F.concat(F.lit('\n\nWebpage:\n"""\n'), text, F.lit("\nSource: "), url, F.lit("\nScore: "), fmt4(score),
                    F.lit('\n"""'))


def prior_article(text: Column, url: Column) -> Column:
    return F.concat(F.lit('\n\nEarlier webpage:\n"""\n'), text, F.lit("\nSource: "), url, F.lit('\n"""'))


def prior_answer(qa: Column) -> Column:
    return F.concat(F.lit('\n\nEarlier question and answer:\n"""\n'), qa, F.lit('\n"""'))


def question_piece(query: Column) -> Column:
    return F.concat(F.lit("\n\nQuestion: "), query)


def answer_record(question: Column, answer: Column) -> Column:
    """What the answer history stores for one answered question."""
    return F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer: "), answer)


def hit_text(hits: DataFrame, index: DataFrame, bound: int | None = None) -> DataFrame:
    """Hits with their chunk text and URL: the index streams past the broadcast hits once."""
    return join_small(index.select("chunk_id", "text", "url"), hits, "chunk_id", bound=bound)


def hit_articles(hits: DataFrame, index: DataFrame, tokenizer=None) -> DataFrame:
    """Hits joined with their chunk text and URL (only the ≤k winners are joined)."""
    j = hits if "text" in hits.columns else join_small(index.select("chunk_id", "text", "url"), hits, "chunk_id")
    piece = article(F.col("text"), F.col("url"), F.col("score"))
    return j.withColumn("piece", piece).withColumn("tokens", count_tokens(F.col("piece"), tokenizer))


# --- budget rules -----------------------------------------------------------------------

def pack_documents(questions: DataFrame, articles: DataFrame, intro: str | dict = INTRO_TEXT,
                   token_budget: int = TOKEN_BUDGET, reserved: int = PRIOR_HITS_BUDGET + PRIOR_ANSWERS_BUDGET,
                   strict: bool = False, tokenizer=None) -> DataFrame:
    """Kept current-question articles: ``conv_id, turn, rank, chunk_id, tokens, piece``.

    With the introductions of several channels (name → text) the articles are read and
    ordered once for all; ``channels`` names those that keep a row.
    """
    intros = list(intro.values()) if isinstance(intro, dict) else [intro]
    base = questions.select(*QKEY, *[count_tokens(F.concat(F.lit(x), question_piece(F.col("query"))), tokenizer).alias(f"__base{i}")
                                     for i, x in enumerate(intros)])
    w = Window.partitionBy(*QKEY).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    a = articles.join(base, QKEY).withColumn("__before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    budget = token_budget - reserved

    def keep(i):
        before = F.col(f"__base{i}") + F.col("__before")
        return before + F.col("tokens") <= budget if strict else (F.col("rank") == 1) | (before <= budget)

    if not isinstance(intro, dict):
        return a.filter(keep(0)).select(*QKEY, "rank", "chunk_id", "tokens", "piece")
    channels = F.array_compact(F.array(*[F.when(keep(i), F.lit(name)) for i, name in enumerate(intro)]))
    return a.withColumn("channels", channels).filter(F.size("channels") > 0).select(*QKEY, "rank", "chunk_id", "tokens", "piece", "channels")


def _turn_totals(questions: DataFrame, rows: DataFrame, value: str, out: str) -> DataFrame:
    """Per question turn: its own total and the running total up to and including it."""
    per_turn = rows.groupBy(*QKEY).agg(F.sum(value).alias("__t"))
    t = questions.select(*QKEY).join(per_turn, QKEY, "left").fillna(0, ["__t"])
    return running_sum(t, ["conv_id"], "turn", "__t", out)


def prior_hit_rows(history: DataFrame, index: DataFrame, per_turn: int = PRIOR_HITS_PER_TURN,
                   tokenizer=None) -> DataFrame:
    """Each question's top hits as earlier-webpage pieces: ``conv_id, turn, rank, chunk_id, tokens, piece``."""
    h = history.filter(F.col("rank") <= per_turn)
    if "text" not in h.columns:
        h = join_small(index.select("chunk_id", "text", "url"), h, "chunk_id")
    h = h.withColumn("piece", prior_article(F.col("text"), F.col("url")))
    return h.select(*QKEY, "rank", "chunk_id", count_tokens(F.col("piece"), tokenizer).alias("tokens"), "piece")


def select_prior_hits(questions: DataFrame, rows: DataFrame, budget: int = PRIOR_HITS_BUDGET,
                      strict: bool = False) -> DataFrame:
    """Earlier hits kept for each question: ``conv_id, turn, src_turn, rank, chunk_id, tokens, piece``.

    Tokens before row (h, r) for question t, newest first, are
    ``A(t−) − P`` with ``A`` the running per-turn total of the conversation and
    ``P = A(h) − R(h, r)`` the row's place (``R``: the turn's tokens of lower
    ranks), so the rule is a row filter with no per-question window.  Rows
    within the budget lie in the band ``[A(t−) − budget, A(t−)]`` of places and
    are joined by band, as earlier answers are.  First hits, which every later
    question keeps, are joined by pairs of turn blocks: a conversation of any
    length spreads over cells of at most ``TURN_BLOCK`` × ``TURN_BLOCK`` turns.
    """
    tot = _turn_totals(questions, rows, "tokens", "__A")          # __A: through this turn, __t: this turn
    wr = Window.partitionBy(*QKEY).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    h = (rows.join(tot.select(*QKEY, "__A"), QKEY)
         .withColumn("__P", F.col("__A") - F.coalesce(F.sum("tokens").over(wr), F.lit(0))).drop("__A"))
    q = tot.select("conv_id", F.col("turn").alias("__qt"), (F.col("__A") - F.col("__t")).alias("__prev"))

    # by band: all rows in the strict form, those after a turn's first otherwise
    size = max(int(budget), 1)
    band = (h if strict else h.filter(F.col("rank") > 1)).withColumn("__b", F.floor(F.col("__P") / size))
    qb = q.withColumn("__b", F.explode(F.sequence(F.floor((F.col("__prev") - budget) / size), F.floor(F.col("__prev") / size))))
    before = F.col("__prev") - F.col("__P")
    near = (before + F.col("tokens") <= budget) if strict else (before <= budget)
    kept = _cell_join(band, qb, ["conv_id", "__b"]).filter(near)
    if not strict:
        kept = kept.unionByName(_cell_join(*_turn_cells(h.filter(F.col("rank") == 1), q), ["conv_id", "__hb", "__qb"]))
    return kept.select("conv_id", F.col("__qt").alias("turn"), F.col("turn").alias("src_turn"),
                       "rank", "chunk_id", "tokens", "piece")


def _cell_join(h: DataFrame, q: DataFrame, on) -> DataFrame:
    """Rows of earlier turns with the questions after them, by cell."""
    cols = ["turn", "rank", "chunk_id", "tokens", "piece", "__P"]
    return (h.select(*on, *cols).join(q.select(*on, "__qt", "__prev"), on).filter(F.col("turn") < F.col("__qt"))
            .select("conv_id", *cols, "__qt", "__prev"))


def _turn_cells(h: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides once for each cell (block of earlier turns, block of later or equal turns) they meet in.

    Only blocks that hold rows make cells, so sparse turn numbers cost nothing.
    """
    hb, qb = F.floor(F.col("turn") / TURN_BLOCK), F.floor(F.col("__qt") / TURN_BLOCK)
    h, q = h.withColumn("__hb", hb), q.withColumn("__qb", qb)
    cells = (h.select("conv_id", "__hb").distinct().join(q.select("conv_id", "__qb").distinct(), "conv_id")
             .filter(F.col("__hb") <= F.col("__qb")))
    return h.join(cells, ["conv_id", "__hb"]), q.join(cells, ["conv_id", "__qb"])


def pack_prior_hits(questions: DataFrame, history: DataFrame, index: DataFrame,
                    budget: int = PRIOR_HITS_BUDGET, per_turn: int = PRIOR_HITS_PER_TURN,
                    strict: bool = False, tokenizer=None) -> DataFrame:
    """Earlier hits kept for each question; ``history`` holds every question's hit list."""
    return select_prior_hits(questions, prior_hit_rows(history, index, per_turn, tokenizer), budget, strict)


def answer_rows(answers: DataFrame, tokenizer=None) -> DataFrame:
    """Stored answers as pieces: ``conv_id, turn, tokens, piece`` (tokens of the answer text only)."""
    return answers.select(*QKEY, count_tokens(F.col("qa"), tokenizer).alias("tokens"),
                          prior_answer(F.col("qa")).alias("piece"))


def select_prior_answers(questions: DataFrame, rows: DataFrame, budget: int = PRIOR_ANSWERS_BUDGET,
                         strict: bool = False) -> DataFrame:
    """Earlier answers kept for each question: ``conv_id, turn, src_turn, tokens, piece``.

    Kept answers form a contiguous band of cumulative tokens
    ``[prev − budget, prev]``, so the join is bucketed on that band: each
    question meets at most two buckets of answers, never the whole conversation.
    """
    tot = _turn_totals(questions, rows, "tokens", "__C")
    a = rows.join(tot.select(*QKEY, "__C"), QKEY).withColumn("__b", F.floor(F.col("__C") / budget))
    q = tot.select("conv_id", F.col("turn").alias("__qt"), (F.col("__C") - F.col("__t")).alias("__prev"))
    q = q.withColumn("__b", F.explode(F.sequence(F.floor((F.col("__prev") - budget) / budget),
                                                  F.floor(F.col("__prev") / budget))))
    j = a.join(q, ["conv_id", "__b"]).filter(F.col("turn") < F.col("__qt"))
    before = F.col("__prev") - F.col("__C")
    keep = (before + F.col("tokens") <= budget) if strict else (before <= budget)
    return j.filter(keep).select("conv_id", F.col("__qt").alias("turn"), F.col("turn").alias("src_turn"),
                                 "tokens", "piece")


def pack_prior_answers(questions: DataFrame, answers: DataFrame, budget: int = PRIOR_ANSWERS_BUDGET,
                       strict: bool = False, tokenizer=None) -> DataFrame:
    return select_prior_answers(questions, answer_rows(answers, tokenizer), budget, strict)


# --- prompt -----------------------------------------------------------------------------

def build_prompt(questions: DataFrame, docs: DataFrame, prior: DataFrame, answers: DataFrame,
                 intro: str | dict = INTRO_TEXT, tokenizer=None) -> DataFrame:
    """Intro, articles, earlier articles, earlier answers, question — one string per question.

    Only questions with at least one kept article get a prompt (the others get
    the fixed reply, see ``no_hit_answer``).  With the introductions of several channels
    (name → text; ``docs`` with their ``channels``) one string per question and ``channel``;
    the pieces are gathered once for all.
    """
    several = isinstance(intro, dict)

    def part(df, sec, k1, k2):
        c = [F.col("channels").alias("c") if "channels" in df.columns else F.lit(None).cast("array<string>").alias("c")] if several else []
        return df.select(*QKEY, F.struct(F.lit(sec).alias("s"), k1.cast("long").alias("a"),
                                         k2.cast("long").alias("b"), F.col("piece").alias("p"), *c).alias("x"))

    q = questions.select(*QKEY, "query")
    opening = F.lit(intro) if not several else F.lit("")
    pieces = (part(q.withColumn("piece", opening), 0, F.lit(0), F.lit(0))
              .unionByName(part(docs, 1, F.col("rank"), F.lit(0)))
              .unionByName(part(prior, 2, -F.col("src_turn"), F.col("rank")))
              .unionByName(part(answers, 3, -F.col("src_turn"), F.lit(0)))
              .unionByName(part(q.withColumn("piece", question_piece(F.col("query"))), 4, F.lit(0), F.lit(0))))
    xs = F.array_sort(F.collect_list("x"))
    agg = pieces.groupBy(*QKEY).agg(xs.alias("__xs"))
    if several:
        # the places of the introductions are taken by each channel's own; a piece without channels is in all
        agg = agg.select(*QKEY, "__xs", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("i")) for n, x in intro.items()])).alias("__c"))
        here = F.filter("__xs", lambda x: x["c"].isNull() | F.array_contains(x["c"], F.col("__c")["n"]))
        agg = agg.select(*QKEY, F.col("__c")["n"].alias("channel"), F.transform(
            here, lambda x: x.withField("p", F.when(x["s"] == 0, F.col("__c")["i"]).otherwise(x["p"]))).alias("__xs"))
    # a question gets a prompt only when it has at least one article (rank 1 is always kept)
    agg = agg.filter(F.exists("__xs", lambda x: x["s"] == 1)).select(
        *QKEY, *(["channel"] if several else []), F.array_join(F.transform("__xs", lambda x: x["p"]), "").alias("prompt"))
    out = q.join(agg, QKEY)
    return out.withColumn("tokens_used", count_tokens(F.col("prompt"), tokenizer))


def no_hit_answer(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions without any hit (even after the fallback) get the fixed reply."""
    has = hits.select(*QKEY).distinct().withColumn("has_hits", F.lit(True))
    j = questions.select(*QKEY).join(has, QKEY, "left").fillna(False, ["has_hits"])
    return j.withColumn("answer", F.when(~F.col("has_hits"), F.lit(NO_ANSWER)))


def style_variant(prompts: DataFrame, channel: str | None = None) -> DataFrame:
    """Chat messages for a channel: ``system`` line and ``user`` prompt; without one, for each prompt's own ``channel``."""
    if channel is None:
        name = F.col("channel")
        system = F.coalesce(*[F.when(name == c, F.lit(line)) for c, (_, line) in INTROS.items()])
    else:
        name, system = F.lit(channel), F.lit(INTROS[channel][1])
    return prompts.select(*QKEY, name.alias("channel"), system.alias("system"), F.col("prompt").alias("user"))


def answer_history(conversations: DataFrame) -> DataFrame:
    """``Question: …\\n\\nAnswer: …`` for every user turn answered by the next assistant turn."""
    z = next_row(conversations.select(*QKEY, "role", "text"), ["conv_id"], "turn", ["role", "text"], "__n_")
    return z.filter((F.col("role") == "user") & (F.col("__n_role") == "assistant")).select(
        *QKEY, answer_record(F.col("text"), F.col("__n_text")).alias("qa"))
