"""Memory of Python workers follows neither the rows of a partition nor the words of the input."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import embed


def test_batches_are_cut_by_bytes(spark):
    @F.pandas_udf("int")
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([len(s)] * len(s))

    texts = spark.range(2000).coalesce(1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    assert texts.select(rows("text").alias("n")).agg(F.max("n")).first()[0] <= session.BATCH_BYTES // 10_000 + 1


def test_a_session_keeps_its_own_bound(spark):
    other, key = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    other.conf.set(key, "1m")
    session.bound_batches(other)
    assert other.conf.get(key) == "1m"


def test_remembered_words_are_bounded(monkeypatch):
    words = " ".join(f"w{i}" for i in range(50))
    want = embed.HashEmbedder().encode([words, "a b a"])
    monkeypatch.setattr(embed, "CACHED_WORDS", 5)
    few = embed.HashEmbedder()
    assert (few.encode([words, "a b a"]) == want).all() and len(few._cache) == 5


def test_words_are_pythons(spark):
    """Cheap ranges decide before the list of white space does, with Python's words and runs."""
    from quarry.functions import text as TX

    odd = [chr(c) for lo, hi in TX.WHITESPACE_RANGES for c in range(lo - 1, hi + 2) if c] + ["!", "~", "\u00a1", "\u167f", "\u3001", "\U0010ffff", "\U0001f600"]
    texts = [f"{x}a{x}{x} b\n{x}c{x}" for x in odd] + ["", " ", "\n \n", "".join(odd)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string").select("i", TX.split_ws(F.col("t")).alias("w"), TX.collapse_whitespace(F.col("t")).alias("c")).collect()
    assert {r.i: r.w for r in rows} == dict(enumerate([*(t.split() for t in texts), None]))
    assert {r.i: r.c for r in rows if r.i < len(texts)} == {i: re.sub(r"[\s\x1c-\x1f]+", " ", t) for i, t in enumerate(texts)}
    assert all("[[^!-~" in f(F.col("t"))._jc.toString() for f in (TX.split_ws, TX.collapse_whitespace))
