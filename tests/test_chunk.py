"""Chunk rule: closed form vs a plain-loop twin of the published merge loop."""

import random

from quarry.operators.chunk import chunk_documents, split_text


def loop_twin(text, size, overlap, sep):
    words = [w for w in text.split(sep) if w != ""]
    d, out, cur, total = len(sep), [], [], 0
    for w in words:
        if total + len(w) + (d if cur else 0) > size:
            if cur:
                c = sep.join(cur).strip()
                if c:
                    out.append(c)
                while total > overlap or (total + len(w) + (d if cur else 0) > size and total > 0):
                    total -= len(cur[0]) + (d if len(cur) > 1 else 0)
                    cur = cur[1:]
        cur.append(w)
        total += len(w) + (d if len(cur) > 1 else 0)
    c = sep.join(cur).strip()
    if c:
        out.append(c)
    return out


def random_text(rng, sep):
    n = rng.randint(0, 60)
    pieces = []
    for _ in range(n):
        k = rng.choice([0, 1, 2, 3, 5, 8, 13, 40])
        pieces.append("".join(rng.choice("ab\n c") for _ in range(k)))
    return sep.join(pieces)


def test_closed_form_equals_loop():
    rng = random.Random(7)
    for _ in range(4000):
        sep = rng.choice([" ", "\n\n"])
        size = rng.randint(1, 40)
        overlap = rng.randint(0, size)
        t = random_text(rng, sep)
        assert split_text(t, size, overlap, sep) == loop_twin(t, size, overlap, sep), (t, size, overlap, sep)


def test_oversized_word_stands_alone():
    assert split_text("x" * 1200) == ["x" * 1200]
    assert split_text("a " + "x" * 1200 + " b") == ["a", "x" * 1200, "b"]


def test_chunk_documents_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, ""), (3, None)], "doc_id long, text string")
    rows = chunk_documents(df, size=5, overlap=2).orderBy("doc_id", "chunk_idx").collect()
    assert [(r.doc_id, r.chunk_idx, r.text) for r in rows] == [(1, 0, "a b c"), (1, 1, "c d e"), (1, 2, "e f")]
