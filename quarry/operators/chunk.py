"""Overlapping chunks of a document (table-generating, one row per chunk).

Rule (SURVEY §2.4.1): words are the non-empty pieces of the text split on the
separator; a chunk is the longest run of words whose joined length stays within
``size`` (a single oversized word stands alone); the next chunk starts at the
earliest word such that the carried tail is at most ``overlap`` long and still
leaves room for the next word.  With ``Q[i] = Σ_{j<i} (|w_j| + d)`` the joined
length of words ``[s, e)`` is ``Q[e] − Q[s] − d``, so both choices are binary
searches over ``Q``: each document costs O(words + chunks · log words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.embed import VECTOR, worker_model

# The reference's splitter settings.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
WORD_SEP, PARAGRAPH_SEP = " ", "\n\n"


def chunk_spans(lengths: np.ndarray, size: int, overlap: int, d: int) -> list[tuple[int, int]]:
    """Word index ranges ``[s, e)`` of the chunks, in order."""
    n = len(lengths)
    if n == 0:
        return []
    q = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(lengths + d, out=q[1:])
    spans = []
    s, lo = 0, 1
    while True:
        # longest extension that fits; at least up to the mandatory word lo-1
        e = int(np.searchsorted(q, q[s] + size + d, side="right")) - 1
        e = min(max(e, lo), n)
        spans.append((s, e))
        if e == n:
            return spans
        # earliest start keeping tail ≤ overlap and room for word e
        need = max(q[e] - d - overlap, q[e] + lengths[e] - size)
        s2 = int(np.searchsorted(q, need, side="left"))
        s = min(max(s2, s), e)
        lo = e + 1


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, sep: str = WORD_SEP) -> list[str]:
    """Chunks of one text (empty chunks after stripping are skipped)."""
    if text is None:
        return []
    words = [w for w in text.split(sep) if w != ""]
    lengths = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    out = []
    for s, e in chunk_spans(lengths, size, overlap, len(sep)):
        c = sep.join(words[s:e]).strip()
        if c:
            out.append(c)
    return out


def chunker(size: int, overlap: int, sep: str):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_text(t, size, overlap, sep))

    return chunks


def _chunk_and_embed(size: int, overlap: int, sep: str, out: str, embedder, rows: int = 4096):
    """mapInArrow body: the last column's texts as chunks with their vectors, the other columns repeated for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(embedder)
        for batch in batches:
            chunks = [split_text(t, size, overlap, sep) for t in batch.column(batch.num_columns - 1).to_pylist()]
            n = np.array([len(c) for c in chunks], np.int64)
            doc, flat = np.repeat(np.arange(len(n)), n), [c for cs in chunks for c in cs]
            idx = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            for lo in range(0, len(flat), rows):
                texts = flat[lo:lo + rows]
                m = np.asarray(model.encode(texts), np.float32)
                vectors = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel())
                at = pa.array(doc[lo:lo + rows])
                columns = {name: batch.column(i).take(at) for i, name in enumerate(batch.schema.names[:-1])}
                yield pa.RecordBatch.from_pydict({**columns, "chunk_idx": pa.array(idx[lo:lo + rows], pa.int32()),
                                                  out: pa.array(texts, pa.string()), "embedding": vectors})

    return run


def chunk_documents(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    sep: str = WORD_SEP, out: str = "text", embedder=None) -> DataFrame:
    """One row per chunk: every other column of ``docs`` plus ``chunk_idx`` and the chunk ``out``.

    Map-only (no shuffle); whole texts are processed, never prefixes.  With an
    ``embedder`` also the chunk's vector ``embedding``, made in the same pass.
    """
    if overlap > size:
        raise ValueError(f"overlap {overlap} larger than chunk size {size}")
    keep = [c for c in docs.columns if c != text]
    if embedder is not None:
        schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("chunk_idx", T.IntegerType()),
                               T.StructField(out, T.StringType()), T.StructField("embedding", VECTOR)])
        return docs.select(*keep, text).mapInArrow(_chunk_and_embed(size, overlap, sep, out, embedder), schema)
    arr = docs.select(*keep, chunker(size, overlap, sep)(F.col(text)).alias("__chunks"))
    # outer form: an inner generator makes Catalyst infer a size(...) > 0 filter below
    # the projection, which would run the chunk UDF (and everything under it) twice
    x = arr.select(*keep, F.posexplode_outer("__chunks").alias("chunk_idx", out))
    return x.filter(F.col("chunk_idx").isNotNull()).withColumn("chunk_idx", F.col("chunk_idx").cast("int"))


def chunk_words(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                **kw) -> DataFrame:
    return chunk_documents(docs, text, size, overlap, WORD_SEP, **kw)


def chunk_paragraphs(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                     **kw) -> DataFrame:
    return chunk_documents(docs, text, size, overlap, PARAGRAPH_SEP, **kw)


def chunk_paragraphs_no_overlap(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, **kw) -> DataFrame:
    return chunk_documents(docs, text, size, 0, PARAGRAPH_SEP, **kw)
