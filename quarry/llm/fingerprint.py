"""6. Document fingerprints by consistent weighted sampling.

A text's terms are its 2-word shingles, weighted by their number; 128 samples
(see ``sampling``), 16 bits of each, are the fingerprint.  The share of equal
samples estimates the generalised Jaccard similarity of two texts.

The query needs each document's successor by doc_id.  Documents are dealt out
once, by ranges of doc_id whose bounds are doc_ids of the table; the first document
of a range goes to the range before it as well (the first of all to the last
range), so every range is sorted and read once, with one document at hand.

Defined results: a null text counts as empty; texts without a word have the
fingerprint of no terms, alike among themselves (1.0) and unlike all others
(0.0); equal ids are ordered by text; null ids come first; equal rows follow one
another; a single document is its own successor; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quarry.llm.common import map_text, mix, raw, shingles, table, word_hashes, word_spans
from quarry.llm.sampling import Sampler

SAMPLES = 128
SHINGLE = 2
DOCS_PER_RANGE = 50_000
BYTES_PER_RANGE = 32 << 20


def codes(text: str | bytes, sampler: Sampler) -> np.ndarray:
    """The 16-bit samples of a text."""
    data, offs = raw(pa.array([text], pa.string()))
    starts, ends, _ = word_spans(data, offs)
    if not len(starts):
        return np.zeros(len(sampler.odd), np.uint16)
    terms, n = np.unique(shingles(word_hashes(data, starts, ends), SHINGLE), return_counts=True)
    return (mix(sampler.sample(terms, n.astype(np.float64))) | np.uint64(1)).astype(np.uint16)  # 0 is kept for no terms


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every text, in hexadecimal."""
    def make():
        sampler = Sampler(SAMPLES)
        return lambda col: [pa.array([codes(t or "", sampler).astype(">u2").tobytes().hex() for t in col.to_pylist()], pa.string())]

    return map_text(docs, make, [StructField(out, StringType())], text)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the start of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", docs_per_range: int = DOCS_PER_RANGE) -> tuple[DataFrame, int]:
    """Rows (range, ord, doc_id, text, extra): every document in its range; the range's successor is marked extra."""
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, size = ids.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    few = min(n // 500, 16 * docs.sparkSession.sparkContext.defaultParallelism)  # smaller tables still use all cores
    ranges = max(1, few, n // docs_per_range, size // BYTES_PER_RANGE)
    share = [i / ranges for i in range(1, ranges)]
    stat = ids.agg(F.min("doc_id").alias("low"), *([F.percentile_approx("doc_id", share, max(10_000, 4 * ranges)).alias("cut")] if share else [])).first()
    low = stat["low"]
    cuts = sorted({c for c in (stat["cut"] or []) if c > low}) if share and low is not None else []
    nulls = ids.filter("doc_id is null").limit(1).count() > 0
    if cuts:
        bounds = np.array(cuts, np.int64)
        schema = StructType([*ids.schema.fields, StructField("range", LongType()), StructField("extra", LongType())])

        def deal(batches):
            for b in batches:
                col = b.column(0)
                known = ~col.is_null().to_numpy(zero_copy_only=False)
                x = col.fill_null(0).to_numpy(zero_copy_only=False)
                at = np.where(known, np.searchsorted(bounds, x, side="right"), 0)
                head = known & (at > 0) & (bounds[np.maximum(at - 1, 0)] == x)
                take = np.concatenate((np.arange(len(x)), np.flatnonzero(head)))
                extra = np.concatenate((np.zeros(len(x), np.int64), np.ones(int(head.sum()), np.int64)))
                out = b.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(at[take] - extra), pa.array(extra)], names=schema.names)

        rows = ids.mapInArrow(deal, schema)
    else:
        rows = ids.withColumns({"range": F.lit(0).cast("bigint"), "extra": F.lit(0).cast("bigint")})
    # after the last document comes the first
    first = ids.filter(F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)).orderBy("text").limit(1)
    rows = rows.unionByName(first.withColumns({"range": F.lit(len(cuts)).cast("bigint"), "extra": F.lit(2).cast("bigint")}))
    return rows, len(cuts) + 1


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's table: fingerprints of each text and its edit, and their likeness to it and to the next text."""
    rows, ranges = with_next(docs, id_col, text)
    out = StructType([StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()),
                      StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()),
                      StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())])

    def run(batches):
        sampler, held, done = Sampler(SAMPLES), None, []

        def flush():
            cols = [list(c) for c in zip(*done)] if done else [[] for _ in out.fields]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=out.names)

        for b in batches:
            for i in range(b.num_rows):
                doc, t, part, extra = (b.column(k)[i].as_py() for k in range(4))
                mine = codes(t, sampler)
                if held is not None and held[0] == part:
                    _, doc0, t0, c0 = held
                    e = edited(t0, t)
                    ce = codes(e, sampler)
                    done.append((doc0, len(t0), hashlib.sha256(e.encode()).hexdigest(), c0.astype(">u2").tobytes().hex(),
                                 ce.astype(">u2").tobytes().hex(), likeness(c0, ce), likeness(c0, mine)))
                held = (part, doc, t, mine) if not extra else None
                if len(done) >= 500:
                    yield flush()
            if done:
                yield flush()

    dealt = rows.select("doc_id", "text", "range", "extra").repartition(ranges, "range")
    return dealt.sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, out)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
