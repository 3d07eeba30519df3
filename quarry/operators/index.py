"""The vector index is an ordinary Parquet table (M7):

``chunk_id, doc_id, url, chunk_idx, text, depth, title, model_num, ps_num, embedding``

plus a one-row ``_meta`` table (ignored by readers of the index folder) that
records the embedder name and dimension, checked on load and on append.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import py_strip
from quarry.operators.common import join_small
from quarry.operators.chunk import CHUNK_OVERLAP, CHUNK_SIZE, WORD_SEP, chunk_documents
from quarry.operators.embed import embed_column, embedder_info

CHUNK_BITS = 20          # chunk_id = doc_id · 2^20 + chunk_idx  (≤ 1,048,576 chunks per document)
APPEND_BATCH = 250       # the reference appends in batches of 250 and tests its cap before each batch
INDEX_COLUMNS = ["chunk_id", "doc_id", "url", "chunk_idx", "text", "depth", "title", "model_num", "ps_num",
                 "embedding"]


def compose_document(records: DataFrame) -> DataFrame:
    """Page record → document: body ``"text: …\\nurl: …"``, metadata kept as columns."""
    body = F.concat(F.lit("text: "), py_strip(F.coalesce(F.col("text"), F.lit(""))),
                    F.lit("\nurl: "), py_strip(F.coalesce(F.col("url"), F.lit(""))))
    return records.select(F.col("page_id").alias("doc_id"), body.alias("page_content"),
                          F.col("url"), "depth", "title", "model_num", "ps_num")


def chunk_rows(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, sep: str = WORD_SEP) -> DataFrame:
    ch = chunk_documents(docs, "page_content", size, overlap, sep, out="text")
    return ch.withColumn("chunk_id", chunk_id())


def chunk_id(doc: str = "doc_id", idx: str = "chunk_idx") -> F.Column:
    """``doc · 2^CHUNK_BITS + idx``; fails for ids and ordinals that don't fit, as they would share numbers."""
    fits = F.col(doc).between(0, (1 << (63 - CHUNK_BITS)) - 1) & (F.col(idx) < 1 << CHUNK_BITS)
    wrong = F.raise_error(F.concat(F.lit("no room in a chunk id for document "), F.col(doc).cast("string"), F.lit(", chunk "), F.col(idx).cast("string")))
    return F.when(F.col(doc).isNull() | fits, F.shiftleft(F.col(doc), CHUNK_BITS) + F.col(idx)).otherwise(wrong.cast("bigint"))


def embed_chunks(chunks: DataFrame, embedder="hash") -> DataFrame:
    out = chunks.withColumn("embedding", embed_column(F.col("text"), embedder))
    return out.select(*INDEX_COLUMNS)


def index_rows(docs: DataFrame, embedder="hash", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, sep: str = WORD_SEP) -> DataFrame:
    """``embed_chunks(chunk_rows(docs))`` with each text through one Python worker instead of two."""
    rows = chunk_documents(docs, "page_content", size, overlap, sep, out="text", embedder=embedder)
    return rows.withColumn("chunk_id", chunk_id()).select(*INDEX_COLUMNS)


def _write_meta(spark: SparkSession, path: str, embedder, buckets: int | None = None) -> None:
    name, dim = embedder_info(embedder)
    spark.createDataFrame([(name, dim, buckets)], "model string, dim int, buckets int").coalesce(1).write.mode("overwrite").parquet(
        path.rstrip("/") + "/_meta")


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether an index lies at ``path``, on whatever file system the path names."""
    meta = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_meta")
    return meta.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta)


def _check_meta(spark: SparkSession, path: str, embedder) -> None:
    name, dim = embedder_info(embedder)
    meta = spark.read.parquet(path.rstrip("/") + "/_meta").first()
    if meta is None or meta["model"] != name or meta["dim"] != dim:
        raise ValueError(f"index at {path} was built with {meta and (meta['model'], meta['dim'])}, "
                         f"not {(name, dim)}")


def build_index(docs: DataFrame, path: str, embedder="hash", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                sep: str = WORD_SEP) -> DataFrame:
    """Chunk, embed and write the whole index (overwrite); returns the written table."""
    spark = docs.sparkSession
    idx = index_rows(docs, embedder, size, overlap, sep)
    idx.write.mode("overwrite").parquet(path)
    _write_meta(spark, path, embedder)
    return spark.read.parquet(path)


def load_index(spark: SparkSession, path: str, embedder="hash") -> DataFrame:
    _check_meta(spark, path, embedder)
    return spark.read.parquet(path)


def document_offsets(chunks: DataFrame, doc: str = "doc_id", parts: int | None = None) -> DataFrame:
    """doc, off, n: the global ordinal of each document's first chunk, in document order, and its number of chunks.

    A distributed exclusive scan: the documents' counts are dealt out by ranges of
    the id and written; the ranges' totals, one row for each, are prefix-summed,
    then the counts within each range.  No task sees more than a range, however
    the ids are spaced.
    """
    counts = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    ranged = (counts.repartitionByRange(parts, doc) if parts else counts.repartitionByRange(doc)).withColumn("part", F.spark_partition_id())
    ranged = ranged.checkpoint()                                    # a range keeps its number
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(doc)) - F.col("n")
    return ranged.withColumn("inside", inside).join(before, "part").select(doc, (F.col("before") + F.col("inside")).alias("off"), "n")


def chunk_ordinals(chunks: DataFrame, doc: str = "doc_id", idx: str = "chunk_idx", parts: int | None = None) -> DataFrame:
    """Global 0-based ordinal of each chunk in (doc, chunk_idx) order, without a single-partition sort."""
    offsets = document_offsets(chunks, doc, parts).select(doc, "off")
    return chunks.join(offsets, doc).withColumn("ordinal", F.col("off") + F.col(idx)).drop("off")


def append_index(chunks: DataFrame, path: str, embedder="hash", resume: int = 0, cap: int | None = None,
                 batch: int = APPEND_BATCH) -> int:
    """Append chunks ``[resume, resume + ⌈cap/batch⌉·batch)`` (all from ``resume`` when ``cap`` is None).

    Returns the ordinal to resume from next time: the first chunk not appended.
    """
    spark = chunks.sparkSession
    fresh = not index_exists(spark, path)  # then this append creates it
    if not fresh:
        _check_meta(spark, path, embedder)
    # only the documents' chunk counts are staged; texts are cut a second time for the appended slice alone
    offsets = document_offsets(chunks).checkpoint()
    end = None if cap is None else resume + math.ceil(cap / batch) * batch
    here = offsets.filter(F.col("off") + F.col("n") > resume)
    sel = F.col("off") + F.col("chunk_idx") >= resume
    if end is not None:
        here = here.filter(F.col("off") < end)
        sel = sel & (F.col("off") + F.col("chunk_idx") < end)
    part = embed_chunks(chunks.join(here.select("doc_id", "off"), "doc_id").filter(sel).drop("off"), embedder)
    part.write.mode("append").parquet(path)
    if fresh:
        _write_meta(spark, path, embedder)
    total = offsets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return total if end is None else min(end, total)


def upsert_index(old: DataFrame, new: DataFrame, keys=("url", "chunk_idx")) -> DataFrame:
    """Keyed merge: every new row, and the old rows whose key is not in ``new``.

    Write the result to a fresh path (Parquet has no in-place update).
    """
    keys = list(keys)
    kept = join_small(old, new.select(*keys).distinct(), keys, "left_anti")
    return new.unionByName(kept.select(*new.columns))


def upsert_to(new: DataFrame, path: str, target: str, embedder="hash", keys=("url", "chunk_idx"),
              by_document: bool = False) -> DataFrame:
    """``upsert_index`` of the index at ``path`` into a fresh index ``target``, with its model check and ``_meta``.

    A missing index at ``path`` counts as empty.  Of rows with equal keys in
    ``new`` the one with the largest chunk id stays.  ``by_document`` replaces all
    old chunks of the new rows' urls, also those past their new number.
    """
    spark = new.sparkSession
    new = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), "chunk_id").alias("__r")).select("__r.*")
    merged = new
    if index_exists(spark, path):
        merged = upsert_index(load_index(spark, path, embedder), new, ["url"] if by_document else keys)
    merged.write.parquet(target)
    _write_meta(spark, target, embedder)
    return spark.read.parquet(target)
