"""An index stored by key, so that an upsert rewrites only what it touches.

The table is partitioned by ``bucket``, a hash of the page's key (its url; without
one, its document id).  New pages are merged into the buckets they fall in: these
alone are read, joined and overwritten (dynamic partition overwrite), the others stay
as they are.  A page's chunks are replaced as a whole, so no chunk of an older
version stays behind.  Merging the same pages again changes nothing.

The number of buckets is fixed when the table is made and kept in ``_meta``; choose
it so that a bucket is a few files' worth.  A bucket's swap is as atomic as the file
system's rename; a merge that was broken off is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import index as IX

BUCKETS = 64


def page_key(url: str = "url", doc: str = "doc_id") -> F.Column:
    return F.coalesce(F.col(url), F.concat(F.lit("doc:"), F.col(doc).cast("string")))


def bucket_of(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(page_key()), F.lit(buckets)).cast("int")


def latest_pages(records: DataFrame) -> DataFrame:
    """One record of each page key: the one with the largest page id (of equal ids, the largest text)."""
    first = ["page_id", "text"]
    rest = [c for c in records.columns if c not in first]
    best = records.groupBy(page_key(doc="page_id").alias("page_key")).agg(F.max(F.struct(*first, *rest)).alias("r"))
    return best.select("r.*").select(*records.columns)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    (rows.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def write_keyed(idx: DataFrame, path: str, embedder="hash", buckets: int = BUCKETS) -> DataFrame:
    """Write a whole index (``INDEX_COLUMNS``) by bucket."""
    _write(idx.select(*IX.INDEX_COLUMNS, bucket_of(buckets).alias("bucket")), path, "overwrite")
    IX._write_meta(idx.sparkSession, path, embedder, buckets)
    return load_keyed(idx.sparkSession, path, embedder)


def load_keyed(spark: SparkSession, path: str, embedder="hash") -> DataFrame:
    return IX.load_index(spark, path, embedder).drop("bucket")


def merge(new: DataFrame, path: str, embedder="hash", buckets: int = BUCKETS) -> list[int]:
    """Put the chunks of new pages in place of all chunks with their keys; returns the buckets that were rewritten.

    A missing index is made with ``buckets`` buckets.  Of pages with one key the one
    with the largest document id counts.  An empty batch rewrites nothing.
    """
    spark = new.sparkSession
    fresh = not IX.index_exists(spark, path)
    if not fresh:
        IX._check_meta(spark, path, embedder)
        buckets = spark.read.parquet(path.rstrip("/") + "/_meta").first()["buckets"]
    new = new.select(*IX.INDEX_COLUMNS, bucket_of(buckets).alias("bucket"), page_key().alias("page_key"))
    last = new.groupBy("page_key").agg(F.max("doc_id").alias("doc_id"))
    new = new.join(last, ["page_key", "doc_id"], "left_semi").dropDuplicates(["page_key", "chunk_idx"]).checkpoint()
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())     # at most ``buckets`` numbers
    columns = [*IX.INDEX_COLUMNS, "bucket"]
    rows = new.select(*columns)
    if touched and not fresh:
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        kept = old.withColumn("page_key", page_key()).join(new.select("bucket", "page_key").distinct(), ["bucket", "page_key"], "left_anti")
        rows = rows.unionByName(kept.select(*columns)).checkpoint()                       # read before its folders are replaced
    if touched or fresh:
        _write(rows, path, "overwrite")
    if fresh:
        IX._write_meta(spark, path, embedder, buckets)
    return touched
