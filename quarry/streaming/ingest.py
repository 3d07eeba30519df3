"""Incremental index build: new page-record files → chunks → vectors → keyed index.

The checkpoint replaces the reference's manual resume number.  Each micro-batch
is merged by page key, so a page that is delivered again, in the same batch or a
later one, replaces its chunks; a ledger beside the index (``_batches``) names the
batches that are merged, and one that the stream replays after a restart is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import index as IX
from quarry.operators import keyed as KX

PAGE_RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("title", T.StringType()), T.StructField("model_num", T.StringType()),
    T.StructField("ps_num", T.StringType()),
])
LEDGER = "stream string, batch bigint, buckets int"


def merge_batch(records: DataFrame, batch: int, index_path: str, stream: str, embedder="hash", buckets: int = KX.BUCKETS) -> bool:
    """Merge one micro-batch of page records; False if the ledger has it already."""
    spark = records.sparkSession
    path = index_path.rstrip("/") + "/_batches"
    ledger = spark._jvm.org.apache.hadoop.fs.Path(path)
    if ledger.getFileSystem(spark._jsc.hadoopConfiguration()).exists(ledger):
        if spark.read.schema(LEDGER).parquet(path).filter((F.col("stream") == stream) & (F.col("batch") == batch)).limit(1).count():
            return False
    chunks = IX.index_rows(IX.compose_document(KX.latest_pages(records)), embedder)
    touched = KX.merge(chunks, index_path, embedder, buckets)
    spark.createDataFrame([(stream, batch, len(touched))], LEDGER).coalesce(1).write.mode("append").parquet(path)
    return True


def stream_ingest(spark: SparkSession, source: str, index_path: str, checkpoint: str, embedder="hash",
                  files_per_trigger: int | None = None, available_now: bool = True, buckets: int = KX.BUCKETS) -> StreamingQuery:
    """Start the ingest stream over Parquet page-record files in ``source``."""
    reader = spark.readStream.schema(PAGE_RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if IX.index_exists(spark, index_path):
        IX._check_meta(spark, index_path, embedder)

    def apply(records: DataFrame, batch: int) -> None:
        merge_batch(records, batch, index_path, checkpoint, embedder, buckets)

    w = reader.parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
