"""Page files: header-less CSV (6 or 2 columns) and crawled JSON items.

Schemas are fixed (no inference).  CSV is RFC-4180 style: comma, ``"`` quotes
doubled inside fields, newlines allowed inside quotes, no field-size limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_CSV = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("depth", T.IntegerType()), T.StructField("title", T.StringType()),
    T.StructField("model_num", T.StringType()), T.StructField("ps_num", T.StringType()),
])
TEXT_URL_CSV = T.StructType([T.StructField("text", T.StringType()), T.StructField("url", T.StringType())])
CRAWL_ITEM = T.StructType([T.StructField("text", T.StringType()), T.StructField("url", T.StringType())])

CSV_FILE_BYTES = 64 << 20
_CSV_OPTS = {"header": "false", "sep": ",", "quote": '"', "escape": '"', "multiLine": "true",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
             "maxCharsPerColumn": "-1", "mode": "FAILFAST"}


def _csv_reader(spark: SparkSession, schema: T.StructType):
    r = spark.read.schema(schema)
    for k, v in _CSV_OPTS.items():
        r = r.option(k, v)
    return r


def _empty_is_text(df: DataFrame, cols) -> DataFrame:
    """CSV cannot tell an empty field from a missing one; page text is never missing."""
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    return df


def scan_page_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-less ``text, url, depth, title, model_num, ps_num`` rows."""
    return _empty_is_text(_csv_reader(spark, PAGE_CSV).csv(path), ["text"])


def scan_text_url_csv(spark: SparkSession, path: str) -> DataFrame:
    """Older two-column layout; ``source`` is the file the row came from."""
    df = _csv_reader(spark, TEXT_URL_CSV).csv(path)
    return _empty_is_text(df, ["text"]).withColumn("source", F.col("_metadata.file_path"))


def rows_per_file(df: DataFrame, file_bytes: int) -> int:
    """Rows whose text columns hold about ``file_bytes`` together, by the rows' mean size (one aggregation)."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 1 for c in df.columns), F.lit(0))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return max(1, file_bytes * n // max(1, total))


def append_pages(records: DataFrame, path: str) -> None:
    """Append page records to the page store: Parquet, in a folder for each depth (the default sink)."""
    records.select(*[c.name for c in PAGE_CSV.fields]).write.mode("append").partitionBy("depth").parquet(path)


def scan_pages(spark: SparkSession, path: str, max_depth: int | None = None) -> DataFrame:
    """Page records of the page store; with ``max_depth`` only the folders up to it are read."""
    df = spark.read.schema(PAGE_CSV).parquet(path).select(*[c.name for c in PAGE_CSV.fields])
    return df if max_depth is None else df.filter(F.col("depth") <= max_depth)


def append_page_csv(records: DataFrame, path: str, file_bytes: int = CSV_FILE_BYTES) -> None:
    """Append page records as header-less CSV in the fixed column order.

    A file of CSV whose fields hold line ends can't be split and is one task to its
    readers, so files are cut at about ``file_bytes``.
    """
    rows = records.select(*[c.name for c in PAGE_CSV.fields])
    w = rows.write.mode("append").option("maxRecordsPerFile", rows_per_file(rows, file_bytes))
    opts = dict(_CSV_OPTS)
    opts.pop("mode")
    opts.pop("multiLine")
    opts.pop("maxCharsPerColumn")
    opts["quoteAll"] = "false"
    opts["emptyValue"] = '""'
    for k, v in opts.items():
        w = w.option(k, v)
    w.csv(path)


def write_text_url_csv(df: DataFrame, path: str, file_bytes: int = CSV_FILE_BYTES) -> None:
    rows = df.select("text", "url")
    rows.write.mode("append").option("maxRecordsPerFile", rows_per_file(rows, file_bytes)).option("header", "false").option("escape", '"') \
        .option("emptyValue", '""').csv(path)


def write_crawl_items(items: DataFrame, path: str) -> None:
    items.select("text", "url").write.mode("append").json(path)


def map_crawl_items(spark: SparkSession, path: str) -> DataFrame:
    """Externally crawled JSON items → documents: body = text or ``''``, source = url."""
    items = spark.read.schema(CRAWL_ITEM).json(path)
    return items.select(F.coalesce(F.col("text"), F.lit("")).alias("page_content"), F.col("url").alias("source"))
