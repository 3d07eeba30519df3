"""8. URL filters by a sort-merge range join.

A rule is a host with all its subdomains and a path prefix.  Hosts become keys
with their labels reversed (``example.net`` → ``net.example.``), so a rule's
hosts are the interval of keys that start with its key, and intervals of rules
are nested or disjoint.  Pages and rules are dealt out by ranges of (key, hash of
the row), so one host may span many tasks; a rule goes to every range its
interval touches.  Each task sorts its rows and sweeps them once with a stack of
the open rules; a level of the stack looks its path prefixes up by length.

The bounds of the ranges come from a hash-chosen set of about 32 keys per task
(as for any range partitioning, they decide balance only, never results).

Defined results: a null url or one without ``://`` has an empty host and path, fits
no rule and gets the default verdict; the longest fitting rule (host and path
together, then host) wins; equal rows repeat their result; an empty table gives
an empty table; extra input columns are kept, those named like an output replaced.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quarry.llm.common import table, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_RANGE = 200_000
LAST = "\U0010ffff"
#: The contract's rules: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_path(url: F.Column) -> tuple[F.Column, F.Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: F.Column) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict.  ``rules``: host, path, verdict (strings, one row per rule)."""
    spark = pages.sparkSession
    pages = without(pages, ["host", "path", "rule", "verdict"])
    host, path = host_path(F.col(url))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"),
                        F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]).alias("h"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    n = pages.count()
    ranges = max(8, spark.sparkContext.defaultParallelism, n // ROWS_PER_RANGE + 1)
    every = max(1, n // (32 * ranges))
    seen = sorted(map(tuple, rows.filter(F.pmod("h", F.lit(every)) == 0).select("key", "h").collect()))
    bounds = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []

    row_type = rows.schema["row"].dataType
    blank = F.lit(None)
    events = rows.select("key", "h", F.lit(True).alias("page"), "host", "path", blank.cast("string").alias("verdict"), "row").unionByName(
        rules.select(host_key(F.col("host")).alias("key"), F.lit(None).cast("bigint").alias("h"), F.lit(False).alias("page"),
                     "host", "path", "verdict", F.lit(None).cast(row_type).alias("row")))
    schema = StructType([StructField("range", IntegerType()), *events.schema.fields])

    def deal(batches):
        """A page's range, or a copy of a rule for each range that its interval touches."""
        for b in batches:
            take, at = [], []
            for i, (key, h, page) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
                if page:
                    take.append(i)
                    at.append(bisect.bisect_right(bounds, (key, h)))
                else:
                    low, high = bisect.bisect_left(bounds, (key,)), bisect.bisect_right(bounds, (key + LAST,))
                    take += [i] * (high - low + 1)
                    at += range(low, high + 1)
            out = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *out.columns], names=schema.names)

    out_schema = StructType([StructField("row", row_type), *[StructField(c, StringType()) for c in ("host", "path", "rule", "verdict")]])

    def sweep(batches):
        now, stack = None, []  # stack: [key, {path: (host, verdict)}, lengths of these paths]
        for b in batches:
            take, found = [], []
            cols = [b.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)]
            for i, (part, key, page, host, path, verdict) in enumerate(zip(*cols)):
                if part != now:
                    now, stack = part, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not page:
                    if not stack or stack[-1][0] != key:
                        stack.append([key, {}, []])
                    level = stack[-1]
                    if len(path) not in level[2]:
                        bisect.insort(level[2], len(path))
                    level[1].setdefault(path, (host, verdict))
                    continue
                best = None
                for _, paths, lengths in stack:
                    for m in reversed(lengths):
                        if (hit := paths.get(path[:m])) and len(path) >= m:
                            if best is None or len(hit[0]) + m >= best[0]:
                                best = (len(hit[0]) + m, hit[0] + path[:m], hit[1])
                            break
                take.append(i)
                found.append((host, path, *(best[1:] if best else (None, default))))
            if take:
                rows = b.column(7).take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, *[pa.array(x, pa.string()) for x in zip(*found)]], names=out_schema.names)

    swept = (events.mapInArrow(deal, schema).repartition(ranges, "range")
             .sortWithinPartitions("range", "key", "page", "path", "host").mapInArrow(sweep, out_schema))
    return swept.select("row.*", "host", "path", "rule", "verdict")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLE = r"""
with parts as (
  select page_id, url, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), cut as (
  select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(rhost, rpath, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), hits as (
  select page_id, url, host, path, rhost || rpath as rule, verdict,
         row_number() over (partition by page_id, url order by length(rhost || rpath) desc, length(rhost) desc) as n
  from (select distinct page_id, url, host, path from cut)
  join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select c.page_id, c.url, c.host, c.path, h.rule, coalesce(h.verdict, 'allow') as verdict
from cut c left join hits h on h.n = 1 and h.page_id = c.page_id and h.url = c.url
"""
