"""10. Line dedup by distinct-site spread, in DataFrame functions alone.

Each line (trimmed, with at least one word) is hashed; a HyperLogLog sketch of
the sites it stands on is kept per hash and merged by aggregation.  Lines that may
reach the threshold get a second sketch, of the different texts they stand in, so
that the lines of one text copied to many sites do not count as boilerplate; where
an estimate lies within the sketch's error of the threshold, exact distinct counts
decide.  A line on ``MIN_SITES`` sites or more and in as many different texts is
boilerplate and removed from every document, whatever else the document holds.

Defined results: a null text has no lines and stays null, an empty one stays empty,
one of boilerplate alone becomes empty (its blank lines stay);
a null site counts as one site; blank lines are never removed; equal rows repeat
their result; an empty table gives an empty table; extra columns are kept, those
named like an output replaced; a line of any length is one hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import free, staged, table, without

MIN_SITES = 10
LG_K = 8
#: Three standard errors of a sketch of 2^LG_K registers, and at least 1 site.
BAND = 3 * 1.04 / 2 ** (LG_K / 2)

TRIMMED = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _hash(line: str) -> F.Column:
    """Names a line or text by 128 bits: at 10^12 lines, 64 would make some equal that are not."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """A row per line with a word: text's key, position, hash, site."""
    line = docs.select(_hash(text).alias("key"), F.coalesce(site, F.lit("\0")).alias("site"),
                       F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    return (line.select("key", "site", "pos", F.regexp_replace("line", TRIMMED, "").alias("line")).filter("line <> ''")
            .select("key", "site", "pos", _hash("line").alias("hash")))


def _spread(lines: DataFrame, **of: str) -> DataFrame:
    """Estimated number of different values of each column, by line hash."""
    sketches = lines.groupBy("hash").agg(*[F.hll_sketch_agg(c, LG_K).alias(n) for n, c in of.items()])
    return sketches.select("hash", *[F.hll_sketch_estimate(n).alias(n) for n in of])


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Where boilerplate stands: key of the text and positions of its lines on ``min_sites`` sites and in as many texts or more."""
    low, high = min_sites - max(1, BAND * min_sites), min_sites + max(1, BAND * min_sites)
    lines = _lines(docs, text, site)
    wide = staged(_spread(lines.select("hash", "site"), sites="site").filter(F.col("sites") >= low).select("hash"), "wide-lines")
    # occurrences of lines that may be boilerplate; copies of a text on one site are one
    found = staged(lines.join(wide, "hash", "left_semi").distinct(), "wide-line-places")
    least = F.least("sites", "texts")
    spread = staged(_spread(found, sites="site", texts="key.a").select("hash", least.alias("n")).filter(F.col("n") >= low), "line-spread")
    near = spread.filter(F.col("n") <= high).select("hash")
    exact = (found.join(near, "hash", "left_semi").groupBy("hash").agg(F.count_distinct("site").alias("sites"), F.count_distinct("key").alias("texts"))
             .filter(least >= min_sites))
    bad = spread.filter(F.col("n") > high).select("hash").unionByName(exact.select("hash"))
    return found.join(bad, "hash", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("at"))


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Documents with their boilerplate lines removed from the text; adds n_lines and n_removed."""
    docs = without(docs, ["n_lines", "n_removed"])
    name, cuts = free(docs, "line_key", "line_cuts")
    cut = staged(boilerplate(docs, text, site, min_sites).select(F.col("key").alias(name), F.col("at").alias(cuts)), "line-cuts")
    rows = docs.join(cut, _hash(text) == F.col(name), "left")
    split = F.split(F.col(text), "\n", -1)

    def between(s: F.Column) -> F.Column:
        """The stretches of lines between cuts that follow one another: each line is copied once."""
        gaps = F.transform(F.sequence(F.lit(1), F.size(s["cut"]) - 1),
                           lambda i: F.slice(s["lines"], F.get(s["cut"], i - 1) + 2, F.get(s["cut"], i) - F.get(s["cut"], i - 1) - 1))
        return F.array_join(F.flatten(gaps), "\n")

    ends = F.concat(F.array(F.lit(-1)), F.col(cuts), F.array(F.size(split)))
    # an array of one struct, so that the lines are split once and not for each stretch
    kept = F.get(F.transform(F.array(F.struct(split.alias("lines"), ends.alias("cut"))), between), F.lit(0))
    return rows.select(
        *[F.when(F.col(cuts).isNotNull(), kept).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("bigint").alias("n_lines"),
        F.greatest(F.size(cuts), F.lit(0)).cast("bigint").alias("n_removed"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("kept_chars"),
                                    F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents
), trimmed as (
  select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as t from lines
), bad as (
  select t from trimmed where t <> '' group by t having count(distinct coalesce(source, chr(1))) >= 10 and count(distinct text) >= 10
), hits as (
  select distinct doc_id, text, pos from trimmed where t in (select t from bad)
), kept as (
  select l.doc_id, l.text, string_agg(l.line, chr(10) order by l.pos) as body, count(*) as n
  from trimmed l left join hits h on h.doc_id = l.doc_id and h.text = l.text and h.pos = l.pos
  where h.pos is null group by l.doc_id, l.text
)
select d.doc_id, len(string_split(d.text, chr(10)))::bigint as n_lines,
       (len(string_split(d.text, chr(10))) - coalesce(k.n, 0))::bigint as n_removed,
       length(coalesce(k.body, ''))::bigint as kept_chars, sha256(coalesce(k.body, '')) as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id and k.text = d.text
"""
