"""Raw pages → page records (M1 → M2): one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import html as H


def page_records(pages: DataFrame, depth: Column | None = None, profile: str = "default",
                 on_missing: str = "drop", phrases=H.BOILERPLATE) -> DataFrame:
    """``pages(page_id, url, html[, depth])`` → ``(page_id, text, url, depth, title, model_num, ps_num)``.

    ``depth`` (default: the ``depth`` column) picks the seed-page element list
    at depth 0.  Pages without a title are dropped (``on_missing='drop'``, the
    reference behaviour) or kept with a NULL title (``'keep'``).
    """
    tags, seed_tags = H.PROFILES[profile]
    d = depth if depth is not None else F.col("depth")
    rec = pages.select("page_id", "url", "html", d.cast("int").alias("depth"))
    if on_missing == "drop":
        rec = drop_untitled(rec, H.has_title(F.col("html")))
    # title and text are decoded in one pass of the rows through Python
    rec = rec.select("page_id", H.page_text(F.col("html"), tags, seed_tags, F.col("depth"), phrases).alias("text"),
                     "url", "depth", H.extract_title(F.col("html")).alias("title"))
    rec = rec.withColumn("model_num", F.when(F.col("title").isNotNull(), H.title_model_num(F.col("title"))))
    return rec.withColumn("ps_num", H.url_part_num(F.col("url")))


def drop_untitled(records: DataFrame, titled: Column | None = None) -> DataFrame:
    """A page without a title yields no record (and, upstream, no links); ``titled`` says so before the title is read."""
    return records.filter(F.col("title").isNotNull() if titled is None else titled)


#: Seed flags up to this number are broadcast (8 bytes each); more are joined by a shuffle.
MAX_SEEDS = 1_000_000


def crawl_records(pages: DataFrame, frontier: DataFrame, seeds: DataFrame, profile: str = "default",
                  on_missing: str = "drop", phrases=H.BOILERPLATE) -> DataFrame:
    """Records of all pages: cleaned where the HTML lies, then joined with the depths.

    Every page with a title has its record; ``depth`` is null where the crawl
    behind ``frontier`` didn't come.  Depth 0 is exactly the seed set, so the seed
    element list is chosen from a seed flag and only the narrow record — never the
    raw HTML — meets the frontier in the join.
    """
    flag = seeds.select("page_id").distinct().withColumn("__seed", F.lit(0))
    if seeds.count() <= MAX_SEEDS:
        flag = F.broadcast(flag)
    p = pages.join(flag, "page_id", "left").withColumn("depth", F.coalesce(F.col("__seed"), F.lit(1)))
    rec = page_records(p, profile=profile, on_missing=on_missing, phrases=phrases).drop("depth")
    return rec.join(frontier, "page_id", "left").select("page_id", "text", "url", F.col("depth").cast("int").alias("depth"),
                                                "title", "model_num", "ps_num")
