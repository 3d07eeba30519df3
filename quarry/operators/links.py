"""Link graph over a stored page table: extract, resolve, filter, dedupe, BFS."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import urls as U
from quarry.operators.common import join_small
from quarry.session import work_path

# The crawl profiles of the reference (seeds, depth limit, excluded
# link, site prefix).  Profile "single" also drops the bare site URL.
SITE = "https://www.partselect.com"
SITE_PREFIX = SITE + "/"
EXCLUDED_HREF = "/ShoppingCart.aspx"
CRAWL_PROFILES = {
    "default": {"seeds": [SITE_PREFIX], "max_depth": 8, "drop": []},
    "single": {"seeds": [SITE + "/Dishwasher-Parts.htm", SITE + "/Refrigerator-Parts.htm"], "max_depth": 7,
               "drop": [SITE]},
}

#: Edges of one source in a partition's block; hubs up to this number (16 bytes each) are broadcast.
HUB_EDGES, MAX_HUBS = 1_000_000, 500_000

# whole attributes are passed over, so neither a ">" nor an "href=" inside a quoted value counts
HREF = (r"""(?i)<a(?=[\s/])(?>[^>=]*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"']*+))*?"""
        r"""[^>=]*?(?<=[\s/"'])href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")


def _unquote(v: Column) -> Column:
    quoted = v.startswith('"') | v.startswith("'")
    return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def extract_links(pages: DataFrame, html: Column | None = None) -> DataFrame:
    """Every anchor href of the (cleaned) page, in document order: ``(page_id, url, ord, href)``.

    Comments are dropped first: an anchor inside a comment is not a link.
    """
    h = html if html is not None else F.col("html")
    raw = F.regexp_extract_all(F.regexp_replace(h, H.COMMENT, " "), F.lit(HREF), 1)
    # outer form + filter: avoids a second evaluation of the regex through an inferred size filter
    x = pages.select("page_id", "url", F.posexplode_outer(raw).alias("ord", "__v")).filter(F.col("ord").isNotNull())
    return x.select("page_id", "url", F.col("ord").cast("int").alias("ord"),
                    H.unescape_html(_unquote(F.col("__v"))).alias("href"))


def resolve_links(links: DataFrame, base: str = "url", href: str = "href") -> DataFrame:
    """Adds ``abs_url``: the href resolved against the page URL.

    Plain references stay native; the rest (dot segments, empty query or fragment,
    white space, odd schemes) go through ``urljoin``, NULL where it cannot parse.
    """
    plain = U.is_plain(F.col(base), F.col(href))
    # the Python join gets nulls for the rows that it need not decide
    return links.withColumn("abs_url", F.when(plain, U.resolve_native(F.col(base), F.col(href)))
                            .otherwise(U.urljoin_udf(F.when(~plain, F.col(base)), F.when(~plain, F.col(href)))))


def filter_links(links: DataFrame, prefix: str | Column = SITE_PREFIX, excluded=(EXCLUDED_HREF,),
                 drop_urls=()) -> DataFrame:
    """Keep links inside the site prefix, minus the excluded hrefs/URLs."""
    p = prefix if isinstance(prefix, Column) else F.lit(prefix)
    keep = F.col("abs_url").startswith(p)
    for e in excluded:
        keep = keep & (F.col("href") != F.lit(e))
    for u in drop_urls:
        keep = keep & (F.col("abs_url") != F.lit(u))
    return links.filter(keep)


def dedupe_urls(urls: DataFrame, visited: DataFrame, col: str = "url") -> DataFrame:
    """Distinct canonical URLs not visited yet (canonical = fragment dropped, args sorted)."""
    c = urls.select(U.canonical_url(F.col(col)).alias(col)).distinct()
    v = visited.select(U.canonical_url(F.col(col)).alias(col))
    return c.join(v, col, "left_anti")


def crawl_frontier(edges: DataFrame, seeds: DataFrame, max_depth: int = 8,
                   src: str = "src", dst: str = "dst", key: str = "page_id") -> DataFrame:
    """Breadth-first reachability from the seeds: ``(key, depth)`` with depth = hop distance ≤ max_depth.

    At most ``max_depth`` rounds; each round joins only the new frontier with
    the edges, drops visited nodes and writes the new level as a table in the shared
    checkpoint folder, so lineage stays one round long.  Edges are bucketed by
    source and levels by node, both in as many buckets as there are shuffle
    partitions, so a round shuffles its frontier and what that reaches, and
    neither edges nor visited nodes again.  A source of more than ``HUB_EDGES``
    edges is cut into blocks, which the frontier meets one by one.
    Edges without a source or target, and null seeds, are left out.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = edges.select(F.col(src).alias("__s"), F.col(dst).alias(key)).dropna().distinct()
    links = spark.read.schema(links.schema).parquet(_written(links, "frontier-links"))
    degree = links.groupBy("__s").count().filter(F.col("count") > HUB_EDGES)
    hubs = degree.select("__s", F.ceil(F.col("count") / HUB_EDGES).cast("int").alias("__n"))
    hubs = spark.read.schema(hubs.schema).parquet(_written(hubs, "frontier-hubs"))
    block = F.when(F.col("__n").isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.col("__n"))).cast("int")
    first = seeds.select(F.col(key)).dropna().distinct().withColumn("depth", F.lit(0))
    tables, levels = [], []

    def bucketed(df, *by):
        """Writes a bucketed table, one file a bucket; gives the table and its files."""
        path, name = work_path(spark, "frontier"), f"frontier_{uuid.uuid4().hex}"
        tables.append(name)
        (df.repartition(n, *by).write.format("parquet").option("path", path).bucketBy(n, *by).sortBy(*by).saveAsTable(name))
        return spark.table(name), spark.read.schema(df.schema).parquet(path)

    try:
        e, _ = bucketed(_with_hubs(links, hubs).select("__s", block.alias("__b"), key), "__s", "__b")
        levels.append(bucketed(first, key))
        for d in range(1, max_depth + 1):
            out = _with_hubs(levels[-1][0].select(F.col(key).alias("__s")), hubs)
            out = out.select("__s", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1)).alias("__b"))
            nxt = reached(out, e, [seen for seen, _ in levels], key, n).withColumn("depth", F.lit(d))
            # the level size is observed while it is written (no extra emptiness job)
            obs = Observation(f"frontier-{d}")
            levels.append(bucketed(nxt.observe(obs, F.count(F.lit(1)).alias("n")), key))
            if not obs.get["n"]:
                break
    finally:  # the names only: the files belong to no table
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    visited = reduce(DataFrame.unionByName, [files for _, files in levels])
    return visited.select(key, F.col("depth").cast("int").alias("depth"))


def reached(frontier: DataFrame, edges: DataFrame, seen: list[DataFrame], key: str, n: int) -> DataFrame:
    """Distinct targets of the frontier's edges that no earlier level holds; edges and levels stay where they lie."""
    out = frontier.repartition(n, "__s", "__b").join(edges, ["__s", "__b"]).select(key).distinct()
    for level in seen:
        out = out.join(level.select(key), key, "left_anti")
    return out


def _written(df: DataFrame, name: str) -> str:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def _with_hubs(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """Adds the number of blocks ``__n`` of a hub, null for other sources."""
    return join_small(rows, hubs, "__s", "left", max_rows=MAX_HUBS)


def link_edges(pages: DataFrame, seed_urls, profile: str = "default", prefix: str | None = None,
               excluded=(EXCLUDED_HREF,), drop_urls=None) -> DataFrame:
    """Page-to-page edges of a stored crawl: ``(src, dst)`` page ids.

    Each titled page is cleaned (seed pages with the seed element list), its
    anchors resolved and filtered to the site, and targets matched to stored
    pages by canonical URL (fragment dropped, arguments sorted).
    """
    tags, seed_tags = H.PROFILES[profile if profile in H.PROFILES else "default"]
    crawl = CRAWL_PROFILES.get(profile, CRAWL_PROFILES["default"])
    prefix = prefix or SITE_PREFIX
    drop_urls = crawl["drop"] if drop_urls is None else drop_urls
    seeds = [canonical_literal(u) for u in seed_urls]
    is_seed = U.canonical_url(F.col("url")).isin(seeds)
    cleaned = pages.select(
        "page_id", "url", H.has_title(F.col("html")).alias("titled"),
        H.strip_inputs(F.when(is_seed, H.strip_elements(F.col("html"), seed_tags))
                       .otherwise(H.strip_elements(F.col("html"), tags))).alias("html"),
    ).filter("titled")
    links = filter_links(resolve_links(extract_links(cleaned)), prefix, excluded, drop_urls)
    targets = pages.select(F.col("page_id").alias("dst"), U.canonical_url(F.col("url")).alias("__u"))
    return (links.select(F.col("page_id").alias("src"), U.canonical_url(F.col("abs_url")).alias("__u"))
            .join(targets, "__u").select("src", "dst").distinct())


def canonical_literal(url: str) -> str:
    """Driver-side canonical form of a literal seed URL (same rule as ``canonical_url``)."""
    base = url.split("#", 1)[0]
    path, _, query = base.partition("?")
    args = sorted(a for a in query.split("&") if a)
    return path + ("?" + "&".join(args) if args else "")


def site_crawl(pages: DataFrame, profile: str = "default", seed_urls=None, max_depth: int | None = None,
               prefix: str | None = None) -> DataFrame:
    """Which stored pages a crawl with this profile reaches, and at what depth: ``(page_id, url, depth)``."""
    crawl = CRAWL_PROFILES[profile]
    seed_urls = seed_urls or crawl["seeds"]
    depth = crawl["max_depth"] if max_depth is None else max_depth
    canon = [canonical_literal(u) for u in seed_urls]
    seeds = pages.filter(U.canonical_url(F.col("url")).isin(canon)).select("page_id")
    edges = link_edges(pages, seed_urls, profile, prefix)
    reached = crawl_frontier(edges, seeds, depth)
    return reached.join(pages.select("page_id", "url"), "page_id").select("page_id", "url", "depth")
