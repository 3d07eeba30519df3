"""Literal rows for the page parser (FIXTURES.md) and link handling."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import urls as U
from quarry.functions.text import collapse_whitespace, py_strip
from quarry.operators import extract as EX
from quarry.operators import links as LK


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("v")).first()["v"]


def test_element_removal_golden(spark):
    doc = '<div><p><head>This is a link:</head> <a href="http://www.example.com">example</a></p></div>'
    assert one(spark, H.strip_elements(F.col("h"), ["head"]), h=doc) == \
        '<div><p> <a href="http://www.example.com">example</a></p></div>'


def test_removal_is_case_insensitive_and_spans_lines(spark):
    doc = "a<SCRIPT type=x>\nvar x;\n</script>b<img />c<img src=1/>d"
    # only a bare self-closing element matches the short form; attributes keep it (markup removal drops it later)
    assert one(spark, H.strip_elements(F.col("h"), ["script", "img"]), h=doc) == "abc<img src=1/>d"


@pytest.mark.parametrize("depth,profile,expected", [
    (0, "default", "H"), (1, "default", ""), (1, "literal", "S"), (0, "literal", "H")])
def test_seed_page_profiles(spark, depth, profile, expected):
    tags, seed = H.PROFILES[profile]
    df = spark.createDataFrame([(f"<header>H</header><select>S</select>", depth)], "h string, d int")
    out = df.select(H.strip_elements_seed(F.col("h"), F.col("d"), tags, seed).alias("v")).first()["v"]
    assert py_text(out) == expected


def py_text(s):
    import re
    return re.sub(r"<[^>]*>", "", s)


def test_untitled_page_has_no_record_and_no_links(spark):
    pages = spark.createDataFrame([(1, "https://x.example/a", '<html><body><a href="/b">b</a></body></html>', 1),
                                   (2, "https://x.example/b", "<html><title>T 12</title><body>t</body></html>", 1)],
                                  "page_id long, url string, html string, depth int")
    rec = EX.page_records(pages)
    assert [r.page_id for r in rec.collect()] == [2]
    titled = pages.select("page_id", "url", "html", H.extract_title(F.col("html")).alias("title")) \
        .filter(F.col("title").isNotNull())
    assert LK.extract_links(titled).count() == 0


@pytest.mark.parametrize("title,expected", [("A12 B34", "A12"), ("Part 7 kit", "7"), ("Ice maker", "N/A")])
def test_title_model_num(spark, title, expected):
    assert one(spark, H.title_model_num(F.col("t")), t=title) == expected


def test_whitespace_collapse_is_unicode(spark):
    assert one(spark, py_strip(collapse_whitespace(F.col("t"))), t="a  b ") == "a b"


def test_text_nodes_entities_and_boilerplate(spark):
    html = ("<html><head><title>x</title></head><body><p>Fish &amp; chips</p><!-- c --><p>&lt;b&gt;</p>"
            "<div>Your coupon for will be reflected when you check out!</div><style>p{}</style></body></html>")
    assert one(spark, H.page_text(F.col("h"), H.DEFAULT_TAGS), h=html) == "Fish & chips <b>"


def test_title_entities_decoded_not_trimmed(spark):
    assert one(spark, H.extract_title(F.col("h")), h="<title> A &amp; B </title>") == " A & B "
    assert one(spark, H.extract_title(F.col("h")), h="<title></title>") is None


def test_part_number_in_url(spark):
    assert one(spark, H.url_part_num(F.col("u")), u="https://x/PS1234-abc/PS99") == "PS1234"
    assert one(spark, H.url_part_num(F.col("u")), u="https://x/ps1234") == "N/A"


def test_link_extraction_quotes_comments_order(spark):
    html = """<a href="/one">1</a><!-- <a href="/hidden"> --><A class=x HREF='/two'>2</A><a data-href="/no" href=/three>"""
    pages = spark.createDataFrame([(1, "https://s.example/p/q", html)], "page_id long, url string, html string")
    got = [(r.ord, r.href) for r in LK.extract_links(pages).orderBy("ord").collect()]
    assert got == [(0, "/one"), (1, "/two"), (2, "/three")]


def test_link_extraction_passes_over_whole_attributes(spark):
    html = """<a title="x > y" href="/one">1</a><a/href=/two>2</a><a data="1"href='/three'>3</a><a title="z href=/no">4</a><abbr href=/no>"""
    pages = spark.createDataFrame([(1, "https://s.example/p/q", html)], "page_id long, url string, html string")
    assert [r.href for r in LK.extract_links(pages).orderBy("ord").collect()] == ["/one", "/two", "/three"]


def test_markup_with_quoted_signs_and_title_in_comment(spark):
    assert one(spark, py_strip(collapse_whitespace(H.html_to_text(F.col("h")))),
               h="""<p title="a > b" class='c > d'>one</p><p title=don't>two</p> it's <b>three</b>""") == "one two it's three"
    assert one(spark, H.extract_title(F.col("h")), h="<!-- <title>no</title> --><title>yes</title>") == "yes"
    assert one(spark, H.html_to_text(F.col("h")), h="<p " + "x=1 " * 3_000 + ">t") == " t"


BASES = ["https://s.example/a/b/c?x=1#f", "https://s.example", "http://s.example/dir/", "https://s.example/a/../b//c", "https://s.example?"]
HREFS = ["/r", "rel", "rel/x", "?q=2", "#top", "", "//other.example/p", "https://abs.example/z",
         "../up", "./same", "a/../b", "mailto:x@y", "#", "?", " /lead", "/tail\n", "HTTPS://Up.example/x", "https:foo",
         "a//b", "/a//b", "///x", "p;", "x?#", "/x?u=http://y/z", "//h.example", "https://abs.example/a/../z", "/a/.;x", "javascript:void(0)", "é/ü"]


def test_resolve_links_matches_urljoin(spark):
    rows = [(i, b, h) for i, (b, h) in enumerate((b, h) for b in BASES for h in HREFS)]
    df = spark.createDataFrame(rows, "page_id long, url string, href string")
    got = {r.page_id: r.abs_url for r in LK.resolve_links(df).collect()}
    for i, b, h in rows:
        assert got[i] == urljoin(b, h), (b, h)


def test_canonical_url(spark):
    c = U.canonical_url(F.col("u"))
    assert one(spark, c, u="https://s.example/p?b=2&a=1#frag") == "https://s.example/p?a=1&b=2"
    assert one(spark, c, u="https://s.example/p?#x") == "https://s.example/p"


def test_crawl_frontier_hop_distance(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 2), (3, 4), (4, 5), (7, 8)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "page_id long")
    got = {r.page_id: r.depth for r in LK.crawl_frontier(edges, seeds, max_depth=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}


def test_crawl_frontier_with_a_hub_in_blocks(spark, monkeypatch):
    """A source with a third of the edges lies in several blocks; depths equal a plain walk."""
    monkeypatch.setattr(LK, "HUB_EDGES", 40)
    edges = [(0, 3 * i) for i in range(1, 200)] + [(i, (7 * i + 3) % 997) for i in range(400)] + [(5, 5), (5, None), (None, 6), (0, 3)]
    want, level = {0: 0, 1: 0}, {0, 1}
    for d in range(1, 5):
        level = {t for s, t in edges if s in level and t is not None} - set(want)
        want.update(dict.fromkeys(level, d))
    df = spark.createDataFrame(edges, "src long, dst long")
    got = LK.crawl_frontier(df, spark.createDataFrame([(0,), (1,), (1,), (None,)], "page_id long"), max_depth=4).collect()
    assert {r.page_id: r.depth for r in got} == want and len(got) == len(want)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("frontier_")]
    assert LK.crawl_frontier(df.limit(0), spark.createDataFrame([(9,)], "page_id long")).collect() == [(9, 0)]


def test_a_round_of_the_frontier_moves_neither_edges_nor_levels(spark, monkeypatch):
    plans, inner = [], LK.reached

    def spy(*args):
        out = inner(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(LK, "reached", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges = spark.range(3000).selectExpr("id % 300 as src", "(id * 7) % 997 as dst")
        LK.crawl_frontier(edges, spark.createDataFrame([(1,)], "page_id long"), max_depth=3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 3 and all(p.count("Exchange hashpartitioning") == 2 for p in plans), plans[-1]


def test_site_crawl_profiles(spark):
    site = "https://shop.example"
    html = lambda title, links: f"<html><head><title>{title}</title></head><body>" + "".join(
        f'<a href="{h}">x</a>' for h in links) + "</body></html>"
    pages = spark.createDataFrame([
        (0, site + "/", html("Home", ["/a", "/ShoppingCart.aspx", "https://other.example/z"])),
        (1, site + "/a", html("A 1", ["/b?y=2&x=1#frag"])),
        (2, site + "/b?x=1&y=2", html("B", ["/c"])),
        (3, site + "/c", html("C", ["/a"])),
        (4, site + "/ShoppingCart.aspx", html("Cart", [])),
        (5, site + "/lost", html("Lost", [])),
    ], "page_id long, url string, html string")
    got = {r.page_id: r.depth for r in LK.site_crawl(pages, seed_urls=[site + "/"], prefix=site + "/").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}
    got2 = {r.page_id: r.depth for r in LK.site_crawl(pages, seed_urls=[site + "/"], prefix=site + "/",
                                                      max_depth=1).collect()}
    assert got2 == {0: 0, 1: 1}


def test_link_edges_single_profile_drops_bare_site_and_never_exempts_seed(spark):
    site = "https://shop.example"
    pages = spark.createDataFrame([
        (0, site + "/start", f'<title>S</title><header><a href="/h">h</a></header><a href="{site}">home</a>'
                             '<a href="/x">x</a>'),
        (1, site + "/x", "<title>X</title>"),
        (2, site + "/h", "<title>H</title>"),
        (3, site, "<title>Home</title>"),
    ], "page_id long, url string, html string")
    single = {(r.src, r.dst) for r in LK.link_edges(pages, [site + "/start"], "single", prefix=site,
                                                      drop_urls=[site]).collect()}
    assert single == {(0, 1)}                      # header links gone, bare site URL dropped
    default = {(r.src, r.dst) for r in LK.link_edges(pages, [site + "/start"], "default", prefix=site,
                                                       drop_urls=[]).collect()}
    assert default == {(0, 1), (0, 2), (0, 3)}     # seed keeps its header; bare URL kept
