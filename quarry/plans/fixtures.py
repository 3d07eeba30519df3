"""Derived views over the driver tables (see FIXTURES.md).

The given ``embeddings`` table plays the vector index: each vector gets a
model and a part number, and each user turn of ``conversations`` becomes a
question whose vector is one of those rows, with ids written into its text
so that all four search routes and the fallback occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import Tables


def chunk_index_fx(t: Tables) -> DataFrame:
    e = t.embeddings
    return e.select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("M"), F.lpad(F.col("label").cast("string"), 3, "0")).alias("model_num"),
        F.concat(F.lit("PS"), (F.col("vec_id") % 20).cast("string")).alias("ps_num"),
        F.col("embedding"),
    )


def question_fx(t: Tables) -> DataFrame:
    """User turns as questions: (conv_id, turn, vec_id, query)."""
    c = t.conversations
    n_vec = t.embeddings.select(F.count(F.lit(1))).scalar()
    conv = F.col("conv_id")
    m3 = F.lpad((conv % 10).cast("string"), 3, "0")
    prefix = (
        F.when(conv % 4 == 0, F.concat(F.lit("(M"), m3, F.lit(") PS"),
                                       ((conv * 3 + F.col("turn")) % 20).cast("string"), F.lit(" ")))
        .when(conv % 4 == 1, F.concat(F.lit("M"), m3, F.lit("? ")))
        .when(conv % 4 == 2, F.concat(F.lit("PS"), (conv % 25).cast("string"), F.lit(" ")))
        .otherwise(F.lit(""))
    )
    return c.filter(F.col("role") == "user").select(
        "conv_id", "turn",
        ((conv * 8 + F.col("turn")) % n_vec).alias("vec_id"),
        F.concat(prefix, F.col("text")).alias("query"),
    )


def question_vectors(t: Tables, questions: DataFrame | None = None) -> DataFrame:
    """Questions with their vector (row ``vec_id`` of the embeddings table)."""
    q = questions if questions is not None else question_fx(t)
    e = t.embeddings.select("vec_id", F.col("embedding").alias("qvec"))
    return q.join(e, "vec_id", "inner")


def qa_fx(t: Tables) -> DataFrame:
    """Question/answer strings: each user turn paired with the next turn when it is the assistant's."""
    from quarry.operators.context import answer_history

    return answer_history(t.conversations)


def timing_fx(t: Tables) -> DataFrame:
    e = t.events
    return e.filter(F.col("value").isNotNull()).select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"),
        F.col("event_type").alias("stage"), F.col("value").alias("seconds"),
    )


def cleaned_html(t: Tables, profile: str = "default") -> DataFrame:
    """Pages with their ordinary-page element list removed (links are read from this)."""
    from quarry.functions import html as H

    from quarry.session import spread

    tags, _ = H.PROFILES[profile]
    p = spread(t.pages)
    return p.select("page_id", "url", H.strip_inputs(H.strip_elements(F.col("html"), tags)).alias("html"),
                    H.extract_title(F.col("html")).alias("title"), H.has_title(F.col("html")).alias("titled"))


SHOP_PARTS = ('<header>Shop header</header><select name="s"><option>one choice</option></select><input type="text" name="q">'
              '<img src="a.png"/><button>Buy now</button><noscript>no script here</noscript><p>after the form</p> '
              'Your coupon for has been applied and will be reflected when you check out! '
              '<a href="/ShoppingCart.aspx">cart</a> <a href="https://elsewhere.example/x.htm">off the site</a> ')


def shop_pages_fx(t: Tables) -> DataFrame:
    """Every page as a shop would serve it: form elements, a coupon phrase, a cart link and an off-site
    link at its end; part urls on a third, no title on a fifth."""
    n = F.col("page_id").cast("string")
    html = F.concat(F.col("html"), F.lit(SHOP_PARTS), F.lit('<a href="/page-'), n, F.lit('.htm">next</a>'))
    return t.pages.select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*", 0), F.lit("/PS1175"), n, F.lit("-Seal.htm"))).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 5 == 4, F.regexp_replace(html, "(?is)<title>.*?</title>", "")).otherwise(html).alias("html"))


def paragraphs_fx(t: Tables) -> DataFrame:
    """Every document with a blank line after each sentence."""
    return t.documents.select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n")).alias("text"))


def edges_fx(t: Tables) -> DataFrame:
    """Link graph of the fixture: the pages' own links point off-site, so link
    ordinal ``ord`` of page ``p`` leads to page ``(p*3 + ord*17 + 1) % count(pages)``."""
    from quarry.operators.links import extract_links

    n_pages = t.pages.select(F.count(F.lit(1))).scalar()
    links = extract_links(cleaned_html(t).filter("titled"))
    return links.select(F.col("page_id").alias("src"),
                        ((F.col("page_id") * 3 + F.col("ord") * 17 + 1) % n_pages).alias("dst"))


def frontier_fx(t: Tables, max_depth: int = 8) -> DataFrame:
    """Crawl depth of every page reachable from page 0."""
    from quarry.operators.links import crawl_frontier

    seeds = t.pages.filter(F.col("page_id") == 0).select("page_id")
    return crawl_frontier(edges_fx(t), seeds, max_depth)
