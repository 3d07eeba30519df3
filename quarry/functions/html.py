"""HTML → page-record column functions (pure Column → Column, no shuffle).

Regex extraction, not a full HTML parser: tags are removed by pattern, text
nodes are what lies between tags, entities are decoded last.
"""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import WS, collapse_whitespace, count_digits, drop_phrases, py_strip, split_ws

# Element lists as the reference's page parser wrote them.  The
# missing comma that fuses "input" and "select" into one name is kept here; the
# corrected lists below are the default profile.
LITERAL_TAGS = ["noscript", "script", "head", "header", "footer", "button", "inputselect", "img"]
LITERAL_SEED_TAGS = ["noscript", "script", "head", "footer", "button", "select", "input", "img"]

# Default profile: comma restored, and <style> text dropped as well.
DEFAULT_TAGS = ["noscript", "script", "head", "header", "footer", "button", "input", "select", "img", "style"]
DEFAULT_SEED_TAGS = ["noscript", "script", "head", "footer", "button", "select", "input", "img", "style"]

# Boilerplate sentences removed from page text, in this order.
BOILERPLATE = [
    "Your coupon for will be reflected when you check out!",
    "Your coupon for has been applied and will be reflected when you check out!",
    "Hello! You're visiting the PartSelect site in U.S. Would you like to shop on the Canadian site? Stay on this site Go to Canadian site",
]

# Profiles: (ordinary-page tags, seed-page tags).  "single" never exempts the seed.
PROFILES = {
    "default": (DEFAULT_TAGS, DEFAULT_SEED_TAGS),
    "literal": (LITERAL_TAGS, LITERAL_SEED_TAGS),
    "single": (LITERAL_TAGS, LITERAL_TAGS),
}


def element_alternatives(tag: str) -> tuple[str, str]:
    """Regex (after the leading ``<``) for an element with its content, and for its self-closing form."""
    return f"{tag}\\b.*?</{tag}>", f"{tag}\\s*/>"


def strip_elements_pattern(tags) -> str:
    """Static pattern (used by the oracle): one alternation, case-insensitive, dot-all.

    The shared ``<`` is factored out so positions that are not a tag fail at once.
    """
    alts = []
    for t in tags:
        alts.extend(element_alternatives(t))
    return "(?is)<(?:" + "|".join(alts) + ")"


def strip_elements(html: Column, tags) -> Column:
    """Delete listed elements together with their content, in one left-to-right pass.

    A paired alternative can only match when its closing tag occurs in the
    page, so it is left out of the row's pattern otherwise.  That keeps the
    result identical while avoiding a rescan to the end of the page for every
    unclosed ``<img>`` (quadratic on large pages).
    """
    low = F.lower(html)
    parts = []
    for t in tags:
        paired, selfclose = element_alternatives(t)
        parts.append(F.when(F.instr(low, f"</{t}") > 0, F.lit(paired)))
        parts.append(F.lit(selfclose))
    pattern = F.concat(F.lit("(?is)<(?:"), F.concat_ws("|", *parts), F.lit(")"))
    return F.regexp_replace(html, pattern, F.lit(""))


def strip_elements_seed(html: Column, depth: Column, tags, seed_tags) -> Column:
    """The seed page (depth 0) is cleaned with its own element list."""
    return F.when(depth == 0, strip_elements(html, seed_tags)).otherwise(strip_elements(html, tags))


def strip_inputs(html: Column) -> Column:
    """Remove ``<input …>`` void tags (case-sensitive, as written)."""
    return F.regexp_replace(html, "<input[^>]*>", "")


COMMENT = "(?s)<!--.*?-->"
# a tag ends at the first ">" outside a quoted attribute value
MARKUP = r"""<[A-Za-z/!?][^>=]*+(?:=\s*+(?:"[^"]*"|'[^']*')?+[^>=]*+)*+>"""


def strip_markup(html: Column) -> Column:
    """Replace comments and tags by one space each; text nodes stay in order."""
    return F.regexp_replace(F.regexp_replace(html, COMMENT, " "), MARKUP, " ")


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """Decode HTML character references (named, decimal, hex)."""
    return s.map(lambda v: v if v is None or "&" not in v else _html.unescape(v))


def html_to_text(html: Column) -> Column:
    """All remaining text nodes, space separated, entities decoded last."""
    return unescape_html(strip_markup(html))


def _raw_title(html: Column) -> Column:
    bare = F.when(F.instr(html, "<!--") > 0, F.regexp_replace(html, COMMENT, " ")).otherwise(html)
    return F.regexp_extract(bare, r"(?is)<title\b[^>]*>([^<]*)", 1)


def extract_title(html: Column) -> Column:
    """First ``<title>`` text of the page outside comments, decoded, not trimmed; NULL when absent or empty."""
    raw = _raw_title(html)
    return F.when(raw != "", unescape_html(raw))


def has_title(html: Column) -> Column:
    """Whether ``extract_title`` finds one; native, so a filter by it starts no Python worker."""
    return F.coalesce(_raw_title(html) != "", F.lit(False))


def richest_word(words: Column, min_digits: int) -> Column:
    """Word with the most decimal digits; the first one wins ties; "N/A" below the threshold."""
    init = F.struct(F.lit(min_digits - 1).alias("n"), F.lit("N/A").alias("w"))

    def step(acc, w):
        n = count_digits(w)
        return F.when(n > acc["n"], F.struct(n.alias("n"), w.alias("w"))).otherwise(acc)

    return F.aggregate(words, init, step, lambda acc: acc["w"])


def title_model_num(title: Column, min_digits: int = 1) -> Column:
    """Model number of a page: its title word with the most digits (one digit is enough)."""
    return F.coalesce(richest_word(split_ws(title), min_digits), F.lit("N/A"))


PART_PATTERN = r"PS\p{Nd}+"


def url_part_num(url: Column, pattern: str = PART_PATTERN) -> Column:
    """First part number in a string, else "N/A"."""
    return F.coalesce(F.nullif(F.regexp_extract(url, pattern, 0), F.lit("")), F.lit("N/A"))


def page_text(html: Column, tags, seed_tags=None, depth: Column | None = None, phrases=BOILERPLATE) -> Column:
    """Cleaned page text: strip elements, strip inputs, text nodes, collapse, boilerplate, strip."""
    cleaned = strip_elements(html, tags) if depth is None else strip_elements_seed(html, depth, tags, seed_tags)
    text = collapse_whitespace(html_to_text(strip_inputs(cleaned)))
    return py_strip(drop_phrases(text, phrases))


__all__ = [
    "BOILERPLATE", "DEFAULT_TAGS", "DEFAULT_SEED_TAGS", "LITERAL_TAGS", "LITERAL_SEED_TAGS", "PROFILES",
    "strip_elements", "strip_elements_seed", "strip_inputs", "strip_markup", "html_to_text", "unescape_html",
    "extract_title", "has_title", "title_model_num", "url_part_num", "richest_word", "page_text", "WS",
]
