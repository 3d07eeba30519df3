"""DuckDB SQL fragments for the oracle: the same rules as the Spark column
functions, written as ANSI-ish SQL over the pre-registered driver views."""

from __future__ import annotations

from quarry.functions.html import BOILERPLATE, PART_PATTERN, strip_elements_pattern
from quarry.functions.text import PUNCTUATION, WS

# The oracle's own patterns, not those of the code under test.
COMMENT = "(?s)<!--.*?-->"
MARKUP = "<[A-Za-z/!?][^>]*>"
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(WS + '+')}), lambda w: w <> '')"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, {lit(WS + '+')}, ' ', 'g')"


def ndigits(x: str) -> str:
    return f"length(regexp_replace({x}, '\\P{{Nd}}', '', 'g'))"


def richest(words: str, min_digits: int) -> str:
    """First word with the most digits, if it has at least ``min_digits``."""
    ds = f"list_transform({words}, lambda w: {ndigits('w')})"
    return (f"coalesce(case when list_max({ds}) >= {min_digits} "
            f"then ({words})[list_position({ds}, list_max({ds}))] end, 'N/A')")


def title_model(title: str) -> str:
    return richest(split_ws(title), 1)


def query_model(q: str) -> str:
    words = f"list_transform({split_ws(q)}, lambda w: trim(w, {lit(PUNCTUATION)}))"
    return richest(words, 3)


def part_num(x: str) -> str:
    return f"coalesce(nullif(regexp_extract({x}, {lit(PART_PATTERN)}, 0), ''), 'N/A')"


def unescape(x: str) -> str:
    """The character references that occur in the driver pages."""
    for ent, ch in [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"),
                    ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " ")]:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def strip_elements(x: str, tags) -> str:
    return f"regexp_replace({x}, {lit(strip_elements_pattern(tags))}, '', 'g')"


def strip_inputs(x: str) -> str:
    return f"regexp_replace({x}, '<input[^>]*>', '', 'g')"


def html_to_text(x: str) -> str:
    return unescape(f"regexp_replace(regexp_replace({x}, {lit(COMMENT)}, ' ', 'g'), {lit(MARKUP)}, ' ', 'g')")


def drop_phrases(x: str, phrases=BOILERPLATE) -> str:
    for p in phrases:
        x = f"replace({x}, {lit(p)}, '')"
    return x


def page_text(html: str, tags, seed_tags=None, depth: str | None = None) -> str:
    if depth is None:
        cleaned = strip_elements(html, tags)
    else:
        cleaned = f"case when {depth} = 0 then {strip_elements(html, seed_tags)} else {strip_elements(html, tags)} end"
    return py_strip(drop_phrases(collapse(html_to_text(strip_inputs(cleaned)))))


def extract_title(html: str) -> str:
    raw = f"regexp_extract({html}, {lit('(?is)<title\\b[^>]*>([^<]*)')}, 1)"
    return f"case when {raw} <> '' then {unescape(raw)} end"


def sqdist(a: str, b: str, digits: int = 9) -> str:
    """Squared L2 distance in DOUBLE, rounded like the Spark kernel."""
    return (f"round(list_sum(list_transform(list_zip(cast({a} as double[]), cast({b} as double[])), "
            f"lambda p: (p[1] - p[2]) * (p[1] - p[2]))), {digits})")
