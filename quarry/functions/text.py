"""Shared character classes and small text column functions.

Regex classes are emitted in two dialects from one definition: Java (Spark)
and RE2 (the DuckDB oracle), so both engines split and collapse on exactly
the same characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` treats as white space
# (the reference splits and collapses with Python semantics), as code point ranges.
WHITESPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]

# Fixed value: Python's ``string.punctuation`` (stripped from question words).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _java_cp(cp: int) -> str:
    return f"\\x{{{cp:X}}}"


def ws_class(dialect: str = "java") -> str:
    """Character class of white space in the given regex dialect."""
    parts = []
    for lo, hi in WHITESPACE_RANGES:
        a, b = _java_cp(lo), _java_cp(hi)
        parts.append(a if lo == hi else f"{a}-{b}")
    return "[" + "".join(parts) + "]"


WS = ws_class("java")          # Java and RE2 both accept \x{HEX}
NOT_WS = "[^" + WS[1:]
# the same characters for Java alone: three ranges turn most others away before the ten are tried
WS_RUN = r"[[^!-~\x{A1}-\x{167F}\x{3001}-\x{10FFFF}]&&" + WS + "]+"


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing white space.

    Runs to the end and back to the last other character; white space inside isn't tried.
    """
    return F.regexp_extract(col, f"(?s)^{WS}*+(.*{NOT_WS})?+", 1)


def split_ws(col: Column) -> Column:
    """Python ``str.split()``: words separated by runs of white space, no empties."""
    return F.filter(F.split(col, WS_RUN), lambda w: w != F.lit(""))


def collapse_whitespace(col: Column) -> Column:
    """Every run of white space (Unicode included) becomes one space."""
    return F.regexp_replace(col, WS_RUN, " ")


def drop_phrases(col: Column, phrases) -> Column:
    """Remove literal phrases in order, without re-collapsing white space."""
    for p in phrases:
        col = F.replace(col, F.lit(p), F.lit(""))
    return col


def count_digits(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"\P{Nd}", ""))
