"""Identifier extraction from questions and routing of the filtered search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.html import PART_PATTERN, richest_word, url_part_num
from quarry.functions.text import PUNCTUATION, split_ws

NA = "N/A"

# Route names of the four search branches.
ROUTE_BOTH, ROUTE_MODEL, ROUTE_PART, ROUTE_NONE = "both", "model", "part", "none"


def query_model_num(query: Column, min_digits: int = 3) -> Column:
    """Model number in a question: punctuation stripped from word ends, at least 3 digits."""
    words = F.transform(split_ws(query), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    return F.coalesce(richest_word(words, min_digits), F.lit(NA))


def query_part_num(query: Column, pattern: str = PART_PATTERN) -> Column:
    return url_part_num(query, pattern)


def resolve_id_clash(model_num: Column, part_num: Column) -> Column:
    """When both ids are the same string the model id is dropped."""
    return F.when(model_num == part_num, F.lit(NA)).otherwise(model_num)


def route(model_num: Column, part_num: Column) -> Column:
    has_m, has_p = model_num != F.lit(NA), part_num != F.lit(NA)
    return (
        F.when(has_m & has_p, F.lit(ROUTE_BOTH))
        .when(has_m, F.lit(ROUTE_MODEL))
        .when(has_p, F.lit(ROUTE_PART))
        .otherwise(F.lit(ROUTE_NONE))
    )
