"""URL column functions: link resolution, site prefix, canonical form."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
DOT_SEGMENT = r"(^|/)\.\.?(/|$|[?#;])"
PLAIN_BASE = r"^https?://[^/?#]"
#: A web address, another host, or a path, query or fragment whose first part holds no colon.
PLAIN_HREF = r"^(?:https?://[^/?#]|//[^/?#]|[^/:?#]+(?:$|[/?#])|/(?:$|[^/])|\?|#)"
#: Control characters and white space, brackets, path parameters, an empty query or fragment, doubled slashes in the path.
ODD = r"[\x00-\x20\[\];]|[?#]$|\?#|^(?:[^:/?#]+:)?(?://)?[^?#]*[^:/?#]//"


def origin(url: Column) -> Column:
    return F.regexp_extract(url, ORIGIN, 1)


def _directory(base: Column) -> Column:
    no_query = F.regexp_replace(base, r"[?#].*$", "")
    return F.when(no_query.rlike(ORIGIN + "$"), F.concat(no_query, F.lit("/"))).otherwise(
        F.regexp_replace(no_query, "[^/]*$", ""))


def resolve_native(base: Column, href: Column) -> Column:
    """RFC 3986 resolution for references without dot segments."""
    return (
        F.when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, SCHEME, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href == "", base)
        .otherwise(F.concat(_directory(base), href))
    )


def _join(base: str | None, href: str | None) -> str | None:
    if base is None or href is None:
        return None
    try:
        return urljoin(base, href)
    except ValueError:  # such as an unclosed "[" in the host
        return None


@F.pandas_udf(T.StringType())
def urljoin_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_join(b, h) for b, h in zip(base, href)], dtype=object)


def is_plain(base: Column, href: Column) -> Column:
    """Pairs that ``resolve_native`` resolves as ``urljoin`` does; null counts as not plain."""
    plain_base = base.rlike(PLAIN_BASE) & ~base.rlike(ODD) & ~base.rlike(DOT_SEGMENT)
    plain_href = (href == "") | (href.rlike(PLAIN_HREF) & ~href.rlike(ODD) & ~href.rlike(DOT_SEGMENT))
    return F.coalesce(plain_base & plain_href, F.lit(False))


def canonical_url(url: Column) -> Column:
    """Fragment dropped, query arguments sorted, empty arguments dropped."""
    no_frag = F.regexp_replace(url, "#.*$", "")
    path = F.regexp_extract(no_frag, r"^([^?]*)", 1)
    args = F.filter(F.split(F.regexp_extract(no_frag, r"\?(.*)$", 1), "&"), lambda a: a != F.lit(""))
    return F.when(F.size(args) > 0, F.concat(path, F.lit("?"), F.array_join(F.array_sort(args), "&"))).otherwise(path)
