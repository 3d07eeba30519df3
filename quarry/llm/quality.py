"""4. Quality rules: robust multivariate outliers, in DataFrame functions alone.

Six statistics of each whole text become a transformed vector.  Per language and
source (or per language, or over all, where fewer than ``MIN_GROUP`` documents
stand; a language's estimate is made from all its documents, that over all from all)
location and scatter are estimated by minimum covariance determinant:
from medians and median deviations, concentration steps keep the share
``COVER`` of the group with the smallest Mahalanobis distances and estimate anew.
A document is rejected by the base rules, or if its distance under the final,
consistency-scaled estimate exceeds a chi-square quantile.

Groups are never gathered: medians and the distance cut come from counts over
fine bins of the value, moments from sums - aggregations with map-side partials,
a row per group afterwards.  Estimates are joined back by group; a hot group is
the split side of that join.

Defined results: a null text counts as empty; an empty text fails the base rules; a
null language or source is a value of its own; equal rows repeat their result; the
estimate over all documents holds a prior scatter with the weight of ``PRIOR_ROWS``
documents, so a few documents reject only what is far from them by that prior; an
empty table gives an empty table; extra input columns are kept, those named like
an output replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import small_side, staged, table, without

SPLIT = r"r'[\x20\x09-\x0D]+'"
WINDOW = 8
COVER = 0.75
STEPS = 4
MIN_GROUP = 100
#: Documents of an ordinary group beyond this share of the chi-square distribution are rejected.
LEVEL = 0.999
BINS = 64
#: Smallest spread of each transformed statistic, where the group's is smaller: departures of this order are never outliers
#: by themselves.  The ranges are many times as wide (shares of duplicate lines to 1, of repeated words to sqrt(0.3) after the base
#: rules), so each statistic alone can pass the cut.
FLOORS = (0.5, 0.1, 0.05, 0.14, 0.11, 0.05)
#: Spread of each statistic before any document of the table is seen (lengths of ordinary texts range over orders of magnitude),
#: and the documents this counts as.
PRIOR = (1.5, 0.2, 0.1, 0.28, 0.22, 0.1)
PRIOR_ROWS = 100
D = len(FLOORS)


def statistics(text: str = "text") -> F.Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_upper of one text.

    Lambda parameters hold what is used more than once, so each is computed once.
    """
    t = f"coalesce({text}, '')"
    windows = f"if(size(h) < {WINDOW}, array(), transform(sequence(1, size(h) - {WINDOW - 1}), i -> xxhash64(slice(h, i, {WINDOW}))))"
    # positions of windows that occur twice or more: neighbours in sorted order
    twice = ("transform(array(sort_array(transform(v, (x, i) -> struct(x, i)))), s -> sort_array(filter(transform(s, (e, k) -> "
             "if(get(s, k - 1).x <=> e.x or get(s, k + 1).x <=> e.x, e.i, null)), p -> p is not null)))[0]")
    covered = (f"transform(array({twice}), ps -> aggregate(transform(ps, (p, k) -> least({WINDOW}, coalesce(get(ps, k + 1) - p, {WINDOW}))), "
               "0, (a, x) -> a + x))[0]")
    repeat = f"transform(array({windows}), v -> if(size(array_distinct(v)) = size(v), 0, {covered}))[0]"
    words = f"filter(split({t}, {SPLIT}), w -> w <> '')"
    by_words = (f"transform(array({words}), ws -> named_struct('n_words', cast(size(ws) as bigint), 'word_chars', "
                f"cast(length(array_join(ws, '')) as bigint), 'n_repeat_words', cast(transform(array(transform(ws, w -> xxhash64(w))), "
                f"h -> {repeat})[0] as bigint)))[0]")
    lines = f"filter(split({t}, '\\n', -1), l -> l rlike r'[^\\x20\\x09-\\x0D]')"
    by_lines = (f"transform(array({lines}), ls -> named_struct('n_lines', cast(size(ls) as bigint), 'n_dup_lines', "
                "cast(size(ls) - size(array_distinct(ls)) as bigint)))[0]")
    return F.expr(f"named_struct('w', {by_words}, 'l', {by_lines}, "
                  f"'n_upper', cast(length({t}) - length(regexp_replace({t}, r'\\p{{Lu}}', '')) as bigint), 'n_symbols', "
                  f"cast(length({t}) - length(regexp_replace({t}, '[#*$%&|<>]', '')) as bigint))")


def vector() -> list[F.Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log(words), F.log(F.greatest(F.col("word_chars") / words, F.lit(1))), F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
            F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / words),
            F.sqrt(F.col("n_upper") / F.greatest("word_chars", F.lit(1)))]


def chi2_cdf(x: float, d: int) -> float:
    """Chi-square distribution function, by the recurrence over degrees of freedom."""
    p, k = (math.erf(math.sqrt(x / 2)), 1) if d % 2 else (1 - math.exp(-x / 2), 2)
    while k < d:
        p -= math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1)) if x > 0 else 0
        k += 2
    return p


def chi2_quantile(q: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < q else (low, mid)
    return (low + high) / 2


def consistency(cover: float, d: int) -> float:
    """Factor that makes the scatter of the innermost share of a normal sample that of the whole."""
    return cover / chi2_cdf(chi2_quantile(cover, d), d + 2)


def _cut(rows: DataFrame, keys: list[str], bin_col: str, share: float) -> DataFrame:
    """Per keys, the first bin up to which at least ``share`` of the rows lie."""
    counts = rows.groupBy(*keys, bin_col).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*keys).orderBy(bin_col)
    counts = counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return counts.filter(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg(F.min(bin_col).alias("cut"))


def _wide(cuts: DataFrame, name: str) -> DataFrame:
    return cuts.groupBy("g").agg(*[F.max(F.when(F.col("dim") == k, (F.col("cut") + 0.5) / BINS)).alias(f"{name}{k}") for k in range(D)])


def _medians(rows: DataFrame, values: list[F.Column]) -> DataFrame:
    long = rows.select("g", F.posexplode(F.array(*[F.floor(v * BINS) for v in values])).alias("dim", "bin"))
    return _cut(long, ["g", "dim"], "bin", 0.5)


def _cholesky(params: DataFrame, scale: float) -> DataFrame:
    """Lower factor l_ij of the scatter c_ij × scale, its diagonal raised to the squared floors."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.greatest(F.col(f"c{i}{j}") * scale, F.lit(FLOORS[i] ** 2)) if i == j else F.col(f"c{i}{j}") * scale
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return params


def _distance(rows: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(D):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in range(1, D)), F.col("y0") ** 2))


def estimates(rows: DataFrame) -> DataFrame:
    """Location m_i and factor l_ij per group g of rows (g, x_i)."""
    def joined(params):
        return rows.join(small_side(params, 400), "g")

    med = staged(_wide(_medians(rows, [F.col(f"x{k}") for k in range(D)]), "m"), "mcd-median")
    mad = _wide(_medians(joined(med), [F.abs(F.col(f"x{k}") - F.col(f"m{k}")) for k in range(D)]), "s")
    start = med.join(mad, "g").withColumns({f"c{i}{j}": (F.col(f"s{i}") * 1.4826) ** 2 if i == j else F.lit(0.0) for i in range(D) for j in range(i + 1)})
    params = staged(_cholesky(start, 1.0).select("g", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)]), "mcd-start")
    for step in range(STEPS):
        near = _distance(joined(params)).withColumn("bin", F.floor(F.log1p("d2") * BINS))
        cut = staged(_cut(near, ["g"], "bin", COVER), "mcd-cut")
        inner = near.join(small_side(cut, 32), "g").filter("bin <= cut")
        dev = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)]
        sums = inner.groupBy("g").agg(F.count("*").alias("n"), *[F.first(f"m{i}").alias(f"o{i}") for i in range(D)],
                                      *[F.sum(dev[i]).alias(f"a{i}") for i in range(D)],
                                      *[F.sum(dev[i] * dev[j]).alias(f"b{i}{j}") for i in range(D) for j in range(i + 1)])
        # rounded, so that the order of the sums doesn't show
        prior_rows = F.when(F.col("g") == "all", F.lit(PRIOR_ROWS)).otherwise(F.lit(0))
        scatter = {f"c{i}{j}": F.round(F.col(f"b{i}{j}") / F.col("n") - F.col(f"a{i}") * F.col(f"a{j}") / F.col("n") ** 2, 9) * consistency(COVER, D)
                   for i in range(D) for j in range(i + 1)}
        moved = sums.select("g", *[F.round(F.col(f"o{i}") + F.col(f"a{i}") / F.col("n"), 9).alias(f"m{i}") for i in range(D)],
                            *[((c * F.col("n") + prior_rows * (PRIOR[int(k[1])] ** 2 if k[1] == k[2] else 0.0)) / (F.col("n") + prior_rows)).alias(k)
                              for k, c in scatter.items()])
        params = staged(_cholesky(moved, 1.0).select("g", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)]), f"mcd-{step}")
    return params


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", level: float = LEVEL, carry: list[str] | None = None) -> DataFrame:
    """Statistics and verdict of every document: the columns ``carry`` (default: all but the text), then
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept"]
    docs = without(docs, made)
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(carry)],
                       F.to_json(F.struct(F.col(lang).alias("a"), F.col(source).alias("b"))).alias("__fine"),
                       F.to_json(F.struct(F.col(lang).alias("a"))).alias("__coarse"), statistics(f"`{text}`").alias("st"))
    rows = rows.select("*", "st.w.*", "st.l.*", "st.n_symbols", "st.n_upper").drop("st")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    rows = staged(rows.withColumns({f"x{k}": v for k, v in enumerate(vector())}), "quality")
    count = staged(rows.filter("not base_failed").groupBy("__fine", "__coarse").agg(F.count("*").alias("n")), "quality-count")
    langs = count.groupBy("__coarse").agg(F.sum("n").alias("n_coarse"), F.min("n").alias("least"))
    rare = langs.agg(F.min("n_coarse") < MIN_GROUP).first()[0]
    own, wide = F.col("n") >= MIN_GROUP, F.col("n_coarse") >= MIN_GROUP
    # g judges the documents of a fine group; each enters the estimates of all levels in ``levels``
    levels = F.array(F.when(own, F.col("__fine")), F.when(wide & (F.col("least") < MIN_GROUP), F.col("__coarse")), F.when(F.lit(bool(rare)), F.lit("all")))
    group = count.join(small_side(langs, 100), "__coarse").select(
        "__fine", F.when(own, F.col("__fine")).when(wide, F.col("__coarse")).otherwise("all").alias("g"), F.array_compact(levels).alias("levels"))
    group = staged(group, "quality-group")
    rows = rows.join(small_side(group, 200), "__fine", "left")
    params = estimates(rows.filter("not base_failed").select(F.explode("levels").alias("g"), *[f"x{k}" for k in range(D)]))
    rows = _distance(rows.join(small_side(params, 400), "g", "left"))
    outlier = F.coalesce(F.col("d2") > chi2_quantile(level, D), F.lit(False))
    return rows.select(*[F.col(f"__in{i}").alias(c) for i, c in enumerate(carry)], *made[:-2],
                       F.col("d2").alias("distance2"), (~F.col("base_failed") & ~outlier).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("distance2")
