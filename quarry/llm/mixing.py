"""2. Mixing sources to target weights by min-cost flow.

Documents may belong to several overlapping sources.  They are aggregated by
membership pattern; a flow network routes each pattern's words to the quotas of
its sources, where reading a pattern a second and third time costs 1 and 2 (a
convex repetition cost, so a pattern is repeated only when unread words of the
source are gone).  The network holds one node per pattern and per source and is
solved on the driver; documents never are.  A pattern's flow becomes whole
repeats of all its documents and a rest, filled with documents in a seeded order:
each document that fits in what is left, until no later one does.

The seeded order is never sorted as a whole: documents fall in 4,096 buckets of
their seeded hash, sums per bucket find the one bucket where the rest ends, and
only that bucket of each pattern is ordered.  This repeats on the later documents
that fit in what was left; a round leaves less than the document that ended it.

Defined results: a null text has 0 words and is never taken; a null source is a
source of its own, last in order; equal rows are interchangeable; an empty table
gives an empty table; extra input columns are ignored by the plan and kept by
``apply_mix``; those named like an output are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, free, staged, table, without

MAX_REPEATS = 3
BUCKET_BITS = 12
#: Patterns the driver's flow network takes; they count sets of sources, not documents.
MAX_PATTERNS = 100_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict, weights: dict, most: float = MAX_REPEATS) -> dict:
    """Share the total of ``sizes`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    rest, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        scale = rest / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * scale > most * sizes[s]]
        if not over:
            return out | {s: weights[s] * scale for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
            open_.remove(s)
    return out


def quotas(target: dict) -> dict:
    """Whole words with the same total: largest remainders first."""
    out = {s: int(t) for s, t in target.items()}
    short = round(sum(target.values())) - sum(out.values())
    for s in sorted(target, key=lambda s: (out[s] - target[s], str(s)))[:max(0, short)]:
        out[s] += 1
    return out


def route(sizes: dict, member: dict, quota: dict, repeats: int = MAX_REPEATS) -> dict:
    """Min-cost flow from patterns (words ``sizes``, sources ``member``) to sources; words per (pattern, source).

    Successive shortest paths with potentials: each round augments along the
    cheapest path from a pattern's next repetition to a source with quota left.
    """
    used, flow = dict.fromkeys(sizes, 0), {(p, s): 0 for p in sizes for s in member[p]}
    left, readers = dict(quota), {}
    for p, s in flow:
        readers.setdefault(s, []).append(p)
    while True:
        # cost of the next word of each pattern = how often it has been read in full
        dist, back, heap = {}, {}, []
        for p, n in sizes.items():
            if used[p] < repeats * n:
                dist[("p", p)] = used[p] // n
                heapq.heappush(heap, (used[p] // n, str(p), ("p", p)))
        end = None
        while heap:
            d, _, node = heapq.heappop(heap)
            if d > dist[node]:
                continue
            kind, x = node
            if kind == "s" and left.get(x, 0) > 0:
                end = node
                break
            steps = [("s", s) for s in member[x]] if kind == "p" else [("p", p) for p in readers[x] if flow[p, x] > 0]
            for to in steps:
                if d < dist.get(to, float("inf")):
                    dist[to], back[to] = d, node
                    heapq.heappush(heap, (d, str(to[1]), to))
        if end is None:
            return flow
        path = [end]
        while path[-1] in back:
            path.append(back[path[-1]])
        path.reverse()
        start = path[0][1]
        amount = min(left[end[1]], sizes[start] * (used[start] // sizes[start] + 1) - used[start])
        for a, b in zip(path, path[1:]):
            if a[0] == "s":
                amount = min(amount, flow[b[1], a[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "p":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        used[start] += amount
        left[end[1]] -= amount


def place() -> F.Column:
    """Place of a document in the seeded order; the bucket holds the first bits of h."""
    return F.struct("bucket", "h", "doc_id", "row")


def fill(slim: DataFrame, open_: DataFrame) -> DataFrame | None:
    """Fill ``gap`` words per pattern: each document in seeded order that fits in what is left.

    Gives (pattern, steps): a document is taken if for one of the steps its size
    is at most ``gap`` and its place before ``stop`` (null: no end).  A round takes
    the prefix of the documents that fit in the gap, up to the first that is too
    large for what the prefix leaves; only later and smaller ones are open in the next.
    None if there is nothing to fill.
    """
    rounds, stop = [], slim.select(place().alias("stop")).schema["stop"].dataType
    open_ = staged(open_.withColumn("stop", F.lit(None).cast(stop)), "mix-open")
    while open_.limit(1).count():
        fit = (slim.filter("size > 0").join(F.broadcast(open_), "pattern")
               .filter((F.col("size") <= F.col("gap")) & (F.col("stop").isNull() | (place() > F.col("stop")))).drop("stop"))
        # the bucket of each pattern in which the prefix ends, and what lies before it
        run = Window.partitionBy("pattern").orderBy("bucket")
        sums = fit.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
        edge = (sums.withColumn("upto", F.sum("words").over(run)).filter("upto > gap").groupBy("pattern")
                .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
                .select("pattern", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before")))
        edge = staged(edge, "mix-edge")
        inner = (fit.join(F.broadcast(edge), "pattern").filter("bucket = edge")
                 .withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "doc_id", "row")
                                                                          .rowsBetween(Window.unboundedPreceding, 0))))
        ends = inner.groupBy("pattern").agg(
            F.min(F.when(F.col("upto") > F.col("gap"), place())).alias("stop"),
            (F.first("gap") - F.coalesce(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))), F.first("before"))).alias("left"))
        step = staged(open_.select("pattern", "gap").join(ends, "pattern", "left"), "mix-step")
        rounds.append(step.select("pattern", "gap", "stop"))
        open_ = step.filter("left > 0").select("pattern", F.col("left").alias("gap"), "stop")
    if not rounds:
        return None
    return reduce(DataFrame.unionByName, rounds).groupBy("pattern").agg(F.collect_list(F.struct("gap", "stop")).alias("steps"))


def mix(docs: DataFrame, sources: F.Column, weight_cycle: Sequence[float] = (1, 2, 3), seed: int = 42,
        id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """How often each document is taken: doc_id, key, size, pattern, source_size, target, copies, taken.

    ``sources``: array<string> of a document's sources.  Weights repeat over the
    sources in code point order.  ``key`` names the text (for joins back).
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), word_count(F.col(text)).alias("size"),
        F.to_json(F.sort_array(F.array_distinct(sources))).alias("pattern"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text)).alias("h"),
    ).withColumns({"bucket": F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int"), "row": F.monotonically_increasing_id()})
    slim = staged(slim, "mix-slim")
    sums = slim.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    totals = sums.groupBy("pattern").agg(F.sum("words").alias("words"),
                                         F.first(F.from_json("pattern", "array<string>")).alias("of"))
    rows = totals.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources: group rare sources before mixing")
    size = {r.pattern: r.words for r in rows if r.words}
    member = {r.pattern: list(r.of) for r in rows}
    names = sorted({s for m in member.values() for s in m}, key=lambda s: (s is None, s or ""))
    weight = {s: weight_cycle[i % len(weight_cycle)] for i, s in enumerate(names)}
    source_size = {s: sum(n for p, n in size.items() if s in member[p]) for s in names}
    words = sum(size.values())
    share = targets(source_size, weight)
    scale = words / sum(share.values()) if sum(share.values()) else 0  # overlapping sources share the words once
    target = {s: t * scale for s, t in share.items()} if scale < 1 else share
    flow = route(size, member, quotas(target)) if size else {}
    taken = {p: sum(flow[p, s] for s in member[p]) for p in size}

    plan = staged(spark.createDataFrame(
        [(r.pattern, *(divmod(taken[r.pattern], r.words) if r.words else (0, 0)),
          sum(source_size[s] for s in r.of) if len(r.of) == 1 else None,
          sum(target[s] for s in r.of) if len(r.of) == 1 else None) for r in rows],
        "pattern string, whole bigint, rest bigint, source_size bigint, target double"), "mix-plan")  # a row per pattern
    steps = fill(slim, plan.filter("rest > 0").select("pattern", F.col("rest").alias("gap")))
    plan = plan.withColumn("steps", F.lit(None)) if steps is None else plan.join(steps, "pattern", "left")
    within = F.lit(False) if steps is None else F.exists("steps", lambda s: (F.col("size") <= s["gap"]) & (s["stop"].isNull() | (place() < s["stop"])))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.coalesce(within, F.lit(False)).cast("int")).cast("bigint")
    return (slim.join(F.broadcast(plan), "pattern", "left").withColumn("copies", copies)
            .withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "key", "size", "pattern", "source_size", "target", "copies", "taken"))


def apply_mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixed table: each document's row once for each copy the plan takes, columns unchanged.

    The plan is joined by id and text hash.  Equal rows have a plan row each;
    their copies are summed and shared out again.
    """
    id_, key, copies, rows, n, x = free(docs, "mix_id", "mix_key", "mix_copies", "mix_rows", "mix_n", "mix_x")
    per = plan.groupBy(F.col("doc_id").alias(id_), F.col("key").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).filter(F.col(copies) > 0)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    hit = docs.join(per, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(key)))
    once = hit.filter(F.col(rows) == 1).withColumn(n, F.col(copies))
    # of equal rows, the first (copies mod rows) get one more
    w = Window.partitionBy(id_, key).orderBy(F.lit(1))
    one_more = F.when(F.row_number().over(w) <= F.col(copies) % F.col(rows), 1).otherwise(0)
    more = hit.filter(F.col(rows) > 1).withColumn(n, F.floor(F.col(copies) / F.col(rows)) + one_more)
    both = once.unionByName(more).filter(F.col(n) > 0)
    return both.withColumn(x, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n).cast("bigint")))).select(*cols)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, F.array("source")).select("doc_id", "size", "source_size", "target", "taken", "copies")
