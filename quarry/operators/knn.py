"""Exact nearest-neighbour search without pair rows and without an index shuffle
when the question batch is small.

Questions and index rows meet only inside their filter group (the id
equi-join).  Two physical strategies, chosen by a size check:

* broadcast kernel — the question batch (count × dimension checked against
  ``BROADCAST_BYTES``) is shipped to every task; each index partition is
  scored where it lies with matrix products and keeps a running top-k per
  question across its Arrow batches.  A vector crosses into Python once: its
  filter groups are looked up there.  With more partitions than one wave of
  tasks, the first wave's partitions are searched first; the k-th score of
  each question among them bounds what the others may still send, and a block
  of vectors whose centre and radius put it beyond a question's bound is not
  scored for it (triangle inequality).  So candidates grow with the waves, not
  with k × partitions;
* grid — otherwise each group is cut into an R × C grid of cells — questions
  spread over R row blocks, index rows over C column blocks, each side
  replicated along the other axis — so no cell holds more than ``q_cell``
  questions or ``i_cell`` vectors, however hot the key; a cogroup scores a
  cell and emits only its top-k per question.  Each group's first column is
  searched first; the k-th scores found there bound what the cells of the other
  columns score exactly and send.

A final window (two levels when a question has candidates from many cells)
keeps the global top-k by (score, id).

``global_rank`` gives candidates their rank among all index rows by counting,
map-side, the rows that precede them.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.ids import NA, ROUTE_BOTH, ROUTE_MODEL, ROUTE_NONE, ROUTE_PART, route
from quarry.operators.common import join_small
from quarry.session import spread

SCORE_DIGITS = 9            # scores rounded so ties are exact on every engine
MAX_BROADCAST_GROUPS = 200_000
MIN_CELL_ROWS = 256
BROADCAST_BYTES = 16 << 20  # question batch collected and shipped to every task when at most this large
Q_CELL, I_CELL = 32768, 262144  # questions and vectors of a cell at most; fewer cells repeat fewer rows
REDUCE_FAN = 128            # candidate blocks merged per first-level reducer


def _scores(Q: np.ndarray, qn: np.ndarray, X: np.ndarray, digits: int) -> np.ndarray:
    s = qn[:, None] + np.einsum("ij,ij->i", X, X)[None, :] - 2.0 * (Q @ X.T)
    return np.round(np.maximum(s, 0.0), digits) + 0.0


def _ready(X: np.ndarray):
    """Rows of X made ready for the filter, once for all questions: squared norms, columns in single precision, no number too large or missing."""
    xn = np.einsum("ij,ij->i", X, X)
    with np.errstate(over="ignore"):                # such rows are scored without the filter
        right = np.hstack([X, (xn * (1 - 2 * _unit(X)))[:, None]]).astype(np.float32)
    return xn, right, np.abs(X).max(initial=0.0) < 1e15


def _unit(X: np.ndarray) -> float:
    """|error| of scores less qn in single precision: (dimension + 4) * 2^-24 * (qn + 2 xn) at most; both terms with twice that room."""
    return (X.shape[1] + 8) * 2.0 ** -23


def _true(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values of a mask, eight at a time."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    flat = mask.reshape(-1)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


def _merge(cur, Q: np.ndarray, qn: np.ndarray, X: np.ndarray, ids: np.ndarray, k: int, digits: int, limit=None, width: int = 512, ready=None):
    """Each question's k best (scores, ids), given those so far (``cur``; None at first) and the rows of X.

    All pairs go through one product in single precision, whose smallest scores are compared with room for
    its error, ``width`` rows at a time; those that may enter a question's best are scored exactly, and
    ordered whenever four times the rows have been seen or enough have come together.
    ``limit``: the score that none may exceed.  ``ready``: what ``_ready`` gives for X.
    """
    xns, right, plain = ready or _ready(X)
    plain = plain and np.abs(Q).max(initial=0.0) < 1e15
    lo = 0
    while lo < len(X) and (not plain or cur is None or cur[0].shape[1] < k):
        s = _scores(Q, qn, X[lo:lo + width], digits)
        i = np.broadcast_to(ids[lo:lo + width], s.shape)
        if cur is not None:
            s, i = np.hstack([cur[0], s]), np.hstack([cur[1], i])
        cur = _select_topk_pairs(s, i, k, digits)
        lo += width
    if lo >= len(X):
        return cur
    left = np.hstack([-2.0 * Q, np.ones((len(Q), 1))]).astype(np.float32)
    low = np.empty((len(Q), width), np.float32)
    found, edge, tighten = [], None, 4 * lo or len(X)
    for lo in range(lo, len(X), width):
        who, xn = ids[lo:lo + width], xns[lo:lo + width]
        if len(who) < width:
            low = np.empty((len(Q), len(who)), np.float32)
        if edge is None:
            kth = cur[0][:, -1]
            worst = kth if limit is None else np.minimum(kth, limit)
            edge = (worst - qn + _unit(X) * (qn + np.abs(worst - qn)) + 10.0 ** -digits).astype(np.float32)
        np.matmul(left, right[lo:lo + width].T, out=low)
        some = np.flatnonzero(low.min(axis=1) <= edge)   # few questions once their best are near
        if len(some):
            row, col = np.divmod(_true(low[some] <= edge[some, None]), len(who))
            row = some[row]
            if len(row) * 16 > low.size:
                score = _scores(Q, qn, X[lo:lo + width], digits)[row, col]
            else:
                score = np.round(np.maximum(qn[row] + xn[col] - 2.0 * np.einsum("ij,ij->i", Q[row], X[lo + col]), 0.0), digits) + 0.0
            # a null id compares with nothing and comes last in the order
            enters = (score <= worst[row]) & ((score < kth[row]) | ~(who[col] >= cur[1][row, -1]))
            if enters.any():
                found.append((row[enters], score[enters], who[col][enters]))
        done = lo + width
        if done >= len(X) or done >= tighten or sum(len(f[0]) for f in found) > 1 << 17:
            if found:
                cur, found, edge = _enter(cur, found, k), [], None
            tighten = 4 * done
    return cur


def _enter(cur, found, k: int):
    """``cur`` with the (question, score, id) lists of ``found`` taken into each question's k best."""
    (bs, bi), (row, score, who) = cur, (np.concatenate(x) for x in zip(*found))
    some, at = np.unique(row, return_inverse=True)
    at = np.concatenate([np.repeat(np.arange(len(some)), k), at])
    score, who = np.concatenate([bs[some].ravel(), score]), np.concatenate([bi[some].ravel(), who])
    order = np.lexsort((np.unique(who, return_inverse=True)[1] if who.dtype == object else who, score, at))
    top = order[np.searchsorted(at[order], np.arange(len(some)))[:, None] + np.arange(k)]
    bs, bi = bs.copy(), bi.astype(who.dtype)
    bs[some], bi[some] = score[top], who[top]
    return bs, bi


def _cell_best(Q, X, xid: np.ndarray, limit: np.ndarray, k: int, digits: int, block: int = 32768, qblock: int = 512):
    """(question, score, id) lists of a cell: each question's k best that don't exceed its limit."""
    found: list = [None] * -(-len(Q) // qblock)
    for i in range(len(found)):
        some = limit[i * qblock:(i + 1) * qblock]
        if np.isfinite(some).all():                      # places to fill, beyond any limit
            found[i] = np.full((len(some), k), np.inf), np.full((len(some), k), xid[0], xid.dtype)
    for lo in range(0, len(X), block):                   # work arrays hold qblock x width scores at most
        rows = X[lo:lo + block].astype(np.float64)       # double precision a block at a time, as cells are large
        ready = _ready(rows)
        for i in range(len(found)):
            some = Q[i * qblock:(i + 1) * qblock].astype(np.float64)
            found[i] = _merge(found[i], some, np.einsum("ij,ij->i", some, some), rows, xid[lo:lo + block], k, digits,
                              limit[i * qblock:(i + 1) * qblock], ready=ready)
    place, score, who = [], [], []
    for i, (best_s, best_i) in enumerate(found):
        row, col = np.nonzero(~(best_s > limit[i * qblock:(i + 1) * qblock, None]))
        place.append(row + i * qblock), score.append(best_s[row, col]), who.append(best_i[row, col])
    return np.concatenate(place), np.concatenate(score), np.concatenate(who)


def _same_dimension(questions: int, index: int) -> None:
    if questions != index:
        raise ValueError(f"dimension mismatch: questions {questions}, index {index}")


def _cell_kernel(qkey, k: int, digits: int, block: int = 32768, qblock: int = 512):
    """Cogroup body on pandas frames."""

    def run(qdf: pd.DataFrame, xdf: pd.DataFrame) -> pd.DataFrame:
        qdf = qdf[qdf["__qv"].notna()]
        xdf = xdf[xdf["__xv"].notna()]
        if len(qdf) == 0 or len(xdf) == 0:
            return pd.DataFrame({**{c: [] for c in qkey}, "__id": [], "score": []})
        Q, X = np.stack(qdf["__qv"].to_numpy()), np.stack(xdf["__xv"].to_numpy())
        _same_dimension(Q.shape[1], X.shape[1])
        limit = np.full(len(Q), np.inf)
        row, score, who = _cell_best(Q, X, xdf["__id"].to_numpy(), limit, k, digits, block, qblock)
        return pd.DataFrame({**{c: qdf[c].to_numpy()[row] for c in qkey}, "__id": who, "score": score})

    return run


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of lists without nulls; no object is made for a row."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]
    flat = parts[0] if len(parts) == 1 else np.concatenate(parts)
    sizes = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of several dimensions: {sorted(sizes)}")
    return flat.reshape(len(vectors), sizes[0])


def _cell_arrow(qkey, k: int, digits: int):
    """Cogroup body on Arrow tables; questions may have a ``__limit`` that their scores don't exceed."""

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        q, x = (t.filter(pc.is_valid(t[c])) if t[c].null_count else t for t, c in ((q, "__qv"), (x, "__xv")))
        row, score, who = np.zeros(0, np.int64), np.zeros(0), x["__id"].slice(0, 0).to_numpy()
        if len(q) and len(x):
            Q, X = _matrix(q["__qv"]), _matrix(x["__xv"])
            _same_dimension(Q.shape[1], X.shape[1])
            limit = np.full(len(Q), np.inf)
            if "__limit" in q.column_names:
                limit = np.nan_to_num(q["__limit"].to_numpy(), nan=np.inf, posinf=np.inf)
            row, score, who = _cell_best(Q, X, x["__id"].to_numpy(), limit, k, digits)
        at = pa.array(row, pa.int64())
        return pa.table({**{c: q[c].take(at) for c in qkey}, "__id": pa.array(who, x.schema.field("__id").type, from_pandas=True),
                         "score": pa.array(score, pa.float64())})

    return run


def _select_topk_pairs(s: np.ndarray, ids: np.ndarray, k: int, digits: int):
    """Row-wise k smallest (score, id) pairs of candidate lists; exact tie-break on id."""
    m, n = s.shape
    kk = min(n, k)
    if m == 0 or kk == 0:
        return s[:, :kk], ids[:, :kk]
    # only scores up to each row's k-th smallest stay; ids decide among these few
    edge = np.partition(s, kk - 1, axis=1)[:, kk - 1]
    row, col = np.nonzero(~(s > edge[:, None]))
    score, who = s[row, col], ids[row, col]
    order = np.lexsort((np.unique(who, return_inverse=True)[1], score, row))
    first = np.searchsorted(row, np.arange(m))     # row is ascending, before and after the sort
    top = order[first[:, None] + np.arange(kk)]
    return score[top], who[top]


def _group_key(cols):
    """One string for the values of a group; null if one is null, as nulls equal nothing."""
    parts = [F.lit("")]
    for c in cols:
        parts += [c.cast("string"), F.lit("\x1f")]
    return F.concat(*parts)


def _out_of_reach(Q: np.ndarray, X: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Questions whose distance to every row of X exceeds their limit, by X's centre and radius."""
    centre = X.mean(axis=0)
    radius = np.sqrt(((X - centre) ** 2).sum(axis=1).max())
    gap = np.sqrt(((Q - centre) ** 2).sum(axis=1)) - radius
    return (gap > 0) & (gap * gap > limit + 1e-6 * (1 + limit))  # room for rounding


def _broadcast_kernel(groups, keys: int, qkey, k: int, digits: int, bounds=None, qblock: int = 512, xblock: int = 4096):
    """mapInPandas body: score this partition's index rows against the broadcast questions.

    ``groups``: group key → (question keys, vectors, squared norms); a row has ``keys`` group keys.
    ``bounds``: group key → the score that no candidate of a question may exceed.  Work
    arrays hold ``qblock`` × ``xblock`` scores at most, however large the batch;
    beyond them a task keeps the running top-k of each question.
    """

    def run(batches):
        from pyspark import TaskContext

        asked, limits = groups.value, bounds.value if bounds is not None else {}
        best: dict = {}
        for pdf in batches:
            pdf = pdf[pdf["__xv"].notna()]
            for name in [f"__k{i}" for i in range(keys)]:
                for gk, sub in pdf.groupby(name, sort=False):        # null: no question asks for this group
                    if gk not in asked:
                        continue
                    _, Q, qn = asked[gk]
                    X = np.stack(sub["__xv"].to_numpy()).astype(np.float64)
                    if X.shape[1] != Q.shape[1]:
                        raise ValueError(f"dimension mismatch: questions {Q.shape[1]}, index {X.shape[1]}")
                    xid = sub["__id"].to_numpy()
                    limit = limits.get(gk, np.full(len(Q), np.inf))
                    for lo in range(0, len(X), xblock):
                        Xb, ib = X[lo:lo + xblock], xid[lo:lo + xblock]
                        for qlo in range(0, len(Q), qblock):
                            at = slice(qlo, qlo + qblock)
                            cur = best.get((gk, qlo))
                            worst = limit[at]
                            if cur is not None and cur[0].shape[1] == k:
                                worst = np.minimum(worst, cur[0][:, -1])
                            near = ~_out_of_reach(Q[at], Xb, worst)
                            if near.all():
                                best[gk, qlo] = _merge(cur, Q[at], qn[at], Xb, ib, k, digits, limit[at])
                            elif cur is None or cur[0].shape[1] < k:        # as far as they are, they fill the place
                                cs = np.full((len(near), len(Xb)), np.inf)
                                if near.any():
                                    cs[near] = _scores(Q[at][near], qn[at][near], Xb, digits)
                                ci = np.broadcast_to(ib, cs.shape)
                                if cur is not None:
                                    cs, ci = np.hstack([cur[0], cs]), np.hstack([cur[1], ci])
                                best[gk, qlo] = _select_topk_pairs(cs, ci, k, digits)
                            elif near.any():
                                bs, bi = _merge((cur[0][near], cur[1][near]), Q[at][near], qn[at][near], Xb, ib, k, digits, limit[at][near])
                                cur = (cur[0], cur[1].astype(bi.dtype))
                                cur[0][near], cur[1][near] = bs, bi
                                best[gk, qlo] = cur
        part = TaskContext.get().partitionId()
        for (gk, qlo), (bs, bi) in best.items():
            limit = limits.get(gk, np.full(len(asked[gk][1]), np.inf))[qlo:qlo + len(bs)]
            row, col = np.nonzero((bs <= limit[:, None]) & np.isfinite(bs))
            if not len(row):
                continue
            out = {c: asked[gk][0][c][qlo + row] for c in qkey}
            out["__id"] = bi[row, col]
            out["score"] = bs[row, col]
            out["__cell"] = np.full(len(row), part, dtype=np.int64)
            yield pd.DataFrame(out)

    return run


def _candidates(x: DataFrame, groups, keys: int, qkey, k: int, digits: int, schema, wave: int, partitions: int) -> DataFrame:
    """Candidates of all questions from all partitions; beyond one wave, bounded by what the first wave found."""
    if partitions <= 2 * wave:
        return x.mapInPandas(_broadcast_kernel(groups, keys, qkey, k, digits), schema)
    spark = x.sparkSession
    first = (x.filter(F.spark_partition_id() < wave).mapInPandas(_broadcast_kernel(groups, keys, qkey, k, digits), schema))
    top = _final_topk(first, qkey, k, wave).checkpoint()
    # one k-th score for each question of the batch, whose size was checked
    kth = {tuple(r[c] for c in qkey): r["score"] for r in top.filter(F.col("rank") == k).select(*qkey, "score").collect()}
    limit = {gk: np.array([kth.get(key, np.inf) for key in zip(*(cols[c].tolist() for c in qkey))])
             for gk, (cols, _, _) in groups.value.items()}
    bounds = spark.sparkContext.broadcast(limit)
    rest = x.filter(F.spark_partition_id() >= wave).mapInPandas(_broadcast_kernel(groups, keys, qkey, k, digits, bounds), schema)
    return top.drop("rank").withColumn("__cell", F.lit(0).cast("long")).unionByName(rest)


def _final_topk(cand: DataFrame, qkey, k: int, fan: int) -> DataFrame:
    """Global top-k per question; candidates from many cells are merged in two levels."""
    if fan > REDUCE_FAN:
        w1 = Window.partitionBy(*qkey, F.floor(F.col("__cell") / REDUCE_FAN)).orderBy("score", "__id")
        cand = cand.withColumn("__r1", F.row_number().over(w1)).filter(F.col("__r1") <= k).drop("__r1")
    w = Window.partitionBy(*qkey).orderBy(F.col("score"), F.col("__id"))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("__cell")


def nearest(
    index: DataFrame,
    questions: DataFrame,
    k: int,
    *,
    qkey=("query_id",),
    ikey: str = "chunk_id",
    ivec: str = "embedding",
    qvec: str = "qvec",
    qgroup=None,
    igroup=None,
    q_cell: int = Q_CELL,
    i_cell: int = I_CELL,
    digits: int = SCORE_DIGITS,
    strategy: str = "auto",
) -> DataFrame:
    """Top-k nearest index rows per question by squared L2, ranked by (score, id).

    ``qgroup``/``igroup`` are equal-length lists of Columns: a question is
    only compared with index rows whose group values are equal (the filter).
    ``igroup`` may be a list of such lists instead, giving each index row
    several groups, of which a question equals one at most.  ``index`` is a table
    read or a projection of one (its partitions are counted).
    ``strategy``: ``auto`` (size check), ``broadcast`` or ``grid``.
    Returns ``qkey…, ikey, score, rank``.
    """
    spark = questions.sparkSession
    qkey = list(qkey)
    q = questions.select(*[F.col(c) for c in qkey], F.col(qvec).alias("__qv"), *(
        [g.alias(f"__g{i}") for i, g in enumerate(qgroup)] if qgroup else [F.lit(0).alias("__g0")]))
    gcols = [c for c in q.columns if c.startswith("__g")]
    several = igroup if igroup and isinstance(igroup[0], (list, tuple)) else [igroup or [F.lit(0)]]

    qfields = [questions.schema[c] for c in qkey]
    id_field = index.schema[ikey]
    out_schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in qfields]
        + [T.StructField("__id", id_field.dataType), T.StructField("score", T.DoubleType()),
           T.StructField("__cell", T.LongType())]
    )
    parallel = spark.sparkContext.defaultParallelism

    if strategy != "grid":
        # size check: question count × dimension, read from the questions only
        size = q.select(F.count(F.lit(1)).alias("n"), F.max(F.size("__qv")).alias("d")).first()
        n_q, dim = int(size["n"] or 0), int(size["d"] or 0)
        if strategy == "broadcast" or n_q * max(dim, 1) * 8 <= BROADCAST_BYTES:
            pq = q.filter(F.col("__qv").isNotNull()).withColumn("__key", _group_key([F.col(g) for g in gcols])).toArrow().to_pandas()
            groups = {}
            for gk, sub in pq.groupby("__key", sort=False):
                Q = np.stack(sub["__qv"].to_numpy()).astype(np.float64)
                groups[gk] = ({c: sub[c].to_numpy() for c in qkey}, Q, np.einsum("ij,ij->i", Q, Q))
            names = [f"__k{i}" for i in range(len(several))]
            index = spread(index)
            partitions = index.rdd.getNumPartitions()
            x = index.select(F.col(ikey).alias("__id"), F.col(ivec).alias("__xv"), *[_group_key(g).alias(n) for g, n in zip(several, names)])
            if igroup is not None:
                # only rows of groups that some question asks for cross into Python, each once (JVM-side probes of
                # the broadcast keys; the partitioning of the scan is kept)
                asked = spark.createDataFrame([(g,) for g in groups], "__asked string")
                for n in names:
                    x = x.join(F.broadcast(asked.select(F.col("__asked").alias(n + "a"))), F.col(n) == F.col(n + "a"), "left")
                x = x.select("__id", "__xv", *[F.col(n + "a").alias(n) for n in names]).filter(F.coalesce(*names).isNotNull())
            cand = _candidates(x, spark.sparkContext.broadcast(groups), len(names), qkey, k, digits, out_schema, parallel, partitions)
            return _final_topk(cand, qkey, k, parallel).withColumnRenamed("__id", ikey)

    x = index.select(F.col(ikey).alias("__id"), F.col(ivec).alias("__xv"), F.explode(_group_structs(several)).alias("__gs"))
    x = x.select("__id", "__xv", *[F.col("__gs")[f"g{i}"].alias(g) for i, g in enumerate(gcols)])
    qs = q.groupBy(*gcols).agg(F.count(F.lit(1)).alias("__nq"))
    xs = x.groupBy(*gcols).agg(F.count(F.lit(1)).alias("__nx"))
    stats = qs.join(xs, gcols, "inner")
    rows = F.greatest(F.lit(1), F.ceil(F.col("__nq") / q_cell))
    stats = stats.select(
        *gcols,
        rows.cast("int").alias("__nr"),
        F.greatest(
            F.ceil(F.col("__nx") / i_cell),
            # a first column, and more where the questions' rows alone don't make enough cells of the others
            F.least(F.ceil(F.lit(parallel) / rows) + 1, F.ceil(F.col("__nx") / MIN_CELL_ROWS)),
            F.lit(1),
        ).cast("int").alias("__nc"),
        # the first column alone makes enough cells by more rows
        F.greatest(rows, F.least(F.lit(2 * parallel), F.ceil(F.col("__nq") / MIN_CELL_ROWS))).cast("int").alias("__nf"),
    )
    # The counts are one row per filter group; broadcast them only when that is proven small.
    n_groups, max_c = stats.select(F.count(F.lit(1)), F.max("__nc")).first()
    stats_side = F.broadcast(stats) if n_groups <= MAX_BROADCAST_GROUPS else stats
    cell_schema = T.StructType(out_schema.fields[:-1])

    def searched(questions: DataFrame, rows: str, first: bool) -> DataFrame:
        """Candidates of the cells of each group's first column, or of its other columns."""
        counts = ["__nr", "__nc", "__nf"]
        columns = F.array(F.lit(0)) if first else F.sequence(F.lit(1), F.col("__nc") - 1)
        q_rep = (questions.join(stats_side if first else stats_side.filter(F.col("__nc") > 1), gcols, "inner")
                 .withColumn("__r", F.pmod(F.xxhash64(*[F.col(c) for c in qkey]), F.col(rows)).cast("int"))
                 .withColumn("__c", F.explode(columns)).drop(*counts))
        x_rep = (x.join(stats_side, gcols, "inner")
                 .withColumn("__c", F.pmod(F.xxhash64("__id"), F.col("__nc")).cast("int"))
                 .filter(F.col("__c") == 0 if first else F.col("__c") > 0)
                 .withColumn("__r", F.explode(F.sequence(F.lit(0), F.col(rows) - 1))).drop(*counts))
        keys = gcols + ["__r", "__c"]
        found = q_rep.groupBy(*keys).cogroup(x_rep.groupBy(*keys)).applyInArrow(_cell_arrow(qkey, k, digits), cell_schema)
        return found.withColumn("__cell", F.xxhash64("__id") % (max_c or 1))

    cand = searched(q, "__nf", True)
    if (max_c or 1) > 1:
        top = _final_topk(cand, qkey, k, 1).checkpoint()
        # of questions that share a key, or have a null in it, no more is known than that
        bounds = top.filter(F.col("rank") == k).select(*qkey, F.col("score").alias("__limit"))
        rest = searched(q.join(bounds, qkey, "left"), "__nr", False)
        cand = top.drop("rank").withColumn("__cell", F.lit(0).cast("long")).unionByName(rest)
    return _final_topk(cand, qkey, k, int(max_c or 1)).withColumnRenamed("__id", ikey)


# --- search operators -------------------------------------------------------------------

def _route_groups(questions: DataFrame):
    """Question-side group (route, model, part) for the filtered search."""
    r = F.col("route")
    return [
        r,
        F.when(r.isin(ROUTE_BOTH, ROUTE_MODEL), F.col("model_num")).otherwise(F.lit(NA)),
        F.when(r.isin(ROUTE_BOTH, ROUTE_PART), F.col("ps_num")).otherwise(F.lit(NA)),
    ]


def _index_route_groups():
    """Each index row belongs to four groups: one per route."""
    m, p, na = F.col("model_num"), F.col("ps_num"), F.lit(NA)
    return [[F.lit(ROUTE_BOTH), m, p], [F.lit(ROUTE_MODEL), m, na], [F.lit(ROUTE_PART), na, p], [F.lit(ROUTE_NONE), na, na]]


def _group_structs(groups):
    """The groups of a row as an array of structs (g0, g1, …)."""
    return F.array(*[F.struct(*[c.alias(f"g{i}") for i, c in enumerate(g)]) for g in groups])


def knn_topk(index: DataFrame, questions: DataFrame, k: int = 25, **kw) -> DataFrame:
    """Unfiltered exact top-k."""
    return nearest(index, questions, k, **kw)


def with_route(questions: DataFrame) -> DataFrame:
    if "route" in questions.columns:
        return questions
    return questions.withColumn("route", route(F.col("model_num"), F.col("ps_num")))


def knn_filtered(index: DataFrame, questions: DataFrame, k: int = 25, **kw) -> DataFrame:
    """Id filter applied before scoring: each route is an equi-join on its ids."""
    qr = with_route(questions)
    return nearest(index, qr, k, qgroup=_route_groups(qr), igroup=_index_route_groups(), **kw)


def _add_preceding(counts, Q, qn, scores, who, X, xid, digits: int) -> None:
    """Count the rows of X between the candidates of each question.

    A row is counted at the number of candidates that don't follow it, by (score, id);
    so the rows before candidate j are those counted at 0 … j.
    """
    last = np.array([s[-1] for s in scores])
    near = np.flatnonzero(~_out_of_reach(Q, X, last))
    for qlo in range(0, len(near), 512):
        some = near[qlo:qlo + 512]
        for i, row in zip(some.tolist(), _scores(Q[some], qn[some], X, digits)):
            at = np.flatnonzero(row <= scores[i][-1])  # rows after the last candidate precede none
            left, right = (np.searchsorted(scores[i], row[at], side) for side in ("left", "right"))
            for j in np.flatnonzero(left < right).tolist():
                left[j] += np.searchsorted(who[i][left[j]:right[j]], xid[at[j]], "right")
            counts[i] += np.bincount(left, minlength=len(counts[i]))


def _counted(counts) -> list:
    """(question, candidate, rows counted there) of all counts; those after the last candidate precede none."""
    return [(i, j, n) for i, c in enumerate(counts) for j, n in enumerate(c.tolist()) if n and j < len(c) - 1]


def _rank_kernel(shared, digits: int, xblock: int = 4096):
    """mapInPandas body: for each question of the batch, how many rows of this partition lie between its candidates."""

    def run(batches):
        Q, qn, scores, who = shared.value
        counts = [np.zeros(len(s) + 1, np.int64) for s in scores]
        for pdf in batches:
            pdf = pdf[pdf["__xv"].notna()]
            for lo in range(0, len(pdf), xblock):
                X = np.stack(pdf["__xv"].iloc[lo:lo + xblock].to_numpy()).astype(np.float64)
                _add_preceding(counts, Q, qn, scores, who, X, pdf["__id"].to_numpy()[lo:lo + xblock], digits)
        found = _counted(counts)
        if found:
            yield pd.DataFrame(found, columns=["__q", "__j", "__n"])

    return run


def _rank_cell_kernel(qkey, digits: int, xblock: int = 4096):
    """Cogroup body: the same for the questions and index rows of a cell."""

    def run(qdf: pd.DataFrame, xdf: pd.DataFrame) -> pd.DataFrame:
        xdf = xdf[xdf["__xv"].notna()]
        if len(qdf) == 0 or len(xdf) == 0:
            return pd.DataFrame({**{c: [] for c in qkey}, "__q": [], "__j": [], "__n": []})
        Q = np.stack(qdf["__qv"].to_numpy()).astype(np.float64)
        qn, scores, who = np.einsum("ij,ij->i", Q, Q), list(qdf["__s"]), list(qdf["__w"])
        counts = [np.zeros(len(s) + 1, np.int64) for s in scores]
        for lo in range(0, len(xdf), xblock):
            X = np.stack(xdf["__xv"].iloc[lo:lo + xblock].to_numpy()).astype(np.float64)
            _add_preceding(counts, Q, qn, scores, who, X, xdf["__id"].to_numpy()[lo:lo + xblock], digits)
        i, j, n = np.array(_counted(counts), np.int64).reshape(-1, 3).T
        return pd.DataFrame({**{c: qdf[c].to_numpy()[i] for c in [*qkey, "__q"]}, "__j": j, "__n": n})

    return run


def global_rank(index: DataFrame, questions: DataFrame, hits: DataFrame, *, qkey=("query_id",), ikey: str = "chunk_id",
                ivec: str = "embedding", qvec: str = "qvec", digits: int = SCORE_DIGITS) -> DataFrame:
    """``hits`` (qkey…, ikey, score, rank from 1 on) with ``near``: the rank among all index rows by (score, id).

    Only counts are shuffled: a row for each candidate and partition at most.
    Questions whose vectors and candidates take ``BROADCAST_BYTES`` at most go to the
    tasks from the driver; more never come to it, but meet the index in a grid
    of cells of ``Q_CELL`` questions and ``I_CELL`` rows.
    """
    spark, qkey = hits.sparkSession, list(qkey)
    hits = hits.checkpoint()
    per = hits.groupBy(*qkey).agg(F.sort_array(F.collect_list(F.struct("score", F.col(ikey).alias("__id")))).alias("__c"))
    per = per.select(*qkey, F.transform("__c", lambda c: c["score"]).alias("__s"), F.transform("__c", lambda c: c["__id"]).alias("__w"))
    per = per.join(questions.select(*qkey, F.col(qvec).alias("__qv")), qkey)
    per = per.withColumn("__q", F.monotonically_increasing_id()).checkpoint()   # questions may share a key
    n, dim, deep = per.select(F.count("*"), F.max(F.size("__qv")), F.max(F.size("__s"))).first()
    if not n:
        return hits.withColumn("near", F.lit(None).cast("long"))
    index = spread(index).select(F.col(ikey).alias("__id"), F.col(ivec).alias("__xv"))
    if n * ((dim or 0) * 8 + (deep or 0) * 24) <= BROADCAST_BYTES:
        mine = per.toArrow().to_pandas()
        Q = np.stack(mine["__qv"].to_numpy()).astype(np.float64)
        shared = spark.sparkContext.broadcast((Q, np.einsum("ij,ij->i", Q, Q), list(mine["__s"]), list(mine["__w"])))
        counts = index.mapInPandas(_rank_kernel(shared, digits), "__q int, __j int, __n long")
        names = spark.createDataFrame([(i, *key) for i, key in enumerate(mine[qkey].itertuples(index=False, name=None))],
                                      T.StructType([T.StructField("__q", T.IntegerType()), *[hits.schema[c] for c in qkey]]))
        out = counts.groupBy("__q", "__j").agg(F.sum("__n").alias("__n")).join(F.broadcast(names), "__q").drop("__q")
    else:
        rows, cols = -(-n // Q_CELL), max(-(-index.count() // I_CELL), 1)
        q_rep = (per.withColumn("__r", F.pmod(F.xxhash64(*qkey), F.lit(rows)).cast("int"))
                 .withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))))
        x_rep = (index.withColumn("__k", F.pmod(F.xxhash64("__id"), F.lit(cols)).cast("int"))
                 .withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))))
        schema = T.StructType([*[hits.schema[c] for c in qkey], T.StructField("__q", T.LongType()), T.StructField("__j", T.IntegerType()), T.StructField("__n", T.LongType())])
        counts = q_rep.groupBy("__r", "__k").cogroup(x_rep.groupBy("__r", "__k")).applyInPandas(_rank_cell_kernel(qkey, digits), schema)
        out = counts.groupBy(*qkey, "__q", "__j").agg(F.sum("__n").alias("__n")).drop("__q")
    j = hits.join(out.withColumn("rank", F.col("__j") + 1).drop("__j"), [*qkey, "rank"], "left")
    w = Window.partitionBy(*qkey).orderBy("rank")                    # as many rows as a question has candidates
    return j.withColumn("near", F.lit(1) + F.sum(F.coalesce("__n", F.lit(0))).over(w)).drop("__n")


def knn_postfilter(index: DataFrame, questions: DataFrame, k: int = 25, fetch_k: int = 60000,
                   qkey=("query_id",), ikey: str = "chunk_id", **kw) -> DataFrame:
    """Literal semantics: nearest ``fetch_k`` unfiltered, then the id filter, then top k.

    A hit is one of the k nearest of its filter group with at most ``fetch_k`` - 1
    rows of the whole index before it; so the group's k nearest are searched and
    their ranks in the whole index counted, and ``fetch_k`` costs nothing.
    """
    hits = knn_filtered(index, questions, k, qkey=qkey, ikey=ikey, **kw)
    names = {n: kw[n] for n in ("ivec", "qvec", "digits") if n in kw}
    near = global_rank(index, questions, hits, qkey=qkey, ikey=ikey, **names)
    return near.filter(F.col("near") <= fetch_k).select(*qkey, ikey, "score", "rank")


def unmatched_questions(index: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions whose id filter matches no index row (answered by the fallback)."""
    qr = with_route(questions)
    gcols = ["__g0", "__g1", "__g2"]
    qg = qr.select("*", *[g.alias(f"__g{i}") for i, g in enumerate(_route_groups(qr))])
    asked = qg.select(*gcols).distinct()
    # rows without a vector answer nothing
    ig = (index.filter(F.col("embedding").isNotNull()).select(F.explode(_group_structs(_index_route_groups())).alias("__gs"))
          .select(*[F.col("__gs")[f"g{i}"].alias(f"__g{i}") for i in range(3)]))
    # only the groups some question asks for are kept before the distinct
    present = join_small(ig, asked, gcols, "left_semi").distinct()
    return qg.join(present, gcols, "left_anti").drop(*gcols)


def knn_with_fallback(index: DataFrame, questions: DataFrame, k: int = 20, **kw) -> DataFrame:
    """Unfiltered top ``k`` for the questions whose filtered search is empty."""
    return nearest(index, unmatched_questions(index, questions), k, **kw)


def search(index: DataFrame, questions: DataFrame, k: int = 25, fallback_k: int = 20, qkey=("query_id",),
           **kw) -> DataFrame:
    """Routed filtered search, plus the unfiltered fallback for empty results, in one scan of the index.

    Questions whose filter matches nothing are re-routed to the unfiltered
    group before scoring; their top ``fallback_k`` is a prefix of that ranking.
    """
    qkey = list(qkey)
    qr = with_route(questions)
    fb = unmatched_questions(index, qr).select(*qkey).withColumn("fallback", F.lit(True))
    q2 = qr.join(fb, qkey, "left").withColumn("fallback", F.coalesce(F.col("fallback"), F.lit(False)))
    q2 = q2.withColumn("route", F.when(F.col("fallback"), F.lit(ROUTE_NONE)).otherwise(F.col("route")))
    # the routed batch feeds several small actions (size check, broadcast, flags): materialise it once
    q2 = q2.checkpoint()
    hits = nearest(index, q2, max(k, fallback_k), qkey=qkey, qgroup=_route_groups(q2),
                   igroup=_index_route_groups(), **kw)
    hits = join_small(hits, q2.select(*qkey, "fallback"), qkey)
    return hits.filter(F.col("rank") <= F.when(F.col("fallback"), F.lit(fallback_k)).otherwise(F.lit(k)))
