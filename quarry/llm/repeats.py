"""9. Suffix-array dedup: removal of every byte in a 200-byte string that starts elsewhere too.

Any 200-byte string holds 137 64-byte strings; the one with the smallest hash is
its anchor.  Equal strings hold anchors of equal hash, so occurrences sorted by
(anchor, hash of the 136 bytes on either side) find all candidates by looking at
neighbours: an anchor found once has no match; an occurrence whose whole context
is found elsewhere is repeated in full; what is left are the edges of repeats.
The edges' contexts, with one context of each kind found in full, meet by anchor
in blocks of bounded size.  A block's Burrows-Wheeler transform is expanded by
intervals, breadth first by backward extension, which assigns common prefixes in
increasing length; it stops at 200, so entries never assigned are the repeats.
Anchors with more than ``HOT`` different contexts are not gathered: their 200-byte
windows are hashed, and counted by aggregation.

The occurrences are dealt out by ranges of all their columns, so a hot anchor
spreads over tasks, which stream through their sorted rows; the two rows at the
ends of each task are compared once more among themselves.

Defined results: a null text is empty; texts under 200 bytes are kept whole; equal
texts of 200 bytes or more repeat each other in full; equal rows are two
occurrences; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import BASE, mix, raw, slices, small_side, staged, table

LEAST = 200
ANCHOR = 64
SIDE = LEAST - ANCHOR
PIECE = 1 << 20
HOT = 4096
BLOCK_BYTES = 1 << 16
_P: list[np.ndarray] = []


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte × BASE^i, and the powers of BASE's inverse, modulo 2^64."""
    n = len(data) + 1
    if not _P or len(_P[0]) < n:
        up, down = np.full(max(n, PIECE + 1024), BASE, np.uint64), np.full(max(n, PIECE + 1024), pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _P[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    s = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _P[0][:n - 1], dtype=np.uint64, out=s[1:])
    return s, _P[1]


def span_hash(s: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever they stand."""
    return mix((s[end] - s[start]) * down[start] ^ (end - start).astype(np.uint64))


def _anchors_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a piece of text, and their hashes."""
    s, down = _prefix(data)
    at = np.arange(len(data) - ANCHOR + 1)
    h = span_hash(s, down, at, at + ANCHOR)
    # of equal hashes the last counts, as seen from each window: overlapping repeats then have anchors of their own
    low = np.uint64((1 << 21) - 1)
    code = (h & ~low) | (low - at.astype(np.uint64))
    w, n = SIDE + 1, len(code)
    pad = np.full(-n % w + w, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate((code, pad)).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.unique(np.minimum(after[:n - w + 1], before[w - 1:n]) & low)
    pos = (low - least).astype(np.int64)[::-1]
    return pos, h[pos]


def occurrences(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: anchor hash, context hash, start and end of the context, for every anchor."""
    out = []
    for a in range(0, max(1, len(data) - LEAST + 1), PIECE):
        low, high = max(0, a - SIDE), min(len(data), a + PIECE + LEAST - 1)
        part = data[a:high]
        if len(part) < LEAST:
            break
        pos, h = _anchors_of(part)
        wide = data[low:min(len(data), high + SIDE)]
        s, down = _prefix(wide)
        pos = pos + a
        start, end = np.maximum(0, pos - SIDE), np.minimum(len(data), pos + ANCHOR + SIDE)
        ctx = span_hash(s, down, start - low, end - low) ^ mix((pos - start + 1).astype(np.uint64))
        out.append((h, ctx, start, end))
    if not out:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    cols = [np.concatenate(c) for c in zip(*out)]
    _, first = np.unique(cols[2] * (1 << 20) + (cols[3] - cols[2]), return_index=True) if len(out) > 1 else (None, slice(None))
    return tuple(c[first] for c in cols)


def _find(texts: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                data, offs = raw(part.column(1))
                keys, out = part.column(0).to_pylist(), []
                for i, key in enumerate(keys):
                    h, ctx, start, end = occurrences(data[offs[i]:offs[i + 1]])
                    if len(h):
                        out.append((pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array([key] * len(h), pa.binary()),
                                    pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], names=["anchor", "ctx", "key", "start", "end"])

    return texts.select("key", "text").mapInArrow(run, "anchor bigint, ctx bigint, key binary, start int, end int")


def _marked(occ: DataFrame) -> DataFrame:
    """Occurrences of anchors found twice or more, in sorted ranges: full (the context is found elsewhere), head (first of
    its context) and, for the two rows at a range's ends, the range's number in ``part``."""
    names = ["anchor", "ctx", "key", "start", "end", "same_anchor", "same_ctx", "head", "edge"]

    def run(batches):
        held = None  # the last row so far: its columns, and whether its predecessor shares anchor and context
        first = True

        def emit(rows, same_a, same_c, head, edge):
            keep = same_a | edge
            if keep.any():
                cols = [rows[c].filter(pa.array(keep)) for c in range(5)]
                return pa.RecordBatch.from_arrays([*cols, *(pa.array(x[keep]) for x in (same_a, same_c, head, edge))], names=names)
            return None

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b.select(range(5))] if held is None else [held[0], b.select(range(5))]).combine_chunks()
            a, c, s = (rows.column(i).to_numpy() for i in (0, 1, 3))
            key = rows.column(2).to_numpy(zero_copy_only=False)
            eq_a, eq_c = a[1:] == a[:-1], (a[1:] == a[:-1]) & (c[1:] == c[:-1])
            new = np.append(True, ~(eq_c & (s[1:] == s[:-1]) & (key[1:] == key[:-1]).astype(bool)))  # copies of a text give equal rows
            if not new.all():
                rows = rows.filter(pa.array(new))
                a, c = a[new], c[new]
                eq_a, eq_c = a[1:] == a[:-1], (a[1:] == a[:-1]) & (c[1:] == c[:-1])
            rows = rows.combine_chunks()
            prev_a, prev_c = np.append(held[1] if held else False, eq_a), np.append(held[2] if held else False, eq_c)
            n = len(a) - 1
            edge = np.zeros(n, bool)
            if first and n:
                edge[0] = True
                first = False
            got = emit([rows.column(i).combine_chunks().slice(0, n) for i in range(5)], prev_a[:n] | eq_a, prev_c[:n] | eq_c, ~prev_c[:n], edge) if n else None
            if got is not None:
                yield got
            held = (rows.slice(n).to_batches()[0], bool(prev_a[n]), bool(prev_c[n]))
        if held is not None:
            cols = [held[0].column(i) for i in range(5)]
            yield emit(cols, np.array([held[1]]), np.array([held[2]]), np.array([not held[2]]), np.array([True]))

    dealt = occ.repartitionByRange("anchor", "ctx", "key", "start").sortWithinPartitions("anchor", "ctx", "key", "start")
    return dealt.mapInArrow(run, "anchor bigint, ctx bigint, key binary, start int, end int, same_anchor boolean, same_ctx boolean, head boolean, edge boolean")


def candidates(texts: DataFrame) -> DataFrame:
    """anchor, ctx, key, start, end, full, head of every occurrence whose anchor is found elsewhere."""
    marked = staged(_marked(staged(_find(texts), "occurrences")), "anchors")  # dealing by ranges reads them twice
    ends = marked.filter("edge").select("anchor", "ctx", "key", "start").distinct()
    more_a = ends.groupBy("anchor").agg((F.count("*") > 1).alias("more_a"))
    more_c = ends.groupBy("anchor", "ctx").agg((F.count("*") > 1).alias("more_c"), F.min(F.struct("key", "start")).alias("one"))
    edge = (marked.filter("edge").dropDuplicates(["anchor", "ctx", "key", "start"]).join(more_a, "anchor").join(more_c, ["anchor", "ctx"])
            .withColumns({"same_anchor": F.col("same_anchor") | F.col("more_a"), "same_ctx": F.col("same_ctx") | F.col("more_c")}))
    cols = ["anchor", "ctx", "key", "start", "end", F.col("same_ctx").alias("full"), "head"]
    return staged(marked.filter("not edge").select(*cols).unionByName(edge.filter("same_anchor").select(*cols)), "candidates")


def order(sym: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of the symbols, sorted by their first ``depth`` symbols at least.

    The first key packs as many symbols as 62 bits hold; each further sort joins
    the ranks of three neighbouring stretches, which triples the sorted length.
    """
    n = len(sym)
    used = np.bincount(sym) > 0
    dense = (np.cumsum(used) - 1)[sym]
    bits = max(1, int(used.sum()).bit_length())
    h = max(1, 62 // bits)

    def after(x, k):
        out = np.zeros(n, np.int64)
        out[:max(0, n - k)] = x[k:]
        return out

    key = np.zeros(n, np.int64)
    for j in range(h):
        key = (key << bits) | after(dense + 1, j)
    while True:
        at = np.argsort(key)
        sorted_ = key[at]
        rank = np.empty(n, np.int64)
        rank[at] = np.cumsum(np.append(True, sorted_[1:] != sorted_[:-1]))
        if h >= depth or rank[at[-1]] == n:
            return at
        width = int(n + 1).bit_length()
        steps = 3 if 3 * width <= 62 else 2
        key = rank
        for j in range(1, steps):
            key = (key << width) | after(rank, j * h)
        h *= steps


def long_common(sym: np.ndarray, sa: np.ndarray, least: int) -> np.ndarray:
    """True at i if the suffixes at i-1 and i share ``least`` symbols (0 is a separator, never extended).

    Breadth-first over intervals of the Burrows-Wheeler transform: the interval of
    a string is extended by each symbol before it; a string that ends before an
    unassigned entry assigns its parent's length there and is expanded in turn.
    """
    n = len(sym)
    bwt = sym[sa - 1]
    lf = np.empty(n, np.int64)
    lf[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)
    change = np.cumsum(np.append(False, bwt[1:] != bwt[:-1]))
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(least):
        if not len(low):
            break
        one = change[low] == change[high]  # one symbol stands before all of the interval: its ends say it all
        whole = one & (bwt[low] != 0)
        lo, hi = [lf[low[whole]]], [lf[high[whole]]]
        if not one.all():
            a, width = low[~one], (high - low + 1)[~one]
            stop = np.cumsum(width)
            pos = np.arange(stop[-1]) + np.repeat(a - stop + width, width)
            c, of = bwt[pos].astype(np.uint16), np.repeat(np.arange(len(a)), width)
            at = np.argsort(c, kind="stable")  # by symbol, interval and place: a radix sort
            c, of, to = c[at], of[at], lf[pos[at]]
            new = (c[1:] != c[:-1]) | (of[1:] != of[:-1])
            first, last = np.append(True, new), np.append(new, True)
            lo.append(to[first & (c != 0)])
            hi.append(to[last & (c != 0)])
        low, high = np.concatenate(lo), np.concatenate(hi)
        free = open_[high + 1]
        low, high = low[free], high[free]
        open_[high + 1] = False
    return open_[:n]


def repeated(segments: list[bytes], owner: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, from, to) of the bytes covered by strings of LEAST bytes found at two places or more.

    ``owner`` and ``start`` say where a segment comes from; one place seen in two segments is one place.
    """
    lens = np.fromiter(map(len, segments), np.int64, len(segments))
    sym = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    stop = np.cumsum(lens + 1)
    sym[stop - 1] = 0
    seg = np.repeat(np.arange(len(segments)), lens + 1)
    within = np.arange(len(sym)) - (stop - lens - 1)[seg]
    sa = order(sym, LEAST)
    joined = long_common(sym, sa, LEAST)
    valid = (lens[seg] - within >= LEAST)[sa]
    joined[1:] &= valid[1:] & valid[:-1]
    joined[0] = False
    group = np.flatnonzero(~joined)
    place = (owner[seg] << 40) + start[seg] + within
    place = place[sa]
    size = np.diff(np.append(group, len(sa)))
    twice = np.minimum.reduceat(place, group) != np.maximum.reduceat(place, group)
    hit = np.sort(sa[np.repeat(twice, size)])
    if not len(hit):
        return []
    new = np.append(True, np.diff(hit) > 1)
    a, z = hit[new], hit[np.append(new[1:], True)] + LEAST
    return list(zip(seg[a].tolist(), within[a].tolist(), (z - a + within[a]).tolist()))


def edges(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans (key, start, end) of repeats at the occurrences whose context is found once."""
    part = found.filter("not full").select("anchor").distinct()
    need = staged(found.filter("not full or head").join(part, "anchor", "left_semi").select("anchor", "key", "start", "end"), "edges")
    per = need.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "end")).alias("at"))
    body = texts.join(small_side(need.select("key").distinct(), 48), "key", "left_semi").groupBy("key").agg(F.first("text").cast("binary").alias("text"))
    cut = (body.join(per, "key").select("key", "text", F.explode("at").alias("x"))
           .select("x.anchor", "key", "x.start", F.substr("text", F.col("x.start") + 1, F.col("x.end") - F.col("x.start")).alias("segment")))
    cut = staged(cut, "segments")
    hot = staged(cut.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor"), "hot")
    any_hot = hot.limit(1).count() > 0
    usual = cut.join(hot, "anchor", "left_anti") if any_hot else cut

    def run(batches):
        rows, size, last = [], 0, None

        def solve():
            keys: dict[bytes, int] = {}
            owner = np.array([keys.setdefault(k, len(keys)) for k, _, _ in rows], np.int64)
            spans = repeated([s for *_, s in rows], owner, np.array([at for _, at, _ in rows], np.int64))
            out = [(rows[i][0], rows[i][1] + a, rows[i][1] + z) for i, a, z in spans]
            rows.clear()
            cols = list(zip(*out)) if out else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32()))], names=["key", "start", "end"])

        for b in batches:
            for anchor, key, at, segment in zip(*(b.column(i).to_pylist() for i in range(4))):
                if anchor != last and size > BLOCK_BYTES:
                    yield solve()
                    size = 0
                last = anchor
                rows.append((key, at, segment))
                size += len(segment)
        if rows:
            yield solve()

    spans = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "key binary, start int, end int")
    if any_hot:
        spans = spans.unionByName(_windows(cut.join(hot, "anchor", "left_semi")))
    return spans


def _windows(cut: DataFrame) -> DataFrame:
    """The exact way for anchors with very many contexts: each window's hash counted by aggregation."""
    at = F.explode(F.sequence(F.lit(1), F.length("segment") - LEAST + 1)).alias("i")
    win = (cut.filter(F.length("segment") >= LEAST).select("key", "start", "segment", at)
           .select("key", (F.col("start") + F.col("i") - 1).cast("int").alias("start"), F.md5(F.substr("segment", F.col("i"), F.lit(LEAST))).alias("w")))
    two = win.groupBy("w").agg(F.min(F.struct("key", "start")).alias("a"), F.max(F.struct("key", "start")).alias("z")).filter("a <> z").select("w")
    return win.join(two, "w", "left_semi").select("key", "start", (F.col("start") + LEAST).cast("int").alias("end")).distinct()


def with_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """The text (null: empty) and the binary digest that names it."""
    return docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))).withColumn("key", F.unhex(F.md5(text)))


def repeat_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per distinct text (key): spans, an array of (start, end) in bytes, unmerged; (0, -1) for a text found twice."""
    texts = with_key(docs.select(F.col(text).alias("text"))).filter(F.octet_length("text") >= LEAST)
    found = candidates(texts)
    full = found.filter(F.col("full") & (F.col("end") - F.col("start") >= LEAST)).select("key", "start", "end")
    copies = texts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(0).alias("start"), F.lit(-1).alias("end"))
    spans = full.unionByName(edges(found, texts)).unionByName(copies)
    return staged(spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def merged(spans, size: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans; an end of -1 is the text's end."""
    out: list[list[int]] = []
    for a, z in sorted((s["start"], s["end"] if s["end"] >= 0 else size) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans of every document."""
    rows = with_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    rows = rows.join(repeat_spans(docs, text), "key", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                out = []
                for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    runs, kept, at = merged(spans or [], len(t)), [], 0
                    for a, z in runs:
                        kept.append(t[at:a])
                        at = z
                    kept.append(t[at:])
                    left = b"".join(kept)
                    out.append((left, len(t), len(t) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
