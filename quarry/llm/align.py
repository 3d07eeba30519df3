"""13. Cross-tokenizer alignment by lockstep vectorised merging.

A block's documents are encoded by both tokenizers.  One NumPy state vector holds
a pointer into A's tokens and one into B's for each lane; a step emits a link for
every lane, a cut where both tokens end together, and advances the pointers whose
token ends first.  Lanes that are done leave the vector.  A lane is a document, or
a stretch of one of some ``LANE`` tokens between two ends that A and B share, so a
long document doesn't keep the vector short for long.

Pair counts of the whole corpus are sums of counts per task, kept as a table.
Pairs that make up 1 in ``SHARE`` links or more - so there are at most ``SHARE`` of
them - are broadcast; a document's other pairs, which no key can dominate, are
joined with the table.

Defined results: a text that is null or empty, or that either tokenizer can't give
back byte for byte (U+2581, which B reads as a space), has no tokens: zeros and an
empty hash.  Special tokens' strings are plain text.  Equal rows repeat their result
and count each; an empty table gives an empty table; extra columns are ignored.  A
single text must fit a Python worker.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import Encoder, load
from quarry.llm.chunkids import CHUNKS_KEPT, ChunkIds
from quarry.llm.common import slices, staged, table

LANE = 512
SHARE = 1 << 16
BLOCK_BYTES = 2 << 20
FLUSH = 1_000_000


class Spaced(Encoder):
    """Encoder of texts that start with a space, cut before each single space."""

    def pieces(self, text: str) -> list:
        if "  " in text or text[-1:] == " " or text[:1] != " ":
            return super().pieces(text)
        return text[1:].split(" ")


class Pieces:
    """B: ids, and the bytes each id stands for.  No piece has a space inside, so chunks between spaces encode alone."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", p)
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else p.replace("▁", " ").encode())
        runs = re.compile(r" +[^ ]*|^[^ ]+")
        space = [sp.piece_to_id("▁")]  # an empty text has no token, but an empty chunk is a space at the end
        # a chunk stands without the one space that B itself puts before it

        def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [x if c else space for c, x in zip(new, sp.encode(new, num_threads=1))]
            return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

        self.store = ChunkIds(lambda t: t.split(" ") if "  " not in t and t[:1] != " " and t[-1:] != " " else [c[1:] for c in runs.findall(" " + t)], encode)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, b: np.ndarray, last_a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (places in A and B) and cuts (last places of a group in A and B), each ascending.

    ``ends``: byte ends of all tokens, ascending over the block.  Lane k starts at
    places a[k] and b[k], where A and B share a start, and is done after last_a[k], which shares its end with a token of B.
    """
    i, j, last = a.copy(), b.copy(), last_a
    links, cuts = [], []
    while len(i):
        links.append((i, j))
        x, y = ends_a[i], ends_b[j]
        same = x == y
        cuts.append((i[same], j[same]))
        live = ~(same & (i == last))
        i, j = i + (x <= y), j + (y <= x)
        if not live.all():
            i, j, last = i[live], j[live], last[live]
    if not links:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    link_a, link_b = (np.concatenate(x) for x in zip(*links))
    cut_a, cut_b = (np.sort(np.concatenate(x)) for x in zip(*cuts))
    order = np.lexsort((link_b, link_a))
    return link_a[order], link_b[order], cut_a, cut_b


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, past_a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts in A and B and the last place in A of every lane: documents, cut at shared ends about every LANE tokens."""
    open_ = np.concatenate([np.arange(f + LANE, p - 1, LANE) for f, p in zip(first_a, past_a)] or [np.zeros(0, np.int64)]).astype(np.int64)
    stop = np.repeat(past_a, np.maximum(0, -(-(past_a - 1 - first_a - LANE) // LANE)))
    found = []
    while len(open_):  # the next token of A that ends where one of B does
        at = np.searchsorted(ends_b, ends_a[open_])
        hit = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a[open_]
        found.append(open_[hit])
        open_, stop = open_[~hit] + 1, stop[~hit]
        inside = open_ < stop - 1
        open_, stop = open_[inside], stop[inside]
    split = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    start_a = np.sort(np.concatenate((first_a, split + 1)))
    start_b = np.sort(np.concatenate((first_b, np.searchsorted(ends_b, ends_a[split]) + 1)))
    last = np.append(start_a[1:], past_a[-1:]) - 1
    return start_a, start_b, last


class Aligner:
    """Aligns blocks of texts; holds what a task needs."""

    def __init__(self, merges, piece_path: str):
        self.a, self.b = Spaced(merges, CHUNKS_KEPT), Pieces(piece_path)
        self.len_a = np.array([len(x) for x in merges.piece], np.int64)
        self.len_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.width = len(self.b.bytes)
        names = [str(i) for i in range(max(len(self.len_a), self.width))]
        #: an id's text before another of its side, before the other side, before the next group, at the end
        self.text = [np.array([n + mark for n in names], object) for mark in (",", "|", ";", "")]

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B; none where a text is empty or not given back."""
        a = self.a.block([" " + t if t else None for t in texts])
        b = self.b.store.block(texts)
        for k, t in enumerate(texts):
            if not t:
                continue
            want = (" " + t).encode()
            if b"".join(map(self.b.bytes.__getitem__, b[k].tolist())) != want or b"".join(map(self.a.t.piece.__getitem__, a[k].tolist())) != want:
                a[k] = b[k] = np.zeros(0, np.int32)
        return a, b

    def block(self, texts: list[str | None]):
        """Per text: n_a, n_b, n_groups, n_links, groups_sha256, and its distinct id pairs with their counts."""
        ids_a, ids_b = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
        ends_a, ends_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        past_a, past_b = np.cumsum(n_a), np.cumsum(n_b)
        full = n_a > 0
        la, lb, ca, cb = lockstep(ends_a, ends_b, *lanes(ends_a, ends_b, (past_a - n_a)[full], (past_b - n_b)[full], past_a[full]))
        link_at, cut_at = np.searchsorted(la, np.append(0, past_a)), np.searchsorted(ca, np.append(0, past_a))
        pair = flat_a[la] * self.width + flat_b[lb]
        # ids in the order of the groups: a group's A, its B, the next group's
        group_a, group_b = np.searchsorted(ca, np.arange(len(flat_a))), np.searchsorted(cb, np.arange(len(flat_b)))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        mark_a, mark_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        mark_a[ca] = 1
        mark_b[cb] = 2
        mark_b[past_b[full] - 1] = 3
        ids, mark = np.concatenate((flat_a, flat_b))[order], np.concatenate((mark_a, mark_b))[order]
        text = np.empty(len(ids), object)
        for m in range(4):
            at = mark == m
            text[at] = self.text[m][ids[at]]
        past = np.append(0, past_a + past_b)
        for k in range(len(texts)):
            keys, n = np.unique(pair[link_at[k]:link_at[k + 1]], return_counts=True)
            said = "".join(text[past[k]:past[k + 1]].tolist())
            yield (int(n_a[k]), int(n_b[k]), int(cut_at[k + 1] - cut_at[k]), int(link_at[k + 1] - link_at[k]),
                   hashlib.sha256(said.encode()).hexdigest() if said else "", keys.astype("<u4").tobytes(), n.astype("<u4").tobytes())


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every row; a pair is A's id times B's size plus B's id."""
    shared = load(path_a)
    shared.special = {}
    shared = docs.sparkSession.sparkContext.broadcast(shared)  # a vocabulary
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches):
        aligner = Aligner(shared.value, path_b)
        for b in batches:
            for part in slices(b, 1, BLOCK_BYTES):
                cols = zip(*aligner.block(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return slim.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary")


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """pair, n (links of the corpus that hold it), best (no pair of its B id has more)."""
    def count(batches):
        keys, times, size = [], [], 0

        def flush():
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(times)).astype(np.int64)
            keys.clear(), times.clear()
            return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys.append(np.frombuffer(k, "<u4"))
                times.append(np.frombuffer(n, "<u4"))
                size += len(keys[-1])
                if size > FLUSH:
                    yield flush()
                    size = 0
        if keys:
            yield flush()

    n = staged(found.select("pairs", "times").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    most = n.groupBy(F.pmod("pair", F.lit(width)).alias("b")).agg(F.max("n").alias("most"))  # a row per id of B
    return n.join(F.broadcast(most), F.pmod("pair", F.lit(width)) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    found = staged(links(docs, path_a, path_b, id_col, text).withColumn("row", F.monotonically_increasing_id()), "align-links")
    counts = staged(pair_counts(found, len(Pieces(path_b).bytes)), "align-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * share >= total
    top = counts.filter(often).orderBy("pair").toPandas()  # at most ``share`` rows
    known = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def known_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = known.value[0]
        if not len(pair):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(pair, keys), len(pair) - 1)
        return at, pair[at] == keys

    def sums(batches):
        """The known pairs' share of each row, with a null pair, and its other pairs."""
        for b in batches:
            out = [[] for _ in range(5)]
            for row, k, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                keys, times = np.frombuffer(k, "<u4").astype(np.int64), np.frombuffer(t, "<u4").astype(np.int64)
                at, hit = known_pairs(keys)
                _, n, best = known.value
                out[0].append(np.array([row])), out[1].append(np.array([-1])), out[2].append(np.zeros(1, np.int64))
                out[3].append(np.array([(times[hit] * best[at[hit]]).sum()])), out[4].append(np.array([(times[hit] * n[at[hit]]).sum()]))
                rest = keys[~hit]
                out[0].append(np.full(len(rest), row)), out[1].append(rest), out[2].append(times[~hit])
                out[3].append(np.zeros(len(rest), np.int64)), out[4].append(np.zeros(len(rest), np.int64))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["row", "pair", "times", "n_best", "count_sum"])

    parts = found.select("row", "pairs", "times").mapInArrow(sums, "row bigint, pair bigint, times bigint, n_best bigint, count_sum bigint")
    parts = staged(parts, "align-parts")
    rest = (parts.filter("pair >= 0").select("row", "pair", "times").join(counts.filter(~often), "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    both = (parts.filter("pair < 0").select("row", "n_best", "count_sum").unionByName(rest)
            .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    slim = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return slim.join(both, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
