"""12. Packing documents into windows by non-negative least squares.

A document's ids and an end id are cut into full windows and a tail.  The lengths
of all tails make one histogram in bins of ``UNIT`` tokens (4,095 lengths at
most, whatever the table's size).  Shallow combinations - up to three different
bins, or two that repeat - that fill a window are enumerated once, and a
non-negative least-squares solve on the driver gives how often each is used.

Tails then meet in bays: hash partitions of a bounded number of tokens, each
packed in one task.  A bay uses its share of every combination's count, rounded
down and bounded by the tails it has, so combinations take whole documents.  The
residual is packed greedily: the longest tail that fits goes into the room left
in a sequence, then new sequences are filled in the same way.  Last, the emptiest
sequences are dissolved and their documents cut to fill the room that is left
elsewhere; rooms under ``MIN_ROOM`` tokens stay as padding.  What is over at the
end goes into sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is its end id alone; a special token's string
in a text becomes its id, as the tokenizers library has it by default; equal rows
are packed one by one; an empty table gives an empty table; extra columns are
ignored.  Reruns over the same files give the same rows.  Ids must be under 65,536.
"""

from __future__ import annotations

import bisect
import functools
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import Numbered, byte_letters, gather
from quarry.llm.chunkids import ChunkIds
from quarry.llm.common import slices, staged, table

WINDOW = 4096
END_ID = 2
#: A run of letters that are small already and one of marks, either as the tokenizer's pattern splits them.
SIMPLE = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)").fullmatch
UNIT = 32
MIN_ROOM = 16
#: Tokens a bay holds on average (two bytes each).
BAY_TOKENS = 6_000_000


@functools.lru_cache(1)
def encoder(path: str) -> ChunkIds:
    """Ids by the tokenizers library; its split pattern drops white space, so no token reaches over a space or line end.

    A Python worker keeps it, with its bounded store, from task to task.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(path)
    hf.no_truncation()
    hf.no_padding()
    if hf.get_vocab_size() > 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    plain = Tokenizer(hf.model)
    letters = dict(enumerate(byte_letters()))

    def cut(text: str) -> list[str]:
        if "<|" not in text:  # else a special token's string in capitals would become one
            text = text.encode().lower().decode()  # as the tokenizer does; here A-Z alone, so that fewer chunks differ
        return text.replace("\n", " ").split(" ")

    def ids_of(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        e = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(e.ids, np.int32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a run of small letters and one of marks are what the split pattern makes of such a chunk, and the
        # normaliser leaves them alone: they go to the merges at once, each distinct run one time
        runs, other, entry, count = Numbered(), [], [], []
        for chunk in new:
            if m := SIMPLE(chunk):
                word, marks = m.groups()
                entry.append(runs[word])
                if marks:
                    entry.append(runs[marks])
                count.append(2 if marks else 1)
            else:
                entry.append(-1 - len(other))
                other.append(chunk)
                count.append(1)
        words = [w if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in runs]
        (flat, n), (more, m) = ids_of(plain, words), ids_of(hf, other)
        ends = np.append(0, np.cumsum(np.concatenate((n, m))))
        entry = np.array(entry, np.int64)
        out, stops = gather(np.concatenate((flat, more)), ends, np.where(entry < 0, len(words) - 1 - entry, entry))
        return out, np.diff(np.append(0, stops)[np.append(0, np.cumsum(count))])

    return ChunkIds(cut, encode)


def windows(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, crc, ids: each document's full windows (ids null) and tail (ids as unsigned 16-bit integers)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    doc_type = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "doc_tokens", "crc", "ids"]

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for part in slices(b, 1):
                row, start, length, total, crc, tail = [], [], [], [], [], []
                for i, ids in enumerate(enc.block(part.column(1).to_pylist())):
                    ids = np.append(ids, end_id).astype("<u4")
                    for at in range(0, len(ids), window):
                        piece = ids[at:at + window]
                        row.append(i), start.append(at), length.append(len(piece)), total.append(len(ids))
                        crc.append(zlib.crc32(piece))
                        tail.append(None if len(piece) == window else piece.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc)),
                     pa.array(tail, pa.binary())], names=names)

    return slim.mapInArrow(run, f"doc_id {doc_type}, start bigint, length bigint, doc_tokens bigint, crc bigint, ids binary")


def combinations(units: int) -> list[tuple[tuple[int, int], ...]]:
    """Multisets of bins that add up to ``units``: one or two bins with repeats, or three bins once each; as (bin, repeats)."""
    out = [((a, units // a),) for a in range(2, units) if units % a == 0]
    for a in range(2, units):
        for i in range(1, units // a + 1):
            left = units - a * i
            out += [((a, i), (b, left // b)) for b in range(a + 1, left + 1) if left % b == 0]
    for a in range(2, units // 3 + 1):
        out += [((a, 1), (b, 1), (units - a - b, 1)) for b in range(a + 1, (units - a + 1) // 2) if units - a - b > b]
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """x >= 0 with least |a x - b|, by active sets: the column with the steepest gain enters, those that turn negative leave."""
    x, inside = np.zeros(a.shape[1]), []
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[inside] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        inside.append(best)
        while inside:
            z = np.linalg.lstsq(a[:, inside], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[inside] = z
                break
            now = x[inside]
            low = z <= 0
            step = (now[low] / np.maximum(now[low] - z[low], 1e-300)).min()
            now = now + step * (z - now)
            x[:] = 0
            x[inside] = np.maximum(now, 0)
            inside = [j for j in inside if x[j] > 1e-15]
    return x


def solve(hist: dict[int, int], window: int = WINDOW, unit: int = UNIT) -> list[tuple[tuple[tuple[int, int], ...], float]]:
    """Combinations and how often each is used for every tail of the table; most used tokens first."""
    units, total = window // unit, sum(hist.values())
    have = np.zeros(units + 1)
    for length, n in hist.items():
        have[-(-length // unit)] += n
    have[:2] = 0  # the shortest tails fill the room that combinations leave
    have[units] = 0  # as long as a window but for less than a unit
    if not have.sum():
        return []
    combos = [c for c in combinations(units) if all(have[b] >= k for b, k in c)]
    if not combos:
        return []
    a = np.zeros((units + 1, len(combos)))
    for j, c in enumerate(combos):
        for b, k in c:
            a[b, j] = k
    weight = np.sqrt(np.arange(units + 1))[:, None]  # a long tail left over costs more
    x = nnls(a * weight, have / total * weight[:, 0])
    used = [(c, float(v)) for c, v in zip(combos, x) if v > 0]
    return sorted(used, key=lambda u: (-u[1], u[0]))


def pack(lengths: np.ndarray, plan: list, window: int = WINDOW, unit: int = UNIT) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, start in it, length) that hold all of the tails, ``lengths`` tokens each."""
    order = np.argsort(lengths, kind="stable")
    bins: dict[int, list[int]] = {}
    for i in order.tolist():
        bins.setdefault(-(-int(lengths[i]) // unit), []).append(i)
    seqs: list[list[int]] = []
    for combo, often in plan:
        n = min(int(often * len(lengths)), *(len(bins.get(b, ())) // k for b, k in combo))
        if n <= 0:
            continue
        # one length goes up while the next goes down, so that sums differ little
        dealt = []
        for side, (b, k) in enumerate(combo):
            mine = bins[b][:n * k] if side % 2 == 0 else bins[b][:n * k][::-1]
            bins[b] = bins[b][n * k:]
            dealt.append([mine[i::n] for i in range(n)])
        seqs += [[x for d in dealt for x in d[i]] for i in range(n)]
    room = [window - int(lengths[s].sum()) for s in seqs]
    pool = sorted((int(lengths[i]), i) for left in bins.values() for i in left)

    def fill(seq: list[int], left: int) -> int:
        while pool and pool[0][0] <= left:
            size, i = pool.pop(bisect.bisect_right(pool, (left, len(lengths))) - 1)
            seq.append(i)
            left -= size
        return left

    for s in sorted(range(len(seqs)), key=lambda s: (-room[s], s)):
        room[s] = fill(seqs[s], room[s])
    while pool:
        size, i = pool.pop()
        seqs.append([i])
        room.append(fill(seqs[-1], window - size))
    # the emptiest sequences are dissolved; their tails, cut freely, fill the others' rooms
    by_room = sorted(range(len(seqs)), key=lambda s: (-room[s], s))
    need = sum(r for r in room if r >= MIN_ROOM)
    gone, have = 0, 0
    while gone < len(by_room) and room[by_room[gone]] >= MIN_ROOM and have < need:
        s = by_room[gone]
        need -= room[s]
        have += window - room[s]
        gone += 1
    loose = [(i, int(lengths[i])) for s in by_room[:gone] for i in seqs[s]]
    out, at = [], 0  # at: tokens of the first loose tail that are placed
    loose.reverse()

    def take(amount: int) -> list[tuple[int, int, int]]:
        nonlocal at
        got = []
        while amount and loose:
            i, size = loose[-1]
            part = min(amount, size - at)
            got.append((i, at, part))
            amount, at = amount - part, at + part
            if at == size:
                loose.pop()
                at = 0
        return got

    for s in sorted(by_room[gone:]):
        whole = [(i, 0, int(lengths[i])) for i in seqs[s]]
        out.append(whole + (take(room[s]) if room[s] >= MIN_ROOM else []))
    left = sum(size for _, size in loose) - at
    while left:
        amount = min(window, 1 << (left.bit_length() - 1))
        out.append(take(amount))
        left -= amount
    return out


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
                   bay_tokens: int = BAY_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece of a document."""
    cut = windows(docs, path, id_col, text, window, end_id).withColumn("row", F.monotonically_increasing_id())
    cut = staged(cut, "pack-windows")
    tails = cut.filter(F.col("length") < window)
    hist = {r["length"]: r["n"] for r in tails.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer rows than a window has tokens
    plan = solve(hist, window)
    full = (cut.filter(F.col("length") == window)
            .select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens",
                    F.col("row").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    names, schema = full.columns, full.schema
    bays = max(1, math.ceil(sum(k * n for k, n in hist.items()) / bay_tokens))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("row")  # the order in which rows arrive may differ from run to run
        ids, lengths = t.column("ids").combine_chunks(), t.column("length").to_numpy()
        bay = TaskContext.get().partitionId()
        pick, start, length, crc, seq, offset = [], [], [], [], [], []
        begin, whole = t.column("start").to_numpy(), t.column("crc").to_numpy()
        for s, pieces in enumerate(pack(lengths, plan, window)):
            at = 0
            for i, first, n in pieces:
                pick.append(i), start.append(int(begin[i]) + first), length.append(n), seq.append((bay << 32) | s), offset.append(at)
                crc.append(int(whole[i]) if n == lengths[i]
                           else zlib.crc32(np.frombuffer(ids[i].as_py(), "<u2")[first:first + n].astype("<u4")))
                at += n
        take = pa.array(pick, pa.int64())
        cols = [t.column("doc_id").take(take), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                t.column("doc_tokens").take(take), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())]
        yield from pa.Table.from_arrays(cols, names=names).to_batches(max_chunksize=50_000)

    dealt = tails.select("row", "doc_id", "start", "length", "doc_tokens", "crc", "ids").repartition(bays, F.xxhash64("row"))
    return full.unionByName(dealt.mapInArrow(run, schema))


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
