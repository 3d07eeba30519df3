"""1. Byte-level BPE: encoding by a pair occurrence index, and decoding.

The distinct pre-tokens of a block of texts lie in one symbol array with links
to the left and right neighbour.  An index maps every pair to all positions
where it stands.  Active ranks are taken in ascending order; a rank's merge is
applied at all of its positions at once, and only the lists of the pairs it
creates are extended (stale positions are recognised when their rank comes).

The table is a file of a public tokenizer, read by the driver and broadcast
(50,000 merges, about 2 MB: it doesn't grow with the data).

Defined results: null and empty texts have no tokens; a special token's string
in a text becomes its id, as the tokenizers library has it by default; rows are
independent, so repeated rows repeat their result; an empty table gives an
empty table; input columns called ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField

from quarry.llm.common import map_text, table

#: The published split pattern of this kind of vocabulary, a fixed value; \s spelt out as the White_Space property.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Distinct words kept with their ids from block to block of a task; more start the store anew.
WORDS_KEPT = 150_000
BLOCK_BYTES = 2 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones stand for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Table:
    """Merges as sorted pair keys with rank and product, ids of the 256 bytes, bytes of every id."""

    def __init__(self, spec: dict):
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_id = np.array([vocab[c] for c in letters], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.piece: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.piece[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.piece[i] = s.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = size
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.left, self.right = left, right
        key = left * size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of = key[order], order

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it has none."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)


def load(path: str) -> Table:
    with open(path, encoding="utf-8") as f:
        return Table(json.load(f))


def merge_words(words: list[bytes], t: Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and the end of each word's ids."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lens.sum())
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lens)
    sym = np.append(t.bytes_id[np.frombuffer(b"".join(words), np.uint8)], -1).astype(np.int32)
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[ends[lens > 0] - 1] = n  # n: no neighbour
    prv = np.arange(-1, n, dtype=np.int32)
    prv[(ends - lens)[lens > 0]] = -1
    lists: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(pos: np.ndarray) -> None:
        """Enter positions, whose right neighbours exist, in the lists of their pairs."""
        rank = t.ranks(sym[pos], sym[nxt[pos]])
        if not (known := rank >= 0).all():
            pos, rank = pos[known], rank[known]
        if not len(pos):
            return
        order = np.argsort(rank, kind="stable")
        pos, rank = pos[order], rank[order]
        cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        for k, r in zip(range(len(cut) - 1), rank[cut[:-1]].tolist()):
            if r in lists:
                lists[r].append(pos[cut[k]:cut[k + 1]])
            else:
                lists[r] = [pos[cut[k]:cut[k + 1]]]
                heapq.heappush(active, r)

    add(np.flatnonzero(nxt < n).astype(np.int32))
    while active:
        r = heapq.heappop(active)
        found = lists.pop(r)
        pos = np.concatenate(found) if len(found) > 1 else found[0]
        a, b = t.left[r], t.right[r]
        pos = pos[(sym[pos] == a) & (sym[nxt[pos]] == b)]
        if a == b and len(pos) > 1:  # in a run of equal symbols every second one pairs, from the left
            pos = np.sort(pos)
            run = np.append(True, pos[1:] != nxt[pos[:-1]])
            first = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - first) % 2 == 0]
        if not len(pos):
            continue
        gone = nxt[pos]
        after = nxt[gone]
        sym[pos] = t.made[r]
        sym[gone] = -1
        nxt[pos] = after
        prv[after] = pos  # prv has a place for "no neighbour" too
        before = prv[pos]
        before = before[(before >= 0) & (sym[before] != t.made[r])]  # one that merged just now is in pos itself
        add(np.concatenate((before, pos[after < n])))
    left = sym[:n] >= 0
    return sym[:n][left], np.cumsum(np.bincount(owner[left], minlength=len(words)))


def gather(flat: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``row``, one after another, and the end of each; entry i is flat[ends[i]:ends[i + 1]]."""
    start = ends[row]
    lens = ends[row + 1] - start
    at = np.cumsum(lens)
    total = int(at[-1]) if len(at) else 0
    return flat[np.arange(total) + np.repeat(start - at + lens, lens)], at


class Numbered(dict):
    """Numbers keys in the order of their first lookup."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """Chunks seen in a task, with their ids; ``block`` encodes a list of texts.

    A text is cut before each single space; the split pattern never joins what
    stands on both sides of such a cut, so it runs only once for each distinct
    chunk, and the merges once for each distinct pre-token of the new chunks.
    """

    def __init__(self, t: Table, kept: int = WORDS_KEPT):
        self.t, self.kept = t, kept
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(t.special, key=len, reverse=True))) + ")") if t.special else None
        self.reset()

    def reset(self) -> None:
        #: Key: a chunk after a space as it stands, any other piece in a tuple, a special token's id.
        self.known = Numbered()
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def keys(self, text: str) -> list:
        if self.cut is not None and any(s in text for s in self.t.special):
            out: list = []
            for k, part in enumerate(self.cut.split(text)):
                out += [self.t.special[part]] if k % 2 else self.pieces(part)
            return out
        return self.pieces(text)

    def pieces(self, text: str) -> list:
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [(w,) for w in self.find(text)]
        chunks: list = text.split(" ")
        chunks[0] = (chunks[0],)
        return chunks

    def learn(self, new: list) -> None:
        """Enter the ids of new chunks."""
        t, pre, rows, ends = self.t, Numbered(), [], []
        for key in new:
            if not isinstance(key, int):
                rows += [pre[w] for w in self.find(" " + key if isinstance(key, str) else key[0])]
            else:
                rows.append(pre[key])
            ends.append(len(rows))
        words = [t.piece[w] if isinstance(w, int) else w.encode() for w in pre]
        flat, stops = merge_words(words, t)
        stops = np.append(0, stops)
        flat, at = gather(flat, stops, np.array(rows, np.int64))
        at = np.append(0, at)[np.array(ends, np.int64)]
        single = [(k, key) for k, key in enumerate(new) if isinstance(key, int)]
        if single:  # a special token is one id, whatever its bytes would merge to
            parts = np.split(flat, at[:-1])
            for k, key in single:
                parts[k] = np.array([key], np.int32)
            flat, at = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        self.ends = np.concatenate((self.ends, at + len(self.flat)))
        self.flat = np.concatenate((self.flat, flat))

    def block(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > self.kept:
            self.reset()
        known, had, rows = self.known, len(self.known), []
        for text in texts:
            keys = self.keys(text) if text else []
            rows.append(np.fromiter(map(known.__getitem__, keys), np.int32, len(keys)))
        if len(known) > had:
            self.learn(list(known)[had:])
        return [gather(self.flat, self.ends, row)[0].astype("<u4") for row in rows]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``ids``: the text's token ids as little-endian unsigned 32-bit integers (binary)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def make():
        enc = Encoder(shared.value)
        return lambda col: [pa.array([x.tobytes() for x in enc.block(col.to_pylist())], pa.binary())]

    return map_text(docs, make, [StructField(out, BinaryType())], text, BLOCK_BYTES)


def texts_of(rows, piece: list[bytes]) -> pa.Array:
    """The text of each row of ids."""
    joined = (b"".join(map(piece.__getitem__, ids.tolist())) for ids in rows)
    return pa.array([x.decode("utf-8", "replace") for x in joined], pa.string())


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``decoded``: the text of packed ids, special tokens included; broken UTF-8 gives U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(load(path).piece)

    def make():
        return lambda col: [texts_of((np.frombuffer(x or b"", "<u4") for x in col.to_pylist()), shared.value)]

    return map_text(df, make, [StructField(out, StringType())], ids)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``decoded``, as ``encode`` and then ``decode`` do, from one Python worker per task."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def make():
        enc = Encoder(shared.value)

        def both(col):
            ids = enc.block(col.to_pylist())
            return [pa.array([x.tobytes() for x in ids], pa.binary()), texts_of(ids, shared.value.piece)]

        return both

    fields = [StructField("ids", BinaryType()), StructField("decoded", StringType())]
    return map_text(docs, make, fields, text, BLOCK_BYTES)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; keep the digests and the number of tokens."""
    return round_trip(docs, path).withColumns({
        "n_tokens": F.expr("cast(octet_length(ids) div 4 as bigint)"),
        "ids_sha256": F.sha2("ids", 256),
        "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
    })


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
