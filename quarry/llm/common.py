"""Helpers of the operators here: reading, work tables, Arrow row maps, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.session import ship_package, work_path

#: A word is a run of anything but these: fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Word hashes take some 40 bytes of work arrays for each byte of a slice.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a slim table under the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = work_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_side(df: DataFrame, bytes_per_row: int, max_bytes: int = 32 << 20) -> DataFrame:
    """Mark a side for broadcast if its counted rows prove it small; else leave it for a shuffled join."""
    return F.broadcast(df) if df.count() * bytes_per_row <= max_bytes else df


def without(df: DataFrame, names) -> DataFrame:
    """Drop input columns that an output column of the same name (any case) replaces."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that a column of ``df`` has already (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def slices(batch: pa.RecordBatch, col: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes (one long text may exceed it)."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def map_text(df: DataFrame, make: Callable, fields: list[StructField], text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Add ``fields`` computed from the text column.

    ``make()`` runs once per task and gives a function from an Arrow text array
    to one Arrow array per field.  Input columns named like a field are replaced.
    """
    df = without(df, [f.name for f in fields])
    schema = StructType(df.schema.fields + fields)
    at, names = df.columns.index(text), schema.names

    def run(batches):
        f = make()
        for b in batches:
            for part in slices(b, at, limit):
                yield pa.RecordBatch.from_arrays([*part.columns, *f(part.column(at))], names=names)

    return df.mapInArrow(run, schema)


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text array and its offsets from 0; null counts as empty."""
    arr = pc.fill_null(arr, "") if arr.null_count else arr
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    if len(arr) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0]:offs[-1]]
    return data, offs - offs[0]


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the range of its words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[(offs > 0) & (offs < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


#: Odd multiplier of the polynomial hashes, and the finaliser's published multipliers: fixed values.
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_POW = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 … n-1, modulo 2^64."""
    global _POW
    if len(_POW) < n:
        p = np.full(max(n, 1024), BASE, np.uint64)
        p[0] = 1
        _POW = np.cumprod(p, dtype=np.uint64)
    return _POW[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_A)
    x ^= x >> np.uint64(33)
    x *= np.uint64(MIX_B)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, from its bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens)))
    within = np.arange(at[-1]) - np.repeat(at[:-1], lens)
    value = (data[within + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[within]
    return mix(np.add.reduceat(value, at[:-1]) ^ lens.astype(np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text; a shorter text is one window, an empty one has none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    p = powers(k + 1)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += words[j:n - k + 1 + j] * p[j + 1]
    return mix(out)
