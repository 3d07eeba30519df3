"""7. Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1-, 2- and 3-grams of the lower-cased text, with every run of
other characters than letters as one space, hashed to 2^16 places; a feature's
value is its relative frequency times its inverse document frequency.  Document
frequencies count every learnable document in full.  The weights are learned with
follow-the-regularised-leader (proximal, per-coordinate rates, L1 and L2) on a
bounded sample of labelled rows - ``PER_LANG`` documents of each language, those
with the smallest hash - and a temperature is fitted on every fifth of them, kept
out of the learning.  The model (places × languages) is broadcast; its size does
not depend on the data.

Defined results: a null text and one without a letter is ``und`` with score 0, as is
everything when no labelled text can be learned from; a row with a null id or
null language is never learned from; equal rows repeat their result; an empty
table gives an empty table; columns named like an output are replaced; a very
long text is scored in pieces, its memory is that of one piece.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from quarry.llm.common import map_text, slices, small_side, staged, table

BITS = 16
PLACES = 1 << BITS
GRAMS = (1, 2, 3)
PER_LANG = 600
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
SCALE = 10.0
PIECE = 1 << 20
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def normal(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of other characters than letters as one space, one at either end."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = letters()[c]
    c = np.where(keep, c, np.uint32(32))
    keep[1:] |= keep[:-1]
    keep[0] = True
    return c[keep] if keep[1:].any() else c[:0]


def grams(c: np.ndarray) -> np.ndarray:
    """Places of all n-grams of a normalised text."""
    out = []
    for n in GRAMS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ c[j:len(c) - n + 1 + j]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pieces(c: np.ndarray):
    """Cuts of a normalised text whose n-grams together are those of the whole: each n-gram starts in one piece."""
    if len(c) <= PIECE:
        yield grams(c)
        return
    for n in GRAMS:
        for at in range(0, len(c) - n + 1, PIECE):
            part = c[at:at + PIECE + n - 1]
            h = np.full(len(part) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ part[j:len(part) - n + 1 + j]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            yield (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # places × languages, the inverse document frequency and scale multiplied in
    bias: np.ndarray
    heat: float = 1.0

    def score(self, text: str | None) -> tuple[str, float]:
        c = normal(text) if text and self.langs else np.zeros(0, np.uint32)
        if not len(c):
            return "und", 0.0
        total, n = np.zeros(len(self.langs)), 0
        for g in pieces(c):
            total += np.array([w.take(g).sum(dtype=np.float64) for w in self.weight])
            n += len(g)
        p = softmax((total / n + self.bias) / self.heat)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each place occurs, and the number of texts with a letter.  One row a place and task is shuffled."""
    schema = StructType([StructField("place", IntegerType()), StructField("df", LongType())])

    def count(batches):
        df, n, any_ = np.zeros(PLACES, np.int64), 0, False
        for b in batches:
            for part in slices(b, 0):
                for t in part.column(0).to_pylist():
                    c = normal(t) if t else ()
                    if len(c):
                        seen = np.zeros(PLACES, bool)
                        for g in pieces(c):
                            seen[g] = True
                        df += seen
                        n += 1
                        any_ = True
        if any_:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["place", "df"])

    rows = docs.select(text).mapInArrow(count, schema).groupBy("place").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(PLACES, np.int64)
    at = rows.place.to_numpy()
    df[at[at >= 0]] = rows.df.to_numpy()[at >= 0]
    return df, int(rows.df[rows.place == -1].sum())


def vectors(docs: DataFrame, text: str) -> DataFrame:
    """Sparse relative frequencies (places, values) of the texts that have a letter."""

    def make():
        def run(col):
            at, val = [], []
            for t in col.to_pylist():
                count = np.zeros(PLACES, np.int64)
                for g in pieces(normal(t) if t else np.zeros(0, np.uint32)):
                    count += np.bincount(g, minlength=PLACES)
                i = np.flatnonzero(count)
                at.append(i.astype(np.int32))
                val.append((count[i] / max(1, count.sum())).astype(np.float32))
            return [pa.array(at, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))]

        return run

    out = map_text(docs, make, [StructField("at", ArrayType(IntegerType())), StructField("val", ArrayType(FloatType()))], text)
    return out.filter(F.size("at") > 0).drop(text)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows, in their order: weights (places × languages) and bias."""
    z, n = np.zeros((PLACES + 1, n_langs)), np.zeros((PLACES + 1, n_langs))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, PLACES), np.append(x, 1.0)  # the last place is the bias
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g2
    w = weights(z, n)
    return w[:PLACES], w[PLACES]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood (golden section on its logarithm).

    The labels are smoothed by one row in all, else separable rows would ask for a temperature of 0.
    """
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    goal = np.full(logits.shape, 1 / (len(y) + 2) / (logits.shape[1] - 1))
    goal[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)

    def loss(u):
        return -(goal * np.log(np.maximum(softmax(logits / np.exp(u)), 1e-300))).sum(axis=1).mean()

    a, b, g = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG) -> Model:
    """Learn from the rows with a language; document frequencies from all of them, weights from the bounded sample."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    df, total = frequencies(docs, "text")
    if not total:
        return Model([], np.zeros((0, PLACES)), np.zeros(0))
    # a row per distinct text; of each language those whose hash lies lowest, by a share that leaves some 3 * per_lang
    slim = docs.filter(F.col("text").rlike(r"\p{L}")).select("id", "lang", F.xxhash64("text").alias("h"))
    slim = slim.groupBy("lang", "h").agg(F.min("id").alias("id")).withColumn("at", F.shiftrightunsigned("h", 11) / float(1 << 53))
    slim = staged(slim, "lang-texts")
    share = slim.groupBy("lang").agg((3.0 * per_lang / F.count("*")).alias("share"))  # a row for each language, as the model has
    order = Window.partitionBy("lang").orderBy("at", "h")
    picked = (slim.join(F.broadcast(share), "lang").filter("at <= share")
              .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang).select("id", "lang", "h"))
    rows = docs.withColumn("h", F.xxhash64("text")).join(small_side(picked, 64), ["id", "lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    rows = vectors(rows.select("id", "lang", "h", "text"), "text").toPandas().sort_values(["h", "lang"], kind="stable")
    langs = sorted(set(rows.lang))
    idf = np.log((1 + total) / (1 + df)) + 1
    number = {v: i for i, v in enumerate(langs)}
    data = [(np.asarray(a), np.asarray(v, np.float64) * idf[a] * SCALE, number[k]) for a, v, k in zip(rows["at"], rows["val"], rows["lang"])]
    held = data[4::5]
    weight, bias = learn([r for i, r in enumerate(data) if i % 5 != 4], len(langs))
    logits = np.array([x @ weight[a] + bias for a, x, _ in held]).reshape(-1, len(langs))
    heat = temperature(logits, np.array([y for *_, y in held], int))
    return Model(langs, np.ascontiguousarray((weight * (idf * SCALE)[:, None]).T.astype(np.float32)), bias, heat)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(col):
            found = [shared.value.score(t) for t in col.to_pylist()]
            return [pa.array([a for a, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

        return run

    return map_text(docs, make, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], text)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows kept out of the learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(learnable(docs))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
