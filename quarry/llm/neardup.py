"""3. Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Terms are 5-word shingles of the lower-cased text; a term weighs its count times
its inverse document frequency 1 + ln(N / df) / ln(1 / FLOOR), where frequencies
under FLOOR·N count as FLOOR·N.  So only terms in 1 % of the documents or more need
a table - at most 100 × the mean number of shingles, whatever N - and it is
broadcast.  Their frequencies are counted over all documents: tasks send sorted
unique hashes packed by hash range, a range is merged at a time.

Equal texts are one node.  100 samples a node make 20 bands of 5 (a pair at
similarity 0.8 shares no band with probability 4e-4).  In a bucket of nodes the
members with most company over all their buckets - the most central ones - are
leaders and compared with the others, which joins most of a large group.  Then
only members outside their bucket's largest component are compared with the
members of other components, in blocks of ``BLOCK`` at a time; so no link between
texts that share a band is lost, and copies are never expanded into all pairs.
Pairs are verified by exact weighted Jaccard similarity; a leader's comparisons
are split into blocks of members, so a hot one is many tasks.

Defined results: null texts and those without a word are classes of their own; equal
rows are copies of each other; the kept document of a class has the smallest id
(null ids last); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import free, mix, raw, shingles, slices, small_side, staged, table, word_hashes, word_spans
from quarry.llm.sampling import Sampler

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
FLOOR = 0.01
TOP = 2.0  # weight of a term found once in its text and in few documents
BLOCK = 64
LEADERS = 3
DOCS_PER_RANGE = 1_000
FLUSH = 500_000


def shingled(col: pa.Array):
    """Shingle hashes of each text of an Arrow array."""
    data, offs = raw(pc.utf8_lower(col))
    starts, ends, at = word_spans(data, offs)
    words = word_hashes(data, starts, ends)
    for i in range(len(offs) - 1):
        yield shingles(words[at[i]:at[i + 1]], SHINGLE)


class Weights:
    """TF-IDF weights of shingles, from the table of frequent ones."""

    def __init__(self, frequent: np.ndarray, df: np.ndarray, total: int, shift: int):
        self.terms, self.shift = frequent, np.uint64(shift)
        self.idf = 1 + np.log(total / np.maximum(df, 1)) / math.log(1 / FLOOR)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms, n = np.unique(hashes, return_counts=True)
        idf = np.full(len(terms), TOP)
        if len(self.terms) and len(terms):
            short = terms >> self.shift
            at = np.minimum(np.searchsorted(self.terms, short), len(self.terms) - 1)
            idf = np.where(self.terms[at] == short, self.idf[at], TOP)
        return terms, n * idf


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets (terms ascending)."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    least = np.minimum(a[1][at[both]], b[1][both]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def frequent_terms(texts: DataFrame, total: int) -> Weights:
    """Document frequencies of the shingles in FLOOR of the documents or more, over all documents."""
    bits = min(20, max(4, math.ceil(math.log2(max(1, total / DOCS_PER_RANGE)))))
    shift = 32 - bits  # a term counts by its first bits + 32 bits
    least = max(2, math.ceil(FLOOR * total))

    def pack(batches):
        held, size = [], 0

        def flush():
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(terms >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = []
            for r in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                low, k = terms[cut[r]:cut[r + 1]].astype(np.uint32), n[cut[r]:cut[r + 1]]
                rows.append((r, low[k == 1].tobytes(), low[k > 1].tobytes(), k[k > 1].astype(np.uint32).tobytes()))
            held.clear()
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["range", "ones", "more", "times"])

        for b in batches:
            for part in slices(b, 0):
                for s in shingled(part.column(0)):
                    if len(s):
                        held.append(np.unique(s >> np.uint64(shift)))
                        size += len(held[-1])
                if size > FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(key, rows):
        ones = [np.frombuffer(x, np.uint32) for x in rows["ones"]]
        terms = np.concatenate([*ones, *(np.frombuffer(x, np.uint32) for x in rows["more"])])
        n = np.concatenate([np.ones(sum(map(len, ones)), np.int64), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["times"])])
        order = np.argsort(terms, kind="stable")
        terms, n = terms[order], n[order]
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        df = np.add.reduceat(n, first)
        big = df >= least
        import pandas as pd

        return pd.DataFrame({"term": (terms[first][big].astype(np.int64) | (np.int64(key[0]) << 32)), "df": df[big]})

    packed = texts.mapInArrow(pack, "range int, ones binary, more binary, times binary")
    found = packed.groupBy("range").applyInPandas(merge, "term bigint, df bigint").toPandas().sort_values("term")
    return Weights(found.term.to_numpy().astype(np.uint64), found.df.to_numpy().astype(np.float64), total, shift)


def bands(texts: DataFrame, weights) -> DataFrame:
    """key, weight (of all terms), bands of each distinct text.  A task signs a text once."""
    def sign(batches):
        sampler, seen = Sampler(BANDS * ROWS, TOP), set()
        odd = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        number = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for b in batches:
            for part in slices(b, 1):
                keys, out = part.column(0).to_pylist(), []
                for key, s in zip(keys, shingled(part.column(1))):
                    if key in seen or not len(s):
                        continue
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(key)
                    terms, w = weights.value(s)
                    code = sampler.sample(terms, w).reshape(BANDS, ROWS)
                    out.append((key, float(w.sum()), mix((code * odd).sum(axis=1) ^ number).view(np.int64)))
                if out:
                    k, w, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(w, pa.float64()), pa.array(list(c), pa.list_(pa.int64()))],
                                                     names=["key", "weight", "bands"])

    signed = texts.select("key", "text").mapInArrow(sign, "key binary, weight double, bands array<bigint>")
    return signed.groupBy("key").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"))


def verify(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose weighted Jaccard similarity reaches the threshold.  b may be hot: its pairs are cut in blocks."""
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = (pairs.join(blocks, "b").select("b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), "a")
              .join(texts.withColumnRenamed("key", "a"), "a").select("b", "block", "kind", "a", "text"))
    leader = (blocks.join(texts.withColumnRenamed("key", "b"), "b")
              .select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("b").alias("a"), "text"))

    def compare(batches):
        now, held = None, None
        for batch in batches:
            for part in slices(batch, 4):
                out = []
                cols = [part.column(i).to_pylist() for i in range(4)]
                for b, block, kind, a, s in zip(*cols, shingled(part.column(4))):
                    w = weights.value(s)
                    if kind == 0:
                        now, held = (b, block), w
                    elif now == (b, block) and similarity(held, w) >= threshold:
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    return (member.unionByName(leader).repartition("b", "block").sortWithinPartitions("b", "block", "kind")
            .mapInArrow(compare, "a binary, b binary"))


def verify_rest(rest: DataFrame, body: DataFrame, weights, threshold: float) -> DataFrame:
    """Links between members (band, key, weight, comp) of one bucket that lie in different components.

    Of two such members one at least is outside the bucket's largest component.
    These are numbered off in blocks; all members of the bucket stream past
    each block once.  A pair is compared in the first bucket that it shares.
    """
    count = rest.groupBy("band", "comp").agg(F.count("*").alias("n"))
    main = count.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps")).filter("comps > 1")
    rest = staged(rest.join(main.select("band", F.col("m.comp").alias("main")), "band").withColumn("out", F.col("comp") != F.col("main")).drop("main"), "rest")
    by_key = Window.partitionBy("band").orderBy("key")
    lead = rest.filter("out").withColumn("block", F.floor((F.row_number().over(by_key) - 1) / BLOCK).cast("int"))
    blocks = lead.groupBy("band").agg(F.max("block").alias("last"))
    member = rest.join(blocks, "band").select("*", F.explode(F.sequence(F.lit(0), "last")).alias("block")).drop("last")
    rows = (lead.withColumn("kind", F.lit(0)).unionByName(member.withColumn("kind", F.lit(1)))
            .join(body, "key").select("band", "block", "kind", "key", "comp", "out", "weight", "bands", "text"))

    def compare(batches):
        now, held = None, []
        for batch in batches:
            for part in slices(batch, 8):
                out = []
                cols = [part.column(i).to_pylist() for i in range(8)]
                for band, block, kind, key, comp, outer, weight, bands_, s in zip(*cols, shingled(part.column(8))):
                    if (band, block) != now:
                        now, held = (band, block), []
                    mine = np.array(bands_, np.int64)
                    if kind == 0:
                        held.append((key, comp, weight, mine, weights.value(s)))
                        continue
                    w = None
                    for k, c, x, b, v in held:
                        if c == comp or (outer and key >= k) or min(x, weight) < threshold * max(x, weight) - 1e-9:
                            continue
                        if int(b[np.argmax(b == mine)]) != band:
                            continue
                        w = weights.value(s) if w is None else w
                        if similarity(v, w) >= threshold:
                            out.append((key, k))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    return rows.repartition("band", "block").sortWithinPartitions("band", "block", "kind").mapInArrow(compare, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """Smallest node of the component of each linked node (key, comp): smallest neighbour and pointer doubling, in rounds."""
    both = staged(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    now = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("key"), F.least("u", "v").alias("comp"))
    now = staged(now, "comp")
    while True:
        near = both.join(now.withColumnRenamed("key", "u"), "u").groupBy("v").agg(F.min("comp").alias("near"))
        step = (now.join(near.withColumnRenamed("v", "key"), "key")
                .select("key", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        step = staged(step, "comp")
        root = step.select(F.col("key").alias("comp"), F.col("comp").alias("root"))
        step = staged(step.join(root, "comp").select("key", "old", F.least("comp", "root").alias("comp")), "comp")
        now = step.drop("old")
        if not step.filter("old <> comp").limit(1).count():
            return now


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, class_id, class_size, kept for every row; ``key`` (binary) names the text, null for one without words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("key", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5("text"))))
    texts = rows.filter("key is not null").select("key", "text")
    weights = spark.sparkContext.broadcast(frequent_terms(texts.select("text"), docs.count()))
    nodes = staged(bands(texts, weights), "bands")
    long = nodes.select("key", "weight", F.explode("bands").alias("band"))
    shared = long.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    open_ = staged(long.join(shared, "band"), "buckets")
    company = open_.groupBy("key").agg(F.sum("n").alias("company"))
    open_ = staged(open_.drop("n").join(company, "key"), "buckets")
    wanted = small_side(staged(company.select("key"), "candidates"), 48)
    body = texts.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    body = staged(body.join(nodes.select("key", "bands"), "key"), "candidate-texts")
    central = Window.partitionBy("band").orderBy(F.col("company").desc(), "key")
    lead = (open_.withColumn("n", F.row_number().over(central)).filter(F.col("n") <= LEADERS)
            .select("band", F.col("key").alias("b"), F.col("weight").alias("wb"), "n"))
    pairs = (open_.join(lead, "band").filter("key <> b").filter(F.least("weight", "wb") >= threshold * F.greatest("weight", "wb") - 1e-9)
             .select(F.greatest("key", "b").alias("a"), F.least("key", "b").alias("b")).distinct())
    links = staged(verify(staged(pairs, "pairs"), body.drop("bands"), weights, threshold), "links")
    comp = components(links)
    rest = open_.join(lead.select("band", F.col("b").alias("key")), ["band", "key"], "left_anti").select("band", "key", "weight")
    rest = rest.join(small_side(comp, 48), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    more = staged(verify_rest(rest, body, weights, threshold), "links")
    if more.limit(1).count():
        comp = components(links.unionByName(more))
    weights.destroy()  # all that needs it is written
    slim = staged(rows.select("doc_id", "key"), "rows")
    named = slim.filter("key is not null").join(small_side(comp, 48), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    size = named.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key")).alias("first"), F.count("*").alias("class_size"))
    out = named.join(size, "comp").select("doc_id", "key", F.col("first.doc_id").alias("class_id"), "class_size",
                                          (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))).alias("kept"))
    bare = slim.filter("key is null").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(bare)


def keep_first(docs: DataFrame, found: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that ``near_duplicates`` keeps, one row each (equal rows of a kept document too), columns unchanged."""
    id_, key, n, mine = free(docs, "kept_id", "kept_key", "kept_n", "text_key")
    keep = found.filter("kept and key is not null").groupBy(F.col("doc_id").alias(id_), F.col("key").alias(key)).agg(F.count("*").alias(n))
    keep = small_side(staged(keep, "kept"), 64)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    wordy = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    hit = docs.filter(wordy).withColumn(mine, F.unhex(F.md5(text))).join(keep, (F.col(mine) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(id_)))
    once = hit.filter(F.col(n) == 1).select(*cols)
    again = hit.filter(F.col(n) > 1).dropDuplicates([id_, key]).select(*cols)
    return once.unionByName(again).unionByName(docs.filter(~wordy))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")
