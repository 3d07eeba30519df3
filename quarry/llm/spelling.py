"""11. Spelling variants: near words by a frontier over a relational trie.

Words are counted in map tasks that send each distinct word once in a while, and
summed.  Each word enters the trie twice, from its start and, with another mark,
from its end.  The trie is an edge table: a row per prefix that two words or more
share and next character (a mark where a word ends there); below a prefix of one
word the edge carries that word.  An edit lies in the later half of one of a word's
two directions, so its states (word, position, node, edits) start at the node of its
first half; they are joined with the edges of one depth after another.  A step follows the word's
own character, or spends the one edit: another character (replaced), any character
without moving in the word (inserted), or moving in the word alone (deleted).  A
state whose node is a whole word after one edit names a neighbour; one that reaches
an edge with a single word is decided by comparing the two.

A depth whose edges are counted and small is broadcast; a larger one is joined by
node, and a node with many states by (node, salt), so a prefix that a third of the
words share is many tasks.  The
number of rounds is at most ``DEPTH``: words of that many characters or more, which
are no words of a language, meet by the hashes of their forms with one character
taken out; a form and place has at most one word for each letter, so these groups
are small however many words there are.

Defined results: a null text has no words; a null id counts as an empty one in the
hash; equal rows count each; an empty table gives an empty table; extra columns are
ignored; a word that is near none is a row with no form and itself as root.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import slices, small_side, staged, table

#: A run of letters, fixed by the contract.
RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, FORM_RATIO = 6, 5, 5
EDIT_MODULUS = 199
DEPTH = 32
#: A node with more states than this is joined in parts.
HOT = 50_000
#: Stands for the end of a word; no word holds it.
END = "."
FLUSH = 200_000
LONG_TEXT = 1 << 20
#: A depth's edges are broadcast up to this size.
BROADCAST_BYTES, EDGE_BYTES = 32 << 20, 200


def edited(doc_id, run: str) -> str:
    """The run without one character where 199 divides the hash of id and run, else as it is."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % EDIT_MODULUS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", change: Callable | None = edited,
                min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: words of ``min_chars`` characters found ``min_count`` times or more; ``change`` maps (id, run) to the word counted."""
    def run(batches):
        find, words = re.compile(RUN).finditer, Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})
            words.clear()
            return out

        for b in batches:
            for part in slices(b, 1):
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not t:
                        continue
                    t = t.encode().lower().decode()  # bytes: A-Z alone
                    here = Counter(re.findall(RUN, t)) if len(t) < LONG_TEXT else Counter(m.group() for m in find(t))
                    for word, n in here.items():
                        word = change(doc, word) if change else word
                        if len(word) >= min_chars:
                            words[word] += n
                if len(words) > FLUSH:
                    yield flush()
        if words:
            yield flush()

    sent = docs.select(F.col(id_col), F.col(text)).mapInArrow(run, "word string, n bigint")
    return sent.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def edges(words: DataFrame, least: int = 0) -> DataFrame:
    """depth, node, ch, leaf, after: the trie of words from depth ``least`` on.

    ch is END where node is a word; leaf is the only word behind the edge, else after holds the characters that follow it.
    """
    step = (words.select("word", F.posexplode(F.split(F.concat("word", F.lit(END)), "")).alias("depth", "ch")).filter(F.col("depth") >= least)
            .select("depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"), "ch", "word"))
    edge = step.groupBy("depth", "node", "ch").agg(F.count("*").alias("n"), F.min("word").alias("leaf"))
    # one row for each node; below a prefix of a single word there is nothing to walk
    node = (edge.groupBy("depth", "node").agg(F.sum("n").alias("all"), F.collect_list(F.struct("ch", "n", "leaf")).alias("out"))
            .filter("all > 1").select("depth", "node", "out", F.concat_ws("", "out.ch").alias("after")))
    node = staged(node, "spell-nodes")
    out = (node.select("depth", "node", F.explode("out").alias("e"))
           .select("depth", "node", "e.ch", F.when((F.col("e.n") == 1) & (F.col("e.ch") != END), F.col("e.leaf")).alias("leaf"),
                   F.when(F.col("e.n") > 1, F.concat("node", "e.ch")).alias("child")))
    return (out.join(node.select(F.col("node").alias("child"), "after"), "child", "left")
            .select("depth", "node", "ch", "leaf", "after"))


def hot_nodes(state: DataFrame, most: int) -> DataFrame | None:
    """node, salts of the nodes with more than ``most`` states: at most one for each ``most`` states.  None if there are none."""
    hot = state.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hot = staged(hot.select("node", F.ceil(F.col("n") / most).cast("int").alias("salts")), "spell-hot")
    return hot if hot.limit(1).count() else None


def frontier(words: DataFrame, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """word, near: pairs of words of at most ``depth`` characters that differ by exactly one edit, both ways."""
    spark = words.sparkSession
    both = F.explode(F.array(F.concat(F.lit(">"), "word"), F.concat(F.lit("<"), F.reverse("word"))))
    short = words.filter(F.length("word") <= depth).select(both.alias("word"))
    short = staged(short.withColumn("start", F.expr("cast(1 + (length(word) - 1) div 2 as int)")), "spell-short")
    first = short.agg(F.min("start")).first()[0] or 0
    trie = staged(edges(short, first).repartition("depth", "node"), "spell-trie")
    sizes = {r["depth"]: r["n"] for r in trie.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # at most ``depth`` rows
    found, state = [], None
    for level in range(first, max(sizes, default=-1) + 1):
        begun = short.filter(F.col("start") == level).select("word", F.col("start").alias("pos"), F.substring("word", 1, level).alias("node"), F.lit(0).alias("edits"))
        state = begun if state is None else state.unionByName(begun)
        here = state.withColumns({f"next{k}": F.expr(f"substring(concat(word, '{END}'), pos + {k}, 1)") for k in (1, 2)})
        edge = trie.filter(F.col("depth") == level).select("node", "ch", "leaf", "after")
        if sizes.get(level, 0) * EDGE_BYTES <= BROADCAST_BYTES:
            met = here.join(F.broadcast(edge), "node")
        elif (salted := hot_nodes(state, hot)) is None:
            met = here.join(edge, "node")
        else:
            salted = small_side(salted, 64)
            edge = (edge.join(salted, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts"))
            here = (here.join(salted, "node", "left").withColumn("salt", F.pmod(F.xxhash64("word"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts"))
            met = here.join(edge, ["node", "salt"]).drop("salt")
        fresh = F.col("edits") == 0
        met = met.filter(fresh | (F.col("ch") == F.col("next1")))
        child, pos, walk = F.concat("node", "ch"), F.col("pos"), F.col("after").isNotNull()

        def to(step, edits, when):
            """The state at the child, if the word's next character follows there (an unedited state may spend its edit there)."""
            goes = F.lit(True) if edits == 0 else F.instr("after", F.expr(f"substring(concat(word, '{END}'), pos + {step + 1}, 1)")) > 0
            return F.when(walk & when & goes, F.struct(F.lit(None).cast("string").alias("near"), (pos + step).cast("int").alias("pos"),
                                                       child.alias("node"), F.lit(edits).alias("edits")))

        follows = F.col("ch") == F.col("next1")
        ended = F.col("ch") == END
        near = (F.when(F.col("leaf").isNotNull(), F.when((F.abs(F.length("word") - F.length("leaf")) <= 1) & (F.levenshtein("word", "leaf", 1) == 1), F.col("leaf")))
                .when(ended & F.when(fresh, F.col("next2") == END).otherwise(F.col("next1") == END), F.col("node")))
        steps = F.array(
            F.when(near.isNotNull(), F.struct(near.alias("near"), F.lit(0).alias("pos"), F.lit("").alias("node"), F.lit(0).alias("edits"))),
            to(1, 0, fresh & follows),
            to(1, 1, ~fresh),
            to(1, 1, fresh & ~follows & (F.col("next1") != END)),  # replaced
            to(0, 1, fresh),  # inserted
            to(2, 1, fresh & (F.col("ch") == F.col("next2")) & (F.col("next1") != END) & (F.col("next2") != END)))  # deleted
        out = staged(met.select("word", F.explode(F.array_compact(steps)).alias("s")).select("word", "s.*"), f"spell-{level}")
        found.append(out.filter("near is not null").select("word", "near"))
        state = out.filter("near is null").drop("near")
    pairs = found[0] if found else spark.createDataFrame([], "word string, near string")
    for more in found[1:]:
        pairs = pairs.unionByName(more)

    def plain(c):
        rest = F.expr(f"substring({c}, 2)")
        return F.when(F.col(c).startswith("<"), F.reverse(rest)).otherwise(rest).alias(c)

    return pairs.select(plain("word"), plain("near")).distinct()


def long_pairs(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """word, near: such pairs of words of ``depth`` characters or more, by their forms with one character taken out."""
    def forms(batches):
        for b in batches:
            for word in b.column(0).to_pylist():
                for lo in range(0, len(word) + 1, 1024):
                    at = range(lo, min(lo + 1024, len(word) + 1))
                    out = [word[:i] + word[i + 1:] for i in at]
                    yield pa.RecordBatch.from_pydict({
                        "word": pa.array([word] * len(out), pa.string()), "place": pa.array([i if i < len(word) else -1 for i in at], pa.int64()),
                        "form": pa.array([_digest(x) for x in out], pa.binary())})

    one = words.select("word").filter(F.length("word") >= depth).mapInArrow(forms, "word string, place bigint, form binary")
    cut, whole = one.filter("place >= 0"), one.filter("place < 0").select("form", F.col("word").alias("near"))
    replaced = cut.join(cut.select("form", "place", F.col("word").alias("near")), ["form", "place"]).select("word", "near")
    shorter = cut.select("form", "word").join(whole, "form").select("word", "near")
    both = replaced.unionByName(shorter).unionByName(shorter.select(F.col("near").alias("word"), F.col("word").alias("near")))
    return both.filter("word <> near and levenshtein(word, near, 1) = 1").distinct()


def _digest(x: str) -> bytes:
    return hashlib.blake2b(x.encode(), digest_size=16).digest()


def near_words(words: DataFrame, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """word, near: all pairs of words, both ways, that differ by exactly one inserted, deleted or replaced character."""
    return frontier(words, depth, hot).unionByName(long_pairs(words, depth)).distinct()


def variants(words: DataFrame, ratio: int = FORM_RATIO, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of a table (word, n)."""
    words = staged(words, "spell-words")
    near = near_words(words, depth, hot)
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (near.join(small_side(other, 64), "near").groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b")))
    all_ = words.join(best, "word", "left")
    has = -F.col("b.less") >= ratio * F.col("n")
    all_ = staged(all_.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                              F.when(has, F.col("b.form")).alias("form"), F.when(has, -F.col("b.less")).alias("form_n")), "spell-forms")
    # a form is ratio times as frequent, so chains are short; each round doubles the part followed
    root = all_.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = root.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = staged(root.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "spell-roots")
        root = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            break
    return all_.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
with recursive tab as (
  select list(c order by i) as t from (
    select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from range(256) r(i))
), runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from documents) group by 1, 2
), hashed as (
  select run, n, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::bigint)),
                                 lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as h
  from (select run, n, encode(coalesce(doc_id::varchar, '') || ':' || run) as b from runs), tab
), words as (
  select word, sum(n)::bigint as n from (
    select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed)
  where length(word) >= 6 group by word having sum(n) >= 5
), cut as (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as form from (select word, unnest(range(1, length(word) + 1)) as i from words)
), near as (
  select a.word, b.word as near from cut a join cut b on a.form = b.form and a.i = b.i and a.word <> b.word
  union select a.word, a.form from cut a join words b on a.form = b.word
  union select a.form, a.word from cut a join words b on a.form = b.word
), best as (
  select e.word, count(*) as n_near, arg_min(e.near, (-w.n, e.near)) as form, max(w.n) as form_n
  from near e join words w on w.word = e.near group by e.word
), forms as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.form_n >= 5 * w.n then b.form end as form, case when b.form_n >= 5 * w.n then b.form_n end as form_n
  from words w left join best b using (word)
), up as (
  select word, word as last, 0 as d from forms
  union all select up.word, f.form, up.d + 1 from up join forms f on f.word = up.last where f.form is not null
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n
from forms f join (select word, arg_max(last, d) as root from up group by word) r using (word)
"""
