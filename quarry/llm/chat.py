"""5. Chat formatting by quotation linking, in DataFrame functions alone.

Quote levels are the ``>`` signs that open a line.  Runs of lines of one level are
passages, cut at blank lines; normalised (lower case, other characters than
letters and digits as one space) and hashed, they are joined with the hashed bodies,
paragraphs and lines of the original messages.  A passage links to the first
message of its conversation that wrote it, if that came earlier; a passage of several
lines that is no such unit links to the first message that holds all its lines.  A message replies
to the latest message it quotes at its outermost linked level.  Messages that
reply to one another form threads (their first message found by pointer
doubling), and a conversation is ordered by the start of the thread, then by turn.

Only hashes and turns are shuffled for the links, and the join side of originals is
one row per conversation and hash.  Lines of a passage are looked for only in the
messages that hold the one of them that fewest messages hold, equal passages and
equal bodies once.  Positions come from running sums in blocks
of turns, so a conversation with a third of all rows spreads over many tasks.

Defined results: a null text has a null body and no quotes; an empty text an empty
body; messages with null conversation or turn get no position and no link; equal
turns share a position, equal rows are one message and repeat its result; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import small_side, staged, table
from quarry.operators.common import running_sum

MARKS = r"^[ \t]*(?:>[ \t]?)+"
QUOTED = r"(?m)^[ \t]*>"
#: An introduction of a quote, dropped with it.
INTRODUCTION = r"(?i)\b(wrote|writes|schrieb|écrit|escribió)\s*:\s*$"
BLANK = r"\n[ \t]*(?=\n)\n"


def parsed(text: F.Column) -> F.Column:
    """Array of (level, line) of a text."""
    def one(line):
        marks = F.regexp_extract(line, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.substr(line, F.length(marks) + 1).alias("line"))

    return F.transform(F.split(text, "\n", -1), one)


def body(text: F.Column) -> F.Column:
    """The text without quoted lines and their introductions; as it is if it quotes nothing."""
    def own(lines):
        def keep(x, i):
            intro = (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0) & x["line"].rlike(INTRODUCTION)
            return (x["level"] == 0) & ~intro

        return F.array_join(F.transform(F.filter(lines, keep), lambda x: x["line"]), "\n")

    stripped = F.element_at(F.transform(F.array(parsed(text)), own), 1)
    return F.when(text.rlike(QUOTED), F.regexp_replace(stripped, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")).otherwise(text)


def normal_hash(passage: F.Column) -> F.Column:
    """Hash of a normalised passage; null if it has no letter or digit."""
    clean = F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean != "", F.md5(clean))


def message_key() -> F.Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("conv_id", "turn", "role", "text")])


def line_hashes(passage: F.Column) -> F.Column:
    """Distinct hashes of the lines of a passage, in order of the hash."""
    return F.sort_array(F.array_distinct(F.array_compact(F.transform(F.split(passage, "\n", -1), normal_hash))))


def holders(parts: DataFrame, messages: DataFrame) -> DataFrame:
    """Per conv_id and part (with its line hashes ``lines``): held_turn, the first turn of a message that holds all the lines."""
    need = parts.select("conv_id", "part", F.size("lines").alias("n"), F.explode("lines").alias("hash"))
    bodies = (messages.filter("conv_id is not null and turn is not null and body is not null")
              .join(small_side(parts.select("conv_id").distinct(), 24), "conv_id", "left_semi")
              .groupBy("conv_id", "body").agg(F.min("turn").alias("held_turn")))
    held = (bodies.select("conv_id", F.md5("body").alias("message"), "held_turn", F.explode(line_hashes(F.col("body"))).alias("hash"))
            .join(small_side(need.select("conv_id", "hash").distinct(), 64), ["conv_id", "hash"], "left_semi"))
    held = staged(held, "held-lines")
    often = held.groupBy("conv_id", "hash").agg(F.count("*").alias("often"))
    rarest = (need.join(often, ["conv_id", "hash"]).groupBy("conv_id", "part", "n").agg(F.count("*").alias("found"), F.min(F.struct("often", "hash")).alias("r"))
              .filter("found = n").select("conv_id", "part", "n", F.col("r.hash").alias("hash")))
    tried = rarest.join(held, ["conv_id", "hash"]).select("conv_id", "part", "message", "held_turn")
    whole = (tried.join(need, ["conv_id", "part"]).join(held.select("conv_id", "message", "hash"), ["conv_id", "message", "hash"])
             .groupBy("conv_id", "part", "message", "n", "held_turn").agg(F.count("*").alias("found")).filter("found = n"))
    return whole.groupBy("conv_id", "part").agg(F.min("held_turn").alias("held_turn"))


def links(messages: DataFrame) -> DataFrame:
    """Per quoting message (key): n_quotes, n_linked, max_level, reply_to."""
    quoting = messages.filter(F.col("text").rlike(QUOTED) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).dropDuplicates(["key"])
    # runs of one level: the lines of a message numbered by the changes of level up to them
    lines = quoting.select("key", "conv_id", "turn", F.posexplode(parsed(F.col("text"))).alias("pos", "x")).select("key", "conv_id", "turn", "pos", "x.*")
    by_pos = Window.partitionBy("key").orderBy("pos")
    lines = lines.withColumn("change", (F.lag("level", 1, -1).over(by_pos) != F.col("level")).cast("int")).withColumn("run", F.sum("change").over(by_pos))
    runs = (lines.filter("level > 0").groupBy("key", "conv_id", "turn", "run", "level")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("passage")))
    passages = (runs.select("key", "conv_id", "turn", "level", F.explode(F.split("passage", BLANK, -1)).alias("passage"))
                .withColumn("hash", normal_hash(F.col("passage"))).filter("hash is not null")
                .withColumn("lines", F.when(F.col("passage").contains("\n"), line_hashes(F.col("passage")))).drop("passage"))
    passages = staged(passages, "passages")
    wanted = passages.select("conv_id", "hash").distinct()
    own = F.col("body")
    units = F.array_distinct(F.concat(F.array(own), F.split(own, BLANK, -1), F.split(own, "\n", -1)))
    originals = (messages.filter("conv_id is not null and turn is not null and body is not null")
                 .join(small_side(wanted.select("conv_id").distinct(), 24), "conv_id", "left_semi")
                 .select("conv_id", "turn", F.explode(units).alias("unit")).select("conv_id", "turn", normal_hash(F.col("unit")).alias("hash")))
    first = originals.join(small_side(wanted, 64), ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("source_turn"))
    found = passages.join(first, ["conv_id", "hash"], "left").withColumn("linked", F.coalesce(F.col("source_turn") < F.col("turn"), F.lit(False)))
    found = staged(found.withColumn("part", F.when(~F.col("linked"), F.md5(F.array_join("lines", " ")))), "found")
    parts = found.filter("part is not null").groupBy("conv_id", "part").agg(F.first("lines").alias("lines"))
    if found.filter("part is not null").limit(1).count():
        found = found.join(small_side(staged(holders(parts, messages), "holders"), 64), ["conv_id", "part"], "left")
        found = (found.withColumn("source_turn", F.when(F.col("linked"), F.col("source_turn")).otherwise(F.col("held_turn")))
                 .withColumn("linked", F.coalesce(F.col("source_turn") < F.col("turn"), F.lit(False))))
    per = found.groupBy("key", "conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.sum(F.col("linked").cast("bigint")).alias("n_linked"), F.max("level").cast("bigint").alias("max_level"),
        F.max(F.when(F.col("linked"), F.struct(-F.col("level"), F.col("source_turn").alias("t")))).alias("r"))
    return staged(per.select("key", "conv_id", "turn", "n_quotes", "n_linked", "max_level", F.col("r.t").alias("reply_to")), "links")


def threads(found: DataFrame) -> DataFrame:
    """First turn of the thread of every replying turn (conv_id, turn, thread_turn), by pointer doubling."""
    up = found.filter("reply_to is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up"))
    up = staged(up, "up")
    while True:
        further = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"))
        step = staged(up.join(further, ["conv_id", "up"], "left")
                      .select("conv_id", "turn", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "up")
        up = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            return up.withColumnRenamed("up", "thread_turn")


def reply_order(messages: DataFrame) -> DataFrame:
    """Per distinct message (key): reply_to, thread_turn, position and quote counts.  ``messages``: key, conv_id, turn, text, body."""
    found = links(messages)
    slim = messages.filter("conv_id is not null and turn is not null").groupBy("key", "conv_id", "turn").agg(F.lit(1).cast("bigint").alias("one"))
    slim = (slim.join(small_side(found.drop("conv_id", "turn"), 64), "key", "left")
            .join(small_side(threads(found), 32), ["conv_id", "turn"], "left").withColumn("thread_turn", F.coalesce("thread_turn", "turn")))
    slim = staged(slim, "replies")
    per = slim.groupBy("conv_id", "thread_turn").agg(F.count("*").alias("n"))
    before = running_sum(per, ["conv_id"], "thread_turn", "n", "upto").select("conv_id", "thread_turn", (F.col("upto") - F.col("n")).alias("before"), "n")
    # threads of one message need no order of their own
    alone = before.filter("n = 1").select("conv_id", "thread_turn", (F.col("before") + 1).alias("position"))
    many = running_sum(slim.join(before.filter("n > 1"), ["conv_id", "thread_turn"]), ["conv_id", "thread_turn"], "turn", "one", "within")
    cols = ["key", "reply_to", "thread_turn", "position", "n_quotes", "n_linked", "max_level"]
    return slim.join(alone, ["conv_id", "thread_turn"]).select(cols).unionByName(
        many.withColumn("position", F.col("before") + F.col("within")).select(cols))


def prepared(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, key, body."""
    return (conversations.select("conv_id", "turn", "role", "text").withColumn("key", message_key())
            .withColumn("body", body(F.col("text"))))


def formatted() -> F.Column:
    """A message in the chat layout."""
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("body", F.lit("")), F.lit("\n<|end|>\n"))


def chat(conversations: DataFrame) -> DataFrame:
    """Every message without quotes, in the chat layout, with its place in the reply order of its conversation."""
    rows = prepared(conversations)
    return (rows.withColumn("chat", formatted()).drop("text").join(reply_order(rows), "key", "left").drop("key")
            .withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_quotes", "n_linked", "max_level")}))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(table(spark, sf_dir, "conversations"))
    digest = rows.select("key", "conv_id", "turn", "role", F.length("body").cast("bigint").alias("body_chars"), F.sha2(formatted().cast("binary"), 256).alias("chat_sha256"))
    return (digest.join(reply_order(rows), "key", "left").drop("key")
            .withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_quotes", "n_linked", "max_level")}))
