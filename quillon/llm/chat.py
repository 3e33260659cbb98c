"""Chat formatting with quotation linking (DataFrame functions only).

Messages are written once; lines are only exploded for messages that have a quote mark. Quoted runs
and lines are hashed, and joined to the texts, runs and lines of the messages of the same conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm._text import stored

#: turns in one window bucket, messages in one conversation segment
BUCKET, SEGMENT = 4096, 256
_MARKS = r"^[ \t]*(?:>[ \t]?)+"
MESSAGE = ["conv_id", "turn", "mid"]


def normalised(text: str) -> str:
    """SQL: lower case, white space runs as one space, trimmed."""
    return f"trim(regexp_replace(lower({text}), '[ \\t\\r\\n]+', ' '))"


def _hash(text: str) -> str:
    return f"xxhash64({normalised(text)})"


def messages(conversations: DataFrame) -> DataFrame:
    """One row a distinct message: conv_id, turn, mid, role, text, quoted. Null texts and roles are empty."""
    m = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    return stored(m.withColumn("mid", F.xxhash64("role", "text")).withColumn("quoted", F.col("text").rlike(r"(?m)^[ \t]*>")))


def quoted_lines(m: DataFrame) -> DataFrame:
    """(conv_id, turn, mid, pos, raw, level, line, run) of the messages with quotes: nested quote levels, and runs of lines of one level."""
    q = m.where("quoted").select(*MESSAGE, F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    q = q.select(*MESSAGE, "pos", "raw", F.expr(f"length(regexp_replace(regexp_extract(raw, r'{_MARKS}', 0), '[^>]', ''))").alias("level"), F.regexp_replace("raw", _MARKS, "").alias("line"))
    w = Window.partitionBy(*MESSAGE).orderBy("pos")  # the lines of one message
    q = q.withColumn("new", F.coalesce(F.col("level") != F.lag("level").over(w), F.lit(True)).cast("int"))
    return stored(q.withColumn("run", F.sum("new").over(w)).drop("new"))


def _in_order(column: str) -> Column:
    return F.expr(f"array_join(transform(array_sort(collect_list(struct(pos, {column}))), x -> x.{column}), ' ')")


def linked(conversations: DataFrame, min_words: int = 3) -> DataFrame:
    """Messages with ``reply_to``, the turn they answer: from their quotes or else the turn before.

    A quoted passage of any level is matched whole (against whole texts, unquoted runs and single
    lines) and line by line. A line of fewer than ``min_words`` words makes no link. The
    original of a passage is the earliest turn of the conversation that has it, before the quoting
    turn. Of a message's matches the least nested come first, then whole passages, then the latest
    original; ``links`` holds all of them. Quotes that are linked are taken out of the text: passages that match whole, lines that
    match, and blank and short matched lines of a passage with a link. What no earlier message has, as a prompt or a quote from
    elsewhere, stays as it stands. ``position`` is the place in reply order: by the turn answered, then
    by turn, so that a message follows the one it answers and answers to one message stand together.
    Null texts are empty, identical rows count once; null turns and conversations link to nothing and come first.
    """
    m = messages(conversations)
    lines = quoted_lines(m)
    words = f"size(split({normalised('line')}, ' '))"
    quotes = lines.where("level > 0")
    runs = quotes.groupBy(*MESSAGE, "run").agg(F.min("level").alias("level"), _in_order("line").alias("line"))
    probes = runs.select(*MESSAGE, "run", F.lit(-1).alias("pos"), "level", F.lit(0).alias("part"), F.expr(_hash("line")).alias("h")).where("h <> xxhash64('')")
    each = quotes.where(f"{normalised('line')} <> ''").select(*MESSAGE, "run", "pos", "level", F.expr(f"if({words} >= {min_words}, 1, 2)").alias("part"), F.expr(_hash("line")).alias("h"))
    probes = probes.unionByName(each)
    # only conversations with quotes need their originals indexed
    asked = lines.select(F.col("conv_id").alias("c")).distinct()
    plain = m.where("NOT quoted").join(asked, F.col("conv_id") == F.col("c"), "left_semi")
    plain = plain.select("conv_id", "turn", F.expr(f"explode(array_distinct(concat(array({_hash('text')}), transform(filter(split(text, '\\n', -1), x -> trim(x) <> ''), x -> {_hash('x')}))))").alias("h"))
    own = lines.where("level = 0")
    whole = own.groupBy(*MESSAGE).agg(_in_order("line").alias("line"))
    parts = own.groupBy(*MESSAGE, "run").agg(_in_order("line").alias("line"))
    own = [x.where(f"{normalised('line')} <> ''").select("conv_id", "turn", F.expr(_hash("line")).alias("h")) for x in (own, whole, parts)]
    own = plain.unionByName(own[0]).unionByName(own[1]).unionByName(own[2])
    own = own.groupBy("conv_id", "h").agg(F.min("turn").alias("original")).select(F.col("conv_id").alias("oc"), F.col("h").alias("oh"), "original")
    hits = probes.join(own, (F.col("conv_id") == F.col("oc")) & (F.col("h") == F.col("oh")) & (F.col("original") < F.col("turn")))
    hits = stored(hits.select(*MESSAGE, "run", "pos", "level", "part", "original"))
    links = hits.where("part < 2").groupBy(*MESSAGE).agg(F.array_sort(F.collect_set(F.struct("level", "part", (-F.col("original")).alias("late")))).alias("links"))
    bodies = lines.join(hits.groupBy(*MESSAGE, "run").agg(F.max(F.col("part") < 2).alias("hit"), F.max(F.col("part") == 0).alias("all")), [*MESSAGE, "run"], "left")
    bodies = bodies.join(hits.where("pos >= 0").select(*MESSAGE, "pos", F.lit(True).alias("found")).distinct(), [*MESSAGE, "pos"], "left")
    gone = F.coalesce(F.col("hit") & (F.col("all") | F.coalesce("found", F.lit(False)) | (F.expr(normalised("line")) == "")), F.lit(False))
    left = F.expr("array_join(transform(array_sort(collect_list(if(gone, NULL, struct(pos, raw)))), x -> x.raw), '\n')")
    bodies = bodies.withColumn("gone", gone).groupBy(*MESSAGE).agg(F.max("gone").alias("cut"), left.alias("left"), F.count_distinct(F.when(F.col("level") > 0, F.col("run"))).alias("n_quotes"))
    bodies = bodies.select(*MESSAGE, "cut", F.expr("trim(BOTH '\n' FROM left)").alias("left"), "n_quotes")
    before = previous_turns(m)
    j = m.join(before, (F.col("conv_id") == F.col("pc")) & (F.col("turn") == F.col("pt")), "left")
    j = j.join(bodies, MESSAGE, "left").join(links, MESSAGE, "left")
    reply = F.coalesce(-F.try_element_at("links", F.lit(1))["late"], F.col("previous"))
    text = F.when(F.col("cut"), F.col("left")).otherwise(F.col("text"))
    at = F.coalesce(F.expr("array_distinct(transform(links, l -> -l.late))"), F.array().cast("array<bigint>"))
    j = stored(j.select("conv_id", "turn", "role", text.alias("text"), reply.alias("reply_to"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), at.alias("links")))
    place = reply_order(j.select("conv_id", "reply_to", "turn").distinct())
    same = F.col("conv_id").eqNullSafe(F.col("rc")) & F.col("reply_to").eqNullSafe(F.col("rr")) & F.col("turn").eqNullSafe(F.col("rt"))
    return j.join(place, same).select("conv_id", "turn", "position", "role", "text", "reply_to", "n_quotes", "links")


def previous_turns(m: DataFrame) -> DataFrame:
    """(pc, pt, previous) of each distinct turn of each conversation, by windows over bounded buckets of turns."""
    t = m.where("turn IS NOT NULL AND conv_id IS NOT NULL").select("conv_id", "turn").distinct().withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    b = t.groupBy("conv_id", "bucket").agg(F.max("turn").alias("last"))
    b = b.select(F.col("conv_id").alias("bc"), F.col("bucket").alias("bb"), F.lag("last").over(Window.partitionBy("conv_id").orderBy("bucket")).alias("carried"))
    t = t.withColumn("near", F.lag("turn").over(Window.partitionBy("conv_id", "bucket").orderBy("turn")))
    j = t.join(b, (F.col("conv_id") == F.col("bc")) & (F.col("bucket") == F.col("bb")))
    return j.select(F.col("conv_id").alias("pc"), F.col("turn").alias("pt"), F.coalesce("near", "carried").alias("previous"))


def counted_before(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The rows (distinct in ``by`` and ``order``, with a number n) and ``before``, the sum of n over smaller values of ``order``; nulls come first.

    Windows run over the values of one bucket, and over the buckets of one key.
    """
    t = rows.withColumn("bucket", F.floor(F.col(order) / BUCKET))
    b = t.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    so_far = lambda keys, c: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in (*by, "bucket")), so_far(by, "bucket").alias("skipped"))
    t = t.withColumn("inner", so_far([*by, "bucket"], order))
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in (*by, "bucket")]
    return t.join(b, same).select(*rows.columns, (F.col("skipped") + F.col("inner")).alias("before"))


def reply_order(turns: DataFrame) -> DataFrame:
    """(rc, rr, rt, position) of distinct (conv_id, reply_to, turn): ordered by the turn answered, then by turn.

    An answer is later than what it answers, so what a message answers, which answers something
    earlier still, stands before it.
    """
    groups = turns.groupBy("conv_id", "reply_to").agg(F.count("*").alias("n"))
    groups = counted_before(groups, ["conv_id"], "reply_to").select(F.col("conv_id").alias("gc"), F.col("reply_to").alias("gr"), F.col("before").alias("skip"))
    inner = counted_before(turns.withColumn("n", F.lit(1)), ["conv_id", "reply_to"], "turn")
    j = inner.join(groups, F.col("conv_id").eqNullSafe(F.col("gc")) & F.col("reply_to").eqNullSafe(F.col("gr")))
    return j.select(F.col("conv_id").alias("rc"), F.col("reply_to").alias("rr"), F.col("turn").alias("rt"), (F.col("skip") + F.col("before")).alias("position"))


def chat_format(conversations: DataFrame, min_words: int = 3, segment: int = SEGMENT) -> DataFrame:
    """Reply-ordered conversations without linked quotes: conv_id, segment, n_messages, n_linked, messages.

    A message follows the turn it answers. A conversation is given in segments of at most
    ``segment`` turns, so that one of any length is never gathered in one task; texts of any length
    are kept whole. Identical rows count once; different messages of one turn and answer are ordered by role and text;
    null texts are empty, a null turn or conv_id answers nothing. An empty table gives no rows. Only
    conv_id, turn, role and text are read, whatever other columns there are.
    """
    m = linked(conversations, min_words).withColumn("segment", F.floor(F.col("position") / segment).cast("long"))
    row = F.struct(F.col("position").cast("long").alias("position"), "turn", "role", "text", "reply_to", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")).alias("formatted"))
    out = m.groupBy("conv_id", "segment").agg(F.count("*").alias("n_messages"), F.sum((F.size("links") > 0).cast("long")).alias("n_linked"), F.array_sort(F.collect_list(row)).alias("messages"))
    return out.select("conv_id", "segment", "n_messages", "n_linked", "messages")
