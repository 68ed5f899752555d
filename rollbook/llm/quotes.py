"""Quotation linking: which earlier message a message quotes, and conversations in reply order without quotes.

Only DataFrame functions are used. A message's lines keep their level of quotation (leading > signs). A passage is a run of
lines of one level without blank ones between; its lines are joined, so that where they are broken makes no difference,
normalised and hashed. Quoted passages meet those that other messages of the same conversation wrote themselves, by
conversation and hash, so that one very long conversation is dealt over all tasks. Of passages that nobody wrote as
they are (a part of one, say), the single lines of some words are looked for in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import dropped, written

MARK = r"^([ \t]*>)+"
#: Turns whose writers of a passage are bits of one number.
SPAN = 60
BLANK = "\x20\x09-\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Stand before a passage, behind its level, and between its lines.
PASSAGE, LEVEL, LINE = "\x01", "\x02", "\x03"


def with_lines(text: str) -> F.Column:
    """The lines of a text: level, and rest behind the marks; null for a null text."""
    mark = lambda x: F.regexp_extract(x, MARK, 0)
    return F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"), F.substr(x, F.length(mark(x)) + 1).alias("rest")))


def normal(c: F.Column) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(c, f"[{BLANK}{LINE}]+", " ")))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, level, hash, n, body): each passage of each message (conv_id, turn, copy, lines), its number of
    lines, and the lines with a mark between. copy tells rows with the same conv_id and turn apart."""
    blank = lambda x: F.trim(x["rest"], F.lit(BLANK_CHARS)) == ""
    before = lambda i: F.get("lines", i - 1)
    starts = lambda x, i: (i == 0) | (before(i)["level"] != x["level"]) | blank(x) | blank(before(i))
    content = lambda x: F.translate(x["rest"], PASSAGE + LEVEL + LINE, "   ")
    marked = F.transform("lines", lambda x, i: F.concat(F.when(starts(x, i), F.concat(F.lit(PASSAGE), x["level"].cast("string"), F.lit(LEVEL))).otherwise(LINE), content(x)))
    each = messages.select("conv_id", "turn", "copy", F.explode(F.split(F.array_join(marked, ""), PASSAGE)).alias("part")).where("part <> ''")
    level = F.substring_index("part", LEVEL, 1)
    each = each.select("conv_id", "turn", "copy", level.cast("int").alias("level"), F.substr("part", F.length(level) + 2).alias("body"))
    each = each.where(F.trim("body", F.lit(BLANK_CHARS)) != "")
    lines = F.length("body") - F.length(F.replace("body", F.lit(LINE), F.lit(""))) + 1
    return each.select("conv_id", "turn", "copy", "level", F.md5(normal(F.col("body"))).alias("hash"), lines.cast("long").alias("n"), "body")


def single_lines(found: DataFrame, least_words: int) -> DataFrame:
    """The lines of passages, with the columns of these but hash, n and body, and a hash of each line of least_words or more."""
    keep = [c for c in found.columns if c not in ("hash", "n", "body")]
    text = found.select(*keep, F.explode(F.split("body", LINE)).alias("line")).withColumn("line", normal(F.col("line")))
    return text.where(F.size(F.split("line", " ")) >= least_words).select(*keep, F.md5("line").alias("hash"))


def with_writer(asked: DataFrame, source: DataFrame) -> DataFrame:
    """asked (conv_id, turn, hash, ...) with the latest earlier writer of each hash; source: conv_id, writer, hash, each once.

    Turns are dealt with in spans: bits say which turns of a span wrote the passage, and each span knows the latest writer
    before it. So a passage in every message of a hot conversation is one row for every SPAN of them.
    """
    base = lambda turn: F.floor(F.col(turn) / SPAN)
    bit = lambda turn: F.expr(f"shiftleft(1L, cast({turn} - floor({turn} / {SPAN}) * {SPAN} as int))")
    written_in = source.groupBy("conv_id", "hash", base("writer").alias("span")).agg(F.bit_or(bit("writer")).alias("bits"), F.max("writer").alias("last"))
    ahead = Window.partitionBy("conv_id", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    asking = asked.where("turn is not null").withColumn("span", base("turn"))
    needed = written_in.select("conv_id", "hash", "span").union(asking.select("conv_id", "hash", "span")).distinct()
    spans = needed.join(written_in, ["conv_id", "hash", "span"], "left").withColumn("earlier", F.max("last").over(ahead)).select("conv_id", "hash", "span", "bits", "earlier")
    found = asking.join(spans, ["conv_id", "hash", "span"]).withColumn("below", F.coalesce(F.col("bits").bitwiseAND(bit("turn") - 1), F.lit(0)))
    here = F.col("span") * SPAN + F.length(F.bin("below")) - 1
    return found.withColumn("writer", F.when(F.col("below") > 0, here).otherwise(F.col("earlier"))).where("writer is not null").select(*asked.columns, "writer")


def linked(messages: DataFrame, least_words: int = 4) -> DataFrame:
    """One row for each message, without quotes, in reply order.

    conv_id, turn, role, text: the lines of level 0, without blank lines before them and blanks after them (null text stays
    null); n_quoted_lines: non-empty lines of a level over 0; n_linked_lines: those in passages that an earlier message of
    the conversation wrote itself, at level 0, or else that are such lines of least_words words or more; reply_to: of the
    earlier messages that wrote what is quoted at the lowest level found, the turn with most lines of it, the latest of
    equals; depth: replies above it, as far as reply_to leads; root: the turn at the end of that chain. In the order of
    conv_id, root, turn the rows are the conversation's threads.

    A quoted passage or line counts for the latest earlier turn that wrote it. A message quotes no later one and not itself.
    Null conv_id or turn: the row stays and links with nothing. Repeated rows are messages of their own with the same
    links. Empty texts have nothing to quote. An empty table gives an empty table. Other columns are not looked at.
    """
    own = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    own = own.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("text")))
    own = written(own.select("conv_id", "turn", "role", "copy", with_lines("text").alias("lines")), "messages")
    every = written(passages(own).where("conv_id is not null and turn is not null"), "passages")
    wrote, asked = every.where("level = 0").select("conv_id", F.col("turn").alias("writer"), "hash", "body"), every.where("level > 0")
    key = ["conv_id", "turn", "copy", "level", "hash"]
    whole = with_writer(asked.groupBy(*key).agg(F.sum("n").alias("n")), wrote.select("conv_id", "writer", "hash").distinct())
    whole = written(whole, "links")
    rest = written(asked.join(whole.select(*key), key, "left_anti"), "links")
    one = single_lines(rest.drop("hash", "n"), least_words).groupBy(*key).agg(F.count("*").alias("n"))
    lines = single_lines(wrote.join(rest.select("conv_id").distinct(), "conv_id", "left_semi").drop("hash"), least_words).distinct()
    votes = whole.unionByName(with_writer(one, lines)).groupBy("conv_id", "turn", "copy", "level", "writer").agg(F.sum("n").alias("votes"))
    best = votes.groupBy("conv_id", "turn", "copy").agg(F.max_by("writer", F.struct(-F.col("level"), F.col("votes"), F.col("writer"))).alias("reply_to"), F.sum("votes").alias("n_linked_lines"))
    kept = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["rest"]), "\n")
    kept = F.regexp_replace(F.rtrim(kept, F.lit(BLANK_CHARS)), rf"^[{BLANK}]*\n", "")
    count = F.size(F.filter("lines", lambda x: (x["level"] > 0) & (F.trim(x["rest"], F.lit(BLANK_CHARS)) != "")))
    out = own.select("conv_id", "turn", "role", "copy", kept.alias("text"), F.coalesce(F.when(F.col("lines").isNotNull(), count), F.lit(0)).cast("long").alias("n_quoted_lines"))
    out = out.join(best, ["conv_id", "turn", "copy"], "left").withColumn("n_linked_lines", F.coalesce("n_linked_lines", F.lit(0)).cast("long"))
    tree = chains(best.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("reply_to")))
    out = out.drop("reply_to").join(tree, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "n_quoted_lines", "n_linked_lines", "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("root", "turn").alias("root"))


def chains(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, depth, root) of messages that reply: how long the chain above each is, and where it ends.

    Every step doubles how far all messages see up the chain, so the longest chain of n replies takes log2(n) steps.
    """
    state = written(replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        new = written(state.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", "reply_to", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "chains")
        dropped(state)
        moved = new.where("moved").limit(1).count()
        state = new
        if not moved:
            return state.drop("moved")
        path = new.written_at
        state = new.drop("moved")
        state.written_at = path
