"""Quotation linking: conversations in reply order, without their quotes. DataFrame functions only.

A line that starts with one or more ``>`` is quoted at that level. Consecutive quoted lines of one level are a passage.
A trimmed or inline quote holds only parts of its original, so a passage also stands for its paragraphs (between blank lines), its
lines and its sentences, whose lines may be wrapped anew. A message owns its own text, the runs of own lines between its quotes, and
the paragraphs, lines and sentences of both. All these pieces are normalised (lower case, single spaces) and hashed; a
piece belongs to the earliest message that has it as its own, in the same conversation before the quoting turn
or else in an earlier conversation (smaller conv_id); in each, text, runs and paragraphs go before lines and sentences. A message's parent comes from the shallowest level with a linked piece; there
from the coarsest pieces that are linked (passage, paragraph, line, sentence), of these from the first passage, and
in it the message with most characters. Roots and depths follow by pointer doubling over the links.

Links are found by grouped minima and joins with one match for each piece, so a piece that very many messages have or quote
makes no pairs. Only messages with quotes have quoted lines cut, and a window there holds one message.

Null or empty texts own nothing and quote nothing. A message without a linked quote is its own root. Rows
with a null conversation or turn are neither parents nor linked. Repeated rows give repeated results. One row for each message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.llm.store import measured, removed, salted_join, written

QUOTED = r"(?m)^[ \t]*>"
QUOTED_LINES = r"(?m)^(?:[^\n>]*\bwrote:[ \t]*\r?\n(?=[ \t]*>))|^[ \t]*>[^\n]*(?:\n|\z)"
PREFIX = r"^[ \t]*((?:>[ \t]?)+)"
PARAGRAPHS = r"\n\s*\n"
SENTENCES = r"(?<=[.!?…][\"'”’)\]]{0,2})\s+|(?<=[。！？])\s*"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def mark(text: Column) -> Column:
    """Hash of a normalised passage, null where nothing is left of it."""
    plain = normalised(text)
    return F.when(plain != "", F.md5(plain))


def own_text(text: Column) -> Column:
    """The text without quoted lines and without the line that announces a quote."""
    return F.when(text.rlike(QUOTED), F.trim(F.regexp_replace(text, QUOTED_LINES, ""))).otherwise(text)


def _parts(text: Column) -> tuple[Column, Column, Column]:
    """The paragraphs, the lines and the sentences of a text."""
    paragraphs = F.split(text, PARAGRAPHS)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), SENTENCES)))
    return paragraphs, F.split(text, r"\n"), sentences


def passages(messages: DataFrame) -> DataFrame:
    """mid, conv_id, turn, level, at (first line) and body of each quoted passage in which anything is quoted."""
    lines = messages.filter(F.col("text").rlike(QUOTED)).select("mid", "conv_id", "turn", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", PREFIX, 1), "[^>]", ""))
    lines = lines.select("mid", "conv_id", "turn", "at", level.alias("level"), F.regexp_replace("line", PREFIX, "").alias("body"))
    order = Window.partitionBy("mid").orderBy("at")
    fresh = F.coalesce((F.lag("level").over(order) != F.col("level")).cast("int"), F.lit(1))
    runs = lines.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order)).filter("level > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("at", "body"))), lambda x: x["body"]), "\n")
    found = runs.groupBy("mid", "conv_id", "turn", "run", "level").agg(F.min("at").alias("at"), joined.alias("body"))
    return found.select("mid", "conv_id", "turn", "level", "at", "body").filter(normalised(F.col("body")) != "")


def pieces(passages: DataFrame) -> DataFrame:
    """Each passage (grain 0), its paragraphs (1), lines (2) and sentences (3), with mark, n_chars and pos among those of its grain."""
    grains = [F.array("body"), *(F.when(F.size(p) > 1, p).otherwise(F.array().cast("array<string>")) for p in _parts(F.col("body")))]
    piece = lambda n: lambda p, i: F.struct(F.lit(n).alias("grain"), i.alias("pos"), F.length(normalised(p)).alias("n_chars"), mark(p).alias("mark"))
    every = F.concat(*(F.transform(g, piece(n)) for n, g in enumerate(grains)))
    return passages.select("mid", "conv_id", "turn", "level", "at", F.inline(every)).filter("mark IS NOT NULL")


def owned(messages: DataFrame) -> DataFrame:
    """mark, large, conv_id, turn, mid: large for each message's own text, its runs of own lines and the paragraphs of both, else for its
    other lines and sentences."""
    runs = F.when(F.col("text").rlike(QUOTED), F.split("text", QUOTED_LINES)).otherwise(F.array("text"))
    parts = lambda *which: F.flatten(F.transform(runs, lambda r: F.concat(*(_parts(r)[k] for k in which))))
    marks = lambda texts: F.array_distinct(F.transform(texts, mark))
    large = marks(F.concat(F.array("own"), F.split("own", PARAGRAPHS), runs, parts(0)))
    with_size = lambda array, size: F.transform(array, lambda m: F.struct(m.alias("mark"), F.lit(size).alias("large")))
    rows = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND own IS NOT NULL").select("conv_id", "turn", "mid", large.alias("large"), marks(parts(1, 2)).alias("small"))
    rows = rows.select("conv_id", "turn", "mid", F.inline(F.concat(with_size(F.col("large"), True), with_size(F.array_except("small", "large"), False))))
    return rows.filter("mark IS NOT NULL")


def parents(messages: DataFrame) -> DataFrame:
    """(child, parent) over message ids: at most one parent for each quoting message."""
    quoted, _ = written(pieces(passages(messages).filter("conv_id IS NOT NULL AND turn IS NOT NULL").dropDuplicates(["mid", "at"])), "passages")
    units = owned(messages).join(measured(quoted.select("mark").distinct(), "mark"), "mark", "left_semi")
    units, _ = written(units, "units")
    first = lambda *of: (F.min(F.when(F.col("large"), F.struct(*of))).alias("large"), F.min(F.struct(*of)).alias("any"))
    here = units.groupBy("conv_id", "mark").agg(*first("turn", "mid")).select("conv_id", "mark", F.struct("large", "any").alias("here"))
    there = units.groupBy("mark").agg(*first("conv_id", "turn", "mid")).select("mark", F.struct("large", "any").alias("there"))
    # a mark may be in a share of all passages
    joined = salted_join(salted_join(quoted, here, ["conv_id", "mark"], "mark", how="left"), there, ["mark"], "mark", how="left")
    target = F.coalesce(
        *(F.when(F.col(f"here.{s}.turn") < F.col("turn"), F.col(f"here.{s}.mid")) for s in ("large", "any")),
        *(F.when(F.col(f"there.{s}.conv_id") < F.col("conv_id"), F.col(f"there.{s}.mid")) for s in ("large", "any")),
    )
    linked = joined.select("mid", "level", "grain", "at", "pos", "n_chars", target.alias("parent")).filter("parent IS NOT NULL AND parent <> mid")
    linked = linked.groupBy("mid", "level", "grain", "at", "parent").agg((-F.sum("n_chars")).alias("fewer"), F.min("pos").alias("pos"))
    return linked.groupBy("mid").agg(F.min(F.struct("level", "grain", "at", "fewer", "pos", "parent")).alias("p")).select(F.col("mid").alias("child"), F.col("p.parent").alias("parent"))


def rooted(links: DataFrame) -> DataFrame:
    """child, parent, root and depth for each child; parents are always earlier, so chains end."""
    spark = links.sparkSession
    state, path = written(links.select("child", "parent", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth")), "roots")
    while True:
        up = state.select(F.col("child").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        stepped = salted_join(state, up, ["root"], "root", "next", how="left").select("child", "parent", F.coalesce("next", "root").alias("root"), F.expr("depth + coalesce(more, 0)").alias("depth"), F.col("next").isNotNull().alias("moved"))
        fresh, after = written(stepped, "roots")
        moved = bool(fresh.filter("moved").take(1))
        removed(spark, path)
        state, path = fresh.drop("moved"), after
        if not moved:
            return state


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own text, parent and thread of each message.

    thread_conv and thread_turn name the root message; ordering by them and then by conv_id and turn puts every message after the one it replies to
    (a sort that splits a very long conversation over tasks). ``formatted`` is the message with its role mark.
    """
    blank, gap = F.lit("\x00"), "\x01"
    mid = F.md5(F.concat_ws(gap, F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank), F.coalesce("role", blank), F.coalesce("text", blank)))
    rows = messages.select("conv_id", "turn", "role", "text", own_text(F.col("text")).alias("own"), mid.alias("mid"))
    links = rooted(parents(rows))
    tree, _ = written(links, "tree")
    ends = tree.select(F.col("parent").alias("id")).union(tree.select(F.col("root").alias("id"))).distinct()
    place = rows.join(measured(ends, "id"), F.col("mid") == F.col("id"), "left_semi").select("mid", F.struct("conv_id", "turn").alias("at")).dropDuplicates(["mid"])
    place, _ = written(place, "places")
    tree = tree.join(place.select(F.col("mid").alias("parent"), F.col("at").alias("parent_at")), "parent").join(place.select(F.col("mid").alias("root"), F.col("at").alias("root_at")), "root")
    counted = passages(rows).groupBy("mid", "at").agg(F.lit(1).alias("one")).groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    extra = counted.select("mid", "n").join(tree.select(F.col("child").alias("mid"), "parent_at", "root_at", "depth"), "mid", "left").withColumnRenamed("mid", "_mid")
    extra, _ = written(extra, "replies")
    joined = rows.join(measured(extra, "_mid"), F.col("mid") == F.col("_mid"), "left")
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("own", F.lit("")), F.lit("\n"))
    return joined.select(
        "conv_id", "turn", "role", F.coalesce("own", F.lit("")).alias("own_text"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_quotes"), F.col("parent_at.conv_id").alias("parent_conv"), F.col("parent_at.turn").alias("parent_turn"),
        F.coalesce(F.col("root_at.conv_id"), "conv_id").alias("thread_conv"), F.coalesce(F.col("root_at.turn"), "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"), formatted.alias("formatted"),
    )
