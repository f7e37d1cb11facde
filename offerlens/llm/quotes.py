"""Quotation linking: quote levels, links to the quoted messages, conversations in reply order.

A line's level is the number of leading ``>``.  Lines, passages (lines of one level joined) and their
sentences are normalised (white space, case) and hashed; each quoted one of level k meets, inside its
conversation, the earliest message that has it at level k - 1, or as its own text, so a phrase that
everybody repeats leads to one message and never to all pairs.  A message replies to the earlier message
that most of its quoted words come from; first-level quotes decide before deeper ones, and quotes of
under three words only where nothing longer leads anywhere.  Parents precede their replies, so turns
order a conversation; depth and root follow by pointer doubling over linked messages only.

All steps are column functions, aggregations with partial sums, and equality joins.

Defined results: a null text has no lines and stays null; a text of quotes only becomes empty; rows
with the same conversation and turn are one message for linking and keep their own texts; rows with a
null conversation or turn are never linked; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.session import materialize

MARKERS = r"^(?:[ \t]*>)+[ \t]?"
#: Lines that only introduce a quotation.
INTRODUCTION = r"(?i)^[ \t]*(?:on|am|le|el)\b.{0,200}(?:wrote|schrieb|écrit|escribió)\s*:\s*$"


def level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, MARKERS, 0), "[^>]", ""))


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKERS, ""), r"\s+", " ")))


def own_text(text: Column) -> Column:
    """Lines of level zero without introductions that stand before a quotation, trimmed."""
    lines = F.split(text, "\n")
    quoted = lambda i: F.coalesce(F.get(lines, i).rlike(MARKERS), F.lit(False))
    kept = F.filter(lines, lambda x, i: ~x.rlike(MARKERS) & ~(x.rlike(INTRODUCTION) & quoted(i + 1)))
    clean = F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")
    return F.when(text.contains(">"), clean).otherwise(text)


def units(text: Column) -> Column:
    """Distinct ``(level, body)`` of a text: its lines, its passages and the sentences of those, all normalised.

    A passage is a stretch of lines of one level without an empty line, joined by blanks, so it stays the
    same however a quotation was wrapped again.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(level(x).cast("int").alias("level"), normal(x).alias("body")))

    def joined(all_lines: Column) -> Column:
        before = lambda i: F.get(all_lines, i - 1)
        goes_on = lambda x, i: (i > 0) & (before(i)["level"] == x["level"]) & (before(i)["body"] != "") & (x["body"] != "")
        piece = lambda x, i: F.when(goes_on(x, i), F.concat(F.lit(" "), x["body"])).otherwise(F.concat(F.lit("\n"), x["level"].cast("string"), F.lit("\t"), x["body"]))
        told = F.filter(F.split(F.array_join(F.transform(all_lines, piece), ""), "\n"), lambda p: p != "")
        passage = lambda p: F.struct(F.substring_index(p, "\t", 1).cast("int").alias("level"), F.substring_index(p, "\t", -1).alias("body"))
        passages = F.transform(told, passage)
        sentences = F.flatten(F.transform(passages, lambda p: F.transform(F.split(p["body"], "(?<=[.!?]) "), lambda b: F.struct(p["level"].alias("level"), b.alias("body")))))
        return F.array_distinct(F.filter(F.concat(all_lines, passages, sentences), lambda u: u["body"] != ""))

    return F.get(F.transform(F.array(lines), joined), 0)


def link(messages: DataFrame, least_words: int = 3) -> DataFrame:
    """Per message with a parent: conv_id, turn, parent_turn, n_linked (quoted lines, sentences and passages that lead there).

    A unit of level k meets the earliest message of its conversation that has it at level k - 1, and,
    for k > 1, the earliest that has it as its own.  First-level units decide before deeper ones, those
    before deeper ones found in an original, and units under ``least_words`` only where no longer one
    leads anywhere.  Then most words win, then the earliest message.
    """
    placed = messages.filter("conv_id is not null and turn is not null and text is not null")
    rows = placed.select("conv_id", "turn", F.explode(units(F.col("text"))).alias("u"))
    body = F.col("u.body")
    rows = rows.select("conv_id", "turn", F.col("u.level").alias("level"), F.md5(body.cast("binary")).alias("h"), F.size(F.split(body, " ")).alias("words"))
    first = rows.groupBy("conv_id", F.col("level").alias("at"), "h").agg(F.min("turn").alias("parent_turn"))
    quoted = rows.filter("level > 0").withColumn("at", F.explode(F.array_distinct(F.array(F.col("level") - 1, F.lit(0)))))
    rank = F.when(F.col("level") == 1, 0).when(F.col("at") == F.col("level") - 1, 1).otherwise(2) + F.when(F.col("words") < least_words, 3).otherwise(0)
    met = quoted.withColumn("rank", rank).join(first, ["conv_id", "at", "h"]).filter("parent_turn < turn")
    votes = met.groupBy("conv_id", "turn", "rank", "parent_turn").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    best = F.max_by(F.struct("parent_turn", "n"), F.struct(-F.col("rank"), "words", -F.col("parent_turn")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.parent_turn").alias("parent_turn"), F.col("b.n").alias("n_linked"))


def chains(links: DataFrame) -> DataFrame:
    """Depth and root of every linked message, doubling the reach of its pointer in each round."""
    at = materialize(links.select("conv_id", "turn", F.col("parent_turn").alias("root"), F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = at.join(up, ["conv_id", "root"], "left")
        if moved.filter("next is not null").isEmpty():
            return at
        at = materialize(
            moved.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chains"
        )


def conversations(messages: DataFrame) -> DataFrame:
    """Messages without quotes, in reply order by (conv_id, turn).

    Adds n_quoted (quoted lines), max_level, n_linked, parent_turn, root_turn and depth.
    """
    own = messages.select("conv_id", "turn", "role", "text")
    links = materialize(link(own), "replies")
    tree = links.join(chains(links), ["conv_id", "turn"])
    levels = F.filter(F.transform(F.split("text", "\n"), level), lambda x: x > 0)
    rows = own.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"), levels.alias("levels"))
    return rows.join(tree, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.coalesce(F.size("levels"), F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max("levels"), F.lit(0)).cast("long").alias("max_level"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
