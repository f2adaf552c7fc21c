"""Chat formatting (operator 1): conversations become one marked-up string each, with a loss mask.

Method: relational.  Turn structs are collected and sorted per conversation, adjacent turns of the same role are merged
with array functions, and the pieces are joined; Spark expressions only, linear in the conversation's length.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``; texts merged into one turn are parted by ``<|im_next|>``.
``<|`` inside a text or role gets a backslash between its two characters, and where backslashes stand there already one
more, so every control string in the output is the template's and unescape() gives the text back.  A line break
inside a role becomes ``<|nl|>``.

Edge cases: null texts and roles count as empty; null turns sort first; equal turns sort by role and text, repeated rows
stay; null conv_ids form one conversation; empty tables give empty results; extra columns are not read.
One conversation is one output string, so it has to fit a row; a long one costs time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT, BREAK = "<|im_start|>", "<|im_end|>\n", "<|im_next|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments, mask: formatted is the segments' texts end to end; the loss mask holds where loss is true.

    mask says the same of what the control strings part formatted into: of each such piece, whether it is learnt, and how
    many of its characters come before (the role of a turn's first text).
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turn = F.sort_array(F.collect_list("t"))
    grouped = rows.groupBy("conv_id").agg(turn.alias("t"))
    first = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.col("t")[i]["role"] != F.col("t")[F.greatest(i - 1, F.lit(0))]["role"]))
    grouped = grouped.withColumn("first", first)

    def run(s: Column, k: Column) -> Column:
        after = F.when(k + 1 < F.size("first"), F.col("first")[k + 1]).otherwise(F.size("t"))
        return F.struct(F.col("t")[s]["role"].alias("role"), F.slice("t", s + 1, after - s).alias("parts"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def marked(r: Column) -> Column:
        off = F.lit(False)
        head = F.concat(F.lit(START), F.replace(escape(r["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
        texts = F.flatten(F.transform(r["parts"], lambda p, i: F.when(i == 0, F.array(segment(escape(p["text"]), r["role"] == learn_from))).otherwise(F.array(segment(F.lit(NEXT), off), segment(escape(p["text"]), r["role"] == learn_from)))))
        return F.concat(F.array(segment(head, off)), texts, F.array(segment(F.lit(END), off)))

    runs = grouped.select("conv_id", F.transform("first", run).alias("runs"))
    piece = lambda loss, skip: F.struct(loss.alias("loss"), skip.cast("int").alias("skip"))
    none = F.array(piece(F.lit(False), F.lit(0)))

    def masked(r: Column) -> Column:
        role = F.char_length(F.replace(escape(r["role"]), F.lit("\n"), F.lit(BREAK))) + 1
        return F.concat(F.transform(r["parts"], lambda _, i: piece(r["role"] == learn_from, F.when(i == 0, role).otherwise(0))), none)

    cut = runs.select("conv_id", F.flatten(F.transform("runs", marked)).alias("segments"), F.concat(none, F.flatten(F.transform("runs", masked))).alias("mask"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "mask")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted string holds, merged ones apart again."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.char_length(role) + 2, F.char_length(block) - F.char_length(role) - 1 - len(END))
        said = unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda p: F.struct(said.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learnt(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, read from the formatted string; a mask that doesn't fit its pieces gives null."""
    pieces = F.split(formatted, r"<\|im_(?:start|next|end)\|>")
    own = F.zip_with(pieces, mask, lambda p, m: F.when(m["loss"], unescape(F.substring(p, m["skip"] + 1, F.char_length(p)))).otherwise(""))
    return F.when(F.size(pieces) == F.size(mask), F.array_join(own, ""))


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask, read back from format_chats()'s output."""
    back = chats.select("conv_id", read_back(F.col("formatted")).alias("turns"), learnt(F.col("formatted"), F.col("mask")).alias("learnt"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
