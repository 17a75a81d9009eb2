"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role share
a block and are divided by a separator; everything is then one concatenation:

    <|im_start|>role\\ntext<|im_sep|>text of the same role<|im_end|>\\n

Control strings inside texts are escaped: a bar that follows ``<`` and k backslashes gets one
backslash more, so ``<|`` never occurs in an escaped text and the step back is exact. Roles are
escaped by percent codes. The loss mask is a list of runs, characters with or without loss, over
the whole string; each assistant text is a run of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, TRAINED = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "assistant"
MASK = "array<struct<chars:bigint,loss:boolean>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """``conv_id, formatted, mask`` per conversation of ``turns`` (``conv_id, turn, role, text``).

    Turns come in order of turn (null first), then role, then text, so repeated turn numbers and
    repeated rows have a fixed order; rows are never dropped. A null role or text is empty; rows
    with a null id are one conversation. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def parts(t, i):
        ts = F.col("ts")
        opens = (i == 0) | (F.get(ts, i - 1)["role"] != t["role"])
        closes = (i == F.size(ts) - 1) | (F.get(ts, i + 1)["role"] != t["role"])
        head = F.when(opens, F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
                        (t["role"] == trained).alias("loss"))

    parted = chats.select("conv_id", F.transform("ts", parts).alias("ps"))
    formatted = F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")

    def run(chars, loss):
        return F.struct(F.length(chars).cast("long").alias("chars"), loss.alias("loss"))

    mask = F.flatten(F.transform("ps", lambda p: F.array(
        run(p["head"], F.lit(False)), run(p["body"], p["loss"]), run(p["tail"], F.lit(False)))))
    return parted.select("conv_id", formatted.alias("formatted"), F.filter(mask, lambda m: m["chars"] > 0).cast(MASK).alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (``role, text``) back from a formatted string."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def of(block):
        inside = F.substr(block, F.lit(len(START) + 1))
        line = F.instr(inside, "\n")
        role, body = F.substr(inside, F.lit(1), line - 1), F.substr(inside, line + 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(unescape_role(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, of))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped run by run."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def step(acc, m):
        piece = F.when(m["loss"], unescape(F.substr(formatted, (acc["at"] + 1).cast("int"), m["chars"].cast("int")))).otherwise(F.lit(""))
        return F.struct((acc["at"] + m["chars"]).alias("at"), F.concat(acc["text"], piece).alias("text"))

    return F.aggregate(mask, zero, step, lambda acc: acc["text"])


def chat_digest(chats: DataFrame) -> DataFrame:
    """What can be read back from the output of :func:`format_chats`."""
    read = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
                        read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")
