"""Chat examples by prefix-target expansion.

Every assistant turn of a conversation becomes an example: all turns before it are its context, and only its own text
may be learned. Turns after the last assistant turn, which no example would show, form one more example without a
target, so nothing of a conversation is lost. Control strings inside a turn are escaped and can be read back. All of
it is built-in functions; a conversation is put together once and its examples are prefixes of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: TURN role SAYS text END.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Where control strings of this and other templates begin: an escape goes after the first character of each.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    """No control string is left in the result; unescape() gives the text back."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(\\?)", "$1")


def examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """(conv_col, example, formatted, loss_start, loss_end): examples of each conversation, numbered from 0.

    formatted is the whole example; its characters from loss_start up to loss_end, counted from 0, are the only ones to
    learn. They are null in an example without target. Turns stand in the order of turn_col, nulls first, and equal
    ones in that of role and text; rows that repeat are turns like others. A null role or text counts as empty, a null
    conversation is one of its own. Other columns of df don't matter; an empty table has no example.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    head, body = F.concat(F.lit(TURN), escape(role), F.lit(SAYS)), escape(text)
    turns = df.select(
        F.col(conv_col).alias("conv"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), body.alias("body")).alias("t"),
    )
    whole = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # the end of each turn in the whole, as a running sum
    size = lambda t: F.char_length(t["head"]) + F.char_length(t["body"]) + len(END)
    ends = F.aggregate(
        "ts",
        F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("to")),
        lambda a, t: F.struct(F.array_append(a["ends"], a["to"] + size(t)).alias("ends"), (a["to"] + size(t)).alias("to")),
        lambda a: a["ends"],
    )
    joined = F.concat_ws("", F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    put = whole.select("conv", "ts", joined.alias("whole"), ends.alias("ends"))
    is_target = lambda i: F.get(F.col("ts"), i)["role"] == target_role
    shown = put.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: is_target(i) | (i == F.size("ts") - 1)))
    each = shown.select("conv", "ts", "whole", "ends", F.posexplode("at").alias("example", "i"))
    end, last = F.get("ends", F.col("i")), F.get("ts", F.col("i"))
    learn = last["role"] == target_role
    return each.select(
        F.col("conv").alias(conv_col),
        "example",
        F.substring(F.col("whole"), F.lit(1), end).alias("formatted"),
        F.when(learn, end - len(END) - F.char_length(last["body"])).alias("loss_start"),
        F.when(learn, end - len(END)).alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """The turns of an example, as array<struct<role, text>>: null of null, none of an empty text."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    cut = lambda p: F.split(F.substring(p, F.lit(1), F.char_length(p) - len(END)), r"<\|says\|>", 2)
    return F.transform(parts, lambda p: F.transform(F.array(cut(p)), lambda x: F.struct(unescape(F.get(x, F.lit(0))).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")))[0])


def read_back(made: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the examples of each conversation hold, from their output alone.

    (conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): the turns are those of the longest
    example, the learned text is that under the masks in order, and formatted_chars counts all examples.
    """
    masked = F.when(F.col("loss_start").isNotNull(), unescape(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")))
    own = made.select(F.col(conv_col).alias("conv"), "example", "formatted", masked.alias("learned"))
    conv = own.groupBy("conv").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("learned").isNotNull(), F.struct("example", "learned")))).alias("learned"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    turns = parse(F.col("longest"))
    learned = F.concat_ws("", F.transform("learned", lambda x: x["learned"]))
    done = conv.select("conv", "formatted_chars", turns.alias("turns"), learned.alias("learned"))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return done.select(
        F.col("conv").alias(conv_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
