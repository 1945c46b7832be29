"""Chat formatting: each conversation once from every participant's side, that speaker as assistant, the others as named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that lie in one part of its rendering; messages of a part beyond which it is divided.
PART_TURNS, PART_MESSAGES = 64, 256
#: The role that speaks to all and is nobody's side.
SYSTEM = "system"


def escaped(text: Column) -> Column:
    """text in which no mark begins: `<|` becomes `<\\|`."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def user_name(role: Column) -> Column:
    """role as it stands in a user's head: neither a mark nor a line ends in it."""
    return F.replace(F.replace(F.replace(escaped(role), F.lit("|>"), F.lit("|\\>")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def numbered(rows: DataFrame, part_turns: int, part_messages: int) -> DataFrame:
    """rows with part and sub, which follow the order of turn, role and text: part from the turn; sub is 0 unless more messages
    than part_messages have the part's turns, such as when turns are null."""
    rows = rows.withColumn("part", F.floor(F.col("turn") / part_turns).cast("bigint"))
    crowded = rows.groupBy(F.col("conv_id").alias("of"), F.col("part").alias("its")).count().where(F.col("count") > part_messages).drop("count")
    found = rows.join(crowded, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("its")), "left")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")) - 1
    usual = found.where("its is null").withColumn("sub", F.lit(0))
    return usual.unionByName(found.where("its is not null").withColumn("sub", F.floor(place / part_messages).cast("int"))).drop("of", "its")


def rotate(messages: DataFrame, part_turns: int = PART_TURNS, part_messages: int = PART_MESSAGES) -> DataFrame:
    """conv_id, perspective, part, sub, start, n_messages, n_targets, text, mask, n_chars, n_mask_chars for messages (conv_id, turn,
    role, text): for every participant the whole dialogue, with that speaker as assistant.

    The dialogue as `perspective` has it is the texts of its rows joined by part and sub: the perspective's own turns are the
    assistant's, the system's stay the system's, all others are users named by role. start is where a row's text begins
    in the dialogue; mask lists start:end (code points of the dialogue, end exclusive) of the assistant's words and end
    marks, which alone are to be learned. A row holds part_turns turns and at most part_messages messages, so that no
    conversation, and no turn that many messages have, must fit one task.

    Messages of one turn come in order of role and text; a message that repeats in conversation, turn, role and text
    counts once. A null role is nobody's name, and shown as `unknown`; a null text is empty; null turns come first, as turn
    -1; a null conv_id is a conversation. What looks like a mark in texts and roles is escaped (`escaped`, `user_name`).
    Conversations of the system alone, and empty tables, give no rows. Other columns are not read, whatever their names.
    """
    rows = messages.select("conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    parts = numbered(rows, part_turns, part_messages).groupBy("conv_id", "part", "sub").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    sides = rows.where(~F.col("role").eqNullSafe(SYSTEM)).select(F.col("conv_id").alias("side_of"), F.col("role").alias("perspective")).distinct()
    seen = parts.join(sides, F.col("conv_id").eqNullSafe(F.col("side_of"))).drop("side_of")

    def head(m):
        named = F.concat(F.lit("<|user name="), user_name(F.coalesce(m["role"], F.lit("unknown"))), F.lit("|>\n"))
        return F.when(m["role"].eqNullSafe(F.col("perspective")), F.lit("<|assistant|>\n")).when(m["role"] == SYSTEM, F.lit("<|system|>\n")).otherwise(named)

    seen = seen.withColumn("turns", F.transform("said", lambda m: F.struct(head(m).alias("head"), F.concat(escaped(m["text"]), F.lit("<|end|>\n")).alias("body"), m["role"].eqNullSafe(F.col("perspective")).alias("own")))).drop("said")
    length = F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, t: s + F.length(t["head"]) + F.length(t["body"]))
    seen = seen.withColumn("n_chars", length)
    # where each row begins, from the lengths of the dialogue's rows
    before = Window.partitionBy("conv_id", "perspective").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = seen.select("conv_id", "perspective", "part", "sub", F.coalesce(F.sum("n_chars").over(before), F.lit(0).cast("bigint")).alias("start"))
    same = [F.col(f"seen.{c}").eqNullSafe(F.col(f"starts.{c}")) for c in ("conv_id", "perspective", "part", "sub")]
    seen = seen.alias("seen").join(starts.alias("starts"), same).select("seen.*", "starts.start")

    # ends of the turns by a running sum over an array of bounded length
    ends = F.transform("turns", lambda t, i: F.struct((F.col("start") + F.aggregate(F.slice("turns", 1, i + 1), F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["head"]) + F.length(x["body"]))).alias("end"), F.length(t["body"]).cast("bigint").alias("size"), t["own"].alias("own")))
    seen = seen.withColumn("targets", F.filter(ends, lambda e: e["own"]))
    spans = F.transform("targets", lambda e: F.concat_ws(":", (e["end"] - e["size"]).cast("string"), e["end"].cast("string")))
    return seen.select(
        "conv_id", F.coalesce("perspective", F.lit("unknown")).alias("perspective"), "part", "sub", "start",
        F.size("turns").cast("bigint").alias("n_messages"), F.size("targets").cast("bigint").alias("n_targets"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        F.array_join(spans, ",").alias("mask"), "n_chars", F.aggregate("targets", F.lit(0).cast("bigint"), lambda s, e: s + e["size"]).alias("n_mask_chars"),
    )
