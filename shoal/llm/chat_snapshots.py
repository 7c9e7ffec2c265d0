"""Cumulative-snapshot collapse of logged conversations (operator 6), DataFrame functions only.

A log often holds one conversation many times: as it stood after two turns,
after four, and so on. The rolling hash after a turn is the exclusive-or of the
hashes of (turn number, role, text) of all turns up to it, in two independent
64-bit lanes; it does not change when later turns are added. A conversation is
a snapshot if its final hash is a rolling hash of a longer conversation before
that one's last turn: such conversations go by an anti-join. Of conversations
with the same turns the smallest id stays. What remains is rendered.

Prefix sums run in two levels, first within blocks of ``BLOCK`` turn numbers
and then over the blocks' totals, so that one giant conversation is many small
groups. The rendered text comes in segments of the same blocks.

Defined results: a repeated row (same id, turn, role and text) counts once; rows
that share a turn number but not role or text all belong to that turn, in order
of role and text; null role or text is told apart from empty and rendered as
empty; a null turn comes before turn 0; rows without an id belong to no
conversation and are left out; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import write_table

BLOCK = 4096
LANES = ("a", "b")


def rolling(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, block, turn, role, text, rolling hashes pa/pb, n (turn rows so far) and final pair fa/fb, total."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).filter("conv_id is not null")
    order = F.coalesce(F.col("turn"), F.lit(-(1 << 62)))
    absent = F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"))
    rows = rows.withColumns({
        "order": order, "block": F.floor(F.coalesce(F.col("turn"), F.lit(0)) / block).cast("long"),
        "a": F.xxhash64(order, absent, "role", "text"),
        "b": F.xxhash64(F.lit("lane"), "text", absent, "role", order)})
    in_block = Window.partitionBy("conv_id", "block")
    same = in_block.orderBy("order", "role", "text")
    rows = (rows.withColumn("repeat", F.coalesce((F.lag("order").over(same) == F.col("order"))
                                                 & F.lag("role").over(same).eqNullSafe(F.col("role"))
                                                 & F.lag("text").over(same).eqNullSafe(F.col("text")), F.lit(False)))
            .filter("not repeat").drop("repeat"))
    upto = in_block.orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"p{x}": F.bit_xor(x).over(upto) for x in LANES} | {"n": F.count("*").over(upto)})
    # totals of each block, then of the blocks before it: one row per block
    blocks = rows.groupBy("conv_id", "block").agg(*(F.bit_xor(x).alias(f"t{x}") for x in LANES), F.count("*").alias("tn"))
    conv = Window.partitionBy("conv_id")
    before = conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns(
        {f"o{x}": F.coalesce(F.bit_xor(f"t{x}").over(before), F.lit(0)) for x in LANES}
        | {f"f{x}": F.bit_xor(f"t{x}").over(conv) for x in LANES}
        | {"on": F.coalesce(F.sum("tn").over(before), F.lit(0)), "total": F.sum("tn").over(conv)})
    out = rows.join(blocks.drop("ta", "tb", "tn"), ["conv_id", "block"])
    for x in LANES:
        out = out.withColumn(f"p{x}", F.col(f"p{x}").bitwiseXOR(F.col(f"o{x}")))
    return out.withColumn("n", F.col("n") + F.col("on")).drop("a", "b", "oa", "ob", "on")


def render(column_role="role", column_text="text") -> "F.Column":
    """One turn as text: a header line with the role, the text, an end mark."""
    return F.concat(F.lit("<|"), F.coalesce(F.col(column_role), F.lit("")), F.lit("|>\n"),
                    F.coalesce(F.col(column_text), F.lit("")), F.lit("<|end|>\n"))


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_same (conversations with the same turns), segment, rendered."""
    rows, _ = write_table(rolling(turns, conv_col, turn_col, role_col, text_col, block), "turns")
    inner = rows.filter("n < total").select(F.col("pa").alias("fa"), F.col("pb").alias("fb"), F.col("n").alias("total")).distinct()
    whole = (rows.select("conv_id", "fa", "fb", "total").groupBy("conv_id", "fa", "fb", "total").agg(F.lit(1).alias("one"))
             .groupBy("fa", "fb", "total").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same")))
    kept = whole.join(inner, ["fa", "fb", "total"], "left_anti")
    order = F.struct("order", F.col("role").isNotNull().alias("r"), "role", F.col("text").isNotNull().alias("t"), "text")
    return (rows.select("conv_id", "block", "order", "role", "text")
            .join(kept.select("conv_id", F.col("total").alias("n_turns"), "n_same"), "conv_id")
            .groupBy("conv_id", "n_turns", "n_same", F.col("block").alias("segment"))
            .agg(F.sort_array(F.collect_list(order)).alias("turns"))
            .select("conv_id", "n_turns", "n_same", "segment",
                    F.array_join(F.transform("turns", lambda t: F.concat(
                        F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n"))), "").alias("rendered")))
