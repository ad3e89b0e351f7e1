"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logs often hold a conversation once per turn, each snapshot a prefix of the
next.  A turn's hash covers its place, role and text; the rolling hash of a
prefix is the exclusive-or of its turns' hashes (two independent 64-bit ones), so
prefixes can be hashed in parts: turns are numbered by a range sort, whatever their turn numbers
are, dealt into stretches of ``STRETCH`` places, hashed within, and combined over the stretches,
and no conversation, however long, is gathered in one task.  A conversation is dropped if its whole
hash and length equal those of a proper prefix of another (anti-join), and of
equal conversations the smallest id stays.  Both sides of the join have one row
per different hash, so a first turn that very many share is one row.

What stays is rendered by a template, in parts of ``PART`` turns a row.

Defined cases: turns are ordered by turn number, then role and text (null first);
rows with a null conv_id are left out; a null turn number comes first; null roles and texts
count as empty in rendering and as null in hashing; repeated turns each count;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmart.llm.common import shared_table

STRETCH = 1024
PART = 256
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _xor(col: str) -> Column:
    return F.expr(f"bit_xor({col})")


def placed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, role, text, h1, h2): places from 1, and the rolling hashes of the prefix that ends there."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).filter("conv_id is not null")
    # equal rows may be very many: their order decides nothing, but splits them
    order = ["conv_id", *(F.asc_nulls_first(c) for c in ("turn", "role", "text")), "copy"]
    ranged = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = shared_table(ranged.select("conv_id", "role", "text", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("number")), "turns")
    # one row per conversation and task of the sort: the places before it
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = ranged.groupBy("conv_id", "slice").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("size"))
    offsets = slices.select("conv_id", "slice", (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first") + 1).alias("offset"))
    placed = ranged.join(offsets, ["conv_id", "slice"]).select("conv_id", (F.col("number") + F.col("offset")).alias("place"), "role", "text")
    placed = placed.withColumn("stretch", F.expr(f"(place - 1) div {STRETCH}"))
    # hashing skips nulls, so their marks are hashed too
    nulls = (F.col("role").isNull(), F.col("text").isNull())
    hashed = placed.withColumn("t1", F.xxhash64("place", *nulls, "role", "text")).withColumn("t2", F.xxhash64(F.lit("second"), *nulls, "text", "role", "place"))
    rolling = Window.partitionBy("conv_id", "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hashed = shared_table(hashed.withColumn("r1", _xor("t1").over(rolling)).withColumn("r2", _xor("t2").over(rolling)).drop("t1", "t2"), "hashed-turns")
    same = F.expr("conv_id = c and stretch = s")
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ends = hashed.groupBy(F.col("conv_id").alias("c"), F.col("stretch").alias("s")).agg(F.max_by("r1", "place").alias("e1"), F.max_by("r2", "place").alias("e2"))
    zero = F.lit(0).cast("long")
    carried = ends.select("c", "s", *(F.coalesce(_xor(f"e{i}").over(before), zero).alias(f"c{i}") for i in (1, 2)))
    return hashed.join(carried, same).select("conv_id", "place", "role", "text", *(F.col(f"r{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"h{i}") for i in (1, 2)))


def maximal(placed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no other one repeats or continues."""
    prefixes = placed.select("conv_id", "place", "h1", "h2")
    lengths = prefixes.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    whole = prefixes.join(lengths, "conv_id")
    last = whole.filter("place = n_turns").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = whole.filter("place < n_turns").select("place", "h1", "h2").distinct()
    return last.join(proper, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, rendered): the maximal conversations; n_turns counts the part's turns."""
    placed = shared_table(placed_turns(turns, conv_col, turn_col, role_col, text_col), "placed-turns")
    kept = placed.join(maximal(placed).select("conv_id"), "conv_id", "left_semi")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    parts = kept.groupBy("conv_id", F.expr(f"cast((place - 1) div {PART} as int)").alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "part", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.col("lines.line"), "").alias("rendered"))
