"""Conversation prefix trie by whole-sequence collapse.

Logged conversations share their first turns.  The trie over them (a node for
each different sequence of first turns) comes from whole sequences, not
level by level:

1. ``rebuilt``: the conversations to index, here each with the first turns of
   another one put before its own.
2. ``prefixes``: a turn is the SHA-256 of its role and text; a prefix is known by
   its depth and two 64-bit rolling hashes (exclusive-or of the hashes of place
   and turn).  Turns are numbered by a range sort and hashed in stretches of ``STRETCH``
   places, so a conversation of any length is spread over many tasks.
3. Identical conversations collapse into one weighted sequence: how many, the
   smallest id, and the list of ends, hashed in ascending order.
4. An anti-join with all proper prefixes leaves the sequences that are leaves.
5. The prefixes of each sequence, weighted, are summed by node: members,
   smallest member, leaves.  A first turn that very many conversations share is
   one row a sequence before the sum, and is summed within tasks first.
6. Sums over subtrees need no recursion: a node belongs to the sequence of its
   smallest member, and a sequence's own nodes are the deepest part of its path,
   so each node's sum is that of the suffix sums of the sequences through it.

Hashes are verified: a node whose sequences differ in the last turn or in the
parent shows a collision, and all is hashed anew with another seed.

The ends of one sequence are joined in runs by a range sort on (sequence, id),
whichever task they are in; then the runs, a few thousand ids each, go through
one SHA-256, which the result asks for and which can't be split.

Defined cases: rows with a null conv_id are left out; turns are ordered by number,
null first, then role and text; null roles and texts are empty; repeated turns each count; a
conversation without turns ends at the root; very long texts only count by their
hash and bytes; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmart.llm.common import mapped_table, shared_table

STRETCH = 1024
# Ids of a run of one sequence's ends.
RUN = 4096
NODE = ["depth", "h1", "h2"]
DIGEST = ["d1", "d2", "d3", "d4"]


def _xor(col: str) -> Column:
    return F.expr(f"bit_xor({col})")


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, d1 to d4, bytes): turns in order, places from 1, whatever the turn numbers are."""
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
        # equal rows of one conversation may be very many: their order decides nothing, but splits them
        F.monotonically_increasing_id().alias("copy"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "copy"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("conv_id", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("number"), F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("hex"))
    digest = [F.conv(F.substring("hex", 16 * i + 1, 16), 16, -10).cast("long").alias(d) for i, d in enumerate(DIGEST)]
    ranged = shared_table(ranged.select("conv_id", "slice", "number", "bytes", *digest), "ranged-turns")
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = ranged.groupBy("conv_id", "slice").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    offsets = slices.select("conv_id", "slice", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("offset"))
    placed = ranged.join(offsets, ["conv_id", "slice"]).select("conv_id", (F.col("number") + F.col("offset")).alias("place"), *DIGEST, "bytes")
    return shared_table(placed, "placed-turns")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c after the rule: (conv_id, place, d1 to d4, bytes), and (conv_id, length) of all, also turnless.

    The first h turns of conversation c - c % 5 (what there is of them), then c's own turns after
    its first h; h is crc32 of the decimal c, modulo 9.
    """
    lengths = placed.groupBy("conv_id").agg(F.max("place").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    plans = lengths.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9})
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    plans = plans.join(bases, "base", "left")
    plans = shared_table(plans.withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0)))), "plans")
    firsts = placed.filter("place <= 8").withColumnRenamed("conv_id", "base")
    taken = plans.select("conv_id", "base", "taken").join(firsts, "base").filter("place <= taken").select("conv_id", "place", *DIGEST, "bytes")
    rest = placed.join(plans.select("conv_id", "taken", "h"), "conv_id").filter("place > h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), *DIGEST, "bytes")
    totals = plans.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return shared_table(taken.unionByName(rest), "rebuilt-turns"), totals


def _running(rows: DataFrame, ends: dict[str, Column], run: dict[str, Column], order: str, name: str) -> DataFrame:
    """``rows`` (conv_id, depth, ...) with running aggregates over a conversation, in stretches of places.

    ``run``: the running aggregate within a stretch by name; ``ends``: the aggregate of a whole stretch,
    carried over the earlier stretches by the same window; both are combined by the caller as ``<name>`` and ``<name>_before``.
    """
    rows = rows.withColumn("stretch", F.expr(f"(depth - 1) div {STRETCH}"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = shared_table(rows.withColumns({n: c.over(inside) for n, c in run.items()}), name)
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    per = inner.groupBy("conv_id", "stretch").agg(*(c.alias(f"{n}_end") for n, c in ends.items()))
    carried = per.select("conv_id", "stretch", *(F.coalesce(F.expr(f"{'bit_xor' if n.startswith('h') else 'sum'}({n}_end)").over(earlier), F.lit(0)).cast("long").alias(f"{n}_before") for n in ends))
    return inner.join(carried, ["conv_id", "stretch"]).drop("stretch")


def prefixes(turns: DataFrame, seed: int = 0) -> DataFrame:
    """(conv_id, depth, h1, h2, p1, p2, d1 to d4, bytes): every prefix of every conversation, and its parent's hashes."""
    terms = [F.xxhash64(F.lit(2 * seed + i), "place", *DIGEST) for i in (0, 1)]
    rows = turns.withColumns({"t1": terms[0], "t2": terms[1]}).withColumnRenamed("place", "depth")
    rolled = _running(rows, {"h1": _xor("t1"), "h2": _xor("t2")}, {"h1": _xor("t1"), "h2": _xor("t2")}, "depth", "rolled-turns")
    rolled = rolled.withColumns({f"h{i}": F.col(f"h{i}").bitwiseXOR(F.col(f"h{i}_before")) for i in (1, 2)})
    rolled = rolled.withColumns({f"p{i}": F.col(f"h{i}").bitwiseXOR(F.col(f"t{i}")) for i in (1, 2)})
    return shared_table(rolled.select("conv_id", *NODE, "p1", "p2", *DIGEST, "bytes"), "prefixes")


def collides(prefixed: DataFrame) -> bool:
    """Whether two different prefixes have one hash: then, at the least depth, their last turns or parents differ."""
    told = ("p1", "p2", *DIGEST)
    spread = prefixed.groupBy(*NODE).agg(*(F.min(c).alias(f"{c}_min") for c in told), *(F.max(c).alias(f"{c}_max") for c in told))
    return not spread.filter(" or ".join(f"{c}_min <> {c}_max" for c in told)).isEmpty()


def sequences(prefixed: DataFrame, totals: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2) of every conversation as a whole; a turnless one is the root."""
    ends = prefixed.select("conv_id", *NODE)
    last = ends.join(totals, "conv_id").filter("depth = length").select("conv_id", *NODE)
    none = totals.filter("length = 0").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in NODE))
    return shared_table(last.unionByName(none), "sequences")


def end_lists(whole: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256): the conversations that are exactly this sequence, ids ascending, comma-joined."""
    names, schema = [*NODE, "first", "ids"], "depth long, h1 long, h2 long, first long, ids string"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, start = list(zip(*(c.to_pylist() for c in batch.columns))), [], 0
            for at in range(1, len(rows) + 1):
                if at == len(rows) or rows[at][:3] != rows[start][:3]:
                    out.append((*rows[start], ",".join(str(r[3]) for r in rows[start:at])))
                    start = at
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out))], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for depth, h1, h2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (depth, h1, h2):
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (depth, h1, h2), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield _hashes(out)
        if key:
            yield _hashes([(*key, sha.hexdigest())])

    ranged = whole.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = mapped_table(ranged, runs, schema, "end-runs", rows=RUN)
    dealt = joined.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return mapped_table(dealt, hashed, "depth long, h1 long, h2 long, ends_sha256 string", "ends", rows=256)


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    names = [*NODE, "ends_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for n, c in zip(names, zip(*rows))], names)


def trie(turns: DataFrame, totals: DataFrame, seed: int = 0) -> DataFrame:
    """The nodes of the trie over (conv_id, place, d1 to d4, bytes); ``totals`` has every conversation's length.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    """
    prefixed = prefixes(turns, seed)
    if collides(prefixed):
        return trie(turns, totals, seed + 1)
    whole = sequences(prefixed, totals)
    weighted = shared_table(whole.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")), "weighted-sequences")
    paths = shared_table(prefixed.join(weighted.select("conv_id", "weight", F.col("depth").alias("length")), "conv_id"), "paths")
    proper = paths.filter("depth < length").select(*NODE).distinct()
    root = weighted.filter("depth > 0").limit(1).select(*(F.lit(0).cast("long").alias(c) for c in NODE))
    leaves = shared_table(weighted.join(proper.unionByName(root), NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf")), "leaves")
    paths = paths.join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0).cast("long")))
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        *(F.max(c).alias(c) for c in ("bytes", "p1", "p2")),
    )
    nodes = shared_table(nodes, "nodes")

    # suffix sums along each sequence of what its own nodes save
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    along = paths.select("conv_id", *NODE).join(own, ["conv_id", "depth"], "left").withColumn("saved", F.coalesce("saved", F.lit(0).cast("long")))
    total = F.sum("saved")
    summed = shared_table(_running(along, {"run": total}, {"run": total}, "depth", "saved-along"), "suffix-sums")
    sums = summed.groupBy("conv_id").agg(F.sum("saved").alias("all"))
    suffix = F.col("all") - F.col("run") - F.col("run_before") + F.col("saved")
    subtree = summed.join(sums, "conv_id").groupBy(*NODE).agg(F.sum(suffix).alias("saved_tokens"))

    # the root, one row, beside the others
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    counted = weighted.select("conv_id", F.col("weight").alias("n_convs"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    counted = counted.unionByName(leaves.select(none.alias("conv_id"), zero.alias("n_convs"), F.col("leaf").alias("n_leaves"), zero.alias("saved_tokens")))
    counted = counted.unionByName(own.select(none.alias("conv_id"), zero.alias("n_convs"), zero.alias("n_leaves"), F.col("saved").alias("saved_tokens")))
    every = counted.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens"))).filter("conv_id is not null")
    top = every.select(*(zero.alias(c) for c in NODE), "conv_id", "n_convs", "n_leaves", none.alias("p1"), none.alias("p2"), "saved_tokens")
    known = shared_table(nodes.join(subtree, NODE).select(top.columns).unionByName(top), "trie-nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")]
    children = known.filter("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = known.join(parents, ["depth", "p1", "p2"], "left").join(children, NODE, "left").join(end_lists(whole), NODE, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
