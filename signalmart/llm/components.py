"""Connected components of a link table, by randomised contraction.

Each round every node moves to the neighbour (or itself) with the smallest
hash, twice over; links between equal nodes vanish, the rest are made
distinct and written to the shared folder.  Hash priorities differ by round,
so the links shrink geometrically also on long chains.  Minima are partial
aggregates, written out before they are joined, so that both sides of a join are
plain shuffles, which adaptive execution can split: a hub with very many links is
never gathered in one task.  Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmart.llm.common import drop_shared, shared_table


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): ``component`` is the smallest node reachable; only nodes with links to others appear.

    Repeated links, both directions of one link and self-links are allowed;
    links with a null end are ignored.
    """
    edges = shared_table(
        links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        .filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        rank = F.xxhash64("other", F.lit(len(moves)))
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        # min over (hash, node) as two plain minima would tear pairs apart; min_by keeps them together
        best = ends.groupBy("node").agg(F.min_by("other", rank).alias("other"), F.min(rank).alias("rank"))
        to = shared_table(best.select("node", F.expr(f"if(xxhash64(node, {len(moves)}) <= rank, node, other)").alias("to")), "moves")
        hop = to.alias("x").join(to.select(F.col("node").alias("to"), F.col("to").alias("to2")).alias("y"), "to").select("node", F.col("to2").alias("to"))
        move = shared_table(hop, "moves2")
        drop_shared(to)
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        shrunk = shared_table(
            edges.join(left, "a").join(right, "b").filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(),
            "links",
        )
        drop_shared(edges)
        edges = shrunk
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        nxt = move.select(F.col("node").alias("root"), F.col("to").alias("next"))
        whole = whole.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    whole = shared_table(whole, "roots")
    least = shared_table(whole.groupBy("root").agg(F.min("node").alias("component")), "least-nodes")
    for used in (edges, *moves):
        drop_shared(used)
    return whole.join(least, "root").select("node", "component")
