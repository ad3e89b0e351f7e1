"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length 1 in double precision; cosine >= t is Euclidean
distance <= sqrt(2 - 2 t).  Equal unit vectors of a label become one row with a
multiplicity, so groups of copies cost one row.

The top level runs in Spark: each label's vectors go to the nearest of a few
centres (at most ``MAX_CENTRES``, a bounded sample; the centres only shape the
cells), cells of more than ``BLOCK`` vectors are cut by hash, and pairs of
blocks whose covering radii and centres rule out a close pair are pruned.  Each
remaining pair of blocks is one bounded task: it builds a cover tree of each
block and walks both trees together, dropping node pairs that the covering radii put too far apart,
accepting whole those that they put close enough, and comparing vectors at the
leaves.  A node's children are centres more than half its radius apart that cover
its vectors within that half, each vector under its nearest one; a vector that no other is near is a node of
its own.  Vectors without structure come apart at the first level, and their pairs are
dropped there as pairs of nodes; vectors in clusters come apart level by level, down to
clusters no wider than the distance sought.

A task returns one row per vector: how many vectors it links with there, and the
root of its connected part.  So no list of pairs is ever made; components are
then joined by contraction over these (vector, root) rows.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and those with a null label, link with nothing; vectors of different
lengths don't link; repeated rows count as vectors of their own; the component id
is the smallest vec_id reached (nulls aside); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmart.llm.common import shared_table
from signalmart.llm.components import connected_components

BLOCK = 4096
MAX_CENTRES = 1024
LEAF = 16
# Vectors whose distances are taken at a time.
STRIP = 512
# Rounding of a dot product moves a small distance by about 1e-8.
SLACK = 1e-6


def distances(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))


class Node:
    __slots__ = ("centre", "members", "radius", "children")

    def __init__(self, centre: int, members: np.ndarray, radius: float):
        self.centre, self.members, self.radius, self.children = centre, members, radius, ()


class CoverTree:
    """Nested centres over unit vectors; a child's radius is at most half its parent's, down to ``least``."""

    def __init__(self, points: np.ndarray, least: float):
        self.points, self.levels = points, 1
        everything = np.arange(len(points))
        self.root = Node(0, everything, float(distances(points @ points[0]).max()))
        waiting = [(self.root, 1)]
        while waiting:
            node, level = waiting.pop()
            self.levels = max(self.levels, level)
            if len(node.members) > LEAF and node.radius > max(least, SLACK):
                node.children = self._split(node)
                waiting.extend((child, level + 1) for child in node.children)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return distances(self.points[a] @ self.points[b].T)

    def _centres(self, members: np.ndarray, reach: float) -> np.ndarray:
        """Members more than ``reach`` apart that cover all within it, in order: a strip at a time against those chosen before."""
        chosen = members[:1]
        for begin in range(1, len(members), STRIP):
            strip = members[begin : begin + STRIP]
            strip = strip[self._apart(strip, chosen).min(axis=1) > reach]
            near = self._apart(strip, strip) <= reach
            covered, new = np.zeros(len(strip), bool), []
            for i in range(len(strip)):
                if not covered[i]:
                    new.append(i)
                    covered |= near[i]
            chosen = np.concatenate((chosen, strip[new]))
        return chosen

    def _split(self, node: Node) -> list[Node]:
        """Its children: at least two, as some member is farther than half the radius from the centre."""
        members = np.concatenate(([node.centre], node.members[node.members != node.centre]))  # nested: the centre stays one
        centres = self._centres(members, node.radius / 2)
        owner, away = np.empty(len(members), np.int64), np.empty(len(members))
        for begin in range(0, len(members), STRIP):
            part = slice(begin, begin + STRIP)
            apart = self._apart(members[part], centres)
            owner[part] = apart.argmin(axis=1)
            away[part] = apart.min(axis=1)
        place = {int(c): i for i, c in enumerate(centres)}
        for i, m in enumerate(members.tolist()):
            if m in place:
                owner[i], away[i] = place[m], 0.0
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        return [Node(int(c), members[order[b:e]], float(away[order[b:e]].max())) for c, b, e in zip(centres, ends[:-1], ends[1:])]


class Links:
    """What a task finds: numbers of linked vectors, and links enough for the connected parts."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.counts = weights, np.zeros(len(weights), np.int64)
        # ordered pairs of vectors that were compared at leaves, and that were accepted as whole nodes
        self.compared, self.accepted = 0, 0
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray, close: np.ndarray, both: bool) -> None:
        """``close[i, j]``: a[i] and b[j] are linked; ``both``: count on b's side too."""
        self.counts[a] += close @ self.weights[b]
        if both:
            self.counts[b] += close.T @ self.weights[a]
        first = np.argmax(close, axis=1)
        rows = close[np.arange(len(a)), first]
        self.ends.append((a[rows], b[first[rows]]))
        # the other links matter only where they join parts that the first ones leave apart
        label = np.where(close, first[:, None], len(b)).min(axis=0)
        apart = close & (label[None, :] != first[:, None])
        i, j = np.nonzero(apart)
        if len(i):
            pairs = np.unique(np.stack((first[i], label[j]), axis=1), axis=0)
            self.ends.append((b[pairs[:, 0]], b[pairs[:, 1]]))
        columns = np.flatnonzero(label < len(b))
        self.ends.append((b[columns], b[label[columns]]))

    def whole(self, a: np.ndarray, b: np.ndarray, both: bool) -> None:
        """All of a are linked with all of b."""
        self.counts[a] += self.weights[b].sum()
        if both:
            self.counts[b] += self.weights[a].sum()
        self.ends.append((a, np.full(len(a), b[0])))
        self.ends.append((b, np.full(len(b), a[0])))

    def clique(self, a: np.ndarray) -> None:
        """All of a are linked with each other."""
        self.counts[a] += self.weights[a].sum() - self.weights[a]
        self.ends.append((a, np.full(len(a), a[0])))

    def roots(self) -> np.ndarray:
        label = np.arange(len(self.weights))
        if not self.ends:
            return label
        u, v = (np.concatenate(x) for x in zip(*self.ends))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if (new == label).all():
                return label
            label = new


def dual_traversal(points: np.ndarray, weights: np.ndarray, split: int, least: float) -> Links:
    """Links with cosine >= ``least``: within all points (``split`` 0) or between the first ``split`` and the rest."""
    limit = math.sqrt(max(0.0, 2.0 - 2.0 * least))
    links = Links(weights)
    one = CoverTree(points[:split] if split else points, limit)
    two = CoverTree(points[split:], limit) if split else one
    shift, both = split, bool(split)
    stack = [(one.root, two.root)]
    while stack:
        a, b = stack.pop()
        if not a.children and not b.children:
            other = b.members + shift
            links.compared += len(a.members) * len(other)
            for begin in range(0, len(a.members), 512):
                own = a.members[begin : begin + 512]
                close = points[own] @ points[other].T >= least
                if not split:
                    close &= own[:, None] != other[None, :]
                if close.any():
                    links.add(own, other, close, both)
            continue
        mine, others = a.children or [a], b.children or [b]
        radius_a, radius_b = (np.array([n.radius for n in side]) for side in (mine, others))
        at_a, at_b = (np.array([n.centre for n in side]) for side in (mine, others))
        for begin in range(0, len(mine), 512):
            part = slice(begin, begin + 512)
            apart = distances(points[at_a[part]] @ points[at_b + shift].T)
            reach = radius_a[part, None] + radius_b[None, :]
            near = apart <= limit + reach + SLACK
            inside = near & (apart + reach <= limit - SLACK)
            for i, j in np.argwhere(near).tolist():
                x, y = mine[begin + i], others[j]
                if not split and x is y and len(x.members) == 1:
                    continue
                if inside[i, j]:
                    links.accepted += len(x.members) * len(y.members)
                    if split or x is not y:
                        links.whole(x.members, y.members + shift, both)
                    else:
                        links.clique(x.members)
                else:
                    stack.append((x, y))
    return links


def _unit(embedding: list | None) -> bytes | None:
    """The unit vector in double precision, or None where there is none."""
    if not embedding or any(x is None for x in embedding):
        return None
    v = np.array(embedding, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0.0:
        return None
    v /= top  # no overflow in the squares
    return (v / np.sqrt(v @ v) + 0.0).tobytes()


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; see the module docstring."""
    if not 0.0 < least <= 1.0:
        raise ValueError("the threshold must be above 0 and at most 1")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(_unit, batch.column(2).to_pylist())), pa.binary())], ["vec_id", "label", "unit"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    rows = shared_table(rows.mapInArrow(units, "vec_id long, label string, unit binary"), "unit-vectors")
    usable = rows.filter("label is not null and unit is not null")
    distinct = usable.groupBy("label", "unit").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    distinct = shared_table(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")

    sizes = distinct.groupBy("label", F.octet_length("unit").alias("width")).count().withColumn("cells", F.expr(f"cast(least({MAX_CENTRES}, (count + {BLOCK - 1}) div {BLOCK}) as int)")).drop("count")
    centres = _centres(distinct, sizes)
    placed = shared_table(_cells(distinct, sizes, centres), "cells")
    counts = placed.groupBy("label", "width", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    blocked = placed.join(counts, ["label", "width", "cell"]).withColumn("part", F.expr(f"pmod(xxhash64(node), (n + {BLOCK - 1}) div {BLOCK})"))
    blocked = shared_table(blocked.select("label", "width", "cell", "part", "radius", "node", "unit", "copies"), "blocks")

    pairs = shared_table(_block_pairs(blocked, centres, least), "block-pairs")
    sides = []
    for side in ("a", "b"):
        own = pairs.filter("not same" if side == "b" else "true").select("label", "width", F.col(f"{side}_cell").alias("cell"), F.col(f"{side}_part").alias("part"), "pair", "same")
        sides.append(blocked.join(own, ["label", "width", "cell", "part"]).select("pair", "same", F.lit(side).alias("side"), "node", "unit", "copies"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"], kind="stable")
        points = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        split = 0 if pdf["same"].iloc[0] else int((pdf["side"] == "a").sum())
        nodes = pdf["node"].to_numpy()
        links = dual_traversal(points, pdf["copies"].to_numpy(np.int64), split, least)
        found = pd.DataFrame({"node": nodes, "links": links.counts, "root": nodes[links.roots()]})
        return found[found["links"] > 0]

    found = shared_table(sides[0].unionByName(sides[1]).groupBy("pair").applyInPandas(walk, "node long, links long, root long"), "links")
    linked = connected_components(found, "node", "root")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = distinct.join(degree, "node", "left").join(linked, "node", "left").select("label", "unit", "first_id", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    # written out: a join with an aggregate on its own key could not be split
    whole = shared_table(whole, "linked-vectors")
    least_id = shared_table(whole.groupBy("component").agg(F.min("first_id").alias("component_id")), "least-ids")
    known = whole.join(least_id, "component").select("label", "unit", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    return rows.join(known, ["label", "unit"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n_links").isNull(), F.lit(True)).otherwise(F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def _centres(distinct: DataFrame, sizes: DataFrame) -> Broadcast:
    """By vector width, a bounded sample of unit vectors; empty if no label needs more than one cell."""
    most = sizes.agg(F.max("cells")).first()[0] or 1
    found = []
    if most > 1:
        sample = distinct.select(F.octet_length("unit").alias("width"), "unit").orderBy(F.xxhash64("unit"), "unit").limit(2 * MAX_CENTRES)
        found = sample.groupBy("width").agg(F.slice(F.sort_array(F.collect_list("unit")), 1, most).alias("units")).collect()
    return distinct.sparkSession.sparkContext.broadcast({r["width"]: np.stack([np.frombuffer(u, np.float64) for u in r["units"]]) for r in found})


def _cells(distinct: DataFrame, sizes: DataFrame, centres: Broadcast) -> DataFrame:
    """Each vector's nearest centre among as many as its label has cells, and its distance from it."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = [], []
            for width, cells, unit in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4))):
                among = centres.value.get(width)
                apart = distances(among[:cells] @ np.frombuffer(unit, np.float64)) if cells > 1 and among is not None else np.array([2.0])
                cell.append(int(np.argmin(apart)))
                away.append(float(apart.min()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(away, pa.float64()), *(batch.column(i) for i in (3, 4, 5))], ["label", "width", "cell", "away", "node", "unit", "copies"])

    own = distinct.withColumn("width", F.octet_length("unit")).join(sizes, ["label", "width"]).select("label", "width", "cells", "node", "unit", "copies")
    return own.mapInArrow(nearest, "label string, width int, cell int, away double, node long, unit binary, copies long")


def _block_pairs(blocked: DataFrame, centres: Broadcast, least: float) -> DataFrame:
    """Pairs of blocks of a label that may hold a close pair: their balls around the centres come within the limit."""
    limit = math.sqrt(max(0.0, 2.0 - 2.0 * least))
    blocks = blocked.groupBy("label", "width", "cell", "part").agg(F.max("radius").alias("radius"))
    a = blocks.select("label", "width", *(F.col(c).alias(f"a_{c}") for c in ("cell", "part", "radius")))
    b = blocks.select("label", "width", *(F.col(c).alias(f"b_{c}") for c in ("cell", "part", "radius")))
    joined = a.join(b, ["label", "width"]).filter("a_cell < b_cell or (a_cell = b_cell and a_part <= b_part)")

    @F.pandas_udf("double")
    def apart(width: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        found = np.zeros(len(width))
        for w in width.unique():
            own, among = (width == w).to_numpy(), centres.value.get(int(w))
            if among is not None:
                found[own] = distances((among[x[own].to_numpy()] * among[y[own].to_numpy()]).sum(axis=1))
        return pd.Series(found)

    close = joined.filter(apart("width", "a_cell", "b_cell") <= F.col("a_radius") + F.col("b_radius") + limit + SLACK)
    return close.select("label", "width", "a_cell", "a_part", "b_cell", "b_part", F.expr("a_cell = b_cell and a_part = b_part").alias("same")).withColumn("pair", F.monotonically_increasing_id())
