"""Exact sums of doubles against fractions, for any order and partitioning, and the operators that use them."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from signalmart import dims
from signalmart.functions import exact
from signalmart.operators import aggs, joins

NAN, INF = float("nan"), float("inf")


def exactly(values):
    """The exact sum, rounded once; infinities and NaN as in floating-point addition."""
    odd = [v for v in values if v is not None and not math.isfinite(v)]
    if odd:
        return NAN if any(math.isnan(v) for v in odd) or len(set(odd)) > 1 else odd[0]
    return float(sum((Fraction(v) for v in values if v is not None), Fraction(0)))


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b))


def groups():
    rng = random.Random(9)
    out = {
        "tenths": [0.1] * 1000,
        "tiny": [1e-13] * 7,
        "huge": [1e27, 1e13 * 1e13, -1e27],
        "cancel": [1e27, 1e-13, -1e27],
        "deep": [5e-324] * 3 + [2.2e-308, -1e-310],
        "wide": [1e300, 1.0, -1e300, 1e-300],
        "top": [1.7e308, 1.7e308, -1.7e308],
        "over": [1.7e308, 1.7e308],
        "zeros": [0.0, -0.0],
        "nulls": [None, None],
        "some": [None, 0.3, 0.6],
        "nan": [1.0, NAN, INF],
        "plus": [1.0, INF, INF],
        "minus": [-INF, 3.0],
        "both": [INF, -INF, 1.0],
        "powers": [s * 2.0**e for e in range(-60, 60) for s in (1, -0.75)],
    }
    for i in range(20):
        out[f"random{i}"] = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20) for _ in range(rng.randint(1, 60))]
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_sums_are_exact_in_any_order(spark, partitions):
    rows = [(k, v) for k, vs in groups().items() for v in vs]
    random.Random(partitions).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(partitions)
    got = {r.k: (r.a, r.b) for r in exact.sums(df, ["k"], {"a": F.col("v"), "b": F.lit(2.0)}).collect()}
    for k, values in groups().items():
        want = INF if k == "over" else exactly(values)
        assert same(got[k][0], want), (k, got[k][0], want)
        assert got[k][1] == 2.0 * len(values)


def test_binned_sums_of_parts_add_up(spark):
    rows = [(k, v) for k, vs in groups().items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    whole = exact.sums(df, ["k"], {"v": F.col("v")})
    parts = [exact.binned_sums(df.where(F.pmod(F.xxhash64("v"), F.lit(3)) == i), ["k"], {"v": F.col("v")}) for i in range(3)]
    added = exact.doubles(exact.add_bins(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["k"]), ["k"], ["v"])
    assert sorted(map(str, added.collect())) == sorted(map(str, whole.collect()))


def _articles(spark, rows):
    """(importance, dimension value, target score) articles of one region and quarter."""
    df = spark.createDataFrame(rows, "w double, d double, s double")
    ai = F.struct(
        F.lit(True).alias("is_6g_relevant"),
        F.lit("US").alias("source_region"),
        F.col("w").alias("overall_6g_importance"),
        F.create_map(F.lit(dims.DIMENSIONS[0]), F.col("d")).alias("impact_dimensions"),
        F.create_map(F.lit("EU"), F.col("s")).alias("world_power_impact"),
    )
    return df.select(ai.alias("ai_insights"), F.lit("2024-05-01").alias("date"))


@pytest.mark.parametrize(
    "rows, momentum, weight",
    [
        ([(1e-13, 1.0, 2.0)], 1.0, 2e-13),
        ([(1e13, 1e13, 1e13)], 1e13, 1e26),
        ([(1.0, 3.0, 1e27), (1.0, 5.0, 1.0)], 4.0, 1e27),
        ([(NAN, 1.0, 2.0)], NAN, NAN),
        ([(1.0, INF, INF)], INF, INF),
        ([(INF, 1.0, 1.0)], NAN, INF),
    ],
)
def test_momentum_and_matrix_of_odd_weights(spark, rows, momentum, weight):
    """Tiny, huge and non-finite weights as floating-point arithmetic has them."""
    arts = _articles(spark, rows)
    got = aggs.momentum(arts).first()
    assert same(got.momentum_score, momentum)
    matrix = aggs.influence_matrix(arts)
    cell = {(r.source, r.target): r.weight for r in matrix.collect()}
    assert same(cell[("US", "EU")], weight) and cell[("EU", "US")] == 0.0
    twice = {(r.source, r.target): r.weight for r in joins.accumulate_matrix(matrix, matrix).collect()}
    assert same(twice[("US", "EU")], 2 * weight)
