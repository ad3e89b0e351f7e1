"""Set operations and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from .aggs import regions_table


def union_groups(parts: list[DataFrame]) -> DataFrame:
    """Concatenate per-group results; a failed group contributes no rows."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def quarter_labels(start: str, end: str) -> list[str]:
    """The quarters from one day to another, as momentum labels them: a pivot's columns without a job to find them."""
    first, last = (int(d[:4]) * 4 + (int(d[5:7]) - 1) // 3 for d in (start, end))
    return [f"{q // 4}-Q{q % 4 + 1}" for q in range(first, last + 1)]


def pivot_momentum(momentum_rows: DataFrame, quarters: list[str] | None, regions=dims.CANONICAL_REGIONS, value: str = "momentum_score") -> DataFrame:
    """Region x quarter grid (one column per quarter), absent cells null, every region present.

    With ``quarters`` given the pivot needs no extra job; with None Spark first
    finds the distinct quarter labels (a small aggregate: one row per quarter).
    The grid has len(regions) rows.
    """
    rows = momentum_rows.where(F.col("region").isin(list(regions)))
    piv = rows.groupBy("region").pivot("time_window", quarters).agg(F.first(value))
    return regions_table(momentum_rows.sparkSession, regions).select("region", "region_ord").join(F.broadcast(piv), "region", "left")


def grid_long(pivoted: DataFrame, quarters: list[str], value: str = "momentum_score") -> DataFrame:
    """Long form (region, time_window, value) of a pivoted grid."""
    if not quarters:
        return pivoted.select("region", F.lit(None).cast("string").alias("time_window"), F.lit(None).cast("double").alias(value)).limit(0)
    return pivoted.unpivot(["region"], [F.col(f"`{q}`").alias(q) for q in quarters], "time_window", value)


def pivot_matrix(matrix: DataFrame, regions=dims.CANONICAL_REGIONS) -> DataFrame:
    """6 x 6 table: one row per source, one column per target, absent 0, rounded half up."""
    rows = matrix.where(F.col("source").isin(list(regions)))
    piv = rows.groupBy("source").pivot("target", list(regions)).agg(F.first("weight"))
    src = regions_table(matrix.sparkSession, regions).select(F.col("region").alias("source"), "region_ord")
    out = src.join(F.broadcast(piv), "source", "left")
    return out.select(
        "source",
        *[F.floor(F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) + F.lit(0.5)).cast("long").alias(t) for t in regions],
    )


def unpivot_matrix(nested: DataFrame, col: str = "matrix") -> DataFrame:
    """map<source, map<target, weight>> -> long (source, target, weight)."""
    a = nested.select(F.explode(F.col(col)).alias("source", "row"))
    return a.select("source", F.explode("row").alias("target", "weight"))


def nest_matrix(long: DataFrame, col: str = "matrix", regions=dims.CANONICAL_REGIONS) -> DataFrame:
    """Long (source, target, weight) -> one row holding the nested map (sink side).

    Only region pairs are nested, one cell per pair, so the collected map holds
    at most len(regions)^2 cells whatever the input size.
    """
    cells = (
        long.where(F.col("source").isin(list(regions)) & F.col("target").isin(list(regions)))
        .groupBy("source", "target")
        .agg(F.sum("weight").alias("weight"))
    )
    rows = cells.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("target", "weight"))).alias("row"))
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("source", "row"))).alias(col))


def radar_rows(latest: DataFrame) -> DataFrame:
    """Latest row per region -> one (dimension, label, value) row per impact dimension, null -> 0."""
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.lit(l).alias("label"), F.col(d).cast("double").alias("value"))
          for d, l in zip(dims.DIMENSIONS, dims.DIMENSION_LABELS)]
    )
    r = latest.select("region", F.inline(pairs))
    return r.withColumn("value", F.coalesce(F.col("value"), F.lit(0.0)))
