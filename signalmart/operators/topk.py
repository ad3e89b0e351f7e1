"""Ordering, limits and per-group top-k.

Global orderings use ``orderBy`` (range-partitioned sort) and global top-k uses
``orderBy().limit(k)`` (TakeOrderedAndProject: each task keeps k rows).  Per-group
top-k keeps at most k rows per group in every task before the shuffle (a
partial window-group limit), so a group holding a third of all rows is never sorted whole inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (a deterministic total order).

    One ``row_number`` window for any k; the optimizer keeps at most k rows per
    group in every task before the shuffle (a partial ``WindowGroupLimit``,
    checked in ``tests/test_plans.py``) up to its own threshold for k.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sort_within_source(df: DataFrame) -> DataFrame:
    """Feed order, then keyword score descending, then entry order (stable)."""
    return df.orderBy("feed_ord", F.desc("score"), "entry_ord")


def rolling_recent(df: DataFrame, as_of: str, ttl_days: int = dims.RECENT_TTL_DAYS, k: int = dims.MAX_RECENT_ARTICLES, order: str = "entry_ord") -> DataFrame:
    """Recent list: date string >= as_of - ttl, newest first, first k (missing date dropped)."""
    cutoff = F.date_format(F.date_sub(F.lit(as_of).cast("date"), ttl_days), "yyyy-MM-dd")
    d = F.coalesce(F.col("date"), F.lit("0000-00-00"))
    return df.where(d >= cutoff).orderBy(F.desc("date"), order).limit(k)


def latest_by_name(df: DataFrame, col: str = "file_name") -> DataFrame:
    """Lexically greatest name (one row)."""
    return df.agg(F.max(col).alias(col))


def top_meetings_per_group(df: DataFrame, k: int | None = 3, name: str = "meeting_dir", group: str = "working_group") -> DataFrame:
    """Newest k meeting folders per group by name, descending (``_99`` sorts above ``_115``)."""
    if k is None:
        return df
    return top_k_per_group(df, [group], [F.desc(name)], k).drop("rank")


def first_report_file(links: DataFrame, qualifies: Column, page: str = "page_id", pos: str = "pos", href: str = "href") -> DataFrame:
    """First qualifying link per page in document order."""
    return links.where(qualifies).groupBy(page).agg(F.min_by(href, pos).alias("report_file"))


def latest_per_region(momentum_rows: DataFrame, order: str | None = None) -> DataFrame:
    """Row with the greatest quarter label per region (first one on ties)."""
    cols = [c for c in momentum_rows.columns if c != "region"]
    key = F.struct(F.col("time_window"), -F.col(order)) if order else F.col("time_window")
    g = momentum_rows.groupBy("region").agg(F.max_by(F.struct(*cols), key).alias("_r"))
    return g.select("region", *[F.col("_r").getField(c).alias(c) for c in cols])


def sort_momentum(df: DataFrame) -> DataFrame:
    return df.orderBy("region", "time_window")


def sort_meetings(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("date"))


__all__ = [
    "top_k_per_group",
    "sort_within_source",
    "rolling_recent",
    "latest_by_name",
    "top_meetings_per_group",
    "first_report_file",
    "latest_per_region",
    "sort_momentum",
    "sort_meetings",
]
