"""Joins and state merges.

Lookups (languages, aliases, seen cache, profiles, prior state) are plain
equi-joins: sort-merge by default, turned into broadcasts by AQE only once the
build side's measured size is small; AQE also splits skewed partitions.
Upserts without a MERGE-capable table format are written as union + a
keyed ``max_by`` aggregate, which pre-aggregates in every task and so stays
safe when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import exact, scalars


def join_aggregate(df: DataFrame, per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``df`` joined to an aggregate of one row per ``key`` (its first column), so that a hot key's rows can be split.

    An aggregate arrives partitioned by its key; joined on it as it is, its stage can't be
    split, and all rows of a hot key meet in one task.  Joined on a derived key, both
    sides are plain shuffles (the aggregate's is narrow), whose skewed partitions adaptive
    execution splits.  Null keys match each other.
    """
    first = per_key.columns[0]

    def derived(col: str):
        return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))

    return df.withColumn("_derived", derived(key)).join(per_key.withColumn("_derived", derived(first)).drop(first), "_derived", how).drop("_derived")


def anti_seen(entries: DataFrame, seen: DataFrame, key: str = "article_id") -> DataFrame:
    """Entries whose url hash is not in the seen cache."""
    return entries.join(seen.select(key), key, "left_anti")


def dedup_cross_feed(df: DataFrame, key: str = "article_id", feed_ord: str = "feed_ord") -> DataFrame:
    """Drop a url already taken by an earlier feed; repeats inside one feed survive.

    A null feed number (an unregistered feed) counts as the last feed.  The first
    feed per key is a partial aggregate over two narrow columns, joined back by
    ``join_aggregate``; callers with a costly input write it out first, since it is read
    twice.
    """
    last = F.lit((1 << 31) - 1)
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.coalesce(F.col(feed_ord), last)).alias("_first_feed"))
    kept = join_aggregate(df, first, key).where(F.coalesce(F.col(feed_ord), last) == F.col("_first_feed"))
    return kept.select(*df.columns)


def bypass_lookup(df: DataFrame, languages: DataFrame, key: str = "source", out: str = "bypass") -> DataFrame:
    """Flag rows whose ``key`` is registered in the language table; its measured size decides how it is joined."""
    lang = languages.select(F.col(languages.columns[0]).alias(key)).distinct().withColumn(out, F.lit(True))
    return df.join(lang, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def enrich_join(candidates: DataFrame, responses: DataFrame, key: str = "entry_ord") -> DataFrame:
    """Attach the profile returned for each candidate; candidates without a profile are kept."""
    return candidates.join(responses, key, "left")


def alias_lookup(df: DataFrame, aliases: DataFrame, col: str, out: str) -> DataFrame:
    """Region alias mapping as a left join, for alias tables too big for a literal map.

    One region per alias (the smallest, should an alias be listed twice); the
    alias table's measured size decides how it is joined.
    """
    a = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("region").alias("_canon"))
    raw = F.col(col)
    j = df.join(a, F.lower(scalars.py_strip(raw)) == F.col("_alias"), "left")
    mapped = (
        F.when(raw.isNull() | (raw == ""), raw)
        .when(raw.isin(dims.CANONICAL_REGIONS), raw)
        .otherwise(F.coalesce(F.col("_canon"), raw))
    )
    return j.withColumn(out, mapped).drop("_alias", "_canon")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace old rows with the same key as a whole; old-only rows are kept.

    Within one side, the row with the greatest ``order`` wins (the later one).
    Written as union + ``max_by`` over a precedence struct: one shuffle on the
    keys, with a partial aggregate before it.
    """
    cols = [c for c in new.columns]
    o = F.col(order) if order else F.lit(0)
    tagged = old.select(*cols, F.struct(F.lit(0).alias("side"), o.alias("ord")).alias("_prec")).unionByName(
        new.select(*cols, F.struct(F.lit(1).alias("side"), o.alias("ord")).alias("_prec"))
    )
    rest = [c for c in cols if c not in keys]
    win = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_prec")).alias("_row"))
    return win.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])


def upsert_momentum(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["region", "time_window"])


def accumulate_matrix(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cumulative matrix: old + new per (source, target); running twice adds twice."""
    u = old.select("source", "target", "weight").unionByName(new.select("source", "target", "weight"))
    return exact.sums(u, ["source", "target"], {"weight": F.col("weight")})


def upsert_recent(old: DataFrame, new: DataFrame, key: str = "article_id", order: str = "entry_ord") -> DataFrame:
    """Merge by article id, newer wins; rows without an id are dropped."""
    return upsert(old.where(F.col(key).isNotNull()), new.where(F.col(key).isNotNull()), [key], order)


def append_snapshot_if_absent(history: DataFrame, snapshot: DataFrame, key: str = "date") -> DataFrame:
    """Append the snapshot rows whose date is not in the history yet (idempotent by date)."""
    add = snapshot.join(history.select(key).distinct(), key, "left_anti")
    return history.unionByName(add.select(*history.columns))


def fallback_if_empty(primary: DataFrame, fallback: DataFrame, primary_tag: str = "live", fallback_tag: str = "cached", tag: str = "data_source") -> DataFrame:
    """Primary rows if there are any, else the fallback rows; tagged with their origin.

    Lazy and join-free: "is there a primary row?" is a scalar subquery over
    ``primary.limit(1)`` (Spark runs it once, reading at most one row), and the
    fallback rows are kept only when it is 0.  No action runs on the driver.
    """
    has_primary = primary.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    fb = fallback.where(has_primary == 0)
    return primary.withColumn(tag, F.lit(primary_tag)).unionByName(fb.withColumn(tag, F.lit(fallback_tag)))


def matrix_as_of(snapshots: DataFrame, current: DataFrame, date: str) -> DataFrame:
    """Matrix of the snapshot taken on ``date``, else the current matrix."""
    snap = snapshots.where(F.col("date") == date).select("source", "target", "weight")
    return fallback_if_empty(snap, current.select("source", "target", "weight"), "snapshot", "current", "origin")


def discover_new_sources(hits: DataFrame, known: DataFrame, discovered_at: str, order=("page_id", "pos")) -> DataFrame:
    """Search hits whose url is non-empty and not known yet; the first hit of a url wins."""
    h = hits.where(F.coalesce(F.col("url"), F.lit("")) != "")
    h = h.join(known.select("url").distinct(), "url", "left_anti")
    first = h.groupBy("url").agg(F.min_by(F.struct("title", "snippet"), F.struct(*order)).alias("_hit"))
    return first.select(
        "url",
        F.col("_hit.title").alias("title"),
        F.lit(discovered_at).alias("discovered_at"),
        F.substring(F.coalesce(F.col("_hit.snippet"), F.lit("")), 1, dims.SUMMARY_CUT).alias("relevance_snippet"),
    )
