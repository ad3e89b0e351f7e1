"""The parameterised queries as DataFrame functions.

Argument checks happen on the driver (they are parameters, not data); the
filters themselves are Catalyst predicates over the articles table, so nested
profile fields are pruned down to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalars
from ..operators import aggs, standards

VALID_REGIONS = set(dims.CANONICAL_REGIONS)


def _importance():
    ai = F.col("ai_insights")
    return F.coalesce(ai.getField("overall_6g_importance"), F.lit(0.0))


def latest_news(articles: DataFrame, min_importance: int = 5, region: str | None = None) -> DataFrame:
    """Articles with importance >= min (missing = 0), optionally of one profile region (no aliasing)."""
    m = scalars.clamp(min_importance)
    if region is not None and region not in VALID_REGIONS:
        raise ValueError(f"Invalid region '{region}'. Must be one of: {sorted(VALID_REGIONS)}")
    out = articles.withColumn("importance", _importance()).where(F.col("importance") >= m)
    if region:
        out = out.where(F.col("ai_insights").getField("source_region") == region)
    return out


def release_status(totals: DataFrame, as_of: str, data_source: str = "live") -> DataFrame:
    return standards.release_status(totals, as_of, data_source)


def recent_meetings(meetings: DataFrame, working_group: str | None = None) -> DataFrame:
    return standards.recent_meetings(meetings, working_group)


def search_topics(articles: DataFrame, topic: str, min_importance: int = 0, order: str = "entry_ord") -> DataFrame:
    """Articles whose topics / concepts / title / summary contain the term; importance desc (stable)."""
    t = F.lit(scalars.clean_topic(topic))
    m = scalars.clamp(min_importance)
    ai = F.col("ai_insights")

    def in_list(field):
        return F.coalesce(F.exists(ai.getField(field), lambda x: F.contains(F.lower(x), t)), F.lit(False))

    hit = (
        in_list("6g_topics")
        | in_list("emerging_concepts")
        | F.contains(F.lower(F.coalesce(F.col("title"), F.lit(""))), t)
        | F.contains(F.lower(F.coalesce(F.col("summary"), F.lit(""))), t)
    )
    out = articles.withColumn("importance", _importance()).where(hit & (F.col("importance") >= m))
    return out.orderBy(F.desc("importance"), order)


def regional_momentum(articles: DataFrame, date: str) -> DataFrame:
    """Per region: total, mentions, average, plus the leader and the digest date.

    The regional table has exactly one row per canonical region, so the leader
    is taken over a fixed six-row frame.
    """
    reg = aggs.regional_momentum(articles)
    w = Window.partitionBy()
    any_score = F.max(F.col("total_score") != 0).over(w)
    lead = F.max_by("region", F.struct(F.col("total_score"), -F.col("leader_ord"))).over(w)
    return reg.select(
        "region", "total_score", "article_mentions", "average_impact",
        F.when(any_score, lead).otherwise(F.lit("None")).alias("leader"),
        F.lit(date).alias("date"),
    )


def emerging_concepts(articles: DataFrame, min_frequency: int = 2) -> DataFrame:
    return aggs.concept_counts(articles, min_frequency)
