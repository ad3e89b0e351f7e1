"""Row filters and boolean predicates.

Each filter is ``df -> df`` with only built-in predicates, so Catalyst can
push the parts that touch scan columns down to Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalars, text, urls
from ..functions.scalars import _c


def filter_has_link(df: DataFrame, link: str = "link") -> DataFrame:
    return df.where(F.coalesce(F.col(link), F.lit("")) != "")


def is_recent(published, as_of: str, days: int = dims.LOOKBACK_DAYS) -> Column:
    """Published within the look-back; a missing date counts as recent, a future one too."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    p = _c(published)
    return p.isNull() | (p >= cutoff)


def filter_recent(df: DataFrame, as_of: str, days: int = dims.LOOKBACK_DAYS, published: str = "published") -> DataFrame:
    return df.where(is_recent(published, as_of, days))


def passes_relevance(score, bypass=None, threshold: int = dims.RELEVANCE_THRESHOLD) -> Column:
    ok = _c(score) >= threshold
    return ok if bypass is None else (F.coalesce(_c(bypass), F.lit(False)) | ok)


def filter_relevance(df: DataFrame, score: str = "score", bypass: str | None = None, threshold: int = dims.RELEVANCE_THRESHOLD) -> DataFrame:
    return df.where(passes_relevance(score, bypass, threshold))


def gate_passes(ai="ai_insights") -> Column:
    """Enrichment gate: only an explicit false flag rejects; no profile or no flag passes."""
    a = _c(ai)
    return a.isNull() | F.coalesce(a.getField("is_6g_relevant"), F.lit(True))


def gate_profile(df: DataFrame, ai: str = "ai_insights") -> DataFrame:
    return df.where(gate_passes(ai))


def aggregable(ai="ai_insights") -> Column:
    """Aggregates need a profile with the flag explicitly true (a missing flag fails)."""
    a = _c(ai)
    return a.isNotNull() & F.coalesce(a.getField("is_6g_relevant"), F.lit(False))


def filter_aggregable(df: DataFrame, ai: str = "ai_insights") -> DataFrame:
    return df.where(aggregable(ai))


def filter_canonical_region(df: DataFrame, region, regions=dims.CANONICAL_REGIONS) -> DataFrame:
    """Keep rows whose (alias-mapped) region is canonical."""
    return df.where(_c(region).isin(list(regions)))


def filter_positive_target(df: DataFrame, target: str = "target", score: str = "score", regions=dims.CANONICAL_REGIONS) -> DataFrame:
    return df.where(F.col(target).isin(list(regions)) & (F.col(score) > 0))


def filter_release_exact(df: DataFrame, release: str = dims.TARGET_RELEASE, col: str = "release") -> DataFrame:
    return df.where(F.col(col) == release)


def release_is_21(release) -> Column:
    low = F.lower(F.coalesce(_c(release), F.lit("")))
    return text.contains_any(low, dims.RELEASE_21_MARKERS, lower=False)


def filter_release_fuzzy(df: DataFrame, col: str = "release") -> DataFrame:
    return df.where(release_is_21(col))


def is_work_plan_file(href, http_variant: bool = False) -> Column:
    name = urls.file_name(href)
    if http_variant:
        return name.rlike(r"(?i)^Work_plan_3gpp_\d+\.xlsx$")
    return F.lower(name).startswith("work_plan_3gpp_") & F.lower(name).endswith(".xlsx")


def filter_work_plan_files(df: DataFrame, col: str = "href", http_variant: bool = False) -> DataFrame:
    return df.where(is_work_plan_file(col, http_variant))


def filter_meeting_dirs(df: DataFrame, col: str = "href") -> DataFrame:
    """Directory links like ``TSGR1_115/`` (anchored at the start only, as ``re.match``)."""
    return df.where(F.col(col).rlike(r"^TSG[RS]\d+_\d+/"))


def is_report_file(href) -> Column:
    low = F.lower(_c(href))
    return low.rlike(r"\.htm|\.html|\.doc|\.pdf") & low.rlike(r"report|summary|final")


def filter_report_files(df: DataFrame, col: str = "href") -> DataFrame:
    return df.where(is_report_file(col))


def content_kind(name) -> Column:
    return F.when(F.lower(_c(name)).rlike(r"\.htm|\.html"), F.lit("html")).otherwise(F.lit("text"))


def fetch_is_html(content) -> Column:
    """Body is a bot-wall or an HTML page where a feed was expected."""
    return scalars.let(
        F.lower(F.coalesce(_c(content), F.lit(""))),
        lambda low: low.contains("incapsula")
        | low.contains("cloudflare")
        | (low.contains("<html") & ~F.substring(low, 1, 100).contains("<?xml")),
    )


def fetch_needs_fallback(status_code, error, success, content) -> Column:
    err = F.lower(F.coalesce(_c(error), F.lit("")))
    return (
        _c(status_code).isin(403, 429)
        | err.contains("bot")
        | err.contains("cloudflare")
        | (F.coalesce(_c(success), F.lit(False)) & fetch_is_html(content))
    )


def fetch_is_blocked(content) -> Column:
    return text.contains_any(F.coalesce(_c(content), F.lit("")), dims.BLOCK_PHRASES, lower=True)


def evict_stale(df: DataFrame, as_of: str, ttl_days: int = dims.CACHE_TTL_DAYS, col: str = "processed_date") -> DataFrame:
    """Drop cache rows older than the TTL; unparseable or missing dates are kept."""
    age = F.datediff(F.lit(as_of).cast("date"), scalars.parse_iso_date(col))
    return df.where(F.coalesce(age <= ttl_days, F.lit(True)))


def search_dashboard(df: DataFrame, term: str = "", source: str | None = None) -> DataFrame:
    """Dashboard search: optional source equality and a term in title, summary or topics."""
    out = df
    if source is not None and source != "all":
        out = out.where(F.col("source") == source)
    term = (term or "").lower()
    if term:
        ai = F.col("ai_insights")
        ai_sum = ai.getField("summary")
        summary = F.when(ai.isNotNull() & F.coalesce(ai_sum, F.lit("")).__ne__(""), ai_sum).otherwise(
            F.coalesce(F.col("summary"), F.lit(""))
        )
        topics = F.coalesce(F.array_join(ai.getField("6g_topics"), " "), F.lit(""))
        t = F.lit(term)
        out = out.where(
            F.contains(F.lower(F.coalesce(F.col("title"), F.lit(""))), t)
            | F.contains(F.lower(summary), t)
            | F.contains(F.lower(topics), t)
        )
    return out
