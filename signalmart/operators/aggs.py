"""Aggregations.

All of them are aggregates with a partial (map-side) phase, so a key that
holds a third of the rows is pre-combined in every task before the shuffle and
never lands whole in one task (what is joined back to its rows goes through
``joins.join_aggregate``).  Results keyed by canonical regions are bounded
(6 x 6, 6 x quarters) by construction; only those are joined with broadcast
dimension tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import exact, scalars
from ..functions.scalars import _c
from . import filters

# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------


EXACT_TYPE = "decimal(38,12)"


def exact_units(x) -> Column:
    """A term as an exact decimal with 12 places (for streaming sums of terms between 1e-12 and 1e26)."""
    return _c(x).cast("double").cast(EXACT_TYPE)


def exact_sum(x) -> Column:
    """Order-independent sum as a plain aggregate, for terms between 1e-12 and 1e26; ``exact.sums`` takes any doubles."""
    return F.sum(exact_units(x)).cast("double")


def mean_of(num, den, digits: int = 2) -> Column:
    """round(num/den, digits); 0 when den is 0 (Python would divide by zero)."""
    num, den = _c(num).cast("double"), _c(den).cast("double")
    return F.coalesce(scalars.py_round(F.try_divide(num, F.when(den != 0, den)), digits), F.lit(0.0))


def weighted_mean(value, weight, digits: int = 2) -> Column:
    """round(sum(v*w)/sum(w), digits) as a plain aggregate, with the range of ``exact_sum``."""
    return mean_of(exact_sum(_c(value) * _c(weight)), exact_sum(weight), digits)


def region_grid(spark, regions=dims.CANONICAL_REGIONS) -> DataFrame:
    """All (source, target) pairs of the region list, built from a literal array (no join)."""
    pairs = [F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(i).alias("src_ord"), F.lit(j).alias("tgt_ord"))
             for i, s in enumerate(regions) for j, t in enumerate(regions)]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def regions_table(spark, regions=dims.CANONICAL_REGIONS) -> DataFrame:
    rows = [F.struct(F.lit(r).alias("region"), F.lit(i).alias("region_ord"),
                     F.lit(dims.LEADER_ORDER.index(r) if r in dims.LEADER_ORDER else i).alias("leader_ord"))
            for i, r in enumerate(regions)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def attributed(df: DataFrame, regions=dims.CANONICAL_REGIONS, ai: str = "ai_insights", normalize: bool = True) -> DataFrame:
    """Aggregable articles with their canonical source region in ``src_region``."""
    raw = F.col(ai).getField("source_region")
    region = scalars.normalize_region(raw) if normalize else raw
    return filters.filter_aggregable(df, ai).withColumn("src_region", region).where(F.col("src_region").isin(list(regions)))


# ---------------------------------------------------------------------------
# momentum
# ---------------------------------------------------------------------------


QUARTER = ["region", "time_window"]
MOMENTUM_TERMS = ["w", "m", *dims.DIMENSIONS]


def momentum_sums(df: DataFrame, regions=dims.CANONICAL_REGIONS, ai: str = "ai_insights", date: str = "date", normalize: bool = True) -> DataFrame:
    """Per (region, quarter) the exact sums that momentum is made of: of the weights, and of m and each dimension times the weight.

    Binned sums (``exact``): those of batches add up to those of all their articles.
    """
    a = F.col(ai)
    dmap = a.getField("impact_dimensions")
    rows = attributed(df, regions, ai, normalize).select(
        F.col("src_region").alias("region"),
        scalars.quarter_label(F.col(date)).alias("time_window"),
        F.coalesce(a.getField("overall_6g_importance"), F.lit(1.0)).alias("w"),
        scalars.mean_numeric_map(dmap, dims.DIMENSIONS).alias("m"),
        *[F.coalesce(F.element_at(dmap, F.lit(k)), F.lit(0.0)).alias(k) for k in dims.DIMENSIONS],
    )
    return exact.binned_sums(rows, QUARTER, {"w": F.col("w")} | {n: F.col(n) * F.col("w") for n in MOMENTUM_TERMS[1:]})


def momentum_of_sums(binned: DataFrame) -> DataFrame:
    """Momentum rows from the ``momentum_sums`` of all articles."""
    g = exact.doubles(binned, QUARTER, MOMENTUM_TERMS)
    means = F.transform(F.array(*MOMENTUM_TERMS[1:]), lambda total: mean_of(total, "w"))
    names = ["momentum_score", *dims.DIMENSIONS]
    return g.select(*QUARTER, means.alias("_means")).select(*QUARTER, *(F.get("_means", i).alias(n) for i, n in enumerate(names)))


def momentum(df: DataFrame, regions=dims.CANONICAL_REGIONS, ai: str = "ai_insights", date: str = "date", normalize: bool = True) -> DataFrame:
    """Importance-weighted quarterly momentum per canonical region.

    Per article: m = mean of the numeric impact dimensions (0 if none),
    w = importance (1 if missing); per (region, quarter): round(sum(m*w)/sum(w), 2)
    and the same for each of the five dimensions (missing dimension = 0).
    """
    return momentum_of_sums(momentum_sums(df, regions, ai, date, normalize))


# ---------------------------------------------------------------------------
# influence matrix
# ---------------------------------------------------------------------------


def influence_pairs(df: DataFrame, regions=dims.CANONICAL_REGIONS, ai: str = "ai_insights", normalize: bool = True) -> DataFrame:
    """(source, target, contribution) per article x positive canonical target."""
    a = F.col(ai)
    rows = attributed(df, regions, ai, normalize).select(
        F.col("src_region").alias("source"),
        F.coalesce(a.getField("overall_6g_importance"), F.lit(1.0)).alias("w"),
        F.explode(a.getField("world_power_impact")).alias("target_raw", "score"),
    )
    tgt = scalars.normalize_region(F.col("target_raw")) if normalize else F.col("target_raw")
    rows = rows.withColumn("target", tgt)
    rows = filters.filter_positive_target(rows, "target", "score", regions)
    return rows.select("source", "target", (F.col("score") * F.col("w")).alias("contribution"))


def matrix_densify(matrix: DataFrame, regions=dims.CANONICAL_REGIONS, value: str = "weight") -> DataFrame:
    """Every source x target pair of the region list, absent pairs = 0.

    ``matrix`` is keyed by canonical regions, so it holds at most len(regions)^2
    rows: broadcasting it is bounded by the region list, not by the data.
    """
    grid = region_grid(matrix.sparkSession, regions)
    # at most one row per region pair goes to the broadcast side: its size is
    # bounded by len(regions)^2 whatever the input holds
    m = F.broadcast(
        matrix.where(F.col("source").isin(list(regions)) & F.col("target").isin(list(regions)))
        .groupBy("source", "target")
        .agg(F.sum(value).alias(value))
    )
    return grid.join(m, ["source", "target"], "left").select(
        "source", "target", F.coalesce(F.col(value), F.lit(0.0)).alias(value)
    )


PAIR = ["source", "target"]


def influence_sums(df: DataFrame, regions=dims.CANONICAL_REGIONS, ai: str = "ai_insights", normalize: bool = True) -> DataFrame:
    """The matrix as binned sums (``exact``), present pairs only: those of batches add up."""
    return exact.binned_sums(influence_pairs(df, regions, ai, normalize), PAIR, {"weight": F.col("contribution")})


def influence_matrix(df: DataFrame, regions=dims.CANONICAL_REGIONS, ai: str = "ai_insights", normalize: bool = True) -> DataFrame:
    """Dense source -> target matrix of sum(score x importance), positive canonical targets only."""
    sums = exact.doubles(influence_sums(df, regions, ai, normalize), PAIR, ["weight"])
    return matrix_densify(sums, regions)


def region_article_counts(df: DataFrame, regions=dims.CANONICAL_REGIONS, ai: str = "ai_insights") -> DataFrame:
    """Articles attributed per canonical source region; zero rows shown."""
    counts = attributed(df, regions, ai).groupBy(F.col("src_region").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    return regions_table(df.sparkSession, regions).join(F.broadcast(counts), "region", "left").select(
        "region", F.coalesce("n", F.lit(0)).cast("long").alias("article_count")
    )


# ---------------------------------------------------------------------------
# query-API regional momentum
# ---------------------------------------------------------------------------


def regional_momentum(df: DataFrame, regions=dims.CANONICAL_REGIONS, ai: str = "ai_insights") -> DataFrame:
    """Per region: total score, mentions (score > 0), average; exact key match, no relevance filter."""
    a = F.col(ai)
    scores = df.select(F.explode(F.coalesce(a.getField("world_power_impact"), F.create_map().cast("map<string,double>"))).alias("region", "score"))
    scores = scores.where(F.col("region").isin(list(regions)))
    agg = exact.sums(scores, ["region"], {"total_score": F.col("score"), "article_mentions": (F.col("score") > 0).cast("double")})
    out = regions_table(df.sparkSession, regions).join(F.broadcast(agg), "region", "left")
    total = F.coalesce(F.col("total_score"), F.lit(0.0))
    cnt = F.coalesce(F.col("article_mentions"), F.lit(0)).cast("long")
    return out.select(
        "region",
        "leader_ord",
        total.alias("total_score"),
        cnt.alias("article_mentions"),
        F.when(cnt > 0, scalars.py_round(total / cnt, 2)).otherwise(F.lit(0.0)).alias("average_impact"),
    )


def regional_leader(regional: DataFrame) -> DataFrame:
    """One row: region with the greatest total (ties -> leader order), 'None' if all totals are 0."""
    return regional.agg(
        F.when(
            F.bool_or(F.col("total_score") != 0),
            F.max_by("region", F.struct(F.col("total_score"), -F.col("leader_ord"))),
        ).otherwise(F.lit("None")).alias("leader")
    )


# ---------------------------------------------------------------------------
# term counts
# ---------------------------------------------------------------------------


def _terms(df: DataFrame, field: str, ai: str = "ai_insights", order: str = "entry_ord") -> DataFrame:
    a = F.col(ai)
    return df.where(a.isNotNull()).select(
        F.col(order).alias("article_ord"), F.posexplode(a.getField(field)).alias("pos", "term")
    )


def term_counts(df: DataFrame, field: str, ai: str = "ai_insights", order: str = "entry_ord") -> DataFrame:
    """(term, frequency, first_seen) where first_seen orders ties by first appearance."""
    return _terms(df, field, ai, order).groupBy("term").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.min(F.struct("article_ord", "pos")).alias("first_seen"),
    )


def concept_counts(df: DataFrame, min_frequency: int = 2, ai: str = "ai_insights", order: str = "entry_ord") -> DataFrame:
    """Concepts appearing at least ``min_frequency`` times, most frequent first (ties by first appearance)."""
    c = term_counts(df, "emerging_concepts", ai, order).where(F.col("frequency") >= min_frequency)
    return c.orderBy(F.desc("frequency"), "first_seen").select(F.col("term").alias("concept"), "frequency")


def topic_frequency(df: DataFrame, k: int = 8, ai: str = "ai_insights", order: str = "entry_ord") -> DataFrame:
    """Top-k topics by count (the chart's top 8); ties by first appearance."""
    c = term_counts(df, "6g_topics", ai, order)
    return c.orderBy(F.desc("frequency"), "first_seen").limit(k).select(F.col("term").alias("topic"), "frequency")


def distinct_concepts(df: DataFrame, ai: str = "ai_insights") -> DataFrame:
    a = F.col(ai)
    return df.where(a.isNotNull()).select(F.explode(a.getField("emerging_concepts")).alias("concept")).distinct()


def evidence_flat(df: DataFrame, ai: str = "ai_insights", order: str = "entry_ord") -> DataFrame:
    return _terms(df, "key_evidence", ai, order).withColumnRenamed("term", "evidence")


def distinct_sources(df: DataFrame) -> DataFrame:
    return df.select("source").distinct()


def is_quiet(df: DataFrame) -> DataFrame:
    """Whether there is no row: one row at most is read on."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_quiet"))


# ---------------------------------------------------------------------------
# work items
# ---------------------------------------------------------------------------


def work_item_rollup(items: DataFrame, status: str = "status", group: str = "working_group") -> DataFrame:
    """Totals and per-group counts in one pass: GROUPING SETS ((), (group)).

    ``level`` is 'total' for the overall row and 'group' for per-group rows.
    Status values are matched case-insensitively (completed / postponed / other).
    """
    st = F.lower(F.col(status))
    done = st == "completed"
    post = ~done & (st.contains("postpone") | st.contains("delay") | st.contains("suspend"))
    agg = items.groupingSets([[], [group]], group).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("completed"),
        F.count_if(~done & ~post).alias("in_progress"),
        F.count_if(post).alias("postponed"),
    )
    return agg.select(
        F.when(F.col("gid") == 1, "total").otherwise("group").alias("level"),
        F.col(group).alias("working_group"),
        F.col("total").cast("long").alias("total"),
        F.col("completed").cast("long").alias("completed"),
        F.col("in_progress").cast("long").alias("in_progress"),
        F.col("postponed").cast("long").alias("postponed"),
        F.when(F.col("total") > 0, scalars.py_round(F.col("completed") / F.col("total") * 100.0, 1)).otherwise(F.lit(0.0)).alias("progress"),
    )


# ---------------------------------------------------------------------------
# snapshots, run metrics, fetch log
# ---------------------------------------------------------------------------


def outbound_influence(snapshots: DataFrame) -> DataFrame:
    """Row sum per source region per snapshot date (the snapshots are dense, so a missing row is 0)."""
    return exact.sums(snapshots, ["date", "source"], {"outbound": F.col("weight")})


def progress_series(std_snapshots: DataFrame) -> DataFrame:
    return std_snapshots.select("date", F.coalesce(F.col("progress_percentage"), F.lit(0.0)).alias("progress")).orderBy("date")


def run_metrics(fetched: DataFrame, new_articles: DataFrame) -> DataFrame:
    """Per source and overall (source null): fetched entries and new articles kept."""
    f = fetched.select("source", F.lit(1).alias("fetched"), F.lit(0).alias("kept"))
    n = new_articles.select("source", F.lit(0).alias("fetched"), F.lit(1).alias("kept"))
    return (
        f.unionByName(n)
        .rollup("source")
        .agg(F.sum("fetched").cast("long").alias("fetched_entries"), F.sum("kept").cast("long").alias("new_articles"))
    )


def run_metrics_of(flagged: DataFrame) -> DataFrame:
    """``run_metrics`` in one pass over all entries (source, article_id, feed_ord, gated).

    ``gated`` marks the entries that pass all filters and the gate.  Counts are
    taken per source, url and feed first; the first feed per url then decides over these few rows, so
    neither the entries nor the pipeline behind them are read twice.
    """
    last = F.lit((1 << 31) - 1)
    feed = F.coalesce(F.col("feed_ord"), last).alias("feed")
    per = flagged.groupBy("source", "article_id", feed).agg(F.count(F.lit(1)).alias("n"), F.count_if("gated").alias("g"))
    first = F.min(F.when(F.col("g") > 0, F.col("feed"))).over(Window.partitionBy("article_id"))
    kept = F.when(F.col("feed") == first, F.col("g")).otherwise(0)
    return per.select("source", "n", kept.alias("kept")).rollup("source").agg(
        F.sum("n").cast("long").alias("fetched_entries"), F.sum("kept").cast("long").alias("new_articles")
    )


def domain_best_method(log: DataFrame, url: str = "url") -> DataFrame:
    """Latest successful fetch method per domain (the method cache)."""
    from ..functions import urls

    return (
        log.where(F.col("success"))
        .groupBy(urls.url_domain(F.col(url)).alias("domain"))
        .agg(F.max_by("method_used", "fetched_at").alias("method"))
    )


def feed_health(registry: DataFrame, entries: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Status per registered feed: ok / empty (no usable entry) / missing (nothing read).

    With ``documents`` (``feeds.scan_feed_documents``), a document that isn't
    well-formed is told apart: ``error`` if it gave no entries (such a feed is
    dropped from the run), ``ok_with_error`` if some could be read; a sound
    document without entries is ``empty``, a feed without a document ``missing``.
    """
    per = entries.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(F.coalesce(F.col("link"), F.lit("")) != "").alias("n_with_link"),
    )
    # the registry is small and fixed; the aggregates have one row per source
    j = registry.join(per, "source", "left")
    n = F.coalesce(F.col("n_entries"), F.lit(0)).cast("long")
    w = F.coalesce(F.col("n_with_link"), F.lit(0)).cast("long")
    status = F.when(n == 0, "missing").when(w == 0, "empty").otherwise("ok")
    if documents is not None:
        read = documents.groupBy("source").agg(F.bool_or("parse_error").alias("parse_error"))
        j = j.join(read, "source", "left")
        wrong = F.coalesce(F.col("parse_error"), F.lit(False))
        status = (
            F.when(F.col("parse_error").isNull() & (n == 0), "missing")
            .when(wrong & (n == 0), "error")
            .when(wrong & (w > 0), "ok_with_error")
            .when(w == 0, "empty")
            .otherwise("ok")
        )
    return j.select("source", n.alias("n_entries"), w.alias("n_with_link"), status.alias("status"))


def briefing_context(articles: DataFrame, totals: DataFrame, k: int = 5, ai: str = "ai_insights") -> DataFrame:
    """One row: article count, top-k topics (by frequency, then name) and progress %.

    Three one-row aggregates combined by a union and a final global aggregate
    (no join); the topic list holds at most ``k`` names.
    """
    a = F.col(ai)
    n = articles.agg(F.count(F.lit(1)).alias("article_count"))
    topics = (
        articles.where(a.isNotNull())
        .select(F.explode(a.getField("6g_topics")).alias("topic"))
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("c"))
        .orderBy(F.desc("c"), "topic")
        .limit(k)
        .agg(F.sort_array(F.collect_list(F.struct(-F.col("c"), F.col("topic")))).alias("ranked"))
        .select(F.array_join(F.transform("ranked", lambda s: s.getField("topic")), ", ").alias("top_topics"))
    )
    prog = totals.where(F.col("level") == "total").select(F.col("progress").alias("progress_percentage"))
    u = n.unionByName(topics, allowMissingColumns=True).unionByName(prog, allowMissingColumns=True)
    return u.agg(
        F.coalesce(F.max("article_count"), F.lit(0)).cast("long").alias("article_count"),
        F.coalesce(F.max("top_topics"), F.lit("")).alias("top_topics"),
        F.coalesce(F.max("progress_percentage"), F.lit(0.0)).alias("progress_percentage"),
    )
