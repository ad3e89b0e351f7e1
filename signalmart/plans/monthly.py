"""The monthly batch as one Spark job.

Feed entries -> cheap filters (link, seen cache, look-back, keyword score) ->
enrichment (profile join or ``enrich_with``) -> gate -> cross-feed de-dup ->
portable articles -> state folds (recent list, momentum, matrix, snapshots,
seen cache) -> sinks.  Each step is a DataFrame function; the whole run is one
lineage with a write action per sink.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalars, text, urls
from ..operators import aggs, filters, joins, standards, topk
from ..session import discard, materialize
from ..sources import commits, sinks, state


def keyword_candidates(entries: DataFrame, as_of: str, seen: DataFrame | None = None, languages: DataFrame | None = None, bloom: bool = False) -> DataFrame:
    """Entries that reach enrichment: link present, not seen, recent, keyword score (or bypass).

    The cheap row-local predicates run first, in the scan's stage.  The seen cache
    comes before the scoring: its Bloom filter lets surely new entries pass within
    the same stage, and only what may be seen is shuffled for the exact anti-join.
    """
    e = filters.filter_has_link(entries).withColumn("article_id", urls.url_hash("link"))
    e = filters.filter_recent(e, as_of)
    if bloom and seen is not None:
        e = commits.anti_seen(e, seen)
    e = e.withColumn("score", text.relevance_score("title", "summary"))
    if languages is not None:
        e = filters.filter_relevance(joins.bypass_lookup(e, languages, "source"), "score", "bypass")
    else:
        e = filters.filter_relevance(e)
    if seen is not None and not bloom:
        e = joins.anti_seen(e, seen)
    return e


def gated_articles(entries: DataFrame, seen: DataFrame | None, responses: DataFrame, as_of: str, languages: DataFrame | None = None, key: str = "entry_ord", bloom: bool = False) -> DataFrame:
    """Candidates with their profile (joined on ``key``) that pass the gate; ``responses`` has at most one profile per key."""
    cands = keyword_candidates(entries, as_of, seen, languages, bloom)
    return filters.gate_profile(joins.enrich_join(cands, responses.select(key, "ai_insights"), key))


def flagged_entries(entries: DataFrame, seen: DataFrame, responses: DataFrame, as_of: str, key: str = "entry_ord") -> DataFrame:
    """All entries as (source, article_id, feed_ord, gated), in one pass: what ``aggs.run_metrics_of`` counts.

    ``responses`` has at most one profile per key, ``seen`` may repeat ids.
    """
    e = entries.withColumn("article_id", F.when(F.coalesce(F.col("link"), F.lit("")) != "", urls.url_hash("link")))
    passes = F.col("article_id").isNotNull() & filters.is_recent("published", as_of) & filters.passes_relevance(text.relevance_score("title", "summary"))
    rows = e.select("source", "feed_ord", "article_id", *({key} - {"source", "feed_ord", "article_id"}), F.coalesce(passes, F.lit(False)).alias("passes"))
    known = seen.select(F.col("article_id").alias("_seen")).distinct()
    profiles = responses.select(key, filters.gate_passes("ai_insights").alias("gate"))
    rows = rows.join(known, F.col("article_id") == F.col("_seen"), "left").join(profiles, key, "left")
    gated = F.col("passes") & F.col("_seen").isNull() & F.coalesce(F.col("gate"), F.lit(True))
    return rows.select("source", "article_id", "feed_ord", gated.alias("gated"))


def new_articles(entries: DataFrame, seen: DataFrame | None, responses: DataFrame, as_of: str, languages: DataFrame | None = None, key: str = "entry_ord") -> DataFrame:
    """Accepted articles of this run: gated candidates after cross-feed de-dup."""
    return joins.dedup_cross_feed(gated_articles(entries, seen, responses, as_of, languages, key))


def digest_candidates(articles: DataFrame, as_of: str) -> DataFrame:
    """Digest population of the registered query: link, look-back, keyword threshold, gate."""
    a = filters.filter_has_link(articles)
    a = filters.filter_recent(a, as_of)
    a = filters.filter_relevance(a)
    return filters.gate_profile(a)


def article_project(df: DataFrame, run_date: str | None = None) -> DataFrame:
    """Portable M2 row: id, source, title, link, score, profile (+impact score), region, summary, date."""
    ai = F.col("ai_insights")
    date = scalars.pub_date("published", run_date) if run_date else F.col("date")
    return df.select(
        urls.url_hash("link").alias("article_id"),
        "source",
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        "link",
        F.coalesce(F.col("score"), F.lit(0)).alias("score"),
        scalars.with_impact_score(ai).alias("ai_insights"),
        F.when(ai.isNull(), F.lit("Other")).otherwise(F.coalesce(ai.getField("source_region"), F.lit("Other"))).alias("source_region"),
        F.coalesce(F.col("summary"), F.lit("")).alias("summary"),
        date.alias("date"),
    )


def digest_lines(kept: DataFrame, existing_links: DataFrame, run_date: str, existing_headers: DataFrame | None = None) -> DataFrame:
    """Markdown digest as rows (source, feed_ord, score, entry_ord, line_no, line).

    One header per source (unless ``existing_headers`` already holds it), then
    per article: title/link, score line, summary, rule.  Links already in the
    existing digest are skipped (anti-join on the link).  Ordering keys stay as
    columns; ``write_digest_text`` sorts once.
    """
    ai = F.col("ai_insights")
    score = F.coalesce(F.col("score"), F.lit(0))
    score_str = F.when(
        ai.isNotNull(),
        F.concat(score.cast("string"), F.lit(" (AI Impact: "), F.coalesce(ai.getField("impact_score").cast("string"), F.lit("N/A")), F.lit(")")),
    ).otherwise(score.cast("string"))
    pub = F.when(F.col("published").isNotNull(), F.concat(F.lit(" | 📅 "), F.date_format("published", "yyyy-MM-dd"))).otherwise(F.lit(""))
    summ = F.when(ai.isNotNull(), F.coalesce(ai.getField("summary"), text.truncate_text("summary"))).otherwise(text.truncate_text("summary"))
    title = F.coalesce(F.col("title"), F.lit("No Title"))
    link = F.coalesce(F.col("link"), F.lit("#"))
    # no distinct below an anti-join: a hot link's rows can then be split
    body = kept.join(existing_links.select("link"), "link", "left_anti")
    lines = F.array(
        F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("### ["), title, F.lit("]("), link, F.lit(")")).alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.concat(F.lit("> **Relevance Score:** "), score_str, pub).alias("line")),
        F.struct(F.lit(3).alias("line_no"), summ.alias("line")),
        F.struct(F.lit(4).alias("line_no"), F.lit("---").alias("line")),
    )
    art = body.select("source", "feed_ord", score.alias("score"), "entry_ord", F.inline(lines))
    art = art.where(~((F.col("line_no") == 3) & (F.coalesce(F.col("line"), F.lit("")) == "")))
    hdr = kept.groupBy("source").agg(F.min("feed_ord").alias("feed_ord")).select(
        "source", "feed_ord", F.lit(None).cast("int").alias("score"), F.lit(-1).cast("long").alias("entry_ord"),
        F.lit(0).alias("line_no"), F.concat(F.lit("## "), F.col("source"), F.lit(" — " + run_date)).alias("line"),
    )
    if existing_headers is not None:
        hdr = hdr.join(existing_headers.select("line"), "line", "left_anti")
    return hdr.unionByName(art.withColumn("entry_ord", F.col("entry_ord").cast("long")))


def _star_dims(fx):
    li = fx.table("lineitem")
    o = fx.table("orders")
    geo = fx.table("nation").join(fx.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    sup = fx.table("supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("supp_region"))
    cus = fx.table("customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("cust_region"))
    return li, o, sup, cus


def star_momentum(fx) -> DataFrame:
    """``momentum`` over the star schema with aggregation pushed below the joins.

    Source region = the supplier's region, quarter of the order date, weight =
    quantity, five integer-valued dimensions from lineitem columns.  Same
    result as building one profile row per lineitem and calling
    ``aggs.momentum`` (exact integer sums are associative), but lineitem is
    shuffled once (joined with orders on the order key for the quarter), then
    pre-aggregated per (supplier, quarter) before the supplier-region join
    and the final per-(region, quarter) sums.
    """
    li, o, sup, _ = _star_dims(fx)
    rows = li.join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    dv = {
        "research_intensity": F.col("l_linenumber").cast("long"),
        "standardization_influence": (F.col("l_quantity") % 6).cast("long"),
        "industrial_deployment": (F.col("l_partkey") % 6).cast("long"),
        "spectrum_policy_signal": (F.col("l_suppkey") % 6).cast("long"),
        "ecosystem_maturity": (F.col("l_orderkey") % 6).cast("long"),
    }
    # every term is a whole number (m is a fifth of one), so long sums are exact
    w = F.col("l_quantity").cast("long")
    per_row = rows.select(
        "l_suppkey",
        scalars.quarter_label(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("time_window"),
        w.alias("w_u"),
        *[(dv[k] * w).alias(f"{k}_u") for k in dims.DIMENSIONS],
    )
    cols = ["w_u"] + [f"{k}_u" for k in dims.DIMENSIONS]
    pre = per_row.groupBy("l_suppkey", "time_window").agg(*[F.sum(c).alias(c) for c in cols])
    per_region = pre.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).where(F.col("supp_region").isin(TPCH_REGIONS))
    g = per_region.groupBy(F.col("supp_region").alias("region"), "time_window").agg(*[F.sum(c).alias(c) for c in cols])
    fifths = sum((F.col(f"{k}_u") for k in dims.DIMENSIONS), F.lit(0)).cast("double") / F.lit(float(len(dims.DIMENSIONS)))
    return g.select(
        "region",
        "time_window",
        aggs.mean_of(fifths, "w_u").alias("momentum_score"),
        *[aggs.mean_of(f"{k}_u", "w_u").alias(k) for k in dims.DIMENSIONS],
    )


def star_influence(fx) -> DataFrame:
    """``influence_matrix`` over the star schema with aggregation pushed below the joins.

    orders get their customer region first (one orders-sized shuffle);
    lineitem is shuffled once to join them, then pre-aggregated per
    (supplier, customer region) before the supplier-region join.
    """
    li, o, sup, cus = _star_dims(fx)
    orders = o.join(cus, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cust_region")
    rows = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("cust_region").isin(TPCH_REGIONS))
    pre = rows.groupBy("l_suppkey", "cust_region").agg(F.sum(F.col("l_quantity").cast("long")).alias("u"))
    pairs = pre.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).where(F.col("supp_region").isin(TPCH_REGIONS))
    sums = pairs.groupBy(F.col("supp_region").alias("source"), F.col("cust_region").alias("target")).agg(
        F.sum("u").cast("double").alias("weight")
    )
    return aggs.matrix_densify(sums, TPCH_REGIONS)


# FIXED VALUES: the five region names of the TPC-H region table.
TPCH_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


# ---------------------------------------------------------------------------
# the whole run
# ---------------------------------------------------------------------------


@dataclass
class RunPaths:
    """Where the run reads and writes its state (shared storage on a cluster).

    Every state table lives under ``root/<name>`` unless ``overrides`` names
    another folder for it.
    """

    root: str
    overrides: dict | None = None

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        if self.overrides and name in self.overrides:
            return self.overrides[name]
        return f"{self.root.rstrip('/')}/{name}"


def run_monthly(spark, entries: DataFrame, responses: DataFrame, paths: RunPaths, run_date: str, as_of: str | None = None, languages: DataFrame | None = None, key: str = "entry_ord", meetings: DataFrame | None = None, work_items: DataFrame | None = None) -> dict:
    """Run one cycle; returns the paths written, keyed by sink.

    Quiet cycle (no new article): the recent list is still refreshed and
    exported as the digest; momentum, matrix and history are left untouched.
    The one driver-side decision (quiet or not) reads a single row.

    ``meetings`` (M12 rows) and ``work_items`` (M11 rows, filtered to the target
    release here) are optional: if one is given, their standardization rows
    (``standards_bundle_rows``) become the run date's partition beside the
    digest and, unless the cycle is quiet, the date's snapshot in the history.
    """
    as_of = as_of or run_date
    store = commits.SeenStore(spark, paths.seen)
    seen = commits.read_seen(spark, paths.seen, as_of)
    # the gated entries are read twice by the de-dup, the accepted ones by six
    # sinks: cut the lineage after each, as a columnar table in the shared
    # checkpoint folder (survives executor loss, unlike a local cache; each
    # reader reads only its columns)
    gated = materialize(gated_articles(entries, seen, responses, as_of, languages, key, bloom=True), "gated-entries")
    new = materialize(joins.dedup_cross_feed(gated).withColumn("ai_insights", scalars.with_impact_score("ai_insights")), "accepted-entries")
    cut = [gated, new]
    arts = article_project(new, run_date)
    # of repeats inside one feed, the later entry is the one the recent list keeps
    last = new.groupBy("article_id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "article_id"]), "entry_ord").alias("e")).select("article_id", "e.*")
    out: dict = {}
    quiet = len(new.take(1)) == 0
    prev_recent = state.scan_table(spark, paths.recent, state.ARTICLE_SCHEMA)
    merged = joins.upsert(prev_recent, article_project(last, run_date).select(*prev_recent.columns), ["article_id"])
    recent = topk.rolling_recent(merged, as_of, order="article_id")
    out["recent"] = sinks.write_versioned(recent, paths.recent)
    if not quiet:
        out["digest"] = sinks.write_digest(arts, paths.digest, run_date)
        before = state.read_text_lines(spark, f"{paths.digest_md}/{run_date}")
        links = before.select(F.regexp_extract("line", r"^### \[.*\]\((.*)\)$", 1).alias("link")).where(F.col("link") != "")
        heads = before.where(F.col("line").startswith("## "))
        out["digest_md"] = sinks.write_digest_text(digest_lines(new, links, run_date, heads), f"{paths.digest_md}/{run_date}")
        mom = joins.upsert_momentum(state.scan_table(spark, paths.momentum, state.MOMENTUM_SCHEMA), aggs.momentum(arts))
        out["momentum"] = sinks.write_versioned(mom, paths.momentum)
        # the cumulative matrix is the starting matrix plus one contribution per
        # run.  A run is named by its date and the seen cache it started from: a
        # repeat after a failure starts from the same cache and replaces its own
        # contribution, a further run of the date starts from a newer one and adds
        run_id = f"{run_date}-{store.number if store.number >= 0 else 'first'}"
        contrib = aggs.influence_matrix(arts).withColumn("run_id", F.lit(run_id))
        sinks.write_partitioned(contrib, paths.matrix_runs, "run_id")
        runs = spark.read.parquet(paths.matrix_runs).select("source", "target", "weight")
        mtx = joins.accumulate_matrix(state.scan_table(spark, paths.matrix_base, state.MATRIX_SCHEMA), runs)
        out["matrix"] = sinks.write_versioned(mtx, paths.matrix)
        out["matrix_snapshots"] = sinks.append_snapshot(mtx.withColumn("date", F.lit(run_date)), paths.matrix_snapshots)
    else:
        out["digest"] = sinks.write_digest(state.read_latest(spark, paths.recent, state.ARTICLE_SCHEMA), paths.digest, run_date)
    if meetings is not None or work_items is not None:
        totals = None if work_items is None else standards.work_item_totals(filters.filter_release_exact(work_items))
        std = materialize(standards.standards_bundle_rows(totals, meetings, run_date), "standardization")
        cut.append(std)
        out["standardization"] = sinks.write_digest(std, paths.standardization, run_date)
        if not quiet:
            out["std_snapshots"] = sinks.append_snapshot(std.withColumn("date", F.lit(run_date)), paths.std_snapshots)
    # from the materialized entries: the accepted set is not recomputed
    # a run appends its new rows only; dates beyond the TTL go as whole partitions
    if not quiet:
        store.append(last.select("article_id", F.col("link").alias("url"), "title"), run_date, expire_before=commits.days_before(as_of))
    out["seen"] = paths.seen
    for table in cut:
        discard(table)
    return out


def main(argv: list[str] | None = None) -> None:
    """Command line: one monthly cycle over feed XML files and a profile table.

        spark-submit -m signalmart.plans.monthly --feeds DIR --profiles PARQUET --state DIR --run-date YYYY-MM-DD

    ``--profiles`` holds (article_id, raw_text) scorer answers (parsed with
    ``parse_profile``) or (article_id, ai_insights) profiles; article_id is the
    md5 of the entry link.  ``--meetings`` (M12 rows) and ``--work-items`` (M11
    rows) are optional Parquet tables of the standardization part.
    """
    import argparse

    from pyspark.sql import SparkSession

    from ..operators import enrich
    from ..session import BASE_CONF
    from ..sources import feeds

    ap = argparse.ArgumentParser(description=main.__doc__)
    ap.add_argument("--feeds", required=True)
    ap.add_argument("--profiles", required=True)
    ap.add_argument("--state", required=True)
    ap.add_argument("--run-date", required=True)
    ap.add_argument("--as-of")
    ap.add_argument("--meetings")
    ap.add_argument("--work-items")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("signalmart-monthly").getOrCreate()
    for k, v in BASE_CONF.items():
        spark.conf.set(k, v)
    entries = feeds.scan_feeds_xml(spark, a.feeds, dims.feeds_df(spark).select(
        F.col("source").alias("file_stem"), "source", "feed_ord"))
    prof = spark.read.parquet(a.profiles)
    if "raw_text" in prof.columns:
        prof = prof.select("article_id", enrich.parse_profile("raw_text").alias("ai_insights"))
    # one profile per article (a scorer may have answered twice): keep the greatest
    prof = prof.groupBy("article_id").agg(F.max_by("ai_insights", F.to_json("ai_insights")).alias("ai_insights"))
    meetings, work_items = (spark.read.parquet(p) if p else None for p in (a.meetings, a.work_items))
    out = run_monthly(spark, entries, prof, RunPaths(a.state), a.run_date, a.as_of, key="article_id", meetings=meetings, work_items=work_items)
    for k, v in out.items():
        print(f"{k}\t{v}")


if __name__ == "__main__":
    main()
