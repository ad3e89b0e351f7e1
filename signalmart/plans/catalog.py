"""Registered queries: one callable per operator key of SURVEY section 2.

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame built
from the library's operators over the fixture views of ``sources.fixtures``
(derived from the driver's tables, whole tables and whole texts).  Outputs are
flat columns named exactly as in the matching oracle SQL (``plans/oracle.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import exact, scalars, text, urls
from ..operators import aggs, enrich, filters, joins, reshape, standards, topk
from ..sources import pages as pages_src
from ..sources.fixtures import AS_OF, RUN_DATE, Fixtures
from . import api, monthly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _ai():
    return F.col("ai_insights")



def _fx(spark, sf_dir) -> Fixtures:
    return Fixtures(spark, sf_dir)


def _linked_articles(fx: Fixtures) -> DataFrame:
    """Articles with a non-empty link (the digest / recent-list population)."""
    return filters.filter_has_link(fx.articles)


# ---------------------------------------------------------------------------
# 2.1 scans / sources
# ---------------------------------------------------------------------------


@query
def feed_health(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    registry = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    return aggs.feed_health(registry, fx.entries)


@query
def matrix_densify(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    sums = exact.doubles(aggs.influence_sums(fx.articles), aggs.PAIR, ["weight"])
    # one region more than any article has: its row and column are all zeros
    return aggs.matrix_densify(sums, [*dims.CANONICAL_REGIONS, "Mars"])


@query
def page_links(spark, sf_dir):
    return pages_src.page_links(_fx(spark, sf_dir).pages)


@query
def fallback_if_empty(spark, sf_dir):
    arts = _linked_articles(_fx(spark, sf_dir))
    cached = topk.rolling_recent(arts, AS_OF).select("article_id", "date")
    cases = []
    # nothing is newer than the run date, many are of the last month
    for name, since in (("empty", AS_OF), ("filled", "2024-06-01")):
        primary = arts.where(F.col("date") > since).select("article_id", "date")
        cases.append(joins.fallback_if_empty(primary, cached, "live", "cached").withColumn("primary_side", F.lit(name)))
    return cases[0].unionByName(cases[1])


# ---------------------------------------------------------------------------
# 2.2 sinks (line rendering)
# ---------------------------------------------------------------------------


@query
def digest_lines(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    kept = monthly.digest_candidates(fx.articles, AS_OF)
    existing = fx.seen.select(F.col("url").alias("link"))
    return monthly.digest_lines(kept, existing, RUN_DATE).select("source", "entry_ord", "line_no", "line")


# ---------------------------------------------------------------------------
# 2.3 filters
# ---------------------------------------------------------------------------


@query
def filter_has_link(spark, sf_dir):
    return filters.filter_has_link(_fx(spark, sf_dir).entries).select("entry_ord", "link")


@query
def filter_recent(spark, sf_dir):
    return filters.filter_recent(_fx(spark, sf_dir).entries, AS_OF).select("entry_ord")


@query
def filter_relevance(spark, sf_dir):
    e = _fx(spark, sf_dir).entries.withColumn("score", text.relevance_score("title", "summary"))
    return filters.filter_relevance(e).select("entry_ord", "score")


@query
def gate_profile(spark, sf_dir):
    return filters.gate_profile(_fx(spark, sf_dir).articles).select("entry_ord")


@query
def filter_aggregable(spark, sf_dir):
    return filters.filter_aggregable(_fx(spark, sf_dir).articles).select("entry_ord")


@query
def filter_canonical_region(spark, sf_dir):
    a = _fx(spark, sf_dir).articles.where(_ai().isNotNull())
    a = a.withColumn("region", scalars.normalize_region(_ai().getField("source_region")))
    return filters.filter_canonical_region(a, F.col("region")).select("entry_ord", "region")


@query
def filter_positive_target(spark, sf_dir):
    t = _fx(spark, sf_dir).targets.withColumn("target", scalars.normalize_region(F.col("target")))
    return filters.filter_positive_target(t).select("doc_id", "target", "score")


def _mapped_work_items(fx: Fixtures) -> DataFrame:
    return standards.map_work_items(fx.work_items)


@query
def filter_release_exact(spark, sf_dir):
    return filters.filter_release_exact(_mapped_work_items(_fx(spark, sf_dir))).select("name", "release")


@query
def filter_release_fuzzy(spark, sf_dir):
    return filters.filter_release_fuzzy(_mapped_work_items(_fx(spark, sf_dir))).select("name", "release")


@query
def fetch_is_html(spark, sf_dir):
    return _fx(spark, sf_dir).pages.select("page_id", filters.fetch_is_html(F.col("html")).alias("is_html"))


@query
def fetch_is_blocked(spark, sf_dir):
    return _fx(spark, sf_dir).pages.select("page_id", filters.fetch_is_blocked(F.col("html")).alias("is_blocked"))


@query
def evict_stale(spark, sf_dir):
    return filters.evict_stale(_fx(spark, sf_dir).seen, AS_OF).select("article_id", "processed_date")


@query
def search_dashboard(spark, sf_dir):
    return filters.search_dashboard(_fx(spark, sf_dir).articles, term="Concept1", source="src3").select("entry_ord")


# ---------------------------------------------------------------------------
# 2.4 projections / scalar expressions
# ---------------------------------------------------------------------------


@query
def url_hash(spark, sf_dir):
    return _fx(spark, sf_dir).entries.select("entry_ord", urls.url_hash("link").alias("article_id"))


@query
def relevance_score(spark, sf_dir):
    return _fx(spark, sf_dir).entries.select("entry_ord", text.relevance_score("title", "summary").alias("score"))


@query
def article_project(spark, sf_dir):
    a = _linked_articles(_fx(spark, sf_dir))
    return monthly.article_project(a, RUN_DATE).select(
        "article_id", "source", "title", "link", "score", "source_region", "summary", "date",
        F.col("ai_insights.overall_6g_importance").alias("importance"),
        F.col("ai_insights.impact_score").alias("impact_score"),
    )


@query
def pub_date(spark, sf_dir):
    return _fx(spark, sf_dir).entries.select("entry_ord", scalars.pub_date("published", RUN_DATE).alias("pub_date"))


@query
def impact_score(spark, sf_dir):
    a = _fx(spark, sf_dir).articles.withColumn("ai_insights", _ai().dropFields("impact_score"))
    return a.select("entry_ord", scalars.with_impact_score("ai_insights").getField("impact_score").alias("impact_score"))


@query
def display_impact(spark, sf_dir):
    a = _fx(spark, sf_dir).articles
    value, label = scalars.display_impact("ai_insights", "score")
    return a.select("entry_ord", value.alias("impact"), label.alias("impact_label"))


@query
def display_summary(spark, sf_dir):
    a = _fx(spark, sf_dir).articles
    return a.select("entry_ord", scalars.display_summary("ai_insights", "summary").alias("display_summary"))


@query
def truncate_text(spark, sf_dir):
    e = _fx(spark, sf_dir).entries
    return e.select("entry_ord", text.truncate_text("summary").alias("short_summary"), text.truncate_text("summary", 200, "").alias("snippet"))


@query
def normalize_region(spark, sf_dir):
    p = _fx(spark, sf_dir).profiles
    return p.select("doc_id", "region_raw", scalars.normalize_region("region_raw").alias("region"))


@query
def quarter_label(spark, sf_dir):
    return _fx(spark, sf_dir).profiles.select("doc_id", scalars.quarter_label("date").alias("time_window"))


@query
def mean_numeric_map(spark, sf_dir):
    a = _fx(spark, sf_dir).articles.where(_ai().isNotNull())
    return a.select(F.col("entry_ord").alias("doc_id"), scalars.mean_numeric_map(_ai().getField("impact_dimensions")).alias("dim_mean"))


@query
def region_flag(spark, sf_dir):
    a = _fx(spark, sf_dir).articles
    flag = F.when(_ai().isNull(), F.lit(dims.DEFAULT_FLAG)).otherwise(scalars.region_flag(_ai().getField("source_region")))
    return a.select(F.col("entry_ord").alias("doc_id"), flag.alias("flag"))


@query
def escape_html(spark, sf_dir):
    return _fx(spark, sf_dir).pages.select("page_id", text.escape_html("html").alias("escaped"))


@query
def safe_url(spark, sf_dir):
    p = _fx(spark, sf_dir).pages
    links = pages_src.page_links(p).select("page_id", "pos", F.col("href").alias("u"))
    own = p.select("page_id", F.lit(-1).alias("pos"), F.col("url").alias("u"))
    return links.unionByName(own).select("page_id", "pos", urls.safe_url("u").alias("safe_url"))


@query
def url_domain(spark, sf_dir):
    return _fx(spark, sf_dir).pages.select("page_id", urls.url_domain("url").alias("domain"))


@query
def html_to_text(spark, sf_dir):
    return _fx(spark, sf_dir).pages.select("page_id", text.html_to_text("html").alias("text"))


@query
def extract_date(spark, sf_dir):
    r = _fx(spark, sf_dir).reports
    return r.select("meeting_id", text.extract_date("content").alias("date"))


@query
def extract_agreements(spark, sf_dir):
    r = _fx(spark, sf_dir).reports
    return r.select("meeting_id", F.posexplode(text.extract_agreements("content")).alias("pos", "agreement"))


@query
def extract_tdocs(spark, sf_dir):
    r = _fx(spark, sf_dir).reports
    return r.select("meeting_id", F.explode(text.extract_tdocs("content")).alias("tdoc"))


@query
def sentiment(spark, sf_dir):
    r = _fx(spark, sf_dir).reports
    c = r.select("meeting_id", text.sentiment_counts("content").alias("c"))
    return c.select(
        "meeting_id", text.sentiment_of_counts(F.col("c")).alias("sentiment"),
        F.col("c.pos").alias("n_pos"), F.col("c.neu").alias("n_neu"), F.col("c.neg").alias("n_neg"),
    )


def _meetings(fx: Fixtures) -> DataFrame:
    return standards.parse_meeting_reports(fx.reports)


def _flat_meetings(m: DataFrame) -> DataFrame:
    return m.select(
        "meeting_id", "working_group", "date", "location",
        F.size("key_agreements").alias("n_agreements"),
        F.array_join("key_agreements", " | ").alias("agreements"),
        F.array_join("tdoc_references", ",").alias("tdocs"),
        "sentiment", "data_source",
    )


@query
def parse_meeting_reports(spark, sf_dir):
    return _flat_meetings(_meetings(_fx(spark, sf_dir)))


@query
def parse_html_reports(spark, sf_dir):
    """Meeting reports as HTML pages: every whole page with a report's sentences in its markup."""
    p = _fx(spark, sf_dir).pages
    pid = F.col("page_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (pid % 90).cast("int")).cast("string")
    minutes = F.concat(
        F.lit('<div title="a > b"><p>Venue: Sophia Antipolis, France</p><p>Held on '), day,
        F.lit("</p><!-- agreed: nothing --><p>agreed: R1-23"), F.lpad((pid % 100000).cast("string"), 5, "0"),
        F.lit(" &amp; S2-2401234</p><script>var x = 'rejected';</script></div>"),
    )
    reports = p.select(pid.alias("meeting_id"), F.lit("RAN1").alias("working_group"), F.concat("html", minutes).alias("content"), F.lit("html").alias("content_type"))
    return _flat_meetings(standards.parse_meeting_reports(reports, content_type="content_type"))


@query
def work_item_status_a(spark, sf_dir):
    w = _fx(spark, sf_dir).work_items
    return w.select(F.col("unique_id").alias("name"), "completion", scalars.work_item_status_a("completion").alias("status"))


@query
def work_item_status_b(spark, sf_dir):
    w = _fx(spark, sf_dir).work_items
    return w.select(F.col("unique_id").alias("name"), "completion", scalars.work_item_status_b("completion").alias("status"))


@query
def map_work_items(spark, sf_dir):
    return _mapped_work_items(_fx(spark, sf_dir))


def _tool_totals(fx: Fixtures) -> DataFrame:
    return standards.work_item_totals(filters.filter_release_exact(_mapped_work_items(fx)))


@query
def briefing_context(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return aggs.briefing_context(fx.articles, _tool_totals(fx))


# ---------------------------------------------------------------------------
# 2.5 joins
# ---------------------------------------------------------------------------


def _linked_entries(fx: Fixtures) -> DataFrame:
    return filters.filter_has_link(fx.entries).withColumn("article_id", urls.url_hash("link"))


@query
def anti_seen(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return joins.anti_seen(_linked_entries(fx), fx.seen).select("entry_ord", "article_id")


@query
def dedup_cross_feed(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return joins.dedup_cross_feed(_linked_entries(fx)).select("entry_ord", "article_id", "feed_ord")


@query
def bypass_lookup(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    langs = spark.createDataFrame([("src3", "de"), ("src7", "fr"), ("src7", "en")], "source string, lang string")
    e = fx.entries.withColumn("score", text.relevance_score("title", "summary"))
    j = joins.bypass_lookup(e, langs)
    return j.select("entry_ord", "bypass", filters.passes_relevance("score", "bypass").alias("passes"))


@query
def enrich_join(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    cands = monthly.keyword_candidates(fx.entries, AS_OF)
    responses = fx.profiles.where(F.col("present")).select(F.col("doc_id").alias("entry_ord"), "importance")
    j = joins.enrich_join(cands.select("entry_ord"), responses, "entry_ord")
    return j.select("entry_ord", F.col("importance").isNotNull().alias("has_profile"), "importance")


@query
def alias_lookup(spark, sf_dir):
    p = _fx(spark, sf_dir).profiles
    return joins.alias_lookup(p, dims.region_alias_df(spark), "region_raw", "region").select("doc_id", "region")


def _even(df, col="entry_ord"):
    return df.where(F.col(col) % 2 == 0)


def _odd(df, col="entry_ord"):
    return df.where(F.col(col) % 2 == 1)


@query
def upsert_momentum(spark, sf_dir):
    a = _fx(spark, sf_dir).articles
    return joins.upsert_momentum(aggs.momentum(_even(a)), aggs.momentum(_odd(a)))


@query
def accumulate_matrix(spark, sf_dir):
    a = _fx(spark, sf_dir).articles
    return joins.accumulate_matrix(aggs.influence_matrix(_even(a)), aggs.influence_matrix(_odd(a)))


def _recent_merged(fx: Fixtures) -> DataFrame:
    a = _linked_articles(fx).select("article_id", "entry_ord", "date", "title")
    return joins.upsert_recent(_even(a), _odd(a))


@query
def upsert_recent(spark, sf_dir):
    return _recent_merged(_fx(spark, sf_dir)).select("article_id", "entry_ord", "date")


def _monthly_snapshots(arts: DataFrame) -> DataFrame:
    """Matrix snapshot per month (sparse long form), dated the first of the month."""
    a = arts.withColumn("date", F.date_format(F.date_trunc("month", F.col("date").cast("date")), "yyyy-MM-dd"))
    p = aggs.attributed(a).select(
        "date",
        F.col("src_region").alias("source"),
        F.coalesce(_ai().getField("overall_6g_importance"), F.lit(1.0)).alias("w"),
        F.explode(_ai().getField("world_power_impact")).alias("target_raw", "score"),
    )
    p = p.withColumn("target", scalars.normalize_region("target_raw"))
    p = filters.filter_positive_target(p)
    return exact.sums(p, ["date", "source", "target"], {"weight": F.col("score") * F.col("w")})


def _snapshot_history(fx: Fixtures) -> DataFrame:
    a = fx.articles
    # one month is in both: the one in the history stays
    snaps = _monthly_snapshots(a)
    hist = snaps.where(F.col("date") <= "2024-03-01")
    new = snaps.where(F.col("date") >= "2024-03-01")
    return joins.append_snapshot_if_absent(hist, new)


@query
def append_snapshot_if_absent(spark, sf_dir):
    return _snapshot_history(_fx(spark, sf_dir))


@query
def matrix_as_of(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    current = aggs.influence_matrix(fx.articles)
    return joins.matrix_as_of(_snapshot_history(fx), current, "2024-02-01")


def _search_hits(fx: Fixtures) -> DataFrame:
    p = fx.pages
    cut = F.substring("html", 1, dims.SUMMARY_CUT).alias("snippet")
    links = pages_src.page_links(p.select("page_id", F.col("url").alias("title"), "html", cut), keep=("title", "snippet"))
    return links.select("page_id", "pos", F.col("href").alias("url"), "title", "snippet")


@query
def discover_new_sources(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    hits = _search_hits(fx)
    known = hits.where(F.col("page_id") % 2 == 0).select("url")
    return joins.discover_new_sources(hits, known, RUN_DATE)


# ---------------------------------------------------------------------------
# 2.6 aggregations
# ---------------------------------------------------------------------------


@query
def momentum(spark, sf_dir):
    return aggs.momentum(_fx(spark, sf_dir).articles)


@query
def influence_matrix(spark, sf_dir):
    return aggs.influence_matrix(_fx(spark, sf_dir).articles)


@query
def region_article_counts(spark, sf_dir):
    return aggs.region_article_counts(_fx(spark, sf_dir).articles)


@query
def regional_momentum(spark, sf_dir):
    return aggs.regional_momentum(_fx(spark, sf_dir).articles).drop("leader_ord")


@query
def regional_leader(spark, sf_dir):
    return aggs.regional_leader(aggs.regional_momentum(_fx(spark, sf_dir).articles))


@query
def concept_counts(spark, sf_dir):
    return aggs.concept_counts(_fx(spark, sf_dir).articles, 2)


@query
def topic_frequency(spark, sf_dir):
    return aggs.topic_frequency(_fx(spark, sf_dir).articles, 8)


@query
def distinct_concepts(spark, sf_dir):
    return aggs.distinct_concepts(_fx(spark, sf_dir).articles)


@query
def evidence_flat(spark, sf_dir):
    return aggs.evidence_flat(_fx(spark, sf_dir).articles)


@query
def distinct_sources(spark, sf_dir):
    return aggs.distinct_sources(_fx(spark, sf_dir).entries)


def _gated_articles(fx: Fixtures) -> DataFrame:
    return monthly.gated_articles(fx.entries, fx.seen, fx.articles, AS_OF)


@query
def is_quiet(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    # de-dup never takes a url's last entry: no accepted entry means no gated one
    return aggs.is_quiet(_gated_articles(fx))


@query
def work_item_totals(spark, sf_dir):
    return _tool_totals(_fx(spark, sf_dir))


@query
def work_items_by_group(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rows = fx.work_items.select(
        F.col("unique_id").cast("string").alias("name"),
        F.col("completion").alias("status"),
        "release",
        F.col("resource_names").alias("working_group"),
    )
    return aggs.work_item_rollup(standards.workbook_items(rows))


@query
def outbound_influence(spark, sf_dir):
    return aggs.outbound_influence(_snapshot_history(_fx(spark, sf_dir)))


@query
def progress_series(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    o = fx.table("orders").select("o_orderkey", F.date_format(F.date_trunc("year", "o_orderdate"), "yyyy-MM-dd").alias("date"))
    items = _mapped_work_items(fx).join(o, F.col("name") == F.col("o_orderkey").cast("string")).drop("o_orderkey")
    items = filters.filter_release_exact(items)
    done = F.lower(F.col("status")) == "completed"
    snaps = items.groupBy("date").agg(
        scalars.py_round(F.count_if(done) / F.count(F.lit(1)) * 100.0, 1).alias("progress_percentage")
    )
    return aggs.progress_series(snaps)


@query
def run_metrics(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return aggs.run_metrics_of(monthly.flagged_entries(fx.entries, fx.seen, fx.articles.select("entry_ord", "ai_insights"), AS_OF))


def _fetch_log(fx: Fixtures) -> DataFrame:
    p = fx.pages
    return p.select(
        "url",
        (~filters.fetch_is_blocked(F.col("html"))).alias("success"),
        F.when(F.col("page_id") % 2 == 0, "httpx").otherwise("playwright").alias("method_used"),
        F.col("page_id").alias("fetched_at"),
    )


@query
def domain_best_method(spark, sf_dir):
    return aggs.domain_best_method(_fetch_log(_fx(spark, sf_dir)))


# ---------------------------------------------------------------------------
# 2.7 ordering / top-k
# ---------------------------------------------------------------------------


@query
def sort_within_source(spark, sf_dir):
    c = monthly.keyword_candidates(_fx(spark, sf_dir).entries, AS_OF)
    return topk.sort_within_source(c).select("entry_ord", "feed_ord", "score")


@query
def rolling_recent(spark, sf_dir):
    return topk.rolling_recent(_recent_merged(_fx(spark, sf_dir)), AS_OF).select("article_id", "entry_ord", "date")


@query
def top_meetings_per_group(spark, sf_dir):
    r = _fx(spark, sf_dir).reports.select("working_group", F.concat(F.lit("TSGR_"), F.col("meeting_id").cast("string"), F.lit("/")).alias("meeting_dir"))
    return topk.top_meetings_per_group(r, 3)


@query
def first_report_file(spark, sf_dir):
    files = _fx(spark, sf_dir).report_files
    return topk.first_report_file(files, filters.is_report_file(F.col("href")), page="doc_id")


def _momentum_rows(fx: Fixtures) -> DataFrame:
    return aggs.momentum(fx.articles)


@query
def latest_per_region(spark, sf_dir):
    return topk.latest_per_region(_momentum_rows(_fx(spark, sf_dir)))


@query
def sort_momentum(spark, sf_dir):
    return topk.sort_momentum(_momentum_rows(_fx(spark, sf_dir))).select("region", "time_window", "momentum_score")


@query
def sort_meetings(spark, sf_dir):
    return topk.sort_meetings(_meetings(_fx(spark, sf_dir))).select("meeting_id", "date")


# ---------------------------------------------------------------------------
# 2.8 reshaping
# ---------------------------------------------------------------------------


@query
def union_groups(spark, sf_dir):
    m = _meetings(_fx(spark, sf_dir))
    parts = [standards.recent_meetings(m, g) for g in ("RAN1", "SA2", "RAN2")]
    return reshape.union_groups(parts).select("meeting_id", "working_group")


@query
def pivot_momentum(spark, sf_dir):
    m = _momentum_rows(_fx(spark, sf_dir))
    quarters = reshape.quarter_labels("2023-10-01", AS_OF)
    piv = reshape.pivot_momentum(m, quarters)
    return reshape.grid_long(piv.drop("region_ord"), quarters)


@query
def pivot_matrix(spark, sf_dir):
    return reshape.pivot_matrix(aggs.influence_matrix(_fx(spark, sf_dir).articles))


@query
def radar_rows(spark, sf_dir):
    return reshape.radar_rows(topk.latest_per_region(_momentum_rows(_fx(spark, sf_dir))))


# ---------------------------------------------------------------------------
# 2.10 query API
# ---------------------------------------------------------------------------


@query
def q_latest_news(spark, sf_dir):
    return api.latest_news(_fx(spark, sf_dir).articles, min_importance=5).select("entry_ord", "article_id", "importance")


@query
def q_release_status(spark, sf_dir):
    status = api.release_status(_tool_totals(_fx(spark, sf_dir)), AS_OF)
    v = ("total", "completed", "in_progress", "postponed")
    groups = F.transform(F.map_entries("work_items_by_group"), lambda g: F.concat_ws("/", g.getField("key"), *(g.getField("value").getField(n).cast("string") for n in v)))
    return status.withColumn("work_items_by_group", F.array_join(F.array_sort(groups), ";"))


@query
def q_recent_meetings(spark, sf_dir):
    m = api.recent_meetings(_meetings(_fx(spark, sf_dir)), "ran1")
    return m.select("meeting_id", "working_group", "date", "sentiment")


@query
def q_search_topics(spark, sf_dir):
    return api.search_topics(_fx(spark, sf_dir).articles, "  Concept1 ", 3).select("entry_ord", "importance")


@query
def q_regional_momentum(spark, sf_dir):
    return api.regional_momentum(_fx(spark, sf_dir).articles, RUN_DATE)


@query
def q_emerging_concepts(spark, sf_dir):
    return api.emerging_concepts(_fx(spark, sf_dir).articles, 2)


# ---------------------------------------------------------------------------
# scale runs over the star schema (same operators, lineitem-sized input)
# ---------------------------------------------------------------------------


@query
def momentum_star(spark, sf_dir):
    return monthly.star_momentum(_fx(spark, sf_dir))


@query
def influence_star(spark, sf_dir):
    return monthly.star_influence(_fx(spark, sf_dir))


# ---------------------------------------------------------------------------
# listing, file, fetch-log and model-text operators (views of fixtures.py)
# ---------------------------------------------------------------------------


@query
def extract_location(spark, sf_dir):
    return _fx(spark, sf_dir).reports.select("meeting_id", text.extract_location("content").alias("location"))


@query
def filter_meeting_dirs(spark, sf_dir):
    return filters.filter_meeting_dirs(_fx(spark, sf_dir).listing).select("working_group", "href")


@query
def dir_name_trim(spark, sf_dir):
    return _fx(spark, sf_dir).listing.select("doc_id", urls.dir_name_trim("href").alias("name"))


@query
def listing_to_meetings(spark, sf_dir):
    dirs = filters.filter_meeting_dirs(_fx(spark, sf_dir).listing).withColumnRenamed("href", "meeting_dir")
    top = topk.top_meetings_per_group(dirs, 3)
    return standards.listing_to_meetings(top, RUN_DATE).select(
        "meeting_id", "working_group", "date", "location", F.size("key_agreements").alias("n_agreements"), "sentiment", "data_source"
    )


@query
def filter_report_files(spark, sf_dir):
    return filters.filter_report_files(_fx(spark, sf_dir).report_files).select("doc_id", "pos", "href")


@query
def content_kind(spark, sf_dir):
    f = _fx(spark, sf_dir).report_files
    first = topk.first_report_file(f, filters.is_report_file(F.col("href")), page="doc_id")
    return first.select("doc_id", "report_file", filters.content_kind("report_file").alias("content_kind"))


@query
def filter_work_plan_files(spark, sf_dir):
    f = _fx(spark, sf_dir).work_plan_files
    return filters.filter_work_plan_files(f).select("doc_id", urls.file_name("href").alias("file_name"))


@query
def latest_by_name(spark, sf_dir):
    f = filters.filter_work_plan_files(_fx(spark, sf_dir).work_plan_files, http_variant=True)
    return topk.latest_by_name(f.select(urls.file_name("href").alias("file_name")))


@query
def resolve_url(spark, sf_dir):
    links = pages_src.page_links(_fx(spark, sf_dir).pages, keep=("url",))
    return links.select("page_id", "pos", urls.resolve_url("url", "href").alias("resolved"))


@query
def fetch_needs_fallback(spark, sf_dir):
    log = _fx(spark, sf_dir).fetch_log
    return log.select("page_id", filters.fetch_needs_fallback("status_code", "error", "success", "content").alias("needs_fallback"))


@query
def feed_autodiscovery(spark, sf_dir):
    log = _fx(spark, sf_dir).fetch_log.withColumnRenamed("content", "html")
    return pages_src.feed_autodiscovery(log).select("url", "feed_url")


@query
def unpivot_matrix(spark, sf_dir):
    nested = reshape.nest_matrix(aggs.influence_matrix(_fx(spark, sf_dir).articles))
    return reshape.unpivot_matrix(nested)


@query
def build_prompt(spark, sf_dir):
    e = _fx(spark, sf_dir).entries
    tmpl = "Site: {site_name}\nTitle: {title}\nSummary: {summary}\nReturn {{json}}."
    return e.select("entry_ord", enrich.build_prompt(tmpl, "source", "title", "summary").alias("prompt"))


@query
def parse_profile(spark, sf_dir):
    t = _fx(spark, sf_dir).model_texts.select("doc_id", enrich.parse_profile("raw_text").alias("p"))
    return t.select(
        "doc_id",
        F.col("p").isNotNull().alias("has_profile"),
        F.col("p.is_6g_relevant").alias("is_6g_relevant"),
        F.col("p.overall_6g_importance").alias("importance"),
        F.col("p.source_region").alias("source_region"),
        F.array_join(F.col("p.6g_topics"), ",").alias("topics"),
    )


@query
def json_list_or_items(spark, sf_dir):
    ev = _fx(spark, sf_dir).table("events")
    res = ev.select(F.col("user_id").alias("call_id"), F.col("event_id").alias("ord"), F.col("props").alias("text"))
    return standards.json_list_or_items(res).select("call_id", "ord", "pos", "item")


@query
def standards_bundle(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    rows = standards.standards_bundle_rows(_tool_totals(fx), _meetings(fx), AS_OF)
    meeting = F.col("meeting")
    return rows.select(
        "level", "key", "total", "completed", "in_progress", "postponed", "progress", "last_updated", "data_source",
        meeting.getField("working_group").alias("working_group"),
        meeting.getField("date").alias("date"),
        meeting.getField("sentiment").alias("sentiment"),
        F.array_join(meeting.getField("key_agreements"), " | ").alias("agreements"),
    )
