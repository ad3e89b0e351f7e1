"""Registered queries that write and read back: the monthly run, the sinks and the streams.

Each call has a folder of its own under the checkpoint folder; results are read from what was
written there, so a query checks the write, the commit and the reader together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text, urls
from ..operators import aggs, filters, joins, reshape, topk
from ..session import ensure_checkpoint_dir
from ..sources import commits, pages, sinks, state
from ..sources.fixtures import AS_OF, RUN_DATE, Fixtures, entry_columns
from ..streaming import ingest
from . import monthly
from .oracle import HISTORY, MOMENTUM_ROWS, RECENT, influence_sql, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__], ORACLE[fn.__name__] = fn, sql
        return fn

    return register


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/roundtrips/{uuid.uuid4().hex}"


def _fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


# Accepted articles of a run that starts from the fixture's seen cache, less what the TTL has evicted.
FIRST_DAY = commits.days_before(AS_OF)
RUN = f"""run_new AS (
  SELECT c.* FROM fx_cands c WHERE (NOT c.present OR coalesce(c.is_relevant, true)) AND c.article_id NOT IN (
    SELECT article_id FROM fx_seen WHERE processed_date = 'not-a-date' OR processed_date >= '{FIRST_DAY}')),
run_articles AS (
  SELECT n.* FROM run_new n JOIN (SELECT article_id, min(feed_ord) AS m FROM run_new GROUP BY article_id) f ON f.article_id = n.article_id WHERE n.feed_ord = f.m)"""


@query(
    with_(RUN)
    + """SELECT article_id, source, link, score, CASE WHEN published IS NULL THEN '2024-06-30' ELSE strftime(published, '%Y-%m-%d') END AS date FROM run_articles"""
)
def run_monthly(spark, sf_dir):
    """One whole cycle from an earlier seen cache; the digest it wrote."""
    fx, paths = _fx(spark, sf_dir), monthly.RunPaths(_folder(spark))
    sinks.write_versioned(fx.seen.withColumn("title", F.lit("")), paths.seen)
    out = monthly.run_monthly(spark, fx.entries, fx.articles.select("entry_ord", "ai_insights"), paths, RUN_DATE, AS_OF)
    return spark.read.parquet(out["digest"]).select("article_id", "source", "link", "score", "date")


@query(with_() + "SELECT DISTINCT md5(link) AS article_id, link AS url, '2024-06-30' AS processed_date FROM fx_entries WHERE coalesce(link, '') <> ''")
def sink_seen(spark, sf_dir):
    """Entries' links appended to the dated store in two runs of a date, each a part of its own."""
    path = _folder(spark)
    rows = filters.filter_has_link(_fx(spark, sf_dir).entries).select(urls.url_hash("link").alias("article_id"), F.col("link").alias("url"), "title")
    rows = rows.groupBy("article_id").agg(F.min("url").alias("url"), F.min("title").alias("title"))
    half = F.pmod(F.xxhash64("article_id"), F.lit(2))
    for i in (0, 1):
        commits.SeenStore(spark, path).append(rows.where(half == i), RUN_DATE)
    return commits.read_seen(spark, path, AS_OF).select("article_id", "url", "processed_date")


@query(with_(MOMENTUM_ROWS) + f"SELECT region, time_window, momentum_score, {', '.join(dims.DIMENSIONS)} FROM mom")
def sink_momentum(spark, sf_dir):
    path, rows = f"{_folder(spark)}/momentum", aggs.momentum(_fx(spark, sf_dir).articles)
    sinks.write_versioned(rows.limit(0), path)
    sinks.write_versioned(joins.upsert_momentum(state.read_latest(spark, path, state.MOMENTUM_SCHEMA), rows), path)
    return state.read_latest(spark, path, state.MOMENTUM_SCHEMA)


@query(with_(f"mx AS {influence_sql()}") + "SELECT source, target, 2 * weight AS weight FROM mx")
def sink_matrix(spark, sf_dir):
    """Two runs that contribute the same: the contributions add up, a repeated one replaces its own."""
    path, rows = f"{_folder(spark)}/runs", aggs.influence_matrix(_fx(spark, sf_dir).articles)
    for run in ("a", "b", "b"):
        sinks.write_partitioned(rows.withColumn("run_id", F.lit(run)), path, "run_id")
    parts = spark.read.parquet(path).select("source", "target", "weight")
    return joins.accumulate_matrix(parts.limit(0), parts)


@query(with_(RECENT) + "SELECT article_id, date FROM recent_merged WHERE coalesce(date, '0000-00-00') >= '2024-04-01' ORDER BY date DESC, entry_ord LIMIT 50")
def sink_recent(spark, sf_dir):
    path, arts = f"{_folder(spark)}/recent", filters.filter_has_link(_fx(spark, sf_dir).articles)
    even, odd = (arts.where(F.col("entry_ord") % 2 == i) for i in (0, 1))
    merged = joins.upsert_recent(even, odd)
    sinks.write_versioned(topk.rolling_recent(merged, AS_OF).select("article_id", "date"), path)
    return state.read_latest(spark, path, merged.select("article_id", "date").schema)


@query(with_(HISTORY) + "SELECT date, source, target, weight FROM snaps")
def sink_history(spark, sf_dir):
    """Dated snapshots appended twice over: a date that is there stays as it is."""
    from .catalog import _monthly_snapshots

    path, snaps = f"{_folder(spark)}/snapshots", _monthly_snapshots(_fx(spark, sf_dir).articles)
    sinks.append_snapshot(snaps.where("date <= '2024-03-01'"), path)
    sinks.append_snapshot(snaps, path)
    return spark.read.schema("source string, target string, weight double, date string").parquet(path).select("date", "source", "target", "weight")


@query(with_() + "SELECT article_id, source, title, date, '2024-06-30' AS run_date FROM fx_cands WHERE NOT present OR coalesce(is_relevant, true)")
def sink_digest(spark, sf_dir):
    """The digest's partition of a run date, written twice, beside one of another date."""
    path = _folder(spark)
    rows = monthly.digest_candidates(_fx(spark, sf_dir).articles, AS_OF).select("article_id", "source", "title", "date")
    sinks.write_digest(rows.limit(1), path, "2024-05-31")
    for _ in (0, 1):
        sinks.write_digest(rows, path, RUN_DATE)
    return spark.read.schema("article_id string, source string, title string, date string, run_date string").parquet(path).where(F.col("run_date") == RUN_DATE)


@query(
    """SELECT url, min(page_id) AS first_page FROM pages WHERE coalesce(url, '') <> '' GROUP BY url"""
)
def sink_discovered(spark, sf_dir):
    """Pages as search hits, stored in two overlapping finds: each url once."""
    path, p = f"{_folder(spark)}/discovered", _fx(spark, sf_dir).pages
    hits = p.select("url", F.col("page_id").cast("string").alias("title"), F.lit("").alias("snippet"), "page_id", F.lit(0).alias("pos"))
    known = hits.limit(0)
    for part in (hits.where("page_id % 2 = 0"), hits):
        sinks.sink_discovered(joins.discover_new_sources(part, known, RUN_DATE), path)
    stored = spark.read.parquet(path).select("url").distinct()
    found = p.groupBy("url").agg(F.min("page_id").alias("first_page"))
    return stored.join(found, "url")


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<?xml version="1.0"?><u>' || url || '</u>' ELSE html END AS content FROM pages"""
)
def extract_wrapped_xml(spark, sf_dir):
    """Every other page serves its feed as escaped text inside a page."""
    p = _fx(spark, sf_dir).pages
    feed = F.concat(F.lit('<?xml version="1.0"?><u>'), "url", F.lit("</u>"))
    wrapped = F.concat(F.lit('<html><body><PRE class="x">'), text.escape_html(feed), F.lit("</pre></body></html>"))
    content = F.when(F.col("page_id") % 2 == 0, wrapped).otherwise(F.col("html"))
    return p.select("page_id", content.alias("c")).select("page_id", pages.extract_wrapped_xml("c").alias("content"))


@query(with_() + f"SELECT * FROM {influence_sql()}")
def unpivot_nested_matrix(spark, sf_dir):
    """The matrix in its nested form, written as JSON lines and read back as rows."""
    path = f"{_folder(spark)}/nested"
    nested = reshape.nest_matrix(aggs.influence_matrix(_fx(spark, sf_dir).articles))
    nested.write.json(path)
    return reshape.unpivot_matrix(spark.read.schema(nested.schema).json(path))


# ---------------------------------------------------------------------------
# streams
# ---------------------------------------------------------------------------


def _entry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    # a stream reads a folder or a pattern; this one fits the table whether it is a file or a folder
    docs = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
    return docs.select(*entry_columns(), F.lit(f"{RUN_DATE} 00:00:00").cast("timestamp").alias("ingest_ts"))


def _drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run an append stream over what is there, into files, and read them."""
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    run = sink.trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query(with_() + "SELECT entry_ord, article_id, score FROM fx_cands")
def stream_ingest(spark, sf_dir):
    """Candidates of a stream over all entries."""
    return _drain(ingest.stream_candidates(_entry_stream(spark, sf_dir), AS_OF).select("entry_ord", "article_id", "score"), _folder(spark))


@query(
    with_("e AS (SELECT entry_ord, md5(link) AS article_id, feed_ord FROM fx_entries WHERE coalesce(link, '') <> '')")
    + "SELECT e.entry_ord, e.article_id, e.feed_ord FROM e JOIN (SELECT article_id, min(feed_ord) AS m FROM e GROUP BY article_id) f ON f.article_id = e.article_id WHERE e.feed_ord = f.m"
)
def stream_dedup(spark, sf_dir):
    """De-dup across feeds as keyed state, all entries being of one time."""
    rows = filters.filter_has_link(_entry_stream(spark, sf_dir)).select("entry_ord", urls.url_hash("link").alias("article_id"), "feed_ord", "ingest_ts")
    return _drain(ingest.stream_dedup(rows), _folder(spark)).select("entry_ord", "article_id", "feed_ord")


@query(with_(f"mx AS {influence_sql()}") + f"SELECT 'matrix' AS part, source AS a, target AS b, weight AS value FROM mx UNION ALL SELECT 'momentum', region, time_window, momentum_score FROM ({with_(MOMENTUM_ROWS)} SELECT * FROM mom)")
def stream_state_upsert(spark, sf_dir):
    """Articles folded in three batches, one of them twice: the committed matrix and momentum."""
    arts, paths = _fx(spark, sf_dir).articles, monthly.RunPaths(_folder(spark))
    fold = ingest.stream_state_upsert(paths, RUN_DATE)
    for batch in (0, 1, 1, 2):
        fold(arts.where(F.pmod(F.col("entry_ord"), F.lit(3)) == batch).drop("link"), batch)
    matrix = commits.read(spark, paths.root, "matrix", state.MATRIX_SCHEMA).select(F.lit("matrix").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").alias("value"))
    momentum = commits.read(spark, paths.root, "momentum", state.MOMENTUM_SCHEMA)
    return matrix.unionByName(momentum.select(F.lit("momentum").alias("part"), F.col("region").alias("a"), F.col("time_window").alias("b"), F.col("momentum_score").alias("value")))
