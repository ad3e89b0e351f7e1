"""Structured Streaming form of the incremental monthly run.

New feed-entry files land in a folder; ``stream_ingest`` applies the same
stateless filters and scoring as the batch run, ``stream_enrich`` joins the scorer's
answers and gates, ``stream_dedup`` drops across feeds as the batch does,
``stream_momentum`` keeps the quarterly aggregate as streaming state, and
``stream_state_upsert`` folds every micro-batch into the state tables exactly
once.  Checkpoints go to the folder the caller names (on a cluster: under
``spark.checkpoint.dir``).

``stream_enrich`` and ``stream_dedup`` each keep state and a watermark of their own, so they are two
queries with the gated entries as files between them, as ``README`` shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions import exact, scalars, text, urls
from ..operators import aggs, filters, joins, topk
from ..session import discard, materialize
from ..sources import commits, state
from .dedup import stream_dedup  # noqa: F401 (part of this interface)


def stream_ingest(spark: SparkSession, folder: str, schema: T.StructType, as_of: str | None = None, max_files: int | None = None, seen: DataFrame | None = None, languages: DataFrame | None = None) -> DataFrame:
    """Stream of candidate entries from Parquet files of entries (see ``stream_candidates``).

    An entry's event time is ``ingest_ts``, where the files have that column, else the time
    at which its file landed.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    entries = reader.parquet(folder)
    if "ingest_ts" not in entries.columns:
        entries = entries.withColumn("ingest_ts", F.col("_metadata.file_modification_time"))
    return stream_candidates(entries, as_of, seen, languages)


def stream_candidates(entries: DataFrame, as_of: str | None = None, seen: DataFrame | None = None, languages: DataFrame | None = None) -> DataFrame:
    """Candidate entries of an entry stream: link present, recent (when ``as_of``), keyword
    score >= threshold or a source in the (static) table of ``languages``, and not
    in the (static) seen cache when one is given.

    Adds ``article_id``, ``score``, ``bypass`` and, if it isn't there, ``ingest_ts`` (processing time).
    """
    e = filters.filter_has_link(entries).withColumn("article_id", urls.url_hash("link"))
    if as_of:
        e = filters.filter_recent(e, as_of)
    e = e.withColumn("score", text.relevance_score("title", "summary"))
    if languages is not None:
        e = filters.filter_relevance(joins.bypass_lookup(e, languages, "source"), "score", "bypass")
    else:
        e = filters.filter_relevance(e).withColumn("bypass", F.lit(False))
    if seen is not None:
        e = joins.anti_seen(e, seen)  # stream-static anti-join
    return e if "ingest_ts" in e.columns else e.withColumn("ingest_ts", F.current_timestamp())


def stream_enrich(candidates: DataFrame, answers: DataFrame, wait: str = "1 day", late: str = "1 day", key: str = "article_id") -> DataFrame:
    """Candidates with the scorer's answer, gated as in the batch run.

    ``answers`` is a stream (``key``, ai_insights, answered_at) with at most one
    answer per candidate within ``wait`` of its ``ingest_ts``.  The join is a left outer
    interval join of two streams: a rejected candidate goes, an accepted one
    comes out with its profile at once, and one whose answer is missing, or
    came after ``wait``, comes out without a profile once both watermarks
    (``late`` behind the newest rows) have passed its interval, as the batch keeps it.
    """
    c = candidates.withWatermark("ingest_ts", late)
    a = answers.select(F.col(key).alias("_key"), "ai_insights", "answered_at").withWatermark("answered_at", late)
    within = F.expr(f"{key} = _key AND answered_at >= ingest_ts AND answered_at <= ingest_ts + INTERVAL {wait}")
    return filters.gate_profile(c.join(a, within, "leftOuter").drop("_key", "answered_at"))


# A quarter is at most 92 days long: its rows stay open until the stream holds a
# row of a quarter that ends this long, plus the look-back, after its own end.
MOMENTUM_DELAY = f"{92 + dims.LOOKBACK_DAYS} days"


def stream_momentum(df: DataFrame, event_ts: str = "event_ts", delay: str = MOMENTUM_DELAY, ai: str = "ai_insights") -> DataFrame:
    """Streaming quarterly momentum per canonical region.

    The watermark sits on the end of a row's quarter.  With a delay of a
    quarter and the look-back, the first row of a new quarter doesn't close the
    one before it, so rows within the look-back of their quarter's end are
    never late; older quarters are finalised and dropped.  Sums are exact
    decimals; the weighted means are computed from them on output.
    """
    a = F.col(ai)
    dmap = a.getField("impact_dimensions")
    w = F.coalesce(a.getField("overall_6g_importance"), F.lit(1.0))
    start = F.date_trunc("quarter", F.col(event_ts))
    rows = aggs.attributed(df).select(
        F.col("src_region").alias("region"),
        (start + F.expr("INTERVAL 3 MONTHS")).alias("quarter_end"),
        w.alias("w"),
        scalars.mean_numeric_map(dmap, dims.DIMENSIONS).alias("m"),
        *[F.coalesce(F.element_at(dmap, F.lit(k)), F.lit(0.0)).alias(k) for k in dims.DIMENSIONS],
    )
    terms = {"w_u": F.col("w"), "m_u": F.col("m") * F.col("w")} | {f"{k}_u": F.col(k) * F.col("w") for k in dims.DIMENSIONS}
    g = rows.withWatermark("quarter_end", delay).groupBy("region", "quarter_end").agg(*[F.sum(aggs.exact_units(t)).alias(c) for c, t in terms.items()])
    return g.select(
        "region",
        F.date_format(F.col("quarter_end") - F.expr("INTERVAL 1 DAY"), "yyyy-'Q'q").alias("time_window"),
        aggs.mean_of("m_u", "w_u").alias("momentum_score"),
        *[aggs.mean_of(f"{k}_u", "w_u").alias(k) for k in dims.DIMENSIONS],
    )


SUM_SCHEMA = "term string, bin int, l0 long, l1 long, l2 long"


def stream_state_upsert(paths, run_date: str, stream: str = "articles"):
    """``foreachBatch`` function folding micro-batches of articles into the state tables.

    All tables of a batch count from one commit record on (``commits.Commit``), so a
    batch that failed between two writes has changed nothing, and a batch that
    the record holds is not folded again.  Momentum and matrix are kept as exact
    binned sums: the newest version holds all batches, the next one adds its own,
    so a batch costs the same however many came before it, and the tables don't depend on
    how the rows fell into batches.  The matrix snapshot of ``run_date`` (``matrix_days``) follows the matrix;
    the recent list is an upsert by article, the seen cache takes the new rows only.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commit = commits.Commit(spark, paths.root, stream, batch_id)
        if commit.repeated:
            return
        # read by every write below: cut once, in the shared folder
        rows = materialize(batch, "stream-batch")
        try:
            if rows.isEmpty():
                return
            _fold(spark, commit, rows)
            commit.done()
        finally:
            discard(rows)

    def _fold(spark: SparkSession, commit: commits.Commit, batch: DataFrame) -> None:
        old = commit.old("momentum_sums", T._parse_datatype_string(f"region string, time_window string, {SUM_SCHEMA}"))
        sums = commit.write(exact.add_bins(old.unionByName(aggs.momentum_sums(batch)), aggs.QUARTER), "momentum_sums")
        commit.write(aggs.momentum_of_sums(sums), "momentum")
        old = commit.old("matrix_sums", T._parse_datatype_string(f"source string, target string, {SUM_SCHEMA}"))
        sums = commit.write(exact.add_bins(old.unionByName(aggs.influence_sums(batch)), aggs.PAIR), "matrix_sums")
        base = state.scan_table(spark, paths.matrix_base, state.MATRIX_SCHEMA)
        total = aggs.matrix_densify(joins.accumulate_matrix(base, exact.doubles(sums, aggs.PAIR, ["weight"])))
        matrix = commit.write(total, "matrix")
        commit.snapshot(matrix, "matrix_days", run_date)
        if set(state.ARTICLE_SCHEMA.names) <= set(batch.columns):
            recent = commit.old("recent", state.ARTICLE_SCHEMA)
            order = ["entry_ord"] if "entry_ord" in batch.columns else []
            # of repeats inside a batch the later entry counts, as in the batch run
            new = batch.groupBy("article_id").agg(F.max_by(F.struct(*[c for c in recent.columns if c != "article_id"]), F.struct(*order, "date", "title")).alias("e")).select("article_id", "e.*")
            merged = joins.upsert(recent, new.select(*recent.columns), ["article_id"])
            commit.write(topk.rolling_recent(merged, run_date, order="article_id"), "recent")
        if {"article_id", "link", "title"} <= set(batch.columns):
            add = batch.select("article_id", F.col("link").alias("url"), "title").dropDuplicates(["article_id"])
            store = commits.SeenStore(spark, paths.seen)
            commit.seen = store.append(add, run_date, by=(stream, commit.batch), expire_before=commits.days_before(run_date))

    return fold


def seen_as_committed(spark: SparkSession, paths, as_of: str | None = None) -> DataFrame:
    """The seen cache as the stream's newest commit record has it."""
    number = commits.record(spark, paths.root).get("seen")
    return state.empty(spark, state.SEEN_SCHEMA) if number is None else commits.read_seen(spark, paths.seen, as_of, number)
