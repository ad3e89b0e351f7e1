"""Structured Streaming jobs driven to completion with availableNow over files split from the driver tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmart import schemas
from signalmart.operators import aggs
from signalmart.plans import monthly
from signalmart.sources import commits, state
from signalmart.sources.fixtures import Fixtures
from signalmart.streaming import ingest

from .conftest import SF_SMALL

AS_OF = "2024-06-30"


def _split_entries(spark, folder):
    e = Fixtures(spark, SF_SMALL).entries
    for i in range(3):
        e.where(F.col("entry_ord") % 3 == i).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part{i}")
    return e


def test_stream_ingest_dedup_matches_batch(spark, tmp_dir):
    e = _split_entries(spark, f"{tmp_dir}/in")
    schema = e.schema
    s = ingest.stream_dedup(ingest.stream_ingest(spark, f"{tmp_dir}/in/*", schema, AS_OF, max_files=1))
    q = (
        s.select("article_id").writeStream.format("memory").queryName("dedup_out")
        .option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    got = spark.sql("SELECT article_id FROM dedup_out")
    batch = monthly.keyword_candidates(e, AS_OF).select("article_id").distinct()
    # every url comes out once, or as often as its first feed repeats it
    assert got.distinct().count() == batch.count() and got.join(batch, "article_id", "left_anti").count() == 0
    assert batch.count() <= got.count() < monthly.keyword_candidates(e, AS_OF).count()


def test_stream_momentum_matches_batch(spark, tmp_dir):
    arts = Fixtures(spark, SF_SMALL).articles.withColumn("event_ts", F.col("date").cast("timestamp"))
    arts.coalesce(2).write.parquet(f"{tmp_dir}/arts")
    src = spark.readStream.schema(spark.read.parquet(f"{tmp_dir}/arts").schema).parquet(f"{tmp_dir}/arts")
    q = (
        ingest.stream_momentum(src).writeStream.outputMode("update").format("memory").queryName("mom_out")
        .option("checkpointLocation", f"{tmp_dir}/ckpt2").trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    got = {(r.region, r.time_window): r.momentum_score for r in spark.sql("SELECT * FROM mom_out").collect()}
    want = {(r.region, r.time_window): r.momentum_score for r in aggs.momentum(arts).collect()}
    assert got == want


def test_foreach_batch_fold_is_exactly_once(spark, tmp_dir):
    arts = Fixtures(spark, SF_SMALL).articles
    paths = monthly.RunPaths(f"{tmp_dir}/state")
    fold = ingest.stream_state_upsert(paths, AS_OF)
    fold(arts, 0)
    m1 = {(r.source, r.target): r.weight for r in state.read_latest(spark, paths.matrix, schemas.MATRIX).collect()}
    fold(arts, 0)  # replay of the same micro-batch: skipped
    m2 = {(r.source, r.target): r.weight for r in state.read_latest(spark, paths.matrix, schemas.MATRIX).collect()}
    assert m1 == m2 and sum(m1.values()) > 0
    fold(arts, 1)  # a new batch adds
    m3 = {(r.source, r.target): r.weight for r in state.read_latest(spark, paths.matrix, schemas.MATRIX).collect()}
    assert all(abs(m3[k] - 2 * m1[k]) < 1e-9 for k in m1)


def test_fold_does_not_depend_on_the_batches(spark, tmp_dir):
    arts = Fixtures(spark, SF_SMALL).articles
    want = {(r.region, r.time_window): r.momentum_score for r in aggs.momentum(arts).collect()}
    for n in (1, 3):
        paths = monthly.RunPaths(f"{tmp_dir}/state{n}")
        fold = ingest.stream_state_upsert(paths, AS_OF)
        for i in range(n):
            fold(arts.where(F.pmod(F.col("entry_ord"), F.lit(n)) == i), i)
        got = {(r.region, r.time_window): r.momentum_score for r in state.read_latest(spark, paths.momentum, schemas.MOMENTUM).collect()}
        assert got == want


def test_late_rows_of_a_quarter_count(spark, tmp_dir):
    arts = Fixtures(spark, SF_SMALL).articles.where(F.col("ai_insights").isNotNull())
    days = ["2024-05-01", "2024-07-01", "2024-06-29"]
    base = arts.limit(40)
    for i, day in enumerate(days):
        base.withColumn("event_ts", F.lit(day).cast("timestamp")).withColumn("date", F.lit(day)).coalesce(1).write.parquet(f"{tmp_dir}/in/b{i}")
    schema = spark.read.parquet(f"{tmp_dir}/in/b0").schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/in")
    q = (
        ingest.stream_momentum(src).writeStream.outputMode("update").format("memory").queryName("late_out")
        .option("checkpointLocation", f"{tmp_dir}/ckl").trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    got = {}
    for r in spark.sql("SELECT * FROM late_out").collect():
        got[(r.region, r.time_window)] = r.momentum_score
    whole = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/in")
    assert got == {(r.region, r.time_window): r.momentum_score for r in aggs.momentum(whole).collect()}


def test_stream_feed_xml_matches_batch_scan(spark, tmp_dir):
    import os

    from signalmart.sources import feeds

    from .test_feed_processor import ATOM, RSS

    folder = f"{tmp_dir}/feeds"
    os.makedirs(folder)
    for name, body in (("alpha", RSS), ("beta", ATOM)):
        with open(f"{folder}/{name}.xml", "w") as f:
            f.write(body)
    seen = spark.createDataFrame([("https://b.org/1",)], "url string").selectExpr("md5(url) AS article_id")
    s = ingest.stream_candidates(feeds.stream_feeds_xml(spark, folder), AS_OF, seen)
    q = (
        s.select("source", "title").writeStream.format("memory").queryName("xml_out")
        .option("checkpointLocation", f"{tmp_dir}/ckx").trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.sql("SELECT source, title FROM xml_out").collect())
    batch = monthly.keyword_candidates(feeds.scan_feeds_xml(spark, folder), AS_OF, seen)
    assert got == sorted((r.source, r.title) for r in batch.collect()) == [("alpha", "6G news")]


# ---------------------------------------------------------------- de-duplication across feeds

CYCLES = [("2024-01-10", 0), ("2024-01-20", 1), ("2024-02-05", 2), ("2024-09-15", 3)]


def _feed_rows():
    """Entries of four monthly or later runs: feeds that share urls, repeats inside a feed, a null feed number."""
    out = []
    for day, run in CYCLES:
        for i in range(24):
            url, feed = f"https://n.org/{i % 9}", (None, 3, 1, 2)[i % 4]
            out.append((f"{day} 0{i % 6}:00:00", feed, url, f"{run}-{i}", {"k": float(i)}))
    return out


def _run_dedup(spark, tmp_dir, name, rows, order, files, hold):
    """The titles that come out of the stream over ``rows`` in files landing in ``order``, ``files`` a trigger."""
    import os
    import time

    schema = "ingest_ts string, feed_ord int, link string, title string, m map<string,double>"
    df = spark.createDataFrame(rows, schema).withColumn("ingest_ts", F.to_timestamp("ingest_ts"))
    folder = f"{tmp_dir}/{name}"
    for n, keep in enumerate(order):
        df.where(keep).coalesce(1).write.parquet(f"{folder}/f{n}")
        at = time.time() - 1000 + n
        for f in os.listdir(f"{folder}/f{n}"):
            os.utime(f"{folder}/f{n}/{f}", (at, at))
    src = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)
    out = ingest.stream_dedup(src.withColumn("article_id", F.md5("link")), hold=hold)
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_dir}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted((r.title, r.m["k"], r.link) for r in spark.sql(f"SELECT * FROM {name}").collect())


def _batch_runs(spark, rows):
    """The same by a batch run per month: de-dup across feeds, seen cache of 180 days."""
    from signalmart.operators import joins

    df = spark.createDataFrame(rows, "ts string, feed_ord int, link string, title string, m map<string,double>").withColumn("article_id", F.md5("link"))
    seen, out = {}, []
    for month in sorted({r[0][:7] for r in rows}):
        day = F.lit(f"{month}-01").cast("date")
        alive = [k for k, d in seen.items() if spark.range(1).select(F.datediff(day, F.lit(d).cast("date")) <= 180).first()[0]]
        run = df.where(F.col("ts").startswith(month) & ~F.col("article_id").isin(alive))
        kept = joins.dedup_cross_feed(run).collect()
        out += [(r.title, r.m["k"], r.link) for r in kept]
        seen |= {r.article_id: f"{month}-01" for r in kept}
    return sorted(out)


CLOSING = [("2030-01-01 00:00:00", 0, "https://n.org/closing", "closing", {"k": 0.0})]


def test_stream_dedup_holds_a_cycle_as_the_batch_does(spark, tmp_dir):
    rows = _feed_rows()
    want = _batch_runs(spark, rows)
    assert len({w[0] for w in want}) < len(rows) and len(want) > len({w[2] for w in want})  # drops some, keeps repeats
    # files that cut across feeds and runs; the far closing row comes last
    mixed = [F.col("title").rlike(p) & (F.col("title") != "closing") for p in ("[05]$", "[127]$", "[^01257]$")] + [F.col("title") == "closing"]
    for files in (1, 2, 100):
        assert _run_dedup(spark, tmp_dir, f"held{files}", rows[:48] + CLOSING, mixed, files, True) == _batch_runs(spark, rows[:48])
    by_run = [F.col("title").startswith(f"{run}-") for _, run in CYCLES] + [F.col("title") == "closing"]
    assert _run_dedup(spark, tmp_dir, "held_ttl", rows + CLOSING, by_run, 1, True) == want


def test_stream_dedup_at_once(spark, tmp_dir):
    rows = _feed_rows()
    by_run = [F.col("title").startswith(f"{run}-") for _, run in CYCLES]
    got = [_run_dedup(spark, tmp_dir, f"once{files}", rows, by_run, files, False) for files in (1, 2, 100)]
    assert got[0] == got[1] == got[2]
    first = {}
    for ts, feed, link, title, _ in rows:  # the first feed by time owns the url for its month, the url is seen for 180 days
        first.setdefault(link, []).append((ts, 99 if feed is None else feed, title))
    want = []
    for link, entries in first.items():
        owner = None
        for ts, feed, title in sorted(entries):
            day = spark.sql(f"SELECT unix_date(trunc('{ts}', 'MM'))").first()[0]
            if owner is None or day > owner[0] + 180:
                owner = (day, feed)
            if (day, feed) == owner:
                want.append(title)
    assert sorted(g[0] for g in got[0]) == sorted(want)


# ---------------------------------------------------------------- enrichment and gate


def test_stream_enrich_gates_as_the_batch(spark, tmp_dir):
    from signalmart.operators import filters

    entries = Fixtures(spark, SF_SMALL).articles.where("entry_ord < 60 and link <> ''").select("entry_ord", "article_id", "title", "ai_insights")
    entries = entries.dropDuplicates(["article_id"]).withColumn("ingest_ts", F.to_timestamp(F.lit("2024-03-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.col("entry_ord").cast("int")))
    cands = entries.drop("ai_insights")
    # every third answer is missing, every fourth comes after the wait
    hours = F.when(F.col("entry_ord") % 4 == 0, 30).otherwise(2)
    answers = entries.where("ai_insights is not null and entry_ord % 3 <> 0").select("article_id", "ai_insights", (F.col("ingest_ts") + F.make_dt_interval(F.lit(0), hours)).alias("answered_at"))
    in_time = answers.join(entries.select("article_id", "entry_ord"), "article_id").where("entry_ord % 4 <> 0").select("article_id", "ai_insights")
    want = filters.gate_profile(cands.join(in_time, "article_id", "left"))
    far = F.to_timestamp(F.lit("2025-01-01"))
    cands.unionByName(cands.limit(1).withColumn("article_id", F.lit("closing")).withColumn("ingest_ts", far)).repartition(3).write.parquet(f"{tmp_dir}/c")
    answers.unionByName(answers.limit(1).withColumn("article_id", F.lit("none")).withColumn("answered_at", far)).repartition(2).write.parquet(f"{tmp_dir}/a")
    c = spark.readStream.schema(cands.schema).parquet(f"{tmp_dir}/c")
    a = spark.readStream.schema(answers.schema).parquet(f"{tmp_dir}/a")
    q = (
        ingest.stream_enrich(c, a).select("article_id", F.col("ai_insights").isNull().alias("bare")).writeStream.format("memory").queryName("enriched")
        .option("checkpointLocation", f"{tmp_dir}/cke").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM enriched WHERE article_id <> 'closing'").collect())
    assert got == sorted((r.article_id, r.ai_insights is None) for r in want.collect())
    assert {b for _, b in got} == {True, False} and len(got) < cands.count()


def test_stream_candidates_bypass(spark, tmp_dir):
    entries = Fixtures(spark, SF_SMALL).entries
    entries.write.parquet(f"{tmp_dir}/in")
    languages = spark.createDataFrame([("src3",), ("src5",)], "source string")
    s = ingest.stream_ingest(spark, f"{tmp_dir}/in", entries.schema, AS_OF, languages=languages)
    q = s.select("entry_ord", "bypass").writeStream.format("memory").queryName("bypassed").option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = monthly.keyword_candidates(entries, AS_OF, languages=languages)
    assert sorted(r.entry_ord for r in spark.sql("SELECT * FROM bypassed").collect()) == sorted(r.entry_ord for r in want.collect())
    assert spark.sql("SELECT * FROM bypassed WHERE bypass").count() > 0


# ---------------------------------------------------------------- state fold


def _tables(spark, paths):
    out = {n: sorted(map(tuple, state.read_latest(spark, f"{paths.root}/{n}", s).collect()), key=repr) for n, s in (("momentum", schemas.MOMENTUM), ("matrix", schemas.MATRIX))}
    out["recent"] = sorted(r.article_id for r in state.read_latest(spark, paths.recent, schemas.ARTICLE).collect())
    out["seen"] = sorted(r.article_id for r in ingest.seen_as_committed(spark, paths).collect())
    out["days"] = sorted(map(tuple, commits.read_snapshots(spark, paths.root, "matrix_days", state.MATRIX_SCHEMA).collect()))
    return out


def _batches(spark, n):
    arts = Fixtures(spark, SF_SMALL).articles
    return [arts.where(F.pmod(F.col("entry_ord"), F.lit(n)) == i) for i in range(n)]


def test_fold_of_batches_without_a_relevant_article(spark, tmp_dir):
    paths = monthly.RunPaths(f"{tmp_dir}/state")
    fold = ingest.stream_state_upsert(paths, AS_OF)
    arts = Fixtures(spark, SF_SMALL).articles
    fold(arts.limit(0), 0)
    assert commits.record(spark, paths.root)["number"] == -1
    fold(arts.where("ai_insights is null").limit(3), 1)
    first = _tables(spark, paths)
    assert first["momentum"] == [] and len(first["matrix"]) == 36 and {w for _, _, w in first["matrix"]} == {0.0}
    fold(arts, 2)
    assert _tables(spark, paths)["momentum"] == sorted(map(tuple, aggs.momentum(arts).collect()), key=repr)


def test_fold_after_a_failure_between_any_two_writes(spark, tmp_dir, monkeypatch):
    batches = _batches(spark, 2)
    whole = monthly.RunPaths(f"{tmp_dir}/whole")
    fold = ingest.stream_state_upsert(whole, AS_OF)
    for i, b in enumerate(batches):
        fold(b, i)
    want = _tables(spark, whole)
    assert want["days"] == sorted(want["matrix"])

    class Crash(Exception):
        pass

    paths = monthly.RunPaths(f"{tmp_dir}/failing")
    fold = ingest.stream_state_upsert(paths, AS_OF)
    fold(batches[0], 0)
    before = _tables(spark, paths)
    places = [(commits.Commit, "write", n) for n in (0, 1, 3)] + [(commits.Commit, "snapshot", 0), (commits.SeenStore, "append", 0), (commits.Commit, "done", 0)]
    for cls, name, nth in places:
        real, calls = getattr(cls, name), []

        def failing(self, *args, **kwargs):
            calls.append(1)
            if len(calls) > nth:
                if name == "append":
                    real(self, *args, **kwargs)  # fails after the seen cache has its record
                raise Crash
            return real(self, *args, **kwargs)

        with monkeypatch.context() as m:
            m.setattr(cls, name, failing)
            try:
                fold(batches[1], 1)
                raise AssertionError("must fail")
            except Crash:
                pass
        assert _tables(spark, paths) == before
    fold(batches[1], 1)
    assert _tables(spark, paths) == want
    fold(batches[1], 1)  # a replay of a committed batch
    assert _tables(spark, paths) == want


def test_fold_costs_the_same_after_many_batches(spark, tmp_dir):
    paths = monthly.RunPaths(f"{tmp_dir}/state")
    fold = ingest.stream_state_upsert(paths, AS_OF)
    arts = Fixtures(spark, SF_SMALL).articles.limit(20).cache()
    sizes = []
    for i in range(5):
        fold(arts, i)
        sums = state.read_latest(spark, f"{paths.root}/momentum_sums", T._parse_datatype_string(f"region string, time_window string, {ingest.SUM_SCHEMA}"))
        sizes.append(sums.count())
    assert max(sizes) - min(sizes) <= 8 and max(sizes) < 300
    for name in ("momentum", "momentum_sums", "matrix", "matrix_sums", "recent"):
        assert len(state.versions(spark, f"{paths.root}/{name}")) <= commits.KEEP + 1
    arts.unpersist()
