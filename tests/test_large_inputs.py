"""Operators whose form changes with the input: big keyword tables, hot keys, single-pass metrics, dated reads, the seen store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from signalmart import dims, schemas
from signalmart.functions import text
from signalmart.operators import aggs, joins, keywords, standards
from signalmart.plans import monthly
from signalmart.sources import commits, sinks, state
from signalmart.sources.fixtures import AS_OF, Fixtures

from .conftest import SF_SMALL, rows


def _keyword_table(spark, extra=()):
    lists = ((dims.HIGH_PRIORITY, dims.HIGH_WEIGHT, False), (dims.MEDIUM_PRIORITY, dims.MEDIUM_WEIGHT, False), (dims.HIGH_PRIORITY_INTL, dims.HIGH_WEIGHT, True), (dims.MEDIUM_PRIORITY_INTL, dims.MEDIUM_WEIGHT, True))
    return spark.createDataFrame([(k, w, r) for ks, w, r in lists for k in ks] + list(extra), "keyword string, weight int, raw boolean")


def test_keyword_scores_equal_the_folded_form(spark):
    e = Fixtures(spark, SF_SMALL).entries.select("entry_ord", "title", "summary")
    got = keywords.keyword_scores(e, _keyword_table(spark))
    want = e.withColumn("score", text.relevance_score("title", "summary"))
    assert rows(got, "entry_ord", "score") == rows(want, "entry_ord", "score")
    assert got.where("score > 0").count() > 0


def test_ten_thousand_keywords(spark):
    """From a table, on odd texts and ties, against plain substring tests."""
    rng = random.Random(4)
    letters = "abcdeé世\n "
    texts = [None, "", "a", "ab", "世界", "A\nB"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    table = {("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))), rng.random() < 0.3): rng.randint(1, 3) for _ in range(10_000)}
    entries = [(i % 50, t, rng.choice([None, "Tail", "AB"])) for i, t in enumerate(texts)]  # numbers repeat
    df = spark.createDataFrame(entries, "n int, title string, summary string")
    kw = spark.createDataFrame([(k, w, r) for (k, r), w in table.items()] + [("", 9, False), (None, 9, True)], "keyword string, weight int, raw boolean")
    got = sorted((r.n, r.title or "", r.summary or "", r.score) for r in keywords.keyword_scores(df, kw).collect())
    lowered = {}
    for (k, r), w in table.items():
        key = (k if r else k.lower(), r)
        lowered[key] = max(w, lowered.get(key, 0))
    want = []
    for n, title, summary in entries:
        whole = f"{title or ''} {summary or ''}"
        want.append((n, title or "", summary or "", sum(w for (k, r), w in lowered.items() if k in (whole if r else whole.lower()))))
    assert got == sorted(want)


@pytest.fixture
def small_skew(spark):
    """Adaptive execution takes any partition of some size for skewed."""
    want = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_url_is_split(spark, small_skew):
    """One url holds a third of the rows: its partition is split, in a join with an aggregate over the same key."""
    e = spark.range(60_000, numPartitions=8).select(
        F.col("id").alias("entry_ord"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.md5(F.col("id").cast("string"))).alias("article_id"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 5).when(F.col("id") % 30 == 0, 1).otherwise(0).cast("int").alias("feed_ord"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"),
    )
    out = joins.dedup_cross_feed(e)
    assert "skew=true" in _run_plan(out)
    assert out.where("article_id = 'hot'").count() == 18_000 and out.count() == 58_000


def test_a_hot_tool_call_is_split(spark, small_skew):
    calls = spark.range(60_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("call_id"),
        F.col("id").alias("ord"),
        F.concat(F.lit('{"a": "'), F.sha2(F.col("id").cast("string"), 512), F.lit('"}')).alias("text"),
    )
    out = standards.json_list_or_items(calls)
    assert "skew=true" in _run_plan(out) and out.count() == 60_000


def test_a_hot_link_of_the_digest_is_split(spark, small_skew):
    kept = spark.range(60_000, numPartitions=8).select(
        F.lit("src").alias("source"), F.lit(1).alias("feed_ord"), F.col("id").alias("entry_ord"), F.lit(2).alias("score"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.sha2(F.col("id").cast("string"), 512)).alias("link"),
        F.sha2(F.col("id").cast("string"), 512).alias("title"), F.lit("x").alias("summary"), F.lit(None).cast("timestamp").alias("published"),
        F.lit(None).cast(schemas.PROFILE).alias("ai_insights"),
    )
    known = spark.range(40_000).select(F.sha2((F.col("id") * 3 + 1).cast("string"), 512).alias("link"))
    out = monthly.digest_lines(kept, known, AS_OF)
    assert "skew=true" in _run_plan(out)


def test_run_metrics_in_one_pass(spark):
    fx = Fixtures(spark, SF_SMALL)
    responses = fx.articles.select("entry_ord", "ai_insights")
    flagged = monthly.flagged_entries(fx.entries, fx.seen, responses, AS_OF)
    got = aggs.run_metrics_of(flagged)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = aggs.run_metrics(fx.entries, monthly.new_articles(fx.entries, fx.seen, responses, AS_OF))
    assert rows(got) == rows(want) and got.where("source is null").first().new_articles > 0
    text_scans = [line for line in plan.splitlines() if "FileScan" in line and "text" in line.split("ReadSchema")[-1]]
    assert len(text_scans) == 1


def test_matrix_as_of_reads_one_date(spark, tmp_dir):
    path = f"{tmp_dir}/snaps"
    cells = spark.createDataFrame([("US", "EU", 1.0), ("EU", "US", 2.0)], schemas.MATRIX)
    for i, date in enumerate(("2024-01-01", "2024-02-01", "2024-03-01")):
        sinks.append_snapshot(cells.withColumn("weight", F.col("weight") + i).withColumn("date", F.lit(date)), path)

    def never():
        raise AssertionError("the current matrix isn't asked for")

    got = state.matrix_as_of(spark, path, never, "2024-02-01")
    assert rows(got) == [("EU", "US", 3.0, "snapshot"), ("US", "EU", 2.0, "snapshot")]
    assert all("/date=2024-02-01/" in f for f in got.inputFiles())
    assert rows(state.matrix_as_of(spark, path, lambda: cells, "2024-05-01"))[0][-1] == "current"


# ---------------------------------------------------------------- seen store


def _articles(spark, ids):
    return spark.createDataFrame([(f"id{i}", f"https://x/{i}", f"t{i}") for i in ids], "article_id string, url string, title string")


def test_seen_store_appends_expires_and_merges(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(commits, "MERGE", 4)
    path = f"{tmp_dir}/seen"
    first = (dt.date(2024, 1, 1)).isoformat()
    commits.SeenStore(spark, path).append(_articles(spark, range(3)), first)
    for i in range(6):
        store = commits.SeenStore(spark, path)
        store.append(_articles(spark, [100 + i]), "2024-05-01", by=("s", i))
        store.append(_articles(spark, [100 + i]), "2024-05-01", by=("s", i))  # a repeated batch
    store = commits.SeenStore(spark, path)
    assert store.read().count() == 9 and len(store.record["dates"]["2024-05-01"]) < 4
    assert rows(store.read("2024-07-10"), "article_id") == [(f"id{100 + i}",) for i in range(6)]
    assert all("processed_date=2024-05-01" in f for f in store.read("2024-07-10").inputFiles())
    before = set(store.read("2024-07-10").inputFiles())
    store.append(_articles(spark, [7]), "2024-07-10", expire_before=commits.days_before("2024-07-10"))
    after = set(commits.SeenStore(spark, path).read().inputFiles())
    assert before < after and len(after - before) <= 4  # only the new rows were written
    assert not any("2024-01-01" in f for f in after)
    assert rows(state.read_latest(spark, path, schemas.SEEN), "article_id", "processed_date")[-1] == ("id7", "2024-07-10")


def test_seen_before_a_failed_append(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/seen"
    commits.SeenStore(spark, path).append(_articles(spark, [1]), "2024-05-01")
    with monkeypatch.context() as m:
        m.setattr(commits, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError()))
        with pytest.raises(RuntimeError):
            commits.SeenStore(spark, path).append(_articles(spark, [2]), "2024-05-01")
    assert rows(commits.read_seen(spark, path), "article_id") == [("id1",)]
    commits.SeenStore(spark, path).append(_articles(spark, [2]), "2024-05-01")
    assert rows(commits.read_seen(spark, path), "article_id") == [("id1",), ("id2",)]


def test_bloom_filter_before_the_anti_join(spark):
    entries = spark.range(4000).select(F.concat(F.lit("id"), "id").alias("article_id"), F.col("id"))
    entries = entries.unionByName(spark.createDataFrame([(None, -1)], "article_id string, id long"))
    seen = _articles(spark, range(0, 4000, 4))
    got = commits.anti_seen(entries, seen)
    assert rows(got, "id") == rows(joins.anti_seen(entries, seen), "id") and got.count() == 3001
    plan = _run_plan(got)
    assert "_mask" in plan and "BroadcastHashJoin" in plan and "LeftAnti" in plan
    table, words = commits.bloom_filter(seen)
    word, mask = commits._probe("article_id", words)
    probed = entries.select("id", word, mask).join(table, "_word").where("_bits & _mask = _mask")
    passed = {r.id for r in probed.collect()}
    assert set(range(0, 4000, 4)) <= passed and len(passed) < 1100  # none is missed, few others are let through
    assert commits.bloom_filter(seen, words=1 << 10) is not None
