"""State folds and sinks on hand-written rows: eviction, momentum, matrix, history, recent list, run."""

import json

from pyspark.sql import functions as F

from signalmart import dims, schemas
from signalmart.operators import aggs, filters, joins, reshape, topk
from signalmart.plans import monthly
from signalmart.sources import sinks, state

from .conftest import rows

AS_OF = "2024-06-30"
DIMS_T = "map<string,double>"
AI_T = f"struct<is_6g_relevant:boolean,source_region:string,overall_6g_importance:double,impact_dimensions:{DIMS_T},world_power_impact:{DIMS_T}>"


def _articles(spark, data):
    return spark.createDataFrame(data, f"entry_ord long, date string, ai_insights {AI_T}")


def test_evict_stale_ttl(spark):
    seen = spark.createDataFrame(
        [("old", "2023-12-13"), ("edge", "2024-01-02"), ("today", AS_OF), ("bad", "not-a-date"), ("none", None)],
        "article_id string, processed_date string",
    )
    kept = sorted(r.article_id for r in filters.evict_stale(seen, AS_OF).collect())
    assert kept == ["bad", "edge", "none", "today"]  # 200 days evicted, exactly 180 kept


def test_momentum_weighted_and_relevance_filtered(spark):
    d1 = {k: 4.0 for k in dims.DIMENSIONS}
    d2 = {k: 2.0 for k in dims.DIMENSIONS}
    arts = _articles(
        spark,
        [
            (1, "2024-05-03", (True, "US", 3.0, d1, {})),
            (2, "2024-06-01", (True, "usa", 1.0, d2, {})),  # alias -> US
            (3, "2024-06-01", (False, "US", 10.0, d1, {})),  # not relevant
            (4, "2024-06-01", (None, "US", 10.0, d1, {})),  # missing flag fails aggregation
            (5, "2024-01-15", (True, "Mars", 5.0, d1, {})),  # not canonical
            (6, "garbage", (True, "EU", None, {"research_intensity": 5.0}, {})),  # unknown quarter, weight 1
        ],
    )
    m = {(r.region, r.time_window): r for r in aggs.momentum(arts).collect()}
    assert set(m) == {("US", "2024-Q2"), ("EU", "unknown")}
    assert m[("US", "2024-Q2")].momentum_score == 3.5  # (4*3 + 2*1) / 4
    assert m[("EU", "unknown")].momentum_score == 5.0 and m[("EU", "unknown")].standardization_influence == 0.0


def test_momentum_upsert_replaces_quarter_keeps_old(spark):
    cols = ["region", "time_window", "momentum_score"] + dims.DIMENSIONS
    old = spark.createDataFrame([("US", "2024-Q1", 1.0) + (0.0,) * 5, ("US", "2024-Q2", 2.0) + (0.0,) * 5], schemas.MOMENTUM)
    new = spark.createDataFrame([("US", "2024-Q2", 9.0) + (1.0,) * 5], schemas.MOMENTUM)
    got = {(r.region, r.time_window): r.momentum_score for r in joins.upsert_momentum(old, new).select(*cols).collect()}
    assert got == {("US", "2024-Q1"): 1.0, ("US", "2024-Q2"): 9.0}


def test_influence_matrix_weights_alias_and_accumulation(spark):
    arts = _articles(
        spark,
        [
            (1, "2024-06-01", (True, "US", 2.0, {}, {"South Korea": 3.0, "EU": 0.0, "Mars": 5.0})),
            (2, "2024-06-01", (True, "US", None, {}, {"Korea": 1.0})),
            (3, "2024-06-01", (False, "US", 9.0, {}, {"EU": 9.0})),
        ],
    )
    mx = aggs.influence_matrix(arts)
    cells = {(r.source, r.target): r.weight for r in mx.collect()}
    assert len(cells) == 36
    assert cells[("US", "Korea")] == 7.0  # 3*2 + 1*1 (missing importance = 1)
    assert sum(cells.values()) == 7.0
    twice = {(r.source, r.target): r.weight for r in joins.accumulate_matrix(mx, mx).collect()}
    assert twice[("US", "Korea")] == 14.0  # re-running the same input adds again
    assert rows(aggs.region_article_counts(arts)) == sorted([(r, 2 if r == "US" else 0) for r in dims.CANONICAL_REGIONS], key=repr)


def test_history_append_is_idempotent_and_preserves(spark):
    hist = spark.createDataFrame([("2024-01-01", "US", "EU", 1.0)], "date string, source string, target string, weight double")
    snap_same = spark.createDataFrame([("2024-01-01", "US", "EU", 5.0)], hist.schema)
    snap_new = spark.createDataFrame([("2024-02-01", "US", "EU", 2.0)], hist.schema)
    once = joins.append_snapshot_if_absent(hist, snap_same)
    assert rows(once) == [("2024-01-01", "US", "EU", 1.0)]
    both = joins.append_snapshot_if_absent(once, snap_new)
    assert rows(both) == [("2024-01-01", "US", "EU", 1.0), ("2024-02-01", "US", "EU", 2.0)]


def test_recent_list_newer_wins_ttl_and_cap(spark):
    old = spark.createDataFrame([("a", 1, "2024-06-01", "old a"), ("b", 2, "2024-01-01", "too old"), (None, 3, "2024-06-29", "no id")],
                                "article_id string, entry_ord int, date string, title string")
    new = spark.createDataFrame([("a", 4, "2024-06-20", "new a"), ("c", 5, None, "no date")], old.schema)
    merged = joins.upsert_recent(old, new)
    assert rows(merged, "article_id", "title") == [("a", "new a"), ("b", "too old"), ("c", "no date")]
    recent = topk.rolling_recent(merged, AS_OF)
    assert [r.article_id for r in recent.collect()] == ["a"]
    many = spark.createDataFrame([(str(i), i, "2024-06-%02d" % (1 + i % 28), "t") for i in range(80)], old.schema)
    top = topk.rolling_recent(many, AS_OF, k=50).collect()
    assert len(top) == 50 and top[0].date == "2024-06-28" and top[0].entry_ord == 27


def test_versioned_state_round_trip(spark, tmp_dir):
    path = f"{tmp_dir}/momentum"
    assert state.read_latest(spark, path, schemas.MOMENTUM).count() == 0  # missing -> empty
    a = spark.createDataFrame([("US", "2024-Q1", 1.0) + (0.0,) * 5], schemas.MOMENTUM)
    v0 = sinks.write_versioned(a, path)
    b = joins.upsert_momentum(state.read_latest(spark, path, schemas.MOMENTUM), a.withColumn("momentum_score", F.lit(2.0)))
    v1 = sinks.write_versioned(b, path)
    assert v0.endswith("v=0") and v1.endswith("v=1")
    assert [r.momentum_score for r in state.read_latest(spark, path, schemas.MOMENTUM).collect()] == [2.0]


def _write(path, body):
    with open(path, "w") as f:
        f.write(body)


def test_scan_seen_and_digest_json(spark, tmp_dir):
    seen_path = f"{tmp_dir}/seen.json"
    _write(seen_path, json.dumps({"h1": {"url": "https://a/1", "title": "A", "processed_date": "2024-06-01"}}, indent=2))
    assert rows(state.scan_seen(spark, seen_path)) == [("h1", "https://a/1", "A", "2024-06-01")]
    assert state.scan_seen(spark, f"{tmp_dir}/missing.json").count() == 0
    bad = f"{tmp_dir}/bad.json"
    _write(bad, "{not json")
    d = state.scan_digest(spark, bad).collect()
    assert len(d) == 1 and d[0].date == "" and d[0].articles == []
    good = f"{tmp_dir}/digest.json"
    _write(good, json.dumps({"date": AS_OF, "articles": [{"article_id": "x", "title": "T", "score": 3}]}))
    d = state.scan_digest(spark, good)
    assert d.first().date == AS_OF
    assert rows(state.digest_articles(d), "entry_ord", "article_id", "score") == [(0, "x", 3)]


def test_matrix_nest_unpivot_round_trip(spark):
    long = aggs.matrix_densify(spark.createDataFrame([("US", "EU", 2.5)], "source string, target string, weight double"))
    nested = reshape.nest_matrix(long)
    back = reshape.unpivot_matrix(nested)
    assert rows(back) == rows(long)
    piv = {r.source: r for r in reshape.pivot_matrix(long).collect()}
    assert piv["US"]["EU"] == 3 and piv["EU"]["US"] == 0  # Math.round(2.5) = 3


def n_new_links(spark, paths):
    return state.read_latest(spark, paths.seen, schemas.SEEN).count()


def test_run_monthly_full_and_quiet(spark, tmp_dir):
    from signalmart.sources.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    paths = monthly.RunPaths(f"{tmp_dir}/state")
    responses = fx.articles.select("entry_ord", "ai_insights")
    out = monthly.run_monthly(spark, fx.entries, responses, paths, AS_OF)
    assert {"recent", "momentum", "matrix", "seen", "digest", "digest_md"} <= set(out)
    md = state.read_text_lines(spark, f"{paths.digest_md}/{AS_OF}")
    heads = [r.line for r in md.where(F.col("line").startswith("## ")).collect()]
    assert len(heads) == len(set(heads)) > 0 and md.where(F.col("line").startswith("### [")).count() == n_new_links(spark, paths)
    n_seen = state.read_latest(spark, paths.seen, schemas.SEEN).count()
    assert n_seen > 0
    mtx1 = {(r.source, r.target): r.weight for r in state.read_latest(spark, paths.matrix, schemas.MATRIX).collect()}
    # second run over the same entries: everything is in the seen cache -> quiet cycle
    out2 = monthly.run_monthly(spark, fx.entries, responses, paths, AS_OF)
    assert "momentum" not in out2
    mtx2 = {(r.source, r.target): r.weight for r in state.read_latest(spark, paths.matrix, schemas.MATRIX).collect()}
    assert mtx1 == mtx2  # quiet cycle leaves the matrix untouched
    assert state.read_latest(spark, paths.seen, schemas.SEEN).count() == n_seen


def test_run_monthly_rerun_of_a_date_does_not_add_twice(spark, tmp_dir):
    from signalmart.sources.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    responses = fx.articles.select("entry_ord", "ai_insights")
    first = monthly.RunPaths(f"{tmp_dir}/state")
    monthly.run_monthly(spark, fx.entries, responses, first, AS_OF)
    m1 = {(r.source, r.target): r.weight for r in state.read_latest(spark, first.matrix, schemas.MATRIX).collect()}
    # same date again, as after a failure before the seen cache was saved
    again = monthly.RunPaths(f"{tmp_dir}/state", {"seen": f"{tmp_dir}/fresh-seen"})
    monthly.run_monthly(spark, fx.entries, responses, again, AS_OF)
    m2 = {(r.source, r.target): r.weight for r in state.read_latest(spark, first.matrix, schemas.MATRIX).collect()}
    assert m1 == m2 and sum(m1.values()) > 0
    # a later date adds its own contribution
    monthly.run_monthly(spark, fx.entries, responses, monthly.RunPaths(f"{tmp_dir}/state", {"seen": f"{tmp_dir}/seen2"}), "2024-07-01", AS_OF)
    m3 = {(r.source, r.target): r.weight for r in state.read_latest(spark, first.matrix, schemas.MATRIX).collect()}
    assert all(abs(m3[k] - 2 * m1[k]) < 1e-9 for k in m1)


def test_run_monthly_writes_standardization(spark, tmp_dir):
    from signalmart.sources.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    paths = monthly.RunPaths(f"{tmp_dir}/state")
    responses = fx.articles.select("entry_ord", "ai_insights")
    meet = spark.createDataFrame([(f"R1-{i}", "RAN1", [f"agreed {i}"]) for i in range(12)], "meeting_id string, working_group string, key_agreements array<string>")
    items = spark.createDataFrame(
        [("a", "Completed", dims.TARGET_RELEASE, "RAN1"), ("b", "In Progress", dims.TARGET_RELEASE, "SA2"), ("c", "Completed", "other", "SA2")],
        "name string, status string, release string, working_group string",
    )

    def run(date, **std):
        return monthly.run_monthly(spark, fx.entries, responses, paths, date, AS_OF, **std)

    assert "standardization" not in run("2024-06-29") and not state._exists(spark, paths.standardization)
    paths.overrides = {"seen": f"{tmp_dir}/seen2"}
    run(AS_OF, meetings=meet, work_items=items)
    want = [("group", "RAN1", 1, 1), ("group", "SA2", 1, 0)] + [("meeting", f"R1-{i}", None, None) for i in range(12)] + [("progress", None, 2, 1)]
    for path in (paths.standardization, paths.std_snapshots):
        assert rows(spark.read.parquet(path), "level", "key", "total", "completed") == sorted(want, key=repr)
    assert spark.read.parquet(paths.std_snapshots).where("level = 'meeting'").select("meeting.key_agreements").distinct().count() == 12
    # the same date again, quiet: the digest's partition is replaced, the history keeps its snapshot
    run(AS_OF, meetings=meet.limit(0), work_items=items)
    assert spark.read.parquet(paths.standardization).count() == 3 and spark.read.parquet(paths.std_snapshots).count() == len(want)
