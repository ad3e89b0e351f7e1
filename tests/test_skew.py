"""Operators stay exact when one key holds a third of all rows (checked against brute force)."""

from pyspark.sql import functions as F

from signalmart.operators import aggs, joins, topk


def _hot(spark, n=3000):
    # group "hot" holds a third of the rows; the rest spread over 200 groups
    rows = [("hot" if i % 3 == 0 else f"g{i % 200}", f"m{(i * 7919) % 100003:06d}", i) for i in range(n)]
    return spark.createDataFrame(rows, "working_group string, meeting_dir string, i int").repartition(8)


def test_top_k_equals_brute_force(spark):
    df = _hot(spark)
    got = sorted((r.working_group, r.meeting_dir) for r in topk.top_meetings_per_group(df, 3).collect())
    want = []
    for g in {r.working_group for r in df.collect()}:
        names = sorted((r.meeting_dir for r in df.collect() if r.working_group == g), reverse=True)[:3]
        want += [(g, n) for n in names]
    assert got == sorted(want)


def test_upsert_and_dedup_with_hot_key(spark):
    old = spark.createDataFrame([("hot", 1, "old")] * 500 + [("k1", 2, "old")], "article_id string, entry_ord int, v string")
    new = spark.createDataFrame([("hot", i, "new") for i in range(1000)] + [("k2", 3, "new")], old.schema)
    got = {r.article_id: (r.entry_ord, r.v) for r in joins.upsert_recent(old, new).collect()}
    assert got == {"hot": (999, "new"), "k1": (2, "old"), "k2": (3, "new")}
    feeds = spark.createDataFrame([("hot", i % 5, i) for i in range(3000)] + [("x", 2, -1)], "article_id string, feed_ord int, entry_ord int")
    kept = joins.dedup_cross_feed(feeds.repartition(8))
    assert kept.where(F.col("article_id") == "hot").count() == 600 and kept.where(F.col("feed_ord") != 0).count() == 1


def test_aggregates_with_hot_region(spark):
    dims_t = "map<string,double>"
    rows = [(i, "2024-05-01", (True, "US" if i % 3 == 0 else "EU", 2.0, {"research_intensity": float(i % 5)}, {"Japan": 1.0})) for i in range(3000)]
    arts = spark.createDataFrame(
        rows, f"entry_ord long, date string, ai_insights struct<is_6g_relevant:boolean,source_region:string,"
        f"overall_6g_importance:double,impact_dimensions:{dims_t},world_power_impact:{dims_t}>"
    ).repartition(8)
    m = {r.region: r.research_intensity for r in aggs.momentum(arts).collect()}
    us = [i % 5 for i in range(3000) if i % 3 == 0]
    assert m["US"] == round(sum(us) / len(us), 2)
    mx = {(r.source, r.target): r.weight for r in aggs.influence_matrix(arts).collect()}
    assert mx[("US", "Japan")] == 2.0 * 1000 and mx[("EU", "Japan")] == 2.0 * 2000


def test_top_k_with_map_columns_and_large_k(spark):
    df = _hot(spark).withColumn("m", F.create_map(F.lit("a"), F.col("i")))
    got = topk.top_k_per_group(df, ["working_group"], [F.desc("meeting_dir"), F.desc("i")], 1500)
    assert got.count() == df.count() and got.where("rank > 1000").count() == 0


def test_dedup_keeps_rows_of_unregistered_feeds(spark):
    rows = [("a", None, 1), ("a", 2, 2), ("b", None, 3), ("b", None, 4), (None, 1, 5)]
    kept = joins.dedup_cross_feed(spark.createDataFrame(rows, "article_id string, feed_ord int, entry_ord int"))
    assert sorted(r.entry_ord for r in kept.collect()) == [2, 3, 4, 5]


def test_exact_sums_hold_small_and_large_terms(spark):
    one = spark.createDataFrame([(1.0, 1e-7), (1.0, 1e-7)], "v double, w double").agg(aggs.weighted_mean("v", "w").alias("m")).first().m
    big = spark.createDataFrame([(1e13,), (1e13,), (0.25,)], "v double").agg(aggs.exact_sum("v").alias("s")).first().s
    assert one == 1.0 and big == 2e13 + 0.25


def test_alias_listed_twice_does_not_multiply_rows(spark):
    rows = spark.createDataFrame([("usa",), ("x",)], "r string")
    aliases = spark.createDataFrame([("usa", "US"), ("usa", "US")], "alias string, region string")
    assert sorted(r.out for r in joins.alias_lookup(rows, aliases, "r", "out").collect()) == ["US", "x"]
