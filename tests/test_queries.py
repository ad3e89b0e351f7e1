"""Query API on hand-written digests: clamping, validation, search, regional leader, concept counts."""

import pytest

from signalmart import dims
from signalmart.functions import scalars
from signalmart.operators import aggs, reshape, topk
from signalmart.plans import api

AI_T = (
    "struct<is_6g_relevant:boolean,source_region:string,summary:string,overall_6g_importance:double,"
    "`6g_topics`:array<string>,world_power_impact:map<string,double>,emerging_concepts:array<string>,"
    "impact_dimensions:map<string,double>,key_evidence:array<string>>"
)
SCHEMA = f"entry_ord long, source string, title string, summary string, ai_insights {AI_T}"


def _digest(spark):
    return spark.createDataFrame(
        [
            (0, "A", "AI-RAN trial", "s", (True, "US", "p", 8.0, ["AI-RAN"], {"US": 3.0, "China": 0.0}, ["ISAC", "NTN"], {}, ["e1"])),
            (1, "A", "Spectrum", "about terahertz", (True, "Korea", "p", 5.0, ["THz"], {"Korea": 2.0, "South Korea": 9.0}, ["NTN"], {}, [])),
            (2, "B", "Other", "x", (True, "EU", "p", None, [], {"EU": 1.0}, ["ISAC"], {}, ["e2", "e2"])),
            (3, "B", "No profile", "terahertz", None),
            (4, "C", "Ten", "y", (False, "China", "p", 10.0, ["NTN"], {"China": 3.0}, ["Quantum"], {}, [])),
        ],
        SCHEMA,
    )


def test_clamp_and_topic_cleaning():
    assert scalars.clamp(-5) == 0 and scalars.clamp(42) == 10 and scalars.clamp("7") == 7
    assert scalars.clean_topic("  TeraHertz  ") == "terahertz"
    assert scalars.clean_topic("x" * 150) == "x" * 100


def test_latest_news_min_importance_and_region(spark):
    d = _digest(spark)
    assert sorted(r.entry_ord for r in api.latest_news(d).collect()) == [0, 1, 4]
    assert [r.entry_ord for r in api.latest_news(d, 5, "Korea").collect()] == [1]
    assert sorted(r.entry_ord for r in api.latest_news(d, -3).collect()) == [0, 1, 2, 3, 4]  # clamped to 0
    with pytest.raises(ValueError):
        api.latest_news(d, 5, "Mars")


def test_search_topics_fields_and_order(spark):
    d = _digest(spark)
    got = [(r.entry_ord, r.importance) for r in api.search_topics(d, " TERAHERTZ ").collect()]
    assert got == [(1, 5.0), (3, 0.0)]  # summary match; no-profile article counts importance 0
    assert [r.entry_ord for r in api.search_topics(d, "ntn", 6).collect()] == [4, 0]
    assert [r.entry_ord for r in api.search_topics(d, "").collect()] == [4, 0, 1, 2, 3]  # empty topic matches all


def test_regional_momentum_and_leader(spark):
    d = _digest(spark)
    rm = {r.region: r for r in api.regional_momentum(d, "2024-06-30").collect()}
    assert set(rm) == set(dims.CANONICAL_REGIONS)
    assert (rm["US"].total_score, rm["US"].article_mentions, rm["US"].average_impact) == (3.0, 1, 3.0)
    assert (rm["China"].total_score, rm["China"].article_mentions) == (3.0, 1)  # score 0 is no mention
    assert rm["Korea"].total_score == 2.0  # no alias mapping here
    assert rm["US"].leader == "US"  # US and China tie at 3: first in leader order
    zero = spark.createDataFrame([(0, "A", "t", "s", (True, "US", "p", 1.0, [], {"US": 0.0}, [], {}, []))], SCHEMA)
    assert aggs.regional_leader(aggs.regional_momentum(zero)).first().leader == "None"


def test_concepts_topics_and_evidence(spark):
    d = _digest(spark)
    cc = [(r.concept, r.frequency) for r in api.emerging_concepts(d).collect()]
    assert cc == [("ISAC", 2), ("NTN", 2)]  # tie: ISAC appears first
    assert [(r.concept, r.frequency) for r in api.emerging_concepts(d, 1).collect()] == [("ISAC", 2), ("NTN", 2), ("Quantum", 1)]
    assert [r.topic for r in aggs.topic_frequency(d, 2).collect()] == ["AI-RAN", "THz"]  # ties by first appearance
    assert sorted(r.concept for r in aggs.distinct_concepts(d).collect()) == ["ISAC", "NTN", "Quantum"]
    assert aggs.evidence_flat(d).count() == 3  # duplicates kept
    assert aggs.is_quiet(d.limit(0)).first().is_quiet is True


def test_latest_per_region_pivot_and_radar(spark):
    rows = [("US", "2024-Q1", 1.0) + (1.0,) * 5, ("US", "2024-Q2", 2.0) + (None,) * 5, ("EU", "2023-Q4", 3.0) + (3.0,) * 5]
    m = spark.createDataFrame(rows, "region string, time_window string, momentum_score double, " + ", ".join(f"{d} double" for d in dims.DIMENSIONS))
    latest = {r.region: r.time_window for r in topk.latest_per_region(m).collect()}
    assert latest == {"US": "2024-Q2", "EU": "2023-Q4"}
    radar = [(r.region, r.dimension, r.value) for r in reshape.radar_rows(topk.latest_per_region(m)).collect()]
    assert ("US", "research_intensity", 0.0) in radar and len(radar) == 10
    piv = reshape.pivot_momentum(m, ["2023-Q4", "2024-Q1", "2024-Q2"])
    grid = {r.region: r for r in piv.collect()}
    assert len(grid) == 6 and grid["US"]["2024-Q2"] == 2.0 and grid["EU"]["2024-Q1"] is None and grid["India"]["2023-Q4"] is None
    assert [tuple(r)[:2] for r in topk.sort_momentum(m).collect()] == [("EU", "2023-Q4"), ("US", "2024-Q1"), ("US", "2024-Q2")]
