"""Fixed, explicit schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

from . import dims

S, D, B, I, L = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType()

ENTRY = T.StructType(
    [
        T.StructField("source", S),
        T.StructField("feed_ord", I),
        T.StructField("entry_ord", L),
        T.StructField("title", S),
        T.StructField("link", S),
        T.StructField("summary", S),
        T.StructField("published", T.TimestampType()),
    ]
)

STD_CONTEXT = T.StructType(
    [
        T.StructField("tdoc_refs", T.ArrayType(S)),
        T.StructField("work_items", T.ArrayType(S)),
        T.StructField("target_release", S),
        T.StructField("working_groups", T.ArrayType(S)),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("is_6g_relevant", B),
        T.StructField("source_region", S),
        T.StructField("summary", S),
        T.StructField("overall_6g_importance", D),
        T.StructField("impact_score", D),
        T.StructField("6g_topics", T.ArrayType(S)),
        T.StructField("impact_dimensions", T.MapType(S, D)),
        T.StructField("time_horizon", S),
        T.StructField("world_power_impact", T.MapType(S, D)),
        T.StructField("emerging_concepts", T.ArrayType(S)),
        T.StructField("key_evidence", T.ArrayType(S)),
        T.StructField("standardization_context", STD_CONTEXT),
    ]
)

ARTICLE = T.StructType(
    [
        T.StructField("article_id", S),
        T.StructField("source", S),
        T.StructField("title", S),
        T.StructField("link", S),
        T.StructField("score", I),
        T.StructField("ai_insights", PROFILE),
        T.StructField("source_region", S),
        T.StructField("summary", S),
        T.StructField("date", S),
    ]
)

MOMENTUM = T.StructType(
    [T.StructField("region", S), T.StructField("time_window", S), T.StructField("momentum_score", D)]
    + [T.StructField(d, D) for d in dims.DIMENSIONS]
)

MATRIX = T.StructType([T.StructField("source", S), T.StructField("target", S), T.StructField("weight", D)])

SEEN = T.StructType(
    [T.StructField("article_id", S), T.StructField("url", S), T.StructField("title", S), T.StructField("processed_date", S)]
)

GROUP_PROGRESS = T.StructType(
    [T.StructField("total", L), T.StructField("completed", L), T.StructField("in_progress", L), T.StructField("postponed", L), T.StructField("progress", D)]
)

PROGRESS = T.StructType(
    [
        T.StructField("total_work_items", L),
        T.StructField("completed", L),
        T.StructField("in_progress", L),
        T.StructField("postponed", L),
        T.StructField("progress_percentage", D),
        T.StructField("last_updated", S),
        T.StructField("data_source", S),
        T.StructField("work_items_by_group", T.MapType(S, GROUP_PROGRESS)),
    ]
)

MEETING = T.StructType(
    [
        T.StructField("meeting_id", S),
        T.StructField("working_group", S),
        T.StructField("date", S),
        T.StructField("location", S),
        T.StructField("key_agreements", T.ArrayType(S)),
        T.StructField("tdoc_references", T.ArrayType(S)),
        T.StructField("sentiment", S),
        T.StructField("data_source", S),
    ]
)

STANDARDIZATION = T.StructType(
    [T.StructField("release_21_progress", PROGRESS), T.StructField("recent_meetings", T.ArrayType(MEETING))]
)

DIGEST = T.StructType(
    [T.StructField("date", S), T.StructField("articles", T.ArrayType(ARTICLE)), T.StructField("standardization", STANDARDIZATION)]
)

FETCH_LOG = T.StructType(
    [
        T.StructField("url", S),
        T.StructField("success", B),
        T.StructField("content", S),
        T.StructField("status_code", I),
        T.StructField("error", S),
        T.StructField("method_used", S),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("metadata", T.MapType(S, S)),
    ]
)

DISCOVERED = T.StructType(
    [T.StructField("url", S), T.StructField("title", S), T.StructField("discovered_at", S), T.StructField("relevance_snippet", S)]
)
