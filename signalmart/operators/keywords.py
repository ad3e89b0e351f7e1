"""Keyword relevance for big keyword tables.

``text.relevance_score`` folds a short list into one expression per row; with thousands of
keywords that is thousands of substring searches per text.  Here the keywords are
indexed by trigrams: a keyword is anchored at the one of its trigrams that
the fewest texts hold, texts and keywords meet by an equi-join on anchors, and only
those pairs are verified.  A keyword with a trigram that no text holds leaves at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialize

GRAM = ["raw", "gram"]


def _grams(s: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters, overlapping, line breaks included."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(f"(?s)(?=({'.' * n}))"), 1))


def _tagged(grams: Column, raw: bool) -> Column:
    return F.transform(grams, lambda g: F.struct(F.lit(raw).alias("raw"), g.alias("gram")))


def keyword_scores(df: DataFrame, keywords: DataFrame, title: str = "title", summary: str = "summary", out: str = "score") -> DataFrame:
    """``df`` with the sum of the weights of the keywords its title and summary hold, each counted once.

    ``keywords`` is (keyword, weight, raw): a ``raw`` keyword is matched in the text
    as it is, another one lower-cased in the lower-cased text.  A keyword
    listed twice counts with its greatest weight; empty and null ones don't count.
    The result is that of ``text.relevance_score`` with the same lists.
    """
    rows = df.withColumn("_text", text.relevance_text(title, summary)).withColumn("_tid", F.md5("_text"))
    raw = F.coalesce(F.col("raw"), F.lit(False))
    needles = keywords.select(raw.alias("raw"), F.when(raw, F.col("keyword")).otherwise(F.lower("keyword")).alias("needle"), "weight")
    needles = needles.where(F.coalesce(F.col("needle"), F.lit("")) != "").groupBy("raw", "needle").agg(F.max("weight").alias("weight"))
    # a keyword shorter than three characters is its own gram; at most three lengths
    kinds = [(r.raw, r.n) for r in needles.select("raw", F.least(F.lit(3), F.length("needle")).alias("n")).distinct().collect()]
    if not kinds:
        return df.withColumn(out, F.lit(0))
    by_length = F.when(F.length("needle") == 1, _grams(F.col("needle"), 1)).when(F.length("needle") == 2, _grams(F.col("needle"), 2)).otherwise(_grams(F.col("needle"), 3))
    indexed = needles.select("raw", "needle", "weight", F.explode(by_length).alias("gram"))
    found = [_tagged(_grams(F.col("_text") if r else F.lower("_text"), n), r) for r, n in kinds]
    grams = rows.select("_tid", F.inline(F.concat(*found)))
    # which of the keywords' grams each text holds: read twice below, so written out
    held = materialize(grams.join(indexed.select(*GRAM).distinct(), GRAM), "keyword-grams")
    often = held.groupBy(*GRAM).agg(F.count(F.lit(1)).alias("texts"))
    anchors = indexed.join(often, GRAM, "left").groupBy("raw", "needle", "weight").agg(
        F.min_by("gram", "texts").alias("gram"), F.count_if(F.col("texts").isNull()).alias("absent")
    )
    anchors = anchors.where("absent = 0").drop("absent")
    near = held.join(anchors, GRAM).groupBy("_tid").agg(F.collect_set(F.struct("raw", "needle", "weight")).alias("_near"))
    low = F.lower("_text")
    hits = F.filter("_near", lambda k: F.when(k.getField("raw"), F.contains(F.col("_text"), k.getField("needle"))).otherwise(F.contains(low, k.getField("needle"))))
    score = F.aggregate(hits, F.lit(0).cast("long"), lambda total, k: total + k.getField("weight"))
    return rows.join(near, "_tid", "left").select(*df.columns, F.coalesce(score, F.lit(0)).cast("int").alias(out))
