"""Feed-side operators on hand-written rows: hash, look-back, keyword score, profile parsing, XML scan."""

import datetime as dt
import hashlib

import pandas as pd
from pyspark.sql import functions as F

from signalmart.functions import text, urls
from signalmart.operators import enrich, filters, joins
from signalmart.plans import monthly
from signalmart.sources import feeds, pages

from .conftest import rows

AS_OF = "2024-06-30"


def test_url_hash_is_md5_hex(spark):
    url = "https://arxiv.org/abs/2401.00001"
    got = spark.createDataFrame([(url,), ("https://a.com/2",)], "link string").select(urls.url_hash("link").alias("h")).collect()
    assert got[0].h == hashlib.md5(url.encode()).hexdigest()
    assert len(got[0].h) == 32 and got[0].h != got[1].h


def test_recency_window(spark):
    base = dt.datetime(2024, 6, 30)
    data = [(1, base - dt.timedelta(days=5)), (2, base - dt.timedelta(days=60)), (3, base - dt.timedelta(days=29)), (4, None), (5, base + dt.timedelta(days=3))]
    df = spark.createDataFrame(data, "id int, published timestamp")
    kept = [r.id for r in filters.filter_recent(df, AS_OF).collect()]
    assert sorted(kept) == [1, 3, 4, 5]  # old dropped; missing and future dates kept


SCORE_CASES = [
    ("6G deployment plans", "IMT-2030 roadmap", 6),
    ("Release 21 update", "millimeter wave spectrum", 4),
    ("Weather report", "Sunny day expected.", 0),
    ("6세대 이동통신 기술 개발", "", 5),
    ("第6世代移動通信システム", "", 5),
    ("이동통신 표준화 동향", "", 2),
    ("6G and 第6世代 convergence", "이동통신 spectrum", 8),
    ("16GB memory", "", 3),  # substring match: "6g" inside "16gb"
    ("Radio", "spectrum", 2),  # phrase spans the title/summary join
]


def test_relevance_score_known_answers(spark):
    df = spark.createDataFrame([(t, s) for t, s, _ in SCORE_CASES], "title string, summary string")
    got = [r.s for r in df.select(text.relevance_score("title", "summary").alias("s")).collect()]
    assert got == [e for _, _, e in SCORE_CASES]


def test_relevance_case_insensitive_and_once_per_keyword(spark):
    df = spark.createDataFrame([("TERAHERTZ research", "terahertz terahertz")], "title string, summary string")
    assert df.select(text.relevance_score("title", "summary")).first()[0] == 3


def test_relevance_filter_and_bypass(spark):
    df = spark.createDataFrame([(1, 0, "de"), (2, 2, "en"), (3, 1, "en")], "id int, score int, lang string")
    langs = spark.createDataFrame([("de",)], "lang string")
    j = joins.bypass_lookup(df, langs, key="lang")
    assert sorted(r.id for r in filters.filter_relevance(j, "score", "bypass").collect()) == [1, 2]


def _parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string")
    return [r.p for r in df.orderBy("id").select(enrich.parse_profile("raw").alias("p")).collect()]


def test_parse_profile_plain_and_fenced(spark):
    got = _parse(
        spark,
        [
            '{"is_6g_relevant": true, "overall_6g_importance": 7, "source_region": "EU"}',
            'Here:\n```json\n{"is_6g_relevant": "yes", "6g_topics": ["ISAC"]}\n```\nbye',
            '```\n{"is_6g_relevant": "false"}\n```',
            'noise {"is_6g_relevant": 1, "impact_dimensions": {"research_intensity": 4}} tail',
            "not json at all",
            "[1, 2]",
            '{"overall_6g_importance": 3}',
            '{"is_6g_relevant": null}',
            '{"is_6g_relevant": "TRUE "}',
        ],
    )
    assert got[0].is_6g_relevant is True and got[0].overall_6g_importance == 7.0 and got[0].source_region == "EU"
    assert got[1].is_6g_relevant is True and got[1]["6g_topics"] == ["ISAC"]
    assert got[2].is_6g_relevant is False
    assert got[3].is_6g_relevant is True and got[3].impact_dimensions == {"research_intensity": 4.0}
    assert got[4] is None and got[5] is None  # not JSON / not an object
    assert got[6].is_6g_relevant is None  # absent flag stays absent
    assert got[7].is_6g_relevant is False  # JSON null is falsy
    assert got[8].is_6g_relevant is True


def test_gate_and_aggregable_three_valued(spark):
    schema = "id int, ai struct<is_6g_relevant:boolean>"
    df = spark.createDataFrame([(1, None), (2, (None,)), (3, (True,)), (4, (False,))], schema)
    assert sorted(r.id for r in filters.gate_profile(df, "ai").collect()) == [1, 2, 3]
    assert sorted(r.id for r in filters.filter_aggregable(df, "ai").collect()) == [3]


def test_enrich_with_stub_then_parse(spark):
    cands = spark.createDataFrame([(1, "6G"), (2, "Radio")], "entry_ord long, title string")
    cands = cands.withColumn("prompt", enrich.build_prompt("Site {site_name}: {title} / {summary} {{json}}", F.lit("X"), "title", F.lit("s")))
    assert cands.orderBy("entry_ord").first().prompt == "Site X: 6G / s {json}"

    def stub(pdf: pd.DataFrame) -> pd.DataFrame:
        flag = pdf["prompt"].str.contains("6G")
        return pd.DataFrame({"entry_ord": pdf["entry_ord"], "raw_text": ['{"is_6g_relevant": %s}' % ("true" if f else "false") for f in flag]})

    out = enrich.enrich_with(cands, stub).select("entry_ord", enrich.parse_profile("raw_text").alias("ai"))
    assert rows(out.select("entry_ord", F.col("ai.is_6g_relevant").alias("f"))) == [(1, True), (2, False)]


def test_dedup_cross_feed_keeps_first_feed_and_same_feed_repeats(spark):
    df = spark.createDataFrame(
        [("a", 0, 1), ("a", 0, 2), ("a", 1, 3), ("b", 2, 4), ("b", 1, 5)], "article_id string, feed_ord int, entry_ord int"
    )
    assert sorted(r.entry_ord for r in joins.dedup_cross_feed(df).collect()) == [1, 2, 5]


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>X</title>
<item><title>6G news</title><link>https://a.org/1</link><description>IMT-2030 &amp; more</description><pubDate>Mon, 24 Jun 2024 10:00:00 GMT</pubDate></item>
<item><title>No date</title><link>https://a.org/2</link><description>x</description></item>
<item><title>No link</title><description>terahertz</description></item>
</channel></rss>"""

ATOM = """<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Y</title>
<entry><title>Atom 6G</title><link href="https://b.org/1" rel="alternate"/><summary>terahertz</summary><published>2024-06-20T08:00:00Z</published></entry>
<entry><title>Old</title><link href="https://b.org/2"/><summary>6G</summary><published>2023-01-01T00:00:00Z</published></entry>
</feed>"""


def test_scan_feeds_xml_rss_and_atom(spark, tmp_dir):
    for name, body in (("alpha", RSS), ("beta", ATOM)):
        with open(f"{tmp_dir}/{name}.xml", "w") as f:
            f.write(body)
    reg = spark.createDataFrame([("alpha", "Alpha Feed", 0), ("beta", "Beta Feed", 1)], "file_stem string, source string, feed_ord int")
    e = feeds.scan_feeds_xml(spark, tmp_dir, reg)
    got = rows(e, "source", "title", "link", "published")
    assert ("Alpha Feed", "6G news", "https://a.org/1", dt.datetime(2024, 6, 24, 10, 0)) in got
    assert ("Beta Feed", "Atom 6G", "https://b.org/1", dt.datetime(2024, 6, 20, 8, 0)) in got
    assert len(got) == 5
    cands = monthly.keyword_candidates(e, AS_OF)
    assert sorted(r.title for r in cands.collect()) == ["6G news", "Atom 6G"]


def test_feed_autodiscovery(spark):
    html = '<html><head><link rel="stylesheet" href="/s.css"><link rel="alternate" type="application/rss+xml" href="/feed.xml"></head></html>'
    df = spark.createDataFrame(
        [("https://x.org/news/page.html", html, "text/html"), ("https://y.org/rss", "<rss/>", "application/xml"), ("https://z.org/", "<html></html>", "text/html")],
        "url string, html string, content_type string",
    )
    got = dict((r.url, r.feed_url) for r in pages.feed_autodiscovery(df).collect())
    assert got == {"https://x.org/news/page.html": "https://x.org/feed.xml", "https://y.org/rss": "https://y.org/rss", "https://z.org/": None}


def test_monthly_command_line_over_xml_feeds(spark, tmp_dir):
    import hashlib

    from signalmart.sources import state

    os_dir = f"{tmp_dir}/feeds"
    import os

    os.makedirs(os_dir)
    for name, body in (("Nokia", RSS), ("Ericsson", ATOM)):
        with open(f"{os_dir}/{name}.xml", "w") as f:
            f.write(body)
    raw = [
        (hashlib.md5(b"https://a.org/1").hexdigest(), '{"is_6g_relevant": true, "source_region": "EU", "overall_6g_importance": 7}'),
        (hashlib.md5(b"https://b.org/1").hexdigest(), '```json\n{"is_6g_relevant": false}\n```'),
    ]
    spark.createDataFrame(raw, "article_id string, raw_text string").write.parquet(f"{tmp_dir}/profiles")
    monthly.main(["--feeds", os_dir, "--profiles", f"{tmp_dir}/profiles", "--state", f"{tmp_dir}/state", "--run-date", AS_OF])
    seen = state.read_latest(spark, f"{tmp_dir}/state/seen", state.SEEN_SCHEMA).collect()
    assert [r.url for r in seen] == ["https://a.org/1"]  # the Atom entry was rejected by its profile
