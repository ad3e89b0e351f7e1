"""Values at the edges: rounding ties, long capitalised runs, entities, links, state after failed writes."""

import os

import pytest
from pyspark.sql import functions as F

from signalmart.functions import scalars, text, urls
from signalmart.sources import sinks, state


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col.alias("x")).first().x


def test_py_round_equals_python(spark):
    values = [k / 1000 for k in range(-2000, 2000)] + [0.015, 1.115, 2.675, 1e15 + 0.5, 0.125, 2.5, 1e-9]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.py_round("v", 2).alias("r"), scalars.py_round("v", 1).alias("q")).collect()
    assert all(r.r == round(r.v, 2) and r.q == round(r.v, 1) for r in got)


def test_location_of_a_long_capitalised_run(spark):
    words = " ".join(["Word"] * 20000)
    assert one(spark, text.extract_location(F.col("t")), t=f"held in {words} today") == words
    cases = {
        "held in Berlin, Germany on": "Berlin, Germany",
        "held in New York City": "New York City",
        "held in Berlin": "",
        "location: Sophia Antipolis, France": "Sophia Antipolis, France",
        "venue: Hotel Adlon Berlin,Germany": "Hotel Adlon Berlin,Germany",
        "Paris, France meeting": "Paris, France",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.extract_location(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == cases


def test_entities(spark):
    got = one(spark, text.decode_entities(F.col("t")), t="&eacute;&#8217;&mdash;&#x1F600;&amp;lt;&nbsp;&unknown;&#0; a&b; R&D")
    assert got == "é’—\U0001f600&lt; &unknown;� a&b; R&D"


def test_links(spark):
    html = """<a href="/o'brien">x</a><a data-href="no" href='a&amp;b'>y</a><A HREF=bare.html>z</A><!-- <a href="gone">g</a> --><a title="1 > 0" href="q">w</a><a name="n">v</a>"""
    assert one(spark, urls.href_list(F.col("t")), t=html) == ["/o'brien", "a&b", "bare.html", "q"]


def test_dots_in_urls(spark):
    rows = [("https://h/a/b/page", "../f.xml", "https://h/a/f.xml"), ("https://h/a/b/", "./../../../x", "https://h/x"), ("https://h/a/", "b/..", "https://h/a/"), ("https://h/a", "/x/../y?q=../z", "https://h/y?q=../z"), ("https://h/a/b", "c..d", "https://h/a/c..d")]
    df = spark.createDataFrame(rows, "b string, h string, w string")
    assert all(r.x == r.w for r in df.select("w", urls.resolve_url("b", "h").alias("x")).collect())


def test_versions_after_a_failed_write(spark, tmp_dir):
    table = f"{tmp_dir}/t"
    df = spark.createDataFrame([(1,)], "a int")
    sinks.write_versioned(df, table)
    os.makedirs(f"{table}/v=1")  # left by a failed write: no _SUCCESS
    sinks.write_versioned(spark.createDataFrame([(2,)], "a int"), table)
    assert [r.a for r in state.read_latest(spark, table, df.schema).collect()] == [2]
    for i in range(3, 8):
        sinks.write_versioned(spark.createDataFrame([(i,)], "a int"), table)
    assert len(state.versions(spark, table)) == sinks.KEEP_VERSIONS
    assert [r.a for r in state.read_latest(spark, table, df.schema).collect()] == [7]


def test_corrupt_state_is_an_error(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/t/v=0")
    for name, body in (("part-0.parquet", "not parquet"), ("_SUCCESS", "")):
        with open(f"{tmp_dir}/t/v=0/{name}", "w") as file:
            file.write(body)
    with pytest.raises(Exception):
        state.read_latest(spark, f"{tmp_dir}/t", spark.createDataFrame([(1,)], "a int").schema).collect()


def test_markup_inside_scripts_comments_and_values(spark):
    """Quotes, comments and ">" in values, in all three readers of a page."""
    html = (
        """<head><link rel='alternate' title="a > b" type="application/rss+xml" href='/f?a=1&amp;b=2'><!-- <link rel="alternate" type="application/rss+xml" href="no"> --></head>"""
        """<body><script>var s = '<a href="in script">'; if (1 > 0) {}</script><a title='<a href="in value">' href="one">1</a><style>a > b { }</style>"""
        """<p title="x > y">text &gt; <b>bold</b></p><a href=it's>odd</a><A\nHREF='two' >2</A><abbr href="no">n</abbr><!-- open <a href="gone">"""
    )
    assert one(spark, urls.href_list(F.col("t")), t=html) == ["one", "it's", "two"]
    assert one(spark, text.html_to_text(F.col("t")), t=html) == "1 text > bold odd 2 n"
    page = spark.createDataFrame([("https://h.org/x/", html, "text/html")], "url string, html string, content_type string")
    from signalmart.sources import pages

    assert pages.feed_autodiscovery(page).first()["feed_url"] == "https://h.org/f?a=1&b=2"
