"""Feed documents: order inside a document, parse errors, recovery."""

import os

import pytest

from signalmart.operators import aggs
from signalmart.sources import feeds

from .conftest import rows


def rss(n, start=0, tail="</channel></rss>", extra=""):
    items = "".join(f"<item><title>t{i} &amp; more</title><link>https://r.org/{i}</link><description>d{i}</description><pubDate>Mon, 24 Jun 2024 10:00:00 GMT</pubDate></item>\n" for i in range(start, start + n))
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>X</title>{items}{extra}{tail}'


def atom(n):
    entries = "".join(f'<entry><title type="html">a{i}</title><link rel="self" href="https://s.org/{i}"/><link href="https://a.org/{i}"/><content>c{i}</content><published>2024-06-2{i % 8}T08:00:00Z</published></entry>\n' for i in range(n))
    return f'<feed xmlns="http://www.w3.org/2005/Atom"><title>Y</title>{entries}</feed>'


def write(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, body in files.items():
        with open(f"{folder}/{name}.xml", "w", encoding="utf-8") as f:
            f.write(body)


REGISTRY = [("one", "One", 0), ("two", "Two", 1), ("three", "Three", 2), ("four", "Four", 3), ("five", "Five", 4), ("six", "Six", 5)]


@pytest.mark.parametrize("size", ["2000", "134217728"])
def test_entries_are_in_document_order(spark, tmp_dir, size):
    """For any packing of files into tasks."""
    write(tmp_dir, {"one": rss(40), "two": atom(30), "three": rss(25, 100)})
    registry = spark.createDataFrame(REGISTRY, "file_stem string, source string, feed_ord int")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = feeds.scan_feeds_xml(spark, tmp_dir, registry).orderBy("entry_ord").collect()
        plain = feeds.scan_feeds_xml(spark, tmp_dir).orderBy("entry_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [f"https://r.org/{i}" for i in range(40)] + [f"https://a.org/{i}" for i in range(30)] + [f"https://r.org/{i}" for i in range(100, 125)]
    assert [r.link for r in got] == want and len({r.entry_ord for r in got}) == len(want)
    assert got[0].title == "t0 & more" and got[45].summary == "c5" and got[45].published.day == 25
    for source in ("one", "two", "three"):
        links = [r.link for r in plain if r.source == source]
        assert links == [x for x in want if x in set(links)]


def test_feed_health_tells_errors_apart(spark, tmp_dir):
    broken = rss(3, tail="<item><title>cut")  # the document breaks off inside its fourth item
    named = rss(2, extra="<item><title>R&nbsp;D &copy; <b></title><link>https://r.org/9</link></item>")
    files = {"one": rss(2), "two": broken, "three": "<html><body>503<br></body></html>", "four": rss(0), "five": "﻿\n " + rss(1), "seven": named}
    write(tmp_dir, files)
    registry = spark.createDataFrame([*REGISTRY, ("seven", "Seven", 6)], "file_stem string, source string, feed_ord int")
    entries, documents = feeds.scan_feeds_xml(spark, tmp_dir, registry), feeds.scan_feed_documents(spark, tmp_dir, registry)
    got = {r.source: (r.status, r.n_entries) for r in aggs.feed_health(registry.select("source"), entries, documents).collect()}
    assert got == {"One": ("ok", 2), "Two": ("ok_with_error", 3), "Three": ("error", 0), "Four": ("empty", 0), "Five": ("ok", 1), "Six": ("missing", 0), "Seven": ("ok_with_error", 2)}
    assert rows(entries.where("source = 'Two'"), "link") == [(f"https://r.org/{i}",) for i in range(3)]


def test_recovered_entries_decode_names(spark, tmp_dir):
    write(tmp_dir, {"one": rss(0, extra="<item><title>R&nbsp;D &copy; &lt;b&gt;</title><link>https://r.org/9?a=1&b=2</link></item>")})
    row = feeds.scan_feeds_xml(spark, tmp_dir).first()
    assert (row.title, row.link) == ("R D © <b>", "https://r.org/9?a=1&b=2")
