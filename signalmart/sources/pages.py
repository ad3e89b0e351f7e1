"""Listing and web pages as tables: links, feed auto-discovery, wrapped XML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text, urls
from ..functions.scalars import let, py_strip


def page_links(pages: DataFrame, page: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``<a href>`` values per page in document order: (page, keep..., pos, href)."""
    return pages.select(F.col(page), *keep, F.posexplode(urls.href_list(F.col(html))).alias("pos", "href"))


def _attr(tag, name: str):
    return F.coalesce(urls.attribute(tag, name), F.lit(""))


def feed_autodiscovery(pages: DataFrame, url: str = "url", html: str = "html", content_type: str = "content_type") -> DataFrame:
    """Page -> feed URL: an XML/RSS content type is the feed itself; else the first
    ``<link rel="alternate">`` with a feed type, resolved against the page URL."""
    links = F.transform(text.markup(html, "link"), lambda t: F.struct(_attr(t, "rel").alias("rel"), _attr(t, "type").alias("type"), _attr(t, "href").alias("href")))
    alt = F.filter(links, lambda l: F.lower(l.getField("rel")).contains("alternate") & l.getField("type").isin(dims.FEED_LINK_TYPES) & (l.getField("href") != ""))
    first_href = F.get(alt, 0).getField("href")
    resolved = let(first_href, lambda href: F.when(href.isNotNull(), urls.resolve_url(F.col(url), href)))
    ct = F.lower(F.coalesce(F.col(content_type), F.lit(""))) if content_type in pages.columns else F.lit("")
    feed = F.when(ct.contains("xml") | ct.contains("rss"), F.col(url)).otherwise(resolved)
    return pages.select(F.col(url), feed.alias("feed_url"))


def extract_wrapped_xml(content):
    """HTML whose ``<pre>`` holds an XML document -> that document (tags dropped,
    entities decoded), else the content unchanged."""
    c = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    looks = F.lower(c).contains("<pre") & (c.contains("<?xml") | c.contains("&lt;?xml"))
    inner = F.regexp_extract(c, r"(?is)<pre[^>]*>(.*?)</pre>", 1)
    pre_text = text.decode_entities(F.regexp_replace(inner, r"(?s)<[^>]*>", ""))
    return F.when(looks & py_strip(pre_text).startswith("<?xml"), pre_text).otherwise(c)
