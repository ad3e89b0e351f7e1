"""Feed documents (RSS ``item`` / Atom ``entry``) -> entry rows (M1).

A feed is one document: it is read whole and parsed with an explicit schema
(``from_xml``) to an array, so an entry's place is its place in the document, however
files are packed into tasks.  A document that isn't well-formed is kept as a parse error, and
its complete entries are cut out and parsed one by one, as a lenient feed
reader does.  The source of an entry is its file's registry name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

ITEM = "struct<title: string, link: string, description: string, pubDate: string, `dc:date`: string>"
ENTRY = "struct<title: string, link: array<struct<_href: string, _rel: string, _type: string>>, summary: string, content: string, published: string>"
# RSS 2.0 has its items in the channel, RSS 1.0 beside it; Atom has entries.
DOCUMENT = f"struct<channel: struct<item: array<{ITEM}>>, item: array<{ITEM}>, entry: array<{ENTRY}>, _corrupt_record: string>"
PARSE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
# A complete entry in a document that can't be parsed as a whole, and what XML alone knows no name for.
FRAGMENT_RX = r"(?is)<(item|entry)\b[^>]*+>.*?</\1\s*+>"
STRAY_RX = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9a-fA-F]{1,6});)"
# Entries of one document; room for them in an entry's number.
ROOM = 1 << 32
# A feed registry of up to this many rows is broadcast.
MAX_REGISTRY = 10_000


def parse_feed_date(s) -> Column:
    """RFC 822 (``Mon, 03 Jun 2024 10:00:00 GMT`` / ``+0000``) or ISO 8601 -> timestamp; null if neither."""
    c = F.col(s) if isinstance(s, str) else s
    rfc = F.regexp_replace(F.trim(c), r"^[A-Za-z]+,\s*", "")
    return F.coalesce(
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm z")),
        F.try_to_timestamp(F.trim(c)),
    )


def _plain(title: Column, link: Column, summary: Column, published: Column) -> Column:
    return F.struct(title.alias("title"), link.alias("link"), summary.alias("summary"), published.alias("published"))


def _of_item(i: Column) -> Column:
    return _plain(i.getField("title"), i.getField("link"), i.getField("description"), F.coalesce(i.getField("pubDate"), i.getField("dc:date")))


def _of_entry(e: Column) -> Column:
    links = e.getField("link")
    alternate = F.filter(links, lambda l: F.coalesce(l.getField("_rel"), F.lit("alternate")) == "alternate")
    link = F.coalesce(F.get(alternate, 0).getField("_href"), F.get(links, 0).getField("_href"))
    return _plain(e.getField("title"), link, F.coalesce(e.getField("summary"), e.getField("content")), e.getField("published"))


def _entries_of(document: Column) -> Column:
    """Entries of a parsed document, in its order."""
    none = F.array().cast("array<struct<title: string, link: string, summary: string, published: string>>")
    arrays = (
        F.transform(document.getField("channel").getField("item"), _of_item),
        F.transform(document.getField("item"), _of_item),
        F.transform(document.getField("entry"), _of_entry),
    )
    return F.concat(*(F.coalesce(a, none) for a in arrays))


def _recovered(content: Column) -> Column:
    """Complete entries of a document that isn't well-formed, each parsed by itself; those that can't be are left out."""

    def one(fragment: Column) -> Column:
        wrapped = F.concat(F.lit("<feed>"), F.regexp_replace(fragment, STRAY_RX, "&amp;"), F.lit("</feed>"))
        return _entries_of(F.from_xml(wrapped, DOCUMENT, PARSE))

    found = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(FRAGMENT_RX), 0), one))
    return F.transform(found, lambda e: _plain(*(text.decode_entities(e.getField(n)) for n in ("title", "link", "summary")), e.getField("published")))


def _documents(files: DataFrame, registry: DataFrame | None) -> DataFrame:
    """(file_path, source, feed_ord, parse_error, entries) of feed files read whole as ``value``."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    # a byte-order mark or blanks before the declaration are no error to a feed reader
    content = F.regexp_replace(F.col("value"), r"^[\ufeff\s]+", "")
    docs = files.select(F.col("_metadata.file_path").alias("file_path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("file_stem"), content.alias("content"))
    docs = docs.withColumn("document", F.from_xml("content", DOCUMENT, PARSE))
    error = F.col("document").getField("_corrupt_record").isNotNull() | F.col("document").isNull()
    docs = docs.select("file_path", "file_stem", error.alias("parse_error"), F.when(error, _recovered(F.col("content"))).otherwise(_entries_of(F.col("document"))).alias("entries"))
    if registry is None:
        return docs.withColumns({"source": F.col("file_stem"), "feed_ord": F.lit(None).cast("int")}).drop("file_stem")
    known = registry.select("file_stem", F.col("source").alias("_source"), "feed_ord")
    if known.limit(MAX_REGISTRY + 1).count() <= MAX_REGISTRY:
        known = F.broadcast(known)
    return docs.join(known, "file_stem", "left").withColumn("source", F.coalesce("_source", "file_stem")).drop("_source", "file_stem")


def _entries(docs: DataFrame) -> DataFrame:
    """Entry rows; ``entry_ord`` is the feed's number, or one made from the file's name, and the place in the document."""
    rows = docs.select("file_path", "source", "feed_ord", F.posexplode("entries").alias("place", "e"))
    feed = F.coalesce(F.col("feed_ord").cast("long"), F.pmod(F.xxhash64("file_path"), F.lit(1 << 30)) + F.lit(1 << 30))
    return rows.select("source", "feed_ord", (feed * F.lit(ROOM) + F.col("place")).alias("entry_ord"), "e.title", "e.link", "e.summary", parse_feed_date("e.published").alias("published"))


def scan_feeds_xml(spark: SparkSession, path: str, registry: DataFrame | None = None) -> DataFrame:
    """All feed files under ``path`` -> (source, feed_ord, entry_ord, title, link, summary, published).

    ``registry`` (file_stem, source, feed_ord) names the sources; without it the
    file stem is the source.  ``entry_ord`` orders the entries of a feed as its
    document does, and is different for every entry.
    """
    return _entries(_documents(spark.read.text(path, wholetext=True), registry))


def scan_feed_documents(spark: SparkSession, path: str, registry: DataFrame | None = None) -> DataFrame:
    """(source, feed_ord, file_path, parse_error, n_entries) of all feed files: what ``feed_health`` tells feeds by."""
    docs = _documents(spark.read.text(path, wholetext=True), registry)
    return docs.select("source", "feed_ord", "file_path", "parse_error", F.size("entries").alias("n_entries"))


def stream_feeds_xml(spark: SparkSession, path: str, registry: DataFrame | None = None, max_files: int | None = None) -> DataFrame:
    """Streaming form of ``scan_feeds_xml``: new feed files landing under ``path`` become the same entry rows."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _entries(_documents(reader.text(path, wholetext=True), registry))
