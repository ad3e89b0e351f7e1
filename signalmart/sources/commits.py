"""Commit records: several tables move together, and a failed write changes nothing.

A record is a small JSON file under ``<root>/_commits``, named by its number and put in
place by a rename.  It names the version folder of every table; readers go by the newest
record, so what a failed job left behind is never read, and its repetition
writes folders of its own.

``Commit`` collects the writes of one batch of a stream (or one run).  ``SeenStore`` is the
seen cache: an append-only table of dated parts with its own record.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims, schemas
from . import state

# Records kept besides the newest: who has just read one can still open what it names.
KEEP = 2
# Parts of one date from which they are merged into one.
MERGE = 16


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    _, p, fs = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    _, p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/_commits") if n.endswith(".json") and n[:-5].isdigit())


def record(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """The newest record of ``root``, or one by its number; ``{"number": -1}`` before the first."""
    found = numbers(spark, root)
    if not found:
        return {"number": -1}
    jvm, p, fs = _hadoop(spark, f"{root}/_commits/{found[-1] if number is None else number}.json")
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put(spark: SparkSession, root: str, new: dict) -> None:
    _, p, fs = _hadoop(spark, f"{root}/_commits/{new['number']}.json")
    _, draft, _ = _hadoop(spark, f"{root}/_commits/.{new['number']}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(new).encode()))
    finally:
        stream.close()
    if not fs.rename(draft, p):
        raise RuntimeError(f"commit {new['number']} of {root} is there already")


def _kept(spark: SparkSession, root: str) -> list[dict]:
    """The newest records; the others are deleted."""
    found = numbers(spark, root)
    for number in found[: -KEEP - 1]:
        _delete(spark, f"{root}/_commits/{number}.json")
    return [record(spark, root, n) for n in found[-KEEP - 1 :]]


# ---------------------------------------------------------------------------
# tables of a stream or a run
# ---------------------------------------------------------------------------


def read(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A table as of the newest record; empty where none names it."""
    version = record(spark, root).get("tables", {}).get(name)
    return state.empty(spark, schema) if version is None else spark.read.schema(schema).parquet(f"{root}/{name}/v={version}")


def read_snapshots(spark: SparkSession, root: str, name: str, schema: T.StructType, date: str | None = None) -> DataFrame:
    """The dated snapshots of a table as of the newest record; with ``date`` only that one's folder is opened."""
    found = record(spark, root).get("snapshots", {}).get(name, {})
    folders = [f"{root}/{name}/date={d}/v={v}" for d, v in sorted(found.items()) if date in (None, d)]
    if not folders:
        return state.empty(spark, schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*folders).select(*schema.names)


class Commit:
    """One batch's writes under ``root``: ``write`` and ``snapshot`` its tables, then ``done``."""

    def __init__(self, spark: SparkSession, root: str, stream: str, batch: int):
        self.spark, self.root, self.stream, self.batch = spark, root.rstrip("/"), stream, batch
        old = record(spark, self.root)
        self.number, self.batches = old["number"] + 1, dict(old.get("batches", {}))
        self.tables, self.snapshots = dict(old.get("tables", {})), {n: dict(d) for n, d in old.get("snapshots", {}).items()}
        self.seen = old.get("seen")

    @property
    def repeated(self) -> bool:
        """Whether a record holds this batch (or a later one): then there is nothing to do."""
        return self.batch <= self.batches.get(self.stream, -1)

    def _version(self, folder: str) -> int:
        return max([self.number, *(n + 1 for n, _, _ in state.versions(self.spark, folder))])

    def old(self, name: str, schema: T.StructType) -> DataFrame:
        return read(self.spark, self.root, name, schema)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table's next version and read it back."""
        version = self._version(f"{self.root}/{name}")
        df.write.parquet(f"{self.root}/{name}/v={version}")
        self.tables[name] = version
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}/v={version}")

    def snapshot(self, df: DataFrame, name: str, date: str) -> None:
        """Write the snapshot of ``date`` anew: it follows its table while batches of that date come."""
        folder = f"{self.root}/{name}/date={date}"
        version = self._version(folder)
        df.write.parquet(f"{folder}/v={version}")
        self.snapshots.setdefault(name, {})[date] = version

    def done(self) -> None:
        """Make all writes count at once, then delete what no kept record names."""
        new = {"number": self.number, "batches": {**self.batches, self.stream: self.batch}, "tables": self.tables, "snapshots": self.snapshots}
        if self.seen is not None:
            new["seen"] = self.seen
        _put(self.spark, self.root, new)
        kept = _kept(self.spark, self.root)
        for name, newest in self.tables.items():
            named = {r.get("tables", {}).get(name) for r in kept}
            self._clean(f"{self.root}/{name}", newest, named)
        for name, dates in self.snapshots.items():
            for date, newest in dates.items():
                if newest == max(dates.values()):  # only the date at hand has changed
                    named = {r.get("snapshots", {}).get(name, {}).get(date) for r in kept}
                    self._clean(f"{self.root}/{name}/date={date}", newest, named)

    def _clean(self, folder: str, newest: int, named: set) -> None:
        for version, path, _ in state.versions(self.spark, folder):
            if version < newest and version not in named:
                _delete(self.spark, path)


# ---------------------------------------------------------------------------
# the seen cache
# ---------------------------------------------------------------------------


class SeenStore:
    """Seen articles by processed date: ``<path>/processed_date=<d>/part=<n>``, visible as its record names them.

    A run appends its new rows only; a date beyond the TTL leaves the record as a whole;
    the parts of a date are merged when there are ``MERGE`` of them, so neither a
    batch's cost nor the number of files grows with the batches before it.
    """

    def __init__(self, spark: SparkSession, path: str, number: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.record = record(spark, self.path, number)

    @property
    def number(self) -> int:
        return self.record["number"]

    def _folder(self, date: str, part: int) -> str:
        return f"{self.path}/processed_date={date}/part={part}"

    def read(self, as_of: str | None = None, ttl_days: int | None = None) -> DataFrame:
        """The rows, of dates within the TTL only if ``as_of`` is given: other dates' folders are not opened."""
        dates = self.record.get("dates", {})
        if as_of is not None:
            dates = {d: parts for d, parts in dates.items() if d >= days_before(as_of, ttl_days)}
        folders = [self._folder(d, p) for d, parts in sorted(dates.items()) for p in parts]
        if not folders:
            return state.empty(self.spark, schemas.SEEN)
        return self.spark.read.schema(schemas.SEEN).option("basePath", self.path).parquet(*folders).select(*schemas.SEEN.names)

    def append(self, rows: DataFrame, date: str, by: tuple[str, int] | None = None, expire_before: str | None = None) -> int:
        """Add (article_id, url, title) rows of one processed date; returns the record's number.

        ``by`` names a stream and its batch: a batch that the record holds is not added again.
        """
        done = dict(self.record.get("by", {}))
        if by is not None and done.get(by[0], -1) >= by[1]:
            return self.number
        number, dates = self.number + 1, {d: list(p) for d, p in self.record.get("dates", {}).items()}
        there = [int(n[5:]) for n in _names(self.spark, f"{self.path}/processed_date={date}") if n.startswith("part=")]
        part, parts = max([number, *(n + 1 for n in there)]), dates.get(date, [])
        rows = rows.select("article_id", "url", "title")
        if len(parts) + 1 >= MERGE:
            old = self.spark.read.schema(rows.schema).parquet(*(self._folder(date, p) for p in parts))
            rows, parts = old.unionByName(rows), []
        rows.write.parquet(self._folder(date, part))
        dates[date] = [*parts, part]
        if expire_before is not None:
            dates = {d: p for d, p in dates.items() if d >= expire_before}
        if by is not None:
            done[by[0]] = by[1]
        self.record = {"number": number, "dates": dates, "by": done}
        _put(self.spark, self.path, self.record)
        self._clean()
        return number

    def _clean(self) -> None:
        kept = _kept(self.spark, self.path)
        named = {(d, p) for r in kept for d, parts in r.get("dates", {}).items() for p in parts}
        for name in _names(self.spark, self.path):
            if not name.startswith("processed_date="):
                continue
            date = name.partition("=")[2]
            if all(d != date for d, _ in named):
                _delete(self.spark, f"{self.path}/{name}")
                continue
            newest = max(p for d, p in named if d == date)
            for part in _names(self.spark, f"{self.path}/{name}"):
                if part.startswith("part=") and int(part[5:]) < newest and (date, int(part[5:])) not in named:
                    _delete(self.spark, f"{self.path}/{name}/{part}")


def days_before(as_of: str, days: int | None = None) -> str:
    """The first day within the TTL of ``as_of``."""
    return (datetime.date.fromisoformat(as_of) - datetime.timedelta(days=dims.CACHE_TTL_DAYS if days is None else days)).isoformat()


def read_seen(spark: SparkSession, path: str, as_of: str | None = None, number: int | None = None) -> DataFrame:
    """The seen cache within the TTL of ``as_of``: the dated store, and a versioned table of earlier runs if there is one.

    Rows of an earlier table whose date can't be read are kept, as ``evict_stale`` does.
    """
    from ..operators import filters

    dated = SeenStore(spark, path, number).read(as_of)
    version = state.latest_version(spark, path)
    if version is None:
        return dated
    old = spark.read.schema(schemas.SEEN).parquet(version)
    return dated.unionByName(filters.evict_stale(old, as_of) if as_of else old)


# ---------------------------------------------------------------------------
# Bloom filter
# ---------------------------------------------------------------------------

# Words of 64 bits: at most 2^20 of them are broadcast (12 MB of words and places).
MAX_WORDS = 1 << 20
BITS_A_KEY = 12
# Beyond this many keys a word the filter would let nearly all through.
FULL = 24


def _probe(key: str, words: int):
    """(word, mask) of a key: one word, four of its bits."""
    h = F.xxhash64(F.col(key))
    bits = F.lit(0).cast("long")
    for i in range(4):
        bits = bits.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(`{key}`), {6 * i}) & 63 as int))"))
    return F.pmod(F.shiftright(h, 24), F.lit(words)).alias("_word"), bits.alias("_mask")


def bloom_filter(seen: DataFrame, key: str = "article_id", words: int | None = None) -> tuple[DataFrame, int] | None:
    """A blocked Bloom filter over ``seen``'s keys as rows (_word, _bits), and its number of words; None if there are too many keys."""
    if words is None:
        keys = seen.count()
        words = min(MAX_WORDS, max(1 << 10, 1 << max(keys * BITS_A_KEY // 64, 1).bit_length()))
        if keys > FULL * words:
            return None
    word, mask = _probe(key, words)
    return seen.select(word, mask).groupBy("_word").agg(F.expr("bit_or(_mask)").alias("_bits")), words


def anti_seen(entries: DataFrame, seen: DataFrame, key: str = "article_id") -> DataFrame:
    """Entries whose key isn't in ``seen``: a Bloom filter lets the surely new ones pass, only the others are joined.

    The filter's size is bounded by ``MAX_WORDS``, so it is broadcast; above its capacity
    there is the plain anti-join.
    """
    from ..operators import joins

    found = bloom_filter(seen, key)
    if found is None:
        return joins.anti_seen(entries, seen, key)
    table, words = found
    word, mask = _probe(key, words)
    probed = entries.select("*", word, mask).join(F.broadcast(table), "_word", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    surely_new = probed.where(~maybe).select(*entries.columns)
    checked = probed.where(maybe).select(*entries.columns).join(seen.select(key), key, "left_anti")
    return surely_new.unionByName(checked.select(*entries.columns))
