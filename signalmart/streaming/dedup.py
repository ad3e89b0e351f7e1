"""De-duplication across feeds as keyed streaming state.

The batch run keeps, of a url, the entries of the first feed that has it (repeats
inside that feed too), and drops the url in later runs while the seen cache
holds it.  ``stream_dedup`` is the stream of such runs: a run is a cycle of event time, and
each url has a state of its own.

* With ``hold``, a url's entries wait while their cycle is open, only those of the smallest feed
  number so far (null counts as the last feed).  A timer at the cycle's end lets them out.
  What comes out is what a batch run over the whole cycle keeps, however its files landed.
* Without it they come out at once: the first feed is that of the entry with the
  earliest event time, of the smallest number among equally early ones.
* The cycle and feed that let entries out own the url until ``ttl_days`` after the
  cycle's start: other entries are dropped, and a timer ends the state.

Either way the result depends on event times and feed numbers only, not on how the files
fell into triggers (without ``hold``: if they land in the order of their event
times).  A cycle closes when the watermark passes its end, ``delay`` behind the
newest cycle that the stream has seen; what comes later than that is dropped as
late, as by any watermark.  Without ``hold`` a new url's entries of one trigger are compared in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import dims

DAY_MS = 86_400_000
LAST_FEED = (1 << 31) - 1
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# Timestamps keep their microseconds in a payload, and null fields stay in their places.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


class FirstFeed(StatefulProcessor):
    """State of one url; input rows are (key, cycle_start, cycle, cycle_end, at, feed, payload), times in milliseconds."""

    def __init__(self, ttl_ms: int, hold: bool):
        self.ttl_ms, self.hold = ttl_ms, hold

    def init(self, handle) -> None:
        self.handle = handle
        self.owned = handle.getValueState("owned", "cycle long, feed int, until long")
        self.open = handle.getMapState("open", "cycle long", "cycle_end long, feed int")
        self.waiting = handle.getListState("waiting", "cycle long, feed int, payload string")

    def _owner(self) -> tuple[int, int, int] | None:
        return tuple(self.owned.get()) if self.owned.exists() else None

    def _own(self, cycle: int, feed: int) -> tuple[int, int, int]:
        until = cycle + self.ttl_ms
        self.owned.update((cycle, feed, until))
        self.handle.registerTimer(until + 1)
        return cycle, feed, until

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        owner, least, found = self._owner(), {}, {}
        for row in rows:
            cycle, feed = row["cycle"], row["feed"]
            if owner is not None and cycle <= owner[2]:
                if not self.hold and (cycle, feed) == owner[:2]:
                    yield Row(payload=row["payload"])
                continue
            if not self.hold:
                found.setdefault(cycle, []).append((row["at"], feed, row["payload"]))
                continue
            if cycle not in least:
                least[cycle] = self.open.getValue((cycle,))[1] if self.open.containsKey((cycle,)) else None
            if least[cycle] is None or feed < least[cycle]:
                least[cycle] = feed
                self.open.updateValue((cycle,), (row["cycle_end"], feed))
                self.handle.registerTimer(row["cycle_end"])
            if feed == least[cycle]:
                self.waiting.appendValue((cycle, feed, row["payload"]))
        for cycle in sorted(found):
            if owner is None or cycle > owner[2]:
                owner = self._own(cycle, min(found[cycle])[1])
            for _, feed, payload in found[cycle]:
                if (cycle, feed) == owner[:2]:
                    yield Row(payload=payload)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, owner = expiredTimerInfo.getExpiryTimeInMs(), self._owner()
        if owner is not None and owner[2] < now:
            self.owned.clear()
            owner = None
        ended = sorted((k[0], v[1]) for k, v in self.open.iterator() if v[0] <= now)
        if not ended:
            return
        chosen = set()
        for cycle, feed in ended:
            self.open.removeKey((cycle,))
            if owner is None or cycle > owner[2]:
                owner = self._own(cycle, feed)
                chosen.add((cycle, feed))
        done, rest = {c for c, _ in ended}, []
        for cycle, feed, payload in self.waiting.get():
            if cycle not in done:
                rest.append((cycle, feed, payload))
            elif (cycle, feed) in chosen:
                yield Row(payload=payload)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def stream_dedup(df: DataFrame, key: str = "article_id", ts: str = "ingest_ts", feed_ord: str = "feed_ord", ttl_days: int = dims.CACHE_TTL_DAYS, cycle: str = "MONTH", delay: str = "31 days", hold: bool = False) -> DataFrame:
    """``df`` without the entries that a run per ``cycle`` (DAY, WEEK, MONTH) would drop; see the module docstring.

    The stream must not carry a watermark yet.  State is kept in RocksDB, which timers need.
    """
    df.sparkSession.conf.set(*STATE_STORE)
    start = F.date_trunc(cycle, F.col(ts))
    rows = df.select(
        F.col(key).cast("string").alias("key"),
        start.alias("cycle_start"),
        F.unix_millis(start).alias("cycle"),
        F.unix_millis(start + F.expr(f"INTERVAL 1 {cycle}")).alias("cycle_end"),
        F.unix_millis(F.col(ts)).alias("at"),
        F.coalesce(F.col(feed_ord).cast("int"), F.lit(LAST_FEED)).alias("feed"),
        F.to_json(F.struct(*df.columns), JSON).alias("payload"),
    )
    kept = rows.withWatermark("cycle_start", delay).groupBy("key").transformWithState(FirstFeed(ttl_days * DAY_MS, hold), "payload string", "Append", "EventTime")
    return kept.select(F.from_json("payload", df.schema, JSON).alias("row")).select("row.*")
