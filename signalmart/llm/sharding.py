"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0 to N - 1 in ascending order of (id, text checksums), null ids
first; rows equal in all of these are interchangeable and keep the order in
which they were first written.  A balanced Feistel network over the smallest
even number of bits that holds N, with cycle walking (apply it again until the
value is below N), permutes the numbers; the value p puts its row at slot
p div shards of shard p mod shards.  So shards differ by at most one row, slots
have no gaps, and anyone who knows N, the seed and the row number can compute
shard and slot, and back, without a table.

The numbering takes one range sort of narrow rows and one count per partition;
texts are read once and not shuffled.

Defined cases: a null text counts no bytes and has the checksum of an empty one;
an empty table gives no rows; repeated rows each get a place of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmart.llm.common import shared_table

ROUNDS = 6


class Feistel:
    """A permutation of 0 to n - 1 given by a seed, and its inverse."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{seed}/{r}".encode()).digest()[:8], "little")) for r in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ key
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in keys:
            left, right = right, left ^ self._mix(right, key)
        return right << np.uint64(self.half) | left  # halves swapped, so that reversed keys invert

    def _walk(self, values: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        out = self._once(np.asarray(values).astype(np.uint64), keys)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._once(out[outside], keys)
        return out.astype(np.int64)

    def permute(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, self.keys)

    def invert(self, values: np.ndarray) -> np.ndarray:
        return self._walk(values, self.keys[::-1])


def _checksums(text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.octet_length(text).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("crc32"), F.xxhash64(text).alias("h")]


def row_numbers(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a stable table) with ``row``: its place from 0 in the order of these columns, which must tell rows apart."""
    placed = rows.orderBy(*(F.asc_nulls_first(c) for c in order)).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    placed = shared_table(placed, "placed-rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the sort
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return placed.join(F.broadcast(starts), "part").withColumn("row", F.col("first") + F.col("place")).drop("part", "place", "first")


def assign(docs: DataFrame, shards: int, seed: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, bytes, crc32, tie, row, shard, slot) for each row; ``tie`` numbers the rows as first written."""
    if shards < 1:
        raise ValueError("there must be a shard")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_checksums(text_col), F.monotonically_increasing_id().alias("tie"))
    return _deal(shared_table(narrow, "checksums"), shards, seed)


def _deal(narrow: DataFrame, shards: int, seed: int) -> DataFrame:
    feistel = Feistel(narrow.count(), seed)

    @F.pandas_udf("long")
    def permuted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(feistel.permute(rows.to_numpy()))

    numbered = row_numbers(narrow, ["doc_id", "crc32", "h", "tie"]).withColumn("p", permuted("row"))
    return numbered.select("doc_id", "bytes", "crc32", "tie", "row", F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"p div {shards}").alias("slot"))


def shard_documents(docs: DataFrame, shards: int, seed: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (columns of these names are replaced).

    The rows are copied to the shared folder once, with a number to join by.
    """
    docs = docs.drop("shard", "slot")
    key = next(f"tie_{i}" for i in range(len(docs.columns) + 1) if f"tie_{i}" not in docs.columns)
    copied = shared_table(docs.withColumn(key, F.monotonically_increasing_id()), "documents")
    narrow = copied.select(F.col(id_col).cast("long").alias("doc_id"), *_checksums(text_col), F.col(key).alias("tie"))
    dealt = _deal(shared_table(narrow, "checksums"), shards, seed).select(F.col("tie").alias(key), "shard", "slot")
    return copied.join(dealt, key).select(*docs.columns, "shard", "slot")
