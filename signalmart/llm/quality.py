"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

**Features.**  A text's words are its runs of other than white space.  Each word has
a surface (lower-cased) and a shape (runs of capitals, small letters and digits
become one sign each, other signs stay, at most two in a row; a word equal to
the one before it has a shape of its own).  Surface 1- and 2-grams and shape 1-
to 3-grams are hashed into ``2 ** bits`` buckets; a bucket's value is
log(1 + count), and the vector is scaled to length 1.  Bucket 0 is the bias.

**Training.**  FTRL-Proximal keeps, per bucket, the sums z and n and derives the
weight from them.  The labelled rows are dealt by a hash of their id over shards
of about ``shard_rows``; each shard's task makes as many passes over its rows as give
``min_updates`` updates over all shards (three at the full ``max_train_rows``), and the weights
are the mean over shards (exact decimal sums, so no order matters).  At most ``max_train_rows`` labelled rows are used, those with the smallest id
hashes: a documented bound, chosen before any text is read.  Labels 0 and 1
count; a row's other labels are ignored, and of several labels of one id the
smallest holds.  Nothing but texts and labels enters.

**Scoring.**  Each task scores its whole texts as sparse dot products with the
broadcast weights (``2 ** bits`` floats, so bounded).

Defined cases: a null or empty text has the bias only; a table without usable
labels gives score 0.5 for all; repeated rows are scored alike; labels without a
document are ignored; very long texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmart.llm.common import map_batches, shared_table


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    max_train_rows: int = 20_000
    shard_rows: int = 2_500
    min_updates: int = 60_000
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


MAX_WORDS = 150_000
SAME = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)
SHAPES = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1{2,}"), r"\1\1")]


class Words(dict):
    """Memo of words: the hashes of surface and shape, packed; emptied at ``MAX_WORDS``."""

    def __missing__(self, word: str) -> bytes:
        shape = word
        for pattern, by in SHAPES:
            shape = pattern.sub(by, shape)
        packed = xxhash.xxh64_digest(word.lower().encode("utf-8", "surrogatepass"))[::-1] + xxhash.xxh64_digest(shape.encode("utf-8", "surrogatepass"), 1)[::-1]
        if len(self) > MAX_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = packed
        return packed


def features(text: str | None, words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bucket numbers and their values for a whole text."""
    both = np.frombuffer(b"".join(map(words.__getitem__, (text or "").split())), "<u8").reshape(-1, 2)
    surface, shape = both[:, 0], both[:, 1].copy()
    shape[1:][surface[1:] == surface[:-1]] = SAME
    pair = shape[:-1] * STEP + shape[1:]
    grams = np.concatenate((surface, surface[:-1] * STEP + surface[1:], shape ^ SAME, pair ^ (SAME >> np.uint64(1)), pair[:-1] * STEP + shape[2:]))
    grams ^= grams >> np.uint64(29)
    bucket, count = np.unique((grams * STEP >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    if len(bucket) and bucket[0] == 0:
        bucket, count = bucket[1:], count[1:]
    value = np.log1p(count)
    value /= max(np.linalg.norm(value), 1e-12)
    return np.concatenate(([0], bucket)), np.concatenate(([1.0], value))


class Ftrl:
    """FTRL-Proximal for logistic loss; the bias isn't regularised."""

    def __init__(self, settings: Settings):
        self.s, size = settings, 1 << settings.bits
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.l1 = np.full(size, settings.l1)
        self.l1[0] = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.s.beta + np.sqrt(self.n[at])) / self.s.alpha + self.s.l2)

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ value)) - label) * value
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] = grown


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x >= 0 else math.exp(x) / (1.0 + math.exp(x))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row's id is kept out of training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> np.ndarray:
    """The weights by bucket, learned from labelled rows that aren't held out."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("__id"), "__id").limit(settings.max_train_rows)
    chosen = shared_table(chosen, "training-labels")
    n_rows = max(1, chosen.count())
    shards, passes = -(-n_rows // settings.shard_rows), -(-settings.min_updates // n_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    # an id may have very many documents: one of them is learned from, the same for any layout of the table
    rows = rows.groupBy("__id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        model, words = Ftrl(settings), Words()
        rows = rows.assign(order=[zlib.crc32(str(i).encode()) for i in rows["id"]]).sort_values(["order", "id", "text"], kind="stable", na_position="first")
        examples = [(*features(t, words, settings.bits), y) for t, y in zip(rows["text"], rows["label"])]
        for _ in range(passes):
            for bucket, value, label in examples:
                model.update(bucket, value, label)
        weights = model.weights()
        found = np.flatnonzero(weights)
        return pd.DataFrame({"bucket": found, "weight": weights[found]})

    dealt = rows.select(F.col("__id").cast("long").alias("id"), "text", "label", F.pmod(F.xxhash64("__id"), F.lit(shards)).alias("shard"))
    fitted = dealt.groupBy("shard").applyInPandas(lambda pdf: fit(pdf).assign(shard=int(pdf["shard"].iloc[0])), "bucket long, weight double, shard long")
    sums = fitted.groupBy("bucket").agg(F.sum(F.col("weight").cast("decimal(28,14)")).cast("double").alias("total")).toPandas()
    weights = np.zeros(1 << settings.bits, np.float64)
    weights[sums["bucket"].to_numpy(np.int64)] = sums["total"].to_numpy(np.float64) / shards
    return weights


def score(docs: DataFrame, weights: np.ndarray, bits: int = Settings.bits, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score) for each row: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = Words(), shared.value
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                bucket, value = features(text, words, bits)
                scores.append(sigmoid(float(w[bucket] @ value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    scored = score(docs, train(docs, labels, settings), settings.bits)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; scores and texts travel together, so nothing is shuffled."""
    weights = train(docs, labels, settings, text_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = Words(), shared.value
        for batch in batches:
            good = []
            for text in batch.column(at).to_pylist():
                bucket, value = features(text, words, settings.bits)
                good.append(sigmoid(float(w[bucket] @ value)) >= 0.5)
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_batches(docs, run, docs.schema)
