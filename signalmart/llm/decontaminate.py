"""Benchmark decontamination with one FM-index per training shard.

Test items are cut into phrases: every window of ``window`` consecutive words,
or the whole item where it has fewer.  Each task gathers its documents into
shards; a shard's words become numbers of the phrases' vocabulary, other words
separate.  Stretches shorter than the shortest phrase can't hold one and are
left out; the rest is one sequence, over which the FM-index is built: suffix
order by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix
with popcount ranks, and sampled suffix positions.  All phrases are searched
backward together, occurrences are located by stepping to the next sampled
position, and the spans of a document are merged.

The items travel to the tasks in blocks of at most ``BLOCK_BYTES`` of text, by
a measured size: one block is read by the driver, broadcast and applied at a
time, so a benchmark of any size works, in as many passes as it has blocks.

Defined cases: a null or empty text has no words; an item without words, or
null, is never found; items that share an id count once; a null item id is the
empty string; repeated documents are each judged; an empty table gives no rows.
A document longer than a shard makes a shard of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmart.llm.common import map_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
BLOCK_BYTES = 2 << 20
SHARD_SYMBOLS = 1 << 19
SHARD_TEXT = 24 << 20
SAMPLE = 8


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


# ---------------------------------------------------------------- FM-index


class BitRank:
    """A bit vector in 64-bit words with running counts."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.counts[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1


class WaveletMatrix:
    """Ranks and access over a sequence of small integers, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.levels: list[BitRank] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        start, i = np.zeros_like(i), i
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones_i, ones_s = level.rank(i), level.rank(start)
            i = np.where(one, zeros + ones_i, i - ones_i)
            start = np.where(one, zeros + ones_s, start - ones_s)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros):
            bit, ones = level.get(i), level.rank(i)
            symbol = symbol << 1 | bit
            i = np.where(bit == 1, zeros + ones, i - ones)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes still tied are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    key = symbols[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = 1
    while True:
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.concatenate((starts, [n])))
        tied = np.repeat(sizes > 1, sizes)
        if not tied.any() or step >= n:
            return order
        at = np.flatnonzero(tied)
        suffix = order[at]
        after = np.where(suffix + step < n, rank[np.minimum(suffix + step, n - 1)], -1)
        group = rank[suffix]
        by = np.lexsort((after, group))
        order[at], group, after = suffix[by], group[by], after[by]
        fresh[at[1:]] |= (after[1:] != after[:-1]) | (group[1:] != group[:-1])
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))[at]
        step *= 2


class FmIndex:
    """Search in one sequence of symbols 1 to ``top``; the end is marked by 0, which stands nowhere else."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = SAMPLE):
        symbols = np.concatenate((symbols, [0]))
        order = suffix_array(symbols)
        self.n = len(symbols)
        self.bwt = WaveletMatrix(symbols[order - 1], top)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        marked = order % sample == 0
        self.marked, self.sampled = BitRank(marked), order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For phrases of one length (rows): those that occur, and their rows' range in suffix order."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[which, k]
            low = self.before[symbol] + self.bwt.rank(symbol, low)
            high = self.before[symbol] + self.bwt.rank(symbol, high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row in suffix order, by steps back to a sampled one."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = rows[left]
            hit = self.marked.get(here) == 1
            done = left[hit]
            found[done] = self.sampled[self.marked.rank(rows[done])] + steps[done]
            left = left[~hit]
            symbol = self.bwt.access(rows[left])
            rows[left] = self.before[symbol] + self.bwt.rank(symbol, rows[left])
            steps[left] += 1
        return found


# ---------------------------------------------------------------- phrases


class Phrases:
    """A block of items: vocabulary, different phrases by length, and whose they are."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.number: dict[bytes, int] = {}  # words from 2 on; 1 separates
        self.items = sorted({item for item, _ in items})
        place = {item: i for i, item in enumerate(self.items)}
        by_length: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.number.setdefault(w, len(self.number) + 2) for w in words], np.int64)
            width = min(window, len(ids))
            rows = np.lib.stride_tricks.sliding_window_view(ids, width)
            phrases, owners = by_length.setdefault(width, ([], []))
            phrases.append(rows)
            owners.append(np.full(len(rows), place[item], np.int64))
        self.shortest = min(by_length, default=0)
        self.by_length = {}
        for width, (phrases, owners) in by_length.items():
            different, which = np.unique(np.concatenate(phrases), axis=0, return_inverse=True)
            pairs = np.unique(np.stack((which.ravel(), np.concatenate(owners)), axis=1), axis=0)
            first = np.searchsorted(pairs[:, 0], np.arange(len(different) + 1))
            self.by_length[width] = (different, pairs[:, 1], first)


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of many ranges, and which range each is of."""
    sizes = last - first
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[which], which


class Shard:
    """Documents gathered for one index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.symbols, self.doc, self.start = phrases, [], [], []
        self.size, self.docs = 0, 0

    def add(self, text: str | None) -> int:
        """Index a document; its number of words."""
        words, doc = words_of(text), self.docs
        self.docs += 1
        least = self.phrases.shortest
        if not least or len(words) < least:
            return len(words)
        ids = np.fromiter(map(self.phrases.number.get, words, repeat(0)), np.int64, len(words))
        gaps = np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))
        long = np.flatnonzero(np.diff(gaps) > least)
        for begin, end in zip((gaps[long] + 1).tolist(), gaps[long + 1].tolist()):
            self.symbols.append(np.concatenate((ids[begin:end], [1])))
            self.doc.append(doc)
            self.start.append(begin)
            self.size += end - begin + 1
        return len(words)

    def find(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences (document, first word, length) and the pairs of document and item found."""
        none = np.zeros(0, np.int64)
        if not self.symbols:
            return none, none, none, none, none
        index = FmIndex(np.concatenate(self.symbols), len(self.phrases.number) + 1)
        lengths = np.fromiter(map(len, self.symbols), np.int64, len(self.symbols))
        begins = np.cumsum(lengths) - lengths
        doc, start = np.array(self.doc), np.array(self.start)
        spans, owned = [], []
        for width, (different, owners, first) in self.phrases.by_length.items():
            which, low, high = index.search(different)
            rows, of = _expand(low, high)
            at = index.locate(rows)
            run = np.searchsorted(begins, at, side="right") - 1
            spans.append(np.stack((doc[run], start[run] + at - begins[run], np.full(len(at), width)), axis=1))
            seen = np.unique(np.stack((doc[run], which[of]), axis=1), axis=0)
            owner, pair = _expand(first[seen[:, 1]], first[seen[:, 1] + 1])
            owned.append(np.stack((seen[pair, 0], owners[owner]), axis=1))
        spans, owned = np.concatenate(spans), np.unique(np.concatenate(owned), axis=0)
        return spans[:, 0], spans[:, 1], spans[:, 2], owned[:, 0], owned[:, 1]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps or touching ends."""
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((begin, end))
    return merged


def text_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as spans of code points in the text."""
    data = text.encode("utf-8", "surrogatepass")
    bounds = [m.span() for m in WORD.finditer(data.lower())]
    return [(len(data[: bounds[b][0]].decode("utf-8", "replace")), len(data[: bounds[e - 1][1]].decode("utf-8", "replace"))) for b, e in spans]


# ---------------------------------------------------------------- jobs


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    return [items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("words", SPAN), T.StructField("spans", SPAN)])


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", keep: list[str] | None = None, found_col: str = "found", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (None: all) and ``found_col`` for each row.

    ``found_col`` holds n_words, n_hit, the item ids found, and the merged
    spans to remove, as words and as code points of the text (ends exclusive).
    A column of that name in ``docs`` is replaced.
    """
    docs = docs.drop(found_col)
    keep = docs.columns if keep is None else keep
    blocks = _blocks(benchmark, item_id_col, item_text_col)
    for k, block in enumerate(blocks):
        rows = [(r["item"], r["text"]) for r in block.collect()]
        docs = _scan(docs, Phrases(rows, window), text_col, found_col, keep if k == len(blocks) - 1 else [c for c in docs.columns if c != found_col])
    return docs


def _scan(docs: DataFrame, phrases: Phrases, text_col: str, found_col: str, keep: list[str]) -> DataFrame:
    """One pass with one block of phrases; earlier passes' findings are in ``found_col``."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    earlier = found_col in docs.columns
    used = [c for c in docs.columns if c in {*keep, text_col, found_col}]
    docs = docs.select(*used)
    out = T.StructType([*(docs.schema[c] for c in used if c in keep and c != found_col), T.StructField(found_col, FOUND)])
    places, text_at = [used.index(f.name) for f in out.fields[:-1]], used.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, counts, texts, before, size = Shard(shared.value), [], [], [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            doc, start, length, owner, item = shard.find()
            words: dict[int, list] = {}
            items: dict[int, set] = {}
            for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist()):
                words.setdefault(d, []).append((s, s + n))
            for d, i in zip(owner.tolist(), item.tolist()):
                items.setdefault(d, set()).add(shared.value.items[i])
            found = []
            for d, n_words in enumerate(counts):
                old = before[d] or {"words": [], "items": []}
                spans = merge(words.get(d, []) + [(x["start"], x["end"]) for x in old["words"]])
                places_in = text_spans(texts[d], spans) if spans else []
                as_rows = [[{"start": b, "end": e} for b, e in x] for x in (spans, places_in)]
                found.append({"n_words": n_words, "n_hit": sum(e - b for b, e in spans), "items": sorted(items.get(d, set()).union(old["items"])), "words": as_rows[0], "spans": as_rows[1]})
            at = 0
            for columns, n in waiting:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found[at : at + n], ARROW_FOUND)], names=out.names)
                at += n

        for batch in batches:
            text = batch.column(text_at).to_pylist()
            counts += [shard.add(t) for t in text]
            texts += text
            before += batch.column(used.index(found_col)).to_pylist() if earlier else [None] * len(text)
            waiting.append(([batch.column(i) for i in places], len(text)))
            size += sum(map(len, filter(None, text)))
            if shard.size >= SHARD_SYMBOLS or size >= SHARD_TEXT:
                yield from emit()
                shard, waiting, counts, texts, before, size = Shard(shared.value), [], [], [], [], 0
        if waiting:
            yield from emit()

    return map_batches(docs, run, out)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("words", _SPANS), ("spans", _SPANS)])


def contaminated(found: str = "found") -> Column:
    """At least a twentieth of the words, and at least one, are hit."""
    return (F.col(f"{found}.n_hit") > 0) & (20 * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, in one pass and without a shuffle."""
    found = next(f"found_{i}" for i in range(len(docs.columns) + 1) if f"found_{i}" not in docs.columns)
    return find_phrases(docs, benchmark, window, text_col, None, found).filter(~contaminated(found)).select(*docs.columns)
