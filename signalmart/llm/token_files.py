"""Token-id files: documents' ids, concatenated, with Elias-Fano boundaries.

**Encoding.**  The tokenizers library encodes; since this kind of vocabulary drops
white space, a text's ids are those of its white-space-separated chunks, and a
chunk's are remembered (in two generations of at most ``MAX_CHUNKS`` chunks of up to
``MAX_LENGTH`` characters: a full one becomes the old one, from which what is met again
is taken over).  Texts are taken ``GROUP`` characters at a time, so what a task holds is
bounded in bytes.  A chunk of letters before plain punctuation is split there, as the library's own
pattern does, and lower-cased as its normaliser does; such words go to the
library's model many to a call.  Texts of letters and single punctuation marks, most of them,
are lower-cased and split so as a whole, so a word is remembered once, however it is written.  A text that holds the string of an added token
(such as an end mark) goes to the library whole, which gives that token's id.

**Order.**  Ranges of ``doc_id`` are cut at quantiles of that column alone, so
the texts are encoded once and their ids shuffled once.  Within a range rows are
sorted by doc_id (null first; equal ids by their token bytes) and written as
segments of about ``SEGMENT_IDS`` ids; a longer document has a segment of its
own.

**Format** of a segment (little-endian): ``EFID``, format 1, bytes per id (2
where the vocabulary allows, else 4), number of null doc ids, documents and ids;
the Elias-Fano sequence of the n + 1 boundaries; the smallest doc id and the
Elias-Fano sequence of the doc ids less it; the ids.  An Elias-Fano sequence
holds each value's lower bits packed and its upper bits in unary; select over
the unary bits returns an offset by sampled counts, made on reading: 16 bits for each
512 unary bits, and 64 bits for each 65,536.  Segments are the rows of a Parquet table (any store Spark writes to
will do); a row's payload is a complete file image.

Defined cases: a null or empty text has the end id only; repeated rows are
written each; an empty table gives no segments and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from signalmart.llm.common import TEXT_BATCH_ROWS, batch_settings, keep, mapped_table, shared_table, small_side, without_cycles

MAX_VOCABULARY_BYTES = 64 << 20
MAX_CHUNKS = 80_000
MAX_LENGTH = 64
GROUP = 1 << 19
SEGMENT_IDS = 1 << 20
RANGE_ROWS = 20_000
MAGIC = b"EFID"

PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
MARKS = ".,;:!?"
# Letters as in ``PLAIN``, marks, blanks and line ends, one byte each; and all marks as one.
PLAIN_BYTES = bytes(b for b in range(256) if re.fullmatch(f"[A-Za-zÀ-ÖØ-öø-ÿ {MARKS}\n]", chr(b)))
ONE_MARK = bytes.maketrans(MARKS.encode(), b"." * len(MARKS))
WORDS_TO_A_CALL = 512


# ---------------------------------------------------------------- encoding


def _spaced(text: str) -> str:
    for blank in "\n\t\r":
        if blank in text:
            text = text.replace(blank, " ")
    return text


def _is_plain(text: str) -> bool:
    """Whether a text can be split as a whole: no other character, no run of marks."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not raw.translate(None, PLAIN_BYTES) and b".." not in raw.translate(ONE_MARK)


class ChunkEncoder:
    """Texts to packed ids through a memo of chunks."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [(t.content.lower() if t.normalized else t.content, t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.width = id_width(len(vocabulary))
        self.kind = np.dtype(f"<u{self.width}")
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # The library's model alone, for lower-case words that its normaliser and
        # split pattern leave as they are: many to a call, told apart by the word ends.
        self.words, self.ascii_words = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # the byte alphabet leaves ASCII letters as they are
        suffix = self.tokenizer.model.end_of_word_suffix
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.tells_ends = bool(suffix)
        if suffix:
            self.is_end[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _plain_words(self, words: list[str], tokenizer: Tokenizer) -> Iterator[tuple[str, bytes]]:
        blocks = [words[at : at + WORDS_TO_A_CALL] for at in range(0, len(words), WORDS_TO_A_CALL)]
        for block, found in zip(blocks, tokenizer.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            ends = ((np.flatnonzero(self.is_end[ids]) + 1) * self.width).tolist()
            if len(ends) != len(block):
                raise ValueError("the vocabulary does not mark word ends")
            packed = ids.tobytes()
            yield from zip(block, map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends)))

    def _library(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return ((chunk, np.array(x.ids, self.kind).tobytes()) for chunk, x in zip(chunks, found))

    def _learn(self, chunks: set[str]) -> None:
        """Take the ids of these chunks into the memo."""
        memo, tailed, rest = self.memo, [], chunks
        letters = [c for c in chunks if c.isascii() and c.isalpha()] if self.tells_ends else []
        if self.tells_ends:
            rest = []
            for chunk in chunks.difference(letters):
                if m := PLAIN.fullmatch(chunk):
                    tailed.append((chunk, m[1].lower(), m[2]))
                else:
                    rest.append(chunk)
        memo.update(self._library([chunk for chunk in rest if chunk]))
        memo[""] = b""
        memo.update(self._library(list({tail for _, _, tail in tailed}.difference(memo))))
        lowered = list(map(str.lower, letters))
        words = {word for _, word, _ in tailed}.union(lowered)
        known = words.intersection(memo.keys())
        parts = dict(zip(known, map(memo.__getitem__, known)))
        new = words.difference(known)
        parts.update(self._plain_words([w for w in new if w.isascii()], self.ascii_words))
        parts.update(self._plain_words([w for w in new if not w.isascii()], self.words))
        memo.update(zip(letters, map(parts.__getitem__, lowered)))
        memo.update({chunk: parts[word] + memo[tail] for chunk, word, tail in tailed})

    def _holds_added(self, text: str) -> bool:
        return any(content in (text.lower() if normalized else text) for content, normalized in self.added)

    def _chunks(self, text: str) -> list[str] | None:
        """What a text's ids are made of, in order; None for one that the library takes whole."""
        if self.tells_ends and _is_plain(text):
            text = text.lower()
            for mark in MARKS:
                if mark in text:
                    text = text.replace(mark, " " + mark)
        elif self._holds_added(text):
            return None
        return _spaced(text).split(" ")

    def _group(self, texts: list[str]) -> list[bytes]:
        split = list(map(self._chunks, texts))
        wanted: set[str] = set().union(*(chunks for chunks in split if chunks is not None))
        unknown = wanted.difference(self.memo)
        if len(self.memo) + len(unknown) > MAX_CHUNKS:
            self.old, self.memo, unknown = self.memo, {}, wanted
        again = self.old.keys() & unknown
        self.memo.update(zip(again, map(self.old.__getitem__, again)))
        unknown = unknown.difference(again)
        self._learn(unknown)
        get = self.memo.__getitem__
        out = [b"".join(map(get, chunks)) if chunks is not None else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes() for text, chunks in zip(texts, split)]
        for chunk in unknown:
            if len(chunk) > MAX_LENGTH:
                del self.memo[chunk]
        return out

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Packed ids of each whole text, with the end id."""
        end = np.array([end_id], self.kind).tobytes()
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > GROUP:
                out += self._group(group)
                group, size = [], 0
        out += self._group(group)
        return [ids + end for ids in out]


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


# ---------------------------------------------------------------- Elias-Fano


# Words of 64 unary bits to a block, blocks to a superblock.
BLOCK, SUPER = 8, 128


class EliasFano:
    """A non-decreasing sequence of unsigned integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        # blocks of 8 words, superblocks of 128 blocks
        padded = high + bytes(-len(high) % (8 * BLOCK * SUPER) or (0 if high else 8 * BLOCK * SUPER))
        self.words = np.frombuffer(padded, "<u8").reshape(-1, BLOCK)
        ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64).reshape(-1, SUPER)
        within = np.cumsum(ones, axis=1)
        self.blocks = (within - ones).astype(np.uint16)
        self.supers = np.concatenate(([0], np.cumsum(within[:, -1])))[:-1]

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little").tobytes())

    def select(self, i: np.ndarray) -> np.ndarray:
        """The place of the i-th set bit (from 0) among the unary bits."""
        above = np.searchsorted(self.supers, i, side="right") - 1
        rest = i - self.supers[above]
        counts = self.blocks[above]
        block = (counts <= rest[:, None]).sum(axis=1) - 1
        at = above * SUPER + block
        rest = rest - np.take_along_axis(counts, block[:, None], axis=1)[:, 0]
        words = self.words[at]
        ones = np.bitwise_count(words).astype(np.int64)
        before = np.cumsum(ones, axis=1) - ones
        word = (before <= rest[:, None]).sum(axis=1) - 1
        rest = rest - np.take_along_axis(before, word[:, None], axis=1)[:, 0]
        chosen = np.take_along_axis(words, word[:, None], axis=1)
        bits = np.unpackbits(chosen.view(np.uint8), axis=1, bitorder="little")
        inside = np.argmax(np.cumsum(bits, axis=1, dtype=np.int64) > rest[:, None], axis=1)
        return (at * BLOCK + word) * 64 + inside

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        i = np.asarray(i, np.int64)
        high = (self.select(i) - i).astype(np.uint64)
        if not self.low_bits:
            return high
        places = i[:, None] * self.low_bits + np.arange(self.low_bits)
        packed = np.frombuffer(self.low, np.uint8)
        bits = (packed[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(np.uint64)
        return high << np.uint64(self.low_bits) | (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def all(self, block: int = 4096) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(self.get(np.arange(at, min(at + block, self.n))) for at in range(0, self.n, block))])

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, low, high = struct.unpack_from("<QBQQ", data, at)
        at += struct.calcsize("<QBQQ")
        return cls(n, low_bits, bytes(data[at : at + low]), bytes(data[at + low : at + low + high])), at + low + high


# ---------------------------------------------------------------- segments


def segment_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The file image of documents in order; null doc ids come first."""
    ends = np.cumsum([0] + [len(x) // width for x in ids])
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    above = np.array([d - least for d in known], np.uint64)
    head = MAGIC + struct.pack("<BBQQQ", 1, width, len(doc_ids) - len(known), len(doc_ids), int(ends[-1]))
    return b"".join([head, EliasFano.of(ends).to_bytes(), struct.pack("<q", least), EliasFano.of(above).to_bytes(), *ids])


class Segment:
    """A file image, read: boundaries by select, ids as an array."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if data[:4] != MAGIC:
            raise ValueError("not a token-id segment")
        version, width, self.nulls, self.n_docs, self.n_ids = struct.unpack_from("<BBQQQ", view, 4)
        if version != 1:
            raise ValueError(f"unknown format {version}")
        self.ends, at = EliasFano.read(view, 4 + struct.calcsize("<BBQQQ"))
        self.least = struct.unpack_from("<q", view, at)[0]
        self.above, at = EliasFano.read(view, at + 8)
        self.ids = np.frombuffer(data, f"<u{width}", count=self.n_ids, offset=at)

    def bounds(self, i: int) -> tuple[int, int]:
        """Where the i-th document's ids begin and end."""
        begin, end = self.ends.get(np.array([i, i + 1])).tolist()
        return begin, end

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds(i)
        return self.ids[begin:end]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.least + x for x in self.above.all().tolist()]


# ---------------------------------------------------------------- jobs


def _cuts(docs: DataFrame) -> list[int]:
    """Boundaries of doc_id ranges with about ``RANGE_ROWS`` rows; only that column is read."""
    rows = docs.count()
    ranges = max(rows // RANGE_ROWS + 1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 500 + 1))
    if ranges < 2:
        return []
    cuts = docs.filter("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    return sorted({int(c) for c in cuts})


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode each whole text, append ``end_id``, write segments in ascending doc_id order; the table of segments.

    Its rows: range, segment (within the range), n_docs, n_ids, payload.
    """
    if os.path.getsize(tokenizer_path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer_path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = np.array(_cuts(docs), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _per_worker(vocabulary.value)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else None
            places = np.searchsorted(cuts, own, side="left") if own is not None else [0 if d is None else int(np.searchsorted(cuts, d, side="left")) for d in batch.column(0).to_pylist()]
            ids = encoder.encode(batch.column(1).to_pylist(), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int32()), pa.array(ids, pa.binary()), pa.array([encoder.width] * len(ids), pa.int32())], ["doc_id", "range", "ids", "width"])

    encoded = docs.mapInArrow(without_cycles(encode), "doc_id long, range int, ids binary, width int")
    dealt = encoded.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", F.asc_nulls_first("doc_id"), "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int | None, bytes]] = []
        at, segment, size, width = -1, 0, 0, 2

        def row() -> pa.RecordBatch:
            payload = segment_bytes([d for d, _ in waiting], [x for _, x in waiting], width)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([segment], pa.int32()), pa.array([len(waiting)], pa.int64()), pa.array([size // width], pa.int64()), pa.array([payload], pa.binary())], ["range", "segment", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for doc_id, place, ids, width_here in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting and (place != at or size + len(ids) > SEGMENT_IDS * width):
                    yield row()
                    segment, size = segment + 1, 0
                    waiting.clear()
                if place != at:
                    at, segment = place, 0
                width = width_here
                waiting.append((doc_id, ids))
                size += len(ids)
        if waiting:
            yield row()

    packed = dealt.mapInArrow(pack, "range int, segment int, n_docs long, n_ids long, payload binary")
    with batch_settings(docs.sparkSession, TEXT_BATCH_ROWS, 16 << 20):
        return shared_table(packed, "token-files")


def _per_worker(vocabulary: str) -> ChunkEncoder:
    """One encoder for all tasks that a Python worker runs with this vocabulary."""
    return keep(("chunks", hash(vocabulary)), lambda: ChunkEncoder(vocabulary))


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the segments.

    ``start`` counts the ids of all documents before it.  The segments' sums run
    within ranges, and over one row for each range.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, number, payload in zip(*(c.to_pylist() for c in batch.columns)):
                segment = Segment(payload)
                ends = segment.ends.all().astype(np.int64)
                crcs = [zlib.crc32(segment.ids[b:e].astype("<u4")) for b, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                n = segment.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(segment.doc_ids(), pa.int64()), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())],
                    ["range", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    # few segments to a batch: each is some MB
    own = mapped_table(files.select("range", "segment", "payload"), read, "range int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long", "token-documents", rows=8)
    sizes = files.select("range", "segment", "n_ids")
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("range").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("base")).join(ranges, "range")
    starts = small_side(shared_table(starts.select("range", "segment", (F.col("base") + F.col("first")).alias("base")), "segment-starts"))
    return own.join(starts, ["range", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
