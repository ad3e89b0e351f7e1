"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

**Encoding.**  A text is cut by the split pattern; each piece is read byte by
byte by a transducer.  A sequence of tokens is the BPE encoding of its bytes
exactly if the merges leave every two neighbours apart, so each prefix of a
piece has one last token: the one that ends there, starts at a position whose
own last token it may stand beside, and so continues that position's encoding.
A state holds the positions from which a longer token may still come: for each
its place in the token trie and the last token before it.  No position stays
alive longer than the longest token, so the lookahead is bounded; what the
encodings up to all of them share is settled and emitted.  States are numbered
and their transitions worked out from the merges when first met (lazy
determinisation) and then only looked up; the table is emptied when it
exceeds ``MAX_TRANSITIONS``, as is the memo of finished pieces at
``MAX_PIECES``, so memory is bounded for any input.

**Decoding.**  Ids become bytes in blocks; an incremental UTF-8 machine holds
back the bytes of an unfinished character from one block to the next and
replaces what can't become one.

Defined cases: a null or empty text has no ids and decodes to nothing; ids that
the vocabulary lacks raise an error; repeated rows each get their own result.
The vocabulary is a parameter: the path of a rank file, read by the driver and
broadcast (its size is checked against ``MAX_VOCABULARY_BYTES``).
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmart.llm.common import keep, map_batches

MAX_VOCABULARY_BYTES = 64 << 20
MAX_TRANSITIONS = 1 << 18
MAX_PIECES = 200_000
# Bytes of a piece that wait before what is settled is emitted.
SETTLE = 4096
DECODE_BLOCK = 1 << 16

# Characters on which Python's classes and the pattern's Unicode classes agree.
COMMON = r"\x00-\x1b\x20-\x7f\xa0\xc0-ɏ‐-‧"
RARE = re.compile(f"[^{COMMON}]")
# The default split pattern in Python's classes, for texts of common characters only.
DEFAULT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_FAST = re.compile(r""" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank on each line), by rank."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


class Transducer:
    """Lazily determinised byte transducer for one vocabulary."""

    ROOT = 0

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, token in enumerate(tokens):
            node = self.ROOT
            for byte in token:
                nxt = self.child[node].get(byte)
                if nxt is None:
                    nxt = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = i
        self.length = list(map(len, tokens))
        self.longest = max(self.length)
        self._apart: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: by position still alive, its place in the trie and the last token before it
        start = ((self.ROOT, -1),)
        self.states = [start]
        self.number = {start: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges applied one after another, lowest rank first: the definition."""
        get, none = self.rank.get, len(self.rank)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.rank[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens beside each other."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > MAX_TRANSITIONS:
                self._apart.clear()
            known = self._apart[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the token that ends after ``byte``."""
        alive, whole, child, ends = [], -1, self.child, self.ends
        for node, last in self.states[state]:
            node = child[node].get(byte)
            if node is None:
                continue
            token = ends[node]
            if whole < 0 <= token and (last < 0 or self.apart(last, token)):
                whole = token
            if child[node]:
                alive.append((node, last))
        if whole < 0:
            raise ValueError(f"the vocabulary cannot encode byte {byte}")
        alive.append((self.ROOT, whole))
        nxt = tuple(alive)
        number = self.number.get(nxt)
        if number is None:
            number = self.number[nxt] = len(self.states)
            self.states.append(nxt)
        return number, whole

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece.

        ``last[i]`` is the token that ends after i bytes; stepping back by the
        tokens' lengths from a position gives the encoding up to it.  Within a
        long piece, what the encodings up to all positions still alive share is
        settled: it is emitted once ``SETTLE`` bytes wait.
        """
        own = self.rank.get(piece)
        if own is not None:
            return [own]
        out: list[int] = []
        last, state, steps, length = [-1], 0, self.steps, self.length
        for byte in piece:
            key = state << 8 | byte
            known = steps.get(key)
            if known is None:
                known = steps[key] = self.step(state, byte)
            state, token = known
            last.append(token)
            if len(last) > SETTLE:
                last = self._settle(last, state, out)
                if len(steps) > MAX_TRANSITIONS:
                    present = self.states[state]
                    self._reset()
                    self.states.append(present)
                    state = self.number[present] = 1
                    steps = self.steps
        at, back = len(last) - 1, []
        while last[at] >= 0 and at > 0:
            back.append(last[at])
            at -= length[last[at]]
        out += reversed(back)
        if len(steps) > MAX_TRANSITIONS:
            self._reset()
        return out

    def _settle(self, last: list[int], state: int, out: list[int]) -> list[int]:
        """Emit what the encodings up to every position still alive share; the rest waits."""
        at = max(0, len(last) - 1 - self.longest)  # no alive position lies before this
        ways = []
        for start in range(len(last) - 1, at - 1, -1):
            way = [start]
            while way[-1] > 0:
                way.append(way[-1] - self.length[last[way[-1]]])
            ways.append(way)
        point = max(set(ways[0]).intersection(*ways[1:]))
        emitted, i = [], point
        while i > 0:
            emitted.append(last[i])
            i -= self.length[last[i]]
        out += reversed(emitted)
        return [-1, *last[point + 1 :]] if point else last


class Encoder(dict):
    """Texts to ids; as a dict, the memo of finished pieces as packed little-endian 32-bit ids."""

    def __init__(self, tokens: list[bytes], pattern: str = DEFAULT_PATTERN):
        super().__init__()
        self.transducer = Transducer(tokens)
        self.pieces = regex.compile(pattern).findall
        self.fast = DEFAULT_FAST.findall if pattern == DEFAULT_PATTERN else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MAX_PIECES:
            self.clear()
        packed = np.array(self.transducer.encode(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        find = self.fast if self.fast and not RARE.search(text) else self.pieces
        return b"".join(map(self.__getitem__, find(text)))


class Utf8Machine:
    """Incremental UTF-8: the state is the unfinished character's bytes, at most three."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < need else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        hold = self._unfinished(data)
        self.held = data[len(data) - hold :]
        return data[: len(data) - hold].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens

    def blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        for at in range(0, len(ids), DECODE_BLOCK):
            yield b"".join(map(self.tokens.__getitem__, ids[at : at + DECODE_BLOCK].tolist()))

    def text(self, ids: np.ndarray) -> str:
        machine = Utf8Machine()
        return "".join([machine.feed(block) for block in self.blocks(ids)] + [machine.finish()])

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        """The decoded text in blocks; no character is cut."""
        machine = Utf8Machine()
        for block in self.blocks(ids):
            yield machine.feed(block)
        yield machine.finish()


def _per_worker(tokens: Broadcast, pattern: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder for all tasks that a Python worker runs with this vocabulary."""
    return keep(("bpe", hash(tuple(tokens.value)), pattern), lambda: (Encoder(tokens.value, pattern), Decoder(tokens.value)))


def encode(docs: DataFrame, ranks_path: str, pattern: str = DEFAULT_PATTERN, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``, an array of token ids, appended (a column of that name is replaced)."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    docs = docs.drop(ids_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _per_worker(tokens, pattern)
        for batch in batches:
            packed = [encoder.packed(t) for t in batch.column(names.index(text_col)).to_pylist()]
            ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*names, ids_col])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]), keeps=True)


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``, the text of an array of token ids (null: no ids), appended (a column of that name is replaced)."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    docs = docs.drop(text_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokens.value)
        for batch in batches:
            texts = [decoder.text(np.array(ids if ids is not None else [], np.int64)) for ids in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, text_col])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = DEFAULT_PATTERN, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, exact): encode each whole text, then decode its ids by the stream.

    ``exact``: whether the decoded text equals the text (null: empty).
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _per_worker(tokens, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha, exact = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                packed, back, at, same = encoder.packed(text), hashlib.sha256(), 0, True
                for block in decoder.stream(np.frombuffer(packed, "<u4")):
                    back.update(block.encode("utf-8"))
                    same = same and text[at : at + len(block)] == block
                    at += len(block)
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                decoded_sha.append(back.hexdigest())
                exact.append(same and at == len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha), pa.array(exact)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean", keeps=True)
