"""SimHash near-dedup by anchor-point covering.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles.
Two fingerprints at most ``max_distance`` (0 to 3) bits apart differ in at
most one bit of their lower or their upper half, so each half is searched for
distance 1.  The anchors of a half are the code words of the perfect Hamming
code on 31 of its 32 bits: covering radius 1, so every fingerprint has one
home anchor at distance 0 or 1.  A fingerprint is replicated to every anchor
within the covering radius plus the distance sought, 2: that is one anchor for
a code word and 16 otherwise.  If y differs from x in at most one bit, the home
of x is within 2 of y, so every close pair meets at an anchor: there the whole
64 bits are compared.  Nothing is capped or sampled.

Equal fingerprints are made one row first (partial aggregation), so a group of
copies of any size costs one row; classes are connected components of the
links between different fingerprints.

Defined cases: a null or empty text, and one without words, has fingerprint
zero, linked like any other; texts shorter than a shingle hash their whole word
sequence; rows with a null ``doc_id`` are linked by their fingerprint, and a
class's id is the smallest non-null ``doc_id`` in it (null if there is none);
repeated rows each keep a row; an empty table gives no rows.  Classes are told
apart by fingerprints, not by ids: one ``doc_id`` with two texts can be in two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart.llm.common import map_batches, shared_table, small_side
from signalmart.llm.components import connected_components

SEED = 42
# Shingles whose bits are counted at a time (64 bytes each).
VOTE_BLOCK = 1 << 15
CODE_BITS = 31


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of a whole text; zero where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.dtype("<u8"), len(ends))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTE_BLOCK):
        block = hashes[at : at + VOTE_BLOCK]
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", id_col: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, also...): the fingerprint as a signed 64-bit integer; ``also`` are long columns to carry along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *also])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "fp", *also))
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *also), run, schema)


def home_anchors(half: np.ndarray) -> np.ndarray:
    """The nearest code word of each 31-bit word: the syndrome is the place of the one bit to flip."""
    syndrome = np.zeros_like(half)
    for place in range(1, CODE_BITS + 1):
        syndrome ^= ((half >> (place - 1)) & 1) * place
    return np.where(syndrome == 0, half, half ^ (np.int64(1) << np.maximum(syndrome - 1, 0)))


def anchors_within_two(half: np.ndarray) -> np.ndarray:
    """(n, 32): every code word within 2 bits of each 31-bit word, with repeats."""
    flips = np.concatenate(([0], np.int64(1) << np.arange(CODE_BITS, dtype=np.int64)))
    return home_anchors(half[:, None] ^ flips[None, :])


def to_anchors(fps: DataFrame, replicate: bool) -> DataFrame:
    """(anchor, fp) for both halves: the home anchor, or all anchors within radius plus distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.int64((1 << CODE_BITS) - 1)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for which in (0, 1):
                half = (fp >> (32 * which)) & mask
                if replicate:
                    found = np.sort(anchors_within_two(half), axis=1)
                    first = np.ones(found.shape, bool)
                    first[:, 1:] = found[:, 1:] != found[:, :-1]
                    anchor, own = found[first], np.repeat(fp, first.sum(axis=1))
                else:
                    anchor, own = home_anchors(half), fp
                yield pa.RecordBatch.from_arrays([pa.array(anchor | np.int64(which << 32)), pa.array(own)], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def close_pairs(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """(a, b): all pairs of different fingerprints at most ``max_distance`` bits apart, once or twice each."""
    if not 0 <= max_distance <= 3:
        raise ValueError("max_distance must be 0 to 3: the anchors cover one differing bit in a half")
    home = to_anchors(fps, False).select("anchor", F.col("fp").alias("a"))
    near = to_anchors(fps, True).select("anchor", F.col("fp").alias("b"))
    return home.join(near, (home.anchor == near.anchor) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)).select("a", "b")


def fingerprint_classes(own: DataFrame, max_distance: int = 2) -> DataFrame:
    """(fp, component, component_id) of the different fingerprints of ``own``: the class's smallest fingerprint and smallest id."""
    distinct = shared_table(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    linked = connected_components(close_pairs(distinct, max_distance))
    classes = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    # written out: a join with an aggregate on its own key could not be split
    classes = shared_table(classes, "fingerprint-classes")
    least = shared_table(classes.groupBy("component").agg(F.min("first_id").alias("component_id")), "least-ids")
    return classes.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row; see the module docstring."""
    own = shared_table(with_fingerprints(docs, shingle, text_col, id_col), "fingerprints")
    return own.join(fingerprint_classes(own, max_distance), "fp").select("doc_id", "fp", "component_id")


def hex64(col: Column) -> Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))


ROW_KEY = ("text_key", "row_key")


def with_row_keys(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with two 64-bit hashes that tell rows apart, of the text and of all columns that can be hashed, and their (free) names.

    Hashing skips nulls, so each value goes with its null mark; the literals
    make the two hashes independent.
    """

    def marked(names: list[str]) -> list[Column]:
        return [c for n in names for c in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))]

    plain = [f.name for f in docs.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("text_key", "row_key"):
        while name in taken:
            name = f"_{name}"
        names.append(name)
    return docs.withColumns({names[0]: F.xxhash64(F.lit(1), *marked([text_col])), names[1]: F.xxhash64(F.lit(2), *marked(plain))}), tuple(names)


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with exactly one row of each near-duplicate class, whatever ids repeat or are null.

    The row with the smallest id stays (null ids last), among those of one id
    the one with the smallest row key; rows equal in every column stay once.
    """
    keyed, names = with_row_keys(docs, text_col)
    wanted = keyed.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(F.col(n).alias(k) for n, k in zip(names, ROW_KEY)))
    own = shared_table(with_fingerprints(wanted, shingle, also=ROW_KEY), "fingerprints")
    rows = own.join(fingerprint_classes(own, max_distance).select("fp", "component"), "fp")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW_KEY)
    rows = shared_table(rows.select("component", key.alias("key")), "classes")
    best = shared_table(rows.groupBy("component").agg(F.min("key").alias("best"), F.count(F.lit(1)).alias("n")), "best-rows")
    marked = rows.join(best.filter("n > 1"), "component")
    gone = marked.filter("not key <=> best").select(F.col("key.doc_id").alias("doc_id"), *(F.col(f"key.{k}").alias(k) for k in ROW_KEY)).distinct()
    gone = small_side(shared_table(gone, "copies")).alias("gone")
    same = F.col(f"kept.`{id_col}`").cast("long").eqNullSafe(F.col("gone.doc_id"))
    for n, k in zip(names, ROW_KEY):
        same = same & (F.col(f"kept.{n}") == F.col(f"gone.{k}"))
    kept = keyed.alias("kept").join(gone, same, "left_anti")
    if not marked.filter("key <=> best").groupBy("component").count().filter("count > 1").isEmpty():
        # rows equal in every column that can be hashed
        kept = kept.dropDuplicates([id_col, *names])
    return kept.drop(*names)
