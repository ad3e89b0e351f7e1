"""Exact dedup: Patricia-trie owners.

Texts are compared as whole byte strings after their white space is deleted.
A task inserts its strings into a compressed radix trie (``Trie``): an edge
holds the bytes up to the next branching, and a node at which a string ends
holds what is known of its owner, the row that stays: the one with the most code
points in the original text, then the smallest id (null last), then the first row.

1. ``combine``: each input task has a trie of its own.  A row is written as
   (doc_id, member, ref) and each different string once as a partial owner under
   that ref, so a group of copies of any size leaves a task as one string.
2. Strings that very many tasks hold (``HOT`` or more) are combined once more,
   dealt by ref, so that no task gets one string from every other task.
3. ``settle``: partial owners are partitioned by length and content hash, into as
   many partitions as their bytes ask for, and each partition's trie gives the
   owners: equal strings always meet, and equality is decided by their bytes, the
   hash only deals them out.
4. Rows find their owner by ref.  A ref has the rows of one input task at most, so
   the copies of one text are never gathered.

Spill is by subtree: a trie above ``BUDGET`` bytes gives up its heaviest subtrees
below its first branching.  In ``combine`` its strings go out as partial owners (a later
copy starts a new one); in ``settle`` the node stays as a mark, all strings below
it go on to the next round, whole, and are dealt anew by another hash seed.  A
round always settles at least one string of each partition, so the rounds end.

Defined cases: null counts as empty, and a text of white space only equals it;
rows with a null id are compared like others, and own a group only if all its
ids are null (``keep_id`` is null then); repeated rows are one group, of which
exactly one row has ``kept``; very long texts are bounded by Arrow's 2 GB for a
value only; an empty table gives no rows.  Only the id and text columns are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmart.llm.common import mapped_table, shared_table, small_side

WHITE = b" \t\n\x0b\x0c\r"
# Bytes of strings a trie may hold, and what a node is reckoned beside its label.
BUDGET = 96 << 20
NODE = 400
# Bytes of strings dealt to a partition of ``settle``.
TARGET = 32 << 20
# Partial owners of one string from which they are combined before they meet.
HOT = 1024

LINK = "member long, doc_id long, ref long"
PARTIAL = "ref long, doc_id long, points long, member long, n long, size long, hash long, body binary"


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner = label, {}, None


def shared_prefix(key: bytes, at: int, label: bytes) -> int:
    """How many bytes ``label`` and ``key`` from ``at`` have in common."""
    most, step = min(len(label), len(key) - at), 16
    low = 0
    while low < most and key[at + low : at + min(low + step, most)] == label[low : min(low + step, most)]:
        low, step = min(low + step, most), step * 2
    high = min(low + step, most)
    while low < high:
        middle = (low + high + 1) // 2
        if key[at + low : at + middle] == label[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie of byte strings; ``held`` reckons its bytes."""

    SPILLED = object()

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def reach(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if need be, or the mark of a spilled subtree on its way."""
        node, at = self.root, 0
        while at < len(key):
            if node.owner is Trie.SPILLED:
                return node
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(child.label) + NODE
                return child
            if not key.startswith(child.label, at):
                cut = shared_prefix(key, at, child.label)
                upper = node.children[key[at]] = Node(child.label[:cut])
                child.label = child.label[cut:]
                upper.children[child.label[0]] = child
                self.held += NODE
                child = upper
            node, at = child, at + len(child.label)
        return node

    def walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        """(string, node) of every string at or below ``node``, whose own edge ends ``prefix``."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.owner is not None and node.owner is not Trie.SPILLED:
                yield prefix, node
            stack.extend((c, prefix + c.label) for c in node.children.values())

    def strings(self) -> Iterator[tuple[bytes, Node]]:
        return self.walk(self.root, b"")

    def weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE
            stack.extend(node.children.values())
        return total

    def spill(self, least: int, mark: bool) -> Iterator[tuple[bytes, Node]]:
        """Cut off the heaviest subtrees at the first branching until ``least`` bytes are held; give their strings.

        With ``mark`` the subtree's first byte stays as a mark, and one string or subtree is left.
        """
        node, prefix = self.root, b""
        while True:
            alive = {f: c for f, c in node.children.items() if c.owner is not Trie.SPILLED}
            if len(alive) != 1 or node.owner is not None:
                break
            node = next(iter(alive.values()))
            prefix += node.label
        weights = sorted(((self.weight(c), f) for f, c in alive.items()), reverse=True)
        if mark and node.owner is None:
            weights = weights[:-1]
        for weight, first in weights:
            if self.held <= least:
                break
            child = node.children.pop(first)
            self.held -= weight
            if mark:
                stub = node.children[first] = Node(bytes([first]))
                stub.owner = Trie.SPILLED
            yield from self.walk(child, prefix + child.label)


def _best(a: tuple, b: tuple) -> tuple:
    """The better of two owners (points, doc_id, member)."""
    return min(a, b, key=lambda o: (-o[0], o[1] is None, o[1] or 0, o[2]))


class Out:
    """Rows of one task gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size > 8 << 20:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


LONG = pa.int64()
COMBINED = pa.schema([("link", LONG), ("ref", LONG), ("doc_id", LONG), ("points", LONG), ("member", LONG), ("n", LONG), ("body", pa.binary())])


def combine(rows: DataFrame, name: str, sign: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """One trie per task over (link, doc_id, points, member, n, body): the links (link, doc_id, ref) and the partial owners.

    ``link`` null: a row of the documents, which gets a number unique in the
    table as its link and member.  ``sign`` (1 or -1) keeps refs of two calls apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        trie, out, refs, number = Trie(), Out(COMBINED), 0, 0
        for batch in batches:
            for link, doc_id, points, member, n, body in zip(*(c.to_pylist() for c in batch.columns)):
                key = (body or b"").translate(None, WHITE)
                if link is None:
                    link = member = base + number
                    number += 1
                node = trie.reach(key)
                if node.owner is None:
                    node.owner = [sign * (base + refs + 1), (points, doc_id, member), n]
                    refs += 1
                else:
                    node.owner[1] = _best(node.owner[1], (points, doc_id, member))
                    node.owner[2] += n
                yield from out.add((link, node.owner[0], doc_id, None, None, None, None))
                if trie.held > budget:
                    for key, node in trie.spill(budget // 2, False):
                        ref, (points, doc_id, member), n = node.owner
                        yield from out.add((None, ref, doc_id, points, member, n, key), len(key) + 64)
        for key, node in trie.strings():
            ref, (points, doc_id, member), n = node.owner
            yield from out.add((None, ref, doc_id, points, member, n, key), len(key) + 64)
        yield from out.flush()

    both = mapped_table(rows, run, "link long, ref long, doc_id long, points long, member long, n long, body binary", name)
    links = both.filter("link is not null").select("link", "doc_id", "ref")
    return links, both.filter("link is null").drop("link")


SETTLED = pa.schema([("ref", LONG), ("keep_id", LONG), ("keep_member", LONG), ("group_size", LONG), ("text_sha256", pa.string()), ("doc_id", LONG), ("points", LONG), ("member", LONG), ("n", LONG), ("body", pa.binary())])


def settle(partials: DataFrame, target: int = TARGET, budget: int = BUDGET) -> DataFrame:
    """(ref, keep_id, keep_member, group_size, text_sha256): the owner of every partial owner's string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), Out(SETTLED)

        def passed_on(key: bytes, entries: list) -> Iterator[pa.RecordBatch]:
            for ref, owner, n in entries:
                yield from out.add((ref, None, None, None, None, owner[1], owner[0], owner[2], n, key), len(key) + 64)

        for batch in batches:
            for ref, doc_id, points, member, n, key in zip(*(c.to_pylist() for c in batch.columns)):
                entry, node = (ref, (points, doc_id, member), n), trie.reach(key)
                if node.owner is Trie.SPILLED:
                    yield from passed_on(key, [entry])
                    continue
                if node.owner is None:
                    node.owner = []
                node.owner.append(entry)
                if trie.held > budget:
                    for key, node in trie.spill(budget // 2, True):
                        yield from passed_on(key, node.owner)
        for key, node in trie.strings():
            best, total = node.owner[0][1], 0
            for _, owner, n in node.owner:
                best, total = _best(best, owner), total + n
            sha = hashlib.sha256(key).hexdigest()
            for ref, _, _ in node.owner:
                yield from out.add((ref, best[1], best[2], total, sha, None, None, None, None, None), 160)
        yield from out.flush()

    schema = "ref long, keep_id long, keep_member long, group_size long, text_sha256 string, doc_id long, points long, member long, n long, body binary"
    done, left, seed = [], partials, 0
    while True:
        size = left.agg(F.sum(F.octet_length("body") + NODE)).first()[0]
        if size is None:
            break
        # length and content hash; another seed in each round deals a spilled subtree's strings anew
        dealt = left.repartition(-(-size // target), F.octet_length("body"), F.xxhash64(F.lit(seed), "body"))
        both = mapped_table(dealt.select("ref", "doc_id", "points", "member", "n", "body"), run, schema, "owners", rows=512)
        done.append(both.filter("group_size is not null").select("ref", "keep_id", "keep_member", "group_size", "text_sha256"))
        left, seed = both.filter("group_size is null").select("ref", "doc_id", "points", "member", "n", "body"), seed + 1
    if not done:
        return partials.sparkSession.createDataFrame([], "ref long, keep_id long, keep_member long, group_size long, text_sha256 string")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", hot: int = HOT, target: int = TARGET, budget: int = BUDGET) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; see the module docstring."""
    text, null = F.col(f"`{text_col}`").cast("string"), F.lit(None).cast("long")
    rows = docs.select(
        null.alias("link"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("points"),
        null.alias("member"),
        F.lit(1).cast("long").alias("n"),
        text.cast("binary").alias("body"),
    )
    links, partials = combine(rows, "text-owners", 1, budget)
    # strings that very many tasks hold meet in two steps
    key = (F.octet_length("body").alias("size"), F.xxhash64("body").alias("hash"))
    often = shared_table(partials.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= hot), "hot-strings")
    if not often.isEmpty():
        marked = partials.withColumns({"size": key[0], "hash": key[1]}).join(small_side(often), ["size", "hash"], "left")
        groups = F.pmod(F.xxhash64("ref"), F.ceil(F.sqrt("times")))
        hot_rows = marked.filter("times is not null").repartition("size", "hash", groups)
        relinks, merged = combine(hot_rows.select(F.col("ref").alias("link"), "doc_id", "points", "member", "n", "body"), "hot-owners", -1, budget)
        partials = shared_table(marked.filter("times is null").select(merged.columns).unionByName(merged), "all-owners")
        links = links.alias("l").join(relinks.select(F.col("link").alias("ref"), F.col("ref").alias("to")), "ref", "left").select("link", "doc_id", F.coalesce("to", "ref").alias("ref"))
    owners = shared_table(settle(partials, target, budget), "settled")
    return links.join(owners, "ref").select("doc_id", "keep_id", "group_size", (F.col("link") == F.col("keep_member")).alias("kept"), "text_sha256")
