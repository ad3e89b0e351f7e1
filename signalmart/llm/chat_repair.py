"""Conversation structure repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``.

``repair`` takes turns ``in_order``, or ``damaged`` ones: logged conversations with faults
put in by a rule, so that there is something to find.

A row's first fault counts: blank, duplicate (role and text seen earlier in the
conversation), truncated (no closing mark at the end).  Edits and what they cost:
Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and
duplicate rows), Insert an empty turn 3; a truncated row that isn't deleted costs 3
more.  The audit is the initials of the cheapest edits in order, among equally
cheap ones the least in ASCII.

Persistent audit DP (``Audit``): after each row there is one best edit sequence for
each state of the pattern (nothing yet, system, user, assistant).  The sequences
are linked nodes that share their prefixes, each with binary-lifting ancestors
and a rolling hash of its prefix.  Equal costs are decided by a search for the
longest common prefix down the ancestors; equal hashes are verified along the
links (pairs found equal are joined, so no stretch is walked twice), so a
collision can't change a result.  States that can't win any more are dropped, and
when nodes pile up the live paths are copied and the prefix that all of them
share is settled, so memory follows what is undecided, not the conversation.

Work is dealt by conversation, and rows stream through a task in order; only
the audit, a letter a turn, is held whole, as it is one value.  Texts pass once more,
beside the parts of the audit, into the running hash of the repaired
conversation.  A result is one sequential hash over a conversation, so a very
long one is a long task, in bounded memory.

Defined cases: null conv_id, turn, role and text count as one space, in the damage
rule and as values; a null conv_id is a conversation of its own, a null turn comes first;
rows of one turn are in order of role and text; repeated rows are duplicates; very long texts are bounded by Arrow's
2 GB a value only; conversations that lose all rows give zeros, an empty audit and the hash of the
empty string; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmart.llm.common import mapped_table, shared_table

# Fixed values of the pattern: white space, closing marks, role pairs that may be neighbours.
WHITE = "\x20\t\n\x0b\x0c\r"
CLOSING = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
# States of the pattern.
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
# Nodes from which the live paths are copied; rows of a part of the audit.
NODES = 1 << 15
PART = 4096

MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Paths:
    """Edit sequences as linked nodes; node 0 is the empty one."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.letter, self.depth, self.hash, self.up, self.same = [0], [0], [0], [[]], [0]

    def add(self, parent: int, letter: int) -> int:
        node, depth = len(self.letter), self.depth[parent] + 1
        ancestors = [parent]
        for k in range(depth.bit_length() - 1):
            higher = self.up[ancestors[k]]
            if len(higher) <= k:
                break
            ancestors.append(higher[k])
        self.letter.append(letter)
        self.depth.append(depth)
        self.hash.append((self.hash[parent] * BASE + letter) % self.modulus)
        self.up.append(ancestors)
        self.same.append(node)
        return node

    def lift(self, node: int, depth: int) -> int:
        """The ancestor at ``depth``."""
        while self.depth[node] > depth:
            gap = self.depth[node] - depth
            node = self.up[node][gap.bit_length() - 1]
        return node

    def first_same(self, node: int) -> int:
        while self.same[node] != node:
            self.same[node] = node = self.same[self.same[node]]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two sequences of one length are equal: by hash, then verified along the links."""
        if self.hash[a] != self.hash[b]:
            return False
        walked = []
        while (x := self.first_same(a)) != (y := self.first_same(b)):
            if self.letter[a] != self.letter[b]:
                return False
            walked.append((x, y))
            a, b = self.up[a][0], self.up[b][0]
        for x, y in walked:
            self.same[self.first_same(y)] = self.first_same(x)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether sequence ``a`` is before ``b`` in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        shorter = self.depth[a] < self.depth[b]
        a, b = self.lift(a, depth), self.lift(b, depth)
        if self.equal(a, b):
            return shorter
        for k in range(depth.bit_length() - 1, -1, -1):
            if k < len(self.up[a]) and k < len(self.up[b]) and not self.equal(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return self.letter[a] < self.letter[b]

    def spelled(self, node: int, top: int = 0) -> bytes:
        """The letters below ``top`` down to ``node``."""
        letters = bytearray()
        while node != top:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return bytes(reversed(letters))


class Audit:
    """The DP of one conversation: ``step`` for each row, then ``result``."""

    def __init__(self, modulus: int = MODULUS, nodes: int = NODES):
        self.modulus, self.limit, self.nodes = modulus, nodes, nodes
        self.paths, self.settled = Paths(modulus), bytearray()
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._insert()

    def _offer(self, best: list, state: int, cost: int, parent: int, letter: int) -> bool:
        old = best[state]
        if old is not None and old[0] < cost:
            return False
        node = self.paths.add(parent, letter)
        if old is None or old[0] > cost or self.paths.less(node, old[1]):
            best[state] = (cost, node)
            return True
        return False

    def _insert(self) -> None:
        """Insertions after the row at hand: shortest paths over the four states."""
        best, changed = self.best, True
        while changed:
            changed = False
            for state, to in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
                if best[state] is not None and (best[to] is None or best[to][0] >= best[state][0] + INSERT):
                    changed |= self._offer(best, to, best[state][0] + INSERT, best[state][1], ord("I"))

    def step(self, initial: str, fault: int) -> None:
        before, self.best = self.best, [None] * 4
        extra = CUT if fault == TRUNCATED else 0
        for state, found in enumerate(before):
            if found is None:
                continue
            cost, node = found
            self._offer(self.best, state, cost + DELETE, node, ord("D"))
            if fault in (BLANK, DUPLICATE):
                continue
            to = ASSISTANT if state == USER else USER
            if (initial, to) in (("u", USER), ("a", ASSISTANT)):
                self._offer(self.best, to, cost + extra, node, ord("K"))
            if initial == "s" and state == START:
                self._offer(self.best, SYSTEM, cost + extra, node, ord("K"))
            self._offer(self.best, to, cost + REROLE + extra, node, ord("R"))
        self._insert()
        # From ASSISTANT any way on from the first two states can be gone at no more than this.
        top = self.best[ASSISTANT]
        if top is not None:
            for state, more in ((START, DELETE), (SYSTEM, 0)):
                if self.best[state] is not None and self.best[state][0] > top[0] + more:
                    self.best[state] = None
        if len(self.paths.letter) > self.limit:
            self._copy()

    def _copy(self) -> None:
        """Settle what all live paths share and copy what they don't."""
        old, live = self.paths, [x[1] for x in self.best if x is not None]
        top = live[0]
        for node in live[1:]:
            top, node = (old.lift(x, min(old.depth[top], old.depth[node])) for x in (top, node))
            for k in range(len(old.up[top]) - 1, -1, -1):
                if k < len(old.up[top]) and old.up[top][k] != old.up[node][k]:
                    top, node = old.up[top][k], old.up[node][k]
            if top != node:
                top = old.up[top][0]
        self.settled += old.spelled(top)
        self.paths, moved = Paths(self.modulus), {top: 0}
        for state, found in enumerate(self.best):
            if found is None:
                continue
            way, node = [], found[1]
            while node not in moved:
                way.append(node)
                node = old.up[node][0]
            for node in reversed(way):
                moved[node] = self.paths.add(moved[old.up[node][0]], old.letter[node])
            self.best[state] = (found[0], moved[found[1]])
        self.limit = max(self.nodes, 2 * len(self.paths.letter))

    def result(self) -> tuple[int, bytes]:
        """(cost, audit): the pattern ends with nothing or after an assistant."""
        none, full = self.best[START], self.best[ASSISTANT]
        if none is None or (full is not None and (full[0] < none[0] or (full[0] == none[0] and self.paths.less(full[1], none[1])))):
            none = full
        return none[0], bytes(self.settled) + self.paths.spelled(none[1])


def _rows(turns: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role0"),
        F.coalesce(F.col("text").cast("string"), space).alias("text0"),
    )


def _placed(rows: DataFrame, role: Column, text: Column, *ties: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role0", "text0", *ties)
    return rows.repartition("conv_id").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.row_number().over(order).alias("place"))


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place) of all rows as they are, nulls as one space."""
    return _placed(_rows(turns), F.col("role0"), F.col("text0"))


def damaged(turns: DataFrame) -> DataFrame:
    """The same after damage by crc32(``conv_id:turn``) modulo 20.

    0 drops the row, 1 empties its text, 2 removes its closing marks, 3 repeats it, 4 makes its role user.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = _rows(turns).withColumn("fate", F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20).filter("fate <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role0"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text0", "".join(CLOSING), "")).otherwise(F.col("text0"))
    return _placed(rows, role, text, "copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    ended = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (
        F.when(ended == "", BLANK)
        .when(F.row_number().over(earlier) > 1, DUPLICATE)
        .when(~F.right(ended, F.lit(1)).isin(*CLOSING), TRUNCATED)
        .otherwise(NONE)
    )
    return rows.withColumn("fault", fault.cast("int"))


FOUND = "conv_id long, part long, first_place long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
FOUND_NAMES = [f.split()[0] for f in FOUND.split(", ")]


class _Conversation:
    """What pass one keeps of the conversation at hand."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.audit, self.faults, self.illegal = conv_id, Audit(), [0] * 4, 0
        self.last, self.low, self.high, self.turns = None, None, None, 0

    def row(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        self.faults[fault] += 1
        self.audit.step(initial, fault)

    def rows_out(self) -> Iterator[tuple]:
        """The summary (part null, whole audit), then the parts of the audit, each of ``PART`` rows."""
        cost, audit = self.audit.result()
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        text = audit.decode("ascii")
        yield (self.conv_id, None, None, gaps, *self.faults[BLANK:], self.illegal, cost, text)
        part, start, place, taken = 0, 0, 1, 0
        for at, letter in enumerate(text, 1):
            taken += letter != "I"
            if taken == PART or at == len(text):
                yield (self.conv_id, part, place, None, None, None, None, None, None, text[start:at])
                part, start, place, taken = part + 1, at, place + taken, 0


def audits(rows: DataFrame) -> DataFrame:
    """``FOUND`` rows of a table (conv_id, place, turn, role, fault): one summary a conversation, and the audit in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv_id, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    out.extend(now.rows_out() if now else ())
                    now = _Conversation(conv_id)
                now.row(turn, initial, fault)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(FOUND_NAMES, zip(*out))], FOUND_NAMES)
                out = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(FOUND_NAMES, zip(*now.rows_out()))], FOUND_NAMES)

    narrow = rows.select("conv_id", "place", "turn", F.left("role", F.lit(1)).alias("initial"), "fault")
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return mapped_table(ordered.select("conv_id", "turn", "initial", "fault"), run, FOUND, "audits")


def apply_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, step, edit, role, text): the rows with their edits, inserted ones too, in order.

    ``step`` numbers the repaired turns and is null for deleted rows.
    """
    return _edited(rows, found, "conv_id long, place long, step long, edit string, role string, text string", _edits, "edits")


def _edits(conv_id: int | None, turns: Iterator[tuple]) -> Iterator[tuple]:
    step = 0
    for place, edit, role, text in turns:
        step += edit != "D"
        yield conv_id, place, None if edit == "D" else step, edit, role, text


def _digest(conv_id: int | None, turns: Iterator[tuple]) -> Iterator[tuple]:
    sha, first = hashlib.sha256(), True
    for _, edit, role, text in turns:
        if edit != "D":
            sha.update(b"" if first else b"\n")
            sha.update(f"{role}:{text}".encode())
            first = False
    yield conv_id, sha.hexdigest()


def _replay(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(place, edit, role, text) of a conversation from its rows and, before the rows they cover, its audit's parts."""
    edits, at, after = "", 0, "s"

    def role_now() -> str:
        return "assistant" if after == "u" else "user"

    for _, place, role, text, part in rows:
        if part is not None:
            edits, at = edits[at:] + part, 0
            continue
        while edits[at] == "I":
            yield None, "I", role_now(), ""
            after, at = role_now()[0], at + 1
        edit, at = edits[at], at + 1
        if edit == "R":
            role = role_now()
        if edit != "D":
            after = role[0]
        yield place, edit, role, text
    for _ in edits[at:]:
        yield None, "I", role_now(), ""
        after = role_now()[0]


def _edited(rows: DataFrame, found: DataFrame, schema: str, make, name: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64() if f.endswith("long") else pa.string() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        source, out, size = flat(), [], 0
        row = next(source, None)
        while row is not None:
            conv_id, ahead = row[0], [row]

            def one() -> Iterator[tuple]:
                while ahead[0] is not None and ahead[0][0] == conv_id:
                    yield ahead[0]
                    ahead[0] = next(source, None)

            for made in make(conv_id, _replay(one())):
                out.append(made)
                size += 64 + len(made[-1] or "")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, size = [], 0
            row = ahead[0]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    turns = rows.select("conv_id", F.col("place").cast("long").alias("place"), "role", "text", F.lit(None).cast("string").alias("part"))
    parts = found.filter("part is not null").select("conv_id", F.col("first_place").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.col("audit").alias("part"))
    both = turns.unionByName(parts).repartition("conv_id").sortWithinPartitions("conv_id", "place", F.desc_nulls_last("part"))
    return mapped_table(both, run, schema, name)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, the cheapest audit and the hash of what is repaired.

    ``rows`` come from ``in_order`` or ``damaged``; ``conversations`` may name more
    conversations (conv_id) than those that have rows.
    """
    rows = shared_table(with_faults(rows), "faulty-turns")
    everyone = (rows if conversations is None else conversations).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = audits(rows)
    hashes = _edited(rows, found, "conv_id long, repaired_sha256 string", _digest, "repaired")
    summary = found.filter("part is null").drop("part", "first_place").withColumnRenamed("conv_id", "c")
    hashes = hashes.withColumnRenamed("conv_id", "h")
    whole = everyone.join(summary, F.expr("conv_id <=> c"), "left").join(hashes, F.expr("conv_id <=> h"), "left")
    counts = [_zero(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
