"""Secret scan with multipart credential linking.

**Base kinds**, leftmost and without overlaps within a kind, always reported:
``assign`` (a secret's name, ``:`` or ``=``, and a value of 6 or more signs),
``access`` (``AKIA`` and capitals or digits, 20 or more in all) and ``hex`` (24 or
more small hexadecimal digits).  A match that is too short still uses up its text.

**Weak kinds** say little alone: ``key`` (a run of 32 or more base64 signs with
capitals, small letters and digits), ``id`` (a user's or client's name, ``:`` or
``=``, and a value) and ``endpoint`` (a URL, or host and port).  They are joined by
intervals: two parts are in one scope if they lie in the same paragraph (no blank
line between) and at most ``reach`` code points apart.  Reported are only
a ``key`` with an identifier (``access`` or ``id``) in scope, an ``id`` with a secret
(``assign``, ``hex`` or ``key``) in scope, and an ``endpoint`` with both an identifier
and a secret in scope.  Each is given the start of the nearest such part.  Parts
are sorted and searched by bisection, so a text with very many is no problem.

Defined cases: a null or empty text has no spans; spans are in code points, ends
exclusive; a weak part that overlaps a base span is dropped; repeated rows each
get their own result; texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart.llm.common import map_batches

KINDS = ["assign", "access", "hex", "key", "id", "endpoint"]
REACH = 400


def _either_case(words: str) -> str:
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGN = re.compile(f"(?:{_either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as runs of any length, then only those of 24 or more
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
ID = re.compile(f"(?:{_either_case('user_?name|user_?id|login|client_?id|access_?key_?id|account')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{4,})""")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)+[a-z0-9-]+:[0-9]{2,5}(?![0-9])")
BREAK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[str, int, int, int | None]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Scoped:
    """Parts of one side of the interval join, by paragraph."""

    def __init__(self, parts: list[tuple[str, int, int]], breaks: list[int], reach: int):
        self.breaks, self.reach = breaks, reach
        by: dict[int, list[tuple[int, int]]] = {}
        for _, start, end in parts:
            by.setdefault(bisect_right(breaks, start), []).append((start, end))
        self.by = {}
        for paragraph, spans in by.items():
            spans.sort()
            starts = [s for s, _ in spans]
            furthest = list(accumulate(((e, s) for s, e in spans), max))
            self.by[paragraph] = (starts, furthest)

    def nearest(self, start: int, end: int) -> int | None:
        """The start of the nearest part in scope other than the span itself, or None."""
        starts, furthest = self.by.get(bisect_right(self.breaks, start), ((), ()))
        at = bisect_left(starts, start)
        before = furthest[at - 1] if at else None
        after = bisect_left(starts, end, at)
        best = None
        if before is not None and start - before[0] <= self.reach:
            best = (max(0, start - before[0]), before[1])
        if after < len(starts) and starts[after] - end <= self.reach and (best is None or starts[after] - end < best[0]):
            best = (starts[after] - end, starts[after])
        return best and best[1]


def _outside(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that overlap none of those taken."""
    taken = sorted((s, e) for _, s, e in taken)
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    return [x for x in spans if not (at := bisect_left(starts, x[2])) or furthest[at - 1] <= x[1]]


def scan(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, by start and then kind; the last field is the partner's start."""
    text = text or ""
    base = base_spans(text)
    access = [x for x in base if x[0] == "access"]
    strong = [x for x in base if x[0] != "access"]
    ids = _outside([("id", *m.span()) for m in ID.finditer(text)], base) if ":" in text or "=" in text else []
    linked: list[Span] = []
    if access or ids:
        breaks = [m.start() for m in BREAK.finditer(text)]
        identifiers = Scoped(access + ids, breaks, reach)
        keys = [("key", *m.span()) for m in KEY.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])]
        linked += [(*x, to) for x in _outside(keys, base + ids) if (to := identifiers.nearest(x[1], x[2])) is not None]
        secrets = Scoped(strong + [x[:3] for x in linked], breaks, reach)
        linked += [(*x, to) for x in ids if (to := secrets.nearest(x[1], x[2])) is not None]
        if secrets.by:
            ends = _outside([("endpoint", *m.span()) for m in ENDPOINT.finditer(text)], base + [x[:3] for x in linked])
            linked += [(*x, to) for x in ends if identifiers.nearest(x[1], x[2]) is not None and (to := secrets.nearest(x[1], x[2])) is not None]
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    own = sorted(((*x, None) for x in base), key=order)
    return own, sorted([*own, *linked], key=order)


SPANS = "array<struct<kind:string,start:int,end:int,partner:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("partner", pa.int32())]))


def find_secrets(docs: DataFrame, reach: int = REACH, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans) of each row: base spans, and all spans with the linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t, reach) for t in batch.column(1).to_pylist()]
            as_rows = [[[dict(zip(("kind", "start", "end", "partner"), x)) for x in side] for side in both] for both in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in as_rows], _ARROW) for i in (0, 1))], ["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id long, base {SPANS}, spans {SPANS}")


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")
