"""Row-local expressions: numbers, dates, regions, profiles, work-item status.

All helpers return ``Column`` objects built from ``pyspark.sql.functions``;
none of them needs Python at run time.  Higher-order functions (``let``, maps)
are interpreted, the rest is generated code.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` (a lambda variable).

    Written as ``transform`` over a one-element array.  Expressions that test
    one big derived value many times (lower-cased documents) use it so the
    value is not recomputed per test, also inside filters, which get no
    common-subexpression elimination.
    """
    return F.get(F.transform(F.array(value), body), 0)


# ---------------------------------------------------------------------------
# numbers
# ---------------------------------------------------------------------------


def py_round(x, digits: int) -> Column:
    """Correctly rounded to ``digits`` decimals, ties to even, like Python ``round``.

    The double product x * 10^d can land on a tie that the exact product is not
    (0.015 * 100 is 1.5, but 0.015 is below it).  There, the product's rounding
    error, computed exactly by splitting x into halves of its bits, decides.
    """
    scale = F.lit(float(10**digits))
    v = _c(x).cast("double")
    product = v * scale
    wide = v * F.lit(134217729.0)  # 2^27 + 1 splits a double in two
    high = wide - (wide - v)
    error = (high * scale - product) + (v - high) * scale
    down = F.floor(product).cast("double")
    tie = (product - down == 0.5) & (F.abs(product) < F.lit(2.0**51))
    rounded = F.when(tie & (error < 0), down).when(tie & (error > 0), down + 1.0).otherwise(F.rint(product))
    # a value this large has no further decimals to lose
    return F.when(F.abs(product) >= F.lit(2.0**52), v).otherwise(rounded / scale)


def clamp(x, lo: int = 0, hi: int = 10) -> int:
    """Clamp a query parameter (``int(x)`` first, as the query API does) into lo..hi."""
    return max(lo, min(hi, int(x)))


def clamp_col(x, lo: int = 0, hi: int = 10) -> Column:
    """Clamp a column of numbers into lo..hi as integers."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x).cast("int")))


# Characters Python's ``str.strip()`` removes: every code point with isspace(),
# derived from Python's own rule rather than listed by hand.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def py_strip(x) -> Column:
    """Python ``str.strip()``: trims all Unicode whitespace (Spark ``trim`` only removes spaces)."""
    return F.btrim(_c(x), F.lit(PY_WHITESPACE))


def clean_topic(topic: str, max_len: int = dims.MAX_TOPIC_LENGTH) -> str:
    """Search-term cleaning happens once, on the parameter: strip, cut, lower."""
    return str(topic).strip()[:max_len].lower()


# ---------------------------------------------------------------------------
# dates
# ---------------------------------------------------------------------------


def parse_iso_date(s) -> Column:
    """``%Y-%m-%d`` parse; null when it does not parse (never raises)."""
    return F.try_to_date(_c(s), "yyyy-M-d")


def pub_date(published, run_date: str) -> Column:
    """Publication day as ``yyyy-MM-dd``, else the run date."""
    return F.coalesce(F.date_format(_c(published), "yyyy-MM-dd"), F.lit(run_date))


def quarter_label(date_str) -> Column:
    """``YYYY-Qn`` of an ISO date string; ``unknown`` when it does not parse."""
    return F.coalesce(F.date_format(parse_iso_date(date_str), "yyyy-'Q'q"), F.lit("unknown"))


# ---------------------------------------------------------------------------
# regions
# ---------------------------------------------------------------------------

def _alias_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(dims.REGION_ALIASES.items())])


def _flag_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(dims.REGION_FLAGS.items())])


def normalize_region(raw) -> Column:
    """Null/empty as is, canonical as is, else alias of lower(strip(raw)), else unchanged."""
    r = _c(raw)
    return (
        F.when(r.isNull() | (r == ""), r)
        .when(r.isin(dims.CANONICAL_REGIONS), r)
        .otherwise(F.coalesce(F.element_at(_alias_map(), F.lower(py_strip(r))), r))
    )


def region_flag(region) -> Column:
    return F.coalesce(F.element_at(_flag_map(), _c(region)), F.lit(dims.DEFAULT_FLAG))


# ---------------------------------------------------------------------------
# profiles (M3)
# ---------------------------------------------------------------------------


def mean_numeric_map(m, known_keys=None) -> Column:
    """Mean of the non-null values of a numeric map, 0 when there are none.

    With ``known_keys`` (the usual dimension names), maps holding only those
    keys take a branch of plain ``element_at`` lookups that stays in generated
    code; any other map goes through the general higher-order path (values
    filtered once).  Both give the same result.
    """
    mc = _c(m)

    def mean(vals: Column) -> Column:
        n = F.size(vals)
        total = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
        return F.when(F.coalesce(n, F.lit(0)) > 0, total / n).otherwise(F.lit(0.0))

    general = let(F.filter(F.map_values(mc), lambda v: v.isNotNull()), mean)
    if not known_keys:
        return general
    vals = [F.element_at(mc, F.lit(k)) for k in known_keys]
    n_keys = sum((F.when(F.map_contains_key(mc, F.lit(k)), 1).otherwise(0) for k in known_keys), F.lit(0))
    n_vals = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in vals), F.lit(0))
    total = F.lit(0.0)
    for v in vals:
        total = total + F.coalesce(v.cast("double"), F.lit(0.0))
    fast = F.when(n_vals > 0, total / n_vals).otherwise(F.lit(0.0))
    return F.when(mc.isNull(), F.lit(0.0)).when(F.size(mc) == n_keys, fast).otherwise(general)


def with_impact_score(ai) -> Column:
    """Profile with ``impact_score`` = importance (0 when absent); null profile stays null."""
    a = _c(ai)
    return F.when(a.isNotNull(), a.withField("impact_score", F.coalesce(a.getField("overall_6g_importance"), F.lit(0.0))))


def display_impact(ai, score):
    """(value, label): profile impact when non-zero, else keyword score when non-zero, else null/'?'."""
    a = _c(ai)
    imp = a.getField("impact_score")
    use_ai = a.isNotNull() & imp.isNotNull() & (imp != 0)
    sc = _c(score)
    use_score = sc.isNotNull() & (sc != 0)
    value = F.when(use_ai, imp).when(use_score, sc.cast("double"))
    label = F.when(use_ai, F.lit("Impact")).when(use_score, F.lit("Relevance")).otherwise(F.lit("Impact"))
    return value, label


def display_summary(ai, summary) -> Column:
    a = _c(ai)
    return F.when(a.isNotNull(), a.getField("summary")).otherwise(_c(summary))


# ---------------------------------------------------------------------------
# work-item status
# ---------------------------------------------------------------------------

# Python float() accepts these spellings; anything else is "not a number".
_NUMERIC_RX = r"^[+-]?((\d+(\.\d*)?)|(\.\d+))([eE][+-]?\d+)?$"
_NAN_RX = r"^[+-]?nan$"
_INF_RX = r"^[+-]?inf(inity)?$"


def _status_number(val: Column) -> tuple[Column, Column]:
    """(is_number, number) for ``val`` = stripped lower-cased status text."""
    clean = py_strip(F.regexp_replace(val, "%", ""))
    is_num = clean.rlike(_NUMERIC_RX) | clean.rlike(_NAN_RX) | clean.rlike(_INF_RX)
    num = (
        F.when(clean.rlike(_NAN_RX), F.lit(float("nan")))
        .when(clean.rlike(_INF_RX), F.when(clean.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .otherwise(clean.try_cast("double"))
    )
    return is_num, num


def _contains_any(s: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def work_item_status_a(completion) -> Column:
    """Two-outcome status of the tool path: Completed / In Progress."""
    val = F.lower(py_strip(F.coalesce(_c(completion).cast("string"), F.lit("0"))))
    is_num, num = _status_number(val)
    done_num = ~F.isnan(num) & ((num >= 100.0) | ((num >= 1.0) & ~val.contains("%")))
    return (
        F.when(is_num, F.when(done_num, "Completed").otherwise("In Progress"))
        .when(_contains_any(val, dims.COMPLETED_WORDS), "Completed")
        .otherwise("In Progress")
    )


def work_item_status_b(status) -> Column:
    """Three-outcome status of the workbook path: completed / postponed / in_progress."""
    val = F.lower(py_strip(F.coalesce(_c(status).cast("string"), F.lit("0"))))
    is_num, num = _status_number(val)
    not_nan = ~F.isnan(num)
    done_num = not_nan & ((num >= 100.0) | ((num >= 1.0) & ~val.contains("%")))
    post_num = (not_nan & (num < 0)) | val.contains("postpone") | val.contains("delay")
    return (
        F.when(is_num, F.when(done_num, "completed").when(post_num, "postponed").otherwise("in_progress"))
        .when(_contains_any(val, dims.COMPLETED_WORDS), "completed")
        .when(_contains_any(val, dims.POSTPONED_WORDS), "postponed")
        .otherwise("in_progress")
    )
