"""Exact, order-free sums of doubles.

A double is an integer mantissa times a power of two.  ``binned_sums`` groups terms by
that power (their bin), scales each to an integer and sums the integer in three limbs
of 19 bits, so a sum is exact for any order of rows and partitions (up to 2^44 rows of
one key and bin).  Binned sums of parts add up to the binned sums of the whole, so they are also what
incremental state keeps.  ``doubles`` combines the few bins of a key, largest first, with
a compensated addition, and rounds once.

Infinities and NaN are counted in a bin of their own and come out as they would in
floating-point addition; nulls count as zero.  One pass serves any number of terms: they
are unpivoted before the aggregate, which combines within tasks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 19
LIMBS = ("l0", "l1", "l2")
# The bin of infinities and NaN, above that of any finite double.
SPECIAL = 1 << 16


def _scaled(x: str, k: str) -> str:
    """x * 2^k in two steps, so that neither factor leaves the range of doubles."""
    return f"{x} * pow(2D, floor({k} / 2)) * pow(2D, {k} - floor({k} / 2))"


# A double as SQL: x = (l2 * 2^38 + l1 * 2^19 + l0) * 2^(bin - 53).  The bin is off by one at
# most near a power of two, which the spare bits of the scaled integer allow for.
_ODD = "(isnan(_x) or abs(_x) = double('Infinity'))"
_BIN = f"case when {_ODD} then {SPECIAL} when coalesce(_x, 0D) = 0 then 0 else cast(floor(log2(abs(_x))) as int) end"
_WHOLE = f"cast(case when bin < {SPECIAL} and _x <> 0 then {_scaled('_x', '(53 - bin)')} else 0D end as bigint)"
_MASK = (1 << LIMB) - 1
_LIMBS = {
    "l0": f"if(bin = {SPECIAL}, cast(isnan(_x) as bigint), _w & {_MASK}L)",
    "l1": f"if(bin = {SPECIAL}, cast(_x = double('Infinity') as bigint), shiftright(_w, {LIMB}) & {_MASK}L)",
    "l2": f"if(bin = {SPECIAL}, cast(_x = double('-Infinity') as bigint), shiftright(_w, {2 * LIMB}))",
}


def _limbs(long: DataFrame) -> DataFrame:
    """``long`` with the bin and the limbs of ``_x``; a null counts as zero."""
    return long.withColumn("bin", F.expr(_BIN)).withColumn("_w", F.expr(_WHOLE)).withColumns({n: F.expr(e) for n, e in _LIMBS.items()})


def binned_sums(rows: DataFrame, keys: list[str], terms: dict[str, Column]) -> DataFrame:
    """(keys, term, bin, l0, l1, l2): the exact sums of ``terms`` by key, one row per term and bin."""
    if len(terms) == 1:
        name, value = next(iter(terms.items()))
        long = rows.select(*keys, F.lit(name).alias("term"), value.cast("double").alias("_x"))
    else:
        pairs = F.array(*(F.struct(F.lit(n).alias("term"), c.cast("double").alias("_x")) for n, c in terms.items()))
        long = rows.select(*keys, F.inline(pairs))
    return add_bins(_limbs(long), keys)


def add_bins(binned: DataFrame, keys: list[str]) -> DataFrame:
    """The binned sums of a union of binned sums."""
    return binned.groupBy(*keys, "term", "bin").agg(*(F.sum(n).alias(n) for n in LIMBS))


def _part(j: int, high: bool) -> str:
    """Half of a limb's sum, which a double holds exactly, at its place."""
    value = f"shiftright(b.l{j}, 32)" if high else f"(b.l{j} & 4294967295L)"
    at = f"(b.bin + {LIMB * j - 53 + 32 * high})"
    return f"case when {value} = 0 then 0D else {_scaled(f'double({value})', at)} end"


_PARTS = ", ".join(_part(j, high) for j in (2, 1, 0) for high in (True, False))
_SUM, _BACK = "(a.s + x)", "((a.s + x) - a.s)"
# The double nearest to the value of the (bin, l0, l1, l2) structs ``bins``, sorted by bin, largest first.
_DOUBLE = f"""case when get(bins, 0).bin = {SPECIAL} then
    case when get(bins, 0).l0 > 0 or (get(bins, 0).l1 > 0 and get(bins, 0).l2 > 0) then double('NaN')
      when get(bins, 0).l1 > 0 then double('Infinity') else double('-Infinity') end
  else aggregate(flatten(transform(bins, b -> array({_PARTS}))), struct(0D as s, 0D as e),
    (a, x) -> struct({_SUM} as s, a.e + ((a.s - ({_SUM} - {_BACK})) + (x - {_BACK})) as e),
    a -> if(isnan(a.e), a.s, a.s + a.e)) end"""


def doubles(binned: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """(keys, one double per term): the sums as doubles; a term without rows is 0."""
    entry = F.struct("bin", *LIMBS)
    lists = binned.groupBy(*keys).agg(*(F.sort_array(F.collect_list(F.when(F.col("term") == n, entry)), asc=False).alias(n) for n in terms))
    each = F.expr(f"transform(array({', '.join(f'`{n}`' for n in terms)}), bins -> {_DOUBLE})")
    return lists.select(*keys, each.alias("_sums")).select(*keys, *(F.get("_sums", i).alias(n) for i, n in enumerate(terms)))


def sums(rows: DataFrame, keys: list[str], terms: dict[str, Column]) -> DataFrame:
    """(keys, one double per term): exact sums by key; without keys, one row."""
    return doubles(binned_sums(rows, keys, terms), keys, list(terms))
