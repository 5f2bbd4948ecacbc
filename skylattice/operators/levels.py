"""Interpolation of a model column to fixed heights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bracket(z: Column, level: Column) -> Column:
    """The first k with z[k] <= level < z[k + 1], the last bracket closed at its
    top; null beyond the column."""
    n = F.size(z)
    top = F.greatest(n - 2, F.lit(0))

    def inside(k: Column) -> Column:
        return (k < n - 1) & (F.get(z, k) <= level) & ((level < F.get(z, k + 1)) | ((k == n - 2) & (level == F.get(z, k + 1))))

    return F.get(F.filter(F.sequence(F.lit(0), top), inside), F.lit(0))


def at_level(z: Column, v: Column, level: Column) -> Column:
    """Linear between the heights that enclose ``level``, and at a height its own
    value; both ends of the column count as inside, anything beyond is null."""

    def value(k: Column) -> Column:
        share = F.try_divide(level - F.get(z, k), F.get(z, k + 1) - F.get(z, k))
        between = F.get(v, k) + share * (F.get(v, k + 1) - F.get(v, k))
        return F.when(level == F.get(z, k), F.get(v, k)).when(level == F.get(z, k + 1), F.get(v, k + 1)).otherwise(between)

    single = F.when((F.size(z) == 1) & (F.get(z, F.lit(0)) == level), F.get(v, F.lit(0)))
    # An array of one binds the bracket, so that it is looked for once.
    found = F.transform(F.array(bracket(z, level)), lambda k: F.when(k.isNotNull(), value(k)))
    return F.coalesce(F.get(found, F.lit(0)), single)


def at_levels(z: Column, v: Column, levels: Sequence[float]) -> Column:
    """array<struct<height, value>> for the levels, sorted and each once; values as
    ``at_level`` has them.

    Heights ascend, so heights and levels are merged into one order: a level's place in
    it, less the levels before, is the number of heights up to it.  The work grows with
    heights plus levels, not with their product.
    """
    asked = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(1).alias("kind")) for h in sorted({float(x) for x in levels})))
    none = F.array().cast("array<struct<h:double,kind:int>>")
    known = F.coalesce(F.transform(z, lambda x: F.struct(F.coalesce(x.cast("double"), F.lit(float("nan"))).alias("h"), F.lit(0).alias("kind"))), none)
    order = F.array_sort(F.concat(known, asked))
    places = F.filter(F.transform(order, lambda e, p: F.struct(e["h"].alias("h"), e["kind"].alias("kind"), p.alias("p"))), lambda e: e["kind"] == 1)
    return F.transform(places, lambda e, r: F.struct(e["h"].alias("height"), _above(z, v, e["h"], e["p"] - r - 1).alias("value")))


def _above(z: Column, v: Column, level: Column, k: Column) -> Column:
    """The value at ``level``, whose last height not above it is the ``k``-th."""
    n = F.size(z)
    lo = F.greatest(F.least(k, n - 2), F.lit(0))
    share = F.try_divide(level - F.get(z, lo), F.get(z, lo + 1) - F.get(z, lo))
    between = F.get(v, lo) + share * (F.get(v, lo + 1) - F.get(v, lo))
    value = F.when(level == F.get(z, lo), F.get(v, lo)).when(level == F.get(z, lo + 1), F.get(v, lo + 1)).otherwise(between)
    return F.when((k >= 0) & (level <= F.get(z, n - 1)), value)
