"""Staggered grids to mass points: means of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unstagger(values: Column) -> Column:
    """Means of adjacent items of an array: n items to n - 1."""
    n = F.size(values) - 1
    return F.when(n > 0, F.zip_with(F.slice(values, 1, F.greatest(n, F.lit(0))), F.slice(values, 2, F.greatest(n, F.lit(0))), lambda a, b: (a + b) / 2)).otherwise(F.slice(values, 1, 0))


def mean_arrays(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def unstagger_rows(df: DataFrame, by: list[str], index: str, value: str, mean=None) -> DataFrame:
    """Means of rows that follow each other in ``index`` within ``by``; the last
    row of each group goes.  For indices that count by one, where ``by`` holds a
    grid row or column, use ``unstagger_join``, which needs no order of rows."""
    following = F.lead(value).over(W.partitionBy(*by).orderBy(index))
    both = df.withColumn("_next", following)
    mean = mean or (lambda a, b: (a + b) / 2)
    return both.filter(F.col("_next").isNotNull()).withColumn(value, mean(F.col(value), F.col("_next"))).drop("_next")


def unstagger_join(df: DataFrame, by: list[str], index: str, value: str, mean=mean_arrays) -> DataFrame:
    """As ``unstagger_rows`` for an index that counts by one: each row goes to its
    own index and the one before, and the two that meet are averaged.  One shuffle
    on the full cell, so no task holds a whole grid row."""
    ends = df.select(*by, F.explode(F.array(F.struct(F.col(index).alias("_i"), F.lit(0).alias("_side")), F.struct((F.col(index) - 1).alias("_i"), F.lit(1).alias("_side")))).alias("_e"), value)
    side = lambda s: F.max(F.when(F.col("_e._side") == s, F.col(value)))
    cells = ends.groupBy(*by, F.col("_e._i").alias(index)).agg(side(0).alias("_a"), side(1).alias("_b"))
    return cells.filter("_a IS NOT NULL AND _b IS NOT NULL").select(*by, index, mean(F.col("_a"), F.col("_b")).alias(value))


def on_mass_points(mass: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    """``mass`` (time, j, i, ...) with U and V at its points, from u (time, j, i_stag, U)
    and v (time, j_stag, i, V).

    Every component goes to the two cells beside it, and each cell gathers its two of
    each kind and its own row: one shuffle on the whole cell for all three, in place of
    one for each means and for each join.  A cell without both of either, or without a
    mass row, goes.
    """
    own = [c for c in mass.columns if c not in ("time", "j", "i")]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    place = lambda j, i: [F.col("time"), j.cast("int").alias("j"), i.cast("int").alias("i")]
    parts = [mass.select(*place(F.col("j"), F.col("i")), F.lit(0).alias("_kind"), F.struct(*own).alias("_own"), none(u, "U").alias("_edge"))]
    nothing = F.lit(None).cast(parts[0].schema["_own"].dataType)
    for df, value, j, i, first in ((u, "U", "j", "i_stag", 1), (v, "V", "j_stag", "i", 3)):
        for back in (0, 1):
            at = place(F.col(j) - (back if value == "V" else 0), F.col(i) - (back if value == "U" else 0))
            parts.append(df.select(*at, F.lit(first + back).alias("_kind"), nothing.alias("_own"), F.col(value).alias("_edge")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    pick = lambda k, c: F.max(F.when(F.col("_kind") == k, F.col(c)))
    cells = rows.groupBy("time", "j", "i").agg(pick(0, "_own").alias("_own"), *(pick(k, "_edge").alias(f"_e{k}") for k in (1, 2, 3, 4)))
    whole = cells.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("_own", "_e1", "_e2", "_e3", "_e4")))
    return whole.select("time", "j", "i", "_own.*", mean_arrays(F.col("_e1"), F.col("_e2")).alias("U"), mean_arrays(F.col("_e3"), F.col("_e4")).alias("V"))
