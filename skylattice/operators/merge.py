"""Variants of one output variable put together."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Variable
from ..session import broadcast_if_small


def group_keys(keys: Iterable[str], have: dict[str, Variable]) -> dict[str, list[str]]:
    """Keys by output name, in the order in which they were asked for."""
    out: dict[str, list[str]] = {}
    for k in keys:
        out.setdefault(have[k].out, []).append(k)
    return out


def group_frame(df: DataFrame, name: str, pos: str, key: str) -> DataFrame:
    """The same relationally: (name, keys in the order of pos)."""
    ordered = F.array_sort(F.collect_list(F.struct(pos, key)))
    return df.groupBy(name).agg(F.transform(ordered, lambda x: x[key]).alias("keys"))


def heights_of(keys: Iterable[str], have: dict[str, Variable], levels: Sequence[float] | None) -> list[float]:
    """All heights that the keys write, sorted."""
    out = {h for k in keys for h in ((have[k].height,) if not have[k].on_levels else levels or ())}
    return sorted(map(float, out))


def winners(keys: Sequence[str], have: dict[str, Variable], levels: Sequence[float] | None) -> dict[str, list[float]]:
    """For each key of one output name the heights that it gets to write: at a
    height that two keys write the later key's whole slab stands, so the earlier
    one needn't be computed there, and no rows have to be compared."""
    owner: dict[float, str] = {}
    for k in keys:
        for h in heights_of([k], have, levels):
            owner[h] = k
    return {k: sorted(h for h, o in owner.items() if o == k) for k in keys}


def merge_variants(variants: Sequence[DataFrame], by: Sequence[str], value: str, *ties: Column) -> DataFrame:
    """Union of variants; where several have a cell the later one stands, also if
    its value is missing.  ``ties`` decide between rows of one variant."""
    parts = [v.withColumn("_prio", F.lit(n)) for n, v in enumerate(variants)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # A maximum of structs is merged before the shuffle, unlike a window's rows.
    best = F.max(F.struct("_prio", *ties, F.struct(value).alias("_v"))).alias("_best")
    return rows.groupBy(*by).agg(best).select(*by, F.col(f"_best._v.{value}").alias(value))


def densify(sparse: DataFrame, dimensions: Sequence[DataFrame]) -> DataFrame:
    """A row for every combination of the dimensions' values (the axes of a cube,
    each far smaller than the cube itself); combinations that ``sparse`` lacks
    have nulls."""
    full = dimensions[0]
    for d in dimensions[1:]:
        full = full.join(broadcast_if_small(d))
    return full.join(sparse, full.columns, "left")


def height_index(df: DataFrame, heights: Sequence[float], height: str = "height") -> DataFrame:
    """The position of each row's height among ``heights``; other rows go."""
    table = F.array(*(F.lit(float(h)) for h in sorted({*heights})))
    return df.withColumn("h_idx", F.array_position(table, F.col(height).cast("double")) - 1).filter("h_idx >= 0")
