"""Names to catalogue keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Variable


def resolve(names: Iterable[str] | str | None, have: dict[str, Variable]) -> list[str]:
    """Catalogue keys for the names, in order and each once.

    A name is taken as a key, else as an output name (all its keys), else as a
    source variable (the last key that reads it).  None stands for all keys.
    Unknown names, and keys that aren't available, are a ValueError.
    """
    if names is None:
        return list(have)
    out: dict[str, None] = {}
    last_reader = {s: k for k, v in have.items() for s in v.sources}
    for name in [names] if isinstance(names, str) else names:
        by_out = [k for k, v in have.items() if v.out == name]
        keys = [name] if name in have else by_out or [last_reader[k] for k in (name,) if k in last_reader]
        if not keys:
            raise ValueError(f"Unknown variable {name!r}; available: {', '.join(have)}")
        out.update(dict.fromkeys(keys))
    return list(out)


def resolve_frame(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The same relationally: requests (at, name), catalogue (pos, key, out_name,
    source_vars) to (at, pos, key), each key at its first request.  Requests that
    match nothing are left out."""
    c = catalogue.select("pos", "key", "out_name", "source_vars")
    by_source = c.select("pos", "key", F.explode("source_vars").alias("name")).groupBy("name").agg(F.max_by("key", "pos").alias("key"), F.max("pos").alias("pos"))
    ways = (
        c.select(F.col("key").alias("name"), "pos", "key", F.lit(1).alias("way"))
        .union(c.select(F.col("out_name").alias("name"), "pos", "key", F.lit(2)))
        .union(by_source.select("name", "pos", "key", F.lit(3)))
    )
    found = requests.join(ways, "name")
    best = found.groupBy("at").agg(F.min("way").alias("way"))
    return found.join(best, ["at", "way"]).groupBy("key").agg(F.min(F.struct("at", "pos")).alias("m")).select("m.at", "m.pos", "key")


def is_available(source_vars: Column, columns: Column) -> Column:
    """Whether all source variables are among the columns (both arrays)."""
    return F.forall(source_vars, lambda v: F.array_contains(columns, v))


def any_on_levels(heights: Column) -> Column:
    """Whether one of the heights (an array) is missing, so levels are needed."""
    return F.exists(heights, lambda h: h.isNull())


def check_levels(keys: Iterable[str], have: dict[str, Variable], levels: list[float] | None) -> None:
    """Level variables need target levels."""
    on_levels = [k for k in keys if have[k].on_levels]
    if on_levels and not levels:
        raise ValueError(f"target_levels must be given for {', '.join(on_levels)}")
