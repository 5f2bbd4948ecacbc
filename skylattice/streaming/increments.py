"""Increments of accumulated quantities over a stream of steps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_increments(steps: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """by, ``time``, increment for each row of a stream.

    The state of a cell is its last time and total.  Its first row ever has a null
    increment.  Rows that come after a later one of their cell are left out, as
    the batch version would give the later one another increment.
    """
    kinds = dict(steps.dtypes)
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in by)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total = state.get if state.exists else (None, None)
        rows = pd.concat(frames).sort_values(time, kind="stable").drop_duplicates(time)
        if last is not None:
            rows = rows[rows[time].astype("int64") > last]
        if rows.empty:
            return
        before = rows[value].shift()
        before.iloc[0] = float("nan") if total is None else total
        out = pd.DataFrame({k: [v] * len(rows) for k, v in zip(by, key, strict=True)})
        out[time] = rows[time].to_numpy()
        out["increment"] = (rows[value] - before).to_numpy()
        state.update((int(rows[time].astype("int64").iloc[-1]), float(rows[value].iloc[-1])))
        yield out

    return steps.select(*by, time, value).groupBy(*by).applyInPandasWithState(advance, f"{keys}, `{time}` {kinds[time]}, increment double", "last long, total double", "append", GroupStateTimeout.NoTimeout)
