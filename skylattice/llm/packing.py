"""Best-fit packing into sequences of several permitted lengths.

Items are dealt by a hash into shards of bounded size, which are packed on their
own: best fit by decreasing length.  An item that fits in no open bin opens a new
one: for every permitted size it is worked out what the items left would fill it
with, and the size of least cost for each token that it would hold is taken.  At
the end each bin is cut down to the least size that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZES = (512, 1024, 2048, 4096)
#: Items packed together; bins of different shards aren't filled up with each other's.
SHARD = 20_000
#: Equal rows that are dealt together at first.
RUN = 10_000
#: The cost of a sequence: a fixed part, its length, and its length squared over this.
FIXED, SQUARE = 16.0, 65_536.0


def cost(size: float, fixed: float = FIXED, square: float = SQUARE) -> float:
    return fixed + size + size * size / square


def filled(n: int, size: int, left: list[int], count: list[int]) -> int:
    """What a bin of ``size`` with an item of ``n`` holds when the largest of the
    items left that fits goes in again and again.  ``left`` has their lengths,
    sorted, and ``count`` how many there are of each."""
    at = len(left)
    while n < size:
        at = bisect_right(left, size - n, 0, at) - 1
        if at < 0 or not left[at]:
            break
        n += left[at] * min(count[at], (size - n) // left[at])
    return n


def price(used: int, sizes: Sequence[int]) -> float:
    """The cost for each token of a bin cut down to what it holds."""
    return cost(sizes[bisect_left(sizes, used)]) / max(1, used)


def pack(lengths: np.ndarray, sizes: Sequence[int] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the size of each bin.  Items longer than the
    largest size aren't allowed; items of length 0 take no room."""
    sizes = sorted(sizes)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    size: list[int] = []
    room: list[int] = []  # distinct free room of open bins, sorted
    open_: dict[int, list[int]] = {}  # the bins that have it
    values, counts = np.unique(lengths, return_counts=True)
    left, count = values.tolist(), counts.tolist()  # lengths still to pack, and how many of each
    for i in order.tolist():
        n = int(lengths[i])
        count[-1] -= 1
        if not count[-1]:
            left.pop()
            count.pop()
        at = bisect_left(room, n)
        if at < len(room):
            free = room[at]
            b = open_[free].pop()
            if not open_[free]:
                del open_[free], room[at]
        else:
            b = len(used)
            best = min((s for s in sizes if s >= n), key=lambda s: price(filled(n, s, left, count), sizes))
            used.append(0)
            size.append(best)
            free = best
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if free > n:
            if free - n not in open_:
                insort(room, free - n)
            open_.setdefault(free - n, []).append(b)
    final = np.array([sizes[bisect_left(sizes, u)] for u in used], np.int64)
    return bins, offsets, final


def best_fit(docs: DataFrame, length: Column, sizes: Sequence[int] = SIZES, shard: int = SHARD, key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, bin, bin_size, bin_offset, bin_used.

    A row longer than the largest size is cut into pieces of that size and a
    rest; ``start`` is where a piece begins.  Every row has a piece 0, also those
    of length 0 or null (taken as 0).  ``bin`` is unique.  Repeated rows are
    packed each and null keys are kept.  Rows are dealt by key, length and, of equal
    rows, a running number: many of one key don't meet in one shard, and the same
    rows are packed alike however they lie in files.  An empty table gives no rows;
    other columns aren't carried.  The number of shards follows from that of all
    pieces; which bin a row gets depends on that number and the rows of its shard.
    """
    largest = max(sizes)
    spark = docs.sparkSession
    items = docs.select(F.col(key).alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("total"))
    # Equal rows are counted, then made again in runs of bounded length.
    run_of = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("first")
    items = items.groupBy("doc_id", "total").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "total", "n", run_of)
    items = items.repartition(common.partitions(spark), "doc_id", "total", "first")
    items = items.select("doc_id", "total", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + RUN, F.col("n")) - 1)).alias("nth"))
    pieces = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / largest) - 1, F.lit(0)).cast("int"))).alias("piece")
    items = common.staged(items.select("doc_id", "total", "nth", pieces).select("doc_id", "total", "nth", "piece", (F.col("piece").cast("long") * largest).alias("start"), F.least(F.col("total") - F.col("piece").cast("long") * largest, F.lit(largest).cast("long")).alias("length")))
    shards = max(1, -(-items.count() // shard))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "total", "nth", "piece"), F.lit(shards))).drop("total", "nth")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        bins, offsets, final = pack(rows.column("length").to_numpy(), sizes)
        used = np.bincount(bins, weights=rows.column("length").to_numpy(), minlength=len(final)).astype(np.int64)
        base = int(rows.column("shard")[0].as_py()) << 32
        columns = [*(rows.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(bins + base), pa.array(final[bins]), pa.array(offsets), pa.array(used[bins])]
        return pa.table(columns, ["doc_id", "piece", "start", "length", "bin", "bin_size", "bin_offset", "bin_used"])

    return items.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, bin long, bin_size long, bin_offset long, bin_used long")


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are words of the whole texts."""
    return best_fit(common.documents(spark, sf_dir), n_words())
