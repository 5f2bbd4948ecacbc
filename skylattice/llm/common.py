"""What the operators share: scratch space, text kernels and the run finder.

Text kernels work on one chunk of documents at a time: the UTF-8 bytes of many
documents in one numpy array.  Chunks are cut by bytes (``CHUNK_BYTES``), so
that memory in a Python worker doesn't depend on Arrow's batch size; a single
longer document makes a chunk of its own.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once.
CHUNK_BYTES = 1 << 20
#: Words are maximal runs of anything but these bytes.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Rows that one task of a range-partitioned sort holds.
RUN_ROWS = 1_000_000
#: Up to so many partitions, the rows at their edges (two of some 100 bytes each) are broadcast.
BROADCAST_PARTITIONS = 20_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or where ``df`` has such a column, one that it doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


# --- scratch space -----------------------------------------------------------

#: Folders and tables made within the open scopes, those of the innermost last.
_scopes: ContextVar[tuple[list[tuple[str, str]], ...]] = ContextVar("scopes", default=())
#: Shuffle files go when the job that needed them has written its rows.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, as in
    tests on one machine, below a temporary folder that goes with the process."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, base, True)
        base = f"file://{base}"
    path = f"{base}/{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(("folder", path))
    return path


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within it, the session has this setting."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame) -> DataFrame:
    """Writes the rows to scratch space and reads them back: cuts the lineage,
    keeps them from being made twice, and survives the loss of executors."""
    return _staged_at(df, scratch_dir(df.sparkSession))


def _staged_at(df: DataFrame, path: str) -> DataFrame:
    with setting(df.sparkSession, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def finished(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``work()``, written to scratch space; what was written on the
    way to them is removed."""
    made: list[tuple[str, str]] = []
    path = scratch_dir(spark)
    token = _scopes.set((*_scopes.get(), made))
    try:
        return _staged_at(work(), path)
    finally:
        _scopes.reset(token)
        for kind, what in made:
            if kind == "table":
                spark.sql(f"DROP TABLE IF EXISTS {what}")
        for kind, what in made:
            if kind == "folder":
                remove(spark, what)


def bucketed(df: DataFrame, key: str, in_place: bool = False) -> DataFrame:
    """Writes the rows as a table bucketed by ``key``: later joins on the key
    leave these rows where they are.  ``in_place`` says that they already lie by
    the key, as those of another such table do."""
    return bucketed_and_plain(df, key, in_place)[0]


def bucketed_and_plain(df: DataFrame, key: str, in_place: bool = False) -> tuple[DataFrame, DataFrame]:
    """As ``bucketed``, and the same rows without the buckets: joins shuffle these,
    so that Spark can split a key that many rows of the other side have."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    n = partitions(spark)
    name = f"scratch_{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(("table", name))
    with setting(spark, _CLEANUP, "true"):
        (
            (df if in_place else df.repartition(n, key))
            .write.bucketBy(n, key)
            .option("path", path)
            .option("compression", "zstd")
            .format("parquet")
            .saveAsTable(name)
        )
    return spark.table(name), spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, rows: int = 0, each: int = RUN_ROWS) -> int:
    """Partitions for a shuffle: the session's number, or more if ``rows`` ask for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


# --- chunks of texts ---------------------------------------------------------


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most about ``CHUNK_BYTES`` of text, and the
    texts as UTF-8 (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_large_binary(texts.type) and not pa.types.is_binary(texts.type):
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        sizes = np.cumsum([x or 0 for x in pa.compute.binary_length(texts).to_pylist()])
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + CHUNK_BYTES, side="right")))
            yield batch.slice(at, to - at), [x or b"" for x in texts.slice(at, to - at).to_pylist()]
            at = to


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: A random odd number for each byte, so that hashes of texts aren't sums of small numbers.
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.isin(np.arange(256), list(SPACES))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    """``base ** i`` (name "up") or its inverse ("down") modulo 2**64 for i < n."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = _BASE if name == "up" else _INVERSE
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.ones(1, np.uint64)
        while len(out) < size:
            out = np.concatenate([out, out * np.uint64(step)])
            step = step * step % (1 << 64)
        if size > 4 * CHUNK_BYTES:
            return out[:n]  # not kept: a very long text
        _powers[name] = have = out
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of any window of a sequence of 64-bit codes, from prefix sums."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _power("up", len(codes)), out=self.sums[1:])
        self.down = _power("down", len(codes) + 1)

    def at(self, starts: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


class Words:
    """The words of a chunk: ``starts`` and ``ends`` in ``data``, ``doc`` (index
    in the chunk) and ``code`` (64-bit hash) of each; ``first[i]`` is the index of
    the first word of document i, with one more entry at the end."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" " + b" ".join(texts) + b" "
        if lower:
            joined = joined.translate(_LOWER)
        self.data = np.frombuffer(joined, np.uint8)
        space = IS_SPACE[self.data]
        self.starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        begins = np.cumsum([1, *(len(x) + 1 for x in texts)])
        self.first = np.searchsorted(self.starts, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.n = np.diff(self.first)
        lengths = self.ends - self.starts
        self.code = Windows(BYTE_CODE[self.data]).at(self.starts, lengths) ^ mixed(lengths.astype(np.uint64))


_LOWER = bytes(range(256)).lower()  # A-Z only


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (np.minimum or np.maximum) over every window of ``width`` items."""
    if len(a) < width:
        return a[:0]
    out, have = a, 1
    while have * 2 <= width:
        out, have = op(out[:-have], out[have:]), have * 2
    return op(out[: len(a) - width + 1], out[width - have :]) if width > have else out


def anchors(grams: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Indices of the grams that are the least of some window of ``width`` grams
    (all of them at ties), over the windows whose start is ``ok``.  Equal windows
    have the same anchors, so matches of whole windows need only these."""
    least = slide(grams, width, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64)
    least = np.where(ok[: len(least)], least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    most = slide(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero((most == grams) & (most > 0))


def union_length(starts: np.ndarray, length: int) -> np.ndarray:
    """For sorted starts of windows: (begin, end) of the maximal runs they cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length], 1)


# --- runs of equal keys over range partitions --------------------------------


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Sorted order by several columns: sort by the first, then only rows that
    still tie by the next, and so on."""
    order = np.argsort(columns[0], kind="stable")
    if len(order) < 2:
        return order
    group = np.concatenate([[0], np.cumsum(columns[0][order][1:] != columns[0][order][:-1])])
    for column in columns[1:]:
        tied = np.zeros(len(order), bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:].copy()
        at = np.flatnonzero(tied)
        if not len(at):
            break
        value = column[order[at]]
        by = np.lexsort((value, group[at]))
        order[at] = order[at[by]]
        value = value[by]
        split = np.zeros(len(order), np.int64)
        split[at[1:]] = (value[1:] != value[:-1]) & (group[at[1:]] == group[at[:-1]])
        first = np.concatenate([[True], group[1:] != group[:-1]])
        group = np.cumsum(split | first) - 1
    return order


def runs(df: DataFrame, keys: list[str], keep: str, with_keys: bool = False, singly: bool = False) -> DataFrame:
    """Rows whose key repeats.  ``df`` has long key columns, ``doc`` and ``pos``
    (long).  ``keep`` names the rows that stay: "any" (the key has two rows or
    more), "heads" (the same), "open" (the same, and one of them has an odd pos),
    "docs" (rows of two docs or more) or "later" (a smaller doc has it).
    Returns doc and ``at``, arrays of pos; a doc may have several rows: one in each
    partition, or with ``singly`` one for each pos, so that rows grow with the input
    where docs times partitions would grow faster.  With
    ``with_keys`` a row each with the keys, doc, pos, and head and head_pos of the
    key's first row by (doc, pos) in the partition; with "docs" and "heads"
    the rows of that doc have those of the first row of all partitions, so that
    heads lead on to the key's least doc.

    Sampled splitters range-partition the rows by (key, doc, pos), so a key with
    any share of the rows spreads over as many partitions as its rows fill.  Each
    partition sorts its rows; runs at its two edges, which may go on in the next
    partition, are settled by comparing the edges of all partitions, two rows
    from each.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df = _staged_at(df, path)
    n = partitions(spark, df.count())
    schema = ", ".join([f"{k} long" for k in keys] + ["doc long, pos long, head long, head_pos long, last long, n long, odd long, kind int, at array<long>"])
    arrow = pa.schema([(k, pa.int64()) for k in [*keys, "doc", "pos", "head", "head_pos", "last", "n", "odd"]] + [("kind", pa.int32()), ("at", pa.list_(pa.int64()))])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        columns = [table.column(k).to_numpy() for k in [*keys, "doc", "pos"]]
        order = multikey_order(columns)
        columns = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in columns[: len(keys)]:
            new[1:] |= c[1:] != c[:-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(order))
        run = np.cumsum(new) - 1
        doc, pos = columns[-2:]
        head, head_pos, last, count = doc[begin], pos[begin], doc[end - 1], end - begin
        odd = np.maximum.reduceat(pos & 1, begin)
        edge = (run == 0) | (run == len(begin) - 1)
        good = {"any": count[run] > 1, "heads": count[run] > 1, "open": (count > 1)[run] & (odd > 0)[run], "docs": (last > head)[run], "later": doc > head[run]}[keep]
        # Rows that no other partition can change; of a large run these are nearly all.
        sure = good & (doc > head[run]) if keep in ("docs", "later", "heads") else good
        rest = [(good & ~edge | sure, 0), (edge & ~sure, 1)]
        if not with_keys:  # what nobody reads isn't written
            settled = np.flatnonzero(rest.pop(0)[0])
            settled = settled[np.argsort(doc[settled], kind="stable")]
            d, p = doc[settled], pos[settled]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | singly])) if len(d) else np.zeros(0, np.int64)
            none = pa.nulls(len(first), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(d)), pa.int32()), pa.array(p))
            yield pa.RecordBatch.from_arrays([*[none] * len(keys), pa.array(d[first]), *[none] * 6, pa.array(np.zeros(len(first), np.int32)), lists], schema=arrow)
        for rows, kind in rest:
            at = np.flatnonzero(rows)
            for i in range(0, len(at), 200_000):
                j = at[i : i + 200_000]
                r = run[j]
                given = [*(c[j] for c in columns), *(x[r] for x in (head, head_pos, last, count, odd))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, given), pa.array(np.full(len(j), kind, np.int32)), pa.nulls(len(j), arrow.field("at").type)], schema=arrow)
        ends = np.unique([0, len(begin) - 1])
        at = begin[ends]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in columns), *(pa.array(x[ends]) for x in (head, head_pos, last, count, odd)), pa.array(np.full(len(at), 2, np.int32)), pa.nulls(len(at), arrow.field("at").type)], schema=arrow)

    found = staged(df.repartitionByRange(n, *keys, "doc", "pos").mapInArrow(local, schema))
    remove(spark, path)  # nothing reads the rows again
    # Two rows of each partition at most.
    edges = (
        found.filter("kind = 2")
        .groupBy(*keys)
        .agg(F.min(F.struct("head", "head_pos")).alias("h"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max("odd").alias("odd"))
        .select(*keys, "h.head", "h.head_pos", "last", "n", "odd")
    )
    pending = found.filter("kind = 1").select(*keys, "doc", "pos").join(F.broadcast(edges) if n <= BROADCAST_PARTITIONS else edges.hint("merge"), keys)
    pending = pending.filter({"any": "n > 1", "heads": "n > 1", "open": "n > 1 AND odd > 0", "docs": "last > head", "later": "doc > head"}[keep])
    if not with_keys:
        return found.filter("kind = 0").select("doc", "at").unionByName(pending.select("doc", F.array("pos").alias("at")))
    out = [*keys, "doc", "pos", "head", "head_pos"]
    return found.filter("kind = 0").select(out).unionByName(pending.select(out))


# --- tables of packed texts --------------------------------------------------


def numbered(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``docs`` and a column whose numbers tell its rows apart and sort as the keys
    do, nulls last: the key itself, or where it is null or repeats anywhere a new
    column of a written copy, as a number that is made again may fall on another
    row."""
    odd = docs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 OR _key IS NULL")
    if odd.isEmpty():
        return docs, key
    row = free_name(docs, "_row")
    # The second key lets a range end among rows of one key, so these spread out.
    return staged(docs.orderBy(F.col(key).asc_nulls_last(), F.rand(7)).withColumn(row, F.monotonically_increasing_id())), row


def packed_table(docs: DataFrame, summary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A table bucketed by doc_id with each text compressed: passes that need
    texts again join to it by doc_id and don't shuffle texts.

    ``summary(texts)`` gives for each text a digest (bytes, equal for texts that
    count as copies) and a long.  Columns: doc_id (see ``numbered``: rows with a
    null or repeated key are rows of their own), id (the key), packed, digest, size.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch, texts in text_chunks(batches):
            digests, sizes = summary(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([squeeze.compress(x) for x in texts], pa.binary()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "id", "packed", "digest", "size"])

    rows, row = numbered(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id")
    return bucketed(rows.select(F.col(row).alias("doc_id"), "id", "text").mapInArrow(pack, "doc_id long, id long, packed binary, digest binary, size long"), "doc_id")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """As ``text_chunks``, for a column ``packed``."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        packed = batch.column(batch.schema.get_field_index("packed"))
        at, texts, size = 0, [], 0
        for i in range(batch.num_rows):
            texts.append(expand.decompress(packed[i].as_py()))
            size += len(texts[-1])
            if size >= CHUNK_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(at, i + 1 - at), texts
                at, texts, size = i + 1, [], 0


def lists(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row each belongs to."""
    a = batch.column(batch.schema.get_field_index(column))
    n = pa.compute.fill_null(pa.compute.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    return np.asarray(a.flatten(), np.int64), np.repeat(np.arange(batch.num_rows), n)


def representatives(table: DataFrame) -> DataFrame:
    """doc_id and copies of the least row of each digest."""
    return staged(table.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies"))


def by_doc(rows: DataFrame, name: str) -> DataFrame:
    """One row for each doc with its positions: as many as its text has at most."""
    return rows.groupBy(F.col("doc").alias("doc_id")).agg(F.flatten(F.collect_list("at")).alias(name))
