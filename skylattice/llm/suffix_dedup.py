"""Removal of byte strings that start twice or more, by sorted suffixes.

Suffixes go to range partitions between sampled splitters on their leading
token (8 bytes); a partition sorts its suffixes by multikey sort, first by the
leading token and then, where that ties, by the hash of the whole prefix; equal
neighbours, also across the borders of partitions, are repeats (``common.runs``).

Not every suffix is sorted.  Equal strings of W bytes have equal anchors (the
least hash of W/3 bytes within), so:

1. anchors are sorted by a prefix of W/3 bytes; those that repeat survive;
2. around these, starts at fixed steps from the anchor are sorted by W bytes;
3. between two such starts, the core that all strings from there share is
   sorted: where it repeats and not every holder has both starts repeating,
4. every start in between is sorted by W bytes.

Between two starts that repeat, at most W apart, other repeats cover nothing
more, which is why step 4 needs only the borders of repeated passages.
Exact copies are set aside before: all of a text that has one goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 200
ROWS = "lead long, key long, doc long, pos long"
KEYS = ["lead", "key"]


def summary(texts: list[bytes]) -> tuple[list[bytes], list[int]]:
    return [hashlib.sha256(x).digest() for x in texts], [len(x) for x in texts]


class Bytes:
    """The bytes of a chunk's texts, end to end."""

    def __init__(self, batch: pa.RecordBatch, texts: list[bytes]):
        self.ids = np.asarray(batch.column(batch.schema.get_field_index("doc_id")), np.int64)
        self.n = np.array([len(x) for x in texts], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        self.windows = common.Windows(common.BYTE_CODE[self.data[: self.n.sum()]])

    def rows(self, doc: np.ndarray, pos: np.ndarray, length: int, put: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Suffixes at ``pos`` of texts ``doc`` by their first ``length`` bytes;
        ``put`` stands in for the position that the row carries."""
        put = pos if put is None else put
        for i in range(0, len(pos), 100_000):
            d, p = doc[i : i + 100_000], pos[i : i + 100_000]
            at = self.first[d] + p
            lead = np.lib.stride_tricks.sliding_window_view(self.data, 8)[at].copy().view(">u8").reshape(-1).astype(np.uint64)
            key = self.windows.at(at, length) ^ np.uint64(length)
            columns = [(lead ^ np.uint64(1 << 63)).view(np.int64), key.view(np.int64), self.ids[d], put[i : i + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lead", "key", "doc", "pos"])


def _steps(length: int) -> tuple[int, int, int]:
    """Bytes of an anchor, step between tested starts, number of steps.  An anchor
    lies at an offset of 0 to steps * step in each string that it stands for."""
    gram = max(8, length // 3)
    count = 4
    while (length - gram) % count:
        gram += 1
    return gram, (length - gram) // count, count


def find_anchors(length: int):
    gram, _, _ = _steps(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            b = Bytes(batch, texts)
            doc = np.repeat(np.arange(len(texts), dtype=np.int32), b.n)
            n = len(doc) - length + 1
            if n < 1:
                continue
            at = common.anchors(b.windows.every(gram), doc[:n] == doc[length - 1 :], length - gram + 1)
            yield from b.rows(doc[at], at - b.first[doc[at]], gram)

    return run


def test_steps(length: int):
    _, step, count = _steps(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            b = Bytes(batch, texts)
            doc, start = _starts(batch, b, step, count + 1)
            ok = start + length <= b.n[doc]
            yield from b.rows(doc[ok], start[ok], length)

    return run


def _starts(batch: pa.RecordBatch, b: Bytes, step: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) at 0, 1, ... ``count`` - 1 steps before each anchor, each once."""
    pos, row = common.lists(batch, "at")
    start = (pos[:, None] - step * np.arange(count)).reshape(-1)
    each = np.unique((np.repeat(row, count) << 40 | start)[start >= 0])
    return each >> 40, each & (1 << 40) - 1


def test_cores(length: int):
    _, step, count = _steps(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            b = Bytes(batch, texts)
            doc, start = _starts(batch, b, step, count)
            ok = start + length - step <= b.n[doc]
            doc, start = doc[ok], start[ok]
            pos, row = common.lists(batch, "found")
            found = row << 40 | pos
            # Odd: this text has a repeat not at both ends, so starts between may count.
            open_ = ~(np.isin(doc << 40 | start, found) & np.isin(doc << 40 | start - step, found) & (start >= step))
            yield from b.rows(doc, start, length - step, start * 2 + open_)

    return run


def test_between(length: int):
    _, step, _ = _steps(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            b = Bytes(batch, texts)
            code, row = common.lists(batch, "at")
            start = ((code >> 1)[:, None] - np.arange(1, step)).reshape(-1)
            row = np.repeat(row, step - 1)
            ok = (start >= 0) & (start + length <= b.n[row])
            each = np.unique(row[ok] << 40 | start[ok])
            yield from b.rows(each >> 40, each & (1 << 40) - 1, length)

    return run


def finish(length: int, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            starts, row = common.lists(batch, "at")
            copies = batch.column(batch.schema.get_field_index("copies")).to_pylist()
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            columns: list[list] = [[], [], [], [], []]
            for i, text in enumerate(texts):
                spans = common.union_length(np.unique(starts[cut[i] : cut[i + 1]]), length)
                if copies[i] != 1 and len(text) >= length:
                    spans = np.array([[0, len(text)]])
                kept, at = [], 0
                for a, z in spans.tolist():
                    kept.append(text[at:a])
                    at = z
                kept = b"".join([*kept, text[at:]])
                for c, x in zip(columns, (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(x)
            arrays = [batch.column(batch.schema.get_field_index("id")), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts_too:
                arrays, names = [*arrays, pa.array(columns[4], pa.binary())], [*names, "kept_bytes"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", texts_too: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes of each row.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or another; strings overlap, don't cross
    texts and are judged on the input.  Null and empty texts, and those shorter
    than ``length``, lose nothing.  Rows with a null or repeated key are rows of
    their own: copies lose all if they are long enough.  An empty table gives no
    rows; other columns aren't carried, so their names don't matter.  A long text
    is worked on whole by one task, with some 50 bytes for each of its bytes.
    Strings are told apart by their first 8 bytes and a 64-bit hash.
    """
    assert length >= 16
    return common.finished(docs.sparkSession, lambda: _suffix_dedup(docs, length, key, text, texts_too))


def _suffix_dedup(docs: DataFrame, length: int, key: str, text: str, texts_too: bool) -> DataFrame:
    table = common.packed_table(docs, summary, key, text)
    first = common.representatives(table)

    def level(rows: DataFrame, run) -> DataFrame:
        return table.select("doc_id", "packed").join(rows, "doc_id").mapInArrow(run, ROWS)

    table_once = first.select("doc_id")
    anchors = common.staged(common.by_doc(common.runs(level(table_once, find_anchors(length)), KEYS, "any"), "at"))
    found = common.staged(common.runs(level(anchors, test_steps(length)), KEYS, "any"))
    cores = level(anchors.join(common.by_doc(found, "found"), "doc_id", "left"), test_cores(length))
    cores = common.by_doc(common.runs(cores, KEYS, "open"), "at")
    between = common.runs(level(cores, test_between(length)), KEYS, "any")
    spans = common.by_doc(found.unionByName(between), "at")
    done = table.select("doc_id", "id", "packed").join(first, "doc_id", "left").join(spans, "doc_id", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * texts_too
    return done.mapInArrow(finish(length, texts_too), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.documents(spark, sf_dir), texts_too=False)


SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS m FROM h, unnest(range(0, n - {LENGTH - 1})) AS t(i)),
s AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new_run FROM s),
k AS (SELECT doc_id, i, sum(new_run) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS z FROM k GROUP BY doc_id, k),
x AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, [0] || list(z ORDER BY a) AS begins, list(a ORDER BY a) AS ends FROM r GROUP BY doc_id),
o AS (SELECT doc_id, h, n, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, coalesce(begins, [0]) AS begins, list_append(coalesce(ends, []), n) AS ends FROM h LEFT JOIN x USING (doc_id))
SELECT doc_id, n AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(begins) + 1), lambda k: substr(h, 2 * begins[k] + 1, 2 * (ends[k] - begins[k]))), ''))) AS kept_sha256
FROM o
"""
