"""Removal of word windows that repeat across documents, level by level.

A window of W words repeats only if the parts it consists of do.  Level 1 takes
windows of W/4 words at anchors (the least hash among the parts of some window
of W words: equal windows have equal anchors, so a few positions stand for all).
What repeats there is extended to W/2 words, to either side, and what repeats at
that length to all windows of W words around it.  Only positions that survive a
level reach the next.  Exact copies are set aside before: a text of W words or
more that an earlier row has is removed as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROWS = "key long, lead long, doc long, pos long"
WINDOW = 50


def _rows(key: np.ndarray, lead: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(lead.view(np.int64)), pa.array(doc), pa.array(pos.astype(np.int64))], ["key", "lead", "doc", "pos"])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("doc_id")), np.int64)


def summary(texts: list[bytes]) -> tuple[list[bytes], list[int]]:
    words = [x.split() for x in texts]  # bytes.split() parts at the same six bytes
    return [hashlib.sha256(b" ".join(w)).digest() for w in words], [len(w) for w in words]


def first_level(w: int):
    part = w // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            words = common.Words(texts)
            n = len(words.code) - w + 1
            if n < 1:
                continue
            grams = common.Windows(words.code).every(part)
            at = common.anchors(grams, words.doc[:n] == words.doc[w - 1 :], w - part + 1)
            yield _rows(grams[at], words.code[at], _ids(batch)[words.doc[at]], at - words.first[words.doc[at]])

    return run


def second_level(w: int):
    part, half = w // 4, w // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            words = common.Words(texts)
            hashes = common.Windows(words.code)
            pos, row = common.lists(batch, "at")
            for side, shift in ((0, 0), (1, part - half)):  # to the right, to the left
                begin = pos + shift
                ok = (begin >= 0) & (begin + half <= words.n[row])
                at = words.first[row[ok]] + begin[ok]
                yield _rows(hashes.at(at, half), words.code[at], _ids(batch)[row[ok]], pos[ok] * 2 + side)

    return run


def third_level(w: int):
    part, half = w // 4, w // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            words = common.Words(texts)
            hashes = common.Windows(words.code)
            code, row = common.lists(batch, "at")
            # One entry for each anchor: whether it repeats to the right and to the left.
            each, own = np.unique(row << 40 | code >> 1, return_inverse=True)
            side = np.zeros((2, len(each)), bool)
            side[code & 1, own] = True
            row, pos = each >> 40, each & (1 << 40) - 1
            change = np.zeros(len(words.code) + 2, np.int64)
            # An anchor at offset o of a window: which extensions lie within the window.
            for lo, hi, good in ((0, half - part - 1, side[0]), (half - part, w - half, side[0] & side[1]), (w - half + 1, w - part, side[1])):
                a = np.maximum(pos - hi, 0)[good]
                z = np.minimum(pos - lo, words.n[row] - w)[good]
                ok = z >= a
                base = words.first[row[good][ok]]
                np.add.at(change, base + a[ok], 1)
                np.add.at(change, base + z[ok] + 1, -1)
            at = np.flatnonzero(np.cumsum(change) > 0)
            for i in range(0, len(at), 100_000):
                part_at = at[i : i + 100_000]
                doc = words.doc[part_at]
                yield _rows(hashes.at(part_at, w), words.code[part_at], _ids(batch)[doc], part_at - words.first[doc])

    return run


def finish(w: int, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.unpacked(batches):
            starts, row = common.lists(batch, "at")
            copies = batch.column(batch.schema.get_field_index("copies"))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            n, gone, digest, kept_text = [], [], [], []
            for i, text in enumerate(texts):
                words = text.split()
                keep = np.ones(len(words), bool)
                if not copies[i].is_valid and len(words) >= w:
                    keep[:] = False  # an exact copy of an earlier row
                for a, z in common.union_length(np.unique(starts[cut[i] : cut[i + 1]]), w):
                    keep[a:z] = False
                kept = b" ".join([x for x, k in zip(words, keep.tolist(), strict=True) if k])
                n.append(len(words))
                gone.append(int((~keep).sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "replace"))
            columns = [batch.column(batch.schema.get_field_index("id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts_too:
                columns, names = [*columns, pa.array(kept_text, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", texts_too: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of each row.

    A word goes if a window of ``window`` words that covers it also starts in a
    row with a smaller key; windows are judged on the input.  Null and empty
    texts have no words and lose none, as do texts shorter than the window.  Rows
    with a repeated or null key are rows of their own, in some fixed order, nulls
    last.  An empty table gives no rows; other columns aren't carried, so their
    names don't matter.  A long text is worked on whole by one task, with some 50
    bytes for each of its bytes.  Windows are told apart by 128 bits: the hash of
    the window and that of its first word.
    """
    assert window >= 4
    return common.finished(docs.sparkSession, lambda: _substring_dedup(docs, window, key, text, texts_too))


def _substring_dedup(docs: DataFrame, window: int, key: str, text: str, texts_too: bool) -> DataFrame:
    table = common.packed_table(docs, summary, key, text)
    first = common.representatives(table)
    keys = ["key", "lead"]

    def level(rows: DataFrame, run) -> DataFrame:
        return table.select("doc_id", "packed").join(rows, "doc_id").mapInArrow(run, ROWS)

    found = common.runs(level(first.select("doc_id"), first_level(window)), keys, "docs", singly=True)
    found = common.runs(level(common.by_doc(found, "at"), second_level(window)), keys, "docs", singly=True)
    found = common.runs(level(common.by_doc(found, "at"), third_level(window)), keys, "later", singly=True)
    done = table.select("doc_id", "id", "packed").join(first, "doc_id", "left").join(common.by_doc(found, "at"), "doc_id", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts_too
    return done.mapInArrow(finish(window, texts_too), schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(common.documents(spark, sf_dir), texts_too=False)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS g FROM i),
f AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, i + k AS j FROM g JOIN f USING (g), (SELECT unnest(range(50)) AS k) WHERE doc_id > first_id),
u AS (SELECT doc_id, w.j, ws[w.j] AS word FROM d, unnest(range(1, len(ws) + 1)) AS w(j)),
k AS (SELECT doc_id, count(*) FILTER (r.j IS NOT NULL) AS n_removed,
             string_agg(word, ' ' ORDER BY u.j) FILTER (r.j IS NULL) AS kept
      FROM u LEFT JOIN r USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
