"""Stupid-backoff language-model scores from n-gram count tables.

A word's score is the count of the longest n-gram that ends in it and is seen,
over the count of that n-gram without the word, times ``alpha`` for each word by
which the context was cut.  Texts are exploded to n-grams, count tables are
grouped by n-gram, both are joined, and logs are summed by document.

``scores`` does this for any texts against any corpus, n-grams spelt out.

``lm_score`` scores a corpus by itself.  There every n-gram is seen, so a text's
score is a plain sum: plus the log of each longest n-gram's count, minus that of
each context's.  An exploded n-gram needs no more than its hash, its document and
a sign.  It travels in arrays, one row for each chunk of texts and each bucket of
hashes; the buckets are the partitions, where arrays are exploded again, counted,
and joined to their counts without another shuffle.  To bound what a shuffle holds, the
hashes go in ``PASSES`` classes one after another.  N-grams that make up much of
the corpus (``HOT_SHARE``) are looked up in a table of their own, of bounded size,
so no bucket holds many rows of one n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 3
ALPHA = 0.4
#: Classes of hashes, a power of two; bytes of text for each bucket of a class.
PASSES = 2
BUCKET_BYTES = 32 << 20
#: An n-gram is hot if it makes up this share of all; there are as many at most as
#: one divided by it.  A chunk of texts reports those it has this share of itself.
HOT_SHARE = 1 / 4096
MICRO = 1_000_000
#: A small map before the large one, which n-grams are too many for.
TWO_LEVEL = "spark.sql.codegen.aggregate.map.twolevel.enabled"


def micro(x: Column) -> Column:
    """A logarithm in millionths: sums of these don't depend on their order."""
    return F.round(F.log(x) * MICRO).cast("long")


# --- any texts against any corpus --------------------------------------------


def scores(docs: DataFrame, corpus: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and log_score_micro of each row of ``docs`` by the counts of
    ``corpus``.

    n-grams of two words or more are seen if the corpus has them ``least`` times or
    more.  A word that the corpus hasn't counts as if it were there once.  Rows and
    texts are taken as by ``lm_score``.  Joins shuffle both sides afresh, so Spark
    can split an n-gram that many rows have.
    """
    return common.finished(docs.sparkSession, lambda: _scores(docs, corpus, order, alpha, least, key, text))


def _words(text: str) -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, common.SPACE_CLASS + "+"), lambda w: w != "")


def _scores(docs: DataFrame, corpus: DataFrame, order: int, alpha: float, least: int, key: str, text: str) -> DataFrame:
    grams = corpus.select(_words(text).alias("ws")).select("ws", F.posexplode("ws").alias("at", "word"))
    # The n-grams that end in each word, spelt out, from one word to ``order``.
    ending = lambda k: F.when(F.col("at") >= k - 1, F.array_join(F.slice("ws", F.col("at") - (k - 2), F.lit(k)), " "))
    counts = grams.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), ending(k).alias("gram")) for k in range(1, order + 1)))).alias("g"))
    counts = common.staged(counts.select("g.*").filter("gram IS NOT NULL").groupBy("k", "gram").agg(F.count(F.lit(1)).alias("n")))
    total = counts.filter("k = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    rows, row = common.numbered(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id")
    lists = rows.select(F.col(row).alias("doc"), "id", _words("text").alias("ws"))
    at = lists.select("doc", "ws", F.posexplode("ws").alias("at", "word"))
    at = at.select("doc", "at", *(ending(k).alias(f"g{k}") for k in range(1, order + 1)), *(F.when(F.col("at") >= k, F.array_join(F.slice("ws", F.col("at") - (k - 1), F.lit(k)), " ")).alias(f"b{k}") for k in range(1, order)))
    for column, k in [*((f"g{k}", k) for k in range(1, order + 1)), *((f"b{k}", k) for k in range(1, order))]:
        table = counts.filter(F.col("k") == k).select(F.col("gram").alias(column), F.col("n").alias(f"n_{column}"))
        at = at.join(table.hint("merge"), column, "left").drop(column)
    longest = F.least(F.col("at"), F.lit(order - 1))
    score = micro(F.coalesce("n_g1", F.lit(1))) - micro(F.lit(float(max(total, 1)))) + longest * micro(F.lit(alpha))
    for k in range(2, order + 1):
        seen = micro(F.col(f"n_g{k}")) - micro(F.col(f"n_b{k - 1}")) + (longest - (k - 1)) * micro(F.lit(alpha))
        score = F.when(F.col(f"n_g{k}") >= least, seen).otherwise(score)
    summed = at.groupBy("doc").agg(F.sum(score).alias("score"))
    out = lists.select("doc", "id", F.size("ws").cast("long").alias("n_words")).join(summed.hint("merge"), "doc", "left")
    return out.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("score", F.lit(0)).cast("long").alias("log_score_micro"))


# --- a corpus by itself ------------------------------------------------------


def entries(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of a chunk: (hash, text, sign) of those that a text's score has,
    and the hashes of others, which are only counted.

    Of a text with ``order`` words or more, the longest n-grams count plus and their
    contexts minus; the first context is also what its last word's score has plus.
    A shorter text counts as a whole.
    """
    w = common.Words(texts, lower=True)
    hashes = common.Windows(w.code)
    out, only = [], []
    for k in range(1, order + 1):
        every = hashes.every(k)
        at = np.flatnonzero(w.doc[: len(every)] == w.doc[k - 1 :]) if len(every) else np.zeros(0, np.int64)
        key = every[at] ^ common.mixed(np.array([k], np.uint64))
        doc = w.doc[at]
        n, place = w.n[doc], at - w.first[doc]
        plus = (n == k) | (k == order)
        minus = (n >= order) & (k == order - 1) & (place > 0) & (place + k < n)
        for use, sign in ((plus, 1), (minus, -1)):
            out.append((key[use], doc[use], np.full(np.count_nonzero(use), sign, np.int32)))
        only.append(key[~plus & ~minus])
    return (*(np.concatenate(c) for c in zip(*out, strict=True)), np.concatenate(only))


def often(keys: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys that make up ``share`` of ``keys``, 16 of them at least, and their counts."""
    least = max(16, len(keys) * share)
    slot = (keys & np.uint64(0xFFFF)).astype(np.int64)
    key, n = np.unique(keys[(np.bincount(slot, minlength=1 << 16) >= least)[slot]], return_counts=True)
    return key[n >= least], n[n >= least]


class Hot:
    """Counts of hot n-grams, sorted by hash."""

    def __init__(self, table: pa.Table):
        keys = table.column("key").to_numpy().view(np.uint64)
        by = np.argsort(keys)
        self.keys, self.counts = keys[by], table.column("n").to_numpy()[by]

    def at(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the table, -1 for those not in it."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, i, -1)


def _pairs(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def lm_score(docs: DataFrame, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, log_score_micro and mean_log_score of each row of a corpus.

    Words are parted by ASCII white space, with A-Z in lower case.  The model's
    counts are those of the table itself, so no word's context is ever cut but by
    the text's beginning.  log_score_micro is the sum of the words' log scores, each
    count's log rounded to millionths; mean_log_score is that per word.  Null, empty
    and blank texts have no words, a sum of 0 and no mean.  Rows with a repeated or
    null key are rows of their own; repeated texts count each and get the same
    score.  An empty table gives no rows; other columns aren't carried, so their
    names don't matter.  A long text is worked on whole by one task, with some 100
    bytes for each of its bytes.  n-grams are 64-bit hashes.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    return common.finished(docs.sparkSession, lambda: _lm_score(docs, order, key, text))


def _lm_score(docs: DataFrame, order: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows, row = common.numbered(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id")
    rows = rows.select(F.col(row).alias("doc"), "id", "text")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """N-grams that a chunk has often; with a null key, its words."""
        for _, texts in common.text_chunks(batches, "text"):
            keys, _, _, only = entries(texts, order)
            yield _pairs(*often(np.concatenate([keys, only]), HOT_SHARE))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([sum(len(x.split()) for x in texts)], pa.int64())], ["key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hot.value.keys), np.int64)
        for _, texts in common.text_chunks(batches, "text"):
            keys, _, _, only = entries(texts, order)
            at = hot.value.at(np.concatenate([keys, only]))
            total += np.bincount(at[at >= 0], minlength=len(total))
        yield _pairs(hot.value.keys, total)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's words, and the part of its score that hot n-grams make."""
        logs = np.rint(np.log(np.maximum(hot.value.counts, 1)) * MICRO)
        for batch, texts in common.text_chunks(batches, "text"):
            keys, doc, sign, _ = entries(texts, order)
            at = hot.value.at(keys)
            use = at >= 0
            score = np.bincount(doc[use], sign[use] * logs[at[use]], len(texts)) if use.any() else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(x.split()) for x in texts], pa.int64()), pa.array(score.astype(np.int64))], ["doc", "id", "n_words", "score"])

    def packed(this: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in common.text_chunks(batches, "text"):
                own = np.asarray(batch.column(0), np.int64)
                keys, doc, sign, only = entries(texts, order)
                only, n = np.unique(only[only & np.uint64(PASSES - 1) == this], return_counts=True)
                mine = keys & np.uint64(PASSES - 1) == this
                known = np.arange(np.count_nonzero(mine) + len(only)) < np.count_nonzero(mine)
                n = np.concatenate([sign[mine], n]).astype(np.int32)
                who = np.concatenate([own[doc[mine]], np.zeros(len(only), np.int64)])
                keys = np.concatenate([keys[mine], only])
                cold = hot.value.at(keys) < 0
                keys, who, n, known = keys[cold], who[cold], n[cold], known[cold]
                bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                by = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
                at = np.flatnonzero(np.diff(bucket[by], prepend=-1))
                ends = pa.array(np.append(at, len(by)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(keys[by].view(np.int64)), pa.array(who[by], mask=~known[by]), pa.array(n[by]))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[by][at]), *lists], ["bucket", "keys", "docs", "signs"])

        return run

    found = common.staged(rows.mapInArrow(candidates, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    words = sum(r.n for r in found.filter("key IS NULL").collect())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    # At most one divided by the share: what chunks report is no more than there is.
    hot = found.filter(F.col("key").isNotNull() & (F.col("n") >= float(words * order * HOT_SHARE)))
    hot = spark.sparkContext.broadcast(Hot(hot.toArrow()))
    hot = spark.sparkContext.broadcast(Hot(rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()))
    buckets = common.partitions(spark, size, PASSES * BUCKET_BYTES)
    sized = common.staged(rows.mapInArrow(begin, "doc long, id long, n_words long, score long"))
    parts = sized.select("doc", "score")
    for this in range(PASSES):
        sent = rows.mapInArrow(packed(this), "bucket int, keys array<long>, docs array<long>, signs array<int>")
        with common.setting(spark, TWO_LEVEL, "false"):
            parts = parts.unionByName(common.staged(joined(sent, buckets)))
    summed = parts.groupBy("doc").agg(F.sum("score").alias("score"))
    out = sized.select("doc", "id", "n_words").join(summed.hint("merge"), "doc")
    score = F.col("score") - F.when(F.col("n_words") > 0, micro(F.lit(float(max(words, 1))))).otherwise(F.lit(0))
    mean = F.when(F.col("n_words") > 0, score / F.lit(float(MICRO)) / F.col("n_words"))
    return out.select(F.col("id").alias("doc_id"), "n_words", score.alias("log_score_micro"), mean.alias("mean_log_score"))


def joined(sent: DataFrame, buckets: int) -> DataFrame:
    """(doc, score): exploded n-grams joined to their count table, summed.

    Both have the partitions of the one shuffle.  N-grams that the corpus has once
    have a log of 0, so the table leaves them out.
    """
    # What the join would infer is said for both sides, so that one shuffle serves both.
    sent = sent.filter("keys IS NOT NULL AND docs IS NOT NULL AND signs IS NOT NULL")
    lists = sent.repartitionById(buckets, "bucket").select("bucket", "docs", "signs", F.posexplode("keys").alias("at", "key"))
    grams = lists.select("bucket", "key", F.get("docs", F.col("at")).alias("doc"), F.get("signs", F.col("at")).alias("sign"))
    # The count of docs makes this read the same columns.
    counts = grams.groupBy("bucket", "key").agg(F.sum(F.abs("sign")).alias("n"), F.count("doc").alias("in_texts"))
    counts = counts.filter("n > 1 AND in_texts > 0").select("bucket", "key", micro(F.col("n")).alias("log"))
    both = grams.filter("doc IS NOT NULL").join(counts.hint("shuffle_hash"), ["bucket", "key"])
    return both.groupBy("doc").agg(F.sum(F.col("sign") * F.col("log")).alias("score"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(common.documents(spark, sf_dir))


SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS c, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS a FROM d, unnest(range(1, len(ws) + 1)) AS t(i)),
k1 AS (SELECT c, count(*) AS n FROM w GROUP BY c),
k2 AS (SELECT b, c, count(*) AS n FROM w WHERE b IS NOT NULL GROUP BY b, c),
k3 AS (SELECT a, b, c, count(*) AS n FROM w WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (SELECT doc_id, x.n AS c1, y.n AS c2, z.n AS c3, xb.n AS b1, yb.n AS b2
      FROM w JOIN k1 x ON x.c = w.c LEFT JOIN k2 y ON y.b = w.b AND y.c = w.c LEFT JOIN k3 z ON z.a = w.a AND z.b = w.b AND z.c = w.c
      LEFT JOIN k1 xb ON xb.c = w.b LEFT JOIN k2 yb ON yb.b = w.a AND yb.c = w.b),
l AS (SELECT doc_id, CASE WHEN c3 >= 1 THEN round(ln(c3) * {MICRO}) - round(ln(b2) * {MICRO})
                          WHEN c2 >= 1 THEN round(ln(c2) * {MICRO}) - round(ln(b1) * {MICRO})
                          ELSE round(ln(c1) * {MICRO}) - round(ln((SELECT count(*) FROM w)) * {MICRO}) END AS l FROM s),
m AS (SELECT doc_id, count(*) AS n_words, CAST(sum(CAST(l AS BIGINT)) AS BIGINT) AS log_score_micro FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(log_score_micro, 0) AS log_score_micro,
       log_score_micro / {MICRO} / n_words AS mean_log_score
FROM d LEFT JOIN m USING (doc_id)
"""
