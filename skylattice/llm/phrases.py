"""Phrases of words that stand together more often than their parts explain.

Words that occur often enough get numbers; any other word breaks a piece, as no
frequent phrase holds it.  Every position of a text gives one binary key of fixed
width: the numbers of the ``LONGEST`` words from there on, cut at the piece's end.
Keys are range-partitioned and sorted by radix; then the runs of equal first two,
three, ... words are the counts of all shorter phrases too, so each position is
sorted once, not once for each length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

LONGEST = 5
#: Occurrences that make a candidate.
LEAST = 100
#: A longer candidate that has so many percent of a phrase's occurrences takes its place.
PERCENT = 100
TOP = 2000
#: Up to so many frequent words, the dictionary is broadcast (some 50 MB as a Python
#: dict); beyond, words and dictionary are joined.
DICTIONARY_WORDS = 400_000
#: Distinct words that a task counts before it sends its counts on.
COUNTED_WORDS = 500_000
#: Positions that a task sorts and counts before it sends them on.
SORTED_KEYS = 4_000_000
#: Rows, and keys of each, from which it is seen how to cut all keys into ranges.
SAMPLED_ROWS, SAMPLED_KEYS = 4_000, 50
#: Bins in which words are numbered, each by itself.
BINS = 1024
_LOW = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 9)

# --- words and their numbers -------------------------------------------------


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, word, n of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def sent() -> pa.RecordBatch:
            langs = [k for k, c in counts.items() for _ in c]
            words = [w for c in counts.values() for w in c]
            n = [v for c in counts.values() for v in c.values()]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for batch, texts in common.text_chunks(batches):
            for key, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                counts.setdefault(key, Counter()).update(t.translate(_LOW).split())
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield sent()
                counts = {}
        yield sent()

    return _texts(docs, lang, text).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered_words(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word, n, id: words of ``least`` or more, with numbers from 1 that fit 32
    bits.  They are numbered within bins, so no task sees all of them."""
    frequent = counts.filter(F.col("n") >= least).withColumn("bin", F.pmod(F.xxhash64("lang", "word"), F.lit(BINS)))
    nth = F.row_number().over(W.partitionBy("bin").orderBy("lang", "word"))
    return frequent.select("lang", "word", "n", ((nth - 1) * BINS + F.col("bin") + 1).cast("long").alias("id"))


# --- keys --------------------------------------------------------------------


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of 32-bit numbers, by radix: stable sorts by 16 bits, from
    the last to the first.  Digits that are all the same are passed over."""
    order = np.arange(len(keys))
    for column in range(keys.shape[1] - 1, -1, -1):
        for shift in (0, 16):
            digit = (keys[:, column] >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # radix sort for 16 bits
    return order


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with their counts."""
    order = radix_order(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[first], np.add.reduceat(n, first)


def _bytes(keys: np.ndarray) -> np.ndarray:
    """Keys as byte strings of fixed width, in the same order."""
    return np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * LONGEST}").reshape(-1)


def _block(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and counts, one plane of bytes after another."""
    rows = np.concatenate([keys, n.astype(np.uint32)[:, None]], 1).astype(">u4")
    return zstandard.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes(), 3)


def _unblock(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4 * LONGEST + 4, -1)
    rows = np.ascontiguousarray(planes.T).view(">u4").astype(np.uint32)
    return rows[:, :LONGEST], rows[:, LONGEST].astype(np.int64)


def _windows(ids: np.ndarray, many: int) -> np.ndarray:
    """Of words in order, 0 at breaks: a row of ``LONGEST`` numbers for each of the
    first ``many`` positions from which two words or more go on, with zeros from the
    first break."""
    padded = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
    at = np.flatnonzero((padded[: len(ids)] > 0) & (padded[1 : len(ids) + 1] > 0))
    at = at[at < many]
    rows = np.zeros((len(at), LONGEST), np.uint32)
    going = np.ones(len(at), bool)
    for k in range(LONGEST):
        word = padded[at + k]
        going &= word > 0
        rows[:, k] = np.where(going, word, 0)
    return rows


def _gathered(texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted and counted keys of texts (arrays of words), some millions at a time."""
    held, size = [], 0
    for ids in texts:
        for at in range(0, len(ids), SORTED_KEYS):
            held.append(_windows(ids[at : at + SORTED_KEYS + LONGEST - 1], SORTED_KEYS))
            size += len(held[-1])
            if size >= SORTED_KEYS:
                yield _counted(np.concatenate(held), np.ones(size, np.int64))
                held, size = [], 0
    if size:
        yield _counted(np.concatenate(held), np.ones(size, np.int64))


#: Rows, and what gives from their batches the words of each text as numbers, 0 at breaks.
Numbered = tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]]


def _by_broadcast(texts: DataFrame, words: DataFrame) -> Numbered:
    rows = words.select("lang", "word", "id").toArrow()  # at most DICTIONARY_WORDS
    columns = [rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist(), rows.column(2).to_pylist()]
    shared = texts.sparkSession.sparkContext.broadcast(columns)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known: dict[str, dict[bytes, int]] = {}
        for lang, word, i in zip(*shared.value, strict=True):
            known.setdefault(lang, {b"": -1})[word] = i
        for batch, raw in common.text_chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), raw, strict=True):
                if own := known.get(lang):
                    split = text.translate(_LOW).replace(b"\n", b" \n ").split(b" ")
                    ids = np.fromiter(map(own.get, split, repeat(0)), np.int64, len(split))
                    yield ids[ids >= 0]

    return texts, numbers


def _by_join(texts: DataFrame, words: DataFrame) -> Numbered:
    """The same for a dictionary of any size: each word is a row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 36
        for batch, raw in common.text_chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), raw, strict=True):
                for part in text.translate(_LOW).split(b"\n"):
                    own = part.split()
                    piece += 1
                    for at in range(0, len(own), 50_000):
                        some = own[at : at + 50_000]
                        n = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, piece)), pa.array(np.arange(at, at + n)), pa.array([lang] * n, pa.string()), pa.array(some, pa.binary()).cast(pa.string())], ["piece", "pos", "lang", "word"])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for row in batch.column(0):
                yield row.values.to_numpy()

    every = common.staged(texts.mapInArrow(split, "piece long, pos long, lang string, word string"))
    # Both sides are shuffled afresh, so Spark can split a word that many rows have.
    ids = every.join(words.select("lang", "word", "id").hint("merge"), ["lang", "word"], "left")
    rows = ids.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(0).cast("long")).alias("id")))).alias("x"))
    return common.staged(rows.select(F.col("x.id").alias("ids"))), numbers


def _splitters(numbered: Numbered, ranges: int) -> np.ndarray:
    """Sorted keys that cut all keys into about equal ranges, from a sample: some
    thousand rows, or twenty for each range, and a few keys of each.  They decide how
    evenly keys are dealt, nothing else."""
    rows, numbers = numbered

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in numbers(batches):
            keys = _windows(ids[:SORTED_KEYS], SORTED_KEYS)
            keys = keys[:: max(1, len(keys) // SAMPLED_KEYS)]
            yield pa.RecordBatch.from_arrays([pa.array(_bytes(keys).astype(object), pa.binary())], ["key"])

    share = min(1.0, max(SAMPLED_ROWS, 20 * ranges) / max(1, rows.count()))
    sampled = rows if share == 1 else rows.sample(share, seed=11)
    keys = np.sort(np.array(sampled.mapInArrow(some, "key binary").toArrow().column(0).to_pylist(), f"S{4 * LONGEST}"))
    return np.unique(keys[np.arange(1, ranges) * len(keys) // ranges]) if len(keys) else keys


def frequent(numbered: Numbered, ranges: int, least: int = LEAST) -> DataFrame:
    """ids (array) and f of all phrases of two words or more with ``least`` occurrences.

    Tasks sort and count the keys of their texts, cut them at the splitters, and send
    each range as one block; a range's blocks are sorted together, and runs of equal
    first words counted.  Runs at a range's two ends may go on in others, so they are
    summed with theirs, whatever their count.
    """
    splitters = _splitters(numbered, ranges)
    rows, numbers = numbered
    n = len(splitters) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, count in _gathered(numbers(batches)):
            ends = [*np.searchsorted(_bytes(keys), splitters).tolist(), len(keys)]
            some = [(k, a, z) for k, (a, z) in enumerate(zip([0, *ends], ends, strict=False)) if z > a]
            for i in range(0, len(some), 100):
                own = some[i : i + 100]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in own], pa.int32()), pa.array([_block(keys[a:z], count[a:z]) for _, a, z in own], pa.binary())], ["range", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blocks.setdefault(k, []).append(data)
        for k in [*blocks]:
            parts = [*map(_unblock, blocks.pop(k))]
            yield from _runs(*_counted(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])), least)

    dealt = rows.mapInArrow(cut, "range int, block binary").repartitionById(n, F.col("range"))
    counted = dealt.mapInArrow(run, "ids array<long>, f long")
    return counted.groupBy("ids").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _runs(rows: np.ndarray, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Of a range's keys in order: phrases of each length with their counts, those of
    ``least`` or more and those at the ends."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in range(LONGEST):
        new[1:] |= rows[1:, k] != rows[:-1, k]
        if not k:
            continue
        first = np.flatnonzero(new)
        total = np.add.reduceat(n, first)
        good = total >= least
        good[[0, -1]] = True
        good &= rows[first, k] > 0
        own = rows[first[good], : k + 1].astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * (k + 1), pa.int32()), pa.array(own.reshape(-1)))
        yield pa.RecordBatch.from_arrays([lists, pa.array(total[good])], ["ids", "f"])


# --- phrases -----------------------------------------------------------------


def mined(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP, lang: str = "lang", text: str = "text", dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` how often the two parts of its
    lowest-scoring cut do, ``n`` the language's words, score floor(1000 a n / (l r)).
    A null lang is ``und``, a null text is empty; rows that repeat count again, keys
    and other columns don't matter.  Ties go by the phrase.  An empty table, or one
    without a phrase of ``least`` occurrences, gives no rows.  A text of any length is
    read whole by one task.
    """
    spark = docs.sparkSession
    texts = _texts(docs, lang, text)
    counts = common.staged(word_counts(docs, lang, text))
    words = common.staged(numbered_words(counts, least))
    n_words, positions = words.agg(F.count(F.lit(1)), F.sum("n")).first()
    numbered = (_by_broadcast if n_words <= dictionary_words else _by_join)(texts, words)
    phrases = common.staged(frequent(numbered, common.partitions(spark, positions or 0), least))
    # What phrases are made of: phrases, and single words.
    parts = phrases.unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("f")))
    part = lambda side: parts.select(F.col("ids").alias(side), F.col("f").alias(f"f_{side}")).hint("merge")
    cuts = phrases.select("ids", "f", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("ids", F.lit(1), F.col("k")), "rest": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(part("first"), "first").join(part("rest"), "rest")
    # Names and languages.
    named = phrases.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word").hint("merge"), "id")
    named = named.groupBy("ids").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("own")).select("ids", "lang", F.array_join("own.word", " ").alias("phrase"))
    # What a longer candidate has in it.
    inner = phrases.filter(F.size("ids") > 2).select("f", F.explode(_inner(F.col("ids"))).alias("ids")).groupBy("ids").agg(F.max("f").alias("longer"))
    left = phrases.join(inner.hint("merge"), "ids", "left").filter(f"longer IS NULL OR 100 * longer < {percent} * f").select("ids")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (
        cuts.join(named.hint("merge"), "ids")
        .join(left.hint("merge"), "ids", "left_semi")
        .join(totals.hint("merge"), "lang")
        .withColumns({"_over": exact("f") * 1000 * exact("n"), "_under": exact("f_first") * exact("f_rest")})
        .withColumn("score", F.expr("_over div _under"))
    )
    best = scored.groupBy("lang", "phrase", F.col("f").alias("a"), "n").agg(F.min(F.struct("score", "k", F.col("f_first").alias("l"), F.col("f_rest").alias("r"))).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _inner(ids):
    """All runs of two words or more within a phrase but itself."""
    runs = F.transform(F.sequence(F.lit(2), F.size(ids) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(ids) - k + 1), lambda i: F.slice(ids, i, k)))
    return F.array_distinct(F.flatten(runs))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(common.documents(spark, sf_dir))


SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words
), grams AS (
  SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS k FROM starts
), counted AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2 AND f >= 100
), cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.cut, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS cut FROM candidates) c
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates))
  GROUP BY ALL
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.n, b.score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
