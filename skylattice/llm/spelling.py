"""Spelling variants: words one edit apart, grouped under the frequent one.

An edit leaves one half of a word as it is.  So a word within one edit of another
begins with that one's first half, or ends with its second.  Halves are dealt over
shards; each shard holds its halves in an Aho-Corasick automaton, scans the words
that come to it once, and takes those hits whose place and length fit.  The rest of
the two words is then compared by matrices of code points.

A word comes to the shards of its own halves, and to those of what could be a half
of a word one letter shorter or longer: at most four.  What a shard finds for a word
is summed there, so pairs never leave it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import ne

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Code points of the shortest word.
SHORTEST = 6
#: Occurrences of the rarest word, and how many times as frequent a word's form is.
LEAST, TIMES = 5, 5
#: One in so many (document, run) has a letter taken out.
ONE_IN = 199
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words that a task counts before it sends its counts on.
COUNTED_WORDS = 500_000
#: Rows of a shard, words of one half that stay together, and cells of a comparison.
SHARD_ROWS, HALF_WORDS, CELLS = 200_000, 20_000, 1 << 22
#: Pairs of one half that are compared word by word, without matrices.
FEW = 40

# --- words -------------------------------------------------------------------


def word_counts(docs: DataFrame, shortest: int = SHORTEST, one_in: int = ONE_IN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n, of runs of letters with A-Z in lower case.  Where ``one_in`` divides
    the crc32 of ``<doc_id>:<run>``, the run has lost the letter that it names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["word", "n"])

        for batch, texts in common.text_chunks(batches):
            for k, raw in zip(batch.column(0).to_pylist(), texts, strict=True):
                own = Counter(_RUN.findall(raw.decode("utf-8", "replace").translate(_LOW)))
                begin = zlib.crc32(b"%s:" % (b"" if k is None else str(k).encode()))
                for w, n in own.items():
                    if len(w) >= shortest:
                        h = zlib.crc32(w.encode(), begin)
                        if h % one_in == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < shortest:
                                continue
                        counts[w] += n
            if len(counts) > COUNTED_WORDS:
                yield sent()
                counts.clear()
        yield sent()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- near words --------------------------------------------------------------


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` is exactly one edit from each row of ``b``: letters
    (uint8), rows of one length each, which differ by one at most."""
    p, q = a.shape[1], b.shape[1]
    if p == q:
        wrong = np.zeros((len(a), len(b)), np.uint8)
        for i in range(p):
            wrong += a[:, None, i] != b[None, :, i]
        return wrong == 1
    if p < q:
        return one_edit(b, a).T
    # One letter more in a: what agrees from the left and from the right makes up b.
    front = np.ones((len(a), len(b)), bool)
    back, same = front.copy(), np.zeros((len(a), len(b)), np.uint8)
    for i in range(q):
        front &= a[:, None, i] == b[None, :, i]
        back &= a[:, None, p - 1 - i] == b[None, :, q - 1 - i]
        same += front
        same += back
    return same >= q


def _matrices(words: list[str], cut: int, first: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: indices of the words, and the letters of what they have besides the
    half of ``cut`` letters."""
    by: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by[len(w)].append(i)
    rest = lambda w: w[cut:] if first else w[: len(w) - cut]
    return {m: (np.array(at), np.frombuffer("".join(rest(words[i]) for i in at).encode("latin-1"), np.uint8).reshape(len(at), -1)) for m, at in by.items()}


class Found:
    """Of words that a shard scans: near words so far, and the best of them."""

    def __init__(self, words: list[str]):
        self.words = words
        self.n_near = np.zeros(len(words), np.int64)
        self.best_n = np.zeros(len(words), np.int64)
        self.best = [""] * len(words)

    def put(self, i: int, count: int, n: int, word: str) -> None:
        """More near words of the ``i``-th, and the best of them."""
        self.n_near[i] += count
        if n > self.best_n[i] or n == self.best_n[i] and word < self.best[i]:
            self.best_n[i], self.best[i] = n, word


def _near(a: str, b: str) -> bool:
    """``one_edit`` of two words."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    at = next((i for i, c in enumerate(b) if c != a[i]), len(b))
    return a[at + 1 :] == b[at:]


def _shard(halves: list[tuple[str, str, int]], scanned: set[str]) -> Iterator[pa.RecordBatch]:
    """``halves``: (side and half, word, n) that the shard holds; ``scanned``: words
    that came to it."""
    owners: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for half, word, n in halves:
        owners[half].append((-n, word))
    if not owners:
        return
    sides: dict[str, list[str]] = defaultdict(list)
    for half in owners:
        sides[half[1:]].append(half)
    automaton = ahocorasick.Automaton()
    for half, own in sides.items():
        automaton.add_word(half, own)
    automaton.make_automaton()
    words = sorted(scanned)
    asks: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        for end, own in automaton.iter(w):
            for half in own:
                size = len(half) - 1
                # A first half at the word's begin, a second one at its end, of a word of fitting length.
                if (end + 1 == size if half[0] == "<" else end + 1 == len(w)) and 2 * size - 2 <= len(w) <= 2 * size + 2:
                    asks[half].append(i)
    found = Found(words)
    for half, mine in asks.items():
        own = sorted(owners[half])
        if len(mine) * len(own) <= FEW:
            _by_word(found, half, mine, own)
        else:
            _by_matrix(found, half, mine, own)
    some = np.flatnonzero(found.n_near)
    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in some], pa.string()), pa.array(found.n_near[some]), pa.array(found.best_n[some]), pa.array([found.best[i] for i in some], pa.string())], ["word", "n_near", "best_n", "best"])


def _by_word(found: Found, half: str, mine: list[int], own: list[tuple[int, str]]) -> None:
    for i in mine:
        w = found.words[i]
        hits = [(n, x) for n, x in own if abs(len(x) - len(w)) <= 1 and (half[0] == "<" or w[: len(x) // 2] != x[: len(x) // 2]) and _near(w, x)]
        if hits:
            found.put(i, len(hits), -hits[0][0], hits[0][1])


def _by_matrix(found: Found, half: str, mine: list[int], own: list[tuple[int, str]]) -> None:
    cut, first = len(half) - 1, half[0] == "<"
    theirs = [w for _, w in own]
    n = np.array([-x for x, _ in own])
    asking = _matrices([found.words[i] for i in mine], cut, first)
    index = np.array(mine)
    for m, (at, b) in _matrices(theirs, cut, first).items():
        for k in (m - 1, m, m + 1):
            rows, a = asking.get(k, (index[:0], b[:0]))
            step = max(1, CELLS // len(at))
            for i in range(0, len(rows), step):
                who = index[rows[i : i + step]]
                near = one_edit(a[i : i + step], b)
                if not first:  # a pair that the first half finds, too, is taken there
                    begins = np.array([found.words[x][: m // 2] for x in who])[:, None] == np.array([theirs[j][: m // 2] for j in at])[None, :]
                    near &= ~begins
                some = near.any(1)
                for x, j, count in zip(who[some].tolist(), at[near[some].argmax(1)].tolist(), near[some].sum(1).tolist(), strict=True):
                    found.put(x, count, int(n[j]), theirs[j])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best: of distinct words (word, n) within one edit of
    another, how many there are, the most frequent one, and of several the least.
    Words have two letters or more, all of Latin-1."""
    spark = words.sparkSession
    size = "char_length(word)"
    first = lambda k: f"concat('<', left(word, {k}))"
    last = lambda k: f"concat('>', right(word, {k}))"
    halves = words.selectExpr("word", "n", f"explode(array({first(f'{size} div 2')}, {last(f'{size} - {size} div 2')})) AS half")
    # Of words a letter shorter, as long, or a letter longer.
    asked = words.selectExpr("word", "cast(null AS long) AS n", f"explode(array({first(f'({size} - 1) div 2')}, {first(f'({size} + 1) div 2')}, {last(f'{size} div 2')}, {last(f'{size} div 2 + 1')})) AS half")
    hot = common.staged(halves.groupBy("half").count().filter(F.col("count") > HALF_WORDS).selectExpr("half", f"cast(ceil(count / {HALF_WORDS}) AS int) AS parts"))
    if hot.isEmpty():
        dealt = halves.unionByName(asked).withColumn("part", F.lit(0))
    else:  # its words are dealt over several shards, and who asks for it comes to all of them
        halves = halves.join(hot.hint("merge"), "half", "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
        asked = asked.join(hot.hint("merge"), "half", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        dealt = halves.drop("parts").unionByName(asked.drop("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves, scanned = [], set()
        for b in batches:
            for half, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n is None:
                    scanned.add(word)
                else:
                    halves.append((half, word, n))
        yield from _shard(halves, scanned)

    n = common.partitions(spark, 6 * words.count(), SHARD_ROWS)
    got = dealt.repartition(n, "half", "part").select("half", "word", "n").mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return got.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.n")).alias("best_n"), "x.best")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form): the last of the forms that follow from a word.
    Forms are more frequent than their words, so there are no rings; each round
    doubles the way, so rounds grow with the logarithm of the longest one."""
    way = common.staged(forms.select("word", F.col("form").alias("root")))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = common.staged(way.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        way = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return way


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, one_in: int = ONE_IN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``shortest`` letters and
    ``least`` occurrences.

    ``form`` is the near word (one letter in, out or replaced) of largest n, of several
    the least in code-point order, if it occurs ``times`` times as often; else null, as
    is ``form_n``.  ``root`` is where forms lead, the word itself without one.  A null
    text has no words, a null key counts as an empty one; rows that repeat count
    again (each by its own key), other columns don't matter, an empty table gives no
    rows.  A text of any length is read whole by one task.
    """
    if shortest < 2:
        raise ValueError("words need two letters to have halves")
    counts = word_counts(docs, shortest, one_in, key, text)
    words = common.staged(counts.filter(F.col("n") >= least))
    near = near_words(words)
    form = F.col("best_n") >= times * F.col("n")
    known = words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"))
    known = common.staged(known)
    ways = roots(known.filter("form IS NOT NULL"))
    return known.join(ways.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE table_of AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w
  FROM documents
), own AS (
  SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w
), hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM own, table_of
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN crc % 199 = 0 THEN w[1:crc % length(w)] || w[crc % length(w) + 2:] ELSE w END AS word, n FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), holes AS (
  SELECT word, n, word[1:i - 1] || '_' || word[i + 1:] AS hole, word[1:i - 1] || word[i + 1:] AS short FROM places
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.short = b.word
), near AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n FROM pairs GROUP BY word
), best AS (
  SELECT p.word, m.n_near, m.best_n, min(p.other) AS best FROM pairs p JOIN near m ON p.word = m.word AND p.n = m.best_n GROUP BY ALL
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 5 * w.n THEN b.best END AS form, CASE WHEN b.best_n >= 5 * w.n THEN b.best_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), ways AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT y.word, f.form, y.step + 1 FROM ways y JOIN forms f ON f.word = y.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, y.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, max_by(root, step) AS root FROM ways GROUP BY word) y ON y.word = f.word
"""
