"""Phrases against counting every one of them in plain Python; the query has SQL."""

import re
from collections import Counter

import numpy as np
import pytest

from skylattice.llm import phrases


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        kept = []
        for p, a in candidates.items():
            if inside[p] < a:
                score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p, -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(n, seed=5):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "the", "The", "cc", "x", "ü", "日", "rare1", "rare2", "b.", "a,", "\n", "\t", " ", "x!y"]
    return [(["en", "de", None, ""][int(rng.integers(4))], " ".join(rng.choice(words, int(rng.integers(0, 60)), p=[0.15, 0.15, 0.1, 0.1, 0.1] + [0.4 / 11] * 11))) for _ in range(n)]


@pytest.mark.parametrize("dictionary_words", [phrases.DICTIONARY_WORDS, 0])
def test_against_brute_force(spark, dictionary_words, monkeypatch):
    """With the dictionary broadcast, and joined."""
    rows = [*rows_of(150), (None, None), ("en", ""), ("en", "   "), ("fr", "one two three " * 60), ("en", "q r s t u v w. " * 30), ("en", "q r s t u v w. " * 30)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS id", "'k' AS word", "2 AS n", "3 AS score").repartition(5)
    got = phrases.mined(docs, least=12, top=40, dictionary_words=dictionary_words)
    assert sorted(map(tuple, got.collect())) == brute(rows, 12, 40)


def test_small_tasks_and_partitions(spark, monkeypatch):
    """Runs of equal words that go on over chunks and over partitions."""
    monkeypatch.setattr(phrases, "COUNTED_WORDS", 5)
    monkeypatch.setattr(phrases, "SORTED_KEYS", 50)
    monkeypatch.setattr(phrases.common, "RUN_ROWS", 20)
    monkeypatch.setattr(phrases, "SAMPLED_ROWS", 1)
    rows = [("en", "a b a b a a a a b " * 40), ("en", "a a a a a a. b b b " * 25)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.mined(docs, least=10).collect())) == brute(rows, 10, phrases.TOP)


def test_products_beyond_64_bits(spark):
    words = spark.sql("SELECT cast(4e15 AS decimal(19,0)) * 1000 * cast(9e15 AS decimal(19,0)) AS _over, cast(4e15 AS decimal(19,0)) * cast(4e15 AS decimal(19,0)) AS _under")
    assert words.selectExpr("_over div _under AS s").first().s == 2250


def test_radix_order():
    rng = np.random.default_rng(2)
    keys = rng.choice(np.array([0, 1, 65535, 65536, 2**32 - 1], np.uint32), (500, phrases.LONGEST))
    assert keys[phrases.radix_order(keys)].tolist() == sorted(keys.tolist())


def test_empty_and_rare(spark):
    assert phrases.mined(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.mined(spark.createDataFrame([("en", "one two three")], "lang string, text string")).count() == 0
