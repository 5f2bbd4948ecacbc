"""Spelling variants against comparing all words; the query has SQL."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skylattice.llm import spelling


def edits(a, b):
    """Whether one letter in, out or replaced makes b of a."""
    if a == b:
        return False
    out = {a[:i] + a[i + 1 :] for i in range(len(a))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return b in out if len(b) < len(a) else a in {b[:i] + b[i + 1 :] for i in range(len(b))}


def brute(rows, least=5, times=5, one_in=199, shortest=6):
    counts = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % one_in == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and edits(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(n, letters="abé", seed=4):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice([*letters], int(rng.integers(4, 10)))) for _ in range(400)]
    weights = 1 / np.arange(1, 401) ** 1.3
    return [(int(k), " ".join(rng.choice(words, 80, p=weights / weights.sum()))) for k in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "'h' AS half").repartition(4)


@pytest.mark.parametrize("few", [spelling.FEW, 0, 10**9])
def test_against_brute_force(spark, few, monkeypatch):
    """With matrices for large groups, for all, and for none."""
    monkeypatch.setattr(spelling, "FEW", few)
    rows = [*rows_of(60), (None, "Garden garden garten GARDEN garden"), (None, None), (7, ""), (7, "gardenn gardens gardenia"), (7, "gardens"), (8, "x" * 300 + " " + "x" * 301)]
    rows += [(100 + i, "Gardens garden garden garden Éclair éclairs éclairs") for i in range(9)]
    got = spelling.variants(docs_of(spark, rows), one_in=7)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute(rows, one_in=7)


def test_hot_halves_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HALF_WORDS", 3)
    monkeypatch.setattr(spelling, "SHARD_ROWS", 50)
    monkeypatch.setattr(spelling, "CELLS", 10)
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 20)
    rows = rows_of(60, "ab")
    got = spelling.variants(docs_of(spark, rows))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute(rows)


def test_long_chains_of_forms(spark):
    way = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(13)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(way, "word string, form string")).collect()))
    assert got == {w: "w13" for w, _ in way}


def test_one_edit_by_matrices():
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice([*"ab"], int(rng.integers(1, 6)))) for _ in range(200)})
    by = {m: [w for w in words if len(w) == m] for m in range(1, 6)}
    for m, k in [(m, k) for m in by for k in by if abs(m - k) < 2]:
        a, b = (np.frombuffer("".join(x).encode(), np.uint8).reshape(len(x), -1) for x in (by[m], by[k]))
        assert spelling.one_edit(a, b).tolist() == [[edits(x, y) for y in by[k]] for x in by[m]]


def test_empty_tables(spark):
    assert spelling.variants(docs_of(spark, [(1, "a")]).filter("false")).count() == 0
    assert spelling.variants(docs_of(spark, [(1, "some words here")])).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs_of(spark, [(1, "a")]), shortest=1)
