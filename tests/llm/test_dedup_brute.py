"""Suffix, substring and near dedup against brute force."""

import random

import pytest
from .brute import near, suffixes, windows

from skylattice.llm import common, ngram_join, substring_dedup, suffix_dedup

ROWS = "doc_id long, text string, pos string, key string"


def made(seed, n=60, vocabulary=40):
    """Texts with shared passages, copies, near copies, runs and odd ones."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghéß") * r.randint(1, 2) + str(r.randint(0, vocabulary))
    passages = [" ".join(word() for _ in range(r.randint(5, 80))) for _ in range(6)]
    texts = [None, "", " \n ", "x", "a" * 500, "ab" * 300, "one two three four", "one two Three four"]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.15:
            texts.append(r.choice(texts))
        elif kind < 0.35 and texts[-1]:
            ws = texts[-1].split()
            for _ in range(r.randint(1, 3)):
                ws[r.randrange(len(ws))] = word() if ws else ""
            texts.append(" ".join(ws))
        elif kind < 0.5:
            p = r.choice(passages)
            texts.append(p[r.randint(0, 3) :] + " " + p)
        else:
            parts = [r.choice(passages) if r.random() < 0.3 else " ".join(word() for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 4))]
            texts.append(r.choice([" ", "\n", "  "]).join(parts))
    ids = r.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "p", "k") for i, t in docs], ROWS)


@pytest.mark.parametrize("seed,length", [(1, 200), (2, 48), (3, 200), (4, 20)])
def test_suffixes(spark, seed, length):
    docs = made(seed)
    got = suffix_dedup.suffix_dedup(frame(spark, docs), length)
    rows = [tuple(r)[:5] for r in got.collect()]
    assert sorted(rows) == sorted(suffixes(docs, length))


@pytest.mark.parametrize("seed,window", [(1, 50), (2, 8), (3, 13), (4, 4)])
def test_windows(spark, seed, window):
    docs = made(seed)
    got = substring_dedup.substring_dedup(frame(spark, docs), window)
    rows = [tuple(r)[:4] for r in got.collect()]
    assert sorted(rows) == sorted(windows(docs, window))


@pytest.mark.parametrize("seed,percent,words", [(1, 80, 5), (2, 60, 3), (3, 80, 2), (4, 50, 1)])
def test_near(spark, seed, percent, words):
    docs = made(seed)
    got = ngram_join.near_duplicates(frame(spark, docs), words, percent)
    assert sorted(tuple(r) for r in got.collect()) == sorted(near(docs, words, percent))


@pytest.mark.parametrize("small,block", [(32, 128), (1, 7)])
def test_near_chain_and_large_group(spark, monkeypatch, small, block):
    """A chain links end to end; many near copies of one text are one component;
    long runs with several components are compared block by block."""
    monkeypatch.setattr(ngram_join, "SMALL_RUN", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [f"w{i}" for i in range(120)]
    docs = [(1000 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(100)]
    docs += [(k, " ".join(f"c{i}" for i in range(k, k + 60))) for k in range(0, 30, 3)]
    docs += [(2000 + k, " ".join([f"y{k}_{j}" if j % 9 == k % 9 else x for j, x in enumerate(base)])) for k in range(20)]
    got = ngram_join.near_duplicates(frame(spark, docs))
    assert sorted(tuple(r) for r in got.collect()) == sorted(near(docs))


@pytest.mark.parametrize("small,block", [(32, 128), (1, 7)])
def test_near_other_members_of_a_group(spark, monkeypatch, small, block):
    """2 and 3 link and meet by x alone; 1 has 2's prefix and size, but is far from 3."""
    monkeypatch.setattr(ngram_join, "SMALL_RUN", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = [(1, "x a b c"), (2, "x d e f"), (3, "x d e f g")]
    docs += [(10 + k, " ".join(["a b c d e f g", *(f"u{k}_{i}" for i in range(30))])) for k in range(10)]
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(frame(spark, docs), 1).collect())
    assert got == sorted(near(docs, 1)) and got[2] == (3, 5, 2)


def test_sketches_bound_the_difference():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 300)
        both = [r.getrandbits(64) for _ in range(r.randint(0, n))]
        a, b = (both + [r.getrandbits(64) for _ in range(r.randint(1, n))] for _ in "ab")
        a, b = (ngram_join.np.array(x, ngram_join.np.uint64) for x in (a, b))
        assert ngram_join.sketches_differ(ngram_join.parity_sketch(a), ngram_join.parity_sketch(b)) <= len({*a.tolist()} ^ {*b.tolist()})


def test_whole_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in common.documents(spark, sf_dir).collect()]
    assert sorted(map(tuple, suffix_dedup.op4_suffix_dedup(spark, sf_dir).collect())) == sorted(suffixes(docs, 200))
    assert sorted(map(tuple, substring_dedup.op6_substring_dedup(spark, sf_dir).collect())) == sorted(windows(docs, 50))
    assert sorted(map(tuple, ngram_join.op8_ngram_join(spark, sf_dir).collect())) == sorted(near(docs))


def test_odd_rows(spark):
    """Rows with a null or repeated key are rows of their own."""
    text, other = (" ".join(f"{x}{i}" for i in range(60)) for x in ("word", "term"))
    odd = frame(spark, [(None, text), (5, text), (5, text), (5, other), (None, other), (7, None)])
    key = lambda r: r.doc_id or -1
    whole = [len(other), len(text)]
    assert sorted((key(r), r.n_removed) for r in suffix_dedup.suffix_dedup(odd).collect()) == sorted([(-1, n) for n in whole] + [(5, n) for n in [*whole, len(text)]] + [(7, 0)])
    assert sorted((key(r), r.n_removed) for r in substring_dedup.substring_dedup(odd).collect()) == [(-1, 60), (-1, 60), (5, 0), (5, 0), (5, 60), (7, 0)]
    assert sorted((key(r), r.component_id) for r in ngram_join.near_duplicates(odd).collect()) == [(-1, 5), (-1, 5), (5, 5), (5, 5), (5, 5), (7, 7)]
    for f in (suffix_dedup.suffix_dedup, substring_dedup.substring_dedup, ngram_join.near_duplicates):
        assert f(odd.limit(0)).count() == 0


def test_repeated_key_with_different_texts(spark):
    """As many rows come out as went in."""
    odd = frame(spark, [(1, "a" * 300), (1, "b" * 300), (2, "a" * 300)])
    assert suffix_dedup.suffix_dedup(odd).count() == substring_dedup.substring_dedup(odd).count() == ngram_join.near_duplicates(odd).count() == 3


def test_nothing_is_left_behind(spark):
    """Tables and folders made on the way go; the result stays readable."""
    before = {t.name for t in spark.catalog.listTables()}
    got = ngram_join.near_duplicates(frame(spark, made(1)))
    assert {t.name for t in spark.catalog.listTables()} == before and got.count() == 60


def test_slot_counts(spark):
    """Of all sets, whatever the number of tasks."""
    docs = [(i, t) for i, t in made(9) if t]
    texts = [t.encode() for _, t in docs]
    want = ngram_join.np.bincount(ngram_join.slot_of(ngram_join.shingles(texts, 3)[0]), minlength=ngram_join.SLOTS)
    for n in (1, 7):
        table = common.packed_table(frame(spark, docs).repartition(n), ngram_join.summary(3))
        assert (ngram_join.slot_counts(table.select("doc_id", "packed").repartition(n), 3) == want).all()


def test_long_text(spark):
    """One text that is longer than a chunk, twice within another."""
    r = random.Random(5)
    long = " ".join(f"{r.randrange(10**6)}" for _ in range(200_000))
    docs = frame(spark, [(1, long), (2, "start " + long + " end")])
    got = {x.doc_id: x for x in substring_dedup.substring_dedup(docs, texts_too=False).collect()}
    assert (got[1].n_removed, got[2].n_removed) == (0, 200_000)
    got = {x.doc_id: x for x in suffix_dedup.suffix_dedup(docs).collect()}
    assert got[1].n_removed == len(long) and got[2].n_removed == len(long)


def test_runs_across_partitions(spark, monkeypatch):
    """Keys of all shares of the rows, in partitions far smaller than the largest."""
    monkeypatch.setattr(common, "RUN_ROWS", 50)
    monkeypatch.setattr(common.partitions, "__defaults__", (0, 50))
    r = random.Random(7)
    rows = [(r.choice([1, 1, 1, 2, 3, r.randrange(10, 400)]), r.choice([0, r.randrange(3)]), r.randrange(100), p) for p in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, doc long, pos long")
    by = {}
    for a, b, d, p in rows:
        by.setdefault((a, b), []).append((d, p))
    for keep in ("any", "heads", "open", "docs", "later"):
        want = []
        for k, v in by.items():
            head, last = min(v), max(v)
            for d, p in v:
                good = {"any": len(v) > 1, "heads": len(v) > 1, "open": len(v) > 1 and any(q & 1 for _, q in v), "docs": last[0] > head[0], "later": d > head[0]}[keep]
                if good:
                    want.append((*k, d, p))
        got = common.runs(df, ["a", "b"], keep, with_keys=True).collect()
        assert sorted(tuple(r)[:4] for r in got) == sorted(want)
        heads = {(r.a, r.b, r.doc): r.head for r in got}
        for r in got if keep in ("docs", "heads") else ():  # heads lead to the least doc
            assert (r.head, r.head_pos) in by[r.a, r.b] and (r.head, r.head_pos) <= (r.doc, r.pos)
            at = r.doc
            while at in (x[2] for x in heads if x[:2] == (r.a, r.b)) and heads[r.a, r.b, at] != at:
                at = heads[r.a, r.b, at]
            assert at == min(by[r.a, r.b])[0]
