import math
from collections import Counter

import pytest

from skylattice.llm import lm_score

from .brute import words

MICRO = 1_000_000


def parts(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]


def brute(docs, corpus, order, alpha=0.4, least=1):
    """By the definition, word by word."""
    c = Counter(tuple(ws[p : p + k]) for ws in map(parts, corpus) for k in range(1, order + 1) for p in range(len(ws) - k + 1))
    total = sum(len(parts(t)) for t in corpus)
    log = lambda x: round(math.log(x) * MICRO)
    out = []
    for i, ws in ((i, parts(t)) for i, t in docs):
        s = 0
        for p in range(len(ws)):
            longest = min(p, order - 1)
            for k in range(longest, 0, -1):
                g = tuple(ws[p - k : p + 1])
                if c[g] >= least:
                    s += log(c[g]) - log(c[g[:-1]]) + log(alpha) * (longest - k)
                    break
            else:
                s += log(max(c[(ws[p],)], 1)) - log(total) + log(alpha) * longest
        out.append((i or 0, len(ws), s))
    return sorted(out)


DOCS = [(1, "the cat sat on the mat the cat"), (2, "The dog sat"), (3, None), (4, " \n"), (5, "x"), (6, "the cat sat on the mat the cat"), (None, "a dog a dog"), (7, ""), (7, "the cat"), (None, "cat"), (8, "a a a a a a a a a a")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, doc int")


def rows(df):
    return sorted((r.doc_id or 0, r.n_words, r.log_score_micro) for r in df.collect())


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("share", [1 / 4096, 1.0])
def test_own_corpus(spark, monkeypatch, order, share):
    monkeypatch.setattr(lm_score, "HOT_SHARE", share)
    got = lm_score.lm_score(frame(spark, DOCS), order)
    assert rows(got) == brute(DOCS, [t for _, t in DOCS], order)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got.collect())


@pytest.mark.parametrize("order,least", [(3, 1), (2, 2), (4, 1)])
def test_other_corpus_backs_off(spark, order, least):
    new = [(1, "the cat sat near the mat"), (2, "dog the unknown"), (None, None), (2, "sat on the dog")]
    corpus = [t for _, t in DOCS]
    assert rows(lm_score.scores(frame(spark, new), frame(spark, DOCS), order, 0.4, least)) == brute(new, corpus, order, 0.4, least)
    assert rows(lm_score.scores(frame(spark, DOCS), frame(spark, DOCS), order)) == brute(DOCS, corpus, order)


def test_hot_n_grams_and_many_chunks(spark, monkeypatch, sf_dir):
    """A phrase that every text has is looked up apart; chunks and buckets change nothing."""
    docs = [(i, f"a common phrase {i} and {i % 3} more of a common phrase") for i in range(200)]
    want = brute(docs, [t for _, t in docs], 3)
    assert rows(lm_score.lm_score(frame(spark, docs))) == want
    real = lm_score.common.documents(spark, sf_dir)
    whole = rows(lm_score.lm_score(real))
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 500)
    monkeypatch.setattr(lm_score.common, "CHUNK_BYTES", 1000)
    assert rows(lm_score.lm_score(frame(spark, docs))) == want and rows(lm_score.lm_score(real)) == whole


def test_one_shuffle_serves_the_counts_and_the_join(spark):
    sent = spark.range(10).selectExpr("cast(id % 4 as int) AS bucket", "array(id % 4) AS keys", "array(id) AS docs", "array(1) AS signs")
    df = lm_score.joined(sent.mapInArrow(lambda batches: batches, sent.schema), 4)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")]
    reused = plan.count("ReusedExchange")
    assert reused == 1 and plan.count("Exchange shufflepartitionidpassthrough") == 1 + reused and "ShuffledHashJoin" in plan


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    got = lm_score.lm_score(frame(spark, [(1, long), (2, "w1 w2 w3")])).collect()
    assert sorted(r.n_words for r in got) == [3, 300_000]
    assert lm_score.lm_score(frame(spark, []).limit(0)).count() == 0
