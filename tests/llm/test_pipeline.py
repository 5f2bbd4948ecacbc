"""Each stage over its own input, against brute force."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from skylattice.llm import common, packing, pii, quality  # noqa: E402

from .brute import near, words  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage, and the rows after each."""
    out = [common.documents(spark, SF)]
    for _, f in pipeline.STAGES:
        out.append(common.staged(f(spark, out[-1], SF)))
    return out


SF = "/root/testdata/sf0.01"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_join", "pii", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert df.filter("n_chars <> char_length(text)").count() == 0
        assert df.groupBy("doc_id").count().filter("count > 1").count() == 0


def test_quality(stages):
    kept = {r.doc_id: r.clean_text for r in quality.quality(stages[0]).filter("kept").collect()}
    assert texts(stages[1]) == kept and len(kept) > 500


def test_exact(stages):
    best = {}
    for i, t in texts(stages[1]).items():
        norm = " ".join(words("x" + t + "x"))
        best[norm] = min(best.get(norm, i), i)
    before = texts(stages[1])
    assert texts(stages[2]) == {i: before[i] for i in best.values()}


def test_near(stages):
    before = texts(stages[2])
    kept = {i: before[i] for i, _, c in near([*before.items()]) if i == c}
    assert texts(stages[3]) == kept and len(kept) < len(before)


def test_private(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert {*before} == {*after}
    for i, t in before.items():
        own = {e for _, _, _, e in pii.find(t)}
        assert (after[i] == t) == (not own)
        assert not any(e in after[i] for e in own)


def test_packing(stages):
    n = {i: len(t.encode().split()) for i, t in texts(stages[4]).items()}
    total = {}
    for r in stages[5].collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.bin_used <= r.bin_size in packing.SIZES
    assert total == n


def test_null_repeated_and_clashing_ids(spark):
    """Rows, not ids, are kept or dropped."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, c), (2, d), (2, c), (None, d), (4, "x"), (4, "y")]
    want = [(None, a), (None, b), (1, c), (2, d), (4, "x"), (4, "y")]
    df = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, source string")
    for stage in (pipeline.exact, pipeline.near):
        got = stage(spark, df, SF)
        assert got.columns == df.columns
        assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted((i or 0, t) for i, t in want)


def test_columns_of_any_name_stay(spark):
    """Every name that an operator makes, and other columns, in each stage."""
    text = " ".join(f"w{i}" for i in range(80)) + ". Mail ann@corp.org, please."
    names = [*quality.MADE, "n_replaced", "_row", "_own", "_key", "_carried", "keep_id", "component_id", "digest", "packed"]
    df = spark.createDataFrame([(1, text, 7), (2, text + " more", 8), (3, "short", 9)], "doc_id long, text string, n_chars long")
    df = df.select("*", *(pii.F.lit(f"own {c}").alias(c) for c in names))
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, df, SF)
        assert got.columns == df.columns
        rows = got.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in names)
        assert [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
    assert pipeline.packed(spark, df, SF).count() == 3


def test_empty_and_very_long_input(spark):
    schema = "doc_id long, text string, n_chars long"
    long = ". ".join(f"a{i} b{i * 7} c{i * 3}" for i in range(60_000))
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
        got = stage(spark, spark.createDataFrame([(1, long, 1), (2, None, None), (3, "", 0)], schema), SF).collect()
        assert [r for r in got if r.doc_id == 1]
        assert all(r.text == long for r in got if r.doc_id == 1 and "text" in r)


def test_quality_by_brute_force(stages):
    """Of plain texts (few lines, none failing) the verdict is the base rules'."""
    kept = texts(stages[1])
    n = 0
    for i, t in texts(stages[0]).items():
        ws = words(t)
        windows = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = {k + d for k, w in enumerate(windows) if seen[w] > 1 for d in range(3)}
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        if failed:
            assert i not in kept
        elif all(len(line.split()) >= 5 and line.rstrip()[-1:] in ".!?" and not set("#*$%&|<>©") & {*line} and not any(x in line.lower() for x in ("licens", "reserved", "copyright", "policy", "cookie", "javascript", "ipsum", "terms of")) for line in t.split("\n") if line.strip()):
            n += 1
            assert kept[i] == t
    assert n > 100


def test_private_by_brute_force(stages):
    """Entities that the tables have are looked for by patterns of the test's own."""
    plain = r"\b[\w.]+@[\w.]+\.com\b|\+1 \(\d{3}\) \d{3}-\d{4}|(?<=token = \")[0-9a-f]{40}(?=\")"
    before, after = texts(stages[3]), texts(stages[4])
    own = {e for t in before.values() for e in re.findall(plain, t)}
    assert len(own) > 10 and not any(e in t for t in after.values() for e in own)
    assert all(after[i] == t for i, t in before.items() if not re.search(r"[@\d]|Dr|Mr|Ms|token", t))
