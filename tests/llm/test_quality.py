import re
from collections import Counter

import pytest

from skylattice.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(covered), base


CASES = {
    "null": None,
    "empty": "",
    "blank": " \n\t\n ",
    "prose": "\n".join(f"Sentence{i} says item{i * 7} stands near box{i * 3}." for i in range(20)),
    "loop": "spam spam spam " * 30,
    "overlap": "a a a a b " + " ".join(f"w{i}." for i in range(60)),
    "lines": "\n".join(["Same line here once more."] * 3 + [f"Line{i} differs from{i} others{i} really." for i in range(20)]),
    "unicode": "Über 😀 straße | naïve word " * 3,
    "table": "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(30)),
    "menu": "\n".join(["Home | About | Contact"] * 2 + ["Read more"] * 50 + ["This work has a line."]),
    "long": " ".join(f"word{i % 3001}" for i in range(9000)) + ".",
}


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(k, v, "x", 7, 8) for k, v in CASES.items()], "name string, text string, kept string, extra int, _words int")
    return {r.name: r for r in quality.quality(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_counts(judged, name):
    r = judged[name]
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(CASES[name])
    assert (r.extra, r._words) == (7, 8)


def test_verdicts(judged):
    kept = {k for k, r in judged.items() if r.kept}
    assert kept == {"prose", "lines", "overlap"}
    assert judged["prose"].clean_text == CASES["prose"] and judged["prose"].lost_share == 0
    assert judged["menu"].clean_text == "This work has a line."


def test_lines_that_fail(spark):
    text = "Good text stays here.\nAll rights reserved.\nHome | Login | Search\nshort one\nb### c### d### e### f.\n\nEnd of it."
    df = spark.createDataFrame([(text,)], "text string").select(quality.line_verdicts(quality.F.col("text")).alias("v"))
    assert [x.why for x in df.collect()[0].v] == [None, "boilerplate", "navigation", "punctuation", "symbols", None, None]


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = quality.op7_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_phrase_does_not_fail_a_paragraph(spark):
    """It speaks for a dozen words of its line."""
    clean = " ".join(f"word{i} stands" for i in range(62))
    rows = [(1, f"{clean} and she learned JavaScript last year."), (2, f"{clean}.\nShe learned JavaScript last year."), (3, "All rights reserved. " + "Privacy policy and terms of use apply. " * 3)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == rows[0][1]
    assert got[2].kept and got[2].clean_text == f"{clean}."
    assert got[3].clean_text == ""
