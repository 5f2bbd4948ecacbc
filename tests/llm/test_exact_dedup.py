import pytest

from skylattice.llm import common, exact_dedup


def rows(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept) for r in df.collect())


def test_batches_against_the_index(spark):
    index = exact_dedup.new_index(spark)
    a = spark.createDataFrame([(3, "a  b", "z"), (1, "a\tb", "z"), (2, None, "z"), (4, "", "z"), (5, "c", "z")], "doc_id long, text string, digest string")
    assert rows(index.dedup(a, "a")) == [(1, 1, 2, True), (2, 2, 2, True), (3, 1, 2, False), (4, 2, 2, False), (5, 5, 1, True)]
    assert index.rows().count() == 3
    assert rows(index.dedup(a, "a")) == [(1, 1, 2, True), (2, 2, 2, True), (3, 1, 2, False), (4, 2, 2, False), (5, 5, 1, True)]
    assert index.rows().count() == 3  # given again: nothing is appended twice
    b = spark.createDataFrame([(0, "a b"), (9, "new"), (9, "new"), (None, "odd")], "doc_id long, text string")
    assert rows(index.dedup(b, "b")) == [(-1, None, 1, True), (0, 1, 1, False), (9, 9, 2, True), (9, 9, 2, True)]
    assert index.rows().count() == 5
    assert index.dedup(b.limit(0), "c").count() == 0


def test_index_is_bucketed_and_not_shuffled(spark):
    """Whatever a batch is joined for, only the batch moves."""
    index = exact_dedup.new_index(spark)
    index.dedup(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "a")
    groups = spark.createDataFrame([(b"q", 1, 1)], "digest binary, first_id long, group_size long")
    for joined in (index.fresh(groups, "b"), index.known(groups)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_index_is_not_sorted_again(spark):
    """Of three segments none is sorted, only the batch."""
    index = exact_dedup.new_index(spark)
    for n in range(2):
        index.dedup(spark.createDataFrame([(n, f"x{k}") for k in range(40 * n, 40 * n + 60)], "doc_id long, text string").repartition(3), f"{n}")
    assert len(index.segments()) == 3 and index.rows().count() == 100
    groups = common.staged(spark.createDataFrame([(b"q", 1, 1)], "digest binary, first_id long, group_size long"))
    with common.setting(spark, exact_dedup.IN_ORDER, "true"):
        for joined in (index.fresh(groups, "b"), index.known(groups)):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") == 1
            assert plan.count("Sort [") == 1
    assert spark.conf.get(exact_dedup.IN_ORDER) == "false"
    index.drop()


@pytest.mark.parametrize("at", ["_write", "_clean", "_remove"])
def test_compaction_that_breaks_off(spark, monkeypatch, at):
    """Before the merged segment is there, after it, or between two removals."""
    index = exact_dedup.new_index(spark)
    for n in range(3):
        index.dedup(spark.createDataFrame([(n, f"x{n}"), (n, "x0")], "doc_id long, text string"), f"{n}")
    have = sorted(map(tuple, index.rows().collect()))
    assert len(have) == 3
    own, calls = getattr(exact_dedup.DigestIndex, at), []

    def broken(self, *args):
        calls.append(args)
        if at == "_remove" and len(calls) < 2:
            return own(self, *args)
        raise RuntimeError("stopped")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(exact_dedup.DigestIndex, at, broken)
        index.compact()
    again = exact_dedup.DigestIndex(spark, index.name, "unused")
    assert sorted(map(tuple, again.rows().collect())) == have
    assert again._ranges() == again.segments()
    assert rows(again.dedup(spark.createDataFrame([(9, "x1"), (8, "y")], "doc_id long, text string"), "z")) == [(8, 8, 1, True), (9, 1, 1, False)]
    assert again.rows().count() == 4
    again.drop()


def test_append_that_breaks_off(spark, monkeypatch):
    """A batch whose append failed is given again."""
    index = exact_dedup.new_index(spark)
    df = spark.createDataFrame([(2, "a"), (1, "a")], "doc_id long, text string")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(exact_dedup.DigestIndex, "known", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        index.dedup(df, "a")
    assert rows(index.dedup(df, "a")) == [(1, 1, 2, True), (2, 1, 2, False)]
    assert index.rows().count() == 1
    index.drop()


def test_compaction_and_drop(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.DigestIndex, "COMPACT_AFTER", 2)
    index = exact_dedup.new_index(spark)
    for n in range(5):
        df = spark.createDataFrame([(10 * n + k, f"text {k * (n + 1)}") for k in range(4)], "doc_id long, text string")
        index.dedup(df, f"batch {n}")
    texts = {f"text {k * (n + 1)}" for k in range(4) for n in range(5)}
    assert index.rows().count() == len(texts)
    again = exact_dedup.DigestIndex(spark, index.name, "unused", 3)
    assert again.buckets == index.buckets
    assert rows(again.dedup(spark.createDataFrame([(99, "text 1")], "doc_id long, text string"), "z")) == [(99, 1, 1, False)]
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_long_text(spark):
    long = "word  " * 300_000
    df = spark.createDataFrame([(1, long), (2, long.replace("  ", "\t"))], "doc_id long, text string")
    assert rows(exact_dedup.once(df)) == [(1, 1, 2, True), (2, 1, 2, False)]
