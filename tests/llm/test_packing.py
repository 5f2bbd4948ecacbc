import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import common, packing


def holds(lengths, sizes):
    bins, offsets, final = packing.pack(np.array(lengths, np.int64), sizes)
    for b in range(len(final)):
        own = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        at = 0
        for o, n in own:
            assert o == at  # end to end, nothing overlaps
            at += n
        assert at <= final[b] and final[b] == min(s for s in sizes if s >= at)
    assert sorted({*bins.tolist()}) == [*range(len(final))]
    return bins, final


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=80))
def test_bins_are_valid(lengths):
    holds(lengths, (10, 20, 40))


def test_best_fit_takes_the_tightest_bin():
    bins, final = holds([9, 8, 2, 1], (10,))
    assert bins.tolist() == [0, 1, 1, 0] and final.tolist() == [10, 10]


def test_opens_the_size_of_least_cost_and_downsizes():
    # One item alone opens the small size; many fill large ones, as a token costs less there.
    assert holds([100], (128, 512))[1].tolist() == [128]
    _, final = holds([100] * 50, (128, 512))
    assert final.tolist() == [512] * 10
    assert packing.cost(512) / 512 < packing.cost(128) / 128
    _, final = holds([100] * 51, (128, 512))
    assert sorted(final.tolist()) == [128] + [512] * 10


def naive(lengths, sizes):
    """The method with plain lists: the contents of each bin and its final size."""
    cost = lambda s: 16 + s + s * s / 65536
    down = lambda used: min(s for s in sizes if s >= used)
    todo = sorted(lengths, reverse=True)
    bins = []
    while todo:
        n = todo.pop(0)
        fits = [b for b in bins if b["size"] - sum(b["items"]) >= n > 0 or n == 0 and b["size"] > sum(b["items"])]
        if fits:  # of equally tight ones, that which changed last
            best = min(fits, key=lambda b: (b["size"] - sum(b["items"]), -b["at"]))
            best["items"].append(n)
            best["at"] = -len(todo)
            continue
        prices = []
        for s in sorted(x for x in sizes if x >= n):
            used = n
            for x in todo:
                used += x if used + x <= s else 0
            prices.append((cost(down(used)) / max(1, used), s))
        bins.append({"size": min(prices)[1], "items": [n], "at": -len(todo)})
    return sorted((down(sum(b["items"])), sum(b["items"])) for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60))
def test_against_plain_lists(lengths):
    sizes = (32, 64, 100, 200)
    bins, _, final = packing.pack(np.array(lengths, np.int64), sizes)
    used = np.bincount(bins, np.array(lengths), len(final)).astype(int) if lengths else []
    assert sorted(zip(final.tolist(), [*used], strict=True)) == naive(lengths, sizes)


def test_near_the_best_of_all_partitions():
    """Cost against every way to part few items into bins."""
    sizes, r = (10, 20, 40), np.random.default_rng(3)

    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [[items[0]], *rest]
            for i in range(len(rest)):
                yield rest[:i] + [[items[0], *rest[i]]] + rest[i + 1 :]

    total = least = 0
    for _ in range(12):
        items = r.integers(1, 40, 6).tolist()
        ways = ([sum(b) for b in p] for p in partitions(items))
        least += min(sum(packing.cost(min(s for s in sizes if s >= u)) for u in p) for p in ways if max(p) <= 40)
        total += sum(packing.cost(float(s)) for s in packing.pack(np.array(items), sizes)[2])
    assert least <= total <= 1.1 * least


def test_size_is_chosen_by_what_fills_it():
    # Two items of 60 leave 8 empty in 128; three fill 180 of 192.
    _, final = holds([60] * 6, (64, 128, 180))
    assert final.tolist() == [180, 180]
    _, final = holds([60] * 4, (64, 120, 200))
    assert final.tolist() == [120, 120]


def test_clashing_columns_and_odd_rows(spark):
    """Columns of the result's names in the input change nothing."""
    df = spark.createDataFrame([(1, "a b", 9, 9, 9), (1, "a b", 9, 9, 9), (None, None, 9, 9, 9), (2, "", 9, 9, 9)], "doc_id long, text string, total int, piece int, length int")
    rows = packing.best_fit(df, packing.n_words()).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == [(0, 0, 0), (1, 0, 2), (1, 0, 2), (2, 0, 0)]
    assert packing.best_fit(df.limit(0), packing.n_words()).count() == 0


def test_little_is_wasted():
    r = np.random.default_rng(1)
    lengths = np.minimum(r.lognormal(5.5, 1, 5000).astype(np.int64), 4096)
    _, _, final = packing.pack(lengths, packing.SIZES)
    assert lengths.sum() / final.sum() > 0.98


def test_whole_table(spark, sf_dir):
    rows = packing.op9_best_fit_packing(spark, sf_dir).collect()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in common.documents(spark, sf_dir).collect()}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_bin.setdefault(r.bin, []).append(r)
    assert {*by_doc} == {*words}
    for d, pieces in by_doc.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n <= max(packing.SIZES)
            at += n
        assert at == words[d]
    for own in by_bin.values():
        assert len({(r.bin_size, r.bin_used) for r in own}) == 1
        assert sum(r.length for r in own) == own[0].bin_used <= own[0].bin_size


def test_rows_of_one_id_are_spread(spark):
    df = spark.createDataFrame([(7, "a b")] * 300, "doc_id long, text string")
    rows = packing.best_fit(df, packing.n_words(), shard=20).collect()
    held = [sum(r.bin >> 32 == s for r in rows) for s in range(15)]
    assert sum(held) == 300 and max(held) < 60


@pytest.mark.parametrize("shard", [3, 1000])
def test_odd_rows(spark, shard):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, "w " * 9000), (3, "")], "doc_id long, text string")
    rows = packing.best_fit(df, packing.n_words(), shard=shard).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == [(0, 0, 1), (1, 0, 0), (1, 0, 0), (2, 0, 4096), (2, 1, 4096), (2, 2, 808), (3, 0, 0)]
    assert packing.best_fit(df.limit(0), packing.n_words()).count() == 0


def test_layout_of_files_does_not_matter(spark):
    """The same rows, equal ones among them, in one partition and in five."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN null ELSE id % 700 END AS doc_id", "cast(id % 5 * 37 AS long) AS n")
    out = [sorted(map(repr, packing.best_fit(df.repartition(k), packing.F.col("n"), shard=500).collect())) for k in (1, 5)]
    assert out[0] == out[1] and len(out[0]) == 3000
    assert len({r.split("bin=")[1].split(",")[0] for r in out[0]}) < 3000


def test_runs_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 7)
    df = spark.range(100).selectExpr("cast(null AS long) AS doc_id", "5 AS n")
    rows = packing.best_fit(df, packing.F.col("n"), shard=40).collect()
    assert len(rows) == 100 and len({(r.bin, r.bin_offset) for r in rows}) == 100
