"""Operators on rows."""

import pytest
from pyspark.sql import functions as F

from skylattice import catalog
from skylattice.operators import accum, derive, levels, merge, packing, resolve, stagger, timeaxis, wind
from skylattice.session import broadcast_if_small, estimated_bytes


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).collect()[0])


def doubles(*x):
    return F.array(*(F.lit(float(v)) for v in x)) if x else F.array().cast("array<double>")


@pytest.mark.parametrize("given,want", [((1, 3, 5), [2, 4]), ((1, 2), [1.5]), ((1,), []), ((), [])])
def test_unstagger(spark, given, want):
    assert one(spark, stagger.unstagger(doubles(*given)))[0] == want


def test_unstagger_rows_and_join(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 2.0), ("a", 2, 8.0), ("b", 0, 1.0), ("b", 5, 3.0)], "g string, i int, v double")
    assert sorted(map(tuple, stagger.unstagger_rows(df, ["g"], "i", "v").collect())) == [("a", 0, 1.0), ("a", 1, 5.0), ("b", 0, 2.0)]
    arrays = df.withColumn("v", F.array("v", F.col("v") + 1))
    assert sorted((r.g, r.i, r.v) for r in stagger.unstagger_join(arrays, ["g"], "i", "v").collect()) == [("a", 0, [1.0, 2.0]), ("a", 1, [5.0, 6.0])]


@pytest.mark.parametrize("u,v,want", [(0, -1, 0), (-1, 0, 90), (0, 1, 180), (1, 0, 270), (0, 0, 270)])
def test_direction(spark, u, v, want):
    assert one(spark, wind.direction(F.lit(float(u)), F.lit(float(v))))[0] == pytest.approx(want)


def test_direction_stays_below_360(spark):
    got = one(spark, wind.direction(F.lit(1e-9), F.lit(-1.0)))[0]
    assert 0 <= got <= 360


def test_rotation(spark):
    df = spark.createDataFrame([(0, 0, 3.0, 4.0), (0, 1, 3.0, 4.0)], "j int, i int, u double, v double")
    grid = spark.createDataFrame([(0, 0, 0.0, 1.0)], "j int, i int, cosa double, sina double")
    for g, want in ((None, [(3, 4), (3, 4)]), (grid, [(4, -3), (3, 4)])):
        r = wind.attach_rotation(df, g)
        rows = r.select("i", *wind.rotate(F.col("u"), F.col("v"), F.col("cosa"), F.col("sina"))).collect()
        assert [tuple(x)[1:] for x in sorted(rows)] == want


LEVELS = [([0, 10, 20], [1, 2, 4], {-1: None, 0: 1, 5: 1.5, 10: 2, 15: 3, 20: 4, 21: None}), ([5], [7], {5: 7, 4: None}), ([], [], {1: None}), ([0, 0, 10], [1, 2, 3], {0: 2, 5: 2.5}), ([0, 10], [None, 3], {5: None, 10: 3}), ([0, 10], [1, None], {0: 1, 5: None})]


@pytest.mark.parametrize("z,v,want", LEVELS)
def test_levels(spark, z, v, want):
    df = spark.createDataFrame([([float(x) for x in z], [None if x is None else float(x) for x in v])], "z array<double>, v array<double>")
    got = df.select(F.inline(levels.at_levels(F.col("z"), F.col("v"), [*want, *want]))).collect()
    assert {r.height: r.value for r in got} == want and [r.height for r in got] == sorted(want)


def test_derived(spark):
    t, q, p = one(spark, derive.actual_temperature(doubles(0), doubles(0), doubles(50000))[0], derive.humidity(F.lit(0.25)), derive.sea_level_pressure(F.lit(100000.0), F.lit(280.0), F.lit(0.0)))
    assert t == pytest.approx(300 * 0.5**0.2854) and q == 0.2 and p == 100000
    z = one(spark, derive.geo_height(doubles(0, 0), doubles(0, 981 * 2)), derive.geo_height(doubles(0, 0), doubles(0, 981 * 2), F.lit(40)))
    assert z[0] == [100] and z[1] == [60]


def test_times(spark):
    got = one(spark, timeaxis.parse_times(F.lit("2023-02-12_06:30:59")))[0]
    assert str(got) == "2023-02-12 06:30:00"


def times(spark, *rows):
    return spark.createDataFrame(rows, "file string, t_idx int, time string").withColumn("time", F.col("time").cast("timestamp_ntz"))


def test_axis_of_overlapping_files(spark):
    axis = timeaxis.time_axis(times(spark, ("b", 0, "2024-01-01 01:00"), ("a", 0, "2024-01-01 00:00"), ("a", 1, "2024-01-01 01:00"), ("b", 1, "2024-01-01 02:00")))
    assert [(r.g_idx, r.file, r.t_idx) for r in axis.orderBy("g_idx").collect()] == [(0, "a", 0), (1, "a", 1), (2, "b", 1)]
    assert timeaxis.between_times(axis, "2024-01-01 01:00", "2024-01-01 02:00").count() == 2
    assert timeaxis.between_times(axis, None, "2024-01-01").count() == 1
    assert timeaxis.between_times(axis, "2025-01-01", None).count() == 0
    assert timeaxis.locate(axis, spark.createDataFrame([(2,), (9,)], "g_idx int")).collect()[0].file == "b"


def test_increments(spark):
    df = spark.createDataFrame([(c, t, float(t * t + c)) for c in (1, 2) for t in range(5)], "cell int, k int, total double").withColumn("time", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, k)"))
    full = accum.increments(df, F.col("total"), ["cell"], ["time"], "inc")
    assert sorted((r.cell, r.k, r.inc) for r in full.collect()) == [(c, t, None if t == 0 else 2.0 * t - 1) for c in (1, 2) for t in range(5)]
    axis = df.select("time").distinct()
    for start in (None, "2024-01-01", "2024-01-01 02:00", "2023-01-01"):
        want = timeaxis.between_times(full, start, "2024-01-01 03:00")
        got = accum.increments_between(df, axis, F.col("total"), ["cell"], "inc", start, "2024-01-01 03:00")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_increment_of_missing_is_missing(spark):
    df = spark.createDataFrame([(1, 0, 1.0, None), (1, 1, 2.0, 3.0), (1, 2, 4.0, 3.0), (1, 3, 0.0, 0.0)], "cell int, t int, a double, b double")
    got = accum.increments(df, accum.total([F.col("a"), F.col("b")]), ["cell"], ["t"], "inc").orderBy("t").collect()
    assert [r.inc for r in got] == [None, None, 2.0, -7.0]  # negative values stay


def test_merge_later_wins_missing_included(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "cell int, v double")
    b = spark.createDataFrame([(2, None), (3, 3.0)], "cell int, v double")
    assert sorted(map(tuple, merge.merge_variants([a, b], ["cell"], "v").collect())) == [(1, 1.0), (2, None), (3, 3.0)]


def test_densify(spark):
    full = merge.densify(spark.createDataFrame([(1, 2, 5.0)], "a int, b int, v double"), [spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(2,), (3,)], "b int")])
    assert sorted((r.a, r.b, r.v) for r in full.collect()) == [(1, 2, 5.0), (1, 3, None), (2, 2, None), (2, 3, None)]


def test_pack(spark):
    df = spark.createDataFrame([(280.123,), (float("nan"),), (None,), (-61.0,)], "v double")
    got = df.select(packing.pack(F.col("v"), 2, -61)).collect()
    assert [r[0] for r in got] == [34112, None, None, 0]
    back = df.select("v", packing.unpack(packing.pack(F.col("v"), 2, -61), 2, -61).alias("b")).collect()
    assert abs(back[0].b - back[0].v) <= 0.005


def test_chunks(spark):
    df = spark.createDataFrame([(t, i) for t in range(3) for i in range(7)], "t int, i int")
    got = packing.chunked(df, {"t": 2, "i": 3}, 4)
    assert {(r.t_chunk, r.i_chunk) for r in got.collect()} == {(a, b) for a in (0, 1) for b in (0, 1, 2)}
    spread = got.select(F.spark_partition_id().alias("p"), "t_chunk", "i_chunk").distinct().groupBy("t_chunk", "i_chunk").count()
    assert spread.filter("count > 1").count() == 0


def test_resolve_frame_as_resolve(spark):
    names = ["U10", "air_temp", "RAINC", "QVAPOR", "T", "wind_speed", "nothing"]
    rows = resolve.resolve_frame(spark.createDataFrame([*enumerate(names)], "at int, name string"), catalog.as_frame(spark)).orderBy("at", "pos").collect()
    assert [r.key for r in rows] == resolve.resolve(names[:-1], catalog.CATALOGUE)


def test_broadcast_is_bounded(spark):
    small, large = spark.range(10), spark.range(10**9)
    assert estimated_bytes(small) < estimated_bytes(large)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(broadcast_if_small(small)) and "broadcast" not in plan(broadcast_if_small(large))
