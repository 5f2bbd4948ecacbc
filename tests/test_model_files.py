"""Parquet model files: runs of steps, files that differ, winds in one shuffle, levels."""

import re

import pytest
from pyspark.sql import functions as F

from skylattice.functions.projection import SPHERE, Projection
from skylattice.operators import accum, levels, stagger
from skylattice.plans import convert as plan
from skylattice.sources.model import ModelSource
from skylattice.testing import synth


def steps_of(file, *at):
    from pyspark.sql import Row

    return [Row(g_idx=0, time=None, file=file, t_idx=t) for t in at]


def test_runs_of_steps(spark, tmp_path):
    synth.write_file(spark, f"{tmp_path}/a", steps=1)
    s = ModelSource(spark, f"{tmp_path}/a")
    assert s.runs([*steps_of("a", 5, 6), *steps_of("b", 0, 1, 2), *steps_of("c", 0, 1, 2), *steps_of("d", 0, 2)]) == [(((5, 6),), ["a"]), (((0, 2),), ["b", "c"]), (((0, 0), (2, 2)), ["d"])]
    many = [x for k in range(20) for x in steps_of(f"f{k}", k)]
    assert s.runs(many) == [(((0, 19),), [f"f{k}" for k in range(20)])]


def test_two_steps_across_two_files_read_two_steps(spark, tmp_path):
    synth.write_file(spark, f"{tmp_path}/a")
    synth.write_file(spark, f"{tmp_path}/b", start="2023-02-12 04:00:00", first=4)
    s = ModelSource(spark, [f"{tmp_path}/a", f"{tmp_path}/b"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    df = s.timed("surface", "2023-02-12T03:00", "2023-02-12T04:00")
    assert df.count() == 2 * 63
    scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "surface" in x]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert [re.findall(r"\(t_idx,(\d)\)", x) for x in scans] == [["3", "3"], ["0", "0"]]


def test_files_that_differ(spark, tmp_path):
    synth.write_file(spark, f"{tmp_path}/a", steps=2)
    for name, start, change in (("b", "02", lambda x: x.drop("T2")), ("c", "04", lambda x: x.withColumn("PSFC", F.col("PSFC").cast("double")))):
        synth.write_file(spark, f"{tmp_path}/x{name}", start=f"2023-02-12 {start}:00:00", steps=2)
        for t in ("attrs", "times", "columns3d", "grid"):
            spark.read.parquet(f"{tmp_path}/x{name}/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        change(spark.read.parquet(f"{tmp_path}/x{name}/surface.parquet")).write.parquet(f"{tmp_path}/{name}/surface.parquet")
    s = ModelSource(spark, [f"{tmp_path}/{x}" for x in "abc"])
    with pytest.raises(KeyError, match="b has no variable .T2"):
        plan.convert(s, "T2")
    with pytest.raises(TypeError, match="c has .PSFC. as double, not as float"):
        plan.convert(s, "PSFC")
    assert plan.convert(s, ["T2", "PSFC"], end="2023-02-12T01:00")["air_temp"].count() == 2 * 63
    assert plan.convert(s, "U10")["u_wind"].count() == 6 * 63


def test_winds_share_one_shuffle(spark, tmp_path):
    """All four outputs in one job: one shuffle of cells, used again by the others."""
    synth.write_file(spark, f"{tmp_path}/a", steps=2)
    cube = plan.convert(ModelSource(spark, f"{tmp_path}/a"), ["WIND", "WIND_DIR", "U", "V"], target_levels=[300])
    whole = None
    for df in cube.values():
        whole = df if whole is None else whole.unionByName(df)
    whole.collect()
    text = whole._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    cells = [x for x in final.splitlines() if "+- Exchange hashpartitioning(time" in x]
    assert len(cells) == 1 and final.count("ReusedExchange") >= 3


def test_segments_give_the_same_increments(spark):
    """Cells that miss in some segments, null totals, and a segment that is added."""
    rows = [(f, c, 10 * f + t, None if (f, c, t) == (1, 2, 3) else float((10 * f + t) ** 2 * c)) for f in range(4) for c in range(3) for t in range(4) if (f, c) != (2, 1)]
    df = spark.createDataFrame(rows, "file int, cell int, t int, total double").repartition(3)
    total, order = F.col("total"), ["t"]
    want = sorted(map(repr, accum.increments(df, total, ["cell"], order, "inc").select("cell", "t", "inc").collect()))
    assert sorted(map(repr, accum.increments_by_segment(df, total, "file", ["cell"], order, "inc").collect())) == want
    old, new = df.filter("file < 3"), df.filter("file = 3")
    edges = accum.segment_edges(old, total, "file", ["cell"], order)
    added = accum.increments_by_segment(new, total, "file", ["cell"], order, "inc", edges)
    assert sorted(map(repr, accum.increments_by_segment(old, total, "file", ["cell"], order, "inc").unionByName(added).collect())) == want


def test_a_new_segment_reads_only_edges(spark, tmp_path):
    df = spark.range(1000).selectExpr("id div 100 AS file", "id % 5 AS cell", "id AS t", "cast(id * id AS double) AS total")
    df.filter("file < 9").write.parquet(f"{tmp_path}/rows")
    accum.segment_edges(spark.read.parquet(f"{tmp_path}/rows"), F.col("total"), "file", ["cell"], ["t"]).filter("file = 8").write.parquet(f"{tmp_path}/edges")
    added = accum.increments_by_segment(df.filter("file = 9"), F.col("total"), "file", ["cell"], ["t"], "inc", spark.read.parquet(f"{tmp_path}/edges"))
    text = added._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "rows]" not in text
    want = accum.increments(df, F.col("total"), ["cell"], ["t"], "inc").filter("file = 9").select("cell", "t", "inc")
    assert sorted(map(repr, added.collect())) == sorted(map(repr, want.collect()))


def test_on_mass_points(spark):
    mass = spark.createDataFrame([(0, j, i, [float(j)], "m") for j in range(2) for i in range(3)], "time int, j int, i int, z array<double>, name string")
    u = spark.createDataFrame([(0, j, i, [10.0 * i + j]) for j in range(2) for i in range(4)], "time int, j int, i_stag int, U array<double>")
    v = spark.createDataFrame([(0, j, i, [100.0 * j + i]) for j in range(3) for i in range(3) if (j, i) != (2, 2)], "time int, j_stag int, i int, V array<double>")
    got = {(r.j, r.i): (r.z, r.name, r.U[0], r.V[0]) for r in stagger.on_mass_points(mass, u, v).collect()}
    assert got == {(j, i): ([float(j)], "m", 10 * i + 5 + j, 100 * j + 50 + i) for j in range(2) for i in range(3) if (j, i) != (1, 2)}


def test_merged_levels_are_those_of_one_by_one(spark):
    columns = [[0.0, 10.0, 20.0, 40.0], [5.0, 5.0, 7.0], [1.0, 5.0, 5.0], [3.0], [], None, [0.0, 10.0], [2.0, 2.0]]
    rows = [(k, z, None if z is None else [float(n * n + 1) for n in range(len(z))]) for k, z in enumerate(columns)]
    df = spark.createDataFrame(rows, "k int, z array<double>, v array<double>")
    asked = [-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.5, 7.0, 10.0, 15.0, 40.0, 41.0]
    merged = df.select("k", F.inline(levels.at_levels(F.col("z"), F.col("v"), asked)))
    single = df.select("k", F.explode(F.array(*map(F.lit, asked))).alias("height")).join(df, "k").select("k", "height", levels.at_level(F.col("z"), F.col("v"), F.col("height")).alias("value"))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, single.collect()))


@pytest.mark.parametrize("p", [Projection("lcc", -30.0, -60.0, -41.0, 173.0), Projection("lcc", 33.0, 45.0, 40.0, -97.0), Projection("polar", -71.0, 0.0, -90.0, 173.0), Projection("polar", 60.0, 0.0, 90.0, -45.0, SPHERE), Projection("mercator", -41.0, 0.0, 0.0, 173.0), Projection("latlon")])
def test_inverse_in_columns_and_numbers(spark, p):
    """Both agree, and with a fixed point of the test's own for the latitude."""
    points = [(p.lon_0 + a, (p.lat_1 or -40.0) + b) for a in (-9.0, 0.0, 4.0) for b in (-6.0, 0.0, 5.0)]
    df = spark.createDataFrame([(*p.forward(*x), *x) for x in points], "x double, y double, lon double, lat double")
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    for r in df.select("*", lon.alias("back_lon"), lat.alias("back_lat")).collect():
        assert (r.back_lon, r.back_lat) == pytest.approx((r.lon, r.lat), abs=1e-9) == p.inverse(r.x, r.y)
