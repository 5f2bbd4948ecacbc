"""Chunk blocks and the sink: read-back, boxes, whole cubes or none."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import crs
from skylattice.functions.projection import SPHERE, Projection
from skylattice.sources import blocks, sink

SHAPE = {"t": 2, "h": 1, "j": 3, "i": 4}
LCC = Projection("lcc", -30.0, -60.0, -41.0, 173.0)


def cells(spark, nt=5, nh=2, nj=7, ni=9, share=0.7):
    r = np.random.default_rng(3)
    rows = [(t, h, j, i, float(np.float32(r.normal())) if r.random() < share else None) for t in range(nt) for h in range(nh) for j in range(nj) for i in range(ni)]
    return spark.createDataFrame(rows, "t int, h int, j int, i int, value double").repartition(3), {r[:4]: r[4] for r in rows}


def axes(spark, nt=5, nh=2, nj=7, ni=9):
    frame = lambda n, i, c: spark.range(n).select(F.col("id").cast("int").alias(i), F.col("id").cast("double").alias(c))
    return {"time": frame(nt, "t", "time"), "height": frame(nh, "h", "height"), "y": frame(nj, "j", "y"), "x": frame(ni, "i", "x")}


def got(df, name="value"):
    return {(r.t, r.h, r.j, r.i): r[name] for r in df.collect()}


def test_blocks_read_back(spark):
    df, want = cells(spark)
    made = blocks.encoded(df, SHAPE)
    assert got(blocks.decoded(made, SHAPE)) == {k: v for k, v in want.items() if v is not None}
    assert made.count() == len({(t // 2, h, j // 3, i // 4) for (t, h, j, i), v in want.items() if v is not None}) and made.agg(F.sum("n_valid")).first()[0] == sum(v is not None for v in want.values())
    extent = [(0, 4), (0, 1), (0, 6), (0, 8)]
    assert got(blocks.decoded(blocks.every_chunk(made, SHAPE, extent), SHAPE, extent=extent)) == want
    some = blocks.every_chunk(made.filter("t_chunk <> 1"), SHAPE, extent)
    assert got(blocks.decoded(some, SHAPE, extent=extent)) == {k: None if k[0] in (2, 3) else v for k, v in want.items()}


def test_integers_nans_and_no_rows(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 7), (1, 0, 2, 3, -5), (9, 0, 0, 0, None)], "t int, h int, j int, i int, value int")
    assert got(blocks.decoded(blocks.encoded(df, SHAPE, True), SHAPE, True)) == {(0, 0, 0, 0): 7, (1, 0, 2, 3): -5}
    nan = blocks.encoded(df.selectExpr("t", "h", "j", "i", "double('nan') AS value"), SHAPE)
    assert all(np.isnan(r.value) for r in blocks.decoded(nan, SHAPE).collect()) and nan.filter("low IS NULL").count() == 2
    assert blocks.encoded(df.filter("false"), SHAPE).count() == 0


def test_z_order(spark):
    rows = spark.range(64).selectExpr("id div 8 AS j", "id % 8 AS i").withColumn("z", blocks.z_order(F.col("j"), F.col("i")))
    for r in rows.collect():
        assert r.z == sum((r.j >> b & 1) << 2 * b + 1 | (r.i >> b & 1) << 2 * b for b in range(3))


def test_a_box_opens_only_its_chunks(spark, tmp_path):
    """Pages that a scan decodes, with and without a box."""
    df, want = cells(spark, 8, 1, 32, 32, 1.0)
    out = f"{tmp_path}/cube"
    sink.write_cube(spark, out, {"air_temp": df}, axes(spark, 8, 1, 32, 32), LCC, (1, 1, 2, 2))
    box = {"t": (2, 3), "j": (5, 8), "i": (0, 3)}
    rows = sink.read_variable(spark, out, "air_temperature", box)
    inside = lambda k: 2 <= k[0] <= 3 and 5 <= k[2] <= 8 and k[3] <= 3
    assert got(rows, "air_temperature") == {k: v for k, v in want.items() if inside(k)}

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return leaves.apply(0).metrics().apply("numOutputRows").value()

    every = sink.read_blocks(spark, out, "air_temperature")
    few = blocks.within(every, {"t": 1, "h": 1, "j": 2, "i": 2}, box)
    assert few.count() == 2 * 3 * 2 and every.count() == 8 * 256
    assert scanned(few) < 200 < scanned(every) == 2048


def test_a_second_write_replaces_all(spark, tmp_path):
    df, want = cells(spark)
    out = f"{tmp_path}/cube"
    sink.write_cube(spark, out, {"air_temp": df, "precip": df}, axes(spark), LCC, (2, 1, 3, 4))
    sink.write_cube(spark, out, {"wind_speed": df.filter("t = 1")}, axes(spark), LCC, (1, 1, 2, 2), packing={"wind_speed": (3, -100.0)})
    assert [*sink.read_meta(spark, out)["variables"]] == ["wind_speed"]
    back = got(sink.read_variable(spark, out, "wind_speed"), "wind_speed")
    assert back == pytest.approx({k: round(v, 3) for k, v in want.items() if k[0] == 1 and v is not None})
    with pytest.raises(KeyError, match="air_temperature"):
        sink.read_variable(spark, out, "air_temperature")
    assert sorted(n for n in os.listdir(out) if n[0] != ".") == sorted(["manifest", sink.read_meta(spark, out)["version"]])


@pytest.mark.parametrize("stop", ["coordinates", "task", "swap"])
def test_a_failed_write_leaves_the_older_cube(spark, tmp_path, stop, monkeypatch):
    df, want = cells(spark)
    out = f"{tmp_path}/cube"
    sink.write_cube(spark, out, {"air_temp": df}, axes(spark), LCC, (2, 1, 3, 4))
    bad, own = df, axes(spark)
    if stop == "task":
        bad = df.withColumn("value", F.when(F.col("t") == 3, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("value")))
    elif stop == "coordinates":
        own["y"] = own["y"].withColumn("y", F.raise_error(F.lit("stop")).cast("double"))
    else:
        monkeypatch.setattr(sink, "_swap", lambda *_: 1 / 0)
    with pytest.raises(Exception, match="stop|zero"):
        sink.write_cube(spark, out, {"precip": bad}, own, LCC, (1, 1, 1, 1))
    assert got(sink.read_variable(spark, out, "air_temperature"), "air_temperature") == {k: v for k, v in want.items() if v is not None}
    assert sorted(n for n in os.listdir(out) if n[0] != ".") == sorted(["manifest", sink.read_meta(spark, out)["version"]])


def test_dense_reading(spark, tmp_path):
    df, want = cells(spark)
    out = f"{tmp_path}/cube"
    sink.write_cube(spark, out, {"air_temp": df.filter("t <> 2 AND j < 3")}, axes(spark), LCC, (1, 1, 3, 4))
    left = {k: v if k[0] != 2 and k[2] < 3 else None for k, v in want.items()}
    assert got(sink.read_variable(spark, out, "air_temperature", dense=True), "air_temperature") == left
    box = {"t": (1, 2), "i": (3, 5)}
    assert got(sink.read_variable(spark, out, "air_temperature", box, True), "air_temperature") == {k: v for k, v in left.items() if k[0] in (1, 2) and 3 <= k[3] <= 5}


@pytest.mark.parametrize("p", [LCC, Projection("polar", -71.0, 0.0, -90.0, 173.0), Projection("polar", 60.0, 0.0, 90.0, -45.0, SPHERE), Projection("mercator", -41.0, 0.0, 0.0, 173.0), Projection("latlon")])
def test_crs_texts(p):
    back = crs.from_projjson(crs.to_projjson(p))
    assert back == p or p.kind == "latlon" and back.kind == "latlon"
    assert back.forward(171.5, -44.0) == p.forward(171.5, -44.0)


def test_crs_that_is_not_ours():
    with pytest.raises(ValueError):
        crs.from_projjson(crs.to_projjson(LCC).replace("Lambert Conic Conformal (2SP)", "Krovak").replace("9802", "1"))
    with pytest.raises(ValueError):
        crs.from_projjson(crs.to_projjson(LCC).replace('"name": "False easting", "unit": "metre", "value": 0', '"name": "False easting", "unit": "metre", "value": 5'))
