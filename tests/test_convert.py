"""Whole conversions of synthetic files, against closed forms."""

import json
import math

import pytest
from pyspark.sql import functions as F

from skylattice import cli
from skylattice.plans import convert as plan
from skylattice.sources import sink
from skylattice.sources.model import ModelSource
from skylattice.testing import synth


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("model")
    synth.write_file(spark, f"{base}/out_2023-02-12", first=0)
    synth.write_file(spark, f"{base}/out_2023-02-13", start="2023-02-12 04:00:00", first=4)
    return [f"{base}/out_2023-02-13", f"{base}/out_2023-02-12"]


@pytest.fixture(scope="module")
def source(spark, files):
    return ModelSource(spark, files)


def rows(df):
    return {(str(r.time), r.height, r.j, r.i): r.value for r in df.collect()}


def test_metadata(source, files):
    assert source.input_paths == sorted(files)
    assert source.projection.kind == "lcc" and len(source.variables) == 19
    assert [len(a) for a in source.axes] == [9, 7]
    times = source.axis.orderBy("g_idx").collect()
    assert len(times) == 8 and [t.t_idx for t in times] == [0, 1, 2, 3] * 2
    assert times[4].file > times[3].file
    west, south, east, north = source.bbox_geographic
    assert west < 173 < east and south < -41 < north


def test_missing_file(spark, files):
    with pytest.raises(FileNotFoundError):
        ModelSource(spark, [*files, files[0] + "-none"])


def test_surface(source):
    out = plan.convert(source, ["T2", "TSK", "SWDOWN", "GLW", "SNOWH", "PSFC", "Q2"])
    assert sorted(out) == ["air_temp", "longwave_radiation", "shortwave_radiation", "snow_depth", "soil_temp", "specific_humidity", "surface_pressure"]
    t2 = rows(out["air_temp"])
    assert len(t2) == 8 * 9 * 7
    assert t2["2023-02-12 05:00:00", 2.0, 3, 1] == pytest.approx(285.3, abs=1e-3)
    r = out["air_temp"].filter("j = 3 AND i = 4").collect()[0]
    x, y = source.axes
    assert (r.x, r.y, r.h) == (pytest.approx(x[4]), pytest.approx(y[3]), 1)


def test_rain_goes_on_across_files(source):
    whole = rows(plan.convert(source, "precip")["precip"])
    for t in range(8):
        v = whole[f"2023-02-12 0{t}:00:00", 0.0, 2, 3]
        assert v is None if t == 0 else v == pytest.approx(0.5 * (2 * t - 1) + 0.25)
    part = rows(plan.convert(source, "precip", start="2023-02-12 04:00", end="2023-02-12T05:00")["precip"])
    assert len(part) == 2 * 63 and all(whole[k] == v for k, v in part.items())


def rotated(j, i):
    a = math.radians(i * 2.0 - j)
    u, v, c, s = 3.0 + i, 4.0 - j, math.cos(a), math.sin(a)
    return u * c + v * s, v * c - u * s


def test_winds(source):
    out = plan.convert(source, ["WIND10", "WIND_DIR10", "U10", "V10"], end="2023-02-12")
    got = {k: rows(v) for k, v in out.items()}
    for j in range(7):
        for i in range(9):
            u, v = rotated(j, i)
            at = ("2023-02-12 00:00:00", 10.0, j, i)
            want = {"u_wind": u, "v_wind": v, "wind_speed": math.hypot(u, v), "wind_direction": (270 - math.degrees(math.atan2(v, u))) % 360}
            for name, x in want.items():
                assert got[name][at] == pytest.approx(x, abs=1e-3)


def test_slp(source):
    got = rows(plan.convert(source, "mslp", end="2023-02-12")["mslp"])
    t2, hgt = 280 + 0.2, 100.0
    assert got["2023-02-12 00:00:00", 0.0, 2, 4] == pytest.approx(100040 * math.exp(9.81 * hgt / (287.05 * (t2 + 0.0065 * hgt / 2))), rel=1e-6)


def test_levels(source):
    with pytest.raises(ValueError, match="target_levels"):
        plan.convert(source, "T")
    out = plan.convert(source, ["air_temp", "specific_humidity", "wind_speed", "u_wind"], end="2023-02-12", target_levels=[500, 100, 9999])
    got = {k: rows(v) for k, v in out.items()}
    at = lambda h: ("2023-02-12 00:00:00", float(h), 2, 4)
    # Mass levels lie at 100, 300, 500, ... metres.
    assert {k[1] for k in got["air_temp"]} == {2.0, 100.0, 500.0, 9999.0}
    for h, k in ((100, 0), (500, 2)):
        t = (300 + k * 2.0 - 10) * ((100000 - k * 5000 + k * 10) / 100000) ** 0.2854
        assert got["air_temp"][at(h)] == pytest.approx(t, abs=1e-3)
        w = 0.01 - k * 0.001
        assert got["specific_humidity"][at(h)] == pytest.approx(w / (1 + w), abs=1e-6)
        a = math.radians(4 * 2.0 - 2)
        u, v = 4.5 + k, 5.0 - k
        ue, ve = u * math.cos(a) + v * math.sin(a), v * math.cos(a) - u * math.sin(a)
        assert got["u_wind"][at(h)] == pytest.approx(ue, abs=1e-4) and got["wind_speed"][at(h)] == pytest.approx(math.hypot(ue, ve), abs=1e-4)
    assert got["air_temp"][at(9999)] is None and got["air_temp"][at(2)] == pytest.approx(280.2, abs=1e-3)


def test_heights_above_ground(source):
    got = rows(plan.convert(source, "T", end="2023-02-12", target_levels=[100], above_ground=True)["air_temp"])
    sea = rows(plan.convert(source, "T", end="2023-02-12", target_levels=[200], above_ground=False)["air_temp"])
    assert got["2023-02-12 00:00:00", 100.0, 2, 0] == pytest.approx(sea["2023-02-12 00:00:00", 200.0, 2, 0])


def test_height_collision(source):
    """At a height that both keys write the later key's slab stands, nulls too."""
    out = rows(plan.convert(source, ["T2", "T"], end="2023-02-12", target_levels=[2, 100])["air_temp"])
    assert out["2023-02-12 00:00:00", 2.0, 0, 0] is None
    out = rows(plan.convert(source, ["T", "T2"], end="2023-02-12", target_levels=[2, 100])["air_temp"])
    assert out["2023-02-12 00:00:00", 2.0, 0, 0] == pytest.approx(280)


def test_box(source):
    x, y = source.axes
    lon0, lat0 = source.projection.inverse(x[3], y[2])
    lon1, lat1 = source.projection.inverse(x[5], y[4])
    box = (lon0 - 0.05, lat0 - 0.05, lon1 + 0.05, lat1 + 0.05)
    out = plan.convert(source, ["T2", "WIND10"], bbox_degrees=box, end="2023-02-12")
    cells = {k[2:] for k in rows(out["air_temp"])}
    assert cells == {(j, i) for j in (2, 3, 4) for i in (3, 4, 5)}
    deep = plan.convert(source, "u_wind", bbox_degrees=box, end="2023-02-12", target_levels=[100])
    whole = rows(plan.convert(source, "u_wind", end="2023-02-12", target_levels=[100])["u_wind"])
    part = rows(deep["u_wind"])
    assert len(part) == 18 and all(whole[k] == v for k, v in part.items())
    text = plan.convert(source, "T2", bbox_degrees=box)["air_temp"]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(j,2)" in text and "ReadSchema" in text and "TSK" not in text
    with pytest.raises(ValueError, match="does not overlap"):
        plan.convert(source, "T2", bbox_degrees=(0, 0, 1, 1))


def test_no_step_selected(source):
    assert plan.convert(source, "T2", start="2030-01-01")["air_temp"].count() == 0


def test_overlapping_files_first_wins(spark, tmp_path):
    synth.write_file(spark, f"{tmp_path}/a", steps=2, first=0)
    synth.write_file(spark, f"{tmp_path}/b", steps=3, first=100)
    got = rows(plan.convert(ModelSource(spark, [f"{tmp_path}/b", f"{tmp_path}/a"]), "T2")["air_temp"])
    assert [got[f"2023-02-12 0{t}:00:00", 2.0, 0, 0] for t in range(3)] == [280, 281, 382]


def test_two_inputs_of_one_name(spark, tmp_path):
    """Whole paths tell files apart, also with a space or a plus in them."""
    synth.write_file(spark, f"{tmp_path}/a b/out", steps=2, first=0)
    synth.write_file(spark, f"{tmp_path}/a+c/out", start="2023-02-12 02:00:00", steps=2, first=100)
    source = ModelSource(spark, [f"{tmp_path}/a b/out", f"{tmp_path}/a+c/out"])
    out = plan.convert(source, "T2")["air_temp"]
    got = rows(out)
    assert out.count() == len(got) == 4 * 63
    assert [got[f"2023-02-12 0{t}:00:00", 2.0, 0, 0] for t in range(4)] == [280, 281, 380, 381]


def test_time_range_reaches_the_scan(source):
    """Files without a step of the range aren't opened; t_idx has literal bounds."""
    for name, bounds in (("T2", [(0, 1)]), ("precip", [(3, 3), (0, 1)])):
        (df,) = plan.convert(source, name, start="2023-02-12T04:00", end="2023-02-12T05:00").values()
        text = df._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in text.splitlines() if "FileScan" in x and "surface" in x]
        assert len(scans) == len(bounds)  # a file each, with its own steps
        for scan, (lo, hi) in zip(scans, bounds, strict=True):
            assert f"(t_idx,{hi})" in scan and ("erThanOrEqual" in scan or lo == hi)
        assert all("InMemoryFileIndex(1 paths)" in scan for scan in scans)
        assert len(rows(df)) == 2 * 63


def test_locate(source):
    from skylattice.operators import timeaxis

    assert timeaxis.locate_one(source.axis, 5) == (source.steps[5].file, 1)
    for bad in (8, -1):
        with pytest.raises(IndexError):
            timeaxis.locate_one(source.axis, bad)


def test_without_rotation(spark, tmp_path):
    synth.write_file(spark, f"{tmp_path}/a", steps=1, rotation=False)
    got = rows(plan.convert(ModelSource(spark, f"{tmp_path}/a"), "U10")["u_wind"])
    assert got["2023-02-12 00:00:00", 10.0, 0, 5] == 8


def test_write_and_read(spark, source, tmp_path):
    out = f"{tmp_path}/cube"
    for _ in range(2):  # the second replaces the first
        plan.write(source, out, ["T2", "precip"], chunk_shape=(2, 1, 4, 4), packing={"air_temp": (2, -61)})
    meta = sink.read_meta(spark, out)
    assert meta["chunk_shape"] == [2, 1, 4, 4] and meta["projection"]["kind"] == "lcc" and meta["dataset_type"] == "grid"
    assert meta["variables"]["air_temperature"]["units"] == "K"
    back = sink.read_variable(spark, out, "air_temperature")
    want = rows(plan.convert(source, "T2")["air_temp"])
    got = {(str(r.time), r.height, r.j, r.i): r.air_temperature for r in back.collect()}
    assert {*got} == {*want} and all(abs(got[k] - v) < 0.02 for k, v in want.items())
    assert sink.read_coordinate(spark, out, "time").count() == 8
    field = sink.read_variable(spark, out, "precipitation").schema["precipitation"]
    assert field.metadata["standard_name"] == "precipitation_amount"
    assert sink.read_projection(spark, out) == source.projection
    with pytest.raises(ValueError, match="chunk_shape"):
        plan.write(source, out, "T2", chunk_shape=(1, 1))


def test_command_line(spark, files, tmp_path, capsys):
    for k, token in enumerate(([], ["wrf"])):
        out = f"{tmp_path}/c{k}"
        assert cli.main([*token, *files, out, "-v", "air_temp, wind_speed", "-s", "2023-02-12T01:00", "-e", "2023-02-12T02:00", "-l", "100, 500", "-c", "1,1,5,5"], spark) == 0
        assert sink.read_variable(spark, out, "air_temperature").select(F.countDistinct("time"), F.countDistinct("height")).collect()[0] == (2, 3)
        assert sink.read_meta(spark, out)["chunk_shape"] == [1, 1, 5, 5]
    with pytest.raises(FileNotFoundError):
        cli.main([f"{tmp_path}/none", f"{tmp_path}/out"], spark)
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    with pytest.raises(SystemExit):
        cli.main([files[0]])
    capsys.readouterr()


def test_unknown_transform(source):
    from skylattice.catalog import Variable

    r = plan.request(source, ["T2"])
    for f, args in ((plan._surface, ()), (plan._on_levels, ([1.0],))):
        with pytest.raises(ValueError, match="Unknown transform"):
            f(r, Variable("X", "x", ("T2",), "nothing", 0.0), *args)


def test_hdf5_needs_its_library(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        from skylattice.sources import hdf5

        with pytest.raises(ImportError, match="h5py"):
            hdf5.to_tables(spark, ["x.nc"], "out", ["T2"])
