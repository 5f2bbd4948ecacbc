"""Chunked files read where they lie: planning, bounds, chunk reads, means at edges."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.plans import convert as plan
from skylattice.sources import history
from skylattice.sources.history import HistorySource
from skylattice.testing import chunked
from skylattice.testing.synth import ATTRS

LIBRARY = "skylattice.testing.chunked"
NT, NZ, NY, NX = 4, 3, 7, 10
CHUNKS = {3: (2, 3, 4), 4: (1, 2, 3, 4)}


def write(path, start=0, drop=(), **change):
    r = np.random.default_rng(start)
    number = lambda *shape: r.integers(-99, 99, shape).astype(np.float32)
    j, i = np.meshgrid(np.arange(NY), np.arange(NX), indexing="ij")
    data = {
        "T2": number(NT, NY, NX), "U10": number(NT, NY, NX), "V10": number(NT, NY, NX), "T": number(NT, NZ, NY, NX), "P": number(NT, NZ, NY, NX), "PB": number(NT, NZ, NY, NX) + 1e5,
        "U": number(NT, NZ, NY, NX + 1), "V": number(NT, NZ, NY + 1, NX), "PH": np.zeros((NT, NZ + 1, NY, NX), np.float32),
        "PHB": np.broadcast_to((np.arange(NZ + 1) * 981.0)[None, :, None, None], (NT, NZ + 1, NY, NX)).astype(np.float32),
        "COSALPHA": np.broadcast_to(np.cos(i * 0.1 + j), (NT, NY, NX)).astype(np.float32), "SINALPHA": np.broadcast_to(np.sin(i * 0.1 + j), (NT, NY, NX)).astype(np.float32),
    }
    data = {k: v for k, v in (data | change).items() if k not in drop}
    times = np.array([list(f"2023-02-12_{start + k:02d}:00:00") for k in range(NT)], "S1")
    chunks = {k: CHUNKS[v.ndim] for k, v in data.items()} | {"Times": (NT, 19)}
    attrs = ATTRS | {"WEST-EAST_PATCH_START_UNSTAG": "1", "WEST-EAST_PATCH_END_UNSTAG": str(NX), "SOUTH-NORTH_PATCH_START_UNSTAG": "1", "SOUTH-NORTH_PATCH_END_UNSTAG": str(NY)}
    chunked.write_file(str(path), data | {"Times": times}, chunks, attrs)
    os.makedirs(f"{path}/reads")
    return data


def reads(path):
    """Chunks read since the last call."""
    out = [n.rsplit("-", 1)[0] for n in os.listdir(f"{path}/reads") if not n.startswith("Times")]
    for n in os.listdir(f"{path}/reads"):
        os.remove(f"{path}/reads/{n}")
    return sorted(out)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("history")
    return [f"{base}/a", f"{base}/b"], [write(f"{base}/a"), write(f"{base}/b", NT)]


@pytest.mark.parametrize("max_mem", [1, 400, 5000, 2**27])
def test_all_cells_once_and_each_chunk_once(spark, files, max_mem):
    (path, _), (data, _) = files
    reads(path)
    rows = history.read(spark, [path], "surface", ["T2", "V10"], max_mem, LIBRARY).collect()
    assert len(rows) == NT * NY * NX and all(r.T2 == data["T2"][r.t_idx, r.j, r.i] and r.V10 == data["V10"][r.t_idx, r.j, r.i] and r.file == 0 for r in rows)
    chunks = 2 * 3 * 3 * 2
    found = reads(path)
    assert len(found) == len({*found}) == chunks
    assert len({(r.t_idx, r.j, r.i) for r in rows}) == len(rows)


def test_bounds_open_only_their_chunks(spark, files):
    (path, _), (data, _) = files
    reads(path)
    df = history.read(spark, [path], "columns3d", ["T"], 1, LIBRARY)
    rows = df.filter(F.col("t_idx").between(1, 2) & (F.col("j") > 3) & (F.col("j") < 6) & (F.col("i") == 8)).collect()
    assert {(r.t_idx, r.j, r.i) for r in rows} == {(t, j, 8) for t in (1, 2) for j in (4, 5)}
    assert all(r["T"] == data["T"][r.t_idx, :, r.j, r.i].tolist() for r in rows)
    assert reads(path) == sorted(f"T-{t}.{z}.1.2" for t in (1, 2) for z in (0, 1))
    assert df.filter("j > 99").count() == 0 and reads(path) == []
    odd = df.filter("j % 2 = 0 AND t_idx IN (0, 3) AND size(T) = 3")
    assert odd.count() == 2 * 4 * NX


def test_partitions_fit_the_memory(files):
    (path, _), _ = files
    reader = history.Reader({"paths": json.dumps([path]), "table": "surface", "variables": "T2", "library": LIBRARY, "max_mem": str(2 * 3 * 8 * 4)})
    boxes = reader.partitions()
    assert all((b.t[1] - b.t[0]) * (b.j[1] - b.j[0]) * (b.i[1] - b.i[0]) <= 48 for b in boxes) and len(boxes) == 2 * 3 * 2
    assert all(b.t[0] % 2 == b.j[0] % 3 == b.i[0] % 4 == 0 for b in boxes)


@pytest.mark.parametrize("max_mem", [1, 2**27])
def test_edges_come_out_at_middles(spark, files, max_mem):
    (path, _), (data, _) = files
    rows = history.read(spark, [path], "columns3d", ["U", "V"], max_mem, LIBRARY).collect()
    u, v = (data["U"][..., 1:] + data["U"][..., :-1]) / 2, (data["V"][:, :, 1:] + data["V"][:, :, :-1]) / 2
    assert len(rows) == NT * NY * NX
    assert all(r.U == u[r.t_idx, :, r.j, r.i].tolist() and r.V == v[r.t_idx, :, r.j, r.i].tolist() for r in rows)


def test_conversion_without_a_shuffle(spark, files):
    paths, data = files
    s = HistorySource(spark, paths, library=LIBRARY)
    assert len(s.steps) == 2 * NT and s.rotation is not None and float(s.attrs["DX"]) == 27000
    assert "SLP" not in s.variables and "WIND" in s.variables
    cube = plan.convert(s, ["u_wind", "v_wind", "air_temp"], target_levels=[150], start="2023-02-12T03:00", end="2023-02-12T05:00")
    rows = {(r.time.hour, r.height, r.j, r.i): r.value for r in cube["u_wind"].collect()}
    text = cube["u_wind"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    assert len(rows) == 3 * 2 * NY * NX
    for (hour, height, j, i), value in rows.items():
        own, t = data[hour // NT], hour % NT
        c, n = own["COSALPHA"][0, j, i], own["SINALPHA"][0, j, i]
        if height == 10:
            want = own["U10"][t, j, i] * c + own["V10"][t, j, i] * n
        else:  # the middle level lies at 150 m
            u, v = own["U"][t, 1, j, i : i + 2].mean(), own["V"][t, 1, j : j + 2, i].mean()
            want = u * c + v * n
        assert value == pytest.approx(want, abs=1e-3)


def test_files_that_differ(spark, tmp_path):
    write(tmp_path / "a")
    write(tmp_path / "b", NT, drop=("T2",))
    write(tmp_path / "c", 2 * NT, U10=np.zeros((NT, NY, NX), np.float64))
    s = HistorySource(spark, [str(tmp_path / x) for x in "abc"], library=LIBRARY)
    with pytest.raises(KeyError, match="b has no variable .T2"):
        plan.convert(s, "T2")
    with pytest.raises(TypeError, match="c has .U10"):
        plan.convert(s, "U10")
    assert plan.convert(s, "T2", end="2023-02-12T03:00")["air_temp"].count() == NT * NY * NX
    with pytest.raises(Exception, match="no variable"):
        history.read(spark, s.input_paths, "surface", ["T2"], library=LIBRARY).count()


def test_two_steps_across_two_files_read_two_steps(spark, files):
    paths, _ = files
    s = HistorySource(spark, paths, library=LIBRARY)
    for p in paths:
        reads(p)
    assert plan.convert(s, "T2", start="2023-02-12T03:00", end="2023-02-12T04:00")["air_temp"].count() == 2 * NY * NX
    assert {n.split("-")[1][0] for n in reads(paths[0])} == {"1"} and {n.split("-")[1][0] for n in reads(paths[1])} == {"0"}
