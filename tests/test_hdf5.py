"""The HDF5 adapter over a stand-in for its library."""

import importlib
import os
import sys

import numpy as np
import pytest

from skylattice.plans import convert as plan
from skylattice.sources import hdf5
from skylattice.sources.model import ModelSource
from skylattice.testing.synth import ATTRS

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "stand_in")


@pytest.fixture(scope="module")
def h5py(spark):
    if importlib.util.find_spec("h5py"):
        pytest.skip("the real library is here")
    sys.path.insert(0, HERE)
    spark.sparkContext.addPyFile(os.path.join(HERE, "h5py.py"))
    yield
    sys.path.remove(HERE)
    sys.modules.pop("h5py", None)


def write(path, start, steps=2, ny=4, nx=3, nz=3, attrs=None):
    r = np.random.default_rng(1)
    j, i = np.meshgrid(np.arange(ny), np.arange(nx), indexing="ij")
    angle = np.radians(i * 10.0 + j)
    full = lambda x: np.broadcast_to(x, (steps, *x.shape)).astype(np.float32)
    times = np.array([list(f"2023-02-12_{start + k:02d}:00:00") for k in range(steps)], "S1")
    data = {
        "Times": times, "T2": full(280 + j * 1.0), "U10": full(i + 1.0), "V10": full(j * 2.0), "COSALPHA": full(np.cos(angle)), "SINALPHA": full(np.sin(angle)),
        "XLONG": full(170 + i * 0.5), "XLAT": full(-45 + j * 0.25),
        "U": r.integers(0, 9, (steps, nz, ny, nx + 1)).astype(np.float32), "V": r.integers(0, 9, (steps, nz, ny + 1, nx)).astype(np.float32),
        "PH": np.zeros((steps, nz + 1, ny, nx), np.float32), "PHB": np.broadcast_to((np.arange(nz + 1) * 981.0)[None, :, None, None], (steps, nz + 1, ny, nx)).astype(np.float32),
    }
    own = ATTRS | {"WEST-EAST_PATCH_START_UNSTAG": "1", "WEST-EAST_PATCH_END_UNSTAG": str(nx), "SOUTH-NORTH_PATCH_START_UNSTAG": "1", "SOUTH-NORTH_PATCH_END_UNSTAG": str(ny)} | (attrs or {})
    os.makedirs(os.path.dirname(path))
    np.savez(path, **data, **{f"attr:{k}": np.array([int(v) if v.lstrip("-").isdigit() else float(v)]) for k, v in own.items()})
    return data


def test_winds_from_files_are_rotated(spark, h5py, tmp_path, monkeypatch):
    """Two files of one name; rotation and staggering survive the way through tables."""
    monkeypatch.setattr(hdf5, "ROWS_AT_ONCE", 3)
    data = write(f"{tmp_path}/a/out.npz", 0)
    write(f"{tmp_path}/b/out.npz", 2)
    out = f"{tmp_path}/tables"
    hdf5.to_tables(spark, [f"{tmp_path}/b/out.npz", f"{tmp_path}/a/out.npz"], out, ["T2", "U10", "V10", "U", "V", "PH", "PHB"])
    s = ModelSource(spark, sorted(f"{out}/{n}" for n in os.listdir(out)))
    assert len(s.steps) == 4 and s.rotation is not None and float(s.attrs["DX"]) == 27000
    cube = plan.convert(s, ["u_wind"], target_levels=[150])["u_wind"]
    got = {(str(r.time)[11:13], r.height, r.j, r.i): r.value for r in cube.collect()}
    assert len(got) == 4 * 2 * 12
    c, n = data["COSALPHA"][0], data["SINALPHA"][0]
    u, v = data["U"][:, 1], data["V"][:, 1]
    u, v = (u[..., 1:] + u[..., :-1]) / 2, (v[:, 1:] + v[:, :-1]) / 2
    for t in (0, 1):
        for j in range(4):
            for i in range(3):
                assert got[f"0{t}", 10.0, j, i] == pytest.approx((i + 1) * c[j, i] + 2 * j * n[j, i], abs=1e-5)
                assert got[f"0{t}", 150.0, j, i] == got[f"0{t + 2}", 150.0, j, i] == pytest.approx(u[t, j, i] * c[j, i] + v[t, j, i] * n[j, i], abs=1e-5)


def test_grids_in_degrees(spark, h5py, tmp_path):
    write(f"{tmp_path}/c/out.npz", 0, attrs={"MAP_PROJ": "6"})
    hdf5.to_tables(spark, [f"{tmp_path}/c/out.npz"], f"{tmp_path}/tables", ["T2"])
    s = ModelSource(spark, f"{tmp_path}/tables/000000-out.npz")
    assert s.axes == ([170.0, 170.5, 171.0], [-45.0, -44.75, -44.5, -44.25])
    assert plan.convert(s, "T2", bbox_degrees=(170.4, -45, 172, -44.7))["air_temp"].count() == 2 * 2 * 2
