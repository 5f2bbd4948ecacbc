"""Names, attributes, projections, axes and boxes: driver-side parts."""

import math

import numpy as np
import pytest

from skylattice import catalog
from skylattice.catalog import CATALOGUE
from skylattice.functions.projection import SPHERE, Ellipsoid, Projection, from_attributes
from skylattice.functions.text import attribute, split_list
from skylattice.operators import bbox, merge, resolve

ATTRS = {"MAP_PROJ": 1, "TRUELAT1": -30.0, "TRUELAT2": -60.0, "STAND_LON": 173.0, "CEN_LAT": -41.0, "CEN_LON": 173.0, "DX": 27000.0, "DY": 27000.0, "WEST-EAST_PATCH_START_UNSTAG": 1, "WEST-EAST_PATCH_END_UNSTAG": 99, "SOUTH-NORTH_PATCH_START_UNSTAG": 1, "SOUTH-NORTH_PATCH_END_UNSTAG": 111}


@pytest.mark.parametrize("value,plain", [(np.array([42.5]), 42.5), (np.array([3], np.int32), 3), (b"hello", "hello"), (7, 7), ([5], 5)])
def test_attribute(value, plain):
    assert attribute(value) == plain


@pytest.mark.parametrize("names,keys", [
    ("air_temp", ["T2", "T"]), ("RAINC", ["RAIN"]), (["precip", "wind_speed"], ["RAIN", "WIND10", "WIND"]), (["T2", "air_temp"], ["T2", "T"]), ("U10", ["U10"]),
    ("HGT", ["SLP"]), ("P", ["T"]), ("PB", ["T"]), ("PH", ["Q"]), ("QVAPOR", ["Q"]), (None, list(CATALOGUE)), ([], []),
])
def test_resolve(names, keys):
    assert resolve.resolve(names, CATALOGUE) == keys


def test_resolve_unknown_and_unavailable():
    with pytest.raises(ValueError, match="Unknown variable"):
        resolve.resolve(["T2", "nothing"], CATALOGUE)
    have = catalog.available({"T2", "PSFC"})
    assert list(have) == ["T2", "PSFC"]
    with pytest.raises(ValueError, match="Unknown variable"):
        resolve.resolve("RAIN", have)


@pytest.mark.parametrize("levels", [None, []])
def test_levels_needed(levels):
    with pytest.raises(ValueError, match="target_levels"):
        resolve.check_levels(["T2", "T"], CATALOGUE, levels)
    resolve.check_levels(["T2"], CATALOGUE, levels)


def test_templates():
    assert catalog.stored_name("air_temp") == "air_temperature" and catalog.stored_name("mslp") == "mslp"
    assert catalog.attributes("snow_depth") == {"standard_name": "surface_snow_thickness", "units": "m"}
    with pytest.raises(TypeError):
        catalog.attributes("nothing")
    assert len(CATALOGUE) == 19 and len({v.out for v in CATALOGUE.values()}) == 13


def test_merge_plan():
    assert merge.group_keys(["T2", "WIND10", "T", "WIND"], CATALOGUE) == {"air_temp": ["T2", "T"], "wind_speed": ["WIND10", "WIND"]}
    assert merge.heights_of(["T2", "TSK", "T"], CATALOGUE, [500, 100, 100]) == [0, 2, 100, 500]
    assert merge.winners(["T2", "T"], CATALOGUE, [2, 100]) == {"T2": [], "T": [2, 100]}
    assert merge.winners(["T", "T2"], CATALOGUE, [2, 100]) == {"T": [100], "T2": [2]}


FEET = 0.3048006096012192


def degrees(d, m=0):
    return d + m / 60


def test_published_examples():
    """Worked examples of EPSG guidance note 7-2."""
    texas = Projection("lcc", degrees(28, 23), degrees(30, 17), degrees(27, 50), -99.0, Ellipsoid(6378206.4, 294.97870))
    x, y = texas.forward(-96.0, 28.5)
    assert x / FEET + 2_000_000 == pytest.approx(2963503.91, abs=0.02) and y / FEET == pytest.approx(254759.80, abs=0.02)
    polar = Projection("polar", -71.0, 0, -90.0, 70.0)
    x, y = polar.forward(120.0, -75.0)
    assert (x + 6e6, y + 6e6) == pytest.approx((7255380.79, 7053389.56), abs=0.02)
    caspian = Projection("mercator", 42.0, 0, 0, 51.0, Ellipsoid(6378245.0, 298.3))
    assert caspian.forward(53.0, 53.0) == pytest.approx((165704.29, 5171848.07), abs=0.02)


@pytest.mark.parametrize("p", [
    Projection("lcc", -30, -60, -41, 173), Projection("lcc", 45, 45, 45, 10), Projection("lcc", 30, 60, 40, -97, SPHERE), Projection("polar", -71, 0, -90, 170),
    Projection("polar", 60, 0, 90, -100), Projection("polar", 90, 0, 90, 0), Projection("mercator", 20, 0, 0, 30), Projection("latlon"),
])
def test_there_and_back(p):
    south = p.lat_0 < 0
    for lon, lat in ((p.lon_0 + 5, -50.0 if south else 50.0), (p.lon_0 - 20, -70.0 if south else 70.0), (p.lon_0, -45.0 if south else 45.0)):
        assert p.inverse(*p.forward(lon, lat)) == pytest.approx((lon, lat), abs=1e-8)


def test_columns_as_numbers(spark):
    for p in (Projection("lcc", -30, -60, -41, 173), Projection("polar", -71, 0, -90, 170), Projection("mercator", 20, 0, 0, 30), Projection("latlon")):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(170.0, -40.0)], "lon double, lat double")
        assert tuple(df.select(*p.forward(F.col("lon"), F.col("lat"))).collect()[0]) == pytest.approx(p.forward(170.0, -40.0), rel=1e-12)


@pytest.mark.parametrize("kind,name", [(1, "lcc"), (2, "polar"), (3, "mercator"), (6, "latlon")])
def test_projection_of_attributes(kind, name):
    assert from_attributes(ATTRS | {"MAP_PROJ": kind}).kind == name


def test_unsupported_projection():
    with pytest.raises(ValueError, match="Unsupported MAP_PROJ"):
        from_attributes({"MAP_PROJ": 4})


def test_axes_and_boxes():
    p = from_attributes(ATTRS)
    x, y = bbox.axes(ATTRS, p)
    assert (len(x), len(y)) == (99, 111) and x[1] - x[0] == pytest.approx(27000) and x[49] == pytest.approx(0, abs=1e-6)
    west, south, east, north = bbox.geographic(p, x, y)
    assert west < 173 < east and south < -41 < north
    j0, j1, i0, i1 = bbox.to_indices(p, (172, -42, 174, -40), x, y)
    for i in (i0, i1):
        assert abs(x[i]) < 100_000
    assert bbox.to_indices(p, (west, south, east, north), x, y) == (0, 110, 0, 98)
    with pytest.raises(ValueError, match="does not overlap"):
        bbox.to_indices(p, (0, 0, 1, 1), x, y)
    with pytest.raises(ValueError, match="180"):
        bbox.to_indices(p, (170, -42, -170, -40), x, y)


def test_latlon_axes():
    assert bbox.axes({"MAP_PROJ": 6}, Projection("latlon"), [1, 2], [3, 4]) == ([1, 2], [3, 4])


def test_split_list():
    assert split_list("a, b") == ["a", "b"] and split_list("1,2.5", float) == [1, 2.5] and split_list(None) is None


def test_polar_scale_at_the_pole():
    assert Projection("polar", 90, 0, 90, 0).forward(0, 90) == pytest.approx((0, 0), abs=1e-6)
    assert math.isclose(Projection("polar", 89.9999, 0, 90, 0)._polar_scale(), Projection("polar", 90, 0, 90, 0)._polar_scale(), rel_tol=1e-6)
