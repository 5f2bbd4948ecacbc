"""The catalogue of variables that model history files can give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Variable:
    """A catalogue entry: what it reads, how it is derived and what it is called.

    ``height`` is in metres; None means that values are interpolated to levels.
    """

    key: str
    out: str
    sources: tuple[str, ...]
    transform: str | None
    height: float | None

    @property
    def on_levels(self) -> bool:
        return self.height is None


def _catalogue(*rows: tuple) -> dict[str, Variable]:
    return {r[0]: Variable(*r) for r in rows}


# Keys, output names, sources, transforms and heights of the data
# model, in its order (which decides between keys of one name).
CATALOGUE = _catalogue(
    ("T2", "air_temp", ("T2",), None, 2.0),
    ("PSFC", "surface_pressure", ("PSFC",), None, 0.0),
    ("Q2", "specific_humidity", ("Q2",), None, 2.0),
    ("RAIN", "precip", ("RAINNC", "RAINC"), "accumulation_increment", 0.0),
    ("WIND10", "wind_speed", ("U10", "V10"), "wind_speed", 10.0),
    ("WIND_DIR10", "wind_direction", ("U10", "V10"), "wind_direction", 10.0),
    ("TSK", "soil_temp", ("TSK",), None, 0.0),
    ("SWDOWN", "shortwave_radiation", ("SWDOWN",), None, 0.0),
    ("GLW", "longwave_radiation", ("GLW",), None, 0.0),
    ("SNOWH", "snow_depth", ("SNOWH",), None, 0.0),
    ("T", "air_temp", ("T", "P", "PB", "PH", "PHB"), "potential_to_actual_temp", None),
    ("WIND", "wind_speed", ("U", "V", "PH", "PHB"), "wind_speed_3d", None),
    ("WIND_DIR", "wind_direction", ("U", "V", "PH", "PHB"), "wind_direction_3d", None),
    ("U10", "u_wind", ("U10", "V10"), "u_wind", 10.0),
    ("V10", "v_wind", ("U10", "V10"), "v_wind", 10.0),
    ("U", "u_wind", ("U", "V", "PH", "PHB"), "u_wind_3d", None),
    ("V", "v_wind", ("U", "V", "PH", "PHB"), "v_wind_3d", None),
    ("Q", "specific_humidity", ("QVAPOR", "PH", "PHB"), "mixing_ratio_to_specific_humidity", None),
    ("SLP", "mslp", ("PSFC", "T2", "HGT"), "sea_level_pressure", 0.0),
)

# Names under which variables are stored, and CF attributes.
STORED_NAME = {"air_temp": "air_temperature", "precip": "precipitation"}
CF_ATTRIBUTES = {
    "air_temp": {"standard_name": "air_temperature", "units": "K"},
    "surface_pressure": {"standard_name": "surface_air_pressure", "units": "Pa"},
    "specific_humidity": {"standard_name": "specific_humidity", "units": "kg kg-1"},
    "precip": {"standard_name": "precipitation_amount", "units": "mm"},
    "wind_speed": {"standard_name": "wind_speed", "units": "m/s"},
    "wind_direction": {"standard_name": "wind_from_direction", "units": "deg"},
    "soil_temp": {"standard_name": "soil_temperature", "units": "K"},
    "shortwave_radiation": {"standard_name": "surface_downwelling_shortwave_flux_in_air", "units": "W m-2"},
    "longwave_radiation": {"standard_name": "surface_downwelling_longwave_flux_in_air", "units": "W m-2"},
    "snow_depth": {"standard_name": "surface_snow_thickness", "units": "m"},
    "u_wind": {"standard_name": "eastward_wind", "units": "m/s"},
    "v_wind": {"standard_name": "northward_wind", "units": "m/s"},
    "mslp": {"standard_name": "air_pressure_at_mean_sea_level", "units": "Pa"},
}


def stored_name(out: str) -> str:
    return STORED_NAME.get(out, out)


def attributes(out: str) -> dict[str, str]:
    """CF attributes of an output name; a name without a template is a TypeError."""
    if out not in CF_ATTRIBUTES:
        raise TypeError(f"no output template for {out!r}")
    return CF_ATTRIBUTES[out]


def available(columns: set[str], catalogue: dict[str, Variable] = CATALOGUE) -> dict[str, Variable]:
    """The entries all of whose sources are among ``columns``, in catalogue order."""
    return {k: v for k, v in catalogue.items() if columns.issuperset(v.sources)}


def as_frame(spark: SparkSession, catalogue: dict[str, Variable] = CATALOGUE) -> DataFrame:
    """The catalogue as rows, for relational name resolution."""
    rows = [(i, v.key, v.out, list(v.sources), v.transform, v.height) for i, v in enumerate(catalogue.values())]
    return spark.createDataFrame(rows, "pos int, key string, out_name string, source_vars array<string>, transform string, height double")
