"""Synthetic model files with values in closed form."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ATTRS = {
    "MAP_PROJ": "1", "TRUELAT1": "-30.0", "TRUELAT2": "-60.0", "STAND_LON": "173.0", "CEN_LAT": "-41.0", "CEN_LON": "173.0", "DX": "27000.0", "DY": "27000.0",
}


def write_file(spark: SparkSession, path: str, start: str = "2023-02-12 00:00:00", steps: int = 4, nx: int = 9, ny: int = 7, nz: int = 5, rotation: bool = True, attrs: dict | None = None, first: int = 0) -> None:
    """A file of hourly steps.  ``first`` is the number of steps before it, from
    which accumulated rain goes on."""
    own = ATTRS | {"WEST-EAST_PATCH_START_UNSTAG": "1", "WEST-EAST_PATCH_END_UNSTAG": str(nx), "SOUTH-NORTH_PATCH_START_UNSTAG": "1", "SOUTH-NORTH_PATCH_END_UNSTAG": str(ny)} | (attrs or {})
    spark.createDataFrame([*own.items()], "name string, value string").write.parquet(f"{path}/attrs.parquet")
    steps_df = spark.range(steps).select(F.col("id").cast("int").alias("t_idx"))
    time = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("t_idx"))
    steps_df.select("t_idx", F.date_format(time, "yyyy-MM-dd_HH:mm:ss").alias("text")).write.parquet(f"{path}/times.parquet")

    def cells(cols: int, rows: int, i: str = "i", j: str = "j"):
        n = cols * rows
        c = F.col("id") % n
        return spark.range(steps * n).select((F.col("id") / n).cast("int").alias("t_idx"), (c / cols).cast("int").alias(j), (c % cols).cast("int").alias(i))

    def column(f, n: int):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: f(k).cast("float"))

    t, i, j = F.col("t_idx") + first, F.col("i"), F.col("j")
    plain = {
        "T2": 280 + t + j * 0.1, "PSFC": 100000 + 10 * i, "Q2": 0.005 + j * 0.0001, "TSK": 281 + t, "SWDOWN": 100.0 * t, "GLW": 300.0 + i, "SNOWH": j * 0.01,
        "RAINNC": t * t * 0.5 + i, "RAINC": t * 0.25, "U10": 3.0 + i, "V10": 4.0 - j, "HGT": 50.0 * j,
    }
    cells(nx, ny).select("t_idx", "j", "i", *(c.cast("float").alias(n) for n, c in plain.items())).write.parquet(f"{path}/surface.parquet")
    mass = {
        "T": column(lambda k: k * 2.0 - 10, nz), "P": column(lambda k: k * 10.0, nz), "PB": column(lambda k: 100000 - k * 5000.0, nz), "QVAPOR": column(lambda k: 0.01 - k * 0.001, nz),
        "PH": column(lambda k: k * 0.0, nz + 1), "PHB": column(lambda k: k * 200 * 9.81, nz + 1),
    }
    cells(nx, ny).select("t_idx", "j", "i", *(c.alias(n) for n, c in mass.items())).write.parquet(f"{path}/columns3d.parquet")
    cells(nx + 1, ny, i="i_stag").select("t_idx", "j", "i_stag", column(lambda k: F.col("i_stag") + k, nz).alias("U")).write.parquet(f"{path}/u_stag.parquet")
    cells(nx, ny + 1, j="j_stag").select("t_idx", "j_stag", "i", column(lambda k: F.col("j_stag") * 2 - k, nz).alias("V")).write.parquet(f"{path}/v_stag.parquet")
    if rotation:
        angle = F.radians(i * 2.0 - j)
        cells(nx, ny).filter("t_idx = 0").select("j", "i", F.cos(angle).cast("float").alias("COSALPHA"), F.sin(angle).cast("float").alias("SINALPHA")).write.parquet(f"{path}/grid.parquet")
