"""Queries over the driver's tables, one for each operator, and the SQL that
gives the same rows.  The operators don't know these tables; here orders, events
and embeddings stand in for steps, cells and model columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions import text as text_functions
from ..functions.projection import Ellipsoid, Projection, from_attributes
from ..operators import accum, bbox, derive, levels, merge, packing, resolve, stagger, timeaxis, wind
from ..session import broadcast_if_small, staged

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        _QUERIES[name] = f
        _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(rows: list[tuple]) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else "[" + ", ".join(map(lit, x)) + "]" if isinstance(x, (list, tuple)) else str(x)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _cents():
    return F.rint(F.col("value") * 100).cast("long")

#: Rows of a task that sorts segments.
SEGMENT_ROWS = 500_000
_LEVELS = (5.0, 100.0, 333.0, 630.0, 9999.0)

# --- sources and metadata


@query("S3_time_scan", """
WITH t AS (SELECT DISTINCT event_type AS file, date_trunc('hour', ts) AS time FROM events),
f AS (SELECT file, time, row_number() OVER (PARTITION BY file ORDER BY time) - 1 AS t_idx FROM t),
a AS (SELECT time, min(file) AS file FROM f GROUP BY time)
SELECT CAST(row_number() OVER (ORDER BY time) - 1 AS BIGINT) AS g_idx, time, file, CAST(t_idx AS BIGINT) AS t_idx
FROM a JOIN f USING (time, file)
""")  # fmt: skip
def time_scan(spark, d):
    hours = _t(spark, d, "events").select(F.col("event_type").alias("file"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("time")).distinct()
    steps = hours.withColumn("t_idx", F.row_number().over(timeaxis.W.partitionBy("file").orderBy("time")) - 1)
    return timeaxis.time_axis(steps).withColumns({c: F.col(c).cast("long") for c in ("g_idx", "t_idx")})


@query("S4_availability", """
SELECT p_type AS key, list_has_all(have, [p_type, 'Brand#11']) AS usable
FROM (SELECT DISTINCT p_type FROM part), (SELECT list_concat(list(DISTINCT p_type), list(DISTINCT p_brand)) AS have FROM part WHERE p_size > 10)
""")  # fmt: skip
def availability(spark, d):
    part = _t(spark, d, "part")
    have = part.filter("p_size > 10").agg(F.concat(F.collect_set("p_type"), F.collect_set("p_brand")).alias("have"))
    keys = part.select(F.col("p_type").alias("key")).distinct()
    return keys.join(broadcast_if_small(have)).select("key", resolve.is_available(F.array("key", F.lit("Brand#11")), F.col("have")).alias("usable"))


@query("S5_attributes", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, CAST(p_size AS DOUBLE) AS size_value, lower(p_brand) AS brand FROM part")
def attribute_decode(spark, d):
    attrs = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.lower("p_brand"))
    return _t(spark, d, "part").withColumn("a", attrs).select("p_partkey", F.col("a")["size"].alias("size_text"), F.col("a")["size"].cast("double").alias("size_value"), F.col("a")["brand"].alias("brand"))


@query("S6_time", "SELECT o_orderkey, date_trunc('minute', o_orderdate + to_seconds(o_orderkey % 86400)) AS time FROM orders")
def time_decode(spark, d):
    stamp = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)
    text = F.date_format(stamp, "yyyy-MM-dd_HH:mm:ss")
    joined = text_functions.join_characters(F.split(text, ""))
    return _t(spark, d, "orders").select("o_orderkey", timeaxis.parse_times(joined).alias("time"))


@query("S7_axis", "SELECT CAST(i AS INTEGER) AS i, 1000.0::DOUBLE + (i - (n - 1) / 2.0::DOUBLE) * 27000.0::DOUBLE AS x FROM (SELECT count(*) AS n FROM nation), unnest(range(25)) AS t(i)")
def axis(spark, d):
    return bbox.axis_frame(spark, _t(spark, d, "nation").count(), 1000.0, 27000.0)


_KINDS = [(1, "lcc"), (2, "polar"), (3, "mercator"), (6, "latlon")]


@query("S8_projection_kinds", f"SELECT s_suppkey, kind, CAST(CASE WHEN kind = 'polar' THEN CASE WHEN s_acctbal > 0 THEN 90 ELSE -90 END ELSE 0 END AS DOUBLE) AS lat_0 FROM supplier JOIN (VALUES {_values(_KINDS)}) AS k(map_proj, kind) ON map_proj = [1, 2, 3, 6][s_suppkey % 4 + 1]")
def projection_kinds(spark, d):
    """Each projection's attributes, for a centre in either hemisphere."""
    made = [(k, north, p.kind, p.lat_0) for k, _ in _KINDS for north in (True, False) for p in [from_attributes({"MAP_PROJ": k, "CEN_LAT": (1 if north else -1) * (k == 2)})]]
    table = spark.createDataFrame(made, "map_proj int, north boolean, kind string, lat_0 double")
    s = _t(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, (1, 2, 3, 6))), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("map_proj"), (F.col("s_acctbal") > 0).alias("north"))
    return s.join(broadcast_if_small(table), ["map_proj", "north"]).select("s_suppkey", "kind", "lat_0")


@query("S9_static_fields", """
WITH c AS (SELECT event_type AS j, user_id AS i, min(event_id) AS first_id FROM events GROUP BY 1, 2)
SELECT j, i, value AS cosa FROM c JOIN events ON event_id = first_id
""")  # fmt: skip
def static_fields(spark, d):
    """Static fields come from the first step alone."""
    e = _t(spark, d, "events").select(F.col("event_type").alias("j"), F.col("user_id").alias("i"), "event_id", F.col("value").alias("cosa"))
    return e.groupBy("j", "i").agg(F.min_by("cosa", "event_id").alias("cosa"))


@query("S10_corners", "SELECT min(s_suppkey % 25 + 160.0::DOUBLE) AS min_lon, min(s_suppkey % 15 - 48.0::DOUBLE) AS min_lat, max(s_suppkey % 25 + 160.0::DOUBLE) AS max_lon, max(s_suppkey % 15 - 48.0::DOUBLE) AS max_lat FROM supplier")
def corners(spark, d):
    s = _t(spark, d, "supplier").select((F.col("s_suppkey") % 25 + F.lit(160.0)).alias("lon"), (F.col("s_suppkey") % 15 - F.lit(48.0)).alias("lat"))
    return bbox.bounds(s, ["lon", "lat"]).select("min_lon", "min_lat", "max_lon", "max_lat")


@query("S12_locate", """
WITH t AS (SELECT date_trunc('hour', ts) AS time, min(event_type) AS file FROM events GROUP BY 1),
g AS (SELECT row_number() OVER (ORDER BY time) - 1 AS g_idx, file, time FROM t)
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(g_idx AS BIGINT) AS g_idx, file, extract(hour FROM time) AS t_idx FROM orders JOIN g ON g_idx = o_orderkey % 1000
""")  # fmt: skip
def locate(spark, d):
    hours = _t(spark, d, "events").select(F.col("event_type").alias("file"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("time"))
    axis = timeaxis.time_axis(hours.withColumn("t_idx", F.hour("time").cast("long")).distinct())
    wanted = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("g_idx"))
    return timeaxis.locate(axis, wanted).select("o_orderkey", F.col("g_idx").cast("long").alias("g_idx"), "file", "t_idx")


# --- sinks


# What each key is stored as.
_STORED = """
T2 air_temperature air_temperature K
PSFC surface_pressure surface_air_pressure Pa
Q2 specific_humidity specific_humidity kg kg-1
RAIN precipitation precipitation_amount mm
WIND10 wind_speed wind_speed m/s
WIND_DIR10 wind_direction wind_from_direction deg
TSK soil_temp soil_temperature K
SWDOWN shortwave_radiation surface_downwelling_shortwave_flux_in_air W m-2
GLW longwave_radiation surface_downwelling_longwave_flux_in_air W m-2
SNOWH snow_depth surface_snow_thickness m
T air_temperature air_temperature K
WIND wind_speed wind_speed m/s
WIND_DIR wind_direction wind_from_direction deg
U10 u_wind eastward_wind m/s
V10 v_wind northward_wind m/s
U u_wind eastward_wind m/s
V v_wind northward_wind m/s
Q specific_humidity specific_humidity kg kg-1
SLP mslp air_pressure_at_mean_sea_level Pa
"""


@query("K4_output_names", f"SELECT * FROM (VALUES {_values([tuple(x.split(' ', 3)) for x in _STORED.strip().splitlines()])}) AS t(key, name, standard_name, units)")
def output_names(spark, d):
    names = {v.out for v in catalog.CATALOGUE.values()}
    rows = [(n, catalog.stored_name(n), *(catalog.attributes(n)[a] for a in ("standard_name", "units"))) for n in sorted(names)]
    table = spark.createDataFrame(rows, "out_name string, name string, standard_name string, units string")
    return catalog.as_frame(spark).join(broadcast_if_small(table), "out_name").select("key", "name", "standard_name", "units")


_KEYS = [x.split(" ")[0] for x in _STORED.strip().splitlines()]


@query("K4_names_of_parts", f"""SELECT p_partkey, t.key, t.name, t.standard_name, t.units FROM part
JOIN (VALUES {_values([tuple(x.split(' ', 3)) for x in _STORED.strip().splitlines()])}) AS t(key, name, standard_name, units) ON t.key = {_KEYS!r}[p_partkey % {len(_KEYS)} + 1]""")
def names_of_parts(spark, d):
    """Each row of a table asks for a key's stored name and attributes."""
    parts = _t(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("p_partkey") % len(_KEYS) + 1).cast("int")).alias("key"))
    return parts.join(broadcast_if_small(output_names(spark, d)), "key").select("p_partkey", "key", "name", "standard_name", "units")


@query("K5_chunk", "SELECT event_id, CAST(user_id // 50 AS BIGINT) AS user_id_chunk, CAST(event_id // 24 AS BIGINT) AS event_id_chunk FROM events")
def chunk(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id")
    return packing.chunked(e, {"user_id": 50, "event_id": 24}).select("event_id", "user_id_chunk", "event_id_chunk")


@query("K6_slabs", "SELECT CAST(user_id // 50 AS BIGINT) AS user_id_chunk, count(*) AS cells, CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1")
def slabs(spark, d):
    e = _t(spark, d, "events").withColumns(packing.chunk_ids({"user_id": 50}))
    return e.groupBy("user_id_chunk").agg(F.count(F.lit(1)).alias("cells"), F.sum(_cents()).alias("cents"))


@query("K8_pack", "SELECT event_id, CAST(round_even((value + 1) * 100, 0) AS INTEGER) AS packed, CAST(round_even((value + 1) * 100, 0) AS INTEGER) / 100.0::DOUBLE + -1.0::DOUBLE AS unpacked FROM events")
def pack(spark, d):
    p = packing.pack(F.col("value"), 2, -1)
    return _t(spark, d, "events").withColumn("packed", p).select("event_id", "packed", packing.unpack(F.col("packed"), 2, -1).alias("unpacked"))


# --- projections and filters

_REQUESTS = ["U10", "air_temp", "RAINC", "QVAPOR", "HGT", "air_temp", "P", "nothing", "wind_speed"]


@query("P1_resolve", """
WITH c AS (SELECT * FROM (VALUES %s) AS c(pos, key, out_name, source_vars)),
q AS (SELECT * FROM (VALUES %s) AS q("at", name)),
s AS (SELECT pos, key, unnest(source_vars) AS name FROM c),
w AS (SELECT "at", pos, key, 1 AS way FROM q JOIN c ON key = name
      UNION ALL SELECT "at", pos, key, 2 FROM q JOIN c ON out_name = name
      UNION ALL SELECT "at", max(pos), max_by(key, pos), 3 FROM q JOIN s USING (name) GROUP BY "at"),
b AS (SELECT *, min(way) OVER (PARTITION BY "at") AS best FROM w),
o AS (SELECT "at", pos, key, row_number() OVER (PARTITION BY key ORDER BY "at", pos) AS n FROM b WHERE way = best)
SELECT "at", pos, key FROM o WHERE n = 1
""" % (_values([(i, v.key, v.out, list(v.sources)) for i, v in enumerate(catalog.CATALOGUE.values())]), _values([*enumerate(_REQUESTS)])))  # fmt: skip
def resolve_names(spark, d):
    requests = spark.createDataFrame([*enumerate(_REQUESTS)], "at int, name string")
    return resolve.resolve_frame(requests, catalog.as_frame(spark))


@query("P1_resolve_orders", """
WITH c AS (SELECT * FROM (VALUES %s) AS c(pos, key, out_name, source_vars)),
q AS (SELECT o_orderkey AS "at", %r[o_orderkey %% %d + 1] AS name FROM orders),
s AS (SELECT pos, key, unnest(source_vars) AS name FROM c),
w AS (SELECT "at", pos, key, 1 AS way FROM q JOIN c ON key = name
      UNION ALL SELECT "at", pos, key, 2 FROM q JOIN c ON out_name = name
      UNION ALL SELECT "at", max(pos), max_by(key, pos), 3 FROM q JOIN s USING (name) GROUP BY "at"),
b AS (SELECT *, min(way) OVER (PARTITION BY "at") AS best FROM w),
o AS (SELECT "at", pos, key, row_number() OVER (PARTITION BY key ORDER BY "at", pos) AS n FROM b WHERE way = best)
SELECT "at", pos, key FROM o WHERE n = 1
""" % (_values([(i, v.key, v.out, list(v.sources)) for i, v in enumerate(catalog.CATALOGUE.values())]), _REQUESTS, len(_REQUESTS)))  # fmt: skip
def resolve_orders(spark, d):
    """A name for each order; each key comes at the first order that means it."""
    name = F.element_at(F.array(*map(F.lit, _REQUESTS)), (F.col("o_orderkey") % len(_REQUESTS) + 1).cast("int"))
    return resolve.resolve_frame(_t(spark, d, "orders").select(F.col("o_orderkey").alias("at"), name.alias("name")), catalog.as_frame(spark))


@query("P2_prune", "SELECT l_orderkey, l_quantity FROM lineitem")
def prune(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_quantity")


@query("P3_P4_filter", "SELECT event_id, ts, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07' AND user_id BETWEEN 10 AND 60 AND event_id BETWEEN 0 AND 100000000")
def box_and_time(spark, d):
    e = timeaxis.between_times(_t(spark, d, "events"), "2024-01-05", "2024-01-07", "ts")
    return bbox.within(e, (10, 60, 0, 100000000), j="user_id", i="event_id").select("event_id", "ts", "user_id")


@query("P5_levels_needed", "SELECT CAST(p_size AS INTEGER) AS p_size, bool_or(p_retailprice < 1000) AS needs_levels FROM part GROUP BY p_size")
def levels_needed(spark, d):
    heights = F.collect_set(F.struct(F.when(F.col("p_retailprice") >= 1000, F.col("p_retailprice")).alias("h")))
    groups = _t(spark, d, "part").groupBy("p_size").agg(heights.alias("hs"))
    return groups.select("p_size", resolve.any_on_levels(F.transform("hs", lambda x: x["h"])).alias("needs_levels"))


@query("P6_identity", "SELECT p_partkey, CAST(p_retailprice AS FLOAT) AS value FROM part")
def identity(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("float").alias("value"))


@query("P7_heights", "SELECT s_suppkey, unnest([2.0::DOUBLE, 100.0::DOUBLE, 500.0::DOUBLE]) AS height FROM supplier")
def add_heights(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, (2.0, 100.0, 500.0)))).alias("height"))


# --- joins


@query("J1_static_join", """
SELECT c_custkey, round(coalesce(cos(g.n_nationkey), 1.0), 6) AS cosa, round(coalesce(sin(g.n_nationkey), 0.0), 6) AS sina
FROM customer LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) g ON c_nationkey = g.n_nationkey
""")  # fmt: skip
def static_join(spark, d):
    grid = _t(spark, d, "nation").filter("n_nationkey < 20").select("n_nationkey", F.cos("n_nationkey").alias("cosa"), F.sin("n_nationkey").alias("sina"))
    c = _t(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return wind.attach_rotation(c, grid, ("n_nationkey",)).select("c_custkey", F.round("cosa", 6).alias("cosa"), F.round("sina", 6).alias("sina"))


@query("J3_stagger_join", """
WITH n AS (SELECT event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT event_id, (value + next) / 2 AS value FROM n WHERE next IS NOT NULL
""")  # fmt: skip
def stagger_rows(spark, d):
    e = _t(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return stagger.unstagger_rows(e, ["user_id"], "at", "value").select("event_id", "value")


@query("J3_stagger_grid", """
WITH g AS (SELECT user_id, CAST(event_id // 100 AS BIGINT) AS i, max(value) AS value FROM events GROUP BY 1, 2)
SELECT a.user_id, a.i, (a.value + b.value) / 2 AS value FROM g a JOIN g b ON a.user_id = b.user_id AND b.i = a.i + 1
""")  # fmt: skip
def stagger_grid(spark, d):
    g = _t(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("i")).agg(F.max("value").alias("value"))
    return stagger.unstagger_join(g, ["user_id"], "i", "value", lambda a, b: (a + b) / 2)


@query("J4_across_files", """
WITH e AS (SELECT user_id, event_id, date_trunc('day', ts) AS file, CAST(round_even(value * 100, 0) AS BIGINT) AS cents, lag(date_trunc('day', ts)) OVER w AS before, lag(CAST(round_even(value * 100, 0) AS BIGINT)) OVER w AS last
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, cents - last AS increment FROM e WHERE before < file
""")  # fmt: skip
def across_files(spark, d):
    """Increments at the first step of a file, from the last step of the one before."""
    e = _t(spark, d, "events").withColumns({"day": F.unix_date(F.to_date("ts")), "cents": _cents()})
    for c, name in (("cents", "increment"), ("day", "days")):
        e = accum.increments(e, F.col(c), ["user_id"], ["ts", "event_id"], name)
    return e.filter("days > 0").select("user_id", "event_id", "increment")


@query("J5_bracket", """
WITH e AS (SELECT vec_id, 100 * label AS z0, len(embedding) AS n FROM embeddings),
b AS (SELECT vec_id, height, z0, n, k FROM e, unnest([5, 100, 333, 630, 9999]) AS t(height), unnest(range(n - 1)) AS s(k)
      WHERE z0 + 10 * k <= height AND (height < z0 + 10 * (k + 1) OR (k = n - 2 AND height = z0 + 10 * (k + 1))))
SELECT vec_id, CAST(height AS DOUBLE) AS height, CAST(min(k) AS BIGINT) AS k FROM b GROUP BY vec_id, height
""")  # fmt: skip
def bracket(spark, d):
    z = F.transform("embedding", lambda x, k: F.col("label") * 100.0 + k * 10.0)
    e = _t(spark, d, "embeddings").select("vec_id", z.alias("z"), F.explode(F.array(*map(F.lit, _LEVELS))).alias("height"))
    return e.select("vec_id", "height", levels.bracket(F.col("z"), F.col("height")).cast("long").alias("k")).filter("k IS NOT NULL")


@query("J6_height_index", "SELECT p_partkey, CAST(list_position([2, 10, 20, 40], p_size) - 1 AS BIGINT) AS h_idx FROM part WHERE p_size IN (2, 10, 20, 40)")
def height_index(spark, d):
    return merge.height_index(_t(spark, d, "part"), [40, 2, 10, 20], "p_size").select("p_partkey", F.col("h_idx").cast("long").alias("h_idx"))


@query("J7_W5_output_index", """
WITH t AS (SELECT DISTINCT date_trunc('hour', ts) AS time FROM events WHERE ts >= TIMESTAMP '2024-01-10'),
o AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS out_idx FROM t)
SELECT event_id, CAST(out_idx AS BIGINT) AS out_idx FROM events JOIN o ON date_trunc('hour', ts) = time
""")  # fmt: skip
def output_index(spark, d):
    e = _t(spark, d, "events").withColumn("time", F.date_trunc("HOUR", "ts").cast("timestamp_ntz"))
    axis = timeaxis.output_index(timeaxis.between_times(e.select("time").distinct(), "2024-01-10", None))
    return e.join(axis, "time").select("event_id", F.col("out_idx").cast("long").alias("out_idx"))


# --- aggregations


@query("A1_dedup", """
WITH h AS (SELECT date_trunc('hour', ts) AS time, event_type, event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_type, event_id) AS n FROM events)
SELECT time, event_type, event_id FROM h WHERE n = 1
""")  # fmt: skip
def first_times(spark, d):
    e = _t(spark, d, "events").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("time"), "event_type", "event_id")
    return timeaxis.first_of_each_time(e, "time", "event_type", "event_id")


@query("A2_U2_heights", "SELECT DISTINCT CAST(h AS DOUBLE) AS height FROM (SELECT p_size AS h FROM part UNION ALL SELECT unnest([2, 10, 100])) ORDER BY 1")
def heights(spark, d):
    fixed = spark.createDataFrame([(2.0,), (10.0,), (100.0,)], "height double")
    return _t(spark, d, "part").select(F.col("p_size").cast("double").alias("height")).union(fixed).distinct().orderBy("height")


@query("A3_bounds", "SELECT l_returnflag, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY 1")
def bounds(spark, d):
    return bbox.bounds(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])


@query("A4_group", "SELECT p_type, array_to_string(list(p_brand || '/' || p_partkey ORDER BY p_partkey), ',') AS keys FROM part GROUP BY p_type")
def group(spark, d):
    p = _t(spark, d, "part").select("p_type", "p_partkey", F.concat_ws("/", "p_brand", "p_partkey").alias("key"))
    return merge.group_frame(p, "p_type", "p_partkey", "key").select("p_type", F.array_join("keys", ",").alias("keys"))


@query("A5_sum_sources", "SELECT event_id, value + CAST(user_id AS DOUBLE) AS total FROM events")
def sum_sources(spark, d):
    return _t(spark, d, "events").select("event_id", accum.total([F.col("value"), F.col("user_id")]).alias("total"))


@query("A6_any_all", "SELECT o_custkey, bool_or(o_totalprice > 300000) AS some, bool_and(o_totalprice > 50000) AS every FROM orders GROUP BY 1")
def any_all(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 300000).alias("some"), F.bool_and(F.col("o_totalprice") > 50000).alias("every"))


# --- windows


@query("W1_accum", """
WITH c AS (SELECT user_id, ts, event_id, CAST(round_even(value * 100, 0) AS BIGINT) AS cents FROM events),
a AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM c),
i AS (SELECT *, CAST(total - lag(total) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS increment FROM a)
SELECT event_id, ts, increment FROM i WHERE ts >= TIMESTAMP '2024-01-10'
""")  # fmt: skip
def accumulation(spark, d):
    w = accum.W.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, d, "events").withColumn("total", F.sum(_cents()).over(w))
    return timeaxis.between_times(accum.increments(e, F.col("total"), ["user_id"], ["ts", "event_id"], "increment"), "2024-01-10", None, "ts").select("event_id", "ts", "increment")


@query("W1_J4_segments", """
WITH c AS (SELECT user_id, ts, event_id, CAST(round_even(value * 100, 0) AS BIGINT) AS cents FROM events),
a AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM c)
SELECT user_id, event_id, ts, CAST(total - lag(total) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS increment FROM a
""")  # fmt: skip
def segments(spark, d):
    """Days as segments: all but the last two at once, then each of these from its own
    rows and the edges of those before.  Totals and edges are worked out once, and a task
    sorts about ``SEGMENT_ROWS`` rows, however many there are."""
    events, by, order = _t(spark, d, "events"), ["user_id"], ["ts", "event_id"]
    n = max(1, -(-events.count() // SEGMENT_ROWS))
    running = F.sum("cents").over(accum.W.partitionBy(*by).orderBy(*order))
    e = events.select(*by, *order, _cents().alias("cents")).repartition(n, *by).select(*by, *order, running.alias("total"), F.date_trunc("DAY", "ts").alias("day"))
    e = staged(e)
    known = staged(accum.segment_edges(e.repartition(n, "day", *by), F.col("total"), "day", by, order))
    last = known.agg(F.max("day")).first()[0]
    parts, earlier = [], None
    for own in (F.date_diff(F.lit(last), "day") > 1, F.date_diff(F.lit(last), "day") == 1, F.date_diff(F.lit(last), "day") == 0):
        rows, edges = e.filter(own).repartition(n, "day", *by), known.filter(own)
        parts.append(accum.increments_by_segment(rows, F.col("total"), "day", by, order, "increment", earlier, edges))
        earlier = edges if earlier is None else earlier.unionByName(edges)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("W1_halo", """
WITH g AS (SELECT n_nationkey AS cell, CAST(k AS BIGINT) AS k, TIMESTAMP '2024-01-01' + to_hours(CAST(k AS INTEGER)) AS time, CAST((k * k + n_nationkey * k) AS DOUBLE) AS total FROM nation, unnest(range(48)) AS t(k)),
i AS (SELECT *, total - lag(total) OVER (PARTITION BY cell ORDER BY time) AS increment FROM g)
SELECT cell, time, increment FROM i WHERE time BETWEEN TIMESTAMP '2024-01-01 12:00:00' AND TIMESTAMP '2024-01-02'
""")  # fmt: skip
def halo(spark, d):
    """All cells share the axis, so one step before the range is read, no more."""
    steps = spark.range(48).select(F.col("id").alias("k"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("time"))
    cells = _t(spark, d, "nation").select(F.col("n_nationkey").alias("cell"))
    grid = cells.join(broadcast_if_small(steps)).withColumn("total", (F.col("k") * F.col("k") + F.col("cell") * F.col("k")).cast("double"))
    return accum.increments_between(grid, steps, F.col("total"), ["cell"], "increment", "2024-01-01 12:00:00", "2024-01-02").select("cell", "time", "increment")


@query("W2_first_step", """
WITH i AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS increment FROM events)
SELECT user_id, event_id, increment FROM i WHERE increment IS NULL
""")  # fmt: skip
def first_step(spark, d):
    i = accum.increments(_t(spark, d, "events"), F.col("value"), ["user_id"], ["ts", "event_id"], "increment")
    return i.filter("increment IS NULL").select("user_id", "event_id", "increment")


_PROFILE = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("W3_unstagger", f"""
WITH e AS (SELECT vec_id, {_PROFILE} AS p FROM embeddings)
SELECT vec_id, CAST(k AS BIGINT) AS k, (p[k + 1] + p[k + 2]) / 2 AS value FROM e, unnest(range(len(p) - 1)) AS t(k)
""")  # fmt: skip
def unstagger(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.posexplode(stagger.unstagger(F.col("embedding").cast("array<double>"))).alias("k", "value"))
    return e.select("vec_id", F.col("k").cast("long").alias("k"), "value")


# --- sort and set operations


@query("W4_rank", "SELECT event_id, CAST(row_number() OVER (PARTITION BY date_trunc('hour', ts), event_type ORDER BY event_id) AS BIGINT) AS n FROM events")
def rank(spark, d):
    w = timeaxis.W.partitionBy(F.date_trunc("HOUR", "ts"), "event_type").orderBy("event_id")
    return _t(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("n"))


@query("O1_O2_sorted", "SELECT DISTINCT p_brand AS path FROM part ORDER BY 1")
def sorted_paths(spark, d):
    return _t(spark, d, "part").select(F.col("p_brand").alias("path")).distinct().orderBy("path")


@query("U1_concat_times", """
SELECT time, min(file) AS file, count(*) AS copies FROM
(SELECT date_trunc('day', ts) AS time, 1 AS file FROM events UNION ALL SELECT date_trunc('day', o_orderdate), 2 FROM orders) GROUP BY time
""")  # fmt: skip
def concat_times(spark, d):
    days = lambda table, c, n: _t(spark, d, table).select(F.date_trunc("DAY", c).cast("timestamp_ntz").alias("time"), F.lit(n).alias("file"))
    both = days("events", "ts", 1).unionByName(days("orders", "o_orderdate", 2))
    return both.groupBy("time").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("copies"))


_VARIANTS = ("o_orderkey % 3 > 0", "o_orderkey % 5 > 0", "o_orderkey % 7 > 0")


@query("U3_merge", """
WITH v AS (%s),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY prio DESC, o_orderkey DESC) AS n FROM v)
SELECT cell, value FROM r WHERE n = 1
""" % " UNION ALL ".join(f"SELECT CAST(o_orderkey // 5 AS BIGINT) AS cell, o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS value, {n} AS prio FROM orders WHERE {v}" for n, v in enumerate(_VARIANTS)))  # fmt: skip
def merge_variants(spark, d):
    o = _t(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 5).alias("cell"), "o_orderkey", F.expr("CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS value"))
    return merge.merge_variants([o.filter(v) for v in _VARIANTS], ["cell"], "value", F.col("o_orderkey"))


@query("U4_densify", """
WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS day FROM events), t AS (SELECT DISTINCT event_type FROM events),
s AS (SELECT date_trunc('day', ts) AS day, event_type, max(value) AS value FROM events WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY 1, 2)
SELECT day, event_type, value FROM d CROSS JOIN t LEFT JOIN s USING (day, event_type)
""")  # fmt: skip
def densify(spark, d):
    e = _t(spark, d, "events").select(F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("day"), "event_type", "value")
    least = e.agg(F.min("event_type").alias("event_type"))
    sparse = e.join(broadcast_if_small(least), "event_type", "left_anti").groupBy("day", "event_type").agg(F.max("value").alias("value"))
    return merge.densify(sparse, [e.select("day").distinct(), e.select("event_type").distinct()]).select("day", "event_type", "value")


# --- functions

_ROTATED = """
WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity - 25.5 AS u, 100 * l_discount - 4.75 AS v, radians(l_suppkey) AS a FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, u * cos(a) + v * sin(a) AS ue, v * cos(a) - u * sin(a) AS ve FROM w)
"""


def _rotated(spark, d):
    w = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25.5).alias("u"), (F.lit(100) * F.col("l_discount") - 4.75).alias("v"), F.radians("l_suppkey").alias("a"))
    ue, ve = wind.rotate(F.col("u"), F.col("v"), F.cos("a"), F.sin("a"))
    return w.select("l_orderkey", "l_linenumber", ue.alias("ue"), ve.alias("ve"))


@query("F1_F4_rotate", _ROTATED + "SELECT l_orderkey, l_linenumber, round(ue, 6) AS u_wind, round(ve, 6) AS v_wind FROM r")
def rotate(spark, d):
    return _rotated(spark, d).select("l_orderkey", "l_linenumber", F.round("ue", 6).alias("u_wind"), F.round("ve", 6).alias("v_wind"))


@query("F2_F3_wind", _ROTATED + """SELECT l_orderkey, l_linenumber, round(sqrt(ue * ue + ve * ve), 6) AS wind_speed,
round(((270 - degrees(atan2(ve, ue))) % 360 + 360) % 360, 6) AS wind_direction FROM r""")  # fmt: skip
def winds(spark, d):
    u, v = F.col("ue"), F.col("ve")
    return _rotated(spark, d).select("l_orderkey", "l_linenumber", F.round(wind.speed(u, v), 6).alias("wind_speed"), F.round(wind.direction(u, v), 6).alias("wind_direction"))


@query("F5_height", f"""
WITH e AS (SELECT vec_id, {_PROFILE} AS p FROM embeddings)
SELECT vec_id, CAST(k AS BIGINT) AS k, round(((p[k + 1] + 1000.0 * k) / 9.81 + (p[k + 2] + 1000.0 * (k + 1)) / 9.81) / 2, 6) AS height FROM e, unnest(range(len(p) - 1)) AS t(k)
""")  # fmt: skip
def height(spark, d):
    base = F.transform("embedding", lambda x, k: k * 1000.0)
    z = derive.geo_height(F.col("embedding"), base)
    return _t(spark, d, "embeddings").select("vec_id", F.posexplode(z).alias("k", "h")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("h", 6).alias("height"))


@query("F7_temperature", f"""
WITH e AS (SELECT vec_id, {_PROFILE} AS p FROM embeddings)
SELECT vec_id, CAST(k AS BIGINT) AS k, round((p[k + 1] + 300) * pow((10.0::DOUBLE * k + (100000.0::DOUBLE - 1000.0::DOUBLE * k)) / 100000, 0.2854), 6) AS temperature FROM e, unnest(range(len(p))) AS t(k)
""")  # fmt: skip
def temperature(spark, d):
    p = F.transform("embedding", lambda x, k: k * 10.0)
    pb = F.transform("embedding", lambda x, k: F.lit(100000.0) - k * 1000.0)
    t = derive.actual_temperature(F.col("embedding"), p, pb)
    return _t(spark, d, "embeddings").select("vec_id", F.posexplode(t).alias("k", "t")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("t", 6).alias("temperature"))


@query("F8_F10_winds_3d", f"""
WITH e AS (SELECT vec_id, radians(label) AS a, {_PROFILE} AS p FROM embeddings),
s AS (SELECT vec_id, a, k, (p[k + 1] + p[k + 2]) / 2 AS u, 1.0 - (p[k + 1] + p[k + 2]) / 2 AS v FROM e, unnest(range(len(p) - 1)) AS t(k)),
r AS (SELECT vec_id, k, u * cos(a) + v * sin(a) AS ue, v * cos(a) - u * sin(a) AS ve FROM s)
SELECT vec_id, CAST(k AS BIGINT) AS k, round(ue, 6) AS u_wind, round(ve, 6) AS v_wind, round(sqrt(ue * ue + ve * ve), 6) AS wind_speed,
       round(((270 - degrees(atan2(ve, ue))) % 360 + 360) % 360, 4) AS wind_direction FROM r
""")  # fmt: skip
def winds_3d(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.radians("label").alias("a"), stagger.unstagger(F.col("embedding").cast("array<double>")).alias("u"))
    turned = F.transform("u", lambda u: F.struct(*(c.alias(n) for c, n in zip(wind.rotate(u, F.lit(1.0) - u, F.cos("a"), F.sin("a")), ("ue", "ve"), strict=True))))
    e = e.select("vec_id", F.posexplode(turned).alias("k", "w"))
    u, v = F.col("w.ue"), F.col("w.ve")
    return e.select("vec_id", F.col("k").cast("long").alias("k"), F.round(u, 6).alias("u_wind"), F.round(v, 6).alias("v_wind"), F.round(wind.speed(u, v), 6).alias("wind_speed"), F.round(wind.direction(u, v), 4).alias("wind_direction"))


@query("F11_humidity", "SELECT l_orderkey, l_linenumber, round(l_discount / (1 + l_discount), 9) AS q FROM lineitem")
def humidity(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(derive.humidity(F.col("l_discount")), 9).alias("q"))


@query("F12_slp", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * exp(9.81 * (10 * l_quantity) / (287.05 * ((280 + 100 * l_discount) + 0.0065 * (10 * l_quantity) / 2))), 4) AS slp FROM lineitem
""")  # fmt: skip
def slp(spark, d):
    p = derive.sea_level_pressure(F.col("l_extendedprice"), F.lit(280) + F.lit(100) * F.col("l_discount"), F.lit(10) * F.col("l_quantity"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 4).alias("slp"))


@query("F13_levels", f"""
WITH e AS (SELECT vec_id, label, {_PROFILE} AS p FROM embeddings),
l AS (SELECT vec_id, p, CAST(height AS DOUBLE) AS height, 100.0::DOUBLE * label AS z0 FROM e, unnest([5, 100, 333, 630, 9999]) AS t(height)),
k AS (SELECT *, least(CAST(floor((height - z0) / 10) AS BIGINT), len(p) - 2) AS k FROM l)
SELECT vec_id, height, CASE WHEN height >= z0 AND height <= z0 + 10.0::DOUBLE * (len(p) - 1)
       THEN round(p[k + 1] + (height - (z0 + 10.0::DOUBLE * k)) / 10.0::DOUBLE * (p[k + 2] - p[k + 1]), 6) END AS value FROM k
""")  # fmt: skip
def to_levels(spark, d):
    z = F.transform("embedding", lambda x, k: F.col("label") * 100.0 + k * 10.0)
    e = _t(spark, d, "embeddings").select("vec_id", z.alias("z"), F.col("embedding").cast("array<double>").alias("p"))
    return e.select("vec_id", F.inline(levels.at_levels(F.col("z"), F.col("p"), _LEVELS))).select("vec_id", "height", F.round("value", 6).alias("value"))


_LCC = Projection("lcc", -30.0, -60.0, -41.0, 173.0)
_MERCATOR = Projection("mercator", -41.0, 0.0, 0.0, 173.0, Ellipsoid(6370000.0, 0.0))
_POLAR = Projection("polar", -71.0, 0.0, -90.0, 173.0)
_LON, _LAT = "radians(160.0 + s_suppkey % 25 - 173.0)", "radians(-48.0 + s_suppkey % 15)"


# The formulas of the three projections with their constants worked out by hand
# from the ellipsoid: first eccentricity 0.0818..., cone constant, scaled radii.
_T = lambda lat: f"(tan(pi() / 4 - ({lat}) / 2) / pow((1 - 0.08181919084262149 * sin({lat})) / (1 + 0.08181919084262149 * sin({lat})), 0.040909595421310746))"
_PROJECTED = f"""
WITH s AS (SELECT s_suppkey, {_LON} AS lon, {_LAT} AS lat FROM supplier),
t AS (SELECT s_suppkey, lon, lat, 6378137.0::DOUBLE * -1.790073618827417::DOUBLE * pow({_T('lat')}, -0.7156710979405948::DOUBLE) AS rho, 12367396.218459861::DOUBLE * {_T('-lat')} AS polar FROM s)
SELECT s_suppkey, round(rho * sin(lon * -0.7156710979405948::DOUBLE), 3) AS lcc_x, round(-6526426.625305105::DOUBLE - rho * cos(lon * -0.7156710979405948::DOUBLE), 3) AS lcc_y,
       round(polar * sin(lon), 3) AS polar_x, round(polar * cos(lon), 3) AS polar_y,
       round(lon * 4807500.026019058::DOUBLE, 3) AS mercator_x, round(-ln(tan(pi() / 4 - lat / 2)) * 4807500.026019058::DOUBLE, 3) AS mercator_y FROM t
"""


@query("F14_projections", _PROJECTED)
def projections(spark, d):
    lon, lat = F.lit(160.0) + F.col("s_suppkey") % 25, F.lit(-48.0) + F.col("s_suppkey") % 15
    out = []
    for p in (_LCC, _POLAR, _MERCATOR):
        x, y = p.forward(lon, lat)
        out += [F.round(x, 3).alias(f"{p.kind}_x"), F.round(y, 3).alias(f"{p.kind}_y")]
    return _t(spark, d, "supplier").select("s_suppkey", *out)


@query("F15_F16_text", """
SELECT p_partkey, CAST(trim(string_split(t, ',')[2]) AS DOUBLE) AS second, TIMESTAMP '2024-01-01' + to_days(CAST(p_size AS INTEGER)) AS time
FROM (SELECT p_partkey, p_size, ' 1.5, ' || p_size || ' ,x' AS t FROM part)
""")  # fmt: skip
def text(spark, d):
    items = text_functions.split_column(F.concat(F.lit(" 1.5, "), F.col("p_size"), F.lit(" ,x")))
    day = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("p_size")), "yyyy-MM-dd")
    return _t(spark, d, "part").select("p_partkey", F.element_at(items, 2).cast("double").alias("second"), day.cast("timestamp_ntz").alias("time"))
