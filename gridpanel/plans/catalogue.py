"""Every query of the library by name, with the same query as SQL for DuckDB.

The driver's tables stand in for the real ones: line items for pixels, orders for
fields and months, events for detections. Aggregates of doubles are rounded,
since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, indices, quality, text
from ..operators import assemble, calendar, compare, composite, gapfill, grid, ingest, panel, regress, spatial, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PX, PY = "CAST(l_partkey % 40 AS INT)", "CAST(l_suppkey % 25 AS INT)"


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in columns})


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations of a 40 x 25 grid."""
    return read(spark, sf_dir, "lineitem").select(F.expr(PX).alias("px"), F.expr(PY).alias("py"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("nir"), (F.col("l_discount") * 100 + 1).alias("red"), (F.col("l_tax") * 100).alias("blue"), (F.col("l_tax") + 0.01).alias("vv"), F.col("l_discount").alias("vh"))


# --- composites, masks, band algebra -----------------------------------------


@query(f"""
SELECT px, py, month, round(avg(v), 6) + 0.0 AS ndvi_mean, round(min(v), 6) + 0.0 AS ndvi_min, round(max(v), 6) + 0.0 AS ndvi_max FROM (
  SELECT {PX} AS px, {PY} AS py, strftime(l_shipdate, '%Y-%m') AS month, (l_quantity - (l_discount * 100 + 1)) / nullif(l_quantity + (l_discount * 100 + 1), 0) AS v
  FROM lineitem WHERE CAST(l_shipdate AS DATE) < last_day(CAST(l_shipdate AS DATE)))
GROUP BY px, py, month HAVING avg(v) IS NOT NULL""")
def q01_ndvi_month_composite(spark, sf_dir):
    df = windows.with_month(pixels(spark, sf_dir), "ts").withColumn("ndvi", indices.ndvi("nir", "red"))
    out = composite.composite(df, ["px", "py", "month"], {"ndvi": ["mean", "min", "max"]})
    return rounded(quality.all_valid(out, ["ndvi_mean", "ndvi_min", "ndvi_max"]), ["ndvi_mean", "ndvi_min", "ndvi_max"])


_BOTH_MODES = " UNION ALL ".join(f"""
SELECT '{mode}' AS mode, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders
WHERE {cond} GROUP BY 2""" for mode, cond in (("historical", "CAST(o_orderdate AS DATE) < last_day(CAST(o_orderdate AS DATE))"), ("full", "true")))


@query(_BOTH_MODES)
def q02_month_windows_hist_vs_full(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    out = None
    for mode in windows.MODES:
        w = windows.month_windows(spark, "1990-01", "2009-12", mode)
        part = windows.join_windows(orders, w, "o_orderdate").groupBy(F.lit(mode).alias("mode"), "month").agg(F.count("*").alias("n"), r6(F.avg("o_totalprice"), 4).alias("mean_price"))
        out = part if out is None else out.unionByName(part)
    return out


def _fpar(spark, sf_dir, ok) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id"), (F.col("event_id") % 256).cast("int").alias("qc"), "value")
    e = e.withColumn("fpar", quality.masked("value", ok("qc")))
    return rounded(composite.composite(e, ["user_id"], {"fpar": ["mean", "min", "max", "count"]}, {"fpar": 0.01}), ["fpar_mean", "fpar_min", "fpar_max"]).where("fpar_count > 0")


def _fpar_sql(bit: int) -> str:
    return f"""SELECT user_id, round(avg(value) * 0.01, 6) AS fpar_mean, round(min(value) * 0.01, 6) AS fpar_min, round(max(value) * 0.01, 6) AS fpar_max, count(value) AS fpar_count
FROM events WHERE ((event_id % 256) >> 5) & 7 <> 4 AND ((event_id % 256) >> 1) & 1 = {bit} GROUP BY user_id HAVING count(value) > 0"""


@query(_fpar_sql(1))
def q03_fpar_qc_aqua(spark, sf_dir):
    return _fpar(spark, sf_dir, quality.aqua_ok)


@query(_fpar_sql(0))
def q04_fpar_qc_terra(spark, sf_dir):
    return _fpar(spark, sf_dir, quality.terra_ok)


def _fire_sql(mode: str) -> str:
    low = "max" if mode == "historical" else "min"
    names = ", ".join(f"round({s}({t}), 6) AS \"MaxFRP_{t}_{s if s != 'avg' else 'mean'}\"" for t in ("mean", "max", "min") for s in ("avg", "max", "min"))
    return f"""SELECT region, {names} FROM (
  SELECT CAST(user_id % 10 AS INT) AS region, user_id, avg(value) * 0.1 AS mean, max(value) * 0.1 AS max, {low}(value) * 0.1 AS min
  FROM (SELECT user_id, CASE WHEN event_id % 16 >= 7 AND event_id % 4 <= 2 THEN value END AS value FROM events) GROUP BY 1, 2) GROUP BY region"""


def _fire(spark, sf_dir, mode):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("region"), "user_id", "value", (F.col("event_id") % 16).cast("int").alias("fire"), (F.col("event_id") % 4).cast("int").alias("qa"))
    out = composite.fire_power(e, ["region"], ["user_id"], "value", "fire", "qa", mode)
    return rounded(out, [c for c in out.columns if c != "region"])


@query(_fire_sql("historical"))
def q05_fire_bits_frp_historical(spark, sf_dir):
    return _fire(spark, sf_dir, "historical")


@query(_fire_sql("corrected"))
def q05_fire_bits_frp_corrected(spark, sf_dir):
    return _fire(spark, sf_dir, "corrected")


@query("""SELECT p_brand, count(*) AS n, count(v) AS n_clear, round(avg(v), 8) AS mean_reflectance FROM (
  SELECT p_brand, CASE WHEN (p_partkey % 4096) & 3072 = 0 THEN p_retailprice / 10000 END AS v FROM part) GROUP BY p_brand""")
def q06_qa60_cloud_mask(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_brand", quality.masked(F.col("p_retailprice") / 10000, quality.cloud_free((F.col("p_partkey") % 4096).cast("int"))).alias("v"))
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.count("v").alias("n_clear"), r6(F.avg("v"), 8).alias("mean_reflectance"))


@query(f"""SELECT px, py, round(avg(4 * vh / nullif(vv + vh, 0)), 6) AS rvi_mean, round(avg(vv / nullif(vh, 0)), 6) AS vv_vh_mean, round(avg(vh / nullif(vv, 0)), 6) AS vh_vv_mean, round(max(vh / nullif(vv, 0)), 6) AS vh_vv_max
FROM (SELECT {PX} AS px, {PY} AS py, l_tax + 0.01 AS vv, l_discount AS vh FROM lineitem) GROUP BY px, py""")
def q07_rvi_sar_summary(spark, sf_dir):
    df = pixels(spark, sf_dir).select("px", "py", indices.rvi("vv", "vh").alias("rvi"), indices.ratio("vv", "vh").alias("vv_vh"), indices.ratio("vh", "vv").alias("vh_vv"))
    out = composite.composite(df, ["px", "py"], {"rvi": ["mean"], "vv_vh": ["mean"], "vh_vv": ["mean", "max"]})
    return rounded(out, ["rvi_mean", "vv_vh_mean", "vh_vv_mean", "vh_vv_max"])


@query(f"""WITH p AS (SELECT {PX} AS px, vh / nullif(vv, 0) AS q0, 4 * vh / nullif(vv + vh, 0) AS rvi FROM (SELECT *, l_tax + 0.01 AS vv, l_discount AS vh FROM lineitem)),
d AS (SELECT px, least(greatest(q0, 0), 1) AS q, CASE WHEN rvi BETWEEN 0 AND 1 THEN rvi END AS rvi FROM p)
SELECT px, round(avg(q * (q + 3) / ((q + 1) * (q + 1))), 6) AS dprvi_mean, round(avg(rvi), 6) AS rvi_mean, count(rvi) AS rvi_count FROM d GROUP BY px""")
def q08_dprvi_range_masked(spark, sf_dir):
    df = pixels(spark, sf_dir).select("px", quality.within(indices.dprvi("vv", "vh"), 0, 1).alias("dprvi"), quality.within(indices.rvi("vv", "vh"), 0, 1).alias("rvi"))
    return rounded(composite.composite(df, ["px"], {"dprvi": ["mean"], "rvi": ["mean", "count"]}), ["dprvi_mean", "rvi_mean"])


@query("""SELECT l_returnflag, round(avg(evi), 8) AS evi_mean, round(avg(3.618 * evi - 0.118), 8) AS lai_mean, count(*) AS n FROM (
  SELECT l_returnflag, 2.5 * (n - r) / nullif(n + 6 * r - 7.5 * b + 1, 0) AS evi FROM (
    SELECT l_returnflag, l_quantity * 100 * 1e-4 AS n, l_discount * 1000 * 1e-4 AS r, l_tax * 100 * 1e-4 AS b FROM lineitem)) GROUP BY l_returnflag""")
def q09_evi_lai(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", indices.evi(F.col("l_quantity") * 100, F.col("l_discount") * 1000, F.col("l_tax") * 100).alias("evi"))
    return df.groupBy("l_returnflag").agg(r6(F.avg("evi"), 8).alias("evi_mean"), r6(F.avg(indices.lai("evi")), 8).alias("lai_mean"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, avg(20 + value % 15) AS t, avg(10 + value % 9) AS d, avg(value % 7 - 3) AS u, avg(value % 5 - 2) AS v FROM events GROUP BY 1, 2)
SELECT user_id, month, round(exp((d - t) * (17.625 * 243.04) / ((t + 243.04) * (d + 243.04))), 6) AS humidity, round(sqrt(u * u + v * v), 6) AS wind FROM m""")
def q10_humidity_wind(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", dates.month_label("ts").alias("month"), "value")
    v = F.col("value")
    m = e.groupBy("user_id", "month").agg(F.avg(v % 15 + 20).alias("t"), F.avg(v % 9 + 10).alias("d"), F.avg(v % 7 - 3).alias("u"), F.avg(v % 5 - 2).alias("v"))
    return m.select("user_id", "month", r6(indices.humidity("t", "d")).alias("humidity"), r6(indices.wind_speed("u", "v")).alias("wind"))


# --- tiles, zones, gap filling -------------------------------------------------

_TILE = "format('{}{:02d}{}{:03d}_{}_{}', CASE WHEN k % 2 = 0 THEN 'N' ELSE 'S' END, k % 60, CASE WHEN k % 3 = 0 THEN 'W' ELSE 'E' END, k % 180, k % 2, (k // 2) % 2)"


@query(f"""WITH t AS (SELECT {_TILE} AS tile_id, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * (k % 60) AS lat, CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END * (k % 180) AS lon, k % 2 AS tx, (k // 2) % 2 AS ty FROM (SELECT DISTINCT p_partkey AS k FROM part)),
b AS (SELECT DISTINCT tile_id, lon + tx * 0.5 AS west, lat + CASE WHEN ty = 0 THEN 0.5 ELSE 0 END AS south FROM t),
c AS (SELECT * FROM b WHERE west >= -180 AND west + 0.5 <= 180)
SELECT tile_id, concat(tile_id, '_', x, '_', y) AS part, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(west + 0.25 * x AS DOUBLE) AS west, CAST(south + 0.5 - 0.25 * (y + 1) AS DOUBLE) AS south, CAST(west + 0.25 * (x + 1) AS DOUBLE) AS east, CAST(south + 0.5 - 0.25 * y AS DOUBLE) AS north
FROM c, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS q(x, y)""")
def q11_tile_grid_subtiles(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.format_string("%s%02d%s%03d_%d_%d", F.when(k % 2 == 0, "N").otherwise("S"), k % 60, F.when(k % 3 == 0, "W").otherwise("E"), k % 180, k % 2, F.expr("p_partkey div 2 % 2"))
    tiles = grid.with_bounds(read(spark, sf_dir, "part").select(name.alias("tile_id")).distinct())
    return grid.quarters(tiles.where(text.bounds_ok("west", "south", "east", "north")))


_ZONES = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


def _zones(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("v")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("n_name", "l_suppkey", "v")


@query(f"""SELECT n_name, round(avg(m), 4) AS v_mean_mean, round(max(m), 4) AS v_mean_max, round(min(m), 4) AS v_mean_min FROM (
  SELECT n_name, l_suppkey, avg(l_extendedprice) AS m FROM {_ZONES} GROUP BY 1, 2) GROUP BY n_name""")
def q12_zonal_two_level(spark, sf_dir):
    return rounded(composite.zonal(_zones(spark, sf_dir), ["n_name"], ["l_suppkey"], "v", "mean", ["mean", "max", "min"]), ["v_mean_mean", "v_mean_max", "v_mean_min"], 4)


@query(f"""SELECT n_name, round(avg(l_extendedprice), 4) AS v_mean, max(l_extendedprice) AS v_max, min(l_extendedprice) AS v_min, round(stddev_pop(l_extendedprice), 4) AS v_std, round(median(l_extendedprice), 4) AS v_median FROM {_ZONES} GROUP BY n_name""")
def q13_zonal_five_reducers(spark, sf_dir):
    return rounded(composite.composite(_zones(spark, sf_dir), ["n_name"], {"v": ["mean", "max", "min", "std", "median"]}), ["v_mean", "v_std", "v_median"], 4)


@query("""WITH m AS (SELECT CAST(o_custkey % 50 AS INT) AS plot, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2),
h AS (SELECT plot, month, CASE WHEN (plot + year(month) * 12 + month(month)) % 3 <> 0 THEN v END AS v FROM m),
s AS (SELECT plot, year(month) AS y, month(month) AS i, v FROM h UNION ALL SELECT plot, year(month) + 1, 0, v FROM h WHERE month(month) = 12),
c AS (SELECT plot, y FROM s GROUP BY 1, 2 HAVING max(i) > 0),
g AS (SELECT c.plot, c.y, k.i, s.v FROM c CROSS JOIN (SELECT unnest(range(13)) AS i) k LEFT JOIN s ON s.plot = c.plot AND s.y = c.y AND s.i = k.i),
l AS (SELECT plot, y, list({'i': i, 'v': v} ORDER BY i) FILTER (v IS NOT NULL) AS k FROM g GROUP BY 1, 2),
e AS (SELECT g.plot, g.y, g.i, g.v, k, list_filter(k, lambda p: p.i < g.i) AS b, list_filter(k, lambda p: p.i > g.i) AS a FROM g JOIN l USING (plot, y)),
f AS (SELECT plot, y, i, v, CASE WHEN len(k) < 2 OR v IS NOT NULL THEN NULL WHEN len(b) = 0 THEN k[1] WHEN len(a) = 0 THEN k[-2] ELSE b[-1] END AS p, CASE WHEN len(k) < 2 OR v IS NOT NULL THEN NULL WHEN len(b) = 0 THEN k[2] WHEN len(a) = 0 THEN k[-1] ELSE a[1] END AS q FROM e)
SELECT plot, make_date(CAST(y AS INT), CAST(i AS INT), 1) AS month, round(greatest(coalesce(v, p.v + (q.v - p.v) * (i - p.i) / (q.i - p.i), 0), 0), 4) AS v FROM f WHERE i > 0""")
def q14_gapfill_interpolate(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).cast("int").alias("plot"), F.to_date(F.trunc(F.col("o_orderdate").cast("date"), "MM")).alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    holes = o.withColumn("v", F.when((F.col("plot") + F.year("month") * 12 + F.month("month")) % 3 != 0, F.col("v")))
    return rounded(gapfill.fill_months(holes, ["plot"], "month", "v"), ["v"], 4)


@query("""WITH p AS (SELECT p_partkey, p_partkey // 200 AS tile, p_partkey % 200 AS i, p_size % 14 AS class FROM part),
m AS (SELECT CAST(i % 20 + tile * 20 AS INT) AS px, CAST(i // 20 AS INT) AS py, class FROM p),
n AS (SELECT CASE WHEN class BETWEEN 0 AND 12 THEN CAST(class AS INT) END AS class, count(*) AS n FROM m GROUP BY 1)
SELECT k.class, coalesce(n.n, 0) AS n FROM (SELECT CAST(unnest(range(13)) AS INT) AS class) k LEFT JOIN n USING (class) UNION ALL SELECT class, n FROM n WHERE class IS NULL""")
def q15_class_histogram_mosaic(spark, sf_dir):
    """All parts as the cells of tiles of 20 x 10, side by side."""
    p = read(spark, sf_dir, "part").select(F.expr("p_partkey div 200").alias("tile"), (F.col("p_partkey") % 200).alias("i"), (F.col("p_size") % 14).cast("int").alias("class"))
    cells = p.select("tile", (F.col("i") % 20).cast("int").alias("px"), F.expr("cast(i div 20 as int)").alias("py"), "class")
    tiles = p.groupBy("tile").agg(F.lit(0).alias("y")).select("tile", (F.col("tile") * 20).cast("int").alias("x"), "y", F.lit(20).alias("w"), F.lit(10).alias("h"))
    return composite.histogram(grid.mosaic(cells, tiles), "class", 0, 12)


@query("""WITH f AS (SELECT DISTINCT CAST(o_custkey % 50 AS INT) AS plot, CAST(o_orderdate AS DATE) AS at FROM orders),
o AS (SELECT CAST(l_suppkey % 50 AS INT) AS plot, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS s, count(l_quantity) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2)
SELECT f.plot, CAST(k.w AS INT) AS weeks, count(DISTINCT f.at) AS fields, CAST(sum(o.n) AS BIGINT) AS n, round(sum(o.s) / sum(o.n), 6) AS mean_value, min(o.lo) AS low, max(o.hi) AS high
FROM f JOIN o ON o.plot = f.plot AND o.d < f.at AND o.d >= f.at - 56 JOIN (SELECT unnest(range(1, 9)) AS w) k ON o.d >= f.at - CAST(7 * k.w AS INT) GROUP BY 1, 2""")
def q16_interval_lookback_1_8w(spark, sf_dir):
    fields = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).cast("int").alias("plot"), "o_orderdate")
    seen = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).cast("int").alias("plot"), "l_shipdate", "l_quantity")
    out = windows.lookback(fields, seen, ["plot"], "o_orderdate", "l_shipdate", "l_quantity", 8)
    return out.groupBy("plot", "weeks").agg(F.count("*").alias("fields"), F.sum("n").alias("n"), r6(F.sum("total") / F.sum("n")).alias("mean_value"), F.min("low").alias("low"), F.max("high").alias("high"))


# --- dedup, keys, unions -----------------------------------------------------


@query("""WITH s AS (SELECT conv_id, turn, sha256(CAST(to_json([coalesce(role, ''), coalesce(text, '')]) AS VARCHAR)) AS signature FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY conv_id, turn) AS k FROM s) SELECT conv_id, turn, signature FROM r WHERE k = 1""")
def q17_dedup_exact(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return ingest.dedup_exact(c, ["role", "text"], ["conv_id", "turn"]).select("conv_id", "turn", "signature")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS rows, 'repeated' AS problem FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def q18_dup_key_report(spark, sf_dir):
    return assemble.key_report(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IN {_SEGMENTS}")
def q19_strict_union(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return assemble.strict_union([c.where(F.col("c_mktsegment") == s).select("c_custkey", "c_name", "c_acctbal") for s in _SEGMENTS])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, '' AS nation, CASE WHEN true THEN c_mktsegment END AS segment FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), '' FROM supplier""")
def q20_union_header(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return assemble.header_union([a, b], blank=True)


# --- spatial -----------------------------------------------------------------


def _boxes(spark, sf_dir) -> DataFrame:
    """Nations as a 5 x 5 layout of boxes 16 wide, which share their edges."""
    k = F.col("n_nationkey")
    x, y = (k % 5) * 16, F.floor(k / 5) * 16
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("gid"), spatial.box(x, y, x + 16, y + 16).alias("rings"))


@query("""WITH p AS (SELECT c_custkey, CAST((c_custkey * 37) % 90 AS DOUBLE) AS lon, CAST((c_custkey * 53) % 80 AS DOUBLE) AS lat FROM customer),
b AS (SELECT n_name AS gid, (n_nationkey % 5) * 16 AS x, (n_nationkey // 5) * 16 AS y FROM nation),
h AS (SELECT c_custkey, min(gid) AS gid, CAST(count(*) AS INT) AS matches FROM p JOIN b ON lon BETWEEN x AND x + 16 AND lat BETWEEN y AND y + 16 GROUP BY 1)
SELECT p.c_custkey, lon, lat, gid, coalesce(matches, 0) AS matches FROM p LEFT JOIN h USING (c_custkey)""")
def q21_point_in_polygon(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 90).cast("double").alias("lon"), (F.col("c_custkey") * 53 % 80).cast("double").alias("lat"))
    return spatial.point_in_polygon(p, _boxes(spark, sf_dir), size=8.0).select("c_custkey", "lon", "lat", "gid", "matches")


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 4000) / 100.0 AS lon, (c_custkey * 53 % 2000) / 100.0 AS lat FROM customer),
g AS (SELECT p_partkey % 40 AS px, (p_partkey // 40) % 20 AS py, max(p_size) AS v FROM part GROUP BY 1, 2)
SELECT c_custkey, CAST(floor(lon) AS INT) AS px, CAST(floor(20 - lat) AS INT) AS py, v FROM p LEFT JOIN g ON g.px = CAST(floor(lon) AS INT) AND g.py = CAST(floor(20 - lat) AS INT)""")
def q22_nearest_cell_sample(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 4000 / 100.0).alias("lon"), (F.col("c_custkey") * 53 % 2000 / 100.0).alias("lat"))
    g = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).cast("int").alias("px"), F.expr("cast(p_partkey div 40 % 20 as int)").alias("py")).agg(F.max("p_size").alias("v"))
    return grid.sample_nearest(p, g, "lon", "lat", 0.0, 20.0, 1.0, "v").select("c_custkey", "px", "py", "v")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN d BETWEEN 1 AND 365 THEN CAST(month(DATE '2019-01-01' + CAST(d - 1 AS INT)) AS INT) END AS moy
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN dayofyear(l_shipdate) % 7 <> 0 THEN least(dayofyear(l_shipdate), 365) END AS d FROM lineitem)""")
def q23_doy_to_month(spark, sf_dir):
    doy = F.dayofyear("l_shipdate")
    d = F.when(doy % 7 == 0, quality.NODATA).otherwise(F.least(doy, F.lit(365))) + F.when(doy % 7 == 0, 0.0).otherwise(0.25)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dates.day_of_year_to_month(d).alias("moy"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey % 40 AS INT) AS px, CAST((p_partkey // 40) % 20 AS INT) AS py, p_size FROM part),
g AS (SELECT px, py, CASE WHEN max(p_size) % 5 = 0 THEN NULL ELSE max(p_size) * 7.0 END AS d FROM p GROUP BY 1, 2),
c AS (SELECT c_custkey, (c_custkey * 37 % 4000) / 100.0 AS lon, (c_custkey * 53 % 2000) / 100.0 AS lat FROM customer)
SELECT c_custkey, mode, CASE WHEN mode = 'historical' THEN CAST(m AS DOUBLE) ELSE d END AS harvest_1_cropping_doy, m AS harvest_1_cropping_moy FROM (
  SELECT c_custkey, mode, CAST(d AS DOUBLE) AS d, CAST(month(DATE '2019-01-01' + CAST(d - 1 AS INT)) AS INT) AS m FROM c CROSS JOIN (VALUES ('historical', 0.0), ('corrected', 0.5)) AS o(mode, s)
  LEFT JOIN g ON g.px = CAST(floor(lon + s) AS INT) AND g.py = CAST(floor(20 + s - lat) AS INT))""")
def q23_calendar_sample(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 4000 / 100.0).alias("lon"), (F.col("c_custkey") * 53 % 2000 / 100.0).alias("lat"))
    g = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).cast("int").alias("px"), F.expr("cast(p_partkey div 40 % 20 as int)").alias("py")).agg(F.max("p_size").alias("v"))
    day = F.when(F.col("v") % 5 == 0, float(quality.NODATA)).otherwise(F.col("v") * 7.0)
    c = g.select("px", "py", *[day.alias(f"harvest_{s}_cropping") for s in calendar.SEASONS])
    out = [calendar.sample_calendar(p, c, 0.0, 20.0, 1.0, mode=m).select("c_custkey", F.lit(m).alias("mode"), "harvest_1_cropping_doy", "harvest_1_cropping_moy") for m in ("historical", "corrected")]
    return out[0].unionByName(out[1])


# --- comparison and panels ---------------------------------------------------


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 97 <> 0),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 53 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 31 = 0 THEN 1 WHEN o_orderkey % 7 = 0 THEN 0.0001 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 89 <> 0),
j AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS k, l.o_orderkey AS lk, r.o_orderkey AS rk, l.o_orderstatus AS ls, r.o_orderstatus AS rs, l.o_totalprice AS lp, r.o_totalprice AS rp FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey)
SELECT k AS o_orderkey, 'missing' AS kind, CAST(NULL AS VARCHAR) AS "column" FROM j WHERE rk IS NULL UNION ALL SELECT k, 'extra', NULL FROM j WHERE lk IS NULL
UNION ALL SELECT k, 'changed', 'o_orderstatus' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND ls <> rs UNION ALL SELECT k, 'changed', 'o_totalprice' FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL AND abs(lp - rp) > 0.001""")
def q24_keyed_tolerance_diff(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    right = o.where(k % 89 != 0).withColumns({"o_orderstatus": F.when(k % 53 == 0, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.col("o_totalprice") + F.when(k % 31 == 0, 1.0).when(k % 7 == 0, 0.0001).otherwise(0.0)})
    return compare.keyed_diff(o.where(k % 97 != 0), right, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], {"o_totalprice": 0.001}).select("o_orderkey", "kind", "column")


_PROFILED = ("l_orderkey", "l_quantity", "l_discount", "l_returnflag")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls, CAST(coalesce(count_if(TRY_CAST({c} AS DOUBLE) = 0), 0) AS BIGINT) AS zeros, CAST(count_if({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) AS BIGINT) AS not_numeric FROM lineitem" for c in _PROFILED))
def q25_profile(spark, sf_dir):
    return compare.profile(read(spark, sf_dir, "lineitem"), list(_PROFILED))


@query("""SELECT 'missing_columns' AS "check", 1 AS n UNION ALL SELECT 'nulls', 0 UNION ALL SELECT 'not_numeric', count(*) FROM lineitem WHERE TRY_CAST(l_returnflag AS DOUBLE) IS NULL
UNION ALL SELECT 'duplicate_keys', CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def q25_handoff(spark, sf_dir):
    return compare.handoff(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag", "ndvi"], ["l_orderkey", "l_linenumber"])


_PANEL = """SELECT o_orderkey, CAST(o_custkey % 40 AS DOUBLE) / 7 AS lon, CAST(o_custkey % 30 AS DOUBLE) / 9 AS lat, o_totalprice / 1000000 AS ndvi,
CASE WHEN o_orderkey % 5 <> 0 THEN c_acctbal END AS pm25_mean, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 END AS lag_lumen,
CAST(o_orderkey % 2 AS INT) AS reprod, CAST(o_orderkey % 3 AS INT) AS veg, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS mon FROM orders JOIN customer ON o_custkey = c_custkey"""


def _panel(spark, sf_dir) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    k = F.col("o_orderkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", ((F.col("o_custkey") % 40).cast("double") / 7).alias("lon"), ((F.col("o_custkey") % 30).cast("double") / 9).alias("lat"), (F.col("o_totalprice") / 1000000).alias("ndvi"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("pm25_mean"), F.when(k % 11 != 0, F.col("o_totalprice") / 1000).alias("lag_lumen"), (k % 2).cast("int").alias("reprod"), (k % 3).cast("int").alias("veg"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("mon"))


@query(f"""WITH p AS (SELECT * FROM ({_PANEL}) WHERE reprod = 1 OR veg = 1), m AS (SELECT avg(pm25_mean) AS a, avg(lag_lumen) AS b FROM p)
SELECT o_orderkey, round(ln(greatest(ndvi, 1e-4)), 6) AS ln_ndvi, round(ln(greatest(coalesce(pm25_mean, a), 1e-4)), 6) AS ln_pm25, round(ln(coalesce(lag_lumen, b) + 0.01), 6) AS ln_lumen, round(pow(ln(greatest(coalesce(pm25_mean, a), 1e-4)), 2), 6) AS ln_pm25_2,
concat(CAST(round_even(lon, 3) AS VARCHAR), '_', CAST(round_even(lat, 3) AS VARCHAR)) AS plot_id, format('{{:d}}-{{:02d}}', year, mon) AS time_id FROM p, m""")
def q26_panel_impute_log(spark, sf_dir):
    df = panel.panel_rows(_panel(spark, sf_dir), ("pm25_mean", "lag_lumen"))
    df = panel.features(df.withColumns({c: F.lit(1.0) for c in ("temp_av", "rain_cum", "hum_av")}))
    return rounded(df.select("o_orderkey", "ln_ndvi", "ln_pm25", "ln_lumen", "ln_pm25_2", "plot_id", "time_id"), ["ln_ndvi", "ln_pm25", "ln_lumen", "ln_pm25_2"])


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT o_custkey, row_number() OVER (ORDER BY n DESC, CAST(o_custkey AS VARCHAR)) AS r FROM n),
k AS (SELECT CAST(o_custkey AS VARCHAR) AS name, o_custkey FROM t WHERE r <= 50), i AS (SELECT name, o_custkey, row_number() OVER (ORDER BY name) - 1 AS plot_index FROM k)
SELECT o_orderkey, coalesce(name, 'other') AS plot_category, CAST(plot_index AS INT) AS plot_index FROM orders LEFT JOIN i USING (o_custkey)""")
def q27_topk_plot_dummies(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("plot_id"))
    return panel.plot_dummies(o, "plot_id", 50).select("o_orderkey", "plot_category", "plot_index")


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INT) AS "time_O", CAST(o_orderstatus = 'P' AS INT) AS "time_P" FROM orders""")
def q28_time_dummies(spark, sf_dir):
    out = panel.time_dummies(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    return out.drop("o_orderstatus")


@query("""WITH p AS (SELECT c_custkey, CAST((c_custkey * 7919) % 10007 AS DOUBLE) / 7 AS x, CAST((c_custkey * 104729) % 9973 AS DOUBLE) / 11 AS y FROM customer),
d AS (SELECT a.c_custkey, b.c_custkey AS neighbour, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM p a JOIN p b ON a.c_custkey <> b.c_custkey),
r AS (SELECT c_custkey, neighbour, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY d, neighbour) AS INT) AS rank FROM d) SELECT c_custkey, neighbour, rank, CAST(0.125 AS DOUBLE) AS weight FROM r WHERE rank <= 8""")
def q29_knn_row_standardised(spark, sf_dir):
    """The eight nearest customers of each, by place."""
    k = F.col("c_custkey")
    p = read(spark, sf_dir, "customer").select("c_custkey", ((k * 7919 % 10007).cast("double") / 7).alias("x"), ((k * 104729 % 9973).cast("double") / 11).alias("y"))
    return spatial.nearest_points(p, "c_custkey", 8)


@query("""WITH d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2)) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), neighbour) AS INT) AS rank FROM d) SELECT vec_id, neighbour, rank, CAST(0.125 AS DOUBLE) AS weight FROM r WHERE rank <= 8""")
def q29_nearest_vectors(spark, sf_dir):
    """The vectors whose id is divisible by 100 as queries against all vectors."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return spatial.nearest_vectors(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 8)


@query("""WITH t AS (SELECT c_custkey, CAST((c_custkey * 37) % 200 AS DOUBLE) AS x, CAST((c_custkey * 53) % 200 AS DOUBLE) AS y FROM customer), s AS (SELECT CAST((s_suppkey * 29) % 200 AS DOUBLE) AS x, CAST((s_suppkey * 41) % 200 AS DOUBLE) AS y, s_acctbal AS v FROM supplier),
j AS (SELECT c_custkey, v, sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2) AS d FROM t, s), n AS (SELECT c_custkey, sum(v / d) AS a, sum(v / (d * d)) AS b FROM j WHERE d > 0 AND d <= 40 GROUP BY 1)
SELECT c_custkey, round(coalesce(a, 0), 6) + 0.0 AS inv, round(coalesce(b, 0), 6) + 0.0 AS inv2 FROM t LEFT JOIN n USING (c_custkey)""")
def q30_idw_decay(spark, sf_dir):
    at = lambda k, a, b: [(F.col(k) * a % 200).cast("double").alias("x"), (F.col(k) * b % 200).cast("double").alias("y")]
    t = read(spark, sf_dir, "customer").select("c_custkey", *at("c_custkey", 37, 53))
    s = read(spark, sf_dir, "supplier").select(*at("s_suppkey", 29, 41), F.col("s_acctbal").alias("v"))
    return rounded(spatial.decay(t, s, "c_custkey", "v", 40.0), ["inv", "inv2"])


@query("""WITH b AS (SELECT n_name, (n_nationkey % 5) * 16 + 8.0 AS cx, (n_nationkey // 5) * 16 + 8.0 AS cy FROM nation)
SELECT a.n_name AS "from", b.n_name AS "to", CAST(a.cx AS DOUBLE) AS x, CAST(a.cy AS DOUBLE) AS y, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 6) AS distance FROM b a JOIN b b ON a.n_name < b.n_name""")
def q31_centroid_distance(spark, sf_dir):
    c = _boxes(spark, sf_dir).select("gid", spatial.centroid().alias("c")).select("gid", "c.*")
    a, b = c.alias("a"), c.alias("b")
    j = a.join(F.broadcast(b), F.col("a.gid") < F.col("b.gid"))
    return j.select(F.col("a.gid").alias("from"), F.col("b.gid").alias("to"), r6("a.x").alias("x"), r6("a.y").alias("y"), r6(spatial.planar_distance("a.x", "a.y", "b.x", "b.y")).alias("distance"))


_COARSE = "SELECT CAST(p_partkey % 40 AS INT) AS px, CAST((p_partkey // 40) % 20 AS INT) AS py, CAST(max(p_size) AS DOUBLE) AS v FROM part GROUP BY 1, 2"


def _coarse(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).cast("int").alias("px"), F.expr("cast(p_partkey div 40 % 20 as int)").alias("py")).agg(F.max("p_size").cast("double").alias("v"))


@query(f"SELECT CAST(px * 3 + i AS INT) AS px, CAST(py * 3 + j AS INT) AS py, v FROM ({_COARSE}), (SELECT unnest(range(3)) AS i) a, (SELECT unnest(range(3)) AS j) b")
def q32_nearest_resample(spark, sf_dir):
    return grid.upsample_nearest(_coarse(spark, sf_dir), 3, "v")


_KERNEL = "(CASE WHEN {t} <= 1 THEN (1.5 * {t} - 2.5) * {t} * {t} + 1 WHEN {t} < 2 THEN ((-0.5 * {t} + 2.5) * {t} - 4) * {t} + 2 ELSE 0 END)"


@query(f"""WITH c AS ({_COARSE}), f AS (SELECT x AS px, (x + 0.5) / 2 - 0.5 AS ax FROM (SELECT unnest(range(0, 80)) AS x)), g AS (SELECT y AS py, (y + 0.5) / 2 - 0.5 AS ay FROM (SELECT unnest(range(0, 40)) AS y)),
w AS (SELECT f.px, g.py, c.v, abs(ax - c.px) AS tx, abs(ay - c.py) AS ty FROM f, g, c WHERE c.px BETWEEN floor(ax) - 1 AND floor(ax) + 2 AND c.py BETWEEN floor(ay) - 1 AND floor(ay) + 2)
SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(sum(v * {_KERNEL.format(t='tx')} * {_KERNEL.format(t='ty')}), 6) AS v FROM w GROUP BY 1, 2 HAVING count(*) = 16""")
def q32_bicubic_resample(spark, sf_dir):
    return rounded(grid.upsample_bicubic(_coarse(spark, sf_dir), 2, "v"), ["v"])


# --- regression, text, series, joins -------------------------------------------


@query("""WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem)
SELECT 'const' AS term, round(a, 4) AS coefficient, round(r2, 6) AS r2, n FROM s UNION ALL SELECT 'l_quantity', round(b, 4), round(r2, 6), n FROM s""")
def q33_ols_normal_equations(spark, sf_dir):
    out = regress.ols(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return out.select("term", r6("coefficient", 4).alias("coefficient"), r6("r2").alias("r2"), "n")


@query("""WITH d AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, l_quantity AS a, l_discount * 100 AS b FROM lineitem), m AS (SELECT avg(y) AS y, avg(a) AS a, avg(b) AS b, count(*) AS n FROM d),
s AS (SELECT sum((d.a - m.a) ** 2) AS aa, sum((d.a - m.a) * (d.b - m.b)) AS ab, sum((d.b - m.b) ** 2) AS bb, sum((d.a - m.a) * (d.y - m.y)) AS ay, sum((d.b - m.b) * (d.y - m.y)) AS by_ FROM d, m),
k AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q, aa * bb - ab * ab AS det, aa, ab, bb FROM s),
e AS (SELECT d.a - m.a AS a, d.b - m.b AS b, (d.y - m.y - p * (d.a - m.a) - q * (d.b - m.b)) / (1 - 1.0 / n - (bb * (d.a - m.a) ** 2 - 2 * ab * (d.a - m.a) * (d.b - m.b) + aa * (d.b - m.b) ** 2) / det) AS u FROM d, m, k),
v AS (SELECT sum(((bb * a - ab * b) / det) ** 2 * u * u) AS va, sum(((aa * b - ab * a) / det) ** 2 * u * u) AS vb FROM e, k)
SELECT 'a' AS term, round(p, 4) AS coefficient, round(sqrt(va), 4) AS se FROM k, v UNION ALL SELECT 'b', round(q, 4), round(sqrt(vb), 4) FROM k, v""")
def q33_ols_hc3(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"))
    return regress.ols(d, "y", ["a", "b"]).where("term <> 'const'").select("term", r6("coefficient", 4).alias("coefficient"), r6("se", 4).alias("se"))


_POSITIVES = ["-----BEGIN RSA PRIVATE KEY-----", "key AIza" + "b" * 30, "sk-" + "A1" * 12, "api_key = 'abcdefghijklmnop'", "nothing here", "client-secret='short'"]


@query(f"""WITH t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'fixture', i - 1, l[i] FROM (SELECT [{", ".join("'" + x.replace("'", "''") + "'" for x in _POSITIVES)}] AS l, unnest(range(1, {len(_POSITIVES) + 1})) AS i))
SELECT kind, id, CASE {" ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in text.SECRETS)} END AS secret FROM t""")
def q34_secret_scan(spark, sf_dir):
    fixture = spark.createDataFrame([("fixture", i, x) for i, x in enumerate(_POSITIVES)], "kind string, id long, text string")
    docs = read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(fixture).select("kind", "id", text.secret_kind("text").alias("secret"))


def _local_sql(year: bool) -> str:
    y = ", CAST(year(l) AS INT) AS year" if year else ""
    return f"""SELECT user_id{y}, CAST(month(l) AS INT) AS month, round(avg(k), 6) AS k FROM (SELECT user_id, ts + INTERVAL 7 HOUR AS l, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY {'1, 2, 3' if year else '1, 2'}"""


@query(_local_sql(False))
def q35_json_nested_series(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("dt"), F.from_json("props", "k bigint")["k"].alias("k"))
    out = composite.group_mean(e.withColumn("month", dates.local_month("dt")), ["user_id", "month"], "k")
    return rounded(out, ["k"])


@query("""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 2 = 0)
SELECT 'inner' AS kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM c JOIN o USING (k) UNION ALL SELECT 'left', count(*), CAST(sum(c.k) AS BIGINT) FROM c LEFT JOIN o ON c.k = o.k UNION ALL SELECT 'full', count(*), CAST(sum(coalesce(c.k, o.k)) AS BIGINT) FROM c FULL JOIN o ON c.k = o.k
UNION ALL SELECT 'left_semi', count(*), CAST(sum(k) AS BIGINT) FROM c WHERE k IN (SELECT k FROM o) UNION ALL SELECT 'left_anti', count(*), CAST(sum(k) AS BIGINT) FROM c WHERE k NOT IN (SELECT k FROM o)""")
def q36_joins(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    o = read(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("k")).distinct()
    out = [c.join(o, "k", kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("k").alias("keys")) for kind in ("inner", "left", "full", "left_semi", "left_anti")]
    return assemble.strict_union(out)


@query(f"""SELECT px, py, month, round(avg(v), 6) + 0.0 AS ndvi, round(avg(w), 6) + 0.0 AS rvi FROM (SELECT {PX} AS px, {PY} AS py, strftime(l_shipdate, '%Y-%m') AS month, (l_quantity - (l_discount * 100 + 1)) / nullif(l_quantity + (l_discount * 100 + 1), 0) AS v, 4 * l_discount / nullif(l_tax + 0.01 + l_discount, 0) AS w FROM lineitem) GROUP BY 1, 2, 3""")
def q37_handoff_rename(spark, sf_dir):
    df = windows.with_month(pixels(spark, sf_dir), "ts", "full").withColumns({"NDVI": indices.ndvi("nir", "red"), "RVI": indices.rvi("vv", "vh")})
    return rounded(panel.handoff_names(composite.composite(df, ["px", "py", "month"], {"NDVI": ["mean"], "RVI": ["mean"]})), ["ndvi", "rvi"])


@query("""SELECT n_nationkey, sha256(CAST(to_json([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)]) AS VARCHAR)) AS sha256 FROM nation""")
def q38_manifest_hash(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", text.signature(["n_nationkey", "n_name", "n_regionkey"]).alias("sha256"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, last_day(d) AS month_end, last_day(CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE)) AS previous_month_end, strftime(d, '%Y%W') AS week, CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE) AS sunday, CAST(date_trunc('week', d) + INTERVAL 5 DAY AS DATE) AS saturday,
strftime(last_day(d) - INTERVAL 6 DAY, '%Y%W') AS last_week, d = last_day(d) AS is_end, dayofweek(d) = 0 AS is_sunday, CAST(date_trunc('month', d) - INTERVAL 2 MONTH AS DATE) AS first_of_three, CAST(day(last_day(d)) AS INT) AS days FROM d""")
def q39_date_helpers(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().withColumn("m", dates.month_label("d"))
    return d.select("d", dates.last_day_of("m").alias("month_end"), dates.last_day_of("m", -1).alias("previous_month_end"), dates.week_label("d").alias("week"), dates.week_end("d").alias("sunday"), dates.week_end("d", 5).alias("saturday"), dates.last_week_of_month("m").alias("last_week"), dates.is_month_end("d").alias("is_end"), dates.is_sunday("d").alias("is_sunday"), dates.month_start(F.element_at(dates.previous_months("m", 3), 1)).alias("first_of_three"), F.size(dates.days_of_month("m")).alias("days"))


_SEASON_SQL = ", ".join(f"('{s}', '{a}', '{b}')" for s, (a, b) in windows.SEASONS.items())


@query(f"""WITH s AS (SELECT s, y, TRY_CAST(concat(y, '-', a) AS DATE) AS first, TRY_CAST(concat(y, '-', b) AS DATE) AS last FROM (VALUES {_SEASON_SQL}) AS v(s, a, b), (SELECT unnest(range(1995, 2002)) AS y))
SELECT s AS season, CAST(y AS INT) AS year, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders JOIN s ON CAST(o_orderdate AS DATE) BETWEEN first AND last GROUP BY 1, 2""")
def q40_season_windows(spark, sf_dir):
    w = windows.season_windows(spark, list(range(1995, 2002)))
    o = windows.join_seasons(read(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice"), w, "o_orderdate")
    return o.groupBy("season", "year").agg(F.count("*").alias("n"), r6(F.avg("o_totalprice"), 4).alias("mean_price"))


# --- detections, night lights and the rest -------------------------------------

_RAW = """SELECT event_id, CAST(event_id % 100 AS DOUBLE) * 0.9 AS latitude, CAST(user_id % 100 AS DOUBLE) AS longitude, value AS frp, CAST(ts AS DATE) AS acq_date, CASE WHEN event_id % 2 = 0 THEN 'T' ELSE 'Aqua' END AS satellite, CAST(event_id % 110 AS DOUBLE) AS confidence FROM events"""


def _raw(spark, sf_dir) -> DataFrame:
    k, s = F.col("event_id"), lambda c: c.cast("string")
    return read(spark, sf_dir, "events").select(s(k).alias("event_id"), s((k % 100).cast("double") * 0.9).alias("latitude"), s((F.col("user_id") % 100).cast("double")).alias("longitude"), F.lit("300.5").alias("brightness"), F.lit("290").alias("bright_t31"), s(F.col("value")).alias("frp"), s(F.col("ts").cast("date")).alias("acq_date"), F.format_string("%d", k % 60).alias("acq_time"), F.when(k % 2 == 0, "T").otherwise("Aqua").alias("satellite"), s(k % 110).alias("confidence"), F.lit("61").alias("version"))


@query(f"""WITH r AS ({_RAW}), g AS (SELECT * FROM r WHERE confidence <= 100 AND frp >= 0 AND acq_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'),
b AS (SELECT n_name AS gid, (n_nationkey % 5) * 16 AS x, (n_nationkey // 5) * 16 AS y FROM nation), h AS (SELECT event_id, min(gid) AS gid FROM g JOIN b ON longitude BETWEEN x AND x + 16 AND latitude BETWEEN y AND y + 16 GROUP BY 1)
SELECT CAST(event_id AS VARCHAR) AS event_id, latitude AS lat, longitude AS lon, gid AS gid_1, CASE WHEN satellite = 'T' THEN 'Terra' ELSE 'Aqua' END AS satellite, lpad(CAST(event_id % 60 AS VARCHAR), 4, '0') AS acq_time, CAST(year(acq_date) AS INT) AS year, CAST(month(acq_date) AS INT) AS mon FROM g LEFT JOIN h USING (event_id)""")
def q41_detections_prepared(spark, sf_dir):
    rows = ingest.prepared(_raw(spark, sf_dir), _boxes(spark, sf_dir), "2024-01-05", "2024-01-20", ["event_id"], "keep")
    return rows.select("event_id", "lat", "lon", "gid_1", "satellite", "acq_time", "year", "mon")


@query(f"""WITH r AS ({_RAW}) SELECT problem, count(*) AS n FROM (SELECT CASE WHEN NOT frp >= 0 THEN 'frp' WHEN confidence > 100 THEN 'confidence' END AS problem FROM r) GROUP BY 1""")
def q42_detection_problems(spark, sf_dir):
    return ingest.normalized(_raw(spark, sf_dir)).groupBy("problem").agg(F.count("*").alias("n"))


@query("""SELECT event_id, round(CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 7 = 1 OR event_id % 200 > 150 OR raw >= 65535 THEN NULL ELSE greatest(raw, 0) * 0.1 END, 6) AS radiance FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 17 = 0 THEN 70000 ELSE value - 20 END AS raw FROM events)""")
def q43_night_light_cleaning(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 13 == 0, F.lit(float("nan"))).when(k % 17 == 0, 70000.0).otherwise(F.col("value") - 20)
    return read(spark, sf_dir, "events").select("event_id", r6(quality.night_light(raw, F.when(k % 7 == 1, 1).otherwise(0), (k % 200).cast("double"), F.when(k % 11 == 0, 0.0).otherwise(1.0))).alias("radiance"))


@query("""WITH k AS (SELECT unnest(range(12)) AS m, CAST(n_nationkey AS INT) AS t FROM nation), f AS (SELECT DISTINCT CAST(month(o_orderdate) - 1 AS INT) AS m, CAST(o_custkey % 25 AS INT) AS t FROM orders WHERE (o_custkey + month(o_orderdate)) % 5 <> 0)
SELECT CAST(k.m AS INT) AS m, k.t FROM k LEFT JOIN f ON f.m = k.m AND f.t = k.t WHERE f.t IS NULL""")
def q44_missing_granules(spark, sf_dir):
    tiles = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("t"))
    needed = windows.tiles_by_month(tiles, spark.range(12).select(F.col("id").cast("int").alias("m")))
    found = read(spark, sf_dir, "orders").where("(o_custkey + month(o_orderdate)) % 5 <> 0").select((F.month("o_orderdate") - 1).alias("m"), (F.col("o_custkey") % 25).cast("int").alias("t"))
    return assemble.missing_keys(needed, found, ["m", "t"]).select("m", "t")


@query("""WITH t AS (SELECT p_partkey AS tile, (p_partkey * 37) % 4000 AS x, (p_partkey * 61) % 3000 AS y FROM part)
SELECT a.tile AS a, b.tile AS b FROM t a JOIN t b ON a.tile < b.tile AND a.x < b.x + 150 AND b.x < a.x + 150 AND a.y < b.y + 90 AND b.y < a.y + 90""")
def q45_tile_overlaps(spark, sf_dir):
    t = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("tile"), (F.col("p_partkey") * 37 % 4000).alias("x"), (F.col("p_partkey") * 61 % 3000).alias("y"), F.lit(150).alias("w"), F.lit(90).alias("h"))
    return grid.overlaps(t, block=256)


@query("""SELECT c_custkey, round(lag(o_totalprice) OVER (PARTITION BY c_custkey ORDER BY o_orderkey), 2) AS lagged, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey""")
def q46_lagged_feature(spark, sf_dir):
    j = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(read(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(panel.lagged(j, ["c_custkey"], "o_orderkey", "o_totalprice", "lagged"), ["lagged"], 2).select("c_custkey", "lagged", "o_orderkey")


@query("""SELECT n_name, CASE WHEN (n_nationkey % 5) * 16 <= 20 AND (n_nationkey % 5) * 16 + 16 >= 10 AND (n_nationkey // 5) * 16 <= 40 AND (n_nationkey // 5) * 16 + 16 >= 32 THEN true ELSE false END AS meets FROM nation""")
def q47_boxes_meeting(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    window = spark.createDataFrame([(10.0, 32.0, 20.0, 40.0)], "west double, south double, east double, north double")
    hit = spatial.boxes_meeting(b, window, 16.0).select("gid", F.lit(True).alias("meets"))
    return b.join(hit, "gid", "left").select(F.col("gid").alias("n_name"), F.coalesce("meets", F.lit(False)).alias("meets"))


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 100""")
def q48_top_frequent(spark, sf_dir):
    return composite.top_frequent(read(spark, sf_dir, "orders"), "o_custkey", 100)


@query(f"""WITH c AS ({_COARSE}), j AS (SELECT a.px, a.py, b.v, abs(b.v - a.v) <= abs(a.v) AS inside, abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 AS next FROM c a JOIN c b ON abs(a.px - b.px) <= 2 AND abs(a.py - b.py) <= 2)
SELECT px, py, round(CASE WHEN count_if(inside) >= 4 THEN avg(CASE WHEN inside THEN v END) ELSE avg(CASE WHEN next THEN v END) END, 6) AS v FROM j GROUP BY 1, 2""")
def q49_sigma_filter(spark, sf_dir):
    return rounded(grid.sigma_filter(_coarse(spark, sf_dir), "v", radius=2, looks=4.0).select("px", "py", "v"), ["v"])


@query("""WITH b AS (SELECT n_name AS gid, n_nationkey % 5 AS i, n_nationkey // 5 AS j FROM nation)
SELECT gid, CAST(i * 16 + 4 * x AS DOUBLE) + 2 AS lon, CAST(j * 16 + 16 - 4 * y AS DOUBLE) - 2 AS lat FROM b, (SELECT unnest(range(4)) AS x) p, (SELECT unnest(range(4)) AS y) q""")
def q50_grid_points(spark, sf_dir):
    boxes = spatial.with_box(_boxes(spark, sf_dir)).select("gid", "west", "south", "east", "north")
    return grid.grid_points(boxes, 4.0, ["gid"]).select("gid", "lon", "lat")


@query("""WITH e AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, value FROM events) SELECT week, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2""")
def q51_weekly_windows(spark, sf_dir):
    """The batch form of the stream's windows: seven days from Mondays."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), "event_type").agg(F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total"))
    return out.select(F.to_date("w.start").alias("week"), "event_type", "n", "total")
