"""More queries of the catalogue: files written and read back, checks, and the operators that the first part leaves out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, indices, quality, text
from ..operators import assemble, compare, composite, grid, ingest, panel, spatial
from ..sources import raster, readers, scratch, writers
from ..streaming import replay
from .catalogue import _RAW, _boxes, _raw, query, r6, read, rounded

# --- files written and read back -----------------------------------------------


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
def q52_csv_files(spark, sf_dir):
    path = scratch.folder(spark, "csv")
    writers.write_csv(read(spark, sf_dir, "customer").repartition(3), path, ["c_custkey", "c_mktsegment", "c_acctbal", "c_name"])
    files = readers.expand(spark, [f"{path}/part-*"])
    back = readers.read_csv(spark, files, ("c_custkey", "c_acctbal"), "c_custkey bigint, c_acctbal double", ["c_mktsegment", "c_acctbal"])
    return back.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), r6(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_orderpriority AS tile, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03' GROUP BY 1")
def q53_tile_month_folders(spark, sf_dir):
    """A folder per tile and month; reading a month opens its folders only."""
    path = scratch.folder(spark, "tiles")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tile_id"), dates.month_label("o_orderdate").alias("month"), "o_totalprice").where("month between '1996-01' and '1996-06'")
    writers.write_by_tile_month(o, path, ["o_totalprice"])
    back = spark.read.parquet(path).where("month = '1996-03'")
    return back.groupBy(F.col("tile_id").alias("tile")).agg(F.count("*").alias("n"), r6(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT r_name AS country, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def q54_json_records(spark, sf_dir):
    path = scratch.folder(spark, "records")
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("country"))
    writers.write_records(n, path)
    return spark.read.schema("n_nationkey bigint, country string").json(path).groupBy("country").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


@query("SELECT n_name AS gid, CAST(n_regionkey AS VARCHAR) AS country, CAST((n_nationkey % 5) * 16 AS DOUBLE) AS west, CAST((n_nationkey // 5) * 16 AS DOUBLE) AS south, CAST((n_nationkey % 5) * 16 + 16 AS DOUBLE) AS east, CAST((n_nationkey // 5) * 16 + 16 AS DOUBLE) AS north FROM nation")
def q55_geojson_file(spark, sf_dir):
    """Nations' boxes as a FeatureCollection, read back."""
    path = scratch.folder(spark, "geojson")
    boxes = _boxes(spark, sf_dir).join(read(spark, sf_dir, "nation").select(F.col("n_name").alias("gid"), F.col("n_regionkey").cast("string").alias("country")), "gid")
    features = writers.geojson_features(boxes, ["gid", "country"])
    whole = features.groupBy().agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]}")).alias("value"))
    whole.coalesce(1).write.text(path)
    return spatial.with_box(readers.read_geojson(spark, f"{path}/part-*", "gid", "country")).drop("rings")


@query("""SELECT format('N{:02d}E{:03d}_{}_{}', k % 60, k % 180, k % 2, (k // 2) % 2) AS tile_id, CAST(k % 180 AS DOUBLE) AS west, CAST(k % 60 AS DOUBLE) AS south, k % 180 + 0.5::DOUBLE AS east, k % 60 + 0.5::DOUBLE AS north FROM (SELECT DISTINCT s_suppkey % 100 AS k FROM supplier)""")
def q56_tile_map_file(spark, sf_dir):
    path, k = scratch.folder(spark, "tilemap"), F.col("k")
    tiles = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 100).alias("k")).distinct()
    named = tiles.select(F.format_string("N%02dE%03d_%d_%d", k % 60, k % 180, k % 2, F.expr("k div 2 % 2")).alias("tile"), F.array(k % 180, k % 60, k % 180 + F.lit(0.5), k % 60 + F.lit(0.5)).alias("b"))
    named.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("tile", "b")))).alias("value")).coalesce(1).write.text(path)
    return readers.read_tiles(spark, f"{path}/part-*")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region")
def q57_flat_records(spark, sf_dir):
    """One JSON object to a file."""
    path = scratch.folder(spark, "flat")
    r = read(spark, sf_dir, "region").select(F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))).alias("value"))
    r.write.option("maxRecordsPerFile", 1).text(path)
    return readers.records_table(readers.read_records(spark, [f"{path}/part-*"])).drop("file")


@query("SELECT sha256(t) AS sha256, CAST(strlen(t) AS BIGINT) AS bytes FROM (SELECT 'n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey) AS t FROM nation)")
def q38_manifest_of_files(spark, sf_dir):
    """Size and SHA-256 of a written file."""
    path = scratch.folder(spark, "manifest")
    writers.write_csv(read(spark, sf_dir, "nation").orderBy("n_nationkey"), path, ["n_nationkey", "n_name"], single=True)
    return writers.hashes(spark, path, "part-*").select("sha256", "bytes")


@query("SELECT CAST(count(*) AS BIGINT) AS rows FROM (SELECT ntile(1) OVER () FROM nation UNION ALL SELECT 1 FROM region)")
def q58_rows_by_input(spark, sf_dir):
    """Rows counted by the files they come from, added up."""
    both = [read(spark, sf_dir, t) for t in ("nation", "region")]
    return assemble.strict_union([assemble.rows_by_input(t) for t in both]).agg(F.sum("rows").alias("rows"))


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN format('h{:02d}v{:02d}', event_id % 36, event_id % 18) END AS tile, CASE WHEN event_id % 9 <> 0 THEN CAST(ts AS DATE) END AS month, CASE WHEN event_id % 9 <> 0 THEN '001' END AS version FROM events""")
def q59_granule_names(spark, sf_dir):
    k, day = F.col("event_id"), F.to_date("ts")
    name = F.format_string("%s.A%d%03d.h%02dv%02d.001.2024.h5", F.when(k % 9 == 0, "OTHER").otherwise("VNP46A3"), F.year(day), F.dayofyear(day), k % 36, k % 18)
    return readers.granules(read(spark, sf_dir, "events").select("event_id", name.alias("file"))).select("event_id", "tile", "month", "version")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_custkey % 360 BETWEEN 100 AND 110 AND o_custkey % 90 BETWEEN 0 AND 20 AND o_orderstatus IN ('F', 'O') AND o_orderkey % 2 = 0 GROUP BY 1""")
def q60_collection(spark, sf_dir):
    """Orders as a collection with place, mode and bands, filtered by date, bounds and properties."""
    path = scratch.folder(spark, "collection")
    k = F.col("o_custkey")
    bands = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("VV")))
    read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), (k % 360).cast("double").alias("lon"), (k % 90).cast("double").alias("lat"), F.col("o_orderstatus").alias("mode"), bands.alias("bands")).write.parquet(path)
    found = readers.collection(spark, path, "1996-01-01", "1997-01-01", (100, 0, 110, 20), {"mode": ["F", "O"]}, {"bands": ["VV", "VH"]})
    return found.groupBy(dates.month_label("ts").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT tile, CAST(count(*) AS BIGINT) AS cells, round(sum(v), 4) AS total, round(min(tile * 2.0 + (px + 0.5) * 0.1), 6) AS first_lon, round(max(50 - (py + 0.5) * 0.1), 6) AS first_lat FROM (SELECT p_partkey // 200 AS tile, p_partkey % 20 AS px, (p_partkey % 200) // 20 AS py, p_retailprice AS v FROM part WHERE p_size % 9 <> 0) GROUP BY 1""")
def q73_raster_files(spark, sf_dir):
    """Parts as GeoTIFF tiles of 20 x 10 cells, some without data, written and read back."""
    path, k = scratch.folder(spark, "rasters"), F.col("p_partkey")
    tile = F.expr("p_partkey div 200")
    cells = read(spark, sf_dir, "part").select(tile.alias("tile"), (k % 20).cast("int").alias("px"), F.expr("cast(p_partkey % 200 div 20 as int)").alias("py"), (tile * 2.0).alias("west"), F.lit(50.0).alias("north"), F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("v"))
    raster.write_tiles(raster.encode_tiles(cells, "tile", ["v"], 20, 10, 0.1, 0.1, kind="float64"), path)
    back = raster.read_cells(spark, path, pattern="part-*")
    # a tile's number is in its place, as the files' names are the writer's
    named = back.withColumn("tile", F.floor(F.col("lon") / 2).cast("long"))
    return named.groupBy("tile").agg(F.count("*").alias("cells"), r6(F.sum("value"), 4).alias("total"), r6(F.min("lon")).alias("first_lon"), r6(F.max("lat")).alias("first_lat"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT start, event_type, n, total FROM w WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def q74_stream_windows(spark, sf_dir):
    """Events as a stream in windows of seven days; those that the watermark has passed."""
    schema = read(spark, sf_dir, "events").select("event_type", "value", "ts").schema
    path = scratch.folder(spark, "events")
    read(spark, sf_dir, "events").select("event_type", "value", "ts").coalesce(1).write.parquet(path)
    out, state = scratch.folder(spark, "windows"), scratch.folder(spark, "state")
    replay.drain(replay.windowed(replay.events(spark, path, schema), ["event_type"], "value"), out, state)
    back = spark.read.parquet(out)
    return back.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("total", 4).alias("total"))


# --- checks and comparisons ------------------------------------------------------


@query("""WITH f AS (SELECT l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000) SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, count(*) AS rows, 'repeated' AS problem FROM f GROUP BY 1 HAVING count(*) > 1""")
def q18_dup_key_first_rows(spark, sf_dir):
    """Repeats among the first thousand rows, which is what the bounded check is for."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("l_suppkey"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("s"))
    return assemble.key_report(rows, ["l_suppkey"], 1000, ["l_orderkey", "l_linenumber", "l_partkey", "s"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def q25_described(spark, sf_dir):
    return rounded(compare.described(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), ["mean", "std", "q25", "q50", "q75"])


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def q25_value_counts(spark, sf_dir):
    return compare.value_counts(read(spark, sf_dir, "customer"), "c_mktsegment")


@query(f"""WITH r AS ({_RAW}) SELECT CASE WHEN satellite = 'T' THEN 'Terra' ELSE 'Aqua' END AS satellite, count(*) AS rows, CAST(count_if(NOT frp >= 0 OR confidence > 100) AS BIGINT) AS bad FROM r GROUP BY 1""")
def q42_counters_by_satellite(spark, sf_dir):
    return ingest.by_satellite(_raw(spark, sf_dir))


@query("""SELECT o_orderkey, 'missing' AS kind, CAST(NULL AS VARCHAR) AS "column" FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'changed', 'o_totalprice' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0""")
def q24_records_against_rows(spark, sf_dir):
    """Every seventh order as a record, against a table that lacks some and has others dearer; its own further rows don't matter."""
    o, k = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey")
    rows = o.where(k % 3 != 0).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 2 == 0, 0.5).otherwise(0.0))
    return compare.records_against(o.where(k % 7 == 0), rows, ["o_orderkey"], ["o_totalprice"]).select("o_orderkey", "kind", "column")


@query("""SELECT CAST(p_partkey AS BIGINT) AS tile FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 14 = 0""")
def q61_misaligned_tiles(spark, sf_dir):
    k = F.col("p_partkey")
    tiles = read(spark, sf_dir, "part").select(k.alias("tile"), (k * 0.25 + F.when(k % 9 == 0, 0.1).otherwise(0.0)).alias("west"), (k * 0.5 + F.when(k % 14 == 0, 0.07).otherwise(0.0)).alias("north"))
    return grid.misaligned(tiles, "tile", "west", "north", 0.25)


@query("""WITH c AS (SELECT c_custkey % 11 AS k FROM customer WHERE c_custkey % 5 <> 0), s AS (SELECT s_suppkey % 13 AS k FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT 'both' AS kind, k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'left', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'right', k FROM (SELECT k FROM s EXCEPT SELECT k FROM c)""")
def q62_key_sets(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select((F.col("c_custkey") % 11).alias("k"))
    s = read(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select((F.col("s_suppkey") % 13).alias("k"))
    return assemble.strict_union([df.select(F.lit(name).alias("kind"), "k") for name, df in (("both", c.intersect(s)), ("left", c.subtract(s)), ("right", s.subtract(c)))])


@query("SELECT s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal, (SELECT count(*) FROM supplier) > 10 AS more FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def q63_first_rows(spark, sf_dir):
    """The ten largest balances, and whether there are more rows."""
    s = read(spark, sf_dir, "supplier").withColumn("__order", -F.col("s_acctbal"))
    first, more = assemble.truncated(s, 10, ["__order", "s_suppkey"])
    return first.select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"), F.lit(more).alias("more"))


# --- grids and panels -------------------------------------------------------------


@query("""WITH m AS (SELECT p_partkey % 10 AS mx, (p_partkey // 10) % 5 AS my, CAST(max(p_size) AS INT) AS class FROM part GROUP BY 1, 2),
g AS (SELECT CAST(x AS INT) AS px, CAST(y AS INT) AS py FROM (SELECT unnest(range(36)) AS x), (SELECT unnest(range(20)) AS y))
SELECT px, py, class FROM g LEFT JOIN m ON mx = CAST(floor((px + 0.5) * 0.3) AS INT) AND my = CAST(floor((py + 0.5) * 0.3) AS INT)""")
def q64_mask_on_other_grid(spark, sf_dir):
    """A mask of 10 x 5 cells warped to cells 0.3 times as wide, of which some lie beyond it."""
    mask = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 10).cast("int").alias("px"), F.expr("cast(p_partkey div 10 % 5 as int)").alias("py")).agg(F.max("p_size").cast("int").alias("class"))
    cells = spark.range(36 * 20).select((F.col("id") % 36).cast("int").alias("px"), F.expr("cast(id div 36 as int)").alias("py"))
    return grid.warp_mask(cells, mask, 0.0, 100.0, 0.3, 0.0, 100.0, 1.0, "class")


@query("""SELECT l.l_partkey % 50 AS px, strftime(l_shipdate, '%Y-%m') AS month, round(avg(l_quantity), 6) AS v, max(e) AS elevation FROM lineitem l LEFT JOIN (SELECT p_partkey % 50 AS k, CAST(max(p_size) AS INT) AS e FROM part WHERE p_partkey % 50 < 40 GROUP BY 1) ON k = l.l_partkey % 50 GROUP BY 1, 2""")
def q65_static_band(spark, sf_dir):
    """Elevation, which has no time, beside each month's mean."""
    monthly = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("px"), dates.month_label("l_shipdate").alias("month")).agg(r6(F.avg("l_quantity")).alias("v"))
    static = read(spark, sf_dir, "part").where("p_partkey % 50 < 40").groupBy((F.col("p_partkey") % 50).alias("px")).agg(F.max("p_size").cast("int").alias("elevation"))
    return panel.with_static(monthly, static, ("px",))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_custkey AS BIGINT) AS o_custkey FROM orders")
def q66_aligned_columns(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return panel.aligned([o.select("o_orderkey", "o_orderstatus"), o.repartition(3).select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_custkey")], ["o_orderkey"])


@query("""WITH n AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1)
SELECT c_custkey, c_mktsegment AS plot_category, CAST(CASE WHEN r > 1 THEN r - 2 END AS INT) AS plot_index FROM customer JOIN n ON s = c_mktsegment""")
def q27_all_plot_dummies(spark, sf_dir):
    """Fewer plots than the bound: each but the most frequent has a dummy."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("plot_id"))
    return panel.plot_dummies(c, "plot_id", 1000).select("c_custkey", "plot_category", "plot_index")


@query("""WITH b AS (SELECT o_orderkey AS k, o_totalprice AS ndvi FROM orders WHERE o_orderkey % 3 <> 0), e AS (SELECT o_orderkey AS k, CAST(o_custkey AS BIGINT) AS et FROM orders WHERE o_orderkey % 5 <> 0),
r AS (SELECT o_orderkey AS k, o_custkey % 4 AS rvi FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT o_orderkey AS k, o_orderstatus AS crop FROM orders WHERE o_orderstatus <> 'P')
SELECT k, ndvi, et, CAST(rvi AS INT) AS rvi, crop FROM b JOIN e USING (k) LEFT JOIN r USING (k) JOIN c USING (k)""")
def q67_assembled_panel(spark, sf_dir):
    """Two parts united, a full join, a left join, rows with all that is needed, crops."""
    o = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    part = lambda m: o.where(f"k % 3 = {m}").select("k", F.col("o_totalprice").alias("ndvi"))
    extra = o.where("k % 5 <> 0").select("k", F.col("o_custkey").alias("et"))
    radar = o.where("k % 2 = 0").select("k", (F.col("o_custkey") % 4).cast("int").alias("rvi"))
    return panel.assemble([part(1), part(2)], extra, radar, o.where("o_orderstatus <> 'P'").select("k", F.col("o_orderstatus").alias("crop")), ["k"], ["ndvi", "et"])


# --- geometry ----------------------------------------------------------------------


@query("""WITH p AS (SELECT c_custkey, CAST((c_custkey * 37) % 97 AS DOUBLE) / 2 AS x, CAST((c_custkey * 53) % 89 AS DOUBLE) / 2 AS y FROM customer),
d AS (SELECT s AS k, s * 9.0 + 6 AS cx, 20.0 + s AS cy FROM (SELECT unnest(range(4)) AS s)), h AS (SELECT c_custkey, min('d' || k) AS gid, CAST(count(*) AS INT) AS matches FROM p JOIN d ON abs(x - cx) + abs(y - cy) <= 10 AND abs(x - cx) + abs(y - cy) >= 4 GROUP BY 1)
SELECT p.c_custkey, gid, coalesce(matches, 0) AS matches FROM p LEFT JOIN h USING (c_custkey)""")
def q21_oblique_polygons(spark, sf_dir):
    """Diamonds with a diamond hole, which overlap: oblique edges, holes, and points in several of them."""
    ring = lambda cx, cy, r: F.array(*[F.struct((cx + dx * r).alias("x"), (cy + dy * r).alias("y")) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))])
    cx, cy = F.col("id") * 9.0 + 6, F.col("id") + F.lit(20.0)
    shapes = spark.range(4).select(F.concat(F.lit("d"), F.col("id")).alias("gid"), F.array(ring(cx, cy, 10.0), ring(cx, cy, 4.0)).alias("rings"))
    p = read(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 97).cast("double") / 2).alias("lon"), ((F.col("c_custkey") * 53 % 89).cast("double") / 2).alias("lat"))
    return spatial.point_in_polygon(p, shapes, size=4.0).select("c_custkey", "gid", "matches")


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 37) % 3600 / 10.0::DOUBLE - 180 AS lon, (c_custkey * 53) % 1400 / 10.0::DOUBLE - 70 AS lat FROM customer), m AS (SELECT *, radians(lon) * 6378137.0 AS x, ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0 AS y FROM p)
SELECT c_custkey, round(degrees((x - 250) / 6378137.0), 9) AS west, round(degrees(2 * atan(exp((y - 250) / 6378137.0)) - pi() / 2), 9) AS south, round(degrees((x + 250) / 6378137.0), 9) AS east, round(degrees(2 * atan(exp((y + 250) / 6378137.0)) - pi() / 2), 9) AS north FROM m""")
def q68_square_buffers(spark, sf_dir):
    """The box of a buffer of 250 projected metres about each customer."""
    p = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 3600 / 10.0 - 180).alias("lon"), (F.col("c_custkey") * 53 % 1400 / 10.0 - 70).alias("lat"))
    boxes = spatial.with_box(p.withColumn("rings", spatial.buffer("lon", "lat", F.lit(250.0), "square")))
    return rounded(boxes.select("c_custkey", "west", "south", "east", "north"), ["west", "south", "east", "north"], 9)


@query("""WITH k AS (SELECT 6378137.0::DOUBLE AS a, (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e2), c AS (SELECT n_name AS gid, 100 + (n_nationkey % 5) * 2 + 1.0::DOUBLE AS lon, 8 + (n_nationkey // 5) * 3 + 1.5::DOUBLE AS lat FROM nation),
t AS (SELECT gid, a, e2, e2 / (1 - e2) AS ep2, radians(lat) AS phi, a / sqrt(1 - e2 * sin(radians(lat)) ** 2) AS n, tan(radians(lat)) ** 2 AS t, e2 / (1 - e2) * cos(radians(lat)) ** 2 AS c, cos(radians(lat)) * radians(lon - 105) AS d FROM c, k),
m AS (SELECT *, a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - 35 * e2 ** 3 / 3072 * sin(6 * phi)) AS m FROM t),
p AS (SELECT gid, 0.9996 * n * (d + (1 - t + c) * d ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * c - 58 * ep2) * d ** 5 / 120) + 500000 AS x, 0.9996 * (m + n * tan(phi) * (d ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * d ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * c - 330 * ep2) * d ** 6 / 720)) AS y FROM m)
SELECT f.gid AS "from", g.gid AS "to", round(sqrt((f.x - g.x) ** 2 + (f.y - g.y) ** 2) / 1000, 6) AS km FROM p f JOIN p g ON f.gid < g.gid""")
def q31_projected_distance(spark, sf_dir):
    """Kilometres between the centroids of boxes in degrees, in the transverse Mercator projection about 105 degrees east."""
    k = F.col("n_nationkey")
    x, y = k % 5 * 2 + 100, F.floor(k / 5) * 3 + 8
    boxes = read(spark, sf_dir, "nation").select(F.col("n_name").alias("gid"), spatial.box(x, y, x + 2, y + 3).alias("rings"))
    p = boxes.select("gid", spatial.centroid().alias("c")).select("gid", spatial.utm("c.x", "c.y").alias("m")).select("gid", "m.x", "m.y")
    a, b = p.alias("a"), F.broadcast(p.alias("b"))  # a row per nation
    return a.join(b, F.col("a.gid") < F.col("b.gid")).select(F.col("a.gid").alias("from"), F.col("b.gid").alias("to"), r6(spatial.planar_distance("a.x", "a.y", "b.x", "b.y") / 1000).alias("km"))


@query()
def q68_utm_boxes(spark, sf_dir):
    """The box of a buffer of five UTM metres about each customer; without SQL, as DuckDB would need the whole series of both projections."""
    p = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 60 / 10.0 + 102).alias("lon"), (F.col("c_custkey") * 53 % 300 / 10.0).alias("lat"))
    return p.select("c_custkey", spatial.utm_box("lon", "lat").alias("b")).select("c_custkey", "b.*")


@query("""SELECT p_partkey, CAST(100 + px * 0.05 AS DOUBLE) AS west, CAST(20 - (py + 1) * 0.05 AS DOUBLE) AS south, CAST(100 + (px + 1) * 0.05 AS DOUBLE) AS east, CAST(20 - py * 0.05 AS DOUBLE) AS north FROM (SELECT p_partkey, p_partkey % 40 AS px, p_partkey // 40 AS py FROM part)""")
def q69_cell_boxes(spark, sf_dir):
    cells = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("px"), F.expr("p_partkey div 40").alias("py"))
    return cells.select("p_partkey", grid.cell_bounds("px", "py", 100.0, 20.0, 0.05, 0.05).alias("b")).select("p_partkey", "b.*")


@query("""SELECT min(x) AS west, min(y) AS south, max(x + 16) AS east, max(y + 16) AS north FROM (SELECT CAST((n_nationkey % 5) * 16 AS DOUBLE) AS x, CAST((n_nationkey // 5) * 16 AS DOUBLE) AS y FROM nation)""")
def q70_extent(spark, sf_dir):
    return composite.extent(spatial.with_box(_boxes(spark, sf_dir)))


# --- scalars and dates ---------------------------------------------------------------


@query("""SELECT s_suppkey, round(s_acctbal * 10000, 4) AS m2, round(sqrt(abs(s_acctbal) * 10000 / pi()), 6) AS radius, round(sqrt(abs(s_acctbal) * 10000), 6) AS side, round(500 / 111320.0, 9) AS north, round(500 / (111320.0 * cos(radians(s_suppkey % 60))), 9) AS east,
s_suppkey % 13 = 3 AS rice, regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS file, regexp_replace('camelCaseName' || s_nationkey, '([a-z])([A-Z])', '\\1 \\2', 'g') AS words FROM supplier""")
def q71_scalars(spark, sf_dir):
    k, area = F.col("s_suppkey"), indices.hectares_to_metres2("s_acctbal")
    s = read(spark, sf_dir, "supplier")
    out = s.select("s_suppkey", r6(area, 4).alias("m2"), r6(indices.circle_radius(F.abs(area))).alias("radius"), r6(indices.square_side(F.abs(area))).alias("side"), r6(indices.degrees_north(F.lit(500.0)), 9).alias("north"), r6(indices.degrees_east(F.lit(500.0), k % 60), 9).alias("east"), quality.class_is(k % 13, quality.RICE).alias("rice"), text.safe_filename("s_name").alias("file"), text.split_camel(F.concat(F.lit("camelCaseName"), F.col("s_nationkey"))).alias("words"))
    return out


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, CAST(date_trunc('week', d) AS DATE) AS monday, strftime(d - INTERVAL 14 DAY, '%Y%W') AS two_weeks_before, CAST(d - INTERVAL 4 DAY AS DATE) AS first_of_five, CAST(d + INTERVAL 4 DAY AS DATE) AS last_of_five, CAST(31 AS INT) AS days, CAST(5 AS INT) AS weeks,
CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE) AS sunday, CAST(date_trunc('week', d) + INTERVAL 5 DAY AS DATE) AS saturday, CAST((date_diff('day', date_trunc('week', d), date_trunc('week', d + INTERVAL 30 DAY)) // 7) + 1 AS INT) AS sundays, CAST((CAST(epoch(d) AS BIGINT) // 7) % 86400 // 3600 AS INT) AS hours, last_day(d) AS month_end FROM d""")
def q72_more_dates(spark, sf_dir):
    """The helpers that give lists, by their ends and sizes."""
    d, after = F.col("d"), F.date_add("d", 30)
    days = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    own = days.select("d", F.date_add(F.date_sub(d, F.weekday(d)), 0).alias("monday"), dates.week_label(F.date_sub(d, 14)).alias("two_weeks_before"), F.array_min(dates.previous_days(d, 5)).alias("first_of_five"), F.array_max(dates.next_days(d, 5)).alias("last_of_five"), F.size(dates.day_range(d, after)).alias("days"), F.size(dates.weekly_range(d, after)).alias("weeks"), F.element_at(dates.sundays(d, after), 1).alias("sunday"), F.element_at(dates.saturdays(d, after), 1).alias("saturday"), F.size(dates.sundays(d, after)).alias("sundays"), dates.clock(F.expr("unix_date(d) * 86400L div 7"))["hours"].alias("hours"), F.element_at(dates.month_ends(d, after), 1).alias("month_end"))
    return own
