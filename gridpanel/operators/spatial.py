"""Points in polygons, polygon overlap, centroids, distances, neighbours and buffers.

Polygons are arrays of rings, rings arrays of (x, y), closed or not; holes follow
from the even-odd rule. Joins go by the grid cells that a polygon's box touches,
so a point is tested against the polygons of its cell only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.indices import _c
from ..sources.scratch import written

# The earth as the map projections take it (WGS 84), and the UTM scale and false easting.
A, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST = 0.9996, 500000.0
RINGS = "array<array<struct<x:double,y:double>>>"


def box(west, south, east, north) -> Column:
    """A rectangle as rings."""
    p = lambda x, y: F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))
    return F.array(F.array(p(west, south), p(east, south), p(east, north), p(west, north), p(west, south)))


def edges(rings: str) -> str:
    """SQL of the array of edges (x1, y1, x2, y2), rings closed where they are open."""
    return f"flatten(transform({rings}, r -> transform(r, (p, i) -> struct(p.x AS x1, p.y AS y1, r[(i + 1) % size(r)].x AS x2, r[(i + 1) % size(r)].y AS y2))))"


def covers(rings: str, x: str, y: str) -> Column:
    """Whether the polygon holds the point, its boundary included."""
    e = edges(rings)
    cross = f"((e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1))"
    on = f"exists({e}, e -> {cross} = 0 AND {x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND {y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))"
    ray = f"aggregate({e}, 0, (n, e) -> n + CASE WHEN (e.y1 > {y}) <> (e.y2 > {y}) AND ({cross} > 0) = (e.y2 > e.y1) THEN 1 ELSE 0 END) % 2 = 1"
    return F.expr(f"({on} OR {ray})")


def with_box(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """west, south, east, north of each polygon."""
    flat = f"flatten({rings})"
    return polygons.withColumns({n: F.expr(f"{agg}(transform({flat}, p -> p.{c}))") for n, agg, c in (("west", "array_min", "x"), ("south", "array_min", "y"), ("east", "array_max", "x"), ("north", "array_max", "y"))})


def _bucketed(polygons: DataFrame, size: float) -> DataFrame:
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return with_box(polygons).select("*", span("west", "east").alias("__bx")).select("*", span("south", "north").alias("__by"))


def locate(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", gid: str = "gid", size: float = 1.0) -> DataFrame:
    """x, y, gid, matches for each distinct location that a polygon covers: the lexically first gid and how many match.

    Geometry is tested once for each location, not for each point.
    """
    at = points.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x is not null and __y is not null").distinct()
    at = at.withColumn("__bx", F.floor(F.col("__x") / size)).withColumn("__by", F.floor(F.col("__y") / size))
    hit = at.join(_bucketed(polygons.select(gid, "rings"), size), ["__bx", "__by"]).where((F.col("__x").between(F.col("west"), F.col("east"))) & (F.col("__y").between(F.col("south"), F.col("north"))))
    return hit.where(covers("rings", "__x", "__y")).groupBy(F.col("__x").alias(x), F.col("__y").alias(y)).agg(F.min(gid).alias(gid), F.count("*").cast("int").alias("matches"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", gid: str = "gid", ambiguous: str = "first", unassigned: str = "keep", size: float = 1.0) -> DataFrame:
    """points with gid and matches.

    ambiguous: "first" takes the lexically first polygon, "error" fails when the
    row is read; unassigned: "keep" leaves gid null, "drop" drops the row, "error" fails.
    """
    found = points.join(locate(points, polygons, x, y, gid, size), [x, y], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    guard = lambda bad, text: F.when(bad, F.raise_error(F.lit(text)).cast("string"))
    if ambiguous == "error":
        found = found.withColumn(gid, F.coalesce(guard(F.col("matches") > 1, "a point lies in several polygons"), F.col(gid)))
    if unassigned == "error":
        found = found.withColumn(gid, F.coalesce(guard(F.col("matches") == 0, "a point lies in no polygon"), F.col(gid)))
    return found.where("matches > 0") if unassigned == "drop" else found


def boxes_meeting(polygons: DataFrame, boxes: DataFrame, size: float = 1.0, gid: str = "gid") -> DataFrame:
    """Polygons, each named by gid, whose shape meets any of the boxes (boundary included): a semi join after the boxes of both met in a cell."""
    e, inside = edges("rings"), "exists(flatten(rings), p -> p.x BETWEEN b_west AND b_east AND p.y BETWEEN b_south AND b_north)"
    # an edge crosses the box if it isn't wholly on one side and the box's corners aren't all on one side of it
    side = lambda cx, cy: f"sign((e.x2 - e.x1) * ({cy} - e.y1) - (e.y2 - e.y1) * ({cx} - e.x1))"
    signs = ", ".join(side(cx, cy) for cx in ("b_west", "b_east") for cy in ("b_south", "b_north"))
    apart = "greatest(e.x1, e.x2) < b_west OR least(e.x1, e.x2) > b_east OR greatest(e.y1, e.y2) < b_south OR least(e.y1, e.y2) > b_north"
    crossing = f"exists({e}, e -> NOT ({apart}) AND abs(array_max(array({signs})) + array_min(array({signs}))) < 2)"
    cells = boxes.select(*[F.col(c).alias(f"b_{c}") for c in ("west", "south", "east", "north")])
    for axis, a, b in (("__bx", "b_west", "b_east"), ("__by", "b_south", "b_north")):
        cells = cells.select("*", F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))).alias(axis))
    keyed = _bucketed(polygons.select(gid, "rings"), size)
    hit = keyed.join(cells, ["__bx", "__by"]).where(F.expr(f"({inside} OR {crossing})") | covers("rings", "b_west", "b_south")).select(gid).distinct()
    return polygons.join(hit, gid, "left_semi")


def centroid(rings: str = "rings") -> Column:
    """Area centroid of the first ring, by the shoelace formula; null for no area."""
    e = edges(f"slice({rings}, 1, 1)")
    # relative to the first point, which keeps digits
    at = f"named_struct('x', {rings}[0][0].x, 'y', {rings}[0][0].y)"
    w = "((e.x1 - o.x) * (e.y2 - o.y) - (e.x2 - o.x) * (e.y1 - o.y))"
    total = lambda v: f"aggregate({e}, cast(0 as double), (s, e) -> s + {v})"
    area = total(w)
    one = lambda c: f"o.{c} + try_divide({total(f'(e.{c}1 + e.{c}2 - 2 * o.{c}) * {w}')}, 3 * {area})"
    return F.expr(f"transform(array({at}), o -> named_struct('x', {one('x')}, 'y', {one('y')}))[0]")


def area(rings: str = "rings") -> Column:
    """Unsigned area of the first ring in the units of its coordinates."""
    return F.expr(f"abs(aggregate({edges(f'slice({rings}, 1, 1)')}, cast(0 as double), (s, e) -> s + e.x1 * e.y2 - e.x2 * e.y1)) / 2")


def planar_distance(x1, y1, x2, y2) -> Column:
    return F.hypot(_c(x2) - _c(x1), _c(y2) - _c(y1))


def utm(lon, lat, meridian: float = 105.0, scale: float = UTM_SCALE) -> Column:
    """x, y in metres of the transverse Mercator projection about a meridian (Snyder's series)."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - meridian)
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    n = F.lit(A) / F.sqrt(1 - F.pow(F.sin(phi), 2) * e2)
    t, c, a = F.pow(F.tan(phi), 2), F.pow(F.cos(phi), 2) * ep2, F.cos(phi) * lam
    m = (phi * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) - F.sin(phi * 2) * (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) + F.sin(phi * 4) * (15 * e2**2 / 256 + 45 * e2**3 / 1024) - F.sin(phi * 6) * (35 * e2**3 / 3072)) * A
    x = n * scale * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - t * 18 + t * t + c * 72 - 58 * ep2) * F.pow(a, 5) / 120) + UTM_EAST
    y = (m + n * F.tan(phi) * (a * a / 2 + (5 - t + c * 9 + c * c * 4) * F.pow(a, 4) / 24 + (61 - t * 58 + t * t + c * 600 - 330 * ep2) * F.pow(a, 6) / 720)) * scale
    return F.struct(x.alias("x"), y.alias("y"))


def _bound(value: Column, use) -> Column:
    """use(value) with the value made once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def from_utm(x, y, meridian: float = 105.0, scale: float = UTM_SCALE) -> Column:
    """lon, lat of a place in metres, the other way round than utm() (Snyder's series)."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2, e1 = e2 / (1 - e2), (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    mu = _c(y) / scale / (A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = lambda m: m + F.sin(m * 2) * (3 * e1 / 2 - 27 * e1**3 / 32) + F.sin(m * 4) * (21 * e1**2 / 16 - 55 * e1**4 / 32) + F.sin(m * 6) * (151 * e1**3 / 96) + F.sin(m * 8) * (1097 * e1**4 / 512)
    root = lambda phi: F.lit(1.0) - F.pow(F.sin(phi), 2) * e2

    def terms(phi: Column) -> Column:
        n = F.lit(A) / F.sqrt(root(phi))
        return F.struct(phi.alias("phi"), (n * F.tan(phi) / (F.lit(A * (1 - e2)) / F.pow(root(phi), 1.5))).alias("q"), F.pow(F.tan(phi), 2).alias("t"), (F.pow(F.cos(phi), 2) * ep2).alias("c"), ((_c(x) - UTM_EAST) / (n * scale)).alias("d"))

    def place(p: Column) -> Column:
        t, c, d = p["t"], p["c"], p["d"]
        lat = p["phi"] - p["q"] * (d * d / 2 - (t * 3 + 5 + c * 10 - c * c * 4 - 9 * ep2) * F.pow(d, 4) / 24 + (t * 90 + 61 + c * 298 + t * t * 45 - 252 * ep2 - c * c * 3) * F.pow(d, 6) / 720)
        lam = (d - (t * 2 + 1 + c) * F.pow(d, 3) / 6 + (F.lit(5.0) - c * 2 + t * 28 - c * c * 3 + 8 * ep2 + t * t * 24) * F.pow(d, 5) / 120) / F.cos(p["phi"])
        return F.struct((F.degrees(lam) + meridian).alias("lon"), F.degrees(lat).alias("lat"))

    return _bound(mu, lambda m: _bound(foot(m), lambda phi: _bound(terms(phi), place)))


def utm_box(lon, lat, distance: float = 5.0, meridian: float = 105.0) -> Column:
    """west, south, east, north of the square buffer at a distance in UTM metres about a place: the bounds of its corners."""
    corners = F.array(*[F.struct(F.lit(float(sx * distance)).alias("x"), F.lit(float(sy * distance)).alias("y")) for sx in (-1, 1) for sy in (-1, 1)])
    points = _bound(utm(lon, lat, meridian), lambda m: F.transform(corners, lambda o: from_utm(m["x"] + o["x"], m["y"] + o["y"], meridian)))
    edge = lambda p, f, c: f(F.transform(p, lambda q: q[c]))
    return _bound(points, lambda p: F.struct(edge(p, F.array_min, "lon").alias("west"), edge(p, F.array_min, "lat").alias("south"), edge(p, F.array_max, "lon").alias("east"), edge(p, F.array_max, "lat").alias("north")))


def web_mercator(lon, lat) -> Column:
    return F.struct((F.radians(_c(lon)) * A).alias("x"), (F.log(F.tan(F.radians(_c(lat)) / 2 + F.pi() / 4)) * A).alias("y"))


def from_web_mercator(x, y) -> Column:
    return F.struct(F.degrees(_c(x) / A).alias("lon"), F.degrees(F.atan(F.exp(_c(y) / A)) * 2 - F.pi() / 2).alias("lat"))


def buffer(lon, lat, distance, shape: str, corners: int = 32) -> Column:
    """Rings about a point at a distance in Web Mercator metres: a square, or a circle of so many corners."""
    if shape not in ("square", "circle"):
        raise ValueError(shape)
    m, d = web_mercator(lon, lat), _c(distance)
    point = lambda dx, dy: (lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))(from_web_mercator(m["x"] + dx, m["y"] + dy))
    if shape == "square":
        return F.array(F.array(*[point(d * sx, d * sy) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]))
    steps = F.sequence(F.lit(0), F.lit(corners))
    return F.array(F.transform(steps, lambda i: point(d * F.cos(i * (F.pi() * 2 / corners)), d * F.sin(i * (F.pi() * 2 / corners)))))


def nearest_points(points: DataFrame, key: str, k: int, x: str = "x", y: str = "y", per_cell: int = 4, rounds: int = 32) -> DataFrame:
    """key, neighbour, rank, weight (1 / k): the k nearest other points by Euclidean distance, ties by key; exact for any number of points.

    Points meet in grid cells of about per_cell points each and the cells around. A
    point is done once its k-th neighbour is nearer than the searched cells'
    edge; the others go on in a grid twice as coarse, until it is one cell. Null
    places are left out; points that are alone, or fewer than k others, have fewer rows.
    The points of one cell are compared with one another, so points that crowd
    on few places (thousands on one) cost their square.
    """
    own = points.select(F.col(key).alias("a"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    box = own.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    schema = f"{key} {points.schema[key].dataType.simpleString()}, neighbour {points.schema[key].dataType.simpleString()}, rank int, weight double"
    if not box["n"]:
        return points.sparkSession.createDataFrame([], schema)
    wide = max(box["x1"] - box["x0"], box["y1"] - box["y0"])
    area = max(box["x1"] - box["x0"], wide / box["n"]) * max(box["y1"] - box["y0"], wide / box["n"])
    size = max((area * per_cell / box["n"]) ** 0.5, wide / 2**30) or 1.0
    cell = lambda c, low, s: F.floor((F.col(c) - low) / s)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left, out = own, None
    for _ in range(rounds):
        last = size > wide
        mine = left.withColumns({"cx": cell("x", box["x0"], size), "cy": cell("y", box["y0"], size)})
        other = own.select(F.col("a").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"), cell("x", box["x0"], size).alias("ox"), cell("y", box["y0"], size).alias("oy"), F.explode(around).alias("o"))
        other = other.select("b", "u", "v", (F.col("ox") + F.col("o.i")).alias("cx"), (F.col("oy") + F.col("o.j")).alias("cy"))
        met = mine.join(other, ["cx", "cy"]).where("a <> b").withColumn("d", (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v")))
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k)
        # everything nearer than the edge of the cells around has been met
        edge = F.least(*[F.col(c) - (F.lit(low) + (F.col(cc) - 1) * size) for c, low, cc in (("x", box["x0"], "cx"), ("y", box["y0"], "cy"))], *[F.lit(low) + (F.col(cc) + 2) * size - F.col(c) for c, low, cc in (("x", box["x0"], "cx"), ("y", box["y0"], "cy"))])
        ranked = ranked.select("a", "b", "rank", "d", edge.alias("edge")).withColumns({"n": F.count("*").over(Window.partitionBy("a")), "far": F.max("d").over(Window.partitionBy("a"))})
        ranked = written(ranked.select("a", "b", "rank", (F.lit(last) | ((F.col("n") == k) & (F.sqrt("far") < F.col("edge")))).alias("done")), "neighbours")
        good = ranked.where("done").select("a", "b", "rank")
        out = good if out is None else out.unionByName(good)
        if last:
            break
        left = left.join(good.select("a").distinct(), "a", "left_anti")
        if not left.limit(1).count():
            break
        size *= 2
    return out.select(F.col("a").alias(key), F.col("b").alias("neighbour"), "rank", F.lit(1.0 / k).alias("weight"))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """key, neighbour, rank, weight (1 / k): the k nearest vectors of each query by Euclidean distance, itself left out, ties by key.

    A stated set of queries against all vectors: queries are dealt into blocks, each
    block meets every vector once in arrays, and each task keeps the k best of a
    query, so what is shuffled are these. Work is queries times vectors, without a bound.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block))
    q = queries.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("part"), F.struct(F.col(key).alias("a"), F.col(vector).cast("array<double>").alias("v")).alias("q"))
    grouped = q.groupBy("part").agg(F.collect_list("q").alias("qs"))
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("b"), F.col(vector).cast("array<double>").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
    kind = vectors.schema[key].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("d", T.DoubleType())])
    deal = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.schema([("a", right.schema.field("b").type), ("b", right.schema.field("b").type), ("d", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        qs = left["qs"][0].as_py()
        a, va = [x["a"] for x in qs], np.array([x["v"] for x in qs], dtype=np.float64)
        b, vb = np.array(right["b"].to_pylist()), np.array(right["w"].to_pylist(), dtype=np.float64)
        rows: list[tuple] = []
        for i, name in enumerate(a):
            d = np.round(((vb - va[i]) ** 2).sum(axis=1), 9)
            d[b == name] = np.inf
            best = np.lexsort((b, d))[:k] if len(d) <= 4 * k else (lambda c: c[np.lexsort((b[c], d[c]))][:k])(np.flatnonzero(d <= np.partition(d, k)[k]))
            rows += [(name, b[j].item(), float(d[j])) for j in best if d[j] < np.inf]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), empty)], schema=empty) if rows else empty.empty_table()

    salted = v.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(deal)).cast("int"))
    every = grouped.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    near = every.groupBy("part", "salt").cogroup(salted.groupBy("part", "salt")).applyInArrow(run, out)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias(key), F.col("b").alias("neighbour"), "rank", F.lit(1.0 / k).alias("weight"))


def decay(targets: DataFrame, sources: DataFrame, key: str, value: str, reach: float, x: str = "x", y: str = "y") -> DataFrame:
    """key, inv, inv2: sums of value / d and value / d^2 over the sources within reach, none at distance 0.

    Sources at one place are one with the sum of their values, and a place of
    several targets is worked out once, so work grows with the pairs of different
    places. Places meet in cells of the reach's size and their eight neighbours.
    """
    c = lambda v: F.floor(F.col(v) / reach)
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    at = targets.select(F.col(key).alias("__key"), F.col(x).alias("tx"), F.col(y).alias("ty"))
    t = at.select("tx", "ty").distinct().select("*", c("tx").alias("bx"), c("ty").alias("by"))
    s = sources.groupBy(F.col(x).alias("sx"), F.col(y).alias("sy")).agg(F.sum(F.col(value).cast("double")).alias("v"))
    s = s.select("*", F.explode(step).alias("o"), c("sx").alias("cx"), c("sy").alias("cy"))
    s = s.select("sx", "sy", "v", (F.col("cx") + F.col("o.i")).alias("bx"), (F.col("cy") + F.col("o.j")).alias("by"))
    d = planar_distance("tx", "ty", "sx", "sy")
    near = t.join(s, ["bx", "by"]).withColumn("d", d).where((F.col("d") > 0) & (F.col("d") <= reach))
    summed = near.groupBy("tx", "ty").agg(F.sum(F.col("v") / F.col("d")).alias("inv"), F.sum(F.col("v") / (F.col("d") * F.col("d"))).alias("inv2"))
    # no row of a null key counts, as in an equi join
    total = lambda n: F.coalesce(F.sum(F.when(F.col("__key").isNotNull(), F.col(n))), F.lit(0.0)).alias(n)
    return at.join(summed, ["tx", "ty"], "left").groupBy(F.col("__key").alias(key)).agg(total("inv"), total("inv2"))
