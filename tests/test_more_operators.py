"""The rest of the operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridpanel.functions import dates, indices, quality, text
from gridpanel.operators import calendar, compare, composite, grid, ingest, panel, regress, spatial, windows
from gridpanel.sources import readers, writers

D = datetime.date


def test_grids(spark):
    box = spark.createDataFrame([("t", 100.0, 10.0, 101.0, 11.0)], "tile_id string, west double, south double, east double, north double")
    pts = {(r["px"], r["py"]): (r["lon"], r["lat"]) for r in grid.grid_points(box, 0.5, ["tile_id"]).collect()}
    assert pts == {(0, 0): (100.25, 10.75), (1, 0): (100.75, 10.75), (0, 1): (100.25, 10.25), (1, 1): (100.75, 10.25)}
    tiles = spark.createDataFrame([("a", 0.0, 0.5), ("b", 0.3, 0.5)], "tile string, west double, north double")
    assert [r["tile"] for r in grid.misaligned(tiles, "tile", "west", "north", 0.25).collect()] == ["b"]
    cells = spark.createDataFrame([(0, 0), (0, 1)], "px int, py int")
    assert [tuple(r) for r in grid.uncovered(cells, cells.limit(1), ["px", "py"]).collect()] == [(0, 1)]
    b = spark.range(1).select(grid.cell_bounds(F.lit(2), F.lit(1), 100.0, 10.0, 0.5, 0.25).alias("b"), grid.flip_rows(F.lit(0), 5).alias("f"), grid.cell(F.lit(100.2), 100.0, 0.5, centre=True).alias("c"), grid.cell(F.lit(100.3), 100.0, 0.5, centre=True).alias("d")).first()
    assert tuple(b["b"]) == (101.0, 9.5, 101.5, 9.75) and (b["f"], b["c"], b["d"]) == (4, 0, 1)
    assert tuple(composite.extent(box).first()) == (100.0, 10.0, 101.0, 11.0)


def test_windows(spark):
    df = spark.createDataFrame([(D(2024, 3, 1), D(2024, 1, 19)), (D(2024, 3, 1), D(2024, 2, 1)), (D(2024, 3, 1), D(2024, 2, 2)), (D(2024, 3, 1), D(2024, 1, 20))], "h date, d date")
    assert sorted(r["d"] for r in windows.days_before(df, "h", "d", 42, 28).collect()) == [D(2024, 1, 19), D(2024, 1, 20), D(2024, 2, 1)]
    assert windows.half_open(df, "d", D(2024, 1, 20), D(2024, 2, 2)).count() == 2 and windows.inclusive(df, "d", D(2024, 1, 20), D(2024, 2, 2)).count() == 3
    s = {(r["season"], r["valid"]) for r in windows.season_windows(spark, [2019]).collect()}
    assert len(s) == 11 and {n for n, ok in s if not ok} == {"rice_3_s", "rice_1_n"}


def test_panel_tables(spark):
    keys = "Timestamp string, lon double, lat double"
    a = spark.createDataFrame([("2020-01", 1.0, 1.0, 0.5)], f"{keys}, ESI double")
    b = spark.createDataFrame([("2020-02", 1.0, 1.0, 0.6)], f"{keys}, ESI double")
    extra = spark.createDataFrame([("2020-01", 1.0, 1.0, 2.0), ("2020-03", 1.0, 1.0, 3.0)], f"{keys}, ET double")
    radar = spark.createDataFrame([("2020-01", 1.0, 1.0, 0.1)], f"{keys}, RVI double")
    crops = spark.createDataFrame([(1.0, 1.0, "wheat")], "lon double, lat double, crop string")
    out = panel.assemble([a, b], extra, radar, crops, ["Timestamp", "lon", "lat"], ["ESI", "ET"]).collect()
    assert [(r["Timestamp"], r["RVI"], r["crop"]) for r in out] == [("2020-01", 0.1, "wheat")]
    assert panel.dummy_matrix(crops, "crop", ["wheat", "rice"], "plot").first()["plot_rice"] == 0
    assert composite.joint(a.unionByName(extra, allowMissingColumns=True), ["ESI", "ET"]).count() == 0


def test_regression_helpers(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(10)], "id long, v double")
    w = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (5, 9, 1.0)], "id long, neighbour long, weight double")
    assert {r["id"]: r["lag"] for r in regress.spatial_lag(df, w, "id", "v").collect()} == {0: 2.5, 5: 81.0}
    one, two = ([r["id"] for r in regress.sample(df.repartition(n), "id", 4).collect()] for n in (1, 5))
    assert one == two and len(one) == 4


def test_orientation(spark):
    up = spark.createDataFrame([(i, 10.0 + i) for i in range(5)], "i int, lat double")
    assert tuple(calendar.orientation(up, "lat").first()) == (True, False)
    assert tuple(calendar.orientation(up.withColumn("lat", -F.col("lat")), "lat").first()) == (False, True)


def test_collections(spark, tmp_path):
    rows = [(datetime.datetime(2020, 1, d), 105.0, 10.0 + d, "IW", ["VV", "VH"][: d % 2 + 1]) for d in range(1, 9)]
    spark.createDataFrame(rows, "ts timestamp_ntz, lon double, lat double, mode string, bands array<string>").write.parquet(f"{tmp_path}/c")
    df = readers.collection(spark, f"{tmp_path}/c", "2020-01-02", "2020-01-08", (104, 10, 106, 16.5), {"mode": "IW"}, {"bands": ["VV", "VH"]})
    assert sorted(r["lat"] for r in df.collect()) == [13.0, 15.0]
    assert "PushedFilters: [IsNotNull" in df._jdf.queryExecution().executedPlan().toString()
    assert readers.asset_path("x/", "2020-02", "VNM_bm") == "x/VNM_bm_2020_02"
    with pytest.raises(ValueError):
        readers.asset_path("x", "2020", "b")


def test_record_and_grid_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Viet Nam", 1, 2, 3.5)], "country string, px int, py int, v double")
    writers.write_records(df, f"{tmp_path}/r")
    assert (tmp_path / "r/__folder=Viet_Nam").is_dir()
    writers.write_grid(df.withColumn("k", F.lit("a")), f"{tmp_path}/g", ["k"], ["v"], -9999.0)
    assert spark.read.parquet(f"{tmp_path}/g").dtypes[-1] == ("v", "float")
    assert df.select(writers.task_name("country", 10, "px")).first()[0] == "Viet Nam_10m_1"


def test_more_features(spark):
    row = spark.range(1).select(
        indices.bbox_around(F.lit(105.0), F.lit(60.0), F.lit(111320.0)).alias("b"), indices.circle_radius(indices.hectares_to_metres2(F.lit(1.0))).alias("r"), indices.square_side(F.lit(9.0)).alias("s"),
        indices.evi(F.lit(5000), F.lit(1000), F.lit(500)).alias("e"), indices.log_shift(F.lit(-1.0)).alias("n"), indices.log_floor(F.lit(0.0)).alias("l"), quality.cloud_free(F.lit(1024)).alias("c"),
    ).first()
    assert tuple(row["b"]) == (pytest.approx(103.0), 59.0, pytest.approx(107.0), 61.0)
    assert row["r"] == pytest.approx(56.41896) and row["s"] == 3 and row["e"] == pytest.approx(2.5 * 0.4 / (0.5 + 0.6 - 0.375 + 1))
    assert row["n"] is None and row["l"] == pytest.approx(-9.21034) and row["c"] is False


def test_lookup_order(spark):
    df = spark.createDataFrame([(2.0, 1.0, "b", "X"), (1.0, 5.0, "a", "X"), (2.0, 1.0, "b", "X")], "lon double, lat double, gid_1 string, country string")
    assert [tuple(r) for r in ingest.lookup(df).collect()] == [(1.0, 5.0, "a", "X"), (2.0, 1.0, "b", "X")]


def plain_nearest(points, k):
    return {(a, b, r + 1) for a, x, y in points for r, (_, b) in enumerate(sorted(((x - u) ** 2 + (y - v) ** 2, b) for b, u, v in points if b != a)[:k])}


def test_nearest_points_are_all_pairs_nearest(spark):
    """Clusters, ties, points at one place, far ones, fewer than k, none."""
    rng = random.Random(3)
    clusters = [(i, rng.gauss(0, 0.01) + 50 * (i % 3), rng.gauss(0, 0.01)) for i in range(150)] + [(1000, 1e6, -1e6), (1001, 3.0, 3.0)]
    lattice = [(i, float(i % 7), float(i // 7)) for i in range(49)]
    line = [(i, float(2**i), 0.0) for i in range(30)]
    for points, k in ((clusters, 8), (lattice, 4), (line, 3), ([(i, 1.0, 2.0) for i in range(12)], 5), ([(1, 0.0, 0.0), (2, 5.0, 5.0)], 8), ([(7, 1.0, 1.0)], 2)):
        df = spark.createDataFrame(points + [(5000, None, 1.0)], "id long, x double, y double")
        rows = spatial.nearest_points(df, "id", k).collect()
        assert {(r["id"], r["neighbour"], r["rank"]) for r in rows} == plain_nearest(points, k) and len(rows) == len(plain_nearest(points, k))
    assert spatial.nearest_points(spark.createDataFrame([], "id long, x double, y double"), "id", 2).collect() == []


def test_nearest_vectors_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)] + [(500, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    want = {(a, b, n + 1) for a, x in rows[:30] for n, (_, b) in enumerate(sorted((round(sum((p - q) ** 2 for p, q in zip(x, y)), 9), b) for b, y in rows[:120] if b != a)[:4])}
    for block in (7, 1024):
        got = spatial.nearest_vectors(df.where("id < 30"), df, "id", "v", 4, block=block).collect()
        assert {(r["id"], r["neighbour"], r["rank"]) for r in got} == want


def test_sigma_filter_in_blocks(spark):
    """The same for any size of the blocks, and as the definition has it."""
    rng = random.Random(5)
    cells = {(x, y): None if rng.random() < 0.1 else float(rng.randrange(1, 30)) for x in range(-3, 14) for y in range(11) if rng.random() < 0.9}
    df = spark.createDataFrame([(x, y, v) for (x, y), v in cells.items()], "px int, py int, v double")
    want = {}
    for (x, y), v in cells.items():
        near = [(cells[x + i, y + j], max(abs(i), abs(j)) <= 1) for i in range(-2, 3) for j in range(-2, 3) if cells.get((x + i, y + j)) is not None]
        inside = [w for w, _ in near if v is not None and abs(w - v) <= abs(v)]
        by = [w for w, next_ in near if next_]
        want[x, y] = None if v is None else round(sum(inside) / len(inside) if len(inside) >= 4 else sum(by) / len(by), 9)
    for block in (4, 256):
        got = {(r["px"], r["py"]): r["v"] for r in grid.sigma_filter(df, "v", radius=2, block=block).collect()}
        assert {k: None if v is None else round(v, 9) for k, v in got.items()} == want


@pytest.mark.parametrize("kind", ["lag", "error"])
def test_spatial_models(spark, kind):
    import numpy as np

    rng, n = np.random.default_rng(4), 400
    w = np.zeros((n, n))
    for i in range(n):
        w[i, [(i - 1) % n, (i + 1) % n, (i + 20) % n, (i - 20) % n]] = 0.25
    x, e, spread = rng.normal(size=n), rng.normal(size=n) * 0.3, np.linalg.inv(np.eye(n) - 0.6 * w)
    y = spread @ (1 + 2 * x + e) if kind == "lag" else 1 + 2 * x + spread @ e
    df = spark.createDataFrame([(i, float(y[i]), float(x[i])) for i in range(n)], "id long, y double, x double")
    weights = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "id long, neighbour long, weight double")
    got = {r["term"]: r["coefficient"] for r in regress.spatial_fit(df, weights, "id", "y", ["x"], kind).collect()}
    assert got["rho"] == pytest.approx(0.6, abs=0.12) and got["x"] == pytest.approx(2, abs=0.1)
    with pytest.raises(ValueError):
        regress.spatial_fit(df, weights, "id", "y", ["x"], kind, bound=10)


def test_stata(spark, tmp_path):
    import pandas as pd

    writers.write_stata(spark.range(3).selectExpr("cast(id as int) as a", "'é' as b"), f"{tmp_path}/a.dta")
    assert pd.read_stata(f"{tmp_path}/a.dta")["a"].tolist() == [0, 1, 2]


def test_interpolation_against_numpy(spark):
    """1,300 random years of 13 months, each against plain interpolation with end lines."""
    import numpy as np

    from gridpanel.operators import gapfill

    rng, rows, want = np.random.default_rng(12), [], {}
    for k in range(1300):
        v = [None if rng.random() < rng.choice([0.2, 0.6, 0.9]) else float(np.round(rng.normal(5, 20), 3)) for _ in range(13)]
        rows += [(k, D(2016 if i == 0 else 2017, 12 if i == 0 else i, 1), x) for i, x in enumerate(v)]
        at = [i for i, x in enumerate(v) if x is not None]
        full = list(v)
        if len(at) >= 2:
            for i in range(13):
                if v[i] is None:
                    a, b = (at[0], at[1]) if i < at[0] else (at[-2], at[-1]) if i > at[-1] else (max(j for j in at if j < i), min(j for j in at if j > i))
                    full[i] = v[a] + (v[b] - v[a]) * (i - a) / (b - a)
        want[k] = [max(x or 0.0, 0.0) for x in full[1:]]
    df = spark.createDataFrame(rows, "k int, m date, v double")
    got = {}
    for r in gapfill.fill_months(df, ["k"], "m", "v").where("month >= '2017-01-01'").orderBy("k", "month").collect():
        got.setdefault(r["k"], []).append(r["v"])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_utm_and_back(spark):
    df = spark.createDataFrame([(105.3, 21.1), (102.0, -3.5), (108.9, 60.2), (105.0, 0.0)], "lon double, lat double")
    m = df.select("lon", "lat", spatial.utm("lon", "lat").alias("m")).select("lon", "lat", spatial.from_utm("m.x", "m.y").alias("b"), spatial.utm_box("lon", "lat", 5.0).alias("box")).collect()
    for r in m:
        assert r["b"]["lon"] == pytest.approx(r["lon"], abs=1e-7) and r["b"]["lat"] == pytest.approx(r["lat"], abs=1e-7)
        assert r["box"]["west"] < r["lon"] < r["box"]["east"] and r["box"]["south"] < r["lat"] < r["box"]["north"]
        assert (r["box"]["north"] - r["box"]["south"]) * 111_000 == pytest.approx(10, rel=0.1)


def test_aligned_parts_and_masks(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string"), spark.createDataFrame([(2, 5), (1, None)], "k long, b long")
    assert {tuple(r) for r in panel.aligned([a, b], ["k"]).collect()} == {(1, "x", None), (2, "y", 5)}
    for bad in (b.where("k = 1"), b.union(b)):
        with pytest.raises(Exception, match="not aligned"):
            panel.aligned([a, bad], ["k"]).collect()
    cells = spark.createDataFrame([(0, 0), (5, 0)], "px int, py int")
    mask = spark.createDataFrame([(0, 0, 7)], "px int, py int, class int")
    assert {r["px"]: r["class"] for r in grid.warp_mask(cells, mask, 0.0, 1.0, 0.5, 0.0, 1.0, 1.0, "class").collect()} == {0: 7, 5: None}
    with pytest.raises(Exception, match="no mask"):
        grid.warp_mask(cells, mask, 0.0, 1.0, 0.5, 0.0, 1.0, 1.0, "class", strict=True).collect()


def test_profile_with_distinct(spark):
    df = spark.createDataFrame([("1", 0.0), ("a", 2.0), (None, None), ("a", 2.0)], "t string, v double")
    rows = {r["column"]: tuple(r)[1:] for r in compare.profile(df, ["t", "v"], distinct=True).collect()}
    assert rows == {"t": (4, 1, 0, 2, 2), "v": (4, 1, 1, 0, 2)}
    assert {tuple(r) for r in compare.diff_summary(compare.keyed_diff(df.where("t = '1'"), df.where("t = 'a'").limit(1), ["t"], ["v"])).collect()} == {("missing", None, 1), ("extra", None, 1)}


def test_names_and_ranges(spark):
    assert text.column_name(" a-b.c ") == "a_b_c"
    row = spark.range(1).select(dates.day_range(F.lit(D(2024, 1, 1)), F.lit(D(2024, 1, 3))).alias("d"), dates.weekly_range(F.lit(D(2024, 1, 1)), F.lit(D(2024, 1, 15))).alias("w"), dates.month_range(F.lit("2024-11"), F.lit("2025-01")).alias("m"), indices.ndvi_strict(F.lit(3.0), F.lit(1.0)).alias("n")).first()
    assert row["d"] == [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)] and row["w"] == [D(2024, 1, 1), D(2024, 1, 8), D(2024, 1, 15)] and row["m"] == ["2024-11", "2024-12", "2025-01"] and row["n"] == 0.5
