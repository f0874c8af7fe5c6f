"""Operators over small fixtures with known results."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from gridpanel.functions import quality
from gridpanel.operators import assemble, compare, composite, gapfill, grid, ingest, panel, regress, spatial, windows
from gridpanel.plans import dryrun
from gridpanel.sources import readers, writers
from gridpanel.streaming import replay

D = datetime.date


def boxes(spark, *rows):
    df = spark.createDataFrame(rows, "gid string, w double, s double, e double, n double")
    return df.select("gid", spatial.box("w", "s", "e", "n").alias("rings"))


REGIONS = (("MMR.1_1", 95.0, 20.0, 96.0, 21.0), ("MMR.2_1", 96.0, 20.0, 97.0, 21.0))
RAW = "latitude string, longitude string, brightness string, bright_t31 string, frp string, acq_date string, acq_time string, satellite string, instrument string, confidence string, version string, n int"


def detections(spark, *changes):
    base = {"latitude": "20.5", "longitude": "95.5", "brightness": "321.8", "bright_t31": "289.6", "frp": "14", "acq_date": "2017-01-01", "acq_time": "51", "satellite": "T", "instrument": "MODIS", "confidence": "0", "version": "6.1"}
    return spark.createDataFrame([tuple({**base, **c}.values()) + (i,) for i, c in enumerate(changes)], RAW)


def test_detections(spark):
    raw = detections(spark, {}, {"satellite": "A", "acq_time": "0145", "frp": "0"}, {"acq_date": "2022-12-31", "acq_time": "2359"}, {"acq_date": "2023-01-01"})
    regions = boxes(spark, *REGIONS)
    out = ingest.prepared(raw, regions, "2017-01-01", "2022-12-31", ["n"]).orderBy("n").collect()
    assert [(r["acq_time"], r["satellite"], r["gid_1"], r["country"], r["year"], r["mon"]) for r in out] == [("0051", "Terra", "MMR.1_1", "MYM", 2017, 1), ("0145", "Aqua", "MMR.1_1", "MYM", 2017, 1), ("2359", "Terra", "MMR.1_1", "MYM", 2022, 12)]
    counted = ingest.counters(raw.drop("n"), regions, "2017-01-01", "2022-12-31").first().asDict()
    assert counted == {"rows_in": 4, "bad": 0, "outside_dates": 1, "duplicates": 0, "ambiguous": 0, "unassigned": 0, "rows_out": 3}


def test_detection_policies(spark):
    regions = boxes(spark, *REGIONS)
    run = lambda *c, **k: ingest.prepared(detections(spark, *c), regions, "2017-01-01", "2022-12-31", ["n"], **k).collect()
    assert len(run({}, {})) == 1 and len(run({}, {}, duplicates="keep")) == 2
    assert run({"longitude": "96"})[0]["gid_1"] == "MMR.1_1" and run({"longitude": "99"})[0]["gid_1"] is None
    assert run({"longitude": "99"}, unassigned="drop") == []
    for changes, policy, said in ((({}, {}), {"duplicates": "error"}, "repeated"), (({"longitude": "96"},), {"ambiguous": "error"}, "several"), (({"longitude": "99"},), {"unassigned": "error"}, "no polygon")):
        with pytest.raises(Exception, match=said):
            run(*changes, **policy)
    bad = [{"latitude": "nan"}, {"acq_time": "2460"}, {"instrument": "VIIRS"}, {"version": "6.1NRT"}, {"acq_date": "2017-02-30"}, {"confidence": "101"}, {"satellite": "N"}]
    assert [r["problem"] for r in ingest.normalized(detections(spark, *bad)).orderBy("n").collect()] == ["latitude", "acq_time", "instrument", "version", "acq_date", "confidence", "satellite"]
    with pytest.raises(ValueError, match="frp"):
        ingest.normalized(detections(spark, {}).drop("frp"))


def test_gap_fill(spark):
    def series(values, year=2017):
        rows = [("a", D(year - 1 + (i + 11) // 12, (i + 11) % 12 + 1, 1), v) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "k string, m date, v double")

    fill = lambda values: [round(r["v"], 6) for r in gapfill.fill_months(series(values), ["k"], "m", "v").where("month >= '2017-01-01'").orderBy("month").collect()]
    n = None
    assert fill([n, 1.0, n, 3.0, n] + [n] * 8) == [1, 2, 3] + [4 + i for i in range(9)]
    assert fill([10.0, n, 30.0] + [n] * 9 + [130.0]) == [20.0 + 10 * i for i in range(12)]
    assert fill([n] * 13) == [0] * 12 and fill([5.0] + [n] * 12) == [0] * 12
    assert fill([n, 7.0] + [n] * 11) == [7.0] + [0] * 11
    assert fill([n, n, 2.0, 5.0] + [n] * 9)[0] == 0


def test_december_context_is_the_clean_one(spark):
    rows = [("a", D(2017, m, 1), float(10 * m) if m < 11 else None) for m in range(1, 13)] + [("a", D(2018, m, 1), None if m == 1 else float(m)) for m in range(1, 13)]
    got = {r["m"]: r["v"] for r in gapfill.fill_months(spark.createDataFrame(rows, "k string, m date, v double"), ["k"], "m", "v").withColumnRenamed("month", "m").collect()}
    assert got[D(2017, 12, 1)] == 120 and got[D(2018, 1, 1)] == 1  # not between 120 and 2: December 2017 was filled, not observed


def test_mosaic(spark):
    px = lambda t, g: [(t, x, y, v) for y, row in enumerate(g) for x, v in enumerate(row)]
    pixels = spark.createDataFrame(px("left", [[3, 3], [0, 4]]) + px("right", [[4, 4], [3, 0]]), "tile string, px int, py int, class int")
    tiles = lambda x: spark.createDataFrame([("left", 0, 0, 2, 2), ("right", x, 0, 2, 2)], "tile string, x int, y int, w int, h int")
    out = grid.mosaic(pixels, tiles(2))
    assert {(r["px"], r["py"]): r["class"] for r in out.collect()} == {(x, y): v for y, row in enumerate([[3, 3, 4, 4], [0, 4, 3, 0]]) for x, v in enumerate(row)}
    assert {r["class"]: r["n"] for r in composite.histogram(out, "class", 0, 4).collect()} == {0: 2, 1: 0, 2: 0, 3: 3, 4: 3}
    with pytest.raises(ValueError, match="overlap"):
        grid.mosaic(pixels, tiles(1))


def test_polygons(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    shapes = spark.createDataFrame([("hole", [ring((0, 0), (6, 0), (6, 6), (0, 6)), ring((2, 2), (4, 2), (4, 4), (2, 4))]), ("ell", [ring((10, 0), (14, 0), (14, 1), (11, 1), (11, 4), (10, 4), (10, 0))])], f"gid string, rings {spatial.RINGS}")
    points = [(1, 1, "hole"), (3, 3, None), (2, 3, "hole"), (6, 6, "hole"), (7, 3, None), (12, 2, None), (10.5, 3, "ell"), (14, 0.5, "ell"), (11, 1, "ell"), (3, 0, "hole")]
    df = spark.createDataFrame([(float(x), float(y)) for x, y, _ in points], "lon double, lat double")
    got = {(r["lon"], r["lat"]): r["gid"] for r in spatial.point_in_polygon(df, shapes, size=2.0).collect()}
    assert got == {(float(x), float(y)): g for x, y, g in points}
    c = boxes(spark, ("b", 100.0, 10.0, 102.0, 14.0)).select(spatial.centroid().alias("c"), spatial.area().alias("a")).first()
    assert (c["c"]["x"], c["c"]["y"], c["a"]) == (101, 12, 8)


def test_projections(spark):
    row = spark.range(1).select(spatial.utm(F.lit(105.0), F.lit(0.0)).alias("a"), spatial.utm(F.lit(108.0), F.lit(16.0)).alias("b"), spatial.web_mercator(F.lit(180.0), F.lit(0.0)).alias("m")).first()
    assert tuple(row["a"]) == (500000, 0)
    assert row["b"]["x"] == pytest.approx(820_971, abs=150) and row["b"]["y"] == pytest.approx(1_770_980, abs=300)
    assert row["m"]["x"] == pytest.approx(20037508.342789, abs=1e-5)
    lon_lat = spark.range(1).select(spatial.web_mercator(F.lit(105.5), F.lit(-9.25)).alias("m")).select(spatial.from_web_mercator("m.x", "m.y").alias("p")).first()["p"]
    assert tuple(lon_lat) == (pytest.approx(105.5), pytest.approx(-9.25))
    for shape, n in (("square", 5), ("circle", 33)):
        r = spark.range(1).select(spatial.buffer(F.lit(105.0), F.lit(10.0), F.lit(100.0), shape).alias("r")).first()["r"]
        assert len(r[0]) == n and r[0][0]["x"] == pytest.approx(r[0][-1]["x"])


def test_bicubic_keeps_lines(spark):
    df = spark.createDataFrame([(x, y, float(2 * x + 3 * y)) for x in range(8) for y in range(8)], "px int, py int, v double")
    out = grid.upsample_bicubic(df, 2, "v").collect()
    assert out and all(r["v"] == pytest.approx(2 * ((r["px"] + 0.5) / 2 - 0.5) + 3 * ((r["py"] + 0.5) / 2 - 0.5)) for r in out)
    holed = {(r["px"], r["py"]) for r in grid.upsample_bicubic(df.where("not (px = 4 and py = 4)"), 2, "v").collect()}
    assert holed < {(r["px"], r["py"]) for r in out} and (8, 8) not in holed
    assert len(grid.upsample_nearest(df, 3, "v").collect()) == 64 * 9


def test_lookback_is_half_open(spark):
    f = spark.createDataFrame([("p", D(2024, 3, 1))], "k string, h date")
    o = spark.createDataFrame([("p", D(2024, 3, 1), 1.0), ("p", D(2024, 2, 29), 2.0), ("p", D(2024, 2, 23), 4.0), ("p", D(2024, 2, 22), 8.0), ("p", D(2024, 1, 4), 16.0)], "k string, d date, v double")
    got = {r["weeks"]: r["total"] for r in windows.lookback(f, o, ["k"], "h", "d", "v", 8).collect()}
    assert got == {1: 6.0, **{w: 14.0 for w in range(2, 8)}, 8: 14.0}


def test_unions_and_keys(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y", 2)], "b string, a int")
    with pytest.raises(ValueError):
        assemble.strict_union([a, b])
    u = assemble.header_union([a, b.withColumn("c", F.lit(3))], blank=True)
    assert u.columns == ["a", "b", "c"] and sorted(map(tuple, u.collect())) == [("1", "x", ""), ("2", "y", "3")]
    k = spark.createDataFrame([(1, "a"), (2, "a"), (3, " "), (4, None), (5, "b"), (6, "b")], "n int, k string")
    rows = lambda **x: sorted((r["k"], r["problem"]) for r in assemble.key_report(k.withColumn("k", F.coalesce("k", F.lit(""))), ["k"], **x).collect())
    assert rows() == [("", "blank"), (" ", "blank"), ("a", "repeated"), ("b", "repeated")]
    assert rows(first=2, order=["n"]) == [("", "blank"), (" ", "blank"), ("a", "repeated")]
    few, more = assemble.truncated(k, 3, ["n"])
    assert few.count() == 3 and more


def test_comparison(spark):
    l = spark.createDataFrame([(1, "1.0", "a"), (2, "2.0", "b"), (3, None, "c")], "k int, v string, t string")
    r = spark.createDataFrame([(1, "1.00000000000001", "a"), (2, "2.5", "B"), (4, "1", "d")], "k int, v string, t string")
    d = sorted(((x["k"], x["kind"], x["column"]) for x in compare.keyed_diff(l, r, ["k"], ["v", "t"], {"v": 1e-9}).collect()), key=repr)
    assert d == [(2, "changed", "t"), (2, "changed", "v"), (3, "missing", None), (4, "extra", None)]
    assert compare.records_against(l, r, ["k"], ["v"]).count() == 2


def test_panel(spark):
    rows = [(1.0, 1.0, 0.5, 10.0, 1, 0), (1.0, 1.0, 0.5, None, 0, 1), (1.0, 1.0, 0.5, 1000.0, 0, 0), (None, 1.0, 0.5, 90.0, 1, 1)]
    df = spark.createDataFrame(rows, "lon double, lat double, ndvi double, pm25_mean double, reprod int, veg int")
    assert sorted(r["pm25_mean"] for r in panel.panel_rows(df, ("pm25_mean",)).collect()) == [10, 10]
    p = spark.createDataFrame([(x,) for x in "aaabbc"], "plot_id string")
    assert panel.plot_categories(p)[1] == ["b", "c"] and panel.plot_categories(p, top=2)[1] == ["a", "b"]
    assert {r["plot_category"] for r in panel.plot_dummies(p, top=1).collect()} == {"a", "other"}
    assert panel.time_dummies(p, "plot_id").columns == ["plot_id", "time_b", "time_c"]
    assert dict(panel.downcast(spark.createDataFrame([(1, 300, 1.5)], "a long, b long, c double")).dtypes) == {"a": "tinyint", "b": "smallint", "c": "float"}


def test_least_squares(spark):
    df = spark.createDataFrame([(float(x), float(2 * x + 1 + (-1) ** x), None if x == 3 else 1.0) for x in range(40)], "x double, y double, w double")
    out = {r["term"]: r for r in regress.ols(df, "y", ["x"]).collect()}
    assert out["x"]["coefficient"] == pytest.approx(2, abs=0.01) and 0.99 < out["x"]["r2"] < 1 and out["x"]["n"] == 40
    with pytest.raises(ValueError, match="depend"):
        regress.ols(df.withColumn("z", F.col("x") * 2), "y", ["x", "z"])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿lon,lat,v\n1,2,x\n")
    (tmp_path / "b.csv").write_text("lon,lat,v\n3,4,007\n")
    (tmp_path / "c.csv").write_text("lat,lon,w\n5,6,q\n")
    files = readers.expand(spark, [f"{tmp_path}/[ab].csv", f"{tmp_path}/a.csv"])
    assert len(files) == 2
    assert sorted(map(tuple, readers.read_csv(spark, files, ("lon",)).collect())) == [("1", "2", "x"), ("3", "4", "007")]
    assert readers.read_csv(spark, files, schema="lon double", columns=["lon"]).dtypes == [("lon", "double")]
    for bad in (lambda: readers.read_csv(spark, [files[0], f"{tmp_path}/c.csv"]), lambda: readers.read_csv(spark, files, ("z",)), lambda: readers.expand(spark, [f"{tmp_path}/z*"])):
        with pytest.raises((ValueError, FileNotFoundError)):
            bad()
    assert readers.read_split_csv(spark, [files[0], f"{tmp_path}/c.csv"]).columns == ["lon", "lat", "v", "source_file", "w"]
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    feature = lambda i, kind, c: {"type": "Feature", "properties": {"GID_1": i, "GID_0": "VNM"}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("a", "Polygon", square), feature("b", "MultiPolygon", [square, [[[2, 2], [3, 2], [3, 3], [2, 2]]]])]}))
    g = {r["gid"]: r for r in readers.read_geojson(spark, f"{tmp_path}/g.json", "GID_1", "GID_0").collect()}
    assert g["a"]["country"] == "VNM" and len(g["a"]["rings"]) == 1 and len(g["b"]["rings"]) == 2
    (tmp_path / "t.json").write_text(json.dumps({"N10E105_0_1": [105, 10, 105.5, 10.5]}))
    assert tuple(readers.read_tiles(spark, f"{tmp_path}/t.json").first()) == ("N10E105_0_1", 105.0, 10.0, 105.5, 10.5)
    (tmp_path / "t2.json").write_text(json.dumps({"x": [5, 10, 1, 10.5]}))
    with pytest.raises(ValueError):
        readers.read_tiles(spark, f"{tmp_path}/t2.json")
    (tmp_path / "r.json").write_text('{"GID": "a", "Mean_T21": 300.5, "x": null}')
    t = readers.records_table(readers.read_records(spark, [f"{tmp_path}/r.json"])).first()
    assert (t["GID"], t["Mean_T21"], t["x"]) == ("a", "300.5", None)
    (tmp_path / "n.json").write_text('{"GID": {"a": 1}}')
    with pytest.raises(Exception, match="flat record"):
        readers.read_records(spark, [f"{tmp_path}/n.json"]).collect()
    (tmp_path / "10.5_106.25.json").write_text(json.dumps({"list": [{"dt": 5, "components": {"pm2_5": 7.5}}]}))
    assert tuple(readers.read_series(spark, [f"{tmp_path}/10.5_106.25.json"]).first()) == (10.5, 106.25, 5, 7.5)
    names = spark.createDataFrame([("VNP46A3.A2017032.h28v07.001.2020.h5",), ("x.h5",)], "file string")
    assert [(r["tile"], r["month"]) for r in readers.granules(names).collect()] == [("h28v07", D(2017, 2, 1)), (None, None)]
    df = spark.createDataFrame([("t1", "2020-01", 1.5, 2), ("t1", "2020-02", None, 3)], "tile_id string, month string, b double, a int")
    writers.write_csv(df, f"{tmp_path}/out", ["a", "b"], single=True)
    text = next((tmp_path / "out").glob("part*")).read_text()
    assert text in ("a,b\n2,1.5\n3,\n", 'a,b\n2,1.5\n3,""\n')
    with pytest.raises(Exception, match="already exists"):
        writers.write_csv(df, f"{tmp_path}/out", ["a"])
    writers.write_by_tile_month(df, f"{tmp_path}/parts", ["a", "b"])
    assert (tmp_path / "parts/tile_id=t1/month=2020-02").is_dir()
    made = json.loads(writers.manifest(spark, [str(tmp_path / "r.json")], str(tmp_path / "out"), {"k": 1}))
    assert len(made["inputs"][0]["sha256"]) == 64 and made["outputs"]
    line = writers.geojson_features(boxes(spark, *REGIONS), ["gid"]).first()["value"]
    assert json.loads(line)["geometry"]["coordinates"][0][0] == [95.0, 20.0]


def test_dry_run(spark):
    made = json.loads(dryrun.plan(dryrun.Extraction("2019-12", "2020-01", ("t", "t")), ["ndvi"], spark.range(1)))
    assert made["tasks"] == ["t_10m_2019-12-01", "t_10m_2020-01-01"] and "Range" in made["plan"] and not made["submitted"]
    with pytest.raises(ValueError):
        dryrun.Extraction("2020-02", "2020-01", ("t",))


def test_replay(spark, small, tmp_path):
    src = spark.read.parquet(f"{small}/events.parquet")
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = replay.events(spark, f"{tmp_path}/in", src.schema)
    replay.drain(replay.first_seen(stream.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))), ["event_id"], "60 days"), f"{tmp_path}/a", f"{tmp_path}/ca")
    assert spark.read.parquet(f"{tmp_path}/a").count() == src.count()
    replay.drain(replay.windowed(stream, [], "value", "7 days", late="60 days"), f"{tmp_path}/b", f"{tmp_path}/cb")
    replay.drain(replay.windowed(stream, [], "value", "7 days", late="1 hour").where("n > 0"), f"{tmp_path}/c", f"{tmp_path}/cc")
    batch = {r["start"]: r["n"] for r in replay.windowed(src.withColumn("ts", F.col("ts").cast("timestamp")), [], "value").collect()}
    got = {r["start"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/c").collect()}
    assert set(got) <= set(batch) and all(got[k] <= batch[k] for k in got)


def test_no_data_never_reaches_an_aggregate(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (-9999.0,), (None,), (3.0,)], "v double")
    row = df.select(quality.finite("v").alias("v")).agg(F.avg("v"), F.max("v")).first()
    assert tuple(row) == (2.0, 3.0) and not math.isnan(row[0])
