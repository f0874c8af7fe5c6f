"""Golden values of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridpanel.functions import dates, indices, quality, text
from gridpanel.operators import windows

D = datetime.date


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_month_windows(spark):
    got = {m: [tuple(r) for r in windows.month_windows(spark, "2020-02", "2020-02", m).collect()] for m in windows.MODES}
    assert got == {"historical": [("2020-02", D(2020, 2, 1), D(2020, 2, 29))], "full": [("2020-02", D(2020, 2, 1), D(2020, 3, 1))]}
    assert windows.month_windows(spark, "2020-12", "2020-12", "full").first()["exclusive_end"] == D(2021, 1, 1)
    with pytest.raises(ValueError):
        windows.month_windows(spark, "2020-01", "2020-01", "other")


def test_humidity_and_radar(spark):
    assert one(spark, indices.humidity(F.lit(20.0), F.lit(20.0))) == 1
    assert one(spark, indices.humidity(F.lit(30.0), F.lit(20.0))) == pytest.approx(0.550774901, abs=1e-9)
    assert one(spark, indices.rvi(F.lit(0.08), F.lit(0.02))) == pytest.approx(0.8)
    assert one(spark, indices.rvi(F.lit(0.0), F.lit(0.0))) is None
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, indices.rvi_strict(F.col("id") * 0.0, F.col("id") * 0.0))
    assert one(spark, indices.dprvi(F.lit(0.5), F.lit(2.0))) == 1


def test_bits(spark):
    qc = spark.range(256).select(F.col("id").cast("int").alias("qc"))
    assert qc.where(quality.aqua_ok("qc")).count() == 112
    good = {r["qc"] for r in qc.where(quality.aqua_ok("qc")).collect()}
    assert {2, 31} <= good and not {0, 130} & good and 98 in good
    fire = lambda m, q: one(spark, quality.fire_ok(F.lit(m), F.lit(q)))
    assert [fire(7, 0), fire(0b10111, 0b1000010), fire(6, 0), fire(7, 3)] == [True, True, False, False]
    assert one(spark, indices.scaled(F.lit(123), 0.1)) == pytest.approx(12.3)
    with pytest.raises(ValueError):
        quality.bits("x", 3, 2)


def test_night_light_cells(spark):
    nan = float("nan")
    rows = [(nan, 0, 1.0, 1.0), (-10.0, 0, 1.0, 1.0), (65535.0, 0, 1.0, 1.0), (70000.0, 0, 1.0, 0.0), (100.0, 1, 1.0, 1.0), (100.0, 0, 151.0, 1.0), (100.0, 0, nan, 1.0), (100.0, 0, None, 1.0), (65534.0, 0, 150.0, 1.0), (None, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "raw double, q int, land double, lit double").coalesce(1)
    got = [r[0] if r[0] is None else round(r[0], 6) for r in df.select(quality.night_light("raw", "q", "land", "lit")).collect()]
    assert got == [0, 0, None, 0, None, None, None, None, 6553.4, 0]


def test_dates(spark):
    day = F.lit("2024-02-14").cast("date")
    assert one(spark, dates.last_day_of(F.lit("2024-02"))) == D(2024, 2, 29)
    assert one(spark, dates.previous_months(F.lit("202402"), 3)) == ["2023-12", "2024-01", "2024-02"]
    assert one(spark, dates.week_days(F.lit("202400")))[0] == D(2023, 12, 25)
    for d in (D(2023, 1, 1), D(2024, 1, 1), D(2024, 12, 31), D(2022, 7, 5), D(2026, 1, 4)):
        label = one(spark, dates.week_label(F.lit(d)))
        assert label == d.strftime("%Y%W") and d in one(spark, dates.week_days(F.lit(label)))
    assert one(spark, dates.previous_week(F.lit("202410"), 2)) == "202408"
    assert one(spark, dates.sundays(day, F.date_add(day, 7))) == [D(2024, 2, 18), D(2024, 2, 25)]
    assert one(spark, dates.saturdays(day, F.date_add(day, 7))) == [D(2024, 2, 17), D(2024, 2, 24)]
    assert one(spark, dates.previous_days(day, 3)) == [D(2024, 2, 12), D(2024, 2, 13), D(2024, 2, 14)]
    assert one(spark, dates.next_days(day, 2)) == [D(2024, 2, 14), D(2024, 2, 15)]
    assert one(spark, dates.month_ends(F.lit("2024-01-15").cast("date"), day)) == [D(2024, 1, 31), D(2024, 2, 29)]
    assert tuple(one(spark, dates.clock(F.lit(90061)))) == (1, 1, 1)
    assert [one(spark, dates.day_of_year_to_month(F.lit(x))) for x in (1.0, 31.9, 32.0, -9999.0, float("nan"))] == [1, 1, 2, None, None]
    assert one(spark, dates.local_month(F.lit(1706720400))) == 2


def test_text(spark):
    assert [one(spark, text.safe_filename(F.lit(x))) for x in ("a b/c", "_x_", "é.json")] == ["a_b_c", "x", ".json"]
    assert one(spark, text.split_camel(F.lit("camelCaseName"))) == "camel Case Name"
    assert tuple(one(spark, text.tile_bounds(F.lit("N10E105_0_1")))) == (105.0, 10.0, 105.5, 10.5)
    assert tuple(one(spark, text.tile_bounds(F.lit("S10W105_1_0")))) == (-104.5, -9.5, -104.0, -9.0)
    assert one(spark, text.tile_bounds(F.lit("N10E105"))) is None
    assert one(spark, text.bounds_ok(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(3.0))) is False
    assert one(spark, indices.plot_key(F.lit(105.12345), F.lit(9.0625))) == "105.123_9.062"
    assert one(spark, indices.period(F.lit(2021), F.lit(3))) == "2021-03"
