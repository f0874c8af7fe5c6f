"""Operators over many rows at few places, whose pairs of rows can't be gone through one by one."""

import random
import threading

import pytest

from gridpanel.operators import grid, spatial


@pytest.fixture
def limited(spark):
    """Jobs are cancelled after 90 seconds, which fails the test."""
    sc = spark.sparkContext
    sc.setJobGroup("limited", "limited", True)
    timer = threading.Timer(90, lambda: sc.cancelJobGroup("limited"))
    timer.start()
    yield spark
    timer.cancel()
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_decay_of_many_rows_at_few_places(limited):
    """300,000 targets and as many sources at three places each: 60 billion pairs of rows, nine of places."""
    rows = limited.range(300_000)
    targets = rows.selectExpr("id", "cast(id % 3 * 3 as double) as x", "0D as y")
    sources = rows.selectExpr("cast(id % 3 * 3 as double) as x", "4D * int(id % 3 = 2) as y", "if(id < 3, null, 2D) as v")
    got = spatial.decay(targets, sources, "id", "v", 5.0)
    by = {r["kind"]: r for r in got.selectExpr("id % 3 as kind", "inv", "inv2").groupBy("kind").agg({"inv": "min", "inv2": "max", "*": "count"}).collect()}
    n = 99_999 * 2.0
    # sources at (0, 0), (3, 0) and (6, 4); targets at (0, 0), (3, 0) and (6, 0)
    want = {0: (n / 3, n / 9), 1: (n / 3 + n / 5, n / 9 + n / 25), 2: (n / 3 + n / 4, n / 9 + n / 16)}
    assert {k: (round(r["min(inv)"], 6), round(r["max(inv2)"], 6), r["count(1)"]) for k, r in by.items()} == {k: (round(a, 6), round(b, 6), 100_000) for k, (a, b) in want.items()}


def test_decay_of_odd_rows(spark):
    """Null places, keys and values, a repeated key, minus zero and NaN."""
    targets = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (None, 0.0, 0.0), (3, -0.0, 0.0), (3, 1.0, 0.0), (4, float("nan"), 0.0)], "id int, x double, y double")
    sources = spark.createDataFrame([(2.0, 0.0, 8.0), (2.0, 0.0, None), (None, 0.0, 5.0), (0.0, 0.0, 7.0), (1.0, 0.0, None), (float("nan"), 0.0, 3.0)], "x double, y double, v double")
    got = {r["id"]: (r["inv"], r["inv2"]) for r in spatial.decay(targets, sources, "id", "v", 5.0).collect()}
    assert got == {1: (4.0, 2.0), 2: (0.0, 0.0), None: (0.0, 0.0), 3: (4.0 + 8.0 + 7.0, 2.0 + 8.0 + 7.0), 4: (0.0, 0.0)}


def test_overlaps_of_many_tiles_of_few_rectangles(limited):
    """40,000 tiles of two rectangles that share pixels: 800 million pairs, none of which is shuffled."""
    tiles = limited.range(40_000).selectExpr("id as tile", "id % 2 * 100 as x", "id % 2 * 80 as y", "150 as w", "90 as h")
    got = grid.overlaps(tiles, block=64).selectExpr("count(*) as n", "sum(a) as a", "sum(b) as b", "count_if(a < b) as ordered").first()
    n = 40_000
    assert (got["n"], got["ordered"]) == (n * (n - 1) // 2,) * 2
    assert (got["a"], got["b"]) == (sum(i * (n - 1 - i) for i in range(n)), sum(i * i for i in range(n)))


@pytest.mark.parametrize("step, same", [(1, 4096), (1, 2), (0.25, 3)])
def test_overlaps_are_those_of_all_pairs(spark, step, same):
    """Repeated rectangles, rows and names, null places, and sizes that are no whole pixels, in parts of any size."""
    rng = random.Random(9)
    rows = [(rng.randrange(90), rng.randrange(-40, 40) * step, rng.randrange(-40, 40) * step, rng.randrange(1, 30) * step, rng.randrange(1, 30) * step) for _ in range(80)]
    rows += [(100 + i, 3 * step, 5 * step, 20 * step, 4 * step) for i in range(9)] + rows[:5]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]}
    odd = [(None, 0.0, 0.0, 9.0, 9.0), (500, None, 0.0, 9.0, 9.0)]
    tiles = spark.createDataFrame([(t, *map(float, r)) for t, *r in rows] + odd, "tile int, x double, y double, w double, h double")
    got = [tuple(r) for r in grid.overlaps(tiles, block=8, same=same).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
