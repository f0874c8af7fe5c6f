"""Monthly gap filling: linear between neighbours, along the end lines beyond them, within a year and the December before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONTHS = 13


def year_cubes(df: DataFrame, keys: list[str], month: str, value: str) -> DataFrame:
    """keys, year, series: 13 values, the December before and the year's months; absent months are null.

    Every observation belongs to its year, a December also to the next one, always
    as it was observed: a filled December is never a context. Years that have no
    month of their own are left out.
    """
    m = F.month(month)
    own = F.array(F.struct(F.year(month).alias("y"), m.alias("i")))
    both = F.array(F.struct(F.year(month).alias("y"), m.alias("i")), F.struct((F.year(month) + 1).alias("y"), F.lit(0).alias("i")))
    spread = df.select(*keys, F.explode(F.when(m == 12, both).otherwise(own)).alias("s"), F.col(value).alias("v"))
    slots = [F.max(F.when(F.col("s.i") == i, F.col("v"))) for i in range(MONTHS)]
    return spread.groupBy(*keys, F.col("s.y").alias("year")).agg(F.array(*slots).alias("series"), F.max("s.i").alias("__last")).where("__last > 0").drop("__last")


def interpolated(series: str) -> str:
    """SQL of the filled array: fewer than two values leave it as it is."""
    valid = f"filter(transform({series}, (v, i) -> struct(i AS i, v AS v)), p -> p.v IS NOT NULL)"
    line = "a.v + (b.v - a.v) * (i - a.i) / (b.i - a.i)"
    prev, nxt = "filter(k, p -> p.i < i)", "filter(k, p -> p.i > i)"
    pick = f"CASE WHEN size({prev}) = 0 THEN array(k[0], k[1]) WHEN size({nxt}) = 0 THEN array(k[size(k) - 2], k[size(k) - 1]) ELSE array(element_at({prev}, -1), {nxt}[0]) END"
    at = f"transform(array({pick}), e -> transform(array(struct(e[0] AS a, e[1] AS b)), x -> {line.replace('a.', 'x.a.').replace('b.', 'x.b.')})[0])[0]"
    return f"transform(array({valid}), k -> CASE WHEN size(k) < 2 THEN {series} ELSE transform({series}, (v, i) -> coalesce(v, {at})) END)[0]"


def fill_months(df: DataFrame, keys: list[str], month: str, value: str, zero: bool = True) -> DataFrame:
    """keys, month, value: the twelve months of each year, filled; with zero, negative and missing values become 0."""
    cubes = year_cubes(df, keys, month, value).withColumn("filled", F.expr(interpolated("series")))
    rows = cubes.select(*keys, "year", F.posexplode("filled").alias("i", "v")).where("i > 0")
    v = F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0)) if zero else F.col("v")
    return rows.select(*keys, F.make_date("year", F.col("i"), F.lit(1)).alias("month"), v.alias(value))
