"""Month windows, half-open filters, interval joins and lookbacks.

A month window is [start, end). mode "historical" ends on the month's last day,
which is thereby left out; "full" ends on the first day of the next month.
Interval joins are rewritten as equi joins on the month or the day, so that they
shuffle on a key instead of comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODES = ("historical", "full")
#: The planting seasons as month-day pairs; the 31st of September does not exist.
SEASONS = {
    "early_spring": ("01-15", "02-15"),
    "late_spring": ("05-01", "05-31"),
    "main_autumn": ("06-01", "07-31"),
    "late_autumn": ("06-15", "12-15"),
    "winter": ("11-01", "11-30"),
    "rice_1_s": ("01-01", "01-31"),
    "rice_2_s": ("07-01", "07-31"),
    "rice_3_s": ("09-01", "09-31"),
    "rice_1_n": ("09-01", "09-31"),
    "rice_2_n": ("07-01", "07-31"),
    "rice_3_n": ("10-01", "10-30"),
}


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")


def window_end(day: Column, mode: str) -> Column:
    _check(mode)
    return F.last_day(day) if mode == "historical" else F.add_months(F.trunc(day, "MM"), 1)


def month_windows(spark: SparkSession, start: str, end: str, mode: str = "historical") -> DataFrame:
    """month, start, exclusive_end of every month from start to end (yyyy-MM), both in."""
    first = F.to_date(F.lit(f"{start}-01"))
    months = spark.range(1).select(F.explode(F.sequence(first, F.to_date(F.lit(f"{end}-01")), F.expr("interval 1 month"))).alias("start"))
    return months.select(F.date_format("start", "yyyy-MM").alias("month"), "start", window_end(F.col("start"), mode).alias("exclusive_end"))


def half_open(df: DataFrame, ts: str, start, end) -> DataFrame:
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def inclusive(df: DataFrame, day: str, start, end) -> DataFrame:
    return df.where(F.col(day).between(F.lit(start), F.lit(end)))


def with_month(df: DataFrame, ts: str, mode: str = "historical", out: str = "month") -> DataFrame:
    """Rows inside of their own month's window, with its label; no join is needed, as a month window lies in one month."""
    day = F.to_date(ts)
    return df.where(day < window_end(day, mode)).withColumn(out, F.date_format(day, "yyyy-MM"))


def join_windows(df: DataFrame, windows: DataFrame, ts: str) -> DataFrame:
    """Observations with the month window that holds them: an equi join on the month, then the interval."""
    keyed = windows.withColumn("__m", F.col("start"))
    day = F.to_date(ts)
    return df.withColumn("__m", F.trunc(day, "MM")).join(keyed, "__m").where((day >= F.col("start")) & (day < F.col("exclusive_end"))).drop("__m")


def lookback(fields: DataFrame, observations: DataFrame, keys: list[str], at: str, day: str, value: str, weeks: int = 8) -> DataFrame:
    """For each field (keys, at) and k = 1..weeks: n, total, low and high of the observations in [at - 7k, at).

    Observations are first summed up per key and day; fields stand among these days,
    and each window is a range of days before a field's. So a key's rows are days,
    whose number is bounded, and no field is laid out over the days before it.
    """
    number = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    daily = observations.groupBy(*keys, number(day).alias("__day")).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    own = fields.select(*keys, F.to_date(at).alias("at")).where("at is not null").distinct().withColumn("__day", number("at"))
    rows = daily.withColumn("at", F.lit(None).cast("date")).unionByName(own, allowMissingColumns=True)
    by_day = Window.partitionBy(*keys).orderBy("__day")
    span = lambda k: by_day.rangeBetween(-7 * k, -1)
    made = [F.struct(F.lit(k).alias("weeks"), *[f(c).over(span(k)).alias(c) for f, c in ((F.sum, "n"), (F.sum, "total"), (F.min, "low"), (F.max, "high"))]) for k in range(1, weeks + 1)]
    found = rows.select(*keys, "at", F.array(*made).alias("__w")).where("at is not null")
    return found.select(*keys, "at", F.inline("__w")).where("n is not null")


def days_before(df: DataFrame, at: str, day: str, first: int, last: int) -> DataFrame:
    """Rows whose day lies in [at - first, at - last)."""
    return df.where((F.to_date(day) >= F.date_sub(F.to_date(at), first)) & (F.to_date(day) < F.date_sub(F.to_date(at), last)))


def season_windows(spark: SparkSession, years: list[int], seasons: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """season, year, first, last: dates that don't exist are null, and the window is then invalid."""
    rows = [(s, y, f"{y}-{a}", f"{y}-{b}") for s, (a, b) in (seasons or SEASONS).items() for y in years]
    df = spark.createDataFrame(rows, "season string, year int, a string, b string")
    made = lambda c: F.expr(f"try_to_date({c}, 'yyyy-MM-dd')")
    return df.select("season", "year", made("a").alias("first"), made("b").alias("last"), (made("a").isNotNull() & made("b").isNotNull()).alias("valid"))


def join_seasons(df: DataFrame, windows: DataFrame, ts: str) -> DataFrame:
    """Rows with the valid season windows that hold their day, both ends in: an equi join on the year."""
    day = F.to_date(ts)
    return df.withColumn("__y", F.year(day)).join(windows.where("valid"), F.col("__y") == F.col("year")).where(day.between(F.col("first"), F.col("last"))).drop("__y")


def tiles_by_month(tiles: DataFrame, windows: DataFrame) -> DataFrame:
    """Every tile in every month; both are dimension tables, and tiles count once."""
    return tiles.distinct().crossJoin(windows)
