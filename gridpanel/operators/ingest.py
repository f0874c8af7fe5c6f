"""Fire detections: validation, normalisation, exact dedup, regions and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COUNTRIES, SATELLITES, mapped, signature
from .spatial import point_in_polygon

# What a detection file must have, and the accepted versions.
REQUIRED = ("latitude", "longitude", "brightness", "bright_t31", "frp", "acq_date", "acq_time", "satellite", "confidence", "version")
VERSIONS = ("6.1", "61")


def _number(name: str, low: float | None = None, high: float | None = None) -> Column:
    v = F.expr(f"try_cast(trim(`{name}`) as double)")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.when(ok, v)


def normalized(raw: DataFrame) -> DataFrame:
    """Typed fields of each text row, and problem: the first field that is wrong, else null. Nothing is dropped here."""
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    time = F.lpad(F.trim("acq_time"), 4, "0")
    has = lambda c: c in raw.columns
    fields = {
        "latitude": _number("latitude", -90, 90),
        "longitude": _number("longitude", -180, 180),
        "brightness": _number("brightness", 0),
        "bright_t31": _number("bright_t31", 0),
        "frp": _number("frp", 0),
        "confidence": _number("confidence", 0, 100),
        "acq_date": F.when(F.col("acq_date").rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), F.expr("try_to_date(trim(acq_date), 'yyyy-MM-dd')")),
        "acq_time": F.when(time.rlike(r"^([01]\d|2[0-3])[0-5]\d$") & (F.length(F.trim("acq_time")) <= 4), time),
        "satellite": mapped(F.trim("satellite"), SATELLITES),
        "version": F.when(F.trim("version").isin(*VERSIONS), F.lit("6.1")),
    } | ({"instrument": F.when(F.trim("instrument") == "MODIS", F.lit("MODIS"))} if has("instrument") else {})
    problem = F.lit(None).cast("string")
    for name in reversed(fields):
        problem = F.when(F.col(name).isNull(), F.lit(name)).otherwise(problem)
    rest = [c for c in raw.columns if c not in fields]
    # a generator, so that each field is made once, whatever reads it later
    typed = raw.select(*[F.col(c) for c in rest], F.inline(F.array(F.struct(*[v.alias(n) for n, v in fields.items()]))))
    return typed.select(*fields, *rest, problem.alias("problem"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their problem. Rows are judged before any date filter, so a bad row outside of the period is bad too."""
    return df.where("problem is null").drop("problem"), df.where("problem is not null")


def dedup_exact(df: DataFrame, columns: list[str], order: list[str], policy: str = "drop") -> DataFrame:
    """Rows equal in all the columns: "drop" keeps the first by order, "keep" keeps all with their number, "error" fails when read.

    duplicate is the number of equal rows before the row.
    """
    if policy not in ("drop", "keep", "error"):
        raise ValueError(policy)
    out = df.withColumn("signature", signature(columns))
    if policy == "drop":  # an aggregate, so that a row repeated any number of times is reduced before the shuffle
        first = out.groupBy("signature").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("__row"))
        return first.select("__row.*", "signature", F.lit(0).alias("duplicate"))
    out = out.withColumn("duplicate", F.row_number().over(Window.partitionBy("signature").orderBy(*order)) - 1)
    if policy == "error":
        return out.withColumn("duplicate", F.when(F.col("duplicate") > 0, F.raise_error(F.lit("a row is repeated")).cast("int")).otherwise(0))
    return out


def prepared(raw: DataFrame, regions: DataFrame, start: str, end: str, order: list[str], duplicates: str = "drop", ambiguous: str = "first", unassigned: str = "keep") -> DataFrame:
    """Normalised detections of start..end (both in), once each, with their region, year, month and country."""
    good, _ = quarantine(normalized(raw))
    inside = good.where(F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    columns = [c for c in inside.columns if c not in order]
    once = dedup_exact(inside, columns, order, duplicates).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    named = point_in_polygon(once, regions.withColumnRenamed("gid", "gid_1"), "lon", "lat", "gid_1", ambiguous, unassigned)
    country = mapped(F.substring_index("gid_1", ".", 1), COUNTRIES, keep=True)
    return named.withColumns({"year": F.year("acq_date"), "mon": F.month("acq_date"), "T31": F.col("bright_t31"), "country": country})


def counters(raw: DataFrame, regions: DataFrame, start: str, end: str) -> DataFrame:
    """One row: rows in, bad, outside of the dates, repeated, in several regions, in none."""
    rows = normalized(raw)
    good = rows.where("problem is null")
    inside = good.where(F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    distinct = inside.withColumn("signature", signature([c for c in inside.columns if c != "problem"])).groupBy("signature", "latitude", "longitude").agg(F.count("*").alias("n"))
    placed = point_in_polygon(distinct, regions, "longitude", "latitude")
    a = rows.agg(F.count("*").alias("rows_in"), F.count_if(F.col("problem").isNotNull()).alias("bad"), F.count_if(F.col("problem").isNull() & ~F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("outside_dates"))
    b = placed.agg(F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicates"), F.count_if(F.col("matches") > 1).alias("ambiguous"), F.count_if(F.col("matches") == 0).alias("unassigned"), F.count("*").alias("rows_out"))
    return a.crossJoin(b)


def by_satellite(raw: DataFrame) -> DataFrame:
    """satellite (null for an unknown one), rows and bad rows."""
    return normalized(raw).groupBy("satellite").agg(F.count("*").alias("rows"), F.count("problem").alias("bad"))


def lookup(df: DataFrame) -> DataFrame:
    """Distinct locations with their region, in order."""
    return df.select("lon", "lat", "gid_1", "country").distinct().orderBy("lon", "lat")
