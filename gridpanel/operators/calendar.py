"""Crop calendars: sampling harvest days at points and turning them into months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_of_year_to_month
from ..functions.quality import finite
from .grid import cell, row_cell

# What the calendar holds.
SEASONS, GROUPS = (1, 2, 3), ("group", "cropping")


def sample_calendar(points: DataFrame, calendar: DataFrame, west: float, north: float, step: float, lon: str = "lon", lat: str = "lat", groups: tuple[str, ...] = ("cropping",), mode: str = "historical") -> DataFrame:
    """points with harvest_{1,2,3}_{group}_doy and _moy of the cell they lie in.

    calendar is wide: px, py and the harvest columns. In historical mode the
    grid's coordinates, which are centres, are taken for edges, and the _doy
    columns hold months, as the published tables do; corrected mode takes centres
    for centres and keeps days in _doy. Values that are no data are null.
    """
    if mode not in ("historical", "corrected"):
        raise ValueError(mode)
    centre = mode == "corrected"
    names = [f"harvest_{s}_{g}" for s in SEASONS for g in groups]
    cells = points.withColumn("px", cell(lon, west, step, centre)).withColumn("py", row_cell(lat, north, step, centre))
    found = cells.join(calendar.select("px", "py", *names), ["px", "py"], "left")
    day = lambda n: finite(n)
    month = lambda n: day_of_year_to_month(n)
    out = [(month(n).cast("double") if mode == "historical" else day(n)).alias(f"{n}_doy") for n in names] + [month(n).alias(f"{n}_moy") for n in names]
    return found.select(*points.columns, *out)


def orientation(df: DataFrame, axis: str) -> DataFrame:
    """ascending, descending: whether an axis' distinct coordinates run that way in the order of their index."""
    per = df.groupBy("i").agg(F.min(axis).alias("c")).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("v"))
    pairs = F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v") - 1), lambda a, b: b - a)
    return per.select(F.forall(pairs, lambda d: d > 0).alias("ascending"), F.forall(pairs, lambda d: d < 0).alias("descending"))
