"""Temporal composites, zonal statistics and the nesting of the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import fire_ok

_AGG = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "std": F.stddev_pop, "median": F.median}


def reducers(band: str, stats: list[str], factor: float = 1.0, name: str | None = None) -> list[Column]:
    """One aggregate per statistic, named band_stat; masked (null) values don't count."""
    return [(_AGG[s](F.col(band)) * factor if factor != 1.0 and s != "count" else _AGG[s](F.col(band))).alias(f"{name or band}_{s}") for s in stats]


def composite(df: DataFrame, keys: list[str], bands: dict[str, list[str]], factors: dict[str, float] | None = None) -> DataFrame:
    """A row per key with the statistics of each band."""
    return df.groupBy(*keys).agg(*[c for b, stats in bands.items() for c in reducers(b, stats, (factors or {}).get(b, 1.0))])


def joint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sampling of all bands together: a row with a missing band goes."""
    return df.dropna("any", subset=columns)


def zonal(df: DataFrame, zone: list[str], pixel: list[str], band: str, temporal: str, spatial: list[str]) -> DataFrame:
    """First one value per zone and pixel over time, then statistics over the zone's pixels."""
    inner = df.groupBy(*zone, *pixel).agg(_AGG[temporal](F.col(band)).alias("__v"))
    return inner.groupBy(*zone).agg(*[c.alias(f"{band}_{temporal}_{s}") for s in spatial for c in reducers("__v", [s])])


def fire_power(df: DataFrame, zone: list[str], pixel: list[str], frp: str, fire_mask: str, qa: str, mode: str = "historical", scale: float = 0.1) -> DataFrame:
    """Mean, max and min over a zone of the pixels' mean, max and min power of valid fires.

    In historical mode the temporal minimum is the maximum, as the published
    series has it; corrected mode takes the minimum.
    """
    if mode not in ("historical", "corrected"):
        raise ValueError(mode)
    v = F.when(fire_ok(fire_mask, qa), F.col(frp) * scale)
    inner = df.groupBy(*zone, *pixel).agg(F.avg(v).alias("mean"), F.max(v).alias("max"), (F.max(v) if mode == "historical" else F.min(v)).alias("min"))
    return inner.groupBy(*zone).agg(*[_AGG[s](t).alias(f"MaxFRP_{t}_{s}") for t in ("mean", "max", "min") for s in ("mean", "max", "min")])


def group_mean(df: DataFrame, keys: list[str], value: str, year: str | None = None) -> DataFrame:
    """Group means; the published series leaves the year out, pass it to keep years apart."""
    return df.groupBy(*keys, *([year] if year else [])).agg(F.avg(value).alias(value))


def histogram(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """Count of each class low..high, zeros too, and of everything else under null."""
    spark = df.sparkSession
    known = F.when(F.col(value).between(low, high), F.col(value).cast("int"))
    counted = df.groupBy(known.alias("class")).agg(F.count("*").alias("n"))
    classes = spark.range(low, high + 1).select(F.col("id").cast("int").alias("class"))
    return classes.join(counted.where("class is not null"), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n")).unionByName(counted.where("class is null").select("class", "n"))


def extent(df: DataFrame, west: str = "west", south: str = "south", east: str = "east", north: str = "north") -> DataFrame:
    return df.agg(F.min(west).alias("west"), F.min(south).alias("south"), F.max(east).alias("east"), F.max(north).alias("north"))


def top_frequent(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys, ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)
