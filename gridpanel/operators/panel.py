"""Plot-by-month panels: filters, imputation, features, dummies and table assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import log_floor, log_shift, period, plot_key, squared
from .composite import top_frequent

# The panel's columns and how extraction fields are named in it.
NEEDED = ("lon", "lat", "ndvi")
IMPUTED = ("pm25_mean", "temp_av", "rain_cum", "hum_av", "lag_lumen")
RENAMES = {
    "NDVI_mean": "ndvi",
    "RVI_mean": "rvi",
    "PM25_mean": "pm25_mean",
    "PM25_max": "pm25_max",
    "Temperature_mean": "temp_av",
    "Temperature_max": "temp_max",
    "Rel_humidity_mean": "hum_av",
    "Precipitation_sum": "rain_cum",
    "Luminosity": "luminosity",
    "ESI_4wk_mean": "esi_4wk_mean",
    "FPAR_Aqua_mean": "fpar_aqua_mean",
}


def handoff_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RENAMES)


def impute_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the column's mean over df: one aggregate row, joined back without a shuffle of df."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    return df.crossJoin(F.broadcast(means)).select(*[F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def panel_rows(df: DataFrame, imputed: tuple[str, ...] = IMPUTED) -> DataFrame:
    """Rows of a growing phase that have place and index; covariates are filled with means taken after both filters."""
    growing = df.where((F.col("reprod") == 1) | (F.col("veg") == 1)).dropna("any", subset=list(NEEDED))
    return impute_means(growing, list(imputed))


def features(df: DataFrame) -> DataFrame:
    """Logs, squares, the plot key and the period."""
    return df.withColumns({
        "ln_ndvi": log_floor("ndvi"), "ln_pm25": log_floor("pm25_mean"), "ln_temp": log_floor("temp_av"), "ln_rain": log_floor("rain_cum"),
        "ln_hum": log_floor("hum_av"), "ln_lumen": log_shift("lag_lumen"), "plot_id": plot_key("lon", "lat"), "time_id": period("year", "mon"),
    }).withColumn("ln_pm25_2", squared("ln_pm25"))


def time_dummies(df: DataFrame, column: str = "time_id", periods: int = 2400) -> DataFrame:
    """A 0/1 column per period but the first; periods are months, and more than `periods` are refused."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(periods + 1).collect()]
    if len(found) > periods:
        raise ValueError(f"more than {periods} periods")
    return df.select("*", *[F.when(F.col(column) == p, 1).otherwise(0).alias(f"time_{p}") for p in found[1:]])


def plot_categories(df: DataFrame, column: str = "plot_id", top: int = 1000) -> tuple[DataFrame, list[str]]:
    """df with plot_category, and the categories that get a dummy.

    With more than `top` plots the rest become "other", which has no dummy; with
    fewer, all plots but the most frequent one have one. At most top + 1 names come to the driver.
    """
    names = [r[0] for r in top_frequent(df.where(F.col(column).isNotNull()), column, top + 1).collect()]
    if len(names) <= top:
        return df.withColumn("plot_category", F.col(column)), names[1:]
    kept = df.sparkSession.createDataFrame([(n,) for n in names[:top]], "name string")
    joined = df.join(F.broadcast(kept), F.col(column) == F.col("name"), "left")
    return joined.withColumn("plot_category", F.coalesce("name", F.lit("other"))).drop("name"), sorted(names[:top])


def plot_dummies(df: DataFrame, column: str = "plot_id", top: int = 1000) -> DataFrame:
    """df with plot_category and plot_index: the number of the category's dummy, null for the one left out.

    A sparse index instead of a thousand columns; dummy_matrix() makes the columns.
    """
    marked, names = plot_categories(df, column, top)
    numbered = marked.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "plot_category string, plot_index int")
    return marked.join(F.broadcast(numbered), "plot_category", "left")


def dummy_matrix(df: DataFrame, column: str, names: list[str], prefix: str) -> DataFrame:
    return df.select("*", *[F.when(F.col(column) == n, 1).otherwise(0).alias(f"{prefix}_{n}") for n in names])


def lagged(df: DataFrame, plot: list[str], order: str, value: str, out: str, k: int = 1) -> DataFrame:
    """The plot's value k rows before."""
    return df.withColumn(out, F.lag(value, k).over(Window.partitionBy(*plot).orderBy(order)))


def assemble(parts: list[DataFrame], extra: DataFrame, radar: DataFrame, crops: DataFrame, keys: list[str], needed: list[str]) -> DataFrame:
    """Parts united, joined with extra on all rows of both, with radar fields where there are some, rows with all needed values, and crops that match."""
    base = parts[0]
    for p in parts[1:]:
        base = base.unionByName(p, allowMissingColumns=True)
    out = base.join(extra, keys, "full").join(radar, keys, "left")
    return out.dropna("any", subset=needed).join(crops, [k for k in keys if k in crops.columns], "inner")


def with_static(df: DataFrame, static: DataFrame, cell: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """A band without time, such as elevation, beside every month of its cell; cells without it get null."""
    return df.join(static, list(cell), "left")


def aligned(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The columns of all parts side by side, matched by key and not by position; a key that a part lacks, or has twice, is an error when read."""
    marked = [p.groupBy(*keys).agg(F.count("*").alias(f"__n{i}"), *[F.first(c).alias(c) for c in p.columns if c not in keys]) for i, p in enumerate(parts)]
    out = marked[0]
    for p in marked[1:]:
        out = out.join(p, keys, "full")
    whole = F.lit(True)
    for i in range(len(parts)):
        whole = whole & (F.coalesce(F.col(f"__n{i}"), F.lit(0)) == 1)
    names = [c for p in parts for c in p.columns if c not in keys]
    first = F.when(whole, F.col(keys[0])).otherwise(F.raise_error(F.lit("parts are not aligned")).cast(out.schema[keys[0]].dataType))
    return out.select(first.alias(keys[0]), *keys[1:], *names)


def downcast(df: DataFrame) -> DataFrame:
    """Doubles as floats and longs as ints where all values fit; one pass for the ranges."""
    longs = [f.name for f in df.schema.fields if f.dataType.simpleString() == "bigint"]
    row = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in longs]).first() if longs else {}
    size = lambda lo, hi: "tinyint" if -128 <= lo and hi < 128 else "smallint" if -(2**15) <= lo and hi < 2**15 else "int" if -(2**31) <= lo and hi < 2**31 else "bigint"
    cast = {c: size(*row[c]) for c in longs if row[c][0] is not None} | {f.name: "float" for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[F.col(c).cast(cast[c]).alias(c) if c in cast else F.col(c) for c in df.columns])
