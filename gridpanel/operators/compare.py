"""Keyed comparison with tolerances, and profiles of hand-off tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def differs(a: Column, b: Column, tolerance: float | None) -> Column:
    """Null-safe; with a tolerance, numbers may differ by that much and text that is no number is compared as it is."""
    if tolerance is None:
        return ~a.eqNullSafe(b)
    x, y = a.try_cast("double"), b.try_cast("double")
    far = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) > tolerance)
    return F.coalesce(far, ~a.cast("string").eqNullSafe(b.cast("string")))


def keyed_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: dict[str, float] | None = None) -> DataFrame:
    """keys, kind (missing, extra, changed), column, left, right: a full join, long by column."""
    cols = lambda df, side: df.select(*keys, F.lit(True).alias(f"__{side}"), *[F.col(c).alias(f"__{side}_{c}") for c in columns])
    both = cols(left, "l").join(cols(right, "r"), keys, "full")
    one = F.when(F.col("__r").isNull(), F.lit("missing")).when(F.col("__l").isNull(), F.lit("extra"))
    none = F.lit(None).cast("string")
    changes = [F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull() & differs(F.col(f"__l_{c}"), F.col(f"__r_{c}"), (tolerance or {}).get(c)), F.struct(F.lit("changed").alias("kind"), F.lit(c).alias("column"), F.col(f"__l_{c}").cast("string").alias("left"), F.col(f"__r_{c}").cast("string").alias("right"))) for c in columns]
    whole = F.when(one.isNotNull(), F.struct(one.alias("kind"), none.alias("column"), none.alias("left"), none.alias("right")))
    found = F.filter(F.array(whole, *changes), lambda x: x.isNotNull())
    return both.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind", "column").agg(F.count("*").alias("n"))


def records_against(records: DataFrame, rows: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Records that a table lacks or has otherwise; rows that only the table has don't matter."""
    return keyed_diff(records, rows, keys, columns, {c: tolerance for c in columns}).where("kind <> 'extra'")


def profile(df: DataFrame, columns: list[str], distinct: bool = False) -> DataFrame:
    """column, rows, nulls, zeros, not_numeric and, if asked for, distinct (different values): one pass, long by column."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    number = lambda c: F.col(c) if c in numeric else F.col(c).cast("string").try_cast("double")
    odd = lambda c: F.lit(0).cast("long") if c in numeric else F.count_if(F.col(c).isNotNull() & number(c).isNull())
    more = lambda c: [F.count_distinct(c).alias("distinct")] if distinct else []
    made = lambda c: F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(number(c) == 0).alias("zeros"), odd(c).alias("not_numeric"), *more(c))
    one = df.agg(*[made(c).alias(f"__{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.col(f"__{i}") for i in range(len(columns))])).alias("p")).select("p.*")


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std (of a sample), min, q25, q50, q75, max of numeric columns, nulls left out: one pass, quantiles interpolated."""
    made = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(F.col(c).cast("double")).alias("max"))
    one = df.agg(*[made(c).alias(f"__{i}") for i, c in enumerate(columns)])
    rows = one.select(F.explode(F.array(*[F.col(f"__{i}") for i in range(len(columns))])).alias("p")).select("p.*")
    return rows.select("column", "n", "mean", "std", "min", *[F.col("q")[i].alias(f"q{n}") for i, n in enumerate((25, 50, 75))], "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """The column's different values, null left out, and how often they occur."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def handoff(df: DataFrame, required: list[str], keys: list[str], first: int | None = None, order: list[str] | None = None) -> DataFrame:
    """check, n: missing columns, nulls, values that are no numbers, repeated keys (among the first rows if asked)."""
    missing = [c for c in required if c not in df.columns]
    there = [c for c in required if c in df.columns]
    some = df if first is None else df.orderBy(*(order or keys)).limit(first)
    rows = df.sparkSession.createDataFrame([("missing_columns", len(missing))], "check string, n long")
    if there:
        sums = profile(some, there).agg(F.sum("nulls").alias("nulls"), F.sum("not_numeric").alias("not_numeric"))
        rows = rows.unionByName(sums.select(F.explode(F.map_from_arrays(F.array(F.lit("nulls"), F.lit("not_numeric")), F.array("nulls", "not_numeric"))).alias("check", "n")))
    if all(k in df.columns for k in keys):
        repeated = some.groupBy(*keys).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n"))
        rows = rows.unionByName(repeated.select(F.lit("duplicate_keys").alias("check"), "n"))
    return rows
