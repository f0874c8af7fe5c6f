"""Unions of extraction outputs and checks of their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strict_union(parts: list[DataFrame]) -> DataFrame:
    """All rows of parts that have the same columns in the same order; anything else is refused."""
    if not parts:
        raise ValueError("nothing to unite")
    for i, p in enumerate(parts[1:], 2):
        if p.columns != parts[0].columns:
            raise ValueError(f"part {i} has columns {p.columns}, not {parts[0].columns}")
    return reduce(DataFrame.unionAll, parts)


def header_union(parts: list[DataFrame], blank: bool = False) -> DataFrame:
    """All rows under the columns of all parts, in the order in which they are first seen; absent ones null, or blank text."""
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*names)
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names]) if blank else out


def key_report(df: DataFrame, keys: list[str], first: int | None = None, order: list[str] | None = None) -> DataFrame:
    """keys, rows, problem: keys that are blank (in any row) or repeated (in the first rows by order, or in all).

    Blank keys are looked for in every row also where only the first are checked for repeats.
    """
    is_blank = reduce(lambda a, b: a | b, [F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) == "" for k in keys])
    some = df if first is None else df.orderBy(*(order or keys)).limit(first)
    repeated = some.where(~is_blank).groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").withColumn("problem", F.lit("repeated"))
    return repeated.unionByName(df.where(is_blank).groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("problem", F.lit("blank")))


def rows_by_input(df: DataFrame) -> DataFrame:
    """Rows read from each file; df must be a scan of files."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key at the first place at which it is seen."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def missing_keys(needed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return needed.join(found.select(*keys).distinct(), keys, "left_anti")


def truncated(df: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, bool]:
    """The first n rows by order and whether there are more; one row beyond is looked at, no more."""
    more = df.orderBy(*order).limit(n + 1)
    return df.orderBy(*order).limit(n), more.count() > n
