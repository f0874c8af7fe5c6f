"""Sinks: ordered CSV, one folder per tile and month, JSON records, GeoJSON, grids, and manifests with hashes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_filename


def write_csv(df: DataFrame, path: str, selectors: list[str], single: bool = False) -> None:
    """The selected columns in their order, blank for null; existing output is never overwritten."""
    out = df.select(*selectors)
    (out.coalesce(1) if single else out).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_by_tile_month(df: DataFrame, path: str, selectors: list[str], tile: str = "tile_id", month: str = "month", kind: str = "parquet") -> None:
    """A folder per tile and month; rows of one are written by few tasks, large ones are split by size."""
    df.select(tile, month, *selectors).repartition(F.col(tile), F.col(month)).write.mode("errorifexists").partitionBy(tile, month).format(kind).save(path)


def task_name(tile, scale: int, start) -> object:
    """Name of an export: tile_scale m_start."""
    return F.concat(F.col(tile), F.lit(f"_{scale}m_"), F.col(start).cast("string"))


def write_records(df: DataFrame, path: str, country: str = "country") -> None:
    df.withColumn("__folder", safe_filename(country)).write.mode("errorifexists").partitionBy("__folder").json(path)


def geojson_features(df: DataFrame, properties: list[str], rings: str = "rings") -> DataFrame:
    """One Feature as text per row; a coordinate pair is [x, y]."""
    nested = F.transform(F.col(rings), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), nested.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_grid(df: DataFrame, path: str, keys: list[str], bands: list[str], nodata: float | None = None) -> None:
    """A grid table: cell indices, keys and bands as floats, no data as null (or as the value given)."""
    band = lambda c: (F.coalesce(F.col(c), F.lit(nodata)) if nodata is not None else F.col(c)).cast("float").alias(c)
    df.select(*keys, "px", "py", *[band(c) for c in bands]).write.mode("errorifexists").parquet(path)


def hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of every file, by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, inputs: list[str], output: str, settings: dict) -> str:
    """JSON text: settings, and name, size and SHA-256 of each input and output file, sorted by path (a row per file)."""
    row = lambda r: {"name": r["name"], "bytes": r["bytes"], "sha256": r["sha256"]}
    listed = lambda p: [row(r) for r in hashes(spark, p).orderBy("path").toLocalIterator()]
    return json.dumps({"settings": settings, "inputs": [x for p in inputs for x in listed(p)], "outputs": listed(output)}, indent=2, sort_keys=True)


def write_stata(df: DataFrame, path: str, bound: int = 1_000_000) -> None:
    """A Stata 118 file on the driver, so for bounded tables only; more rows than that are refused."""
    rows = df.limit(bound + 1).toPandas()
    if len(rows) > bound:
        raise ValueError(f"Stata files are for {bound} rows at most")
    rows.to_stata(path, write_index=False, version=118)
