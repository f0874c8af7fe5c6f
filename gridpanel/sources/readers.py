"""Sources: strict CSV, GeoJSON, tile maps, JSON records and series, granule names, collections by month."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how granules are named (product, acquisition year and day, tile, version).
GRANULE = r"VNP46A3\.A(\d{4})(\d{3})\.(h\d{2}v\d{2})\.(\d{3})\."


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files of each pattern, once each and sorted; a pattern without a file is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: set[str] = set()
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        if not found:
            raise FileNotFoundError(f"no file matches {p}")
        out.update(str(s.getPath().toString()) for s in found)
    return sorted(out)


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in a CSV file's first line, without a byte order mark; repeated or empty names are refused."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    names = [n.strip().strip('"') for n in line[0].lstrip("﻿").split(",")]
    if len(set(names)) < len(names) or "" in names:
        raise ValueError(f"{path}: columns are repeated or have no name")
    return names


def read_csv(spark: SparkSession, paths: list[str], required: tuple[str, ...] = (), schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV files with one header, all values as text unless a schema is given; only `columns` are parsed if asked.

    Files are compared by header first: another order or name is refused.
    """
    names = header(spark, paths[0])
    for p in paths[1:]:
        if header(spark, p) != names:
            raise ValueError(f"{p} has another header than {paths[0]}")
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    types = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields} if schema else {}
    full = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    df = spark.read.schema(full).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(paths)
    return df.select(*columns) if columns else df


def read_split_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text files whose headers differ, under all their names in the order first seen, with file and no blanks for absent columns."""
    from ..operators.assemble import header_union

    return header_union([read_csv(spark, [p]).withColumn("source_file", F.lit(p)) for p in paths])


def read_geojson(spark: SparkSession, path: str, gid: str, country: str | None = None) -> DataFrame:
    """gid, country, rings of a FeatureCollection in WGS 84; ids must be there and different, shapes polygons."""
    schema = "type string, crs struct<properties:struct<name:string>>, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    crs = F.coalesce(F.col("crs.properties.name"), F.lit("CRS84"))
    if raw.where((F.coalesce("type", F.lit("")) != "FeatureCollection") | ~crs.rlike("(CRS84|4326)$")).limit(1).count():
        raise ValueError(f"{path} is no FeatureCollection in WGS 84")
    f = raw.select(F.explode("features").alias("f")).select("f.*")
    rings = lambda nested: f"transform({nested}, r -> transform(r, p -> struct(p[0] AS x, p[1] AS y)))"
    single = F.expr(rings("from_json(geometry.coordinates, 'array<array<array<double>>>')"))
    multi = F.expr(rings("flatten(from_json(geometry.coordinates, 'array<array<array<array<double>>>>'))"))
    out = f.select(F.col("properties").getItem(gid).alias("gid"), (F.col("properties").getItem(country) if country else F.lit(None).cast("string")).alias("country"), F.when(F.col("geometry.type") == "Polygon", single).when(F.col("geometry.type") == "MultiPolygon", multi).alias("rings"))
    if out.where("gid is null or rings is null").limit(1).count() or out.groupBy("gid").count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: a polygon has no id or shape, or an id is repeated")
    return out


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """tile_id, west, south, east, north of a JSON object of bounds; wrong bounds are an error."""
    from ..functions.text import bounds_ok

    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<double>>").alias("m"))
    df = raw.select(F.explode("m").alias("tile_id", "b")).select("tile_id", *[F.try_element_at("b", F.lit(i + 1)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))], F.size("b").alias("__n"))
    if bad := df.where(~bounds_ok("west", "south", "east", "north") | (F.col("__n") != 4)).first():
        raise ValueError(f"tile {bad['tile_id']} has no valid bounds")
    return df.drop("__n")


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file and record (name to text) of each JSON file with one flat object; nested, empty or broken ones are an error."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("record"))
    bad = F.col("record").isNull() | (F.size("record") == 0) | F.exists(F.map_values("record"), lambda v: v.rlike(r"^\s*[\[{]"))
    return raw.select("file", F.when(bad, F.raise_error(F.concat(F.lit("no flat record in "), F.col("file"))).cast("map<string,string>")).otherwise(F.col("record")).alias("record"))


def records_table(records: DataFrame) -> DataFrame:
    """Flat records as columns, in the order of their names; the names are collected (a record's fields, not its rows)."""
    names = sorted(r[0] for r in records.select(F.explode(F.map_keys("record"))).distinct().collect())
    return records.select("file", *[F.col("record").getItem(n).alias(n) for n in names])


def read_series(spark: SparkSession, paths: list[str], pattern: str = r"(-?\d+(?:\.\d+)?)_(-?\d+(?:\.\d+)?)\.json$") -> DataFrame:
    """lat, lon (from the file's name), dt, value of nested pollution series, one file per place."""
    schema = "list array<struct<dt:bigint,components:struct<pm2_5:double>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(paths).select("list", F.col("_metadata.file_path").alias("f"))
    return raw.select(F.regexp_extract("f", pattern, 1).cast("double").alias("lat"), F.regexp_extract("f", pattern, 2).cast("double").alias("lon"), F.explode("list").alias("e")).select("lat", "lon", F.col("e.dt").alias("dt"), F.col("e.components.pm2_5").alias("pm2_5"))


def granules(names: DataFrame, column: str = "file") -> DataFrame:
    """tile, month, version of granule file names; others have nulls."""
    year, doy = F.regexp_extract(column, GRANULE, 1), F.regexp_extract(column, GRANULE, 2)
    fits = F.col(column).rlike(GRANULE)
    day = F.date_add(F.make_date(F.when(fits, year).cast("int"), F.lit(1), F.lit(1)), F.when(fits, doy).cast("int") - 1)
    return names.withColumns({"tile": F.when(fits, F.regexp_extract(column, GRANULE, 3)), "month": day, "version": F.when(fits, F.regexp_extract(column, GRANULE, 4))})


def collection(spark: SparkSession, path: str, start: str, end: str, bounds: tuple[float, float, float, float] | None = None, properties: dict | None = None, contains: dict | None = None) -> DataFrame:
    """Observations of [start, end) within bounds whose properties are equal, or hold the given items; all of it reaches the scan where it can."""
    df = spark.read.parquet(path).where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    if bounds:
        w, s, e, n = bounds
        df = df.where(F.col("lon").between(w, e) & F.col("lat").between(s, n))
    for k, v in (properties or {}).items():
        df = df.where(F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v)
    for k, items in (contains or {}).items():
        for item in items:
            df = df.where(F.array_contains(k, item))
    return df


def asset_path(prefix: str, month: str, label: str) -> str:
    """Path of a monthly asset: prefix/label_YYYY_MM."""
    if not re.fullmatch(r"\d{4}-\d{2}", month):
        raise ValueError(month)
    return f"{prefix.rstrip('/')}/{label}_{month.replace('-', '_')}"
