"""GeoTIFF rasters as long tables and back: baseline TIFF, strips or tiles, plain or deflated, with GeoTIFF placement.

Files are read whole by executors (binaryFile), so a raster should be a tile of
a mosaic, not a country; cells without data are not rows.
"""

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tag numbers and field types of the TIFF and GeoTIFF formats.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946


@dataclass(frozen=True)
class Raster:
    """Values (band, row, column) and the place of the north-west corner; nodata as the file has it."""

    values: np.ndarray
    west: float | None
    north: float | None
    dx: float | None
    dy: float | None
    nodata: float | None


def _fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = KINDS.get(kind)
        if not code:
            continue
        size = struct.calcsize(order + code) * n
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        out[tag] = (data[place : place + n].rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack_from(order + code * n, data, place)
    return order, out


def decode(data: bytes) -> Raster:
    order, f = _fields(data)
    w, h, bands = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
    bits, kind, packing = f.get(BITS, (1,))[0], f.get(FORMAT, (1,))[0], f.get(COMPRESSION, (NONE,))[0]
    if packing not in (NONE, DEFLATE, OLD_DEFLATE) or bits not in (8, 16, 32, 64) or f.get(PREDICTOR, (1,))[0] not in (1, 2):
        raise ValueError(f"TIFF of {bits} bits with compression {packing} isn't read")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))
    tiled, planar = TILE_AT in f, f.get(PLANAR, (1,))[0] == 2
    bw, bh = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (w, f.get(STRIP_ROWS, (h,))[0])
    across, down, deep = -(-w // bw), -(-h // bh), 1 if planar else bands
    out = np.zeros((bands, h, w), dtype=dtype.newbyteorder("="))
    for i, (at, size) in enumerate(zip(f[TILE_AT if tiled else STRIP_AT], f[TILE_SIZE if tiled else STRIP_SIZE])):
        raw = data[at : at + size]
        raw = zlib.decompress(raw) if packing != NONE else raw
        band, k = divmod(i, across * down) if planar else (0, i)
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        block = np.frombuffer(raw, dtype, rows * bw * deep).reshape(rows, bw, deep)
        if f.get(PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        part = block[: h - y, : w - x].transpose(2, 0, 1)
        out[band : band + deep, y : y + part.shape[1], x : x + part.shape[2]] = part
    scale, tie = f.get(PIXEL_SCALE), f.get(TIEPOINT)
    placed = bool(scale and tie)
    nodata = float(f[NODATA][0]) if f.get(NODATA, ("",))[0].strip() else None
    return Raster(out, tie[3] - tie[0] * scale[0] if placed else None, tie[4] + tie[1] * scale[1] if placed else None, scale[0] if placed else None, scale[1] if placed else None, nodata)


def encode(values: np.ndarray, west: float, north: float, dx: float, dy: float, nodata: float | None = None, tile: int = 256) -> bytes:
    """A tiled, deflated GeoTIFF in WGS 84."""
    bands, h, w = values.shape
    dtype = values.dtype.newbyteorder("<")
    blocks = []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            block = np.zeros((tile, tile, bands), dtype)
            part = values[:, y : y + tile, x : x + tile].transpose(1, 2, 0)
            block[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(block.tobytes(), 6))
    tags = {
        WIDTH: ("I", [w]), HEIGHT: ("I", [h]), BITS: ("H", [dtype.itemsize * 8] * bands), COMPRESSION: ("H", [DEFLATE]), PHOTOMETRIC: ("H", [1]), SAMPLES: ("H", [bands]), PLANAR: ("H", [1]),
        TILE_WIDTH: ("I", [tile]), TILE_HEIGHT: ("I", [tile]), TILE_AT: ("I", [0] * len(blocks)), TILE_SIZE: ("I", list(map(len, blocks))), FORMAT: ("H", [{"u": 1, "i": 2, "f": 3}[dtype.kind]] * bands),
        PIXEL_SCALE: ("d", [dx, dy, 0.0]), TIEPOINT: ("d", [0.0, 0.0, 0.0, west, north, 0.0]), GEO_KEYS: ("H", [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326]),
    } | ({NODATA: ("s", [f"{nodata:g}".encode() + b"\0"])} if nodata is not None else {})
    number = {v: k for k, v in KINDS.items()}
    body = lambda code, v: v[0] if code == "s" else struct.pack("<" + code * len(v), *v)
    extra_at = 8 + 2 + 12 * len(tags) + 4
    data_at = extra_at + sum(len(body(*tags[t])) + len(body(*tags[t])) % 2 for t in tags if len(body(*tags[t])) > 4)
    starts = np.cumsum([data_at, *map(len, blocks)])[:-1].tolist()
    tags[TILE_AT] = ("I", starts)
    head, extra = b"II" + struct.pack("<HIH", 42, 8, len(tags)), b""
    for t in sorted(tags):
        code, v = tags[t]
        raw = body(code, v)
        n = len(raw) if code == "s" else len(v)
        if len(raw) <= 4:
            field = raw.ljust(4, b"\0")
        else:
            field = struct.pack("<I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        head += struct.pack("<HHI", t, number[code], n) + field
    return head + struct.pack("<I", 0) + extra + b"".join(blocks)


def read_headers(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """path, bands, height, width, west, north, dx, dy, nodata of every raster; cells are not kept."""
    schema = "path string, bands int, height int, width int, west double, north double, dx double, dy double, nodata double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                r = decode(content.as_py())
                rows.append((name, *r.values.shape, r.west, r.north, r.dx, r.dy, r.nodata))
            if rows:
                kinds = [pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return _files(spark, path, pattern).mapInArrow(run, schema)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Whole files; the setting, which bounds the batches that they travel in, is the session's and stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def write_tiles(tiles: DataFrame, path: str, content: str = "content") -> None:
    """A file per row of encode_tiles(), part-*, by Spark's text writer; the line feed after the last byte is outside of the raster."""
    tiles.select(F.col(content).cast("string").alias("value")).write.mode("errorifexists").option("maxRecordsPerFile", 1).text(path)


def read_cells(spark: SparkSession, path: str, keep_nodata: bool = False, pattern: str = "*.tif") -> DataFrame:
    """path, band (from 1), px, py, lon, lat (cell centres; null without a place), value: a row per cell with data."""
    schema = "path string, band int, px int, py int, lon double, lat double, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                r = decode(content.as_py())
                for band, grid in enumerate(r.values, 1):
                    for top in range(0, grid.shape[0], 256):
                        part = grid[top : top + 256].astype(np.float64)
                        good = np.ones(part.shape, bool) if keep_nodata else np.isfinite(part) & (part != r.nodata if r.nodata is not None else True)
                        py, px = np.nonzero(good)
                        value = part[py, px]
                        py = py + top
                        none = pa.nulls(len(px), pa.float64())
                        lon = pa.array(r.west + (px + 0.5) * r.dx) if r.dx else none
                        lat = pa.array(r.north - (py + 0.5) * r.dy) if r.dy else none
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(px), pa.string()), pa.array(np.full(len(px), band, np.int32)), pa.array(px.astype(np.int32)), pa.array(py.astype(np.int32)), lon, lat, pa.array(value)], names=["path", "band", "px", "py", "lon", "lat", "value"])

    return _files(spark, path, pattern).mapInArrow(run, schema)


def encode_tiles(cells: DataFrame, key: str, bands: list[str], width: int, height: int, dx: float, dy: float, nodata: float = -9999.0, kind: str = "float32") -> DataFrame:
    """key, content: one GeoTIFF per key from its cells (key, px, py, west, north and the band columns); absent and null cells are no data.

    A key's cells, width * height at most, meet in one task.
    """
    own = cells.select(F.col(key).alias("key"), "px", "py", "west", "north", *[F.col(b).cast("double") for b in bands])

    def run(t: pa.Table) -> pa.Table:
        grid = np.full((len(bands), height, width), nodata)
        px, py = t["px"].to_numpy(), t["py"].to_numpy()
        for i, b in enumerate(bands):
            v = t[b].to_numpy(zero_copy_only=False).astype(np.float64)
            ok = np.isfinite(v)
            grid[i, py[ok], px[ok]] = v[ok]
        data = encode(grid.astype(kind), t["west"][0].as_py(), t["north"][0].as_py(), dx, dy, nodata)
        return pa.table({"key": t["key"].slice(0, 1), "content": pa.array([data], pa.binary())})

    return own.groupBy("key").applyInArrow(run, own.select("key").schema.add("content", "binary")).withColumnRenamed("key", key)
