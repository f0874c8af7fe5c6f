"""GeoTIFF round trips and release archives."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpanel.plans import release
from gridpanel.sources import raster


def test_round_trip():
    rng = np.random.default_rng(1)
    for kind in ("uint8", "int16", "float32", "float64"):
        v = (rng.normal(0, 50, (2, 300, 270))).astype(kind)
        r = raster.decode(raster.encode(v, 105.0, 20.0, 0.01, 0.02, -9999))
        assert (r.values == v).all() and (r.west, r.north, r.dx, r.dy, r.nodata) == (105.0, 20.0, 0.01, 0.02, -9999)
    for bad in (b"", b"II*\0", b"PK\3\4" * 9):
        with pytest.raises((ValueError, struct.error)):
            raster.decode(bad)


def test_strips_and_big_endian():
    v = np.arange(12, dtype=">i2").reshape(3, 4)
    strips = [zlib.compress(v[:2].tobytes()), zlib.compress(v[2:].tobytes())]
    tags = [(256, 3, [4]), (257, 3, [3]), (258, 3, [16]), (259, 3, [8]), (273, 4, [200, 200 + len(strips[0])]), (278, 3, [2]), (279, 4, list(map(len, strips))), (339, 3, [2])]
    head, extra = b"MM" + struct.pack(">HIH", 42, 8, len(tags)), b""
    at = 8 + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(">" + {3: "H", 4: "I"}[kind] * len(values), *values)
        field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", at + len(extra))
        extra += raw if len(raw) > 4 else b""
        head += struct.pack(">HHI", tag, kind, len(values)) + field
    data = (head + b"\0" * 4 + extra).ljust(200, b"\0") + b"".join(strips)
    r = raster.decode(data)
    assert (r.values[0] == v).all() and r.west is None


def test_cells_and_tiles(spark, tmp_path):
    grid = np.array([[[1, -9999], [np.nan, 4]]], dtype="float32")
    (tmp_path / "a.tif").write_bytes(raster.encode(grid, 100.0, 10.0, 0.5, 0.5, -9999))
    cells = raster.read_cells(spark, str(tmp_path)).orderBy("value").collect()
    assert [(c["band"], c["px"], c["py"], c["lon"], c["lat"], c["value"]) for c in cells] == [(1, 0, 0, 100.25, 9.75, 1.0), (1, 1, 1, 100.75, 9.25, 4.0)]
    assert raster.read_cells(spark, str(tmp_path), keep_nodata=True).count() == 4
    head = raster.read_headers(spark, str(tmp_path)).first()
    assert (head["bands"], head["height"], head["width"], head["nodata"]) == (1, 2, 2, -9999)
    df = spark.createDataFrame([("t", 0, 0, 5.0, 1.0), ("t", 1, 1, None, 2.0), ("u", 1, 0, 7.0, 3.0)], "tile string, px int, py int, a double, b double").withColumns({"west": F.lit(100.0), "north": F.lit(10.0)})
    made = {r["tile"]: raster.decode(bytes(r["content"])) for r in raster.encode_tiles(df, "tile", ["a", "b"], 2, 2, 0.5, 0.5).collect()}
    assert made["t"].values.tolist() == [[[5, -9999], [-9999, -9999]], [[1, -9999], [-9999, 2]]] and made["u"].values[0, 0, 1] == 7


def test_release(tmp_path):
    (tmp_path / "a.md").write_text("text")
    (tmp_path / "k.txt").write_text("api_key = 'abcdefghijklmnop'")
    one = release.build({"x/a.md": tmp_path / "a.md"}, tmp_path / "1.zip")
    release.build({"x/a.md": tmp_path / "a.md"}, tmp_path / "2.zip")
    assert (tmp_path / "1.zip").read_bytes() == (tmp_path / "2.zip").read_bytes() and list(one) == ["x/a.md"]
    for files in ({"k.txt": tmp_path / "k.txt"}, {"../a.md": tmp_path / "a.md"}):
        with pytest.raises(ValueError):
            release.build(files, tmp_path / "3.zip")
    with pytest.raises(FileExistsError):
        release.build({}, tmp_path / "1.zip")
