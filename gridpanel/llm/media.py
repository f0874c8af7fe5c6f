"""Local image descriptors: cropped or edited copies by matched corners that agree on one geometry.

Corners of several scales are turned to their own direction and described by
binary tests. A Hamming table's key is made of sampled bits of a corner and of
its next corner in one direction, so that two pictures meet by an arrangement
and not by a common kind of corner. Pictures that meet are compared corner by
corner, and count as copies if a share of the corners of the smaller one agrees
on one turn, scale and shift.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_hot, kept, small_batches
from .components import components

#: Scales of the pyramid, radius of a patch, tests of a descriptor, tables (directions to the next corner) and sampled bits of each of a key's two corners.
SCALES, RADIUS, TESTS = (1.0, 1.4142135623730951, 2.0), 9, 128
TABLES, KEY_BITS = 4, 26
#: Keys that compared pictures have in common at least.
COMMON = 2
#: Bits in which matched descriptors may differ, places that have to agree, and their share of those of the smaller picture.
MAX_BITS, AGREE, SHARE = 20, 6, 0.65
#: Geometries that are counted out for a pair of pictures, the best voted ones.
TRIES = 16
#: Pairs of pictures in a task that compares them.
PAIRS = 4096
#: Pictures with a key that are compared in one task; more are compared in pairs of parts of this size.
PART = 2048


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values from a binary PGM or PPM, or a PNG of 8 bits a channel without interlacing; else None."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            parts, at = [], 2
            while len(parts) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while end < len(data) and not data[end : end + 1].isspace():
                    end += 1
                parts.append(int(data[at:end]))
                at = end
            w, h, _ = parts
            depth = 1 if data[1:2] == b"5" else 3
            raw = np.frombuffer(data, np.uint8, w * h * depth, at + 1).reshape(h, w, depth)
        elif data and data[:8] == b"\x89PNG\r\n\x1a\n":
            raw = _png(data)
        else:
            return None
        raw = raw.astype(np.float64)
        if raw.shape[2] in (2, 4):
            raw = raw[:, :, :-1]
        return raw @ np.array([0.299, 0.587, 0.114]) if raw.shape[2] == 3 else raw[:, :, 0]
    except (ValueError, IndexError, KeyError, zlib.error):
        return None


def encode(grey: np.ndarray) -> bytes:
    """A binary PGM of grey values."""
    return b"P5\n%d %d\n255\n" % grey.shape[::-1] + np.rint(np.clip(grey, 0, 255)).astype(np.uint8).tobytes()


def _png(data: bytes) -> np.ndarray:
    at, body = 8, b""
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h = int.from_bytes(part[:4], "big"), int.from_bytes(part[4:8], "big")
            depth, channels = part[8], {0: 1, 2: 3, 4: 2, 6: 4}[part[9]]
            if depth != 8 or part[12]:
                raise ValueError("unsupported PNG")
        elif kind == b"IDAT":
            body += part
        at += size + 12
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * channels + 1)
    out = np.zeros((h + 1, w * channels + channels), dtype=np.int64)
    for y in range(h):
        line, above, kind = rows[y, 1:].astype(np.int64), out[y], rows[y, 0]
        own = out[y + 1]
        if kind in (0, 2):
            own[channels:] = (line + (above[channels:] if kind == 2 else 0)) & 255
        else:
            for x in range(w * channels):
                a, b, c = own[x], above[x + channels], above[x]
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[x + channels] = (line[x] + guess) & 255
    return out[1:, channels:].reshape(h, w, channels)


def resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, by pixel centres."""
    y = np.clip((np.arange(h) + 0.5) * image.shape[0] / h - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * image.shape[1] / w - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, image.shape[0] - 2)), np.minimum(x.astype(int), max(0, image.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (image[y0][:, x0] * (1 - fy) + image[y1][:, x0] * fy) * (1 - fx) + (image[y0][:, x1] * (1 - fy) + image[y1][:, x1] * fy) * fx


def _blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian over the last two axes, edges carried on."""
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    h, w = image.shape[-2:]
    padded = image[..., np.clip(np.arange(-r, h + r), 0, h - 1), :]
    image = k[r] * padded[..., r : r + h, :]
    for i in range(r):
        image += k[i] * (padded[..., i : i + h, :] + padded[..., 2 * r - i : 2 * r - i + h, :])
    padded = image[..., np.clip(np.arange(-r, w + r), 0, w - 1)]
    image = k[r] * padded[..., r : r + w]
    for i in range(r):
        image += k[i] * (padded[..., i : i + w] + padded[..., 2 * r - i : 2 * r - i + w])
    return image


def _tests() -> np.ndarray:
    """Pairs of points within the patch, the same everywhere: (TESTS, 4)."""
    return np.clip(np.random.default_rng(11).normal(0, RADIUS / 2.5, (TESTS, 4)), -RADIUS * 0.7, RADIUS * 0.7)


def described(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, direction, scale) in the image's own pixels, and their descriptors (n, 2) of unsigned 64 bits.

    Corners are the local maxima of the Harris measure over a hundredth of the
    largest one of their scale; there is no limit to their number.
    """
    points, codes, tests = [], [], _tests()
    disk = [(dx, dy) for dy in range(-RADIUS, RADIUS + 1) for dx in range(-RADIUS, RADIUS + 1) if dx * dx + dy * dy <= RADIUS * RADIUS]
    dx, dy = np.array(disk).T
    for scale in SCALES:
        h, w = (int(round(n / scale)) for n in image.shape)
        if min(h, w) < 2 * RADIUS + 3:
            break
        level = _blurred(resized(image, h, w), 1.0)
        gy, gx = np.gradient(level)
        a, b, c = _blurred(np.stack([gx * gx, gy * gy, gx * gy]), 1.5)
        measure = a * b - c * c - 0.05 * (a + b) ** 2
        inner = measure[RADIUS : h - RADIUS, RADIUS : w - RADIUS]
        rows = np.maximum(np.maximum(measure[RADIUS - 1 : h - RADIUS - 1], measure[RADIUS : h - RADIUS]), measure[RADIUS + 1 : h - RADIUS + 1])
        around = np.maximum(np.maximum(rows[:, RADIUS - 1 : w - RADIUS - 1], rows[:, RADIUS : w - RADIUS]), rows[:, RADIUS + 1 : w - RADIUS + 1])
        y, x = np.nonzero((inner >= around) & (inner > max(1e-6, 0.01 * measure.max())))
        if not len(y):
            continue
        y, x = y + RADIUS, x + RADIUS
        patch = level[y[:, None] + dy, x[:, None] + dx]
        angle = np.arctan2(patch @ dy, patch @ dx)
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        value = []
        for u, v in ((tests[:, 0], tests[:, 1]), (tests[:, 2], tests[:, 3])):
            px = np.clip(np.rint(x[:, None] + cos * u - sin * v).astype(int), 0, w - 1)
            py = np.clip(np.rint(y[:, None] + sin * u + cos * v).astype(int), 0, h - 1)
            value.append(level[py, px])
        codes.append(np.packbits(value[0] < value[1], axis=1, bitorder="little").view(np.uint64))
        points.append(np.column_stack([(x + 0.5) * image.shape[1] / w, (y + 0.5) * image.shape[0] / h, angle, np.full(len(x), scale)]))
    if not points:
        return np.zeros((0, 4)), np.zeros((0, 2), dtype=np.uint64)
    return np.concatenate(points), np.concatenate(codes)


def _keys(points: np.ndarray, codes: np.ndarray, step: int = 512) -> np.ndarray:
    """The different keys of a picture: in each table the sampled bits of a corner and of the nearest one of its scale in a quarter of the directions about it."""
    n = len(points)
    if n < 2:
        return np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").astype(np.int64)
    rng, weight = np.random.default_rng(5), 1 << np.arange(KEY_BITS, dtype=np.int64)
    chosen = [[rng.choice(TESTS, KEY_BITS, replace=False) for _ in (0, 1)] for _ in range(TABLES)]
    own, other = ([bits[:, c[k]] @ weight for c in chosen] for k in (0, 1))
    x, y, angle, scale = points.T
    out = []
    for at in range(0, n, step):
        part = slice(at, at + step)
        dx, dy = x[None] - x[part, None], y[None] - y[part, None]
        far = np.where((scale[None] == scale[part, None]) & ((dx != 0) | (dy != 0)), dx * dx + dy * dy, np.inf)
        quarter = np.minimum(((np.arctan2(dy, dx) - angle[part, None]) % (2 * np.pi) * (TABLES / (2 * np.pi))).astype(np.int8), TABLES - 1)
        for t in range(TABLES):
            d = np.where(quarter == t, far, np.inf)
            j = d.argmin(axis=1)
            has = np.flatnonzero(np.isfinite(d[np.arange(len(j)), j]))
            out.append(((own[t][part][has] << KEY_BITS | other[t][j[has]]) * TABLES) + t)
    return np.unique(np.concatenate(out))


def _packed(points: np.ndarray) -> np.ndarray:
    """A corner in one number: x and y in quarters of a pixel, the turn in 1024 parts, the scale's number."""
    x, y = (np.clip(np.rint(points[:, i] * 4), 0, (1 << 24) - 1).astype(np.int64) for i in (0, 1))
    turn = np.rint(points[:, 2] / (2 * np.pi) * 1024).astype(np.int64) & 1023
    return ((x << 24 | y) << 10 | turn) << 4 | np.searchsorted(SCALES, points[:, 3] - 1e-9)


def _unpacked(place: np.ndarray) -> np.ndarray:
    x, y, turn, scale = place >> 38, place >> 14 & ((1 << 24) - 1), place >> 4 & 1023, place & 15
    return np.column_stack([x / 4, y / 4, turn * (2 * np.pi / 1024), np.array(SCALES)[scale]])


def _blob(points: np.ndarray, codes: np.ndarray) -> bytes:
    """All corners of a picture, 24 bytes each."""
    return np.column_stack([codes.view(np.int64), _packed(points)]).tobytes() if len(points) else b""


CORNERS = "node long, decoded boolean, corners int, keys array<long>, blob binary"


def _corners(classes: DataFrame, image: str) -> DataFrame:
    """CORNERS of each node's picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                grey = decode(data.as_py())
                points, codes = described(grey) if grey is not None else (np.zeros((0, 4)), np.zeros((0, 2), dtype=np.uint64))
                rows.append((node, grey is not None, len(points), _keys(points, codes), _blob(points, codes)))
            if rows:
                kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["node", "decoded", "corners", "keys", "blob"])

    return classes.select("node", image).mapInArrow(run, CORNERS)


def _unblob(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(data, dtype=np.int64).reshape(-1, 3)
    return rows[:, :2].view(np.uint64), _unpacked(rows[:, 2])


def matches(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of descriptors, one of each picture, that differ in max_bits bits at most."""
    found = []
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None, 0] ^ b[None, :, 0]) + np.bitwise_count(a[at : at + step, None, 1] ^ b[None, :, 1]) <= max_bits)
        found.append((i + at, j))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _places(points: np.ndarray) -> np.ndarray:
    """A number for each point's cell of four pixels."""
    cell = np.rint(points[:, :2] / 4).astype(np.int64)
    return cell[:, 0] << 32 | cell[:, 1]


def agreeing(a: np.ndarray, b: np.ndarray, tolerance: float = 2.0) -> int:
    """Places of matched points (x, y, direction, scale; row by row) that agree on one turn, scale and shift, of the smaller number of both sides.

    Every match proposes a geometry; those of the TRIES best voted cells of
    turn, scale and shift are counted out.
    """
    if not len(a):
        return 0
    turn, size = b[:, 2] - a[:, 2], b[:, 3] / a[:, 3]
    middle = a[:, :2].mean(axis=0)
    c, s = np.cos(turn) * size, np.sin(turn) * size
    x, y = a[:, 0] - middle[0], a[:, 1] - middle[1]
    shift_x, shift_y = b[:, 0] - (c * x - s * y), b[:, 1] - (s * x + c * y)
    vote = np.rint(np.column_stack([turn % (2 * np.pi) * (16 / (2 * np.pi)) % 16, np.log2(size) * 2, shift_x / 12, shift_y / 12])).astype(np.int64) % (1 << 14)
    vote[:, 0] %= 16
    _, first, n = np.unique(vote @ np.array([1, 1 << 14, 1 << 28, 1 << 42]), return_index=True, return_counts=True)
    pa_, pb_, best = _places(a), _places(b), 0
    for k in first[np.argsort(-n, kind="stable")[:TRIES]]:
        # the geometry of one match, made finer by all that agree with it
        cos, sin, sx, sy, way = c[k], s[k], shift_x[k], shift_y[k], turn[k]
        for _ in (0, 1):
            near = np.hypot(cos * x - sin * y + sx - b[:, 0], sin * x + cos * y + sy - b[:, 1]) <= tolerance * max(1.0, size[k])
            turned = np.abs((turn - way + np.pi) % (2 * np.pi) - np.pi) <= 0.25
            hit = np.flatnonzero(near & turned & (np.abs(np.log(size / size[k])) <= 0.4))
            best = max(best, min(len(np.unique(p[hit])) for p in (pa_, pb_)) if len(hit) else 0)
            if len(hit) < 3:
                break
            u, v = x[hit] + 1j * y[hit], b[hit, 0] + 1j * b[hit, 1]
            spread = np.abs(u - u.mean()) ** 2
            if spread.sum() < 1:
                break
            whole = ((v - v.mean()) * np.conj(u - u.mean())).sum() / spread.sum()
            move = v.mean() - whole * u.mean()
            cos, sin, sx, sy, way = whole.real, whole.imag, move.real, move.imag, float(np.angle(whole))
    return best


def linked(a: bytes, b: bytes, max_bits: int = MAX_BITS, agree: int = AGREE, share: float = SHARE) -> bool:
    """Whether two pictures, given by their corners, are copies."""
    (ca, qa), (cb, qb) = _unblob(a), _unblob(b)
    if min(len(ca), len(cb)) < agree:
        return False
    need = max(agree, share * min(len(np.unique(_places(qa))), len(np.unique(_places(qb)))))
    i, j = matches(ca, cb, max_bits)
    return len(i) >= need and agreeing(qa[i], qb[j]) >= need


def _verified(pairs: DataFrame, corners: DataFrame, max_bits: int, agree: int, share: float) -> DataFrame:
    """The pairs (a, b) of nodes that are copies; pairs are spread by number, as comparing them takes time and not bytes."""
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, pairs.count() // PAIRS)
    of = lambda side: corners.select(F.col("node").alias(side), F.col("blob").alias(f"blob_{side}"))
    both = join_hot(join_hot(pairs, of("a"), ["a"]), of("b"), ["b"]).select("a", "b", "blob_a", "blob_b").repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(x.as_py(), y.as_py(), max_bits, agree, share) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _sets(rooted: DataFrame) -> DataFrame:
    """key, n, weight: of the keys whose pictures aren't all connected one for each set of pictures, the number of these pictures and of the keys that exactly they have.

    Sets are told apart by 128 bits. So the many keys of a logo bring its pictures together about once.
    """
    told = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
    return told.where("low < high").groupBy("n", "h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("weight")).select("key", "n", "weight")


def links(corners: DataFrame, max_bits: int = MAX_BITS, agree: int = AGREE, share: float = SHARE, common: int = COMMON, part: int = PART) -> DataFrame:
    """Pairs (a, b) of nodes of CORNERS that connect the copies.

    All pictures that share `common` keys are compared, however many pictures have
    these, but for those that are connected already. Keys that one picture has
    go at once. First every picture is compared with the smallest node that
    has the key, which finds large groups of copies without their pairs; then
    all that share keys and are not connected yet, in pairs of parts of `part`
    pictures. Work grows with the square of the pictures that share keys and are no
    copies of one another, such as those with one logo.
    """
    keyed = corners.select("node", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n")
    full = cut(join_hot(keyed, counts, ["key"]), "keys")
    leaders = full.where("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    near = cut(leaders.where(F.col("n") >= common).select("a", "b"), "candidates")
    first = cut(_verified(near, corners, max_bits, agree, share), "first_links")
    root = cut(components(first), "roots")
    rooted = cut(join_hot(full.select("key", "node"), root, ["node"], "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    parts = F.ceil(F.col("n") / part).cast("int")
    rows = join_hot(rooted, _sets(rooted), ["key"]).select("key", "node", "root", "weight", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("at"))
    every = F.explode(F.expr("sequence(0, parts - 1)"))
    a = rows.select("key", "weight", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("at").alias("mine"), every.alias("other"))
    b = rows.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("at").alias("other"), every.alias("mine"))
    rest = a.join(b, ["key", "mine", "other"]).where("a < b and ra <> rb").groupBy("a", "b").agg(F.sum("weight").alias("n")).where(F.col("n") >= common).select("a", "b")
    left = cut(rest.join(near, ["a", "b"], "left_anti"), "candidates")
    second = cut(_verified(left, corners, max_bits, agree, share), "second_links")
    for df in (full, near, root, rooted, left):
        discard(df)
    return first.unionByName(second)


def copies(images: DataFrame, image_id: str = "image_id", image: str = "image", keep: tuple[str, ...] = (), max_bits: int = MAX_BITS, agree: int = AGREE, share: float = SHARE) -> DataFrame:
    """image_id, the columns to keep, class_id, class_size, corners, decoded: one row per row of images.

    Equal bytes are one image. Two images are copies if `agree` places, and the
    `share` of the places of the one with fewer, have matched corners that fit one
    geometry; class_id is the smallest image_id that copies of copies reach,
    itself included, class_size the number of rows of the class. Null, empty and
    undecodable images (decoded is false) have no corners and are copies of
    nothing but equal bytes; null ids stay null; an empty table gives no row.
    """
    keyed = images.select(F.struct(image_id, *keep).alias("own"), F.col(image_id).alias("id"), F.coalesce(F.col(image), F.lit(b"")).alias("image")).withColumn("node", F.xxhash64("image"))
    small_batches(images.sparkSession)
    classes = cut(keyed.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "images")
    corners = cut(_corners(keyed.groupBy("node").agg(F.first("image").alias("image")), "image"), "corners")
    roots = cut(components(links(corners, max_bits, agree, share)), "roots")
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = join_hot(named, named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size")), ["root"]).join(corners.select("node", "corners", "decoded"), "node")
    return join_hot(keyed.drop("image"), named.drop("least", "root", "rows"), ["node"]).select("own.*", "class_id", "class_size", "corners", "decoded")


def _patterns(n: int, side: int) -> np.ndarray:
    """n fixed patterns of blurred noise: (n, side * side)."""
    rng = np.random.default_rng(17)
    return np.stack([_blurred(rng.normal(0, 1, (side, side)), 1.3).ravel() for _ in range(n)])


def rendered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", side: int = 64) -> DataFrame:
    """image_id, image: each vector as a grey picture (PGM), the sum of fixed patterns of noise weighted by its numbers.

    Stands in for an image table, which the test data has not: near vectors give
    pictures that look like edits of one another. Null numbers count as 0; null
    and empty vectors give null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                values = np.nan_to_num(np.array([0.0 if x is None else x for x in v or []], dtype=np.float64))
                if not len(values):
                    out.append(None)
                    continue
                grey = values @ kept("patterns", f"{len(values)}x{side}", lambda: _patterns(len(values), side))
                grey = (grey - grey.min()) / (np.ptp(grey) or 1.0) * 255
                out.append(encode(grey.reshape(side, side)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["image_id", "image"])

    own = vectors.select(F.col(key).alias("image_id"), F.col(vector).alias("v"))
    return own.mapInArrow(run, own.select("image_id").schema.add("image", "binary"))


EDITS = {
    "crop": lambda g: g[g.shape[0] // 10 :, : -(g.shape[1] // 10)],
    "tone": lambda g: g * 0.8 + 25,
    "turn": np.rot90,
}


def with_edits(images: DataFrame, every: int = 100, image_id: str = "image_id", image: str = "image") -> DataFrame:
    """image_id, edit, image: all images (edit is original), and a crop, a change of tone and a quarter turn of those whose id is divisible by `every`.

    Images that can't be decoded have no edits.
    """
    own = images.select(F.col(image_id).alias("image_id"), F.lit("original").alias("edit"), F.col(image).alias("image"))
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, name, encode(change(grey))) for i, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()) if (grey := decode(x)) is not None for name, change in EDITS.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [batch.schema.types[0], pa.string(), pa.binary()])], names=names)

    return own.unionByName(own.where(F.col("image_id") % every == 0).mapInArrow(run, own.schema))
