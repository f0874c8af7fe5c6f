"""SimHash near-duplicates: pigeonhole blocks, a join on the blocks, Hamming verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, guarded, join_hot, small_batches
from .components import components

#: Members of a bucket that are compared in one task; larger buckets are compared in pairs of parts of this size.
PART = 4096
#: Members that a bucket of random fingerprints should have at most; more blocks are used beyond.
CROWD = 256
#: One-byte minima in the sketch of a text's word shingles, and words of these shingles.
SKETCH, SKETCH_WORDS = 128, 5
_TURNS = np.random.default_rng(23).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def _majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The bits that are set in over half of the hashes, as an unsigned integer."""
    votes = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step].view(np.uint8).reshape(-1, 8).astype(np.int64)
        votes += np.bincount((part + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, min_letters: int = 1) -> int:
    """The 64-bit fingerprint of one text; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if min_letters > 1:
        words = [w for w in words if len(w) >= min_letters] or words
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    return _majority(np.fromiter((digest(g, seed) for g in grams), np.uint64, n))


def sketch(text: str | None, shingle: int = SKETCH_WORDS, step: int = 4096) -> bytes:
    """The low bytes of the minima of the text's word shingles under SKETCH hash functions; two texts agree in as many as they have shingles in common (and one in 256 more)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(SKETCH)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, max(1, len(words) - shingle + 1))
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), step):
        least = np.minimum(least, (hashes[at : at + step, None] * _TURNS).min(axis=0))
    return ((least >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = 4, seeds: tuple[int, ...] = (42,), min_letters: int = 1, sketched: bool = False) -> DataFrame:
    """keys and a long column fp0, fp1, ... per seed, one row per row of docs; if asked, also the sketch.

    A to Z are lower-cased; words are runs without ASCII white space; shingles
    are counted with repeats. A null text is an empty one, whose fingerprint is zero.
    """
    own = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    out = T.StructType([*own.schema.fields[:-1], *(T.StructField(f"fp{i}", T.LongType()) for i in range(len(seeds))), *([T.StructField("sketch", T.BinaryType())] if sketched else [])])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sketches = [[] for _ in seeds], []
            for t in batch.column(len(keys)):
                t = t.as_py()
                if sketched:
                    sketches.append(sketch(t))
                for column, seed in zip(fps, seeds):
                    column.append(fingerprint(t, shingle, seed, min_letters))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in fps), *([pa.array(sketches, pa.binary())] if sketched else [])], names=out.names)

    return own.mapInArrow(run, out)


def blocks_for(n: int, max_bits: int) -> int:
    """Blocks to split 64 bits into, such that n random fingerprints fall into buckets of at most CROWD."""
    for blocks in range(max_bits + 2, max_bits + 6):
        if n / 2.0 ** (64 * (blocks - max_bits) // blocks) <= CROWD:
            break
    return blocks


def masks(blocks: int, max_bits: int) -> list[int]:
    """Fingerprints that differ in at most max_bits bits agree under one of these masks at least."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(part, blocks - max_bits)]


def _forest(fps: np.ndarray, nodes: np.ndarray, sketches: np.ndarray | None, max_bits: int, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what pairs within max_bits connect; a member leaves the search once it is reached."""
    out, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= max_bits
            if sketches is not None and near.any():
                near[near] = (sketches[rest[near]] == sketches[at]).mean(axis=1) >= least
            if near.any():
                found, rest = rest[near], rest[~near]
                out.append((np.full(len(found), nodes[at]), nodes[found]))
                front.extend(found.tolist())
    return out


def _solve(max_bits: int, least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def edges(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            bucket, fps, nodes = cols[:3]
            sketches = cols[3] if least is not None else None
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sizes = np.diff(np.r_[starts, len(bucket)])
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits]
            if sketches is not None:
                two = two[(sketches[two] == sketches[two + 1]).mean(axis=1) >= least]
            found = [(nodes[two], nodes[two + 1])]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                found += _forest(fps[s : s + n], nodes[s : s + n], None if sketches is None else sketches[s : s + n], max_bits, least)
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cols[1] = cols[1].view(np.uint64)
            if least is not None:
                cols.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH))
            kept = [np.concatenate(x) for x in zip(kept, cols)] if kept else cols
            change = np.flatnonzero(kept[0][1:] != kept[0][:-1])
            if len(change):
                last = change[-1] + 1
                yield from edges([c[:last] for c in kept])
                kept = [c[last:] for c in kept]
        if kept and len(kept[0]):
            yield from edges(kept)

    return run


def links(members: DataFrame, max_bits: int = 4, blocks: int = 6, part: int = PART, least: float | None = None) -> DataFrame:
    """Edges (a, b) over the nodes of members (node long, fp0, fp1, ... long), which have each row once.

    Two nodes are connected by the edges if and only if a chain of pairs
    connects them whose fingerprints of one column differ in at most max_bits
    bits and, if `least` is given, whose sketches (column sketch, one per node)
    agree in that share of their minima. Buckets of equal blocks with one member go before any Python; within
    a bucket a forest is returned, never all pairs; a bucket of more than `part`
    members is compared in pairs of parts, each pair a task's group of its own.
    """
    own = [c for c in members.columns if c.startswith("fp")]
    tables = [F.struct(F.xxhash64(F.lit(i * 1000 + t), F.col(c).bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))).alias("bucket"), F.col(c).alias("fp")) for i, c in enumerate(own) for t, m in enumerate(masks(blocks, max_bits))]
    rows = members.select("node", F.explode(F.array(*tables)).alias("x")).select("node", "x.bucket", "x.fp")
    crowds = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    mine = F.pmod(F.xxhash64("fp", "node"), F.col("parts")).cast("int")
    shared = join_hot(rows, crowds, ["bucket"]).withColumn("parts", parts).withColumn("mine", mine)
    shared = shared.select("bucket", "fp", "node", "mine", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    shared = shared.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "fp", "node")
    if least is not None:
        shared = shared.join(members.select("node", "sketch"), "node").select("bucket", "fp", "node", "sketch")
    return shared.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_solve(max_bits, least), "a long, b long")


def near_classes(prints: DataFrame, max_bits: int = 4, least: float | None = None) -> DataFrame:
    """(node, root) for every node of prints, which has node and fp0, fp1, ... (and sketch, with least), repeated or not."""
    members = prints.select("node", *[c for c in prints.columns if c.startswith("fp")], *(["sketch"] if least is not None else [])).dropDuplicates(["node"])
    members = cut(members, "members")
    found = components(links(members, max_bits, blocks_for(members.count(), max_bits), least=least))
    return members.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach, itself included).

    One row per row of docs, repeats included. Rows without a word have the
    fingerprint zero and are linked like any other. A null doc_id is returned as
    null and is never a component_id unless its whole component has no other;
    then component_id is null. Only doc_id and text are read.
    """
    prints = cut(fingerprints(docs, [doc_id], text, shingle), "prints")
    classes = near_classes(prints.withColumn("node", F.col("fp0")), max_bits)
    least = prints.groupBy(F.col("fp0").alias("node")).agg(F.min(doc_id).alias("least"))
    named = classes.join(least, "node")
    named = join_hot(named, named.groupBy("root").agg(F.min("least").alias("component_id")), ["root"]).select(F.col("node").alias("fp0"), "component_id")
    return prints.join(named, "fp0").select(F.col(doc_id), F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


@guarded
def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seeds: tuple[int, ...] = (42, 43, 44), min_letters: int = 4, max_bits: int = 4, least: float = 0.73) -> DataFrame:
    """docs without all but one document of each near-duplicate group; the columns of docs.

    Fingerprints are of single words of at least min_letters bytes (of all words
    where a text has no such word), under several seeds; texts are linked if those
    of one seed differ in at most max_bits bits and their sketches of 5-word
    shingles agree in the share `least`: 0.8, less two standard errors of the sketch. The document with the smallest
    doc_id of a group stays (null before all others), the smaller text hash on a
    tie; rows that repeat both doc_id and text count as one and one of them stays.
    All empty and null texts form one group.
    """
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.withColumn("__gp_text", key)
    prints = cut(fingerprints(keyed, [doc_id, "__gp_text"], text, 1, seeds, min_letters, sketched=True).withColumn("node", F.xxhash64("sketch", *[f"fp{i}" for i in range(len(seeds))])), "prints")
    classes = near_classes(prints, max_bits, least)
    first = prints.groupBy("node").agg(F.min(F.struct(doc_id, "__gp_text")).alias("first"))
    kept = classes.join(first, "node").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first").getField(doc_id).alias("__gp_id"), F.col("first.__gp_text").alias("__gp_kept"))
    out = keyed.join(kept, keyed["__gp_text"].eqNullSafe(kept["__gp_kept"]) & keyed[doc_id].eqNullSafe(kept["__gp_id"]), "left_semi")
    return out.dropDuplicates([doc_id, "__gp_text"]).select(*[F.col(f"`{c}`") for c in docs.columns])
