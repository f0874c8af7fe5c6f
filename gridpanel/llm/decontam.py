"""Benchmark decontamination by greedy string tiling.

Runs of a few tokens are the seeds: those of the benchmark and those of the
documents are joined, and a document and an item that may share enough of them are
tiled, the longest matches first, by Karp-Rabin hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, free_names, guarded, join_hot, own_name, small_batches

TOKEN = re.compile(r"\w+")
#: Words of the shortest tile, and the share of an item's words that tiles cover in a contaminated text.
SHORTEST, COVERAGE = 3, 0.8
#: The benchmark's seeds are marked in 2 ** MARK_BITS bits (4 MB, whatever the benchmark's size); documents' seeds without a mark go before any shuffle.
MARK_BITS = 25
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """The lower-cased runs of letters and digits, as 64-bit hashes."""
    found = TOKEN.findall((text or "").lower())
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in found), np.uint64, len(found))


def _rolling(ids: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all runs of s tokens."""
    value = np.zeros(max(0, len(ids) - s + 1), dtype=np.uint64)
    for k in range(s if len(value) else 0):
        value = value * _BASE + ids[k : len(ids) - s + 1 + k].astype(np.uint64) + np.uint64(1)
    return value


def _free(marked: np.ndarray, s: int) -> np.ndarray:
    """Starts of runs of s tokens of which none is marked."""
    run = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(run[s:] == run[:-s]) if len(marked) >= s else np.zeros(0, dtype=np.int64)


def _ends(marked: np.ndarray) -> np.ndarray:
    """For each token the first marked place from there on."""
    place = np.where(marked, np.arange(len(marked)), len(marked))
    return np.minimum.accumulate(place[::-1])[::-1]


def _longest(item: np.ndarray, text: np.ndarray, i: int, places: np.ndarray, most: np.ndarray) -> tuple[int, int]:
    """Words of the longest match of item from i on with text from one of the places on, each up to its bound, and the first place that has it."""
    if len(places) <= 8:
        found = []
        for j, m in zip(places.tolist(), most.tolist()):
            off = np.flatnonzero(item[i : i + m] != text[j : j + m])
            found.append((int(off[0]) if len(off) else m, -j))
        n, j = max(found)
        return n, -j
    n, alive = 0, places
    while True:
        further = alive[most > n]
        most = most[most > n]
        same = text[further + n] == item[i + n] if len(further) else np.zeros(0, bool)
        if not same.any():
            return n, int(alive[0])
        alive, most, n = further[same], most[same], n + 1


def tile(item: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), the longest first; no token of either is in two tiles.

    Always the longest match that is left is marked, of equal ones that with the
    first start in the item, then in the text. Matches are sought by Karp-Rabin
    hashes at a search length that rises while longer matches exist and then
    falls to `shortest`. Of a match that goes on to the left only the whole one is
    looked at, so a text of repeats costs its length for each token of the item.
    """
    marked = [np.zeros(len(item), bool), np.zeros(len(text), bool)]
    tiles: list[tuple[int, int, int]] = []
    s = max(shortest, min(20, len(item)))
    while True:
        matches = []
        mine, theirs = _free(marked[0], s), _free(marked[1], s)
        if len(mine) and len(theirs):
            end_item, end_text = map(_ends, marked)
            h_item, h_text = _rolling(item, s)[mine], _rolling(text, s)[theirs]
            hit = np.isin(h_text, h_item)
            theirs, h_text = theirs[hit], h_text[hit]
            order = np.argsort(h_text, kind="stable")
            places, h_text = theirs[order], h_text[order]
            last, before = -2, places[:0]
            for i, a, b in zip(mine.tolist(), np.searchsorted(h_text, h_item).tolist(), np.searchsorted(h_text, h_item, side="right").tolist()):
                at = own = places[a:b]
                if last == i - 1 and len(before) and a < b:
                    k = np.minimum(np.searchsorted(before, at - 1), len(before) - 1)
                    own = at[before[k] != at - 1]
                last, before = i, at
                if len(own):
                    n, j = _longest(item, text, i, own, np.minimum(end_item[i] - i, end_text[own] - own))
                    if n >= s:
                        matches.append((-n, i, j))
        if matches and -min(matches)[0] > 2 * s:
            s = -min(matches)[0]
            continue
        again = False
        for n, i, j in sorted(matches):
            again = bool(marked[0][i : i - n].any() or marked[1][j : j - n].any())
            if again:
                break
            marked[0][i : i - n] = marked[1][j : j - n] = True
            tiles.append((i, j, -n))
        if again:
            continue
        if s == shortest:
            return tiles
        s = max(shortest, s // 2)


def _seeds(ids: np.ndarray, shortest: int) -> np.ndarray:
    """The different runs of `shortest` tokens, as mixed signed numbers."""
    x = np.unique(_rolling(ids, shortest))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def needed(words: int, distinct: int, coverage: float, shortest: int) -> int:
    """Different seeds of an item that tiles hold which cover that share of it: one for `shortest` tokens at least, less what repeats within the item."""
    return max(1, math.ceil(coverage * words / shortest - 1e-9) - (words - shortest + 1 - distinct))


def _item_seeds(items: DataFrame, coverage: float, shortest: int) -> DataFrame:
    """key, seed, spare: a row per item (by the key of its text) and different seed; spare is how many seeds a contaminated text may lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens(text.as_py())
                seeds = _seeds(ids, shortest)
                if len(seeds):
                    spare = len(seeds) - needed(len(ids), len(seeds), coverage, shortest)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seeds), key)), pa.array(seeds), pa.array(np.full(len(seeds), spare, np.int32))], names=["key", "seed", "spare"])

    return items.mapInArrow(run, "key long, seed long, spare int")


def _marks(seeds: DataFrame) -> np.ndarray:
    """The bits of all seeds, in an array of fixed size."""
    place = F.shiftrightunsigned("seed", 64 - MARK_BITS)
    words = seeds.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - MARK_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MARK_BITS - 6), dtype=np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _hits(texts: DataFrame, marks: np.ndarray, shortest: int) -> DataFrame:
    """key, seed: the different seeds of each text that are marked."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seeds = _seeds(tokens(text.as_py()), shortest)
                place = seeds.view(np.uint64) >> np.uint64(64 - MARK_BITS)
                seeds = seeds[(shared.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                if len(seeds):
                    keys.append(np.full(len(seeds), key))
                    found.append(seeds)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(found))], names=["key", "seed"])

    return texts.mapInArrow(run, "key long, seed long")


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _candidates(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, coverage: float, shortest: int) -> DataFrame:
    """key (of a text) and items (array of item_id, text): what has to be tiled.

    A contaminated text lacks `spare` of the item's seeds at most, so it has one of
    the item's spare + 1 rarest (prefix filtering); frequent seeds bring nothing
    together. Texts with one key are one text here.
    """
    items = cut(benchmark.select(_key(F.col(f"`{item_text}`")).alias("key"), F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("length(text) > 0"), "items")
    seeds = cut(_item_seeds(items.groupBy("key").agg(F.first("text").alias("text")), coverage, shortest), "seeds")
    hits = cut(_hits(docs.select(_key(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`")), _marks(seeds), shortest).distinct(), "hits")
    often = seeds.join(hits.groupBy("seed").agg(F.count("*").alias("n")), "seed")
    # seeds that no text has take the first places of their items
    order = F.row_number().over(Window.partitionBy("key").orderBy("n", "seed"))
    absent = seeds.join(often.select("key", "seed"), ["key", "seed"], "left_anti").groupBy("key").agg(F.count("*").alias("absent"))
    rare = often.withColumn("place", order).join(absent, "key", "left").where(F.col("place") + F.coalesce("absent", F.lit(0)) <= F.col("spare") + 1).select(F.col("key").alias("item"), "seed")
    pairs = join_hot(hits, rare.groupBy("seed").agg(F.collect_list("item").alias("of")), ["seed"]).select("key", F.explode("of").alias("item")).distinct()
    named = pairs.join(items.withColumnRenamed("key", "item"), "item")
    out = cut(named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("items")), "candidates")
    for df in (items, seeds, hits):
        discard(df)
    return out


def contained(text: str | None, items: list[tuple], coverage: float, shortest: int) -> list[tuple]:
    """(item_id, share covered, tiles, words of the longest) of the items (item_id, text) that the text covers that far."""
    ids, out = tokens(text), []
    seeds = _seeds(ids, shortest)
    for item_id, item_text in items:
        item = tokens(item_text)
        own = _seeds(item, shortest)
        if not len(own) or np.isin(own, seeds, assume_unique=True).sum() < needed(len(item), len(own), coverage, shortest):
            continue
        tiles = tile(item, ids, shortest)
        share = sum(t[2] for t in tiles) / len(item)
        if share >= coverage:
            out.append((item_id, share, len(tiles), max(t[2] for t in tiles)))
    return out


@guarded
def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, shortest: int = SHORTEST, keep: list[str] | None = None, added: tuple[str, str, str, str] = ("item_id", "coverage", "tiles", "longest")) -> DataFrame:
    """keep (doc_id by default), item_id, coverage, tiles, longest: a row per document and item of which tiles cover the share.

    Tokens are lower-cased runs of letters and digits, so case and punctuation
    don't matter, nor does the order of passages. Items shorter than the shortest
    tile, empty and null ones are never found, nor is anything in a null text;
    repeated rows of either table are found each. Columns to keep may not have
    one of the added names.
    """
    keep = keep or [doc_id]
    free_names(docs.select(*[F.col(f"`{c}`") for c in keep]), added)
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__t"), _key(F.col(f"`{text}`")).alias("key"))
    small_batches(docs.sparkSession)
    found = _candidates(docs, benchmark, text, item_id, item_text, coverage, shortest)
    rows = join_hot(own, found, ["key"]).select(*[F.col(f"`{c}`") for c in keep], "__t", "items")
    kinds = [benchmark.schema[item_id].dataType, T.DoubleType(), T.LongType(), T.LongType()]
    schema = T.StructType([*rows.schema.fields[: len(keep)], *[T.StructField(n, k) for n, k in zip(added, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, hits = [], []
            for i in range(batch.num_rows):
                items = [(x["item_id"], x["text"]) for x in batch.column(len(keep) + 1)[i].as_py()]
                for hit in contained(batch.column(len(keep))[i].as_py(), items, coverage, shortest):
                    where.append(i)
                    hits.append(hit)
            if hits:
                columns = batch.select(list(range(len(keep)))).take(pa.array(where, pa.int64())).columns
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in hits]) for k in range(4))], names=schema.names)

    return rows.mapInArrow(run, schema)


@guarded
def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, shortest: int = SHORTEST) -> DataFrame:
    """docs without the rows of which an item is contained that far; null and empty texts stay, and so do repeated rows."""
    small_batches(docs.sparkSession)
    found = _candidates(docs, benchmark, text, item_id, item_text, coverage, shortest)
    key, items = own_name(docs, "__key", "__items")
    both = join_hot(docs.withColumn(key, _key(F.col(f"`{text}`"))), found.select(F.col("key").alias(key), F.col("items").alias(items)), [key], "left")
    rows = both.select(*[F.col(f"`{c}`") for c in docs.columns], items)
    at, width = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for i in range(batch.num_rows):
                some = batch.column(width)[i].as_py()
                clean.append(not some or not contained(batch.column(at)[i].as_py(), [(x["item_id"], x["text"]) for x in some], coverage, shortest))
            yield batch.select(list(range(width))).filter(pa.array(clean, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
