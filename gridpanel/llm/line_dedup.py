"""Line dedup: winnowed fingerprints of line runs, joined on position; later repeats are deleted.

A match of a fingerprint isn't extended pair by pair, as that would cost the pairs
of a frequent run. Instead each text brings the shortest runs of enough words around
its fingerprints: what two texts have in common beyond them is a chain of such runs,
so the lines that equal runs cover are those that extending every match both ways
as far as it goes would cover. The tests hold this against all pairs, extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_names, guarded, join_hot, small_batches

#: Words that a repeated run has at least, and words that a fingerprinted run of lines has at least.
RUN_WORDS, GRAM_WORDS = 50, 20


def line_table(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Of each line with words: its number among all lines of the text, its hash (white space apart), its words."""
    at, hashes, counts = [], [], []
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        found = line.split()
        if found:
            at.append(i)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(found)))
            counts.append(len(found))
    return at, hashes, counts


def winnow(hashes: list[int], counts: list[int], run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """The selected grams, as hash pairs by first line, and for each line the gram that its window selects.

    A gram is the shortest run of lines from a line on with gram_words words. The
    window of a line holds the grams from there on that end within run_words
    words (the first one always), and its least hash is selected (the rightmost
    of equal ones). A run of lines with run_words words that two texts share holds
    the whole window of its first line, so the same gram is selected in both.
    """
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    ends = np.searchsorted(total, total[:-1] + gram_words)
    n = int((ends < len(total)).sum())
    raw = np.array(hashes, dtype=np.uint64).tobytes()
    grams = [xxhash.xxh3_128_intdigest(raw[8 * i : 8 * e]) for i, e in enumerate(ends[:n].tolist())]
    last = np.searchsorted(ends[:n], np.searchsorted(total, total[:n] + run_words, side="right") - 1, side="right")
    chosen = [min(range(i, max(i + 1, int(last[i]))), key=lambda j: (grams[j], -j)) for i in range(n)]
    return {i: (grams[i] >> 64, grams[i] & (1 << 64) - 1) for i in sorted(set(chosen))}, chosen


def runs(hashes: list[int], counts: list[int], run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> list[tuple[int, int, list[int], list[int]]]:
    """For each selected gram its hashes, and the runs of run_words words around it: places (first << 32 | upto) and hashes.

    The runs are the shortest ones from each line on and up to each line. Each
    stands with the gram that the window of its first line selects, which lies in
    the run. They cover every line of every longer run, from its first to its last.
    """
    picked, chosen = winnow(hashes, counts, run_words, gram_words)
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    on = np.searchsorted(total, total[:-1] + run_words)
    back = np.searchsorted(total, total[1:] - run_words, side="right") - 1
    found = {(p, e) for p, e in enumerate(on.tolist()) if e < len(total)} | {(p, q + 1) for q, p in enumerate(back.tolist()) if p >= 0}
    raw = np.array(hashes, dtype=np.uint64).tobytes()
    by: dict[int, tuple[list[int], list[int]]] = {}
    for p, e in sorted(found):
        places, keys = by.setdefault(chosen[p], ([], []))
        places.append(p << 32 | e)
        keys.append(_signed(xxhash.xxh64_intdigest(raw[8 * p : 8 * e])))
    return [(*map(_signed, picked[g]), *lists) for g, lists in by.items()]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


GRAMS = "tk long, h1 long, h2 long, places array<long>, keys array<long>"


def fingerprints(docs: DataFrame, doc_id: str, text: str, run_words: int, gram_words: int) -> DataFrame:
    """doc_id and GRAMS: the selected grams of each text, with their runs."""
    own = docs.select(F.col(doc_id), F.col("__gp_text").alias("tk"), F.col(text).alias("__t"))
    schema = T.StructType([own.schema.fields[0], *T._parse_datatype_string(GRAMS).fields])
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where: list[int] = []
            rows: list[list] = [[] for _ in kinds]
            for i, tk in enumerate(batch.column(1).to_pylist()):
                _, hashes, counts = line_table(batch.column(2)[i].as_py())
                for values in runs(hashes, counts, run_words, gram_words) if sum(counts) >= run_words else ():
                    where.append(i)
                    for column, value in zip(rows, (tk, *values)):
                        column.append(value)
            ids = batch.column(0).take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(rows, kinds))], names=schema.names)

    return own.mapInArrow(run, schema)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """doc_id, tk (hash of the text), first, upto (half-open, among the lines with words): runs to delete, overlapping.

    Fingerprints that occur once go at once. The runs around the others meet by
    fingerprint and hash; the one at the smallest (doc_id, text hash, line), null
    first, stays, every other one is returned. So the work grows with the
    occurrences, not with their pairs.
    """
    keyed = docs.select(doc_id, text, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__gp_text"))
    found = cut(fingerprints(keyed, doc_id, text, run_words, gram_words), "fingerprints")
    often = found.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    around = join_hot(found, often, ["h1", "h2"]).select(F.col(doc_id).alias("id"), "tk", "h1", "h2", F.explode(F.arrays_zip("places", "keys")).alias("run"))
    around = cut(around.select("id", "tk", "h1", "h2", F.shiftright("run.places", 32).cast("int").alias("first"), F.col("run.places").bitwiseAND((1 << 32) - 1).cast("int").alias("upto"), F.col("run.keys").alias("key")), "runs")
    place = F.struct("id", "tk", "first")
    heads = around.groupBy("h1", "h2", "key").agg(F.count("*").alias("n"), F.min(place).alias("head")).where("n > 1").drop("n")
    later = join_hot(around, heads, ["h1", "h2", "key"]).where(~place.eqNullSafe(F.col("head")))
    return later.select(F.col("id").alias(doc_id), "tk", "first", "upto")


def _remove(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    at, _, counts = line_table(text)
    lines, goes = text.split("\n"), np.zeros(len(at) + 1, dtype=np.int64)
    for first, upto in spans:
        goes[first] += 1
        goes[upto] -= 1
    gone = np.flatnonzero(np.cumsum(goes)[:-1] > 0)
    drop = {at[i] for i in gone}
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(drop), int(sum(counts[i] for i in gone))


@guarded
def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS, removed: tuple[str, str] | None = None) -> DataFrame:
    """docs with later repeats of line runs deleted from text; with `removed`, also two long columns of lines and words that went.

    Lines end at line feeds and are equal if their words are; lines without words
    are never deleted. A run repeats if it has run_words words in all, in another
    document or further down in the same one. Every row stays: a text that
    is wholly repeated becomes empty, a null text stays null, and rows that
    repeat both doc_id and text count as one document.
    """
    free_names(docs, removed or ())
    small_batches(docs.sparkSession)
    keyed = docs.withColumn("__gp_text", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    spans = repeats(docs, doc_id, text, run_words, gram_words).groupBy(F.col(doc_id).alias("__gp_id"), F.col("tk").alias("__gp_of")).agg(F.collect_set(F.struct("first", "upto")).alias("__gp_spans"))
    joined = keyed.join(spans, F.col("__gp_text").eqNullSafe(F.col("__gp_of")) & keyed[doc_id].eqNullSafe(spans["__gp_id"]), "left")
    joined = joined.select(*[keyed[f"`{c}`"] for c in docs.columns], "__gp_spans")
    extra = [T.StructField(c, T.LongType()) for c in removed or ()]
    schema, at, width = T.StructType([*docs.schema.fields, *extra]), docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, words = batch.column(at).to_pylist(), [0] * batch.num_rows, [0] * batch.num_rows
            for i, spans in enumerate(batch.column(width).to_pylist()):
                if spans and texts[i] is not None:
                    texts[i], lines[i], words[i] = _remove(texts[i], [(s["first"], s["upto"]) for s in spans])
            columns = [*batch.columns[:at], pa.array(texts, type=batch.schema.types[at]), *batch.columns[at + 1 : width], *([pa.array(lines, pa.int64()), pa.array(words, pa.int64())] if extra else [])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)
