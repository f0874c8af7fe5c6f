"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed into rows of one
embedding table (a run of over 64 letters is several words); a window of a few words is the average of its words' bags and
goes through a linear softmax. A document's score is that of its most toxic
windows, so a handful of words in a long text counts; in training the share of
windows that a document is judged by falls from all to its single top window.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, guarded, kept, small_batches

TOKEN = re.compile(r"\w+")
BUCKETS, DIM, SHORT, LONG, SPAN = 1 << 16, 8, 3, 5, 5
#: Letters of a word at most; a longer run (a script without spaces, say) counts as pieces of so many.
PIECE = 64


@dataclass(frozen=True)
class Bounds:
    """The bounded sample that the model is fitted on: ids of each label, in the order of a hash, with texts of at most max_chars letters."""

    toxic: int = 2000
    clean: int = 3000
    max_chars: int = 20_000


def subwords(word: str) -> list[int]:
    w = f"<{word}>"
    grams = {w, *[w[i : i + n] for n in range(SHORT, LONG + 1) for i in range(len(w) - n + 1)]}
    return sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams})


def words(text: str | None) -> list[str]:
    """The runs of letters in order; of one over PIECE letters its pieces, which overlap so that every n-gram lies whole in one."""
    found = TOKEN.findall((text or "").lower())
    if all(len(w) <= PIECE for w in found):
        return found
    return [w[i : i + PIECE] for w in found for i in range(0, max(1, len(w) - LONG + 1), PIECE - LONG + 1)]


def _windows(values: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Means over each run of `span` values; over all of them if there are fewer."""
    if len(values) <= span:
        return values.mean(keepdims=True)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[span:] - total[:-span]) / span


class Model:
    """After training the softmax is linear in the bags, so a subword's share of the margin is one number."""

    def __init__(self, weight: np.ndarray, slope: float, offset: float):
        self.weight, self.slope, self.offset = weight.astype(np.float32), float(slope), float(offset)
        self.memo: dict[str, float] = {}

    def margins(self, texts: list[str | None]) -> np.ndarray:
        memo, weight = self.memo, self.weight.tolist()
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            seen = words(text)
            if len(memo) > 600_000:
                memo.clear()
            for w in {*seen}:
                if w not in memo:
                    bag = subwords(w)
                    memo[w] = sum([weight[g] for g in bag]) / len(bag)
            out[i] = _windows(np.fromiter(map(memo.__getitem__, seen), np.float64, len(seen))).max() if seen else np.nan
        return out

    def probability(self, margins: np.ndarray) -> np.ndarray:
        """A text without a word has the lowest score of all."""
        z = np.clip(self.slope * np.where(np.isnan(margins), -1e6, margins) + self.offset, -40, 40)
        return 1 / (1 + np.exp(-z))


def train(texts: list[str | None], labels: list[int], epochs: int = 16, batch: int = 128, seed: int = 7) -> Model:
    """Fit embeddings and softmax by Adagrad; a fifth of the rows sets slope and offset so that 0.5 is the best F1."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    flat, size = array("i"), array("i")  # the bags of all different words, one after the other

    def numbered(text: str | None) -> np.ndarray:
        found = array("i")
        for w in words(text):
            n = number.setdefault(w, len(number))
            if n == len(size):
                bag = subwords(w)
                flat.extend(bag)
                size.append(len(bag))
            found.append(n)
        return np.array(found, dtype=np.int32)

    ids = [numbered(t) for t in texts]
    y = np.asarray(labels, dtype=np.float64)[[len(d) > 0 for d in ids]]
    ids = [d for d in ids if len(d)]
    if not ids or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return Model(np.zeros(BUCKETS), 0.0, np.log(rate / (1 - rate)))
    del number
    flat, size = np.array(flat, dtype=np.int32), np.array(size, dtype=np.int64)
    at = np.cumsum(size) - size
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-3), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)
    held = np.arange(len(ids)) % 5 == 4 if len(ids) >= 200 else np.zeros(len(ids), bool)
    rows = np.flatnonzero(~held)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for epoch in range(epochs):
        share = max(0.0, 0.4 ** max(0, epoch - 1)) if epoch < 10 else 0.0
        rng.shuffle(rows)
        for lo in range(0, len(rows), batch):
            part = rows[lo : lo + batch]
            used, where = np.unique(np.concatenate([ids[d] for d in part]), return_inverse=True)
            span = size[used]
            edge = np.cumsum(span) - span
            take = flat[np.arange(span.sum()) + np.repeat(at[used] - edge, span)]
            vec = np.add.reduceat(emb[take], edge, axis=0) / span[:, None]
            diff = vec @ (soft[:, 1] - soft[:, 0])
            ends, g_sum = 0, np.zeros(2)
            pulls: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for d in part:
                own = where[ends : ends + len(ids[d])]
                ends += len(own)
                win = _windows(diff[own])
                k = max(1, int(share * len(win)))
                top = np.argpartition(-win, k - 1)[:k]
                width = min(SPAN, len(own))
                hit = (top[:, None] + np.arange(width)[None, :]).ravel() if len(own) > SPAN else np.arange(len(own))
                idx = own[hit]
                mean = vec[idx].mean(axis=0)
                z = mean @ soft + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                g = (p - np.array([1 - y[d], y[d]])) * balance[d]
                pulls.append((idx, np.broadcast_to(g / len(idx), (len(idx), 2)), mean))
                g_sum += g
                d_soft = np.outer(mean, g)
                g_soft += d_soft**2
                soft = soft - 0.05 * d_soft / np.sqrt(g_soft)
            idx = np.concatenate([x[0] for x in pulls])
            pull = np.concatenate([x[1] for x in pulls])
            d_word = np.stack([np.bincount(idx, pull[:, j], len(used)) for j in range(2)], axis=1)
            d_vec = d_word @ soft.T
            grad = np.repeat(d_vec / span[:, None], span, axis=0)
            hit, back = np.unique(take, return_inverse=True)
            change = np.stack([np.bincount(back, grad[:, j], len(hit)) for j in range(DIM)], axis=1)
            g_emb[hit] += (change**2).mean(axis=1)
            emb[hit] -= 0.3 * change / np.sqrt(g_emb[hit])[:, None]
            g_bias += g_sum**2
            bias -= 0.05 * g_sum / np.sqrt(g_bias)
    model = Model(emb @ (soft[:, 1] - soft[:, 0]), 1.0, float(bias[1] - bias[0]))
    check = np.flatnonzero(held) if held.any() else rows
    by_word = np.add.reduceat(model.weight[flat], at) / size
    margins = np.array([_windows(by_word[ids[d]].astype(np.float64)).max() for d in check])
    order = np.argsort(-margins, kind="stable")
    hits = np.cumsum(y[check][order] == 1)
    f1 = 2 * hits / (np.arange(1, len(check) + 1) + max(1, hits[-1]))
    best = int(np.argmax(f1))
    ranked = margins[order]
    cut = (ranked[best] + ranked[min(best + 1, len(ranked) - 1)]) / 2
    model.slope = 4.0 / max(1e-6, float(np.std(margins)))
    model.offset = -model.slope * cut
    return model


def training_rows(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The bounded sample: of each label the first ids by a hash, and of these the whole texts of at most max_chars letters.

    Ids of longer texts, and of labels without a text, leave the sample and aren't replaced. The ids are chosen from the labels alone and are toxic + clean at most, which
    is the bound of what is broadcast; texts are never shuffled. Rows whose crc32(doc_id as text) mod 5 is 0 are held out and never here.
    """
    marked = labels.where(F.col(label).isin(0, 1) & ~is_held_out(doc_id)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__y")).withColumn("__order", F.xxhash64("__id"))
    first = lambda y, n: marked.where(F.col("__y") == y).orderBy("__order", "__id").limit(n)
    chosen = first(1, bounds.toxic).unionByName(first(0, bounds.clean))
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).where(F.length("__text") <= bounds.max_chars)
    return rows.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__y", "__text", "__order")


def is_held_out(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on the bounded sample in one task, which Spark repeats elsewhere if its executor is lost; the driver gets the weights alone."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (2, 1, 0))))
        model = train([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()]), pa.array([model.slope]), pa.array([model.offset])], names=["weight", "slope", "offset"])

    found = training_rows(docs, labels, bounds, doc_id, text, label).repartition(1).mapInArrow(run, "weight binary, slope double, offset double").collect()
    return Model(np.frombuffer(found[0]["weight"], dtype=np.float32), found[0]["slope"], found[0]["offset"]) if found else train([], [])


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out: 0 to 1, higher for likelier toxic, from the whole text alone; null and empty texts get the lowest score."""
    free_names(docs, (out,))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at = docs.columns.index(text)
    small_batches(docs.sparkSession)
    name = hashlib.sha256(repr((model.weight.tobytes(), model.slope, model.offset)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.slope, model.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept("toxicity", name, lambda: Model(*shared.value))
        for batch in batches:
            got = own.probability(own.margins(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=schema.names)

    return docs.mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; null doc_ids count as the text ''."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, bounds))
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@guarded
def without_toxic(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """docs without those that score 0.5 or more; null and empty texts stay."""
    return scored(docs, fit(docs, labels, bounds), out="__gp_score").where("__gp_score < 0.5").drop("__gp_score")
