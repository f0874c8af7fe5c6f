"""URL filters: rules by host and path first, then gradient-boosted trees on lexical features of the URL."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALLOW, BLOCK = "allow", "block"
#: (verdict, host and path prefix).
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
#: Labelled URLs of each label that the trees are fitted on at most, in the order of a hash, and their letters at most.
SAMPLE, LETTERS = 10_000, 4096
BINS, DEPTH, ROUNDS, RATE = 32, 3, 40, 0.2


def host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A to Z lower-cased; empty without ://."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to a question mark, hash or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the URL's or a parent of it and whose path begins the URL's, and its verdict; else nulls.

    Rules are an expression of the plan; they are meant to be hundreds at most.
    Of rules of one length the first listed wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(reversed(rules), key=lambda x: len(x[1])):
        name, slash, rest = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


#: Statistics by part of a URL: the last one and two labels of the host, the first part of the path, and it with the two labels.
PARTS = 4


def features(url: str | None) -> tuple[list[float], tuple[str, ...]]:
    """Lexical features and the PARTS whose statistics count too."""
    url = url or ""
    rest = url.partition("://")[2]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    name, tail = rest[:cut].lower(), rest[cut:]
    way, _, fragment = tail.partition("#")
    way, _, query = way.partition("?")
    labels = name.split(".")
    n = max(1, len(url))
    digits = sum(c.isdigit() for c in url)
    values = [
        len(url), len(name), len(way), way.count("/"), digits / n, sum(c.isdigit() for c in name), _entropy(url), _entropy(name),
        query.count("&") + bool(query), len(query), len(fragment), len(labels), max(map(len, labels)), name.count("-"), url.count("%"),
        sum(c.isupper() for c in url) / n, float(url.startswith("https")), float(way.endswith((".html", ".htm", ".php"))), float(way.endswith("/")),
    ]
    first = way.split("/")[1] if "/" in way else ""
    two = ".".join(labels[-2:])
    return [float(v) for v in values], (labels[-1], two, f"/{first}", f"{two}/{first}")


@dataclass(frozen=True)
class Trees:
    """Plain data: suffix statistics, bin edges and complete trees of DEPTH levels."""

    prior: float
    suffixes: tuple[dict[str, float], ...]
    edges: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray
    base: float

    def matrix(self, urls: list[str | None]) -> np.ndarray:
        rows = []
        for values, parts in map(features, urls):
            rows.append([*values, *[s.get(p, self.prior) for s, p in zip(self.suffixes, parts)]])
        return np.array(rows, dtype=np.float64).reshape(len(urls), -1)

    def margin(self, urls: list[str | None]) -> np.ndarray:
        """Log odds of block."""
        out = np.full(len(urls), self.base)
        if len(urls):
            x = _binned(self.matrix(urls), self.edges)
            for f, b, leaf in zip(self.feature, self.bin, self.leaf):
                out += leaf[_walk(x, f, b)]
        return out


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def _walk(x: np.ndarray, feature: np.ndarray, bin_: np.ndarray) -> np.ndarray:
    """The leaf of each row in a complete tree whose nodes are numbered level by level."""
    at = np.zeros(len(x), dtype=np.int64)
    for _ in range(DEPTH):
        at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > bin_[at])
    return at - (2**DEPTH - 1)


def train(urls: list[str | None], blocked: list[int], rounds: int = ROUNDS, rate: float = RATE) -> Trees:
    """Logistic boosting of complete trees over histograms, in numpy."""
    y = np.asarray(blocked, dtype=np.float64)
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    parts = [features(u) for u in urls]
    suffixes: list[dict[str, float]] = []
    columns = []
    for k in range(PARTS):
        seen, hit = Counter(p[1][k] for p in parts), Counter(p[1][k] for p, b in zip(parts, y) if b)
        suffixes.append({s: (hit[s] + 10 * prior) / (n + 10) for s, n in seen.items() if n >= 5})
        # a row's own label is left out of its statistic
        columns.append([(hit[p[1][k]] - b + 10 * prior) / (seen[p[1][k]] + 9) if seen[p[1][k]] >= 5 else prior for p, b in zip(parts, y)])
    base = math.log(prior / (1 - prior))
    nodes = 2**DEPTH - 1
    width = len(features("")[0]) + PARTS
    if not len(y) or y.min() == y.max():
        return Trees(prior, tuple(suffixes), np.zeros((width, BINS - 1)), np.zeros((0, nodes), int), np.zeros((0, nodes), int), np.zeros((0, nodes + 1)), base)
    x = np.column_stack([np.array([p[0] for p in parts]), *columns])
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(width)])
    b = _binned(x, edges)
    flat = b + np.arange(width)[None, :] * BINS
    margin = np.full(len(y), base)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(nodes, dtype=np.int64), np.full(nodes, BINS, dtype=np.int64)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(nodes):
            here = np.flatnonzero(at == node)
            if len(here) >= 20:
                hist = [np.bincount(flat[here].ravel(), np.repeat(v[here], width), width * BINS).reshape(width, BINS) for v in (g, h)]
                left = [np.cumsum(v, axis=1) for v in hist]
                right = [v[:, -1:] - v for v in left]
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1)
                gain[(left[1] < 1) | (right[1] < 1)] = -1
                j = int(np.argmax(gain))
                if gain.flat[j] > g[here].sum() ** 2 / (h[here].sum() + 1) + 1e-9:
                    feature[node], cut[node] = divmod(j, BINS)
            at[here] = 2 * node + 1 + (b[here, feature[node]] > cut[node])
        leaf = at - nodes
        value = rate * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + 1)
        margin += value[leaf]
        trees.append((feature, cut, value))
    return Trees(prior, tuple(suffixes), edges, *(np.stack(t) for t in zip(*trees)), base)


def sampled(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """url, blocked, __order: at most `sample` different URLs of each label, the first by a hash.

    Only URLs whose hash is in the part of its range that holds about four times
    as many are shuffled, so no more than the sample moves. Longer URLs than
    LETTERS, null ones and other labels are left out.
    """
    known = labelled.select("url", F.col("blocked").cast("int").alias("blocked")).where((F.length("url") <= LETTERS) & F.col("blocked").isin(0, 1)).withColumn("__order", F.xxhash64("url"))
    sizes = {r["blocked"]: r["n"] for r in known.groupBy("blocked").agg(F.approx_count_distinct("url").alias("n")).collect()}
    parts = []
    for label in (0, 1):
        share = min(1.0, 4.0 * sample / max(1, sizes.get(label, 0)))
        few = known.where(F.col("blocked") == label)
        few = few.where(F.col("__order") < int((share - 0.5) * 2.0**64)) if share < 1 else few
        parts.append(few.distinct().orderBy("__order", "url").limit(sample))
    return parts[0].unionByName(parts[1])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees of the sample, fitted in one task, which Spark repeats elsewhere if its executor is lost; the driver gets the trees alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (2, 0, 1))))
        t = train([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((t.prior, t.suffixes, t.edges, t.feature, t.bin, t.leaf, t.base))])], names=["trees"])

    found = sampled(labelled, sample).repartition(1).mapInArrow(run, "trees binary").collect()
    return Trees(*pickle.loads(found[0]["trees"])) if found else train([], [])


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """key, host, path, rule, verdict, score of every page.

    verdict is the rule's; without one it is that of the trees, block where their
    probability of block (score) is 0.5 or more. labelled has url and blocked
    (0 or 1); by default the URLs that the rules decide are the labelled ones. The
    trees are fitted on at most `sample` URLs of each label, and without any they
    allow or block by the label there is, else with a probability of 0.5. A null
    URL, or one without ://, has an empty host and path, no rule, and is judged by
    the trees; null keys and repeated rows are rows like any other; of pages only
    key and url are read.
    """
    own = pages.select(F.col(key).alias(key), F.col(url).alias("__url"))
    own = own.select("*", host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = own.select(key, "__url", "host", "path", rule.alias("rule"), verdict.alias("__ruled"))
    if labelled is None:
        labelled = own.where("__ruled is not null").select(F.col("__url").alias("url"), (F.col("__ruled") == BLOCK).cast("int").alias("blocked"))
    t = fit(labelled, sample)
    shared = pages.sparkSession.sparkContext.broadcast((t.prior, t.suffixes, t.edges, t.feature, t.bin, t.leaf, t.base))
    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(*shared.value)
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(trees.margin(batch.column(1).to_pylist()), -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=schema.names)

    by_trees = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    return own.mapInArrow(run, schema).select(key, "host", "path", "rule", F.coalesce("__ruled", by_trees).alias("verdict"), "score")
