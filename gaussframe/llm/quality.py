"""Quality: a generalised additive model with pairwise interactions, as lookup tables.

Features of a text are counts of its bytes and words.  Each is cut at quantiles of the training rows
into ``BINS`` bins.  Shallow trees (``LEAVES`` leaves) on one feature at a time, boosted in cycles at a
small rate, add up to one table a feature; then shallow trees on two features, for the ``PAIRS`` pairs
whose tree explains most of what is left, add up to one coarse table a pair.  A document's log odds
are the sum of its bins' entries.

Learning uses at most ``SAMPLE`` labelled documents of each class, of at most ``SAMPLE_CHARS``
characters, of which only the features reach the driver; scoring reads every whole text.

Defined results: null and empty texts have the features of no words; with labels of one class only,
all scores are 0 or 1 by that class, without labels 0; labels that are null, contradict each other or
lack a document don't count, labels that repeat count once; rows that repeat get equal scores; no
documents, no rows; other columns play no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tidied
from .toxicity import sample

SAMPLE, SAMPLE_CHARS = 4000, 50_000
BINS, PAIR_BINS, PAIRS = 32, 6, 8
CYCLES, RATE, LEAVES = 150, 0.08, 4

FEATURES = ("bytes", "words", "mean_word", "distinct", "top_word", "repeats", "upper", "digits", "punct", "symbols", "spaces", "high", "lines", "mean_line", "distinct_lines", "stops", "capitals", "marked", "short", "long", "bars")

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "punct": b".,;:?'\"()-", "symbols": b"!#$%&*+/<=>@[\\]^_`{|}~", "spaces": b" \t\n\x0b\x0c\r", "stops": b".?!", "bars": b"|"}


def features(text: str | None) -> list[float]:
    b = (text or "").encode()
    words = b.split()
    n, m = max(1, len(b)), max(1, len(words))
    count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    share = {k: count[np.frombuffer(v, np.uint8)].sum() / n for k, v in _KINDS.items()}
    low = [w.lower() for w in words]
    times = Counter(low)
    lines = [x for x in b.split(b"\n") if x.strip()]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(len(b)),
        np.log1p(len(words)),
        float(lens.mean()) if len(lens) else 0.0,
        len(times) / m / (1 + 0.05 * np.log1p(m)) if words else 0.0,
        max(times.values(), default=0) / m,
        sum(x == y for x, y in zip(low, low[1:])) / m,
        share["upper"],
        share["digits"],
        share["punct"],
        share["symbols"],
        share["spaces"],
        count[128:].sum() / n,
        np.log1p(len(lines)),
        np.log1p(len(b) / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        share["stops"] * n / m,
        sum(w[:1].isupper() for w in words) / m,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m,
        float((lens <= 3).sum() / m),
        float((lens >= 12).sum() / m),
        share["bars"] * n / m,
    ]


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper edges of all but the last bin of each feature, at quantiles."""
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])


def _shallow(b: np.ndarray, n: int, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A tree on one binned feature with up to ``LEAVES`` leaves, as a table."""
    g, h = np.bincount(b, grad, n), np.bincount(b, hess, n)
    out = np.zeros(n)
    cuts = [0, n]
    gain = lambda a, z: g[a:z].sum() ** 2 / (h[a:z].sum() + 1.0)
    for _ in range(LEAVES - 1):
        best = max(((gain(a, m) + gain(m, z) - gain(a, z), m) for a, z in zip(cuts, cuts[1:]) for m in range(a + 1, z)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    for a, z in zip(cuts, cuts[1:]):
        out[a:z] = g[a:z].sum() / (h[a:z].sum() + 1.0)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree on two binned features with up to ``LEAVES`` leaves, as a table, and what it gains.

    ``g`` and ``h`` are the gradient and curvature of each pair of bins; a leaf is a rectangle of them.
    """
    n, m = g.shape
    sums = []
    for x in (g, h):
        s = np.zeros((n + 1, m + 1))
        s[1:, 1:] = x.cumsum(0).cumsum(1)
        sums.append(s.tolist())

    def total(s: list, a: int, z: int, c: int, e: int) -> float:
        return s[z][e] - s[a][e] - s[z][c] + s[a][c]

    def worth(*r: int) -> float:
        return total(sums[0], *r) ** 2 / (total(sums[1], *r) + 5.0)

    leaves, gained = [(0, n, 0, m)], 0.0
    while len(leaves) < LEAVES:
        splits = [((a, k, c, e), (k, z, c, e), (a, z, c, e)) for a, z, c, e in leaves for k in range(a + 1, z)]
        splits += [((a, z, c, k), (a, z, k, e), (a, z, c, e)) for a, z, c, e in leaves for k in range(c + 1, e)]
        best = max(((worth(*x) + worth(*y) - worth(*r), i) for i, (x, y, r) in enumerate(splits)), default=(0.0, -1))
        if best[0] <= 1e-9:
            break
        x, y, r = splits[best[1]]
        leaves[leaves.index(r) : leaves.index(r) + 1] = [x, y]
        gained += best[0]
    out = np.zeros((n, m))
    for a, z, c, e in leaves:
        out[a:z, c:e] = total(sums[0], a, z, c, e) / (total(sums[1], a, z, c, e) + 5.0)
    return out, gained


class Gam:
    """Edges and tables; ``constant`` where there was nothing to learn from."""

    def __init__(self, constant: float | None = None):
        self.constant, self.base = constant, 0.0
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pair_edges: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        out = np.full(len(x), self.base)
        for t, c in zip(self.tables, b.T, strict=True):
            out += t[c]
        if self.pairs:
            p = binned(x, self.pair_edges)
            for i, j, t in self.pairs:
                out += t[p[:, i], p[:, j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, share: float | None = None) -> Gam:
    """Boost in cycles over the features, then over the best pairs; ``share`` is that of label 1 among all."""
    if len(set(y.tolist())) < 2:
        return Gam(float(y[0]) if len(y) else 0.0)
    gam = Gam()
    share = float(np.clip(y.mean() if share is None else share, 1e-3, 1 - 1e-3))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    gam.base = float(np.log(share / (1 - share)))
    gam.edges, gam.pair_edges = edges_of(x, BINS), edges_of(x, PAIR_BINS)
    b = binned(x, gam.edges)
    gam.tables = [np.zeros(len(e) + 1) for e in gam.edges]
    f = np.full(len(y), gam.base)
    for _ in range(CYCLES):
        for i, t in enumerate(gam.tables):
            p = 1 / (1 + np.exp(-f))
            step = RATE * _shallow(b[:, i], len(t), weight * (y - p), weight * p * (1 - p))
            t += step
            f += step[b[:, i]]
    pb = binned(x, gam.pair_edges)
    n = PAIR_BINS

    def tree(i: int, j: int) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-f))
        c = pb[:, i] * n + pb[:, j]
        return _shallow_pair(np.bincount(c, weight * (y - p), n * n).reshape(n, n), np.bincount(c, weight * p * (1 - p), n * n).reshape(n, n))

    ranked = sorted((-tree(i, j)[1], i, j) for i in range(x.shape[1]) for j in range(i))[:PAIRS]
    tables = {(i, j): np.zeros((n, n)) for _, i, j in ranked}
    for _ in range(CYCLES // 3):
        for (i, j), t in tables.items():
            step = RATE * tree(i, j)[0]
            t += step
            f += step[pb[:, i], pb[:, j]]
    gam.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return gam


def quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Learn from the labelled rows with ``learn`` (a condition on the key as ``__k``); key and score of every document."""
    spark = docs.sparkSession
    ship(spark)
    chosen, share = sample(docs, labels, label, learn if learn is not None else F.lit(True), key, text, SAMPLE, SAMPLE_CHARS)

    def described(batches, cut=512):
        for b in batches:
            for a in range(0, b.num_rows, cut):
                part = b.slice(a, cut)
                yield part, np.array([features(t) for t in part.column(1).to_pylist()]).reshape(part.num_rows, len(FEATURES))

    def learn_from(batches):
        for part, x in described(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64())), part.column(2)], names=["k", "x", "y"])

    kind = docs.schema[key].dataType.simpleString()
    rows = sorted(chosen.select("__d", "t", "y").mapInArrow(learn_from, f"k {kind}, x array<double>, y int").collect(), key=lambda r: r.k)
    model = fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float), share)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for part, x in described(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.scores(x), pa.float64())], names=["k", "score"])

    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(lambda it: tidied(run(it)), f"k {kind}, score double").withColumnRenamed("k", key)
