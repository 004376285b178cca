"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel counts common subsequences of three characters of two words, weighted by ``DECAY`` for
each character skipped, over spans of up to ``SPAN`` characters; a word has marks at both ends, and
what isn't a letter is left out of it.  So a word with gaps or inserted characters stays near the
word it hides.  Landmarks are character runs that set toxic training documents apart, and common
runs of the others; the Nyström map turns kernel values into features of a linear machine, which
learns from documents' labels: a toxic document has at least one toxic word, any other has none.
In a linear machine on a kernel of explicit features, all landmarks collapse to one weight for each
triple of characters, so that scoring a word is a few table lookups, kept in a cache by the worker.

A document's score is a calibrated function of its three highest words.

Learning uses at most ``SAMPLE`` labelled documents of each class, of at most ``SAMPLE_CHARS``
characters, taken by a hash of the key.  Within this sample, landmarks come from the ``CANDIDATES``
runs that tell the classes apart best, and of the words that are near no toxic landmark a seeded
``BACKGROUND`` (or ``BACKGROUND_SHARE`` of them, if that is more) stand for all.  Nothing else is
bounded: scoring reads every whole text.

Defined results: null and empty texts get the score of no words; with labels of one class only, all
scores are 0 or 1 by that class, without labels 0; null labels, labels without a document and labels
that contradict each other don't count, labels that repeat count once, with the least of a key's texts;
rows that repeat get equal scores; no documents, no rows; other columns play no part, and ``below``
keeps them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tidied, trim

SAMPLE, SAMPLE_CHARS = 1500, 20_000
SPAN, DECAY = 6, 0.6
TOXIC_LANDMARKS, OTHER_LANDMARKS = 96, 48
#: Lengths of the runs that may become landmarks, and the kernel value under which two are apart.
RUNS, APART = (4, 5, 6, 8), 0.5
ROUNDS, PENALTY = 4, 1.0
#: Runs of the sample that are compared as landmarks, and words of the sample that stand for all far ones.
CANDIDATES, BACKGROUND, BACKGROUND_SHARE = 4000, 5000, 0.02
#: Training words this near a toxic landmark can be a document's most toxic word.
NEAR = 0.2
#: Longer words are scored in windows.
WORD, STEP = 24, 12
#: Words that a worker remembers before it starts anew.
REMEMBERED = 40_000

_ALPHABET = 64
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_LETTERS = re.compile(r"[^\W\d_]+")


def _codes() -> np.ndarray:
    """Small codes of characters: the marks, a to z, and the rest hashed."""
    out = (np.arange(0x110000, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(_ALPHABET - 28) + np.uint64(28)
    out[ord("^")], out[ord("$")] = 0, 1
    out[ord("a") : ord("z") + 1] = np.arange(2, 28)
    return out.astype(np.int32)


_code_table: list[np.ndarray] = []


def _triples(words: list[str]):
    """(word, triple, weight) of all subsequences of the words, in parts."""
    if not _code_table:
        _code_table.append(_codes())
    n = np.fromiter(map(len, words), np.int64, len(words))
    c = _code_table[0][np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
    of = np.repeat(np.arange(len(words)), n)
    for a, b in _GAPS:
        if len(c) > b:
            same = of[:-b] == of[b:]
            yield of[:-b][same], (c[:-b] * _ALPHABET * _ALPHABET + c[a : len(c) - b + a] * _ALPHABET + c[b:])[same], DECAY ** (b - 2)


def _norms(words: list[str]) -> np.ndarray:
    """Norms as if no triple came twice: they depend on the length alone."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    total = np.zeros(len(n))
    for _, b in _GAPS:
        total += np.maximum(n - b, 0) * DECAY ** (2 * (b - 2))
    return np.sqrt(np.maximum(total, 1.0))


def marked(token: str) -> list[str]:
    """A token's letters between marks; a long one in windows."""
    w = "".join(_LETTERS.findall(token.lower()))
    if len(w) < 3:
        return []
    if len(w) <= WORD:
        return [f"^{w}$"]
    return [f"{'^' * (a == 0)}{w[a : a + WORD]}{'$' * (a + WORD >= len(w))}" for a in range(0, len(w) - STEP, STEP)]


def tokens_of(text: str | None) -> list[str]:
    """The tokens of a text, and runs of single characters as one more token each."""
    toks = text.split() if text else []
    if len(toks) > 2:
        single = np.fromiter(map(len, toks), np.int64, len(toks)) == 1
        if single.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
            toks += ["".join(toks[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a > 2]
    return toks


def kernel_matrix(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values of words and landmarks."""
    rows = np.unique(np.concatenate([t for _, t, _ in _triples(landmarks)] or [np.zeros(0, np.int64)]))
    index = np.zeros(_ALPHABET**3, np.int32)
    index[rows] = np.arange(1, len(rows) + 1)
    small = np.zeros((len(rows) + 1, len(landmarks)), np.float32)
    for of, t, w in _triples(landmarks):
        np.add.at(small, (index[t], of), w)
    out = np.zeros((len(words), len(landmarks)))
    for a in range(0, len(words), 4000):
        part = words[a : a + 4000]
        for of, t, w in _triples(part):
            hit = index[t]
            own = hit > 0
            if own.any():
                # the words come in order
                at = of[own]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                out[at[first] + a] += np.add.reduceat(small[hit[own]], first, axis=0) * w
    return out / _norms(words)[:, None] / _norms(landmarks)[None, :]


class Scorer:
    """A weight for each triple, the bias, and the calibration of the three highest words."""

    def __init__(self, weights: np.ndarray, bias: float, top: np.ndarray, constant: float | None = None):
        self.weights, self.bias, self.top, self.constant = weights, bias, top, constant
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.weights, self.bias, self.top, self.constant

    def __setstate__(self, x):
        self.__init__(*x)

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for of, t, w in _triples(words):
            out += np.bincount(of, self.weights[t] * w, len(words))
        return out / _norms(words) + self.bias

    def tokens(self, tokens: list[str]) -> list[float]:
        parts = [marked(t) for t in tokens]
        flat = [w for p in parts for w in p]
        scores = self.words(flat) if flat else np.zeros(0)
        out, at = [], 0
        for p in parts:
            out.append(float(scores[at : at + len(p)].max()) if p else -np.inf)
            at += len(p)
        return out

    def documents(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if len(self.cache) > REMEMBERED:
            self.cache = {}
        docs = [set(tokens_of(t)) for t in texts]
        new = list(set().union(*docs).difference(self.cache))
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.cache.update(zip(part, self.tokens(part), strict=True))
        get = self.cache.__getitem__
        return self.calibrate(np.array([highest(list(map(get, d))) for d in docs]).reshape(len(texts), 3))

    def calibrate(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(_calibration_features(x) @ self.top, -30, 30)
        return 1 / (1 + np.exp(-z))


def highest(scores: list[float]) -> list[float]:
    s = sorted(scores, reverse=True)[:3]
    return [max(x, -3.0) for x in s] + [-3.0] * (3 - len(s))


def _calibration_features(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0], x.mean(axis=1)])


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) / PENALTY
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        miss = 1 - y * (x @ w)
        on = miss > 0
        grad = ridge @ w - 2 * x[on].T @ (weight[on] * y[on] * miss[on])
        hess = ridge + 2 * (x[on].T * weight[on]) @ x[on]
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _landmarks(docs: list[list[str]], y: np.ndarray) -> tuple[list[str], list[str]]:
    """Character runs that set documents of class 1 apart, none near another; and common runs of class 0."""
    hit: tuple[dict, dict] = ({}, {})
    frequent: list[tuple[int, str]] = []
    for n in RUNS:  # a length at a time, as most runs occur once
        ones, zeros = Counter(), Counter()
        for d, k in zip(docs, y, strict=True):
            if k:
                ones.update({w[a : a + n] for w in d for a in range(len(w) - n + 1)})
        hit[1].update((g, c) for g, c in ones.items() if c > 1)
        del ones
        for d, k in zip(docs, y, strict=True):
            if not k:
                zeros.update({g for w in d for a in range(len(w) - n + 1) if (g := w[a : a + n]) in hit[1] or n == 5 or g[0] + g[-1] == "^$"})
        hit[0].update((g, c) for g, c in zeros.items() if g in hit[1])
        frequent = sorted([*frequent, *((-c, g) for g, c in zeros.items() if n == 5 or g[0] + g[-1] == "^$")])[: OTHER_LANDMARKS * 4]
    n1, n0 = int(y.sum()), int((1 - y).sum())
    # the lower end of the log odds' range: rare runs don't win by chance
    score = {g: np.log((c + 0.5) / (n1 + 1)) - np.log((hit[0].get(g, 0) + 0.5) / (n0 + 1)) - 2 * np.sqrt(1 / (c + 0.5) + 1 / (hit[0].get(g, 0) + 0.5)) for g, c in hit[1].items()}
    ranked = sorted((g for g in score if score[g] > 0), key=lambda g: (-score[g] * np.sqrt(hit[1][g]), -len(g), g))[:CANDIDATES]
    chosen: list[str] = []
    near = np.zeros(len(ranked))
    while len(chosen) < TOXIC_LANDMARKS and (near < APART).any():
        chosen.append(ranked[int(np.argmax(near < APART))])
        near = np.maximum(near, kernel_matrix(ranked, chosen[-1:])[:, 0])
        near[ranked.index(chosen[-1])] = 1
    common = [g for _, g in frequent[::4]]
    return chosen, common


def fit(texts: list[str], labels: list[int], share: float | None = None) -> Scorer:
    """Learn from documents with labels 0 and 1; ``share`` is that of label 1 among all labelled documents."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Scorer(np.zeros(1), 0.0, np.zeros(3), float(labels[0]) if labels else 0.0)
    shared: dict[str, str] = {}
    docs = [sorted({shared.setdefault(w, w) for t in set(tokens_of(x)) for w in marked(t)}) for x in texts]
    del shared
    toxic, common = _landmarks(docs, y)
    landmarks = [*toxic, *common]
    if not toxic:
        return Scorer(np.zeros(1), 0.0, np.zeros(3), float(y.mean()))
    every = sorted({w for d in docs for w in d})
    at = {w: i for i, w in enumerate(every)}
    own = [np.array([at[w] for w in d], np.int64) for d in docs]
    values, vectors = np.linalg.eigh(kernel_matrix(landmarks, landmarks) + 1e-3 * np.eye(len(landmarks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    # only words near a toxic landmark are kept, with a share of the others
    kept, nearest, parts = [], [], []
    r = np.random.default_rng(5)
    for a in range(0, len(every), 4000):
        k = kernel_matrix(every[a : a + 4000], landmarks)
        some = (k[:, : len(toxic)].max(axis=1) >= NEAR) | (r.random(len(k)) < max(BACKGROUND_SHARE, BACKGROUND / len(every)))
        kept.append(np.flatnonzero(some) + a)
        nearest.append(k[some, : len(toxic)].max(axis=1).astype(np.float32))
        parts.append(k[some].astype(np.float32) @ root.astype(np.float32))
        del k
    z, kept = np.concatenate(parts), np.concatenate(kept)
    del parts
    new = np.full(len(every), -1, np.int64)
    new[kept] = np.arange(len(kept))
    near = [new[o][new[o] >= 0] for o in own]
    f = np.concatenate(nearest)  # to begin with: the nearest landmark
    w = np.zeros(len(landmarks) + 1)
    for _ in range(ROUNDS):
        pos = [int(o[np.argmax(f[o])]) for o, t in zip(near, y, strict=True) if t == 1 and len(o)]
        hard = [o[np.argsort(-f[o])[:3]] for o, t in zip(near, y, strict=True) if t == 0 and len(o)]
        more = [r.choice(o, min(3, len(o)), replace=False) for o, t in zip(near, y, strict=True) if t == 0 and len(o)]
        neg, often = np.unique(np.concatenate([*hard, *more]), return_counts=True) if hard else (np.zeros(0, np.int64), np.zeros(0))
        p, times = np.unique(pos, return_counts=True)
        rows = np.concatenate([p, neg]).astype(np.int64)
        signs = np.concatenate([np.ones(len(p)), -np.ones(len(neg))])
        weight = np.concatenate([times / times.sum(), often / max(1, often.sum())]) * 100
        w = _svm(z[rows], signs, weight)
        f = z @ w[:-1] + w[-1]
    beta = root @ w[:-1] / _norms(landmarks)
    table = np.zeros(_ALPHABET**3)
    for of, t, g in _triples(landmarks):
        np.add.at(table, t, beta[of] * g)
    scorer = Scorer(table, float(w[-1]), np.zeros(3))
    f = np.concatenate([scorer.words(every[a : a + 20_000]) for a in range(0, len(every), 20_000)])
    x = np.array([highest(f[o].tolist()) for o in own])
    # the sample has its own share of each class
    share = float(np.clip(y.mean() if share is None else share, 1e-3, 1 - 1e-3))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    scorer.top = _logistic(_calibration_features(x), y, weight)
    return scorer


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps that are halved until they help."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 5e-2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (weight * p * (1 - p))) @ x + 1e-1 * np.eye(len(w))
        step, now = np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-1 * w), loss(w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``."""
    return F.crc32(key.cast("string")) % of


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, key: str = "doc_id", text: str = "text", most: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[DataFrame, float | None]:
    """At most ``most`` (t, y) rows of each class with ``learn``, by a hash of the key; and the share of label 1.

    Equal inputs give equal samples: labels that contradict each other don't count, and of several texts of a key
    the least is taken.
    """
    given = labels.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("__k").isNotNull()).filter(learn)
    known = given.groupBy("__k").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("__k", "y")
    order = [F.xxhash64("__k"), F.col("__k")]
    few = known.filter("y = 1").orderBy(*order).limit(most).unionByName(known.filter("y = 0").orderBy(*order).limit(most))
    short = docs.select(F.col(f"`{key}`").alias("__d"), F.col(f"`{text}`").cast("string").alias("t")).filter(F.length("t") <= chars)
    # at most twice ``most`` keys are broadcast
    found = short.join(F.broadcast(few), F.col("__d") == F.col("__k")).groupBy("__d").agg(F.min("t").alias("t"), F.first("y").alias("y"))
    return found, known.agg(F.avg("y")).first()[0]


def _scored(batches: Iterator[pa.RecordBatch], own: Scorer, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches and their scores; the words that the task remembers go with it."""
    try:
        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                yield part, own.documents(part.column(at).to_pylist())
    finally:
        own.cache = {}


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (double) of every document."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(scorer)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part, scores in _scored(batches, model.value, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["k", "score"])

    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(lambda it: tidied(run(it)), f"k {kind}, score double").withColumnRenamed("k", key)


def learned(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Learn from the labelled rows with ``learn`` (a condition on the key as ``__k``)."""
    chosen, share = sample(docs, labels, label, learn if learn is not None else F.lit(True), key, text)
    rows = chosen.orderBy("__d").collect()
    texts, given = [r.t for r in rows], [r.y for r in rows]
    del rows
    try:
        return fit(texts, given, share)
    finally:
        trim()


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Learn from the labelled rows with ``learn`` (a condition on the key as ``__k``), then score every document."""
    return score(docs, learned(docs, labels, learn, key, text, label), key, text)


def below(docs: DataFrame, scorer: Scorer, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own score is under ``limit``, whatever their key."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(scorer)
    at = docs.columns.index(text)

    def run(batches):
        for part, scores in _scored(batches, model.value, at):
            yield part.filter(pa.array(scores < limit))

    return docs.mapInArrow(lambda it: tidied(run(it)), docs.schema)
