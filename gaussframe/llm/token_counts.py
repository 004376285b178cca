"""Token counts with a map-side two-tier lookup.

A text is cut before every run of spaces that follows another character.  The SentencePiece BPE
model has no piece in which a space mark follows another character, so no merge crosses such a cut
and a text's count is the sum of its pre-tokens' counts.  The constructor checks this property of
the model.  First tier: a table of the lengths of frequent pre-tokens (the model's own words, at
most as many as its vocabulary), broadcast once.  Second tier: a bounded cache in each worker;
what misses both is encoded by the library.  Nothing is shuffled.

Defined results: null and empty texts have 0 tokens; extra columns stay untouched; rows repeat as
they are; very long texts are counted whole, without truncation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Entries of a worker's cache before it starts anew.
CACHE = 400_000
#: Longer pre-tokens aren't cached.
CACHED_CHARS = 64

MARK = "▁"
_CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
_loaded: dict[str, object] = {}


def model(path: str):
    """The SentencePiece model of a file, kept by the worker."""
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def separable(sp) -> bool:
    """Whether pre-tokens can be encoded apart: no piece has a space mark after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


def encode_apart(sp, chunks: list[str]) -> list[int]:
    """Token counts of pre-tokens; each begins with a space, of which the library adds the first itself."""
    rest = [c[1:] for c in chunks]
    return [len(ids) if r else 1 for r, ids in zip(rest, sp.encode(rest, num_threads=1), strict=True)]


def frequent(path: str) -> dict[str, int]:
    """First tier: the words among the model's pieces, with their counts.  At most one entry a piece."""
    sp = model(path)
    words = [p for i in range(sp.get_piece_size()) if (p := sp.id_to_piece(i)).startswith(MARK) and len(p) > 1 and p[1] != MARK]
    chunks = [" " + p[1:] for p in words]
    return dict(zip(chunks, encode_apart(sp, chunks), strict=True))


class Counter:
    """Both tiers in one worker."""

    def __init__(self, path: str, table: dict[str, int]):
        self.sp, self.table, self.cache = model(path), table, dict(table)

    def count(self, texts: list[str | None]) -> list[int]:
        split, missing = [], {}
        cache = self.cache
        for t in texts:
            chunks = _CHUNK.findall(t) if t else []
            if chunks:
                # the library puts a space before the text
                chunks[0] = " " + chunks[0]
            split.append(chunks)
        for chunks in split:
            for c in set(chunks).difference(cache):
                missing[c] = 0
        if missing:
            new = list(missing)
            for a in range(0, len(new), 50_000):
                missing.update(zip(new[a : a + 50_000], encode_apart(self.sp, new[a : a + 50_000]), strict=True))
            if len(cache) + len(missing) <= CACHE:
                cache.update((c, n) for c, n in missing.items() if len(c) <= CACHED_CHARS)
            else:
                self.cache = dict(self.table)
                self.cache.update(list((c, n) for c, n in missing.items() if len(c) <= CACHED_CHARS)[:CACHE])
        both = _Two(cache, missing)
        return [sum(map(both.get, chunks)) for chunks in split]


class _Two:
    """The cache, then this batch's misses."""

    def __init__(self, cache: dict, more: dict):
        self.get = cache.__getitem__ if not more else (lambda c, a=cache.get, b=more: n if (n := a(c)) is not None else b[c])


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens", limit: int = 4096) -> DataFrame:
    """Add ``out`` (tokens of the whole text, long), ``n_bytes`` and ``over_limit`` to ``docs``.

    Columns of these names that are there already are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    if not separable(model(model_path)):
        raise ValueError("this model joins words across spaces; its pre-tokens can't be counted apart")
    tier = spark.sparkContext.broadcast(frequent(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(model_path)
        if counter is None:
            counter = _counters[model_path] = Counter(model_path, tier.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index("__text"))
            rest = b.drop_columns(["__text"])
            counts: list[int] = []
            for a in range(0, len(texts), 200):
                counts += counter.count(texts.slice(a, 200).to_pylist())
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(counts, pa.int64())], names=[*rest.schema.names, "__n"])

    kept = [c for c in docs.columns if c not in (out, "n_bytes", "over_limit")]
    # columns may have any name: they travel as c0, c1, ...
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"), F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("__b"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "__text") + ", __n long"
    done = plain.mapInArrow(run, schema)
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("__b").alias("n_bytes"), F.col("__n").alias(out), (F.col("__n") > limit).alias("over_limit"))
