"""Byte-level BPE: encoding by a global shuffle of distinct words, and decoding by a join with the token-byte table.

Encoding has three stages; texts are read and cut once.
1. Texts are cut into pre-tokens.  A block of texts (``BLOCK_BYTES``) keeps the positions of its
   pre-tokens as one sequence of word numbers, and its distinct words go out packed by word hash.
2. Words are dealt by hash and met in order of it, so all that name one word meet in one task at one
   time: each distinct word of the input is encoded once, and what a task remembers is one of
   ``FINE`` parts of its partition's distinct words.
3. The ids are joined back to the blocks, which replace word numbers by ids in order of position.
Words and blocks share one shuffle, which both stages read: blocks are dealt by their name, so that they
lie where stage 3 wants them, and words by names that hash to the partitions (``named_parts``).  What is
written is a block's distinct words, their ids and once the sequence of numbers, all compressed; a
frequent word moves once a block, never once an occurrence.

Decoding joins the table of token bytes, whose size is the vocabulary's, to the ids of a batch by
address: ids are dense, so the broadcast table is an Arrow array that is taken at the ids.

Blocks are named by a digest of their content.  An input that may come in another order when a lost
task runs again (no file scan) needs ``stable=False``, which stores it first.

Defined results: null and empty texts have no tokens; null keys stay null; rows that repeat give a
row each; an empty table gives an empty result; a text is never split between blocks nor truncated;
ids outside the vocabulary raise in ``decode``, null ids decode to null; other columns stay.
"""

from __future__ import annotations

import array
import base64
import hashlib
import math
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stored, tidied

#: Bytes of text of a block; a longer text is a block of its own.
BLOCK_BYTES = 5 << 20
#: Parts of a partition's words; a task remembers the words of one at a time.
FINE = 4
#: Word numbers under this take one byte; others a byte for their size, and their lower bits.
SHORT = 224

_compiled: dict[str, tuple] = {}
_encoders: dict[tuple[str, str], object] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(path: str, pattern: str):
    if (path, pattern) not in _encoders:
        import tiktoken

        _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
    return _encoders[path, pattern]


def char_class(prop: str, ascii_only: bool) -> str:
    """The characters of a Unicode property as the inside of a bracket."""
    import regex

    every = "".join(map(chr, range(0x80))) if ascii_only else "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    runs = [m.group() for m in regex.finditer(rf"{prop}+", every)]
    out = []
    for r in runs:  # a run may step over the gap of the surrogates
        a = 0
        for i in range(1, len(r) + 1):
            if i == len(r) or ord(r[i]) != ord(r[i - 1]) + 1:
                out.append(rf"\U{ord(r[a]):08x}-\U{ord(r[i - 1]):08x}")
                a = i
    return "".join(out)


def translated(pattern: str, ascii_only: bool) -> str:
    """A pattern with \\p{L}, \\p{N}, \\s and \\S for the standard library, whose classes differ."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        if m := re.match(r"\\p\{\w+\}|\\s", pattern[i:]):
            body = char_class(m.group(), ascii_only)
            out.append(body if inside else f"[{body}]")
        elif pattern.startswith(r"\S", i):
            if inside:
                raise ValueError("a negated class inside brackets")
            m = re.match(r"\\S", pattern[i:])
            out.append(f"[^{char_class(chr(92) + 's', ascii_only)}]")
        elif pattern[i] == "\\":
            m = re.match(r"\\.", pattern[i:])
            out.append(m.group())
        else:
            m = re.match(".", pattern[i:], re.S)
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
        i += m.end()
    return "".join(out)


def splitter(pattern: str):
    """A function from text to its pre-tokens."""
    if pattern not in _compiled:
        import regex

        try:
            _compiled[pattern] = (re.compile(translated(pattern, True)).findall, re.compile(translated(pattern, False)).findall)
        except (ValueError, re.error):
            _compiled[pattern] = (regex.compile(pattern).findall,) * 2
    ascii_, all_ = _compiled[pattern]
    return lambda text: (ascii_ if text.isascii() else all_)(text)


_zstd: list = []


def _pack(x) -> bytes:
    if not _zstd:
        import zstandard

        _zstd.extend([zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()])
    return _zstd[0].compress(pickle.dumps(x, 5))


def _unpack(b: bytes):
    if not _zstd:
        _pack(None)
    return pickle.loads(_zstd[1].decompress(b))


def _planes(a: np.ndarray) -> tuple[int, list[bytes]]:
    """A uint32 array as its byte planes, which compress better; planes of zeros are left out."""
    b = np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(a.max()) if len(a) else 0
    return len(a), [b[:, i].tobytes() for i in range(max(1, (top.bit_length() + 7) // 8))]


def _whole(x: tuple[int, list[bytes]]) -> np.ndarray:
    b = np.zeros((x[0], 4), np.uint8)
    for i, p in enumerate(x[1]):
        b[:, i] = np.frombuffer(p, np.uint8)
    return b.reshape(-1).view("<u4")


def _coded(a: np.ndarray) -> tuple[bytes, tuple]:
    """Numbers of which small ones are frequent: a byte each, and for those from ``SHORT`` on the bits below their highest."""
    first = np.minimum(a, 255).astype(np.uint8)
    long = a >= SHORT
    rest = a[long] - np.uint32(SHORT - 1)
    # some at a time, so that no wide copy of all is made
    bits = np.concatenate([np.frexp(rest[i : i + 65536].astype(np.float64))[1].astype(np.uint8) - np.uint8(1) for i in range(0, len(rest), 65536)] or [np.zeros(0, np.uint8)])
    first[long] = SHORT + bits
    return first.tobytes(), _planes(rest - (np.uint32(1) << bits.astype(np.uint32)))


def _decoded(x: tuple[bytes, tuple]) -> np.ndarray:
    out = np.frombuffer(x[0], np.uint8).astype(np.uint32)
    long = out >= SHORT
    out[long] = (np.uint32(1) << (out[long] - np.uint32(SHORT))) + _whole(x[1]) + np.uint32(SHORT - 1)
    return out


def _block(keys: list, rows: list[np.ndarray], numbers: dict[str, int], fine: int) -> tuple[str, bytes, list[tuple[int, bytes]]]:
    """Name, packed documents and packed words by fine part.

    Words are numbered by frequency and listed so in their part, so that ``part`` (of each word by
    number) tells the number of the words as the parts list them.
    """
    lens = np.array([len(r) for r in rows], np.uint32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    words = [w.encode() for w in numbers]
    by_freq = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
    new = np.empty(len(words), np.uint32)
    new[by_freq] = np.arange(len(words), dtype=np.uint32)
    part = np.fromiter((zlib.crc32(words[i]) % fine for i in by_freq.tolist()), np.uint32, len(words))
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist() if len(words) else []
    sent = []
    for a, z in zip(cuts, [*cuts[1:], len(words)], strict=True):
        own = [words[i] for i in by_freq[order[a:z]].tolist()]
        sent.append((int(part[order[a]]), _pack((_planes(np.fromiter(map(len, own), np.uint32, len(own))), b"".join(own)))))
    docs = _pack((keys, _planes(lens), _coded(new[flat]), _planes(part)))
    return hashlib.blake2b(docs, digest_size=16).hexdigest(), docs, sent


_COLUMNS = ["dest", "block", "fine", "payload"]


def _rows(dest: list[str], block: list[str], fine: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.string()), pa.array(block, pa.string()), pa.array(fine, pa.int32()), pa.array(payload, pa.binary())], names=_COLUMNS)


def named_parts(spark: SparkSession, parts: int) -> list[str]:
    """A name for each part of the words, such that names hash to different partitions.

    Of so many candidates one lacks a partition once in 20,000 runs; its part then shares another's.
    """
    names = [f"w{i}" for i in range(parts)]
    tried = spark.range(0, int(parts * (math.log(parts) + 10)), 1, 1).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("name"))
    for name, at in tried.select("name", F.pmod(F.hash("name"), F.lit(parts))).collect():
        names[at] = name
    return names


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row of documents (fine -1, dealt by the block's name) and rows of words (dealt by ``names``) of each block."""
    split = splitter(pattern)

    def out() -> Iterator[pa.RecordBatch]:
        name, docs, sent = _block(keys, rows, numbers, len(names) * FINE)
        yield _rows([name], [name], [-1], [docs])
        yield _rows([names[f // FINE] for f, _ in sent], [name] * len(sent), [f for f, _ in sent], [s for _, s in sent])

    def fresh() -> tuple[list, list, dict, int]:
        numbers: defaultdict = defaultdict()
        numbers.default_factory = numbers.__len__
        return [], [], numbers, 0

    keys, rows, numbers, size = fresh()
    for b in batches:
        for a in range(0, b.num_rows, 256):
            part = b.slice(a, 256)
            for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py() or ""
                if size and size + len(text) > BLOCK_BYTES:
                    yield from out()
                    keys, rows, numbers, size = fresh()
                words = split(text) if text else []
                keys.append(key)
                rows.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(text)
    if keys:
        yield from out()


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indexes of consecutive ranges."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Words:
    """The ids of the words met, in one flat array."""

    def __init__(self, enc):
        self.one = getattr(enc, "_encode_single_piece", None) or (lambda w: enc.encode_ordinary(w.decode()))
        self.number: dict[bytes, int] = {}
        self.ids, self.ends = array.array("I"), array.array("q", [0])

    def clear(self) -> None:
        self.number.clear()
        del self.ids[:], self.ends[1:]

    def of(self, lens: list[int], data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids."""
        at, found = 0, []
        for n in lens:
            w = data[at : at + n]
            at += n
            i = self.number.get(w)
            if i is None:
                i = self.number[w] = len(self.number)
                self.ids.extend(self.one(w))
                self.ends.append(len(self.ids))
            found.append(i)
        ends = np.frombuffer(self.ends, np.int64)
        i = np.array(found, np.int64)
        starts, n = ends[i], ends[i + 1] - ends[i]
        return n.astype(np.uint32), np.frombuffer(self.ids, np.uint32)[ragged(starts, n)]


def _encode_words(batches: Iterator[pa.RecordBatch], path: str, pattern: str, count) -> Iterator[pa.RecordBatch]:
    """Words, in order of their fine part, become ids, dealt by their block's name."""
    words, now, done = _Words(encoder(path, pattern)), -1, 0
    for b in batches:
        payloads = []
        for fine, payload in zip(b.column(2).to_pylist(), b.column(3), strict=True):
            if fine != now:
                done += len(words.number)
                words.clear()
                now = fine
            lens, data = _unpack(payload.as_py())
            n, ids = words.of(_whole(lens).tolist(), data)
            payloads.append(_pack((_planes(n), _planes(ids))))
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(payloads, pa.binary())], names=["dest", "fine", "payload"])
    if count is not None:
        count.add(done + len(words.number))


def _reassemble(blocks: pa.Table, ids: pa.Table, key_type: pa.DataType, tokens: pa.Array | None = None) -> pa.Table:
    """The rows of a block; with the token-byte table also what their ids decode to."""
    # equal blocks come with equal words: each part counts once
    answers = dict(zip(ids.column("fine").to_pylist(), ids.column("payload"), strict=True))
    docs = list(blocks.column("payload"))
    lens, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for f in sorted(answers):
        n, ids = _unpack(answers[f].as_py())
        lens.append(_whole(n).astype(np.int64))
        flat.append(_whole(ids))
    sent_lens, flat = np.concatenate(lens), np.concatenate(flat)
    del lens, answers
    if not docs:
        raise RuntimeError("a block's words came without its documents: the input differs between two runs of a task; use stable=False")
    keys, doc_lens, numbers, part = _unpack(docs[0].as_py())
    doc_lens, numbers, order = _whole(doc_lens).astype(np.int64), _decoded(numbers), np.argsort(_whole(part), kind="stable")
    if len(order) != len(sent_lens):
        raise RuntimeError("words of a block are missing: the input differs between two runs of a task; use stable=False")
    word_lens, word_starts = np.empty_like(sent_lens), np.empty_like(sent_lens)
    word_lens[order], word_starts[order] = sent_lens, np.cumsum(sent_lens) - sent_lens
    ends = np.cumsum(doc_lens)
    out_n, out_ids = [], []
    for a in range(0, len(keys), 128):
        z = min(a + 128, len(keys))
        own = numbers[ends[a] - doc_lens[a] : ends[z - 1]]
        n = word_lens[own]
        ids = flat[ragged(word_starts[own], n)].astype("<u4")
        upto = np.concatenate([[0], np.cumsum(n)])
        cuts = upto[np.concatenate([[0], ends[a:z] - (ends[a] - doc_lens[a])])]
        out_n.append(np.diff(cuts))
        out_ids.append(pa.array([ids[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()))
    one = pa.table([pa.array(keys, key_type), pa.array(np.concatenate(out_n), pa.int64()), pa.chunked_array(out_ids, pa.binary())], names=["__key", "n_tokens", "ids"])
    if tokens is not None:
        one = one.append_column("decoded", pa.chunked_array([joined_bytes(x, tokens) for x in out_ids], pa.binary()))
    # a block that came several times gives its rows as often
    return pa.concat_tables([one] * len(docs))


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", stable: bool = True, count=None, round_trip: bool = False) -> DataFrame:
    """``key``, n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers) of every whole text.

    ``count``, an accumulator, gets the number of words encoded.  ``round_trip`` adds decoded, what ``decode``
    makes of the ids, in the task that has them.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))
    if not stable:
        plain = stored(plain, "bpe-input")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = plain.schema[0].dataType
    key_type = to_arrow_type(kind)
    names = named_parts(spark, parts)
    cut = plain.mapInArrow(lambda it: tidied(_blocks(it, pattern, names)), "dest string, block string, fine int, payload binary")
    dealt = cut.repartition(parts, "dest")

    def kind_of(words: bool):
        # a condition that isn't deterministic stays above the shuffle, so that both sides read the same one
        return F.when(F.spark_partition_id() >= 0, (F.col("fine") >= 0) == words)

    blocks = dealt.filter(kind_of(False))
    answers = dealt.filter(kind_of(True)).sortWithinPartitions("fine").mapInArrow(lambda it: tidied(_encode_words(it, ranks_path, pattern, count)), "dest string, fine int, payload binary")
    table = spark.sparkContext.broadcast(token_bytes(ranks_path)) if round_trip else None
    columns = f"__key {kind.simpleString()}, n_tokens long, ids binary{', decoded binary' * round_trip}"
    whole = blocks.groupBy("dest").cogroup(answers.groupBy("dest")).applyInArrow(lambda b, i: _reassemble(b, i, key_type, table.value if table else None), columns)
    return whole.withColumnRenamed("__key", key)


def token_bytes(ranks_path: str) -> pa.Array:
    """The token-byte table: bytes by id; ids that the file lacks are null."""
    ranks = ranks_of(ranks_path)
    rows: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for b, i in ranks.items():
        rows[i] = b
    return pa.array(rows, pa.binary())


def joined_bytes(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    """The bytes of every id sequence of a batch: one join of all ids with the table."""
    off = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, "<i4")
    data = ids.buffers()[2] if len(ids) else None
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    if len(raw) % 4 or ((off - off[0]) % 4).any():
        raise ValueError("ids are 32-bit integers")
    found = np.frombuffer(raw.tobytes(), "<u4")
    if len(found) and int(found.max()) >= len(tokens):
        raise ValueError(f"{int(found.max())} is no id of this vocabulary")
    taken = tokens.take(pa.array(found))
    if taken.null_count:
        raise ValueError("an id that the vocabulary lacks")
    ends = np.frombuffer(taken.buffers()[1], "<i4")[taken.offset :] if len(taken) else np.zeros(1, "<i4")
    cuts = ends[(off - off[0]) // 4].astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ids), [ids.is_valid().buffers()[1] if ids.null_count else None, pa.py_buffer((cuts - cuts[0]).tobytes()), taken.buffers()[2] if len(taken) else pa.py_buffer(b"")])


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of every id sequence, by a join with the table of token bytes (as many rows as the vocabulary)."""
    spark = encoded.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(token_bytes(ranks_path))
    names = [c for c in encoded.columns if c != out]
    plain = encoded.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    at = names.index(ids)

    def run(batches):
        tokens = table.value
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, joined_bytes(part.column(at), tokens)], names=[*b.schema.names, "__d"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", __d binary"
    return plain.mapInArrow(lambda it: tidied(run(it)), schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("__d").alias(out))
