"""Media columns: Matroska files in a binary column.

``mux`` writes a file, ``packets`` parses one: EBML elements with variable-length sizes, clusters,
simple blocks and block groups with Xiph, EBML or fixed lacing, and cues, into a packet table with
track, timestamp and byte range.  ``packet_table`` applies the parser to a DataFrame.

Times are milliseconds, from the file's own timestamp scale; packets of a block group are keyframes if
it refers to no other block.

Defined results: a null or empty text is stored as 64 zero bytes; null media give no packets; bytes
that aren't Matroska, or are damaged, raise ValueError in ``packets`` and give one row in
``packet_table``, with an error and no packet; rows that repeat give equal values; long texts are stored
whole, in as many clusters as they need; an empty table gives an empty one; a key named as a column of
the packet table raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidied

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
# where a cluster of unknown size ends
TOP = {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: 8-bit PCM at 8 kHz: 8 samples a millisecond; a packet holds 64 ms, a block at most 8 packets.
RATE, PACKET, LACE, CLUSTER_BLOCKS = 8000, 512, 8, 32


class Packet(NamedTuple):
    track: int
    timestamp: int  # in milliseconds
    start: int  # of its bytes in the file
    end: int
    keyframe: bool
    cluster: int
    lacing: int


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size."""
    w = width or next(i for i in range(1, 9) if n < (1 << 7 * i) - 1)
    return ((1 << 7 * w) | n).to_bytes(w, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_size(data: bytes, at: int) -> tuple[int, int]:
    """Value and end of a variable-length size; -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError("no variable-length size here")
    w = 9 - data[at].bit_length()
    if at + w > len(data):
        raise ValueError("a size is cut off")
    n = int.from_bytes(data[at : at + w], "big") & ((1 << 7 * w) - 1)
    return (-1 if n == (1 << 7 * w) - 1 else n), at + w


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or data[at] < 0x10:
        raise ValueError("no element id here")
    w = 9 - data[at].bit_length()
    return int.from_bytes(data[at : at + w], "big"), at + w


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range; a segment of unknown size ends with its parent, a cluster of unknown size there or at the next top element."""
    while at < end:
        ident, at = read_id(data, at)
        n, at = read_size(data, at)
        if n < 0:
            if ident not in (SEGMENT, CLUSTER):
                raise ValueError("only segments and clusters may have an unknown size")
            stop = end
            if ident == CLUSTER:
                for inner, a, b in elements_until(data, at, end, TOP):
                    stop = b if inner else a
        else:
            stop = at + n
        if stop > end:
            raise ValueError("an element is cut off")
        yield ident, at, stop
        at = stop


def elements_until(data: bytes, at: int, end: int, stops: set[int]) -> Iterator[tuple[int, int, int]]:
    """The elements up to one of ``stops``; then (0, its start, its start)."""
    while at < end:
        ident, a = read_id(data, at)
        if ident in stops:
            yield 0, at, at
            return
        n, a = read_size(data, a)
        at = a + n
        yield ident, a, at


def number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def lace_bytes(kind: int, frames: list[bytes]) -> bytes:
    """The body of a block after its header: count, sizes and frames."""
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == EBML_LACING:
        head += size_bytes(len(frames[0]))
        for x, y in zip(frames[:-2], frames[1:-1], strict=True):
            d = len(y) - len(x)
            w = next(i for i in range(1, 9) if abs(d) < (1 << (7 * i - 1)) - 1)
            head += size_bytes(d + (1 << (7 * w - 1)) - 1, w)
    elif len({len(f) for f in frames}) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def frames_of(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose header ends at ``at``."""
    if lacing == NO_LACING:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            s = 0
            while data[at] == 255:
                s, at = s + 255, at + 1
            sizes.append(s + data[at])
            at += 1
    elif lacing == EBML_LACING:
        if n > 1:
            s, at = read_size(data, at)
            sizes.append(s)
        for _ in range(n - 2):
            w = 9 - data[at].bit_length()
            s, at = read_size(data, at)
            if s < 0:
                s = (1 << 7 * w) - 1
            sizes.append(sizes[-1] + s - ((1 << (7 * w - 1)) - 1))
    else:
        if (end - at) % n:
            raise ValueError("fixed lacing doesn't divide its block")
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    if at > end:
        raise ValueError("lacing sizes exceed the block")
    return [*out, (at, end)]


def mux(payload: bytes) -> bytes:
    """A Matroska file with the payload as one track of 8-bit samples.

    Full blocks have fixed lacing; the last, ragged one has EBML lacing, or none for one frame.
    """
    header = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"gaussframe") + element(WRITING_APP, b"gaussframe"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, PACKET * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    ms = PACKET * 1000 // RATE
    per_cluster = PACKET * LACE * CLUSTER_BLOCKS
    for c in range(0, max(1, len(payload)), per_cluster):
        stamp = c // PACKET * ms
        parts = [uint(TIMESTAMP, stamp)]
        for b in range(c, min(c + per_cluster, len(payload)), PACKET * LACE):
            piece = payload[b : b + PACKET * LACE]
            frames = [piece[i : i + PACKET] for i in range(0, len(piece), PACKET)]
            kind = NO_LACING if len(frames) == 1 else FIXED if len(frames[0]) == len(frames[-1]) else EBML_LACING
            head = b"\x81" + struct.pack(">h", b // PACKET * ms - stamp) + bytes([0x80 | kind << 1])
            parts.append(element(SIMPLE_BLOCK, head + (piece if kind == NO_LACING else lace_bytes(kind, frames))))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, stamp) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return header + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def packets(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]], dict[int, dict]]:
    """Packets, cues (time, track, file position of the cluster) and tracks of a file."""
    found: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    tracks: dict[int, dict] = {}
    n_cluster, seen, scale = 0, False, 1_000_000
    for ident, a, b in elements(data, 0, len(data)):
        if ident == EBML:
            kind = {i: data[x:y] for i, x, y in elements(data, a, b)}.get(DOC_TYPE, b"")
            if kind.rstrip(b"\0") not in (b"matroska", b"webm"):
                raise ValueError("not a Matroska file")
            seen = True
        if ident != SEGMENT:
            continue
        if not seen:
            raise ValueError("a segment without its EBML header")
        tops = list(elements(data, a, b))
        for top, x, y in tops:
            if top == INFO:
                scale = next((number(data, u, v) for i, u, v in elements(data, x, y) if i == TIMESTAMP_SCALE), 1_000_000)
        for top, x, y in tops:
            if top == TRACKS:
                for t, p, q in elements(data, x, y):
                    if t == TRACK_ENTRY:
                        own: dict = {"default_ns": 0, "codec": ""}
                        num = 0
                        for i, u, v in elements(data, p, q):
                            if i == TRACK_NUMBER:
                                num = number(data, u, v)
                            elif i == DEFAULT_DURATION:
                                own["default_ns"] = number(data, u, v)
                            elif i == CODEC_ID:
                                own["codec"] = data[u:v].decode("ascii", "replace")
                        tracks[num] = own
            elif top == CLUSTER:
                stamp = 0
                for i, u, v in elements(data, x, y):
                    if i == TIMESTAMP:
                        stamp = number(data, u, v)
                    elif i == SIMPLE_BLOCK:
                        found += block(data, u, v, stamp, scale, n_cluster, tracks, None)
                    elif i == BLOCK_GROUP:
                        parts = list(elements(data, u, v))
                        key = all(j != REFERENCE_BLOCK for j, _, _ in parts)
                        for j, s, e in parts:
                            if j == BLOCK:
                                found += block(data, s, e, stamp, scale, n_cluster, tracks, key)
                n_cluster += 1
            elif top == CUES:
                for p, u, v in elements(data, x, y):
                    if p != CUE_POINT:
                        continue
                    when = 0
                    for i, s, e in elements(data, u, v):
                        if i == CUE_TIME:
                            when = number(data, s, e)
                        elif i == CUE_TRACK_POSITIONS:
                            got = {j: number(data, k, m) for j, k, m in elements(data, s, e)}
                            cues.append((when * scale // 1_000_000, got.get(CUE_TRACK, 0), a + got.get(CUE_CLUSTER_POSITION, 0)))
    if not seen:
        raise ValueError("not a Matroska file")
    return found, cues, tracks


def block(data: bytes, a: int, b: int, stamp: int, scale: int, cluster: int, tracks: dict[int, dict], key: bool | None) -> list[Packet]:
    """The packets of a block; ``key`` is None where the block's own flag tells keyframes."""
    track, at = read_size(data, a)
    if at + 3 > b:
        raise ValueError("a block is cut off")
    offset = struct.unpack_from(">h", data, at)[0]
    flags = data[at + 2]
    lacing = flags >> 1 & 3
    step = tracks.get(track, {}).get("default_ns", 0)
    return [Packet(track, ((stamp + offset) * scale + i * step) // 1_000_000, x, y, bool(flags & 0x80) if key is None else key, cluster, lacing) for i, (x, y) in enumerate(frames_of(data, at + 3, b, lacing))]


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 if data else 64)


def read_back(data: bytes) -> bytes:
    """The payload, from the byte ranges of the packets in order of time."""
    found, _, _ = packets(data)
    return b"".join(data[p.start : p.end] for p in sorted(found, key=lambda p: (p.track, p.timestamp, p.start)))


PACKET_SCHEMA = "packet long, track int, timestamp_ms long, byte_start long, byte_end long, keyframe boolean, cluster int, lacing int, at_cue boolean, error string"


def packet_table(df: DataFrame, media: str, *keys: str) -> DataFrame:
    """One row a packet: ``keys`` and track, timestamp, byte range, cluster, lacing, and whether a cue names its cluster."""
    ship(df.sparkSession)
    n, names = len(keys), [x.split()[0] for x in PACKET_SCHEMA.split(", ")]
    if set(names) & {k.lower() for k in keys}:
        raise ValueError("a key is named as a column of the packet table")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(n)[i].as_py()
                if data is None:
                    continue
                error = None
                try:
                    found, cues, _ = packets(data)
                except (ValueError, IndexError, struct.error) as e:
                    found, cues, error = [], [], str(e) or type(e).__name__
                times = {(t, track) for t, track, _ in cues}
                firsts = {c: t for t, c in sorted(((p.timestamp, p.cluster) for p in found), reverse=True)}
                cols = [pa.array(range(len(found)), pa.int64()), *(pa.array([p[k] for p in found], t) for k, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.bool_()), (5, pa.int32()), (6, pa.int32()))), pa.array([(firsts[p.cluster], p.track) in times for p in found], pa.bool_()), pa.nulls(len(found), pa.string())]
                if error is not None:
                    cols = [*(pa.nulls(1, c.type) for c in cols[:-1]), pa.array([error])]
                own = [pa.array([b.column(k)[i].as_py()] * len(cols[0]), b.schema.field(k).type) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*own, *cols], names=[*b.schema.names[:n], *names])

    plain = df.select(*keys, F.col(media).cast("binary").alias("__media"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:n]), PACKET_SCHEMA])
    return plain.mapInArrow(lambda it: tidied(run(it)), schema)


FEATURES = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def features(text: str | None, keep_media: bool = False) -> tuple:
    raw = (text or "").encode()
    media = mux(pad(raw))
    found, cues, tracks = packets(media)
    order = sorted(found, key=lambda p: (p.track, p.timestamp, p.start))
    back = b"".join(media[p.start : p.end] for p in order)
    laced = sum(p.lacing != NO_LACING for p in found)
    feature = f"{tracks[1]['codec']}:packets={len(found)}:clusters={found[-1].cluster + 1}:laced={laced}:cues={len(cues)}:last_ms={order[-1].timestamp}:mean={sum(back[-64:]) / 64:.4f}"
    out = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
    return (*out, media) if keep_media else out


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every text as a Matroska file, read it back and describe it; ``keep_media`` adds the file itself."""
    ship(docs.sparkSession)
    cols = [*FEATURES, ("media", pa.binary())] if keep_media else FEATURES

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                rows = [features(t, keep_media) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), cols, strict=True))], names=["__key", *(n for n, _ in cols)])

    plain = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = f"__key {plain.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} {kinds[t]}" for n, t in cols)
    return plain.mapInArrow(lambda it: tidied(run(it)), schema).withColumnRenamed("__key", key)
