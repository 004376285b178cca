"""N-gram Jaccard join with token-combination prefixes, down to connected components.

Tokens are hashed word shingles.  They are ordered by how often they occur (from a sketch of
``COUNTERS`` counters over all documents), rare ones first.  Two sets with Jaccard similarity of at
least t share s tokens among their first n - ceil(t n) + s.  With s = 1 + G, and the frequent tokens
dealt to G classes, they then share a rare token, or two frequent tokens of one class: rare tokens are
indexed alone and frequent ones in pairs of a class.  G grows with the size of the set, so that the
pairs stay a few times the prefix; sets meet in size bands, which fix G for both.

Verification loses no link between different texts and never lists a group's pairs:
1. In every bucket each set is verified against one hub (the one that holds the token earliest).
2. Buckets whose members are not yet one component are compared in blocks of bounded size: first by
   parity maps, which bound set differences, then, for members that these allow a partner, by matrix
   products of sets in a worker, which return the edges of a spanning forest.
3. Buckets of several blocks that still hold several components are compared across their blocks.
Components come from alternating large-star and small-star steps on stored tables.

Sets have a 64-bit name; the rare run in which two sets would share one is told by a second hash and
repeated with another seed.  Equal sets are one node, so copies never meet each other.

Defined results: null and blank texts have no shingles and are linked with nothing; texts with fewer
words than a shingle have one, the whole sequence; rows with a null key take part and get their
component's smallest key (null if it has none); rows that repeat give a row each; long texts are
shingled whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_size, filter_words, forget, maybe_in, ship, stored, tidied

#: Counters of the frequency sketch (2**20, 4 MB), whatever the input.
COUNTER_BITS = 20
SLICES = 64
#: A counter this far over the mean holds a frequent token.
FREQUENT = 300
#: Members and tokens of a block.
BLOCK_SETS, BLOCK_TOKENS = 1024, 1_000_000
#: Words whose hashes a worker remembers before it starts anew.
REMEMBERED = 40_000
#: Least cells of the parity map of a set, which bounds the difference of two sets from below.
PARITY = 1024

_MULT = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25]


class _Hashes(dict):
    def __init__(self, seed: int):
        import xxhash

        super().__init__()
        self.seed, self.hash = seed, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self[word] = self.hash(word, self.seed)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes; only A-Z are lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(hashes) > REMEMBERED:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        m = np.uint64(_MULT[i % len(_MULT)] + 2 * (i // len(_MULT)) & 0xFFFFFFFFFFFFFFFF)
        total += h[i : len(h) - k + 1 + i] * m
    if k < width:
        total += np.uint64(k)
    return np.unique(_mixed(total))


def names(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit names of a set."""
    import xxhash

    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
    return int(d[0]), int(d[1])


def parity(s: np.ndarray) -> np.ndarray:
    """Which cells hold an odd number of tokens; maps differ in no more places than sets in tokens.

    There is a cell for each token at least, by powers of two from ``PARITY``; the halves' XOR is the map of half the cells.
    """
    cells = max(PARITY, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(8)).astype(np.int64) % cells, minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_difference(a: Column, b: Column) -> Column:
    """In how many places two maps differ at least, of which one may have twice the other's cells."""

    def folded(x: Column, other: Column) -> Column:
        h = F.size(other)
        return F.when(F.size(x) > h, F.zip_with(F.slice(x, 1, h), F.slice(x, h + 1, h), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    x = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    # maps that differ more in size say nothing
    return F.aggregate(x, F.lit(0), lambda t, n: t + F.coalesce(n, F.lit(0)))


def bands(num: int, den: int, upto: int) -> np.ndarray:
    """First sizes of the bands: sets of similarity num/den are in one band or in neighbours."""
    out = [1]
    while out[-1] <= upto:
        out.append(out[-1] * den // num + 1)
    return np.array(out, np.int64)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def classes(k: int, starts: np.ndarray, num: int, den: int) -> int:
    """Number of classes of frequent tokens in band k."""
    return max(1, -(-prefix_length(int(starts[k]), num, den) // 6))


def signatures(s: np.ndarray, counts: np.ndarray, limit: float, starts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set, and for each how many of its tokens can't be shared once it is the first.

    A set stands in its own size band and the next, so that all that link with it meet it in one.
    A pair of sets that links has a first signature in common: before it no rare token was shared,
    and at most one frequent token of each class.  So the overlap is at most n minus that number.
    """
    n = len(s)
    c = counts[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    p = prefix_length(n, num, den)
    band = int(np.searchsorted(starts, n, "right")) - 1
    g_own, g_next = classes(band, starts, num, den), classes(band + 1, starts, num, den)
    order = np.lexsort((s, c))[: p + max(g_own, g_next)]
    t, often = s[order], c[order] > limit
    rare, f, where = t[~often], t[often], np.flatnonzero(often)
    # of the next band, all are larger: fewer positions leave enough to share
    last = n + -num * (n + int(starts[band + 1])) // (num + den)
    sig, at = [], []
    for key, g, most in ((band, g_own, p - 1), (band + 1, g_next, last)):
        first = np.flatnonzero(~often)
        own = first <= most
        sig.append(_mixed(rare[own] + np.uint64(1 + key * _MULT[3] & 0xFFFFFFFFFFFFFFFF)))
        at.append(first[own])
        own = where < p + g
        kind = (f[own] >> np.uint64(8)) % np.uint64(g)
        by = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[by], np.arange(g + 1, dtype=np.uint64))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                x, y = np.triu_indices(b - a, 1)
                i, j = by[a:b][x], by[a:b][y]
                place = np.maximum(where[np.maximum(i, j)] - g, 0)
                i, j, place = i[place <= most], j[place <= most], place[place <= most]
                sig.append(_mixed(f[i] * np.uint64(_MULT[1]) + f[j] * np.uint64(_MULT[2]) + np.uint64(key + 2)))
                at.append(place)
    return np.concatenate(sig).view(np.int64), np.concatenate(at).astype(np.int32)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for a in range(0, b.num_rows, 128):
            part = b.slice(a, 128)
            yield part, part.column(part.num_columns - 1).to_pylist()


def _first_pass(batches, width: int, seed: int):
    """(key, n, d1, d2) of every document; then this task's counters, in slices."""
    hashes, seen = _Hashes(seed), set()
    counters = np.zeros(1 << COUNTER_BITS, np.int64)
    empty = pa.nulls
    for part, texts in _texts(batches):
        n, d1, d2, bits, new = [], [], [], [], []
        for t in texts:
            s = shingles(t, width, hashes)
            x, y = names(s) if len(s) else (None, None)
            n.append(len(s))
            d1.append(x)
            d2.append(y)
            bits.append(None if x is None else parity(s))
            if x is not None and x not in seen:
                seen.add(x)
                new.append((s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64))
        if new:
            counters += np.bincount(np.concatenate(new), minlength=len(counters))
        m = len(texts)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bits, pa.list_(pa.int64())), empty(m, pa.int32()), empty(m, pa.binary())], names=["key", "n", "d1", "d2", "bits", "slice", "counts"])
        key_type = part.column(0).type
    if counters.any():
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        rows = [z.compress(x.astype("<u8").tobytes()) for x in np.split(counters, SLICES)]
        yield pa.RecordBatch.from_arrays([empty(SLICES, key_type), *(empty(SLICES, pa.int64()) for _ in range(3)), empty(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array(rows, pa.binary())], names=["key", "n", "d1", "d2", "bits", "slice", "counts"])


def _slices_of(batches):
    """Sums of the counters of a task's slices: at most ``SLICES`` rows."""
    import zstandard

    z, sums = zstandard.ZstdDecompressor(), {}
    for b in batches:
        for i, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(z.decompress(c.as_py()), "<u8").astype(np.int64)
            sums[i] = sums[i] + x if i in sums else x
    c = zstandard.ZstdCompressor(level=3)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([c.compress(x.astype("<u8").tobytes()) for x in sums.values()], pa.binary())], names=["slice", "counts"])


def _signature_pass(batches, width: int, seed: int, counts: np.ndarray, limit: float, num: int, den: int):
    hashes, seen = _Hashes(seed), set()
    starts = bands(num, den, 1 << 40)
    for _, texts in _texts(batches):
        sig, at, ids, sizes = [], [], [], []
        for t in texts:
            s = shingles(t, width, hashes)
            if not len(s):
                continue
            d = names(s)[0]
            if d in seen:
                continue
            seen.add(d)
            x, y = signatures(s, counts, limit, starts, num, den)
            sig.append(x)
            at.append(y)
            ids.append(np.full(len(x), d, np.int64))
            sizes.append(np.full(len(x), len(s), np.int32))
        if sig:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, ids, sizes, at)], names=["sig", "id", "n", "at"])


def _set_pass(batches, width: int, seed: int):
    hashes, seen = _Hashes(seed), set()
    for _, texts in _texts(batches):
        ids, sets = [], []
        for t in texts:
            s = shingles(t, width, hashes)
            d = names(s)[0] if len(s) else None
            if d is not None and d not in seen:
                seen.add(d)
                ids.append(d)
                sets.append(s.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "tokens"])


def linked(a: int, b: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (a + b - both)


def forest(sets: list[np.ndarray], left: np.ndarray, label: np.ndarray, num: int, den: int, across: bool) -> list[tuple[int, int]]:
    """Edges that join the components of a block's sets; ``across`` compares left with right members only."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), n)
    _, col, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[col] > 1
    rows, col = rows[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(col, kind="stable")
    rows, col = rows[by], col[by]
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        x, y = np.searchsorted(col, [a, a + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[rows[x:y], col[x:y] - a] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    ok = den * both >= num * (n[:, None] + n[None, :] - both)
    ok &= label[:, None] != label[None, :]
    if across:
        ok &= left[:, None] != left[None, :]
    parent = {int(x): int(x) for x in label}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        x, y = root(int(label[i])), root(int(label[j]))
        if x != y:
            parent[x] = y
            edges.append((int(i), int(j)))
    return edges


def _block_edges(table: pa.Table, num: int, den: int, across: bool) -> pa.Table:
    table = table.combine_chunks()
    ids = table.column("id").to_numpy()
    tokens = table.column("tokens").chunk(0) if table.num_rows else []
    flat, off = tokens.flatten().to_numpy(), tokens.offsets.to_numpy()
    off = off - off[0]
    sets = [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    edges = forest(sets, np.array(table.column("side").to_pylist()), table.column("label").to_numpy(), num, den, across)
    return pa.table([pa.array([int(ids[i]) for i, _ in edges], pa.int64()), pa.array([int(ids[j]) for _, j in edges], pa.int64())], names=["a", "b"])


def _block_candidates(table: pa.Table, num: int, den: int, across: bool) -> pa.Table:
    """The rows of a block that have a partner of another label which sizes and parity maps allow."""
    table = table.combine_chunks()
    n, label = table.column("n").to_numpy(), table.column("label").to_numpy()
    maps = table.column("bits").combine_chunks()
    flat, off = maps.flatten().to_numpy(), maps.offsets.to_numpy()
    off = off - off[0]
    least = int(np.diff(off).min())
    bits = np.stack([np.bitwise_xor.reduce(flat[a:b].reshape(-1, least), axis=0) for a, b in zip(off[:-1], off[1:], strict=True)])
    odd = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)
    each = odd.sum(axis=1)
    differ = each[:, None] + each[None, :] - 2 * (odd @ odd.T)
    total = n[:, None] + n[None, :]
    ok = differ <= total - 2 * -(-num * total // (num + den)) + 0.5
    ok &= den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :])
    ok &= label[:, None] != label[None, :]
    if across:
        side = np.array(table.column("side").to_pylist())
        ok &= side[:, None] != side[None, :]
    return table.select(["block", "id", "label", "side"]).filter(pa.array(ok.any(axis=1)))


def _candidates_of(num: int, den: int, across: bool):
    return lambda table: _block_candidates(table, num, den, across)


def _edges_of(num: int, den: int, across: bool):
    return lambda table: _block_edges(table, num, den, across)


def components(links: DataFrame) -> DataFrame:
    """(id, label) of the nodes of an edge table (a, b); the label is the component's smallest node.

    Large-star and small-star steps, by joins: no node's neighbours meet in one row.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")

    def mark(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = stored(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        new = stored(small, "links")
        forget(large, edges)
        edges, then = new, now
        now = mark(edges)
        if now == then:
            break
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots.select("id", F.col("id").alias("label")))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """key, n_shingles (long) and component_id (the smallest key reachable by links) of every document.

    Two documents link when den * intersection >= num * union.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    key_type = plain.schema[0].dataType.simpleString()
    for seed in range(100):
        first = stored(plain.mapInArrow(lambda it, seed=seed: tidied(_first_pass(it, width, seed)), f"key {key_type}, n long, d1 long, d2 long, bits array<long>, slice int, counts binary"), "ngram-docs")
        rows = first.filter("slice is null").select("key", "n", "d1", "d2", "bits")
        # equal sets: one node
        nodes = stored(rows.filter("n > 0").groupBy("d1").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"), (F.min("d2") != F.max("d2")).alias("twice"), F.first("bits").alias("bits")), "ngram-nodes")
        if not nodes.filter("twice").limit(1).count():
            break
        forget(first, nodes)
    # slices of the counters are summed in two steps, as many tasks may have some
    part = first.filter("slice is not null").select("slice", "counts").mapInArrow(_slices_of, "slice int, counts binary").repartition(min(SLICES, 8), "slice").mapInArrow(_slices_of, "slice int, counts binary")
    import zstandard

    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    wide = len(counts) // SLICES
    for r in part.collect():
        counts[r.slice * wide : (r.slice + 1) * wide] += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.counts)), "<u8").astype(np.int64)
    mean = float(counts.mean())
    limit = mean + 8 * math.sqrt(mean) + FREQUENT
    shared = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))
    sigs = stored(plain.select("text").mapInArrow(lambda it: tidied(_signature_pass(it, width, seed, shared.value, limit, num, den)), "bucket long, id long, n int, at int"), "ngram-signatures")

    def fit_sizes(n, m, room):
        """Whether sets of sizes n and m can link if they share at most ``room``."""
        return (F.lit(den) * F.least(n, m) >= F.lit(num) * F.greatest(n, m)) & (room >= F.ceil(F.lit(num) * (n + m) / F.lit(num + den) - 1e-6))

    n0, n1, room = F.min("n").alias("n0"), F.max("n").alias("n1"), F.min(F.col("n") - F.col("at")).alias("room")
    two = fit_sizes(F.col("n0"), F.col("n1"), F.col("room"))
    # a bucket of two rows is decided here, as most that share a token by chance can't link
    several = stored(sigs.groupBy("bucket").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("c"), n0, n1, room).filter((F.col("x") != F.col("y")) & ((F.col("c") > 2) | two)).select(F.col("bucket").alias("s")), "ngram-shared")
    size = filter_size(several.count())
    words = stored(filter_words(several, "s", size=size), "ngram-filter")
    maybe = maybe_in(sigs, words, "m", "bucket", size=size).filter("m").drop("m")
    members = maybe.join(several, F.col("bucket") == F.col("s"), "left_semi")
    members = stored(members.groupBy("bucket", "id").agg(F.min("n").alias("n"), F.min("at").alias("at")), "ngram-members")
    forget(sigs, several)
    hubs = members.groupBy("bucket").agg(F.min(F.struct("at", "id", "n")).alias("hub"), F.count("*").alias("g")).filter("g > 1").select(F.col("bucket").alias("k"), F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at"), "g")
    hubs = stored(hubs, "ngram-hubs")
    fits = fit_sizes(F.col("n"), F.col("hub_n"), F.least(F.col("n") - F.col("at"), F.col("hub_n") - F.col("hub_at")))
    pairs = members.join(hubs, F.col("bucket") == F.col("k")).filter((F.col("id") != F.col("hub")) & fits).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    # the hub meets all; buckets of two are done; two others are a pair more; of the rest, those that no other can meet go
    rest = members.join(hubs.filter("g > 2").select("k", "hub"), F.col("bucket") == F.col("k")).filter(F.col("id") != F.col("hub")).select("bucket", "id", "n", "at")
    rest = stored(rest, "ngram-rest")
    span = stored(rest.groupBy("bucket").agg(n0, n1, room, F.count("*").alias("c"), F.min("id").alias("x"), F.max("id").alias("y")).withColumnRenamed("bucket", "k"), "ngram-spans")
    more = span.filter((F.col("c") == 2) & two).select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = pairs.unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    top = F.least(F.col("n") * (den / num), (F.col("n") - F.col("at")) * ((num + den) / num) - F.col("n")) + 1e-6
    others = rest.withColumn("lo", F.col("n") * (num / den) - 1e-6).withColumn("hi", top).join(span.filter("c > 2").select("k", "n0", "n1"), F.col("bucket") == F.col("k"))
    others = stored(others.filter("hi >= n0 and lo <= n1").select("bucket", "id", "n"), "ngram-others")
    # a bound from parity maps, so that most pairs never need their sets
    na, nb = (nodes.select(F.col("d1").alias(f"i{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"p{x}")) for x in "ab")
    differ = parity_difference(F.col("pa"), F.col("pb"))
    most = F.col("na") + F.col("nb") - 2 * F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den) - 1e-6)
    pairs = stored(pairs.join(nb, F.col("b") == F.col("ib")).join(na, F.col("a") == F.col("ia")).filter(differ <= most).select("a", "b"), "ngram-pairs")

    def sets_of(ids: DataFrame) -> DataFrame:
        """Token sets of these nodes, from their smallest keys' texts; a few more may come, or come twice."""
        least = stored(ids.join(nodes.select(F.col("d1").alias("d"), "least"), F.col("id") == F.col("d")).select("least"), "ngram-least")
        size = filter_size(least.count())
        few = stored(filter_words(least, "least", size=size), "ngram-filter")
        forget(least)
        chosen = maybe_in(plain, few, "m", "key", size=size).filter("m or key is null").select("text")
        return stored(chosen.mapInArrow(lambda it: tidied(_set_pass(it, width, seed)), "id long, tokens array<long>"), "ngram-sets")

    sets = sets_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    ta, tb = sets.select(F.col("id").alias("ia"), F.col("tokens").alias("ta")), sets.select(F.col("id").alias("ib"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    near = pairs.join(tb, F.col("b") == F.col("ib")).join(ta, F.col("a") == F.col("ia")).withColumn("both", both).filter(F.lit(den) * F.col("both") >= F.lit(num) * (F.size("ta") + F.size("tb") - F.col("both")))
    links = stored(near.select("a", "b").distinct(), "ngram-links")
    forget(sets, pairs)
    forget(members, hubs, rest, span)
    for across in (False, True):
        label = components(links)
        named = others.join(label.select(F.col("id").alias("l"), "label"), F.col("id") == F.col("l"), "left").select("bucket", "id", "n", F.coalesce("label", "id").alias("label"))
        named = stored(named, "ngram-labels")
        # one of the buckets with equal members stands for all of them
        open_ = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("g"), F.sum("n").alias("t"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("f1"), F.sum(F.hash("id").cast("long")).alias("f2")).filter("lo != hi")
        open_ = open_.groupBy("f1", "f2", "g").agg(F.min("bucket").alias("k"), F.first("t").alias("t")).withColumn("m", F.greatest(F.ceil(F.col("g") / BLOCK_SETS), F.ceil(F.col("t") / BLOCK_TOKENS)).cast("int"))
        open_ = stored(open_.filter("m > 1").select("k", "m") if across else open_.select("k", "m"), "ngram-open")
        placed = named.join(open_, F.col("bucket") == F.col("k")).withColumn("c", F.pmod(F.xxhash64("id", F.lit(7)), F.col("m")).cast("int"))
        if not across:
            placed = placed.withColumn("block", F.xxhash64("bucket", "c")).withColumn("side", F.lit(True))
        else:
            other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
            placed = placed.withColumn("o", other).filter("o != c").withColumn("block", F.xxhash64("bucket", F.least("c", "o"), F.greatest("c", "o"))).withColumn("side", F.col("c") < F.col("o"))
        # parity maps first: sets move only for those that may link within their block
        mapped = placed.select("block", "id", "n", "label", "side").join(nodes.select(F.col("d1").alias("i"), "bits"), F.col("id") == F.col("i")).drop("i")
        some = stored(mapped.groupBy("block").applyInArrow(_candidates_of(num, den, across), "block long, id long, label long, side boolean"), "ngram-candidates")
        sets = sets_of(some.select("id").distinct())
        filled = some.join(sets.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).select("block", "id", "label", "side", "tokens")
        more = filled.groupBy("block").applyInArrow(_edges_of(num, den, across), "a long, b long")
        links = stored(links.unionByName(more).distinct(), "ngram-links")
        forget(named, some, sets)
    forget(others)
    label = components(links)
    least = nodes.select(F.col("d1").alias("d"), "least", "copies")
    full = least.join(label, F.col("d") == F.col("id"), "left").withColumn("label", F.coalesce("label", "d"))
    # nodes that are alone and single need no lookup
    groups = full.filter("id is not null").groupBy("label").agg(F.min("least").alias("c")).select(F.col("label").alias("g"), "c")
    lookup = full.filter("id is not null or copies > 1").join(groups, F.col("label") == F.col("g"), "left").select("d", F.coalesce("c", "least").alias("c"))
    lookup = stored(lookup, "ngram-lookup")
    some = rows.filter("n > 0").join(lookup, F.col("d1") == F.col("d"), "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("d").isNull(), F.col("key")).otherwise(F.col("c")).alias("component_id"))
    none = rows.filter("n = 0").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))
    return some.unionByName(none)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest key, a null one last.

    Every row is told by a stored id, so rows with a null key and rows that share one are told apart.
    """
    names_ = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names_)))
    rows = stored(plain.withColumn("row", F.monotonically_increasing_id()), "ngram-rows")
    k, t = (F.col(f"c{names_.index(c)}") for c in (key, text))
    own = F.struct(k.isNull().alias("none"), k.alias("key"), F.col("row"))
    found = jaccard_components(rows.select(own.alias("own"), t.alias("text")), "own", "text", width, num, den)
    gone = stored(found.filter("component_id != own").select(F.col("own.row").alias("gone")), "ngram-gone")
    size = filter_size(gone.count())
    words = stored(filter_words(gone, "gone", size=size), "ngram-filter")
    flagged = maybe_in(rows, words, "m", "row", size=size)
    as_given = [F.col(f"c{i}").alias(c) for i, c in enumerate(names_)]
    sure = flagged.filter("not m").select(*as_given)
    rest = flagged.filter("m").join(gone, F.col("row") == F.col("gone"), "left_anti").select(*as_given)
    return sure.unionByName(rest)


#: Shingles, links and components in SQL, for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(a) < 3 THEN array_to_string(a, ' ') ELSE a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] END AS g FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 1, 2))) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(c.b) AS component_id FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
