"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that list them), so overlapping
sources are one flow problem: words run from patterns, once or repeated at convex costs, to the
quotas of the sources that list them.  The flow gives each pattern a number of words; whole passes
over the pattern come first, and the rest is met by a cut in the order of a seeded hash.

Up to ``MAX_PATTERNS`` patterns, their totals reach the driver, which solves the flow a connected group
of patterns and sources at a time.  With more, patterns of one source each are planned where they are:
their flow has no choice (a source's words are its quota, at most ``copies`` times its size), so quotas
come from a few sums over the table of sources and no row of it is collected; the results are the
same.  More than ``MAX_PATTERNS`` patterns that overlap raise ValueError.

A cut is found from sums over hash bins of a pattern, then of one of these bins, then the rows of one
of those (a 2**24th of the pattern), never from a sort of a source.  Documents are taken whole: a
pattern's words come as near its flow as its best document after the cut allows.

Defined results: null texts have size 0 and are taken 0 times; a null source is a source of its own,
last in order; equal keys share their hash, so rows that repeat are taken alike; no rows, no result;
other columns stay, and a column named as one that ``mix`` adds raises ValueError.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Patterns whose totals the driver may hold, and rows that may be broadcast.
MAX_PATTERNS = 100_000
#: Bits below which a hash (of 60 bits) is cut off, a level of bins after the other.
LEVELS = (48, 36)
SEED = 20240
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
_RUNS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words: spaces of the normalised text and one."""
    t = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " "))
    return F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def capped_shares(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess goes to the others by weight."""
    out: list[float] = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = cap * sizes[i]
        # the others share what the capped ones leave
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def standard_quotas(sizes: dict) -> dict:
    """Weights 5, 2, 1, repeating by code point, null last; 150 % of all words; at most twice a source's size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    shares = capped_shares([sizes[s] for s in names], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))], SHARE * sum(sizes.values()), CAP)
    return dict(zip(names, shares, strict=True))


class Flow:
    """Min-cost flow where only the arcs out of the start cost anything: capacity is added in order of cost.

    An augmenting path leaves the start once and never takes flow back from there, so the words that
    cheaper arcs carry stay when dearer ones open; each level is a maximum flow by blocking flows.
    """

    def __init__(self, n: int):
        self.arcs: list[list[int]] = []  # to, capacity left
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, capacity: int) -> int:
        k = len(self.arcs)
        self.arcs += [[b, capacity], [a, 0]]
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def levels(self, start: int) -> dict[int, int]:
        level, todo = {start: 0}, deque([start])
        while todo:
            a = todo.popleft()
            for k in self.out[a]:
                b, left = self.arcs[k]
                if left > 0 and b not in level:
                    level[b] = level[a] + 1
                    todo.append(b)
        return level

    def run(self, start: int, end: int) -> None:
        while end in (level := self.levels(start)):
            nxt = [0] * len(self.out)
            path: list[int] = []
            a = start
            while True:
                if a == end:
                    room = min(self.arcs[k][1] for k in path)
                    for k in path:
                        self.arcs[k][1] -= room
                        self.arcs[k ^ 1][1] += room
                    path, a = [], start
                    continue
                while nxt[a] < len(self.out[a]):
                    b, left = self.arcs[self.out[a][nxt[a]]]
                    if left > 0 and level.get(b, -1) == level[a] + 1:
                        break
                    nxt[a] += 1
                if nxt[a] < len(self.out[a]):
                    path.append(self.out[a][nxt[a]])
                    a = self.arcs[path[-1]][0]
                elif path:
                    a = self.arcs[path.pop() ^ 1][0]
                    nxt[a] += 1
                else:
                    break


def _groups(patterns: Sequence[tuple[Sequence[int], int]]) -> list[list[int]]:
    """Patterns that share sources, directly or by others."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for members, _ in patterns:
        for s in members[1:]:
            parent[root(s)] = root(members[0])
    found: dict[int, list[int]] = {}
    for p, (members, _) in enumerate(patterns):
        if members:
            found.setdefault(root(members[0]), []).append(p)
    return list(found.values())


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[float], copies: int = 2) -> list[int]:
    """Words that each pattern (its sources, its size) gives; the r-th copy of a word costs r - 1 squared."""
    given = [0] * len(patterns)
    for group in _groups(patterns):
        sources = {s: i for i, s in enumerate(sorted({s for p in group for s in patterns[p][0]}), len(group))}
        start, end = len(group) + len(sources), len(group) + len(sources) + 1
        flow = Flow(end + 1)
        into = []
        for i, p in enumerate(group):
            members, size = patterns[p]
            into.append(flow.arc(start, i, 0))
            for s in members:
                flow.arc(i, sources[s], int(size) * copies)
        for s, i in sources.items():
            flow.arc(i, end, round(quotas[s]))
        for _ in range(copies):  # in order of their costs
            for k, p in zip(into, group, strict=True):
                flow.arcs[k][1] += int(patterns[p][1])
            flow.run(start, end)
        for k, p in zip(into, group, strict=True):
            given[p] = flow.arcs[k ^ 1][1]
    return given


_PLAN = {"p": pa.string(), "whole": pa.int32(), "rest": pa.int64(), "source_size": pa.int64(), "target": pa.float64()}


def _passes(words: int, n: int, copies: int) -> tuple[int, int]:
    whole = min(copies, words // n) if n else 0
    return whole, words - whole * n if whole < copies else 0


def _driver_plan(spark, found: list, quotas: Callable[[dict], dict], copies: int) -> DataFrame:
    sizes: dict = {}
    for r in found:
        for s in r.members:
            sizes[s] = sizes.get(s, 0) + r.n
    targets = quotas(sizes)
    at = {s: i for i, s in enumerate(sizes)}
    given = route([([at[s] for s in r.members], r.n) for r in found], [targets[s] for s in sizes], copies)
    rows = []
    for r, words in zip(found, given, strict=True):
        first = r.members[0] if r.members else None
        rows.append((r.pattern, *_passes(words, r.n, copies), int(sizes.get(first, 0)), float(targets.get(first, 0.0))))
    # as an Arrow table, which no Python worker has to read
    columns = list(zip(*rows, strict=True)) or [()] * len(_PLAN)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, _PLAN.values(), strict=True)], names=list(_PLAN)))


def _spread_plan(totals: DataFrame, copies: int) -> DataFrame:
    """The plan of single sources under the standard quotas, without collecting them."""
    one = totals.select("pattern", "n", F.col("members")[0].alias("s"))
    order = [F.col("s").isNull(), F.col("s")]
    dealt = one.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "mix-order")
    # a row a partition
    starts = dealt.groupBy("part").count().withColumn("start", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select(F.col("part").alias("q"), "start")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((F.col("start") + F.col("i")) % len(WEIGHTS) + 1).cast("int"))
    weighed = stored(dealt.join(F.broadcast(starts), F.col("part") == F.col("q")).select("pattern", "n", weight.alias("w")), "mix-weights")
    total = SHARE * float(weighed.agg(F.sum("n")).first()[0])
    level, capped = 0.0, -1
    while True:  # the level rises until no more sources are capped
        over = F.col("w") * level > CAP * F.col("n")
        r = weighed.agg(F.count(F.when(over, 1)).alias("k"), F.sum(F.when(over, CAP * F.col("n")).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if r.k == capped or not r.w:
            break
        level, capped = (total - r.held) / r.w, r.k
    target = F.least(F.col("w") * level, CAP * F.col("n"))
    words = F.least(F.rint(target).cast("long"), copies * F.col("n"))
    whole = F.when(F.col("n") > 0, F.least(F.lit(copies), F.floor(words / F.col("n")))).otherwise(0).cast("int")
    rest = F.when(whole < copies, words - whole * F.col("n")).otherwise(0).cast("long")
    return weighed.select(F.col("pattern").alias("p"), whole.alias("whole"), rest.alias("rest"), F.col("n").alias("source_size"), target.alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if it has few rows, else joined as the planner sees fit."""
    return F.broadcast(df) if rows <= MAX_PATTERNS else df


def _names(docs: DataFrame, members: Column | None, source: str, key: str, seed: int) -> tuple[Column, Column, Column]:
    """The pattern as an array, its name (which tells null from any text), and the hash that orders documents."""
    pattern = F.array_sort(F.array_distinct(members)) if members is not None else F.array(F.col(f"`{source}`").cast("string"))
    return pattern, F.to_json(F.struct(pattern.alias("p")), {"ignoreNullFields": "false"}), F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{key}`").cast("string"))), 1, 15), 16, 10).cast("long")


def _planned(docs: DataFrame, quotas, members: Column | None, source: str, key: str, size: Column | None, text: str, copies: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows (key, pattern, h, size) of all documents, and the plan a pattern with its cut."""
    spark = docs.sparkSession
    pattern, named, h = _names(docs, members, source, key, seed)
    n = F.coalesce(size if size is not None else n_words(F.col(f"`{text}`")), F.lit(0)).cast("long")
    narrow = stored(docs.select(F.col(f"`{key}`").alias("key"), pattern.alias("members"), named.alias("pattern"), h.alias("h"), n.alias("size")), "mix-sizes")
    totals = stored(narrow.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("n")), "mix-totals")
    many = totals.count()
    if many <= MAX_PATTERNS:
        plan = _driver_plan(spark, totals.collect(), quotas, copies)
    elif members is None and quotas is standard_quotas:
        plan = _spread_plan(totals, copies)
    else:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns that overlap, or with own quotas")
    plan = stored(plan, "mix-plan")
    # the bin in which each pattern's rest ends, then the bin of that bin
    rows, prior = narrow.select("pattern", "h", "size"), None
    ends = plan.filter("rest > 0").select("p", "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bin"))
    for bits in LEVELS:
        same = F.col("pattern") == F.col("p")
        if prior is not None:
            same = same & (F.shiftright("h", prior) == F.col("bin"))
        own = rows.join(_small(ends, many), same).withColumn("new", F.shiftright("h", bits))
        sums = own.groupBy("p", "rest", "before", "new").agg(F.sum("size").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("new"))
        cut = sums.withColumn("upto", upto).filter("upto >= rest and upto - n < rest")
        ends = stored(cut.select("p", "rest", (F.col("upto") - F.col("n")).alias("before"), F.col("new").alias("bin")), "mix-ends")
        prior = bits
    own = rows.join(_small(ends, many), (F.col("pattern") == F.col("p")) & (F.shiftright("h", prior) == F.col("bin")))
    # equal hashes go together
    byhash = own.groupBy("p", "rest", "before", "h").agg(F.sum("size").alias("n"))
    run = F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("h"))
    last = byhash.withColumn("run", run).filter("run <= rest").groupBy("p").agg(F.max("h").alias("last"), F.max("run").alias("got"))
    ends = ends.join(last, "p", "left").select("p", F.shiftleft("bin", prior).alias("start"), "last", (F.col("rest") - F.coalesce("got", "before")).alias("gap"))
    ends = stored(ends, "mix-ends")
    # the document beyond the cut whose size comes closest to what is left, if that beats leaving it
    off = F.abs(F.col("size") - F.col("gap"))
    beyond = rows.join(_small(ends.filter("gap > 0"), many), F.col("pattern") == F.col("p")).filter(~_before() & (off < F.col("gap")))
    more = beyond.groupBy("p").agg(F.min_by("h", F.struct(off, "h")).alias("more"))
    cuts = stored(plan.join(ends.join(more, "p", "left"), "p", "left").select("p", "whole", "source_size", "target", "start", "last", "more"), "mix-cuts")
    return narrow, _small(cuts, many)


def _before() -> Column:
    return (F.col("h") < F.col("start")) | F.coalesce(F.col("h") <= F.col("last"), F.lit(False))


def _copies() -> Column:
    extra = F.when(F.col("start").isNull(), 0).when(_before(), 1).when(F.col("h") == F.col("more"), 1).otherwise(0)
    return F.coalesce(F.col("whole") + extra, F.lit(0)).cast("int")


def mix_table(docs: DataFrame, quotas=standard_quotas, members: Column | None = None, source: str = "source", key: str = "doc_id", size: Column | None = None, text: str = "text", copies: int = 2, seed: int = SEED) -> DataFrame:
    """key, size, source_size and target (of the pattern's first source) and copies of every document; texts are read once."""
    narrow, cuts = _planned(docs, quotas, members, source, key, size, text, copies, seed)
    out = narrow.join(cuts, F.col("pattern") == F.col("p"), "left")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", _copies().alias("copies"))


def mix(docs: DataFrame, quotas=standard_quotas, members: Column | None = None, source: str = "source", key: str = "doc_id", size: Column | None = None, text: str = "text", copies: int = 2, seed: int = SEED, out: str = "copies") -> DataFrame:
    """``docs`` with ``out``, how often the mix takes the document.

    ``members`` is an array of the sources that list a document (by default the one in ``source``).
    ``quotas(sizes)`` gives target words from a dict of source sizes, in which a document counts for
    each of its sources.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out} already")
    _, cuts = _planned(docs, quotas, members, source, key, size, text, copies, seed)
    _, named, h = _names(docs, members, source, key, seed)
    row = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"), named.alias("pattern"), h.alias("h"))
    taken = row.join(cuts, F.col("pattern") == F.col("p"), "left")
    return taken.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)), _copies().alias(out))


#: The whole mix of single sources under the standard quotas.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(concat_ws(':', '20240', doc_id)), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS level
UNION ALL SELECT i + 1, (1.5 * (SELECT sum(n) FROM s) - coalesce((SELECT sum(2.0 * n) FROM s WHERE w * level > 2.0 * n), 0)) / (SELECT sum(w) FROM s WHERE w * level <= 2.0 * n) FROM f WHERE i < 40 AND (SELECT count(*) FROM s WHERE w * level <= 2.0 * n) > 0),
t AS (SELECT source, n, least(w * (SELECT max(level) FROM f), 2.0 * n) AS target, least(CAST(round_even(least(w * (SELECT max(level) FROM f), 2.0 * n), 0) AS BIGINT), 2 * n) AS words FROM s),
u AS (SELECT *, CASE WHEN n > 0 THEN least(2, words // n) ELSE 0 END AS whole, CASE WHEN n > 0 AND words // n < 2 THEN words % n ELSE 0 END AS rest FROM t),
r AS (SELECT doc_id, d.source, size, h, n, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id) AS run FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
g AS (SELECT *, rest - coalesce(max(run) FILTER (run <= rest) OVER (PARTITION BY source), 0) AS gap FROM r),
m AS (SELECT source, arg_min(doc_id, (abs(size - gap), h)) AS more FROM g WHERE gap > 0 AND run > rest AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(target, 6) AS target, CAST((whole + CASE WHEN run <= rest OR doc_id = more THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM g LEFT JOIN m ON g.source IS NOT DISTINCT FROM m.source
"""
