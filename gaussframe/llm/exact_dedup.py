"""Exact dedup by progressive refinement, in DataFrame functions only.

One scan writes a narrow row a text: length and prefix hash of the normalised text (and its full hash,
where the caller wants that of every text anyway).  On these rows:
1. Group by length; lengths that occur once are done.
2. Of the rest, group by length and the hash of the first ``PREFIX`` characters.
3. Only rows whose prefix group has company are grouped by the full hash.
``keep_one`` and ``exact_groups`` without digests take the full hash in a second scan, of surviving
texts only; these are told by length and beginning as they stand, in a membership filter
(common.filter_words) whose size follows the number of survivors up to a bound.  It may let a row pass
that is alone, never the reverse, and the full hash decides.  Groups are formed by counts and minima with map-side combination, so a group of
any size is a row a task; joins are with one row a group, so a hot group's rows can be split.

Equal means: identical after replacing each run of space and bytes 9 to 13 by one space.  Null texts
count as empty.  Of equal texts the row with the smallest key stays, null keys last; of rows that
repeat with text and key, one stays.  Extra columns of any name stay.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_size, filter_words, forget, maybe_in, stored

#: Characters that the prefix hash reads.
PREFIX = 256

# every run but a lone space, which stands for itself
_RUNS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def _full(text: str) -> Column:
    return F.unhex(F.sha2(normalised(F.col(text)), 256))


def _raw(text: str) -> Column:
    """A name of a text from its length and beginning as they stand, which is cheap to take again."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.xxhash64(F.octet_length(t), F.substring(t, 1, PREFIX))


def _narrow(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """Length and prefix hash of the normalised text, and ``more``."""
    norm = docs.withColumn("__norm", normalised(F.col(text)))
    return norm.select(F.length("__norm").alias("__len"), F.xxhash64(F.substring("__norm", 1, PREFIX)).alias("__prefix"), *more)


def _survivors(rows: DataFrame) -> DataFrame:
    """Steps 1 and 2 on stored narrow rows: those whose prefix group has company."""
    lens = rows.groupBy("__len").count().filter("count > 1").select(F.col("__len").alias("l"))
    some = rows.join(lens, F.col("__len") == F.col("l"), "left_semi")
    pairs = some.groupBy(F.col("__len").alias("l"), F.col("__prefix").alias("p")).count().filter("count > 1").select("l", "p")
    # stored, so that the join may split a hot group's rows
    pairs = stored(pairs, "dedup-prefixes")
    return rows.join(pairs, (F.col("__len") == F.col("l")) & (F.col("__prefix") == F.col("p")), "left_semi")


def _refined(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __dup: whether the text's prefix group may have company; no text is normalised for it again."""
    rows = stored(_narrow(docs.select(text), text, _raw(text).alias("__raw")), "dedup-rows")
    raw = stored(_survivors(rows).select("__raw").distinct(), "dedup-survivors")
    size = filter_size(raw.count())
    words = stored(filter_words(raw, "__raw", size=size), "dedup-filter")
    forget(rows, raw)
    marked = docs.withColumn("__raw", _raw(text))
    return maybe_in(marked, words, "__dup", "__raw", size=size).drop("__raw")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """One row a document: key, keep_id, group_size (long), kept (boolean).

    ``digests`` adds text_sha256 of every normalised text, for which every text is hashed in the first scan.
    """
    plain = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    if digests:
        rows = stored(_narrow(plain, "__text", F.col("__key"), F.unhex(F.sha2("__norm", 256)).alias("__sha"), F.monotonically_increasing_id().alias("__rid")), "dedup-rows")
        some = _survivors(rows)
    else:
        hashed = F.when(F.col("__dup"), _full("__text")).alias("__sha")
        rows = stored(_refined(plain, "__text").select("__key", hashed, F.monotonically_increasing_id().alias("__rid")), "dedup-rows")
        some = rows.filter("__sha is not null")
    groups = (
        some.groupBy("__sha")
        .agg(F.min(F.struct(F.col("__key").isNull(), F.col("__key"), F.col("__rid"))).alias("m"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("__sha").alias("__g"), F.col("m.__key").alias("__keep"), F.col("m.__rid").alias("__keep_rid"), "n")
    )
    # stored, so that the join may split the hot group's side
    groups = stored(groups, "dedup-groups")
    joined = rows.filter("__sha is not null").join(groups, F.col("__sha") == F.col("__g"), "left")
    found = joined.select(
        F.col("__key").alias(key),
        F.when(F.col("n").isNull(), F.col("__key")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("__rid") == F.col("__keep_rid"), F.lit(True)).alias("kept"),
        *[F.lower(F.hex("__sha")).alias("text_sha256")] * digests,
    )
    if digests:
        return found
    alone = rows.filter("__sha is null").select(F.col("__key").alias(key), F.col("__key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(found)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Rows that may have company are reduced to one a group by a minimum, combined before the shuffle.
    """
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    k, t = f"c{names.index(key)}", f"c{names.index(text)}"
    second = _refined(plain, t)
    row = F.struct(*plain.columns)
    rest = F.to_json(F.struct(*(c for c in plain.columns if c != t)))
    best = second.filter("__dup").groupBy(_full(t).alias("__sha")).agg(F.min_by(row, F.struct(F.col(k).isNull(), F.col(k), rest)).alias("row"))
    out = second.filter("not __dup").select(*plain.columns).unionByName(best.select("row.*"))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


ORACLE = """
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

