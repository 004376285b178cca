"""Shared plumbing: reading tables, shared storage, shipping code, bounded membership filters."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the bytes 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Least and most words of 64 bits of a membership filter: 1 MB to 16 MB of bits.
FILTER_WORDS, MOST_FILTER_WORDS = 1 << 17, 1 << 21

#: Bytes of text that Arrow hands to a Python worker at once.
BATCH_BYTES = 2 << 20

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (once per application) and bound the session's Arrow batches.

    The bound stays set, as a plan takes it when it runs, after the operator has returned.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        # the driver serves this file for as long as the application lives
        path = os.path.join(tempfile.mkdtemp(prefix="gaussframe-code-"), "gaussframe_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(Path(root.name) / f.relative_to(root)))
        spark.sparkContext.addPyFile(path)
        atexit.register(shutil.rmtree, os.path.dirname(path), True)
        _shipped.add(app)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key))
    except Exception:  # a release without this setting, or one that spells its value with a unit
        now = 1 << 62
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where the session names none and runs on this machine alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        own = tempfile.mkdtemp(prefix="gaussframe-")
        atexit.register(shutil.rmtree, own, True)
        _own_dir[app] = "file://" + own
    return _own_dir[app]


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores until they clash with none that is taken (in any case)."""
    low = {c.lower() for c in taken}
    out = []
    for w in wanted:
        while w.lower() in low:
            w += "_"
        low.add(w.lower())
        out.append(w)
    return out


def trim() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(rows: Iterator) -> Iterator:
    """Rows of a worker's task; its freed memory goes back to the system at the end, as workers live on."""
    try:
        yield from rows
    finally:
        trim()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in dfs:
        path = getattr(df, "stored_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def filter_size(keys: int) -> int:
    """Words of a filter with eight bits or more a key, up to the bound; a fuller filter only lets more others pass."""
    return min(MOST_FILTER_WORDS, max(FILTER_WORDS, 1 << max(0, keys // 8 - 1).bit_length()))


def filter_words(keys: DataFrame, *cols: str, size: int = FILTER_WORDS) -> DataFrame:
    """A lossy set of the given keys as at most ``size`` rows (word, bits).

    ``size`` has a bound whatever the number of keys, so the rows may be broadcast at any scale.  It
    never misses a key that is in the set.
    """
    return (
        keys.select(F.xxhash64(*cols).alias("h"))
        .selectExpr(f"pmod(shiftrightunsigned(h, 6), {size}) as word", "shiftleft(1L, cast(h & 63 as int)) as bit")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )


def maybe_in(df: DataFrame, words: DataFrame, flag: str, *cols: Column | str, size: int = FILTER_WORDS) -> DataFrame:
    """Add the boolean ``flag``: false means that the key is surely not in the set."""
    h, word, bits = free_names([*df.columns, flag], "__h", "__word", "__bits")
    w = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    return (
        df.withColumn(h, F.xxhash64(*cols))
        .join(F.broadcast(w), F.pmod(F.shiftrightunsigned(h, 6), F.lit(size)) == F.col(word), "left")
        .withColumn(flag, F.coalesce(F.expr(f"shiftrightunsigned(`{bits}`, cast(`{h}` & 63 as int)) & 1") == 1, F.lit(False)))
        .drop(h, word, bits)
    )
