"""A corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
reads again as the next stage's docs.  All but the last return the columns of documents.
Null texts count as empty in every stage; an empty table passes through as an empty one; extra columns
of any name are kept; rows that repeat are reduced to one by exact dedup.  Every stage decides by row, so a row with
a null doc_id, or one that shares its doc_id with others, stays or goes by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaussframe.llm import byte_bpe, exact_dedup, mixing, ngram_join, toxicity
from gaussframe.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects (own score 0.5 or more) go.  It learns from all labels of its input's folder."""
    return toxicity.below(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the row with the smallest doc_id stays (a null one last)."""
    return ngram_join.keep_one(docs, width=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    at = {c: f"c{i}" for i, c in enumerate(names)}
    mixed = mixing.mix(plain, source=at["source"], key=at["doc_id"], text=at["text"]).filter("copies > 0")
    return mixed.withColumn("i", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    ranks = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, round_trip=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies), ("source_mixing", mix_sources), ("byte_bpe", encode_texts)]

# a trained classifier and a seeded choice can't be put in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
