"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, ngram_join
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_pii, joined

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(i: int):
        return F.size(F.filter("__base", lambda c: c["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return found.select("doc_id", *(count(i) for i in range(len(KINDS))), F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"), F.size("__spans").cast("long").alias("n_spans"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


def op3_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import media_features

    return media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import remainder, toxicity

    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    scored = toxicity(docs.select("doc_id", "text"), labels, remainder(F.col("__k"), 5) != 0)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality
    from .toxicity import remainder

    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    scored = quality(docs.select("doc_id", "text"), labels, remainder(F.col("__k"), 3) != 1)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, and the matches as license:coverage:start:end by start."""
    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.transform("matches", lambda m: F.concat_ws(":", m["license"], F.format_number(m["coverage"], 4), m["start"].cast("string"), m["end"].cast("string")))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.concat_ws(",", named).alias("licenses"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_table

    mixed = mix_table(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer("piece_bpe_32k.model"), limit=4096).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, num=90, den=100)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode

    ranks = tokenizer("byte_bpe_50k.tiktoken")
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, round_trip=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_pii_boosting, op2_exact_dedup, op3_matroska_packets, op4_toxicity, op5_quality_gam, op6_license_patience, op7_source_mixing, op8_token_counts, op9_ngram_jaccard, op10_byte_bpe)}
ORACLES: dict[str, str] = {"op2_exact_dedup": exact_dedup.ORACLE, "op7_source_mixing": mixing.ORACLE, "op9_ngram_jaccard": ngram_join.ORACLE}
