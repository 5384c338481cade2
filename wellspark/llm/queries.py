"""The queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.llm import bpe, decontam, jaccard, langid, lengths, licenses, quality, suffix_index, toxicity, warc
from wellspark.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_verdicts(table(spark, sf_dir, "documents"))


def op2_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(table(spark, sf_dir, "documents"), BYTE_BPE))


def op3_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")), bucket_width=256)
    return resolved.withColumn("headers", warc.header_text(F.col("headers")))


def op5_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, PIECES))


def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.digest(table(spark, sf_dir, "documents"))


def op9_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items(), key=lambda x: (len(x[0].split("_")[0]), x[0])) if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_frequency": quality.SQL, "op3_signature_trees": jaccard.SQL, "op4_revisit_resolution": warc.SQL}
