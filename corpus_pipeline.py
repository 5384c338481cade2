"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Stages but the last return the columns of ``documents``.  Rejected rows go (toxic documents,
near copies but one, documents that leak test items); repeated passages are cut out of the
texts; the last stage adds the token ids and their count, and leaves every row.

Defined cases: null, empty and wordless texts pass every stage (none is toxic, a copy or a leak; they
encode as no ids); of repeated rows and of ties one stays, as ``jaccard.keep_one`` says; a passage
that repeats inside one text is cut too; an empty table passes as an empty one; without labels of both
kinds nothing is toxic; extra columns stay as they are, whatever their names and types, but ``ids`` and
``n_tokens``, which the last stage replaces; ``n_chars`` is counted anew where a text was cut.  Very long
texts are held whole in one task at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.llm import bpe, decontam, jaccard, suffix_index, toxicity
from wellspark.llm.common import removed, table, written

#: Near copies: shingles of five words, and this similarity in percent.
SHINGLE_WORDS, SIMILARITY = 5, 80
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, SHINGLE_WORDS, SIMILARITY)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_index.cut_repeats(docs)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.reject_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, TOKENIZER).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_near_copy),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", reject_leaks),
    ("bpe_encoding", encode),
]

#: Trained scores, alignments and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
            removed(before)  # its rows are written anew; the tables of the input aren't touched
    return docs
