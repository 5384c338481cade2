"""Exact token-length histogram with suffix sums.

Documents are aggregated by encoded length.  For every length that occurs, the suffix
sums answer for a context limit of that length: how many documents reach it, how many
tokens they hold, what all documents keep when truncated at it, and which quantile it is.

Defined cases: a null or empty text has length 0 and is counted; repeated rows each count; lengths
that tie are one row; an empty table gives no rows; extra columns are ignored, whatever their
names; a very long text costs memory for itself alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspark.llm.bpe import token_counts
from wellspark.llm.common import checkpointed

#: Lengths of one bucket; suffix sums run over buckets first, then inside each bucket.
BUCKET = 256


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """length, n_docs: map-side combined, so a shuffled row is a distinct length of a task."""
    return token_counts(docs, path).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: docs_at_least, tokens_at_least, docs_total, tokens_total, truncated_total, quantile.

    truncated_total is the token count when every document is cut at ``length``; quantile is the
    share of documents of at most ``length``.  The window without a partition sees one row per
    bucket of 256 lengths only.
    """
    bucket = F.floor(F.col("length") / BUCKET)
    hist = checkpointed(hist)  # read twice below; one row per occurring length
    per = hist.withColumn("bucket", bucket).withColumn("tokens", F.col("length") * F.col("n_docs"))
    after = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0).cast("long"))

    buckets = per.groupBy("bucket").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    buckets = buckets.select("bucket", zero(F.sum("bd").over(after)).alias("d_after"), zero(F.sum("bt").over(after)).alias("t_after"), F.sum("bd").over(everything).alias("docs_total"), F.sum("bt").over(everything).alias("tokens_total"))
    inside = Window.partitionBy("bucket").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(buckets, "bucket").select(
        "length", "n_docs", "docs_total", "tokens_total",
        (F.sum("n_docs").over(inside) + F.col("d_after")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("t_after")).alias("tokens_at_least"),
    )
    return out.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """The answers for any context limits: limit, truncated_total, docs_over.

    A limit between two occurring lengths takes the next longer length's suffix sums; beyond the
    longest, nothing is cut.
    """
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    longer = sums.join(F.broadcast(asked), F.col("length") > F.col("limit"), "right")
    total = sums.agg(F.max("tokens_total").alias("all_tokens"))
    best = longer.groupBy("limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "length").alias("s"))
    return best.join(F.broadcast(total)).select(
        "limit",
        (F.col("all_tokens") - F.coalesce(F.col("s.tokens_at_least"), F.lit(0)) + F.col("limit") * F.coalesce(F.col("s.docs_at_least"), F.lit(0))).alias("truncated_total"),
        F.coalesce(F.col("s.docs_at_least"), F.lit(0)).cast("long").alias("docs_over"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the smallest length that at least this share of the documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(asked), F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
