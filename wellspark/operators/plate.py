"""Aggregates per well, facet and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.functions.text import natural_key


def aggregate_by_well(df: DataFrame, column: str, method: str = "mean", well: str = "well", order: str | None = None) -> DataFrame:
    """well and value: mean, sum or sample std of numbers, the first text in ``order``; wells without a value are dropped.

    The sum of a well without any number is 0.
    """
    c = F.col(f"`{column}`")
    rows = df.filter(F.col(well).isNotNull())
    if isinstance(df.schema[column].dataType, T.NumericType):
        value = {"mean": F.avg(c), "sum": F.coalesce(F.sum(c), F.lit(0)), "std": F.stddev_samp(c)}[method]
    else:
        value = F.min_by(c, F.when(c.isNotNull(), F.col(order))) if order else F.first(c, ignorenulls=True)
    return rows.groupBy(well).agg(value.alias("value")).filter("value is not null")


def object_counts(df: DataFrame, well: str = "well", label: str = "label") -> DataFrame:
    return df.groupBy(well).agg(F.count_distinct(label).alias("n_labels"))


def color_range(df: DataFrame, column: str) -> DataFrame:
    """low, high; (0, 1) where all values are equal."""
    r = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    flat = F.col("low") == F.col("high")
    return r.select(F.when(flat, 0.0).otherwise(F.col("low")).alias("low"), F.when(flat, 1.0).otherwise(F.col("high")).alias("high"))


def per_object_values(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """A map of label to value for each site."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, value)))).alias("values"))


def mean_sem(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and standard error per group; null error for one value; null keys and values are left out."""
    rows = df.dropna(subset=[*keys, value])
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("sem"))


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the farthest values within 1.5 interquartile ranges."""
    rows = df.dropna(subset=[*keys, value])
    quartiles = rows.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    quartiles = quartiles.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    both = rows.select(*keys, value).join(quartiles, keys)
    inside = F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return both.groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"))


def facets(df: DataFrame, keys: list[str]) -> DataFrame:
    """Existing combinations with their number of rows; null levels are dropped."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))


def axis_index(df: DataFrame, column: str) -> DataFrame:
    """Distinct levels with their place in natural order, from 0."""
    levels = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("level")).distinct()
    return levels.select("level", (F.row_number().over(Window.orderBy(natural_key(F.col("level")), "level")) - 1).alias("place"))


def natural_distinct(df: DataFrame, column: str, most: int = 100) -> DataFrame:
    """The first ``most`` distinct values in natural order."""
    c = F.col(f"`{column}`").cast("string")
    return df.select(c.alias("value")).filter("value is not null").distinct().orderBy(natural_key(F.col("value")), "value").limit(most)


def natural_sort(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.orderBy(*(natural_key(F.col(f"`{c}`")) for c in columns if c in df.columns))


def plate_size(df: DataFrame, well: str = "well") -> DataFrame:
    """The largest row (letters in base 26) and column of the wells' names."""
    shape = r"^([A-Za-z]+)([0-9]{1,9})$"
    w = F.col(well)
    letters = F.split(F.upper(F.regexp_extract(w, shape, 1)), "")
    row = F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)
    return df.filter(w.rlike(shape)).agg(F.max(row).alias("rows"), F.max(F.regexp_extract(w, shape, 2).cast("int")).alias("cols"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n and the share of the truth's row."""
    n = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: true, predicted and right counts and F1 (0 where it isn't defined)."""
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("r")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("r")))).alias("e")).select("e.*")
    per = both.groupBy("class").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_predicted"), F.sum("r").alias("n_right"))
    return per.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("n_right"), F.col("n_true") + F.col("n_predicted")), F.lit(0.0)))


def accuracy_macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    per = class_scores(df, truth, predicted)
    return per.agg((F.sum("n_right") / F.sum("n_true")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def subset_accuracy(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """The share of rows whose label sets agree, in any order."""
    return df.agg(F.avg((F.array_sort(F.array_distinct(truth)) == F.array_sort(F.array_distinct(predicted))).cast("double")).alias("subset_accuracy"))


def class_distribution(df: DataFrame, labels: Column) -> DataFrame:
    return df.select(F.explode(labels).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def summary_per_group(df: DataFrame, group: str, kept: str) -> DataFrame:
    """kept and total rows of each group."""
    return df.groupBy(group).agg(F.count_if(F.col(kept)).alias("n_kept"), F.count("*").alias("n_total"))


def size_rank(df: DataFrame, cluster: str) -> DataFrame:
    """Names cluster_1, cluster_2 … by falling size, the smaller id first among equals."""
    n = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return n.withColumn("name", F.concat(F.lit("cluster_"), F.row_number().over(Window.orderBy(F.col("n").desc(), cluster)).cast("string")))


def cumulative_dimension(variance: DataFrame, least: float = 0.9, most: int = 100) -> DataFrame:
    """The smallest k whose first k shares of variance reach ``least``, at most ``most``; of (k, share)."""
    run = variance.withColumn("c", F.sum("share").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return run.agg(F.least(F.coalesce(F.min(F.when(F.col("c") >= least, F.col("k"))), F.max("k")), F.lit(most)).alias("k"))


def density(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Histogram density over equal bins between the extremes."""
    lim = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("low"), width), F.lit(0.0)))).cast("int")
    return df.filter(F.col(value).isNotNull()).join(F.broadcast(lim)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.try_divide(F.count("*"), F.first("n") * F.first(width)).alias("density"))


def grouped_series(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each group's values as an array in order, without null keys and values, with its place in natural order of the keys.

    A group's values are one row, so this is for what a plot shows; aggregates serve larger groups.
    """
    rows = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys) or "true")
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("values"))
    order = Window.orderBy(*(natural_key(F.col(k).cast("string")) for k in keys))
    return out.withColumn("place", F.row_number().over(order) - 1) if keys else out.withColumn("place", F.lit(0))


def resolve_groups(df: DataFrame, by: str, cluster: str = "cluster", label: str = "label", source: str = "source", names: dict[str, str] | None = None) -> DataFrame:
    """``group`` of each row: its cluster's name by size, its label (``unknown`` without one), its source's short name, or null for none."""
    if by == "cluster":
        return df.join(size_rank(df, cluster).select(cluster, F.col("name").alias("group")), cluster, "left")
    if by == "label":
        return df.withColumn("group", F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("unknown")))
    if by == "source":
        short = F.create_map(*(F.lit(x) for kv in (names or {}).items() for x in kv)) if names else None
        last = F.regexp_extract(F.regexp_replace(source, "/+$", ""), "([^/]*)$", 1)
        return df.withColumn("group", last if short is None else F.coalesce(F.try_element_at(short, F.col(source)), last))
    if by == "none":
        return df.withColumn("group", F.lit(None).cast("string"))
    raise ValueError(f"unknown grouping: {by}")


def multi_label_scores(df: DataFrame, truth: Column, probability: Column, classes: list[str], threshold: float = 0.5) -> DataFrame:
    """class, n_true, n_predicted, n_right and F1 of multi-label rows: label sets and an array of class probabilities."""
    long = df.select(F.posexplode(probability).alias("k", "p"), truth.alias("t"))
    name = F.element_at(F.array(*map(F.lit, classes)), F.col("k") + 1)
    hit, said = F.array_contains("t", name), F.col("p") >= threshold
    out = long.groupBy(name.alias("class")).agg(F.count_if(hit).alias("n_true"), F.count_if(said).alias("n_predicted"), F.count_if(hit & said).alias("n_right"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("n_right"), F.col("n_true") + F.col("n_predicted")), F.lit(0.0)))
