"""Reading and writing result tables; Parquet folders or catalogue tables instead of one database file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.operators.filters import without_binary
from wellspark.operators.fuse import Source, conform, fuse_sources, read_masks, star_join, upsert


def save_table(df: DataFrame, name: str, if_exists: str = "fail") -> None:
    """``fail``, ``replace`` or ``append``; appended rows take the existing table's columns."""
    spark = df.sparkSession
    if if_exists == "append" and spark.catalog.tableExists(name):
        conform(df, spark.table(name).schema).write.mode("append").saveAsTable(name)
    else:
        df.write.mode({"fail": "errorifexists", "replace": "overwrite", "append": "append"}[if_exists]).saveAsTable(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Without binary and array columns."""
    return without_binary(spark.table(name))


def preview(df: DataFrame, n: int = 20) -> tuple[DataFrame, int]:
    return df.limit(n), df.count()


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def table_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name)]


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def profiler_sources(spark: SparkSession, names: list[str], stem: str) -> list[Source]:
    """Object tables (those with ``label``), split by their mask tag."""
    out = []
    for name in names:
        df = read_table(spark, name)
        if "label" in df.columns:
            out += [Source(part, name, stem, tag or name) for tag, part in read_masks(df)]
    return out


def inference_sources(inference: DataFrame, reductions: list[DataFrame], clusters: DataFrame | None, stem: str, prefix: str | None = None) -> list[Source]:
    """The star of one inference as wide frames, one per mask."""
    wide = star_join(inference, reductions, clusters)
    return [Source(part, "inference", stem, tag, True, prefix) for tag, part in read_masks(wide, "mask_name")]


def load_features(inference: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Rows in uid order with clusters; a null feature vector is an error."""
    rows = inference if clusters is None else inference.join(clusters, "uid", "left")
    return rows.withColumn("features", F.when(F.col("features").isNull(), F.raise_error(F.lit("null features"))).otherwise(F.col("features"))).orderBy("uid")


def load_coordinates(inference: DataFrame, reduction: DataFrame, method: str) -> DataFrame:
    """Coordinates with sorted class probabilities and the compound id found in the file name."""
    probs = [c for c in inference.columns if c.startswith("prob_")]
    pairs = F.array(*(F.struct((-F.col(f"`{c}`")).alias("minus"), F.lit(c.removeprefix("prob_")).alias("name")) for c in probs))
    ranked = F.transform(F.array_sort(pairs), lambda s: F.struct(s["name"].alias("name"), (-s["minus"]).alias("prob")))
    rows = inference.join(reduction.select("uid", F.col(f"{method}_1").alias("x"), F.col(f"{method}_2").alias("y")), "uid")
    out = rows.withColumn("compound", F.nullif(F.regexp_extract("filename", r"CID\d+", 0), F.lit("")))
    return out.withColumn("probabilities", ranked) if probs else out


def infer_schema(extra: list[str], classes: list[str]) -> T.StructType:
    """Columns of an inference table."""
    text = ["directory", "filename", "mask_name", "ground_truth", *extra, "pred_class"]
    fields = [T.StructField("uid", T.LongType()), *(T.StructField(c, T.StringType()) for c in text), T.StructField("label", T.LongType()), T.StructField("pred_prob", T.DoubleType())]
    return T.StructType([*fields, *(T.StructField(f"prob_{c}", T.DoubleType()) for c in classes), T.StructField("features", T.ArrayType(T.FloatType()))])


def write_mask_table(spark: SparkSession, path: str, rows: DataFrame, key: str = "directory") -> None:
    """Replace the incoming folders' rows, keep the others.

    The table is partitioned by folder, so only the incoming folders' files are rewritten
    (dynamic partition overwrite); late columns are added and read as null elsewhere.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_mask_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).option("basePath", path).parquet(path)


def write_inference(existing: DataFrame | None, rows: DataFrame, extra: list[str], classes: list[str]) -> DataFrame:
    """The table after new rows replaced their folders' old ones (null folders too); other columns mean a new table."""
    target = infer_schema(extra, classes)
    rows = conform(rows, target)
    if existing is None or existing.columns != [f.name for f in target]:
        return rows
    return upsert(existing, rows)


def merged_table(sources: list[Source], default_mask: str | None = None) -> DataFrame | None:
    """All sources fused; none if there are no sources.  A single mask is tagged as well."""
    if not sources:
        return None
    df = fuse_sources(sources, default_mask)
    if "mask" not in df.columns:
        df = df.withColumn("mask", F.lit(sources[0].mask or default_mask).cast("string"))
    return df


def reduction_tables(embedding: DataFrame, method: str, uids: DataFrame) -> DataFrame:
    """(uid, method_1, method_2) of one table's rows out of a common embedding of several (source, uid)."""
    return embedding.join(uids, ["source", "uid"], "left_semi").select("uid", F.col("x").alias(f"{method}_1"), F.col("y").alias(f"{method}_2"))


def label_table(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Overwrites a table of labels; refuses one that lacks well, label or class."""
    if spark.catalog.tableExists(name):
        lacking = {"well", "label", "class"} - set(spark.table(name).columns)
        if lacking:
            raise ValueError(f"{name} is no label table: it lacks {sorted(lacking)}")
    rows.write.mode("overwrite").saveAsTable(name)


def append_manifest(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Appends CSV rows; the header of what is there must be the same."""
    try:
        there = spark.read.option("header", True).csv(path).columns
    except Exception:  # noqa: BLE001  nothing there yet
        there = None
    if there is not None and there != rows.columns:
        raise ValueError(f"other columns: {there}")
    rows.write.mode("append").option("header", True).csv(path)


def selection_outputs(df: DataFrame, kept: DataFrame, id_: str) -> dict[str, DataFrame]:
    """manifest (all rows with ``keep``), keep (kept ids) and curated (kept rows), sorted by source and path."""
    flagged = df.join(kept.select(id_, F.lit(True).alias("keep")), id_, "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    order = [c for c in ("source", "filepath") if c in df.columns] or [id_]
    return {"manifest": flagged.orderBy(*order), "keep": kept.select(id_), "curated": flagged.filter("keep").drop("keep").orderBy(*order)}


def stack(frames: list[DataFrame]) -> DataFrame:
    """By name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def table_sources(frames: dict[str, DataFrame], stem: str, prefix: str | None = None) -> list[Source]:
    """The sources of one result set by its tables' names: an inference star if it has ``inference``, else object tables."""
    if "inference" in frames:
        reductions = [df for n, df in sorted(frames.items()) if n.startswith("reduction_")]
        return inference_sources(frames["inference"], reductions, frames.get("clusters"), stem, prefix)
    out = []
    for name, df in sorted(frames.items()):
        if "label" in df.columns:
            out += [Source(part, name, stem, tag or name, False, prefix) for tag, part in read_masks(without_binary(df))]
    return out


def absorbed(inference: DataFrame, reductions: list[DataFrame], clusters: DataFrame | None, stem: str) -> dict[str, DataFrame]:
    """One wide table per mask out of an inference star; rows without a mask go by the star's name."""
    return {s.mask or stem: s.df for s in inference_sources(inference, reductions, clusters, stem)}


def build_merged(spark: SparkSession, name: str, sets: dict[str, dict[str, DataFrame]], prefixes: dict[str, str] | None = None, default_mask: str | None = None) -> DataFrame | None:
    """The merged table ``name`` rebuilt from result sets (stem -> tables); a stale one goes if nothing is left to merge.

    Sets that aren't merged themselves (those with an ``inference`` table and no object rows) are read as stars.
    """
    prefixes = prefixes or {}
    sources = [s for stem, frames in sorted(sets.items()) for s in table_sources(frames, stem, prefixes.get(stem))]
    df = merged_table(sources, default_mask)
    if df is None:
        drop_table(spark, name)
        return None
    save_table(df, name, "replace")
    return spark.table(name)


def init_table(spark: SparkSession, name: str, schema: T.StructType) -> bool:
    """An empty table of these columns; one with other columns is dropped and made anew.  True if it is new."""
    if spark.catalog.tableExists(name):
        if spark.table(name).columns == schema.names:
            return False
        drop_table(spark, name)
    spark.createDataFrame([], schema).write.saveAsTable(name)
    return True


class BatchWriter:
    """Frames into one table: the first write replaces it and fixes the columns, later ones are fitted to them.

    Nothing is written before ``every`` frames are there or ``close`` is called; without frames no table is made.
    """

    def __init__(self, name: str, every: int = 50) -> None:
        self.name, self.every, self._held, self._schema = name, every, [], None

    def add(self, df: DataFrame) -> None:
        self._held.append(df)
        if len(self._held) >= self.every:
            self.flush()

    def flush(self) -> None:
        if not self._held:
            return
        df = stack(self._held)
        if self._schema is None:
            self._schema = df.schema
            save_table(df, self.name, "replace")
        else:
            save_table(conform(df, self._schema), self.name, "append")
        self._held = []

    def close(self) -> None:
        self.flush()


def cached(spark: SparkSession, path: str, make: object) -> DataFrame:
    """Rows kept as Parquet at ``path``; missing or unreadable ones are made anew."""
    try:
        df = spark.read.parquet(path)
        df.limit(1).collect()
    except Exception:  # noqa: BLE001  nothing there, or broken
        make().write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
    return df


def log_metrics(spark: SparkSession, path: str, rows: list[tuple[str, int, int, dict[str, float]]]) -> None:
    """Appends (tag, step, epoch, metrics) as one CSV row each, with a column per name in order."""
    names = sorted({k for r in rows for k in r[3]})
    kind = ", ".join(["tag string", "step long", "epoch long", *(f"`{n}` double" for n in names)])
    append_manifest(spark, path, spark.createDataFrame([(t, s, e, *(float(m[n]) if n in m else None for n in names)) for t, s, e, m in rows], kind))


def sorted_manifest(df: DataFrame) -> DataFrame:
    """By source, then path."""
    return df.orderBy("source", "filepath")
