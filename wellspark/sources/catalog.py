"""The dataset catalogue: file listings parsed into site and cell tables; all captures stay text."""

from __future__ import annotations

import dataclasses
import os
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions.text import base_name, captures, channel_column, derive_well, mask_column, natural_key, normalize_well, parent, portable_path
from wellspark.operators.fuse import join_image_mask
from wellspark.operators.plate import natural_sort

#: Structural and ignored captures, and the sort order of a site table.
STRUCTURAL = ("well", "field", "stack", "timepoint", "channel", "row", "col")
IGNORED = ("ext", "tile", "mask_name", "directory", "stem", "path")
SORT = ("row", "col", "well", "field", "stack", "timepoint")

#: The default file-name patterns, and the folder of the images.
IMAGE_PATTERN = r"r(?P<row>\d+)c(?P<col>\d+)f0?(?P<field>\d+)p0?(?P<stack>\d+)-ch0?(?P<channel>\d+)(?:sk|t)0?(?P<timepoint>\d+).*\.tiff"
MASK_PATTERN = r"r(?P<row>\d+)c(?P<col>\d+)f0?(?P<field>\d+)p0?(?P<stack>\d+)-ch0?(?P<channel>\d+)(?:sk|t)0?(?P<timepoint>\d+).*_cp_masks_(?P<mask_name>.+)\.png"
IMAGE_SUBDIR = "images"


@dataclasses.dataclass
class Roles:
    """A pattern's captures by role."""

    structural: list[str]
    extra: list[str]
    row_col: bool

    @property
    def metadata(self) -> list[str]:
        return [*self.structural, *self.extra]


def roles(pattern: str) -> Roles:
    names = list(re.compile(pattern).groupindex)
    structural = [n for n in STRUCTURAL if n in names and n != "channel"]
    extra = sorted((n for n in names if n not in STRUCTURAL and n not in IGNORED), key=lambda n: [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", n)])
    return Roles(structural, extra, "row" in names and "col" in names and "well" not in names)


def refuse_reserved(pattern: str, reserved: set[str]) -> None:
    clash = sorted(set(re.compile(pattern).groupindex) & reserved)
    if clash:
        raise ValueError(f"reserved capture names: {clash}")


def list_files(spark: SparkSession, root: str, glob: str | None = None, subdir: str | None = None) -> DataFrame:
    """``path`` of the files under ``root`` or under a glob of its folders; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(f"{root.rstrip('/')}/{subdir}" if subdir else root)
    return df.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))


def parse(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose name matches from its beginning, with a text column per capture."""
    caps = captures(base_name(portable_path(F.col("path"))), pattern)
    named = files.select("path", *(c.alias(n) for n, c in caps.items()))
    first = next(iter(caps), None)
    return named.filter(F.col(first).isNotNull()) if first else named.limit(0)


def site_table(files: DataFrame, pattern: str = IMAGE_PATTERN, channels: list[str] | None = None) -> DataFrame:
    """One row per site and one column per channel, holding the path.

    Of two files for one site and channel the one with the last path stays.  Channel names are an
    argument or one small distinct.  Row and column become ``well``.
    """
    r = roles(pattern)
    parsed = parse(files, pattern)
    keys = r.metadata
    if "channel" not in re.compile(pattern).groupindex:
        parsed = parsed.withColumn("channel", F.lit("1"))
    named = parsed.withColumn("channel", channel_column(F.col("channel")))
    if channels is None:
        channels = [x[0] for x in named.select("channel").distinct().orderBy(natural_key(F.col("channel"))).collect()]
    wide = named.groupBy(*keys).pivot("channel", channels).agg(F.max("path")) if channels else named.select(*keys)
    wide = wide.withColumn("directory", parent(F.coalesce(*(F.col(f"`{c}`") for c in channels))) if channels else F.lit(None).cast("string"))
    return merge_well(wide, r)


def merge_well(df: DataFrame, r: Roles) -> DataFrame:
    return df.withColumn("well", derive_well(F.col("row"), F.col("col"))).drop("row", "col") if r.row_col else df


def site_metadata(images: DataFrame, masks: DataFrame | None = None, pattern: str = IMAGE_PATTERN, mask_pattern: str = MASK_PATTERN) -> DataFrame:
    """Image and mask files as one site table: a full outer join on the captures that both have, naturally sorted."""
    out = site_table(images, pattern)
    if masks is not None:
        r = roles(mask_pattern)
        parsed = parse(masks, mask_pattern)
        names = [x[0] for x in parsed.select("mask_name").distinct().orderBy("mask_name").collect()]
        if names:
            wide = parsed.groupBy(*r.metadata).pivot("mask_name", names).agg(F.max("path")).withColumnsRenamed({n: f"mask_{n}" for n in names})
            wide = merge_well(wide.withColumn("directory", parent(F.coalesce(*(F.col(f"`mask_{n}`") for n in names)))), r)
            keys = [c for c in wide.columns if c in out.columns and c != "directory" and not c.startswith("mask_")]
            out = join_image_mask(out, wide, keys)
    return natural_sort(out, list(SORT))


def cell_table(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """One row per TIFF: stem, path, directory and captures; with a pattern, files that don't match are left out."""
    tiffs = files.filter(F.lower("path").rlike(r"\.tiff?$"))
    name = base_name(F.col("path"))
    caps = {n: c for n, c in captures(name, pattern).items() if n not in IGNORED} if pattern else {}
    rows = tiffs.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "path", parent(F.col("path")).alias("directory"), *(c.alias(n) for n, c in caps.items()))
    if caps:
        rows = rows.filter(F.col(next(iter(caps))).isNotNull())
    return rows.orderBy(natural_key(F.col("path")))


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """filepath, label of a CSV; relative paths belong to the CSV's folder; of repeated paths the last line counts."""
    df = spark.read.option("header", True).csv(path).withColumn("__n", F.monotonically_increasing_id())
    folder = path.rsplit("/", 1)[0]
    full = F.when(F.col("filepath").startswith("/"), F.col("filepath")).otherwise(F.concat(F.lit(folder + "/"), F.col("filepath")))
    return df.groupBy(portable_path(full).alias("filepath")).agg(F.max_by("label", "__n").alias("label"))


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """filepath and label (null where blank or missing) of a CSV; paths stay as they are."""
    df = spark.read.option("header", True).csv(path)
    label = F.nullif(F.trim("label"), F.lit("")) if "label" in df.columns else F.lit(None).cast("string")
    return df.select(portable_path(F.col("filepath")).alias("filepath"), label.alias("label"))


def completeness(spark: SparkSession, sites: DataFrame, tables: dict[str, list[str]]) -> dict[str, str]:
    """What is missing of the expected tables and columns; the image table must have a row per site."""
    missing: dict[str, str] = {}
    for name, columns in tables.items():
        if not spark.catalog.tableExists(name):
            missing[name] = "no table"
            continue
        df = spark.table(name)
        lacking = [c for c in columns if c not in df.columns]
        if lacking:
            missing[name] = f"no columns {lacking}"
        elif name == "image" and df.count() != sites.count():
            missing[name] = "row count"
    return missing


def canonical_wells(df: DataFrame) -> DataFrame:
    return df.withColumn("well", normalize_well(F.col("well")))


def resolve_datasets(root: str, pattern: str) -> list[str]:
    """The folder itself if its name matches from its beginning, else its matching subfolders in order; none if it isn't there."""
    folder = Path(root)
    if not folder.is_dir():
        return []
    if re.match(pattern, folder.name):
        return [str(folder)]
    return sorted(str(f) for f in folder.iterdir() if f.is_dir() and re.match(pattern, f.name))


def resolve_directory(directory: str | None, root: str) -> str:
    """The absolute folder of a stored one: under the working folder if it is there, else under ``root`` if it is there."""
    if not directory or directory in (".", "./"):
        return str(Path(root).absolute())
    if Path(directory).is_absolute():
        return os.path.normpath(directory)
    here, there = (os.path.normpath(Path(base) / directory) for base in (Path.cwd(), Path(root).absolute()))
    return there if not Path(here).exists() and Path(there).exists() else here


def canonical_directory(path: str) -> str:
    """The stored form of a folder: relative to the working folder if it lies below, with forward slashes."""
    full = os.path.abspath(path)
    short = os.path.relpath(full)
    return (full if short.startswith("..") else short).replace("\\", "/")


def suggest_model_name(path: str) -> str:
    """A model file's stem, or its folder's name if the stem says nothing (``model``)."""
    p = Path(path)
    return p.stem if p.stem and p.stem != "model" else p.parent.name or p.stem or "model"


def registered_only(features: DataFrame, registry: DataFrame, path: str = "filepath") -> DataFrame:
    """Features whose path is registered."""
    return features.join(registry.select(path).distinct(), path, "left_semi")


def only_subset(files: DataFrame, wanted: DataFrame | None, path: str = "filepath") -> DataFrame:
    """The files of a list, or all without a list."""
    return files if wanted is None else registered_only(files, wanted, path)


def with_masks(sites: DataFrame, masks: list[str]) -> DataFrame:
    """Sites that have all the named masks."""
    return sites.filter(reduce(lambda a, b: a & b, (F.col(f"`{mask_column(m)}`").isNotNull() for m in masks)))
