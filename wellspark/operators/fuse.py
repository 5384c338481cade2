"""Fusing measurement and prediction tables."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.functions.text import normalize_well, unique_name

#: The columns that can name an object.
IDENTITY = ("well", "field", "stack", "timepoint", "directory", "filename", "ground_truth", "label")


@dataclasses.dataclass
class Source:
    """A table to be fused, with where it came from."""

    df: DataFrame
    table: str
    stem: str
    mask: str | None = None
    is_infer: bool = False
    prefix: str | None = None


def q(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A full outer join in which null keys match; keys come once."""
    r = right.select(*(F.col(q(c)).alias(f"__right_{i}") for i, c in enumerate(right.columns)))
    at = {c: f"__right_{i}" for i, c in enumerate(right.columns)}
    on = reduce(lambda a, b: a & b, (F.col(q(k)).eqNullSafe(F.col(at[k])) for k in keys))
    joined = left.join(r, on, "full")
    return joined.select(
        *(F.coalesce(F.col(q(k)), F.col(at[k])).alias(k) for k in keys), *(F.col(q(c)) for c in left.columns if c not in keys), *(F.col(at[c]).alias(c) for c in right.columns if c not in keys)
    )


#: Rows of each side in one cell of a spread key (so its square in pairs), cells of one task, and places a key has on a side, so copies of a row, at most.
CELL_ROWS, CELLS, PLACES = 1024, 4, 8
#: Keys with more rows are paired block by block instead of copied, so many keys at most: cells' rows in a block of the right and of the left side, and about so many tasks at most (the left blocks lengthen beyond).
WIDE_KEYS, RIGHT_CELLS, LEFT_CELLS, WIDE_TASKS = 32, 3, 4, 20_000


def held_rows(df: DataFrame) -> DataFrame:
    """The same rows as an RDD, so that its shuffle runs once for all that is made of it (it runs now)."""
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), session)


def spread_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``full_outer``, with the pairs of hot keys (null ones too) dealt over many tasks (counting is an action, so opt-in).

    A key with more pairs than a cell holds makes a grid: each row has one place on its own side by
    its hash and a copy for every place of the other side, so each pair meets in exactly one cell.
    A key of very many rows isn't copied: each side is dealt into blocks once, and a task for every
    two blocks reads them, so the disk used follows the rows and not the pairs.
    """
    context = left.sparkSession.sparkContext
    left, right = held_rows(left), held_rows(right)
    names = [f"__h{i}" for i in range(len(keys))]
    side = lambda df, l, r: df.select(*(F.col(q(k)).alias(n) for k, n in zip(keys, names)), F.lit(l).alias("__nl"), F.lit(r).alias("__nr"))
    both = side(left, 1, 0).unionAll(side(right, 0, 1)).groupBy(*names).agg(F.sum("__nl").alias("__nl"), F.sum("__nr").alias("__nr"))
    held = both.filter(F.col("__nl").cast("double") * F.col("__nr") > CELL_ROWS * CELL_ROWS).collect()
    if not held:
        return full_outer(left, right, keys)
    held.sort(key=lambda r: -r["__nl"] * r["__nr"])
    wide = [n for n, r in enumerate(held) if max(r["__nl"], r["__nr"]) > PLACES * CELL_ROWS][:WIDE_KEYS]
    places = lambda n: min(PLACES, -(-n // CELL_ROWS))
    grid = [n for n in range(len(held)) if n not in set(wide)]
    listed = [(*r[: len(keys)], places(r["__nl"]), places(r["__nr"]), n) for n, r in enumerate(held)]
    kinds = dict(both.dtypes)
    hot = F.broadcast(left.sparkSession.createDataFrame(listed, ", ".join([*(f"{n} {kinds[n]}" for n in names), "__a int, __b int, __key long"])))
    known = reduce(lambda a, b: a & b, (F.col(q(k)).eqNullSafe(F.col(n)) for k, n in zip(keys, names)))
    others = [c for c in right.columns if c not in keys]
    parts = [full_outer(left.join(hot, known, "left_anti"), right.join(hot, known, "left_anti"), keys)]

    def named(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*more, *(F.col(q(c)).alias(f"__right_{i}") for i, c in enumerate(others)))

    def of_pairs(df: DataFrame) -> DataFrame:
        return df.select(*map(q, keys), *(F.col(q(c)) for c in left.columns if c not in keys), *(F.col(f"__right_{i}").alias(c) for i, c in enumerate(others)))

    if grid:
        cells = sum(listed[n][-3] * listed[n][-2] for n in grid)
        tasks = max(8 * context.defaultParallelism, min(20_000, cells // CELLS))

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            at = F.pmod(F.xxhash64(*(F.col(q(c)) for c in df.columns)), F.col(own)).cast("int").alias(own)
            rows = df.join(hot.filter(~F.col("__key").isin(wide)) if wide else hot, known)
            return rows.select(*(F.col(q(c)) for c in df.columns), "__key", at, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)).repartition(tasks, "__key", "__a", "__b")

        parts.append(of_pairs(dealt(left, "__a", "__b").join(named(dealt(right, "__b", "__a"), "__key", "__a", "__b"), ["__key", "__a", "__b"])))
    if wide:
        pairs = sum(held[n]["__nl"] * held[n]["__nr"] for n in wide)
        right_rows = RIGHT_CELLS * CELL_ROWS
        left_rows = max(LEFT_CELLS * CELL_ROWS, pairs // (right_rows * WIDE_TASKS))

        def gathered(df: DataFrame, rows: int) -> DataFrame:
            """The rows of the wide keys, in few partitions."""
            few = max(1, min(8 * context.defaultParallelism, rows // (64 * CELL_ROWS)))
            return held_rows(df.join(hot.filter(F.col("__key").isin(wide)), known).select(*(F.col(q(c)) for c in df.columns), "__key").repartition(few))

        l, r = gathered(left, sum(held[n]["__nl"] for n in wide)), gathered(right, sum(held[n]["__nr"] for n in wide))
        for n in wide:
            one = l.filter(F.col("__key") == n).drop("__key").repartition(-(-held[n]["__nl"] // left_rows))
            two = named(r.filter(F.col("__key") == n)).repartition(-(-held[n]["__nr"] // right_rows))
            parts.append(of_pairs(one.hint("shuffle_replicate_nl").crossJoin(two)))
    return reduce(lambda a, b: a.unionAll(b), parts)


def same_content(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> bool:
    """Whether a shared column agrees on all keys, null with null (an action, so opt-in)."""
    a = left.select(*map(q, keys), F.col(q(column)).alias("__a"))
    b = right.select(*map(q, keys), F.col(q(column)).alias("__b"))
    return full_outer(a, b, keys).filter(~F.col("__a").eqNullSafe(F.col("__b"))).limit(1).count() == 0


def fuse_pair(left: DataFrame, right: Source, drop_identical: bool = False, spread: bool = False) -> DataFrame:
    """Joined on the shared identity columns if ``label`` is one, else stacked by name.

    A clashing column of ``right`` gets a new name from its source; with ``drop_identical`` one
    with the same content is dropped.  ``spread`` deals the pairs of hot keys over many tasks.
    """
    keys = [c for c in IDENTITY if c in left.columns and c in right.df.columns]
    if "label" not in keys:
        return left.unionByName(right.df, allowMissingColumns=True)
    df, taken = right.df, set(left.columns)
    for c in [c for c in df.columns if c not in keys and c in taken]:
        if drop_identical and same_content(left, df, keys, c):
            df = df.drop(c)
        else:
            new = unique_name(c, taken | set(df.columns), right.stem, right.table)
            df = df.withColumnRenamed(c, new)
    return (spread_outer if spread else full_outer)(left, df, keys)


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in IDENTITY})


def fuse_sources(sources: list[Source], default_mask: str | None = None, drop_identical: bool = False) -> DataFrame:
    """Sources of one mask are folded together; masks are stacked with a ``mask`` column.

    With two or more different prefixes, columns get their source's prefix.  Sources of unknown
    mask count to ``default_mask``, or to the only known one.
    """
    masks = list(dict.fromkeys(s.mask for s in sources if s.mask))
    default = default_mask or (masks[0] if len(masks) == 1 else None)
    use_prefix = len({s.prefix for s in sources if s.prefix}) >= 2
    groups: dict[str | None, list[Source]] = {}
    for s in sources:
        df = prefix_columns(s.df, s.prefix) if use_prefix and s.prefix else s.df
        groups.setdefault(s.mask or default, []).append(dataclasses.replace(s, df=df))
    made = []
    for mask, group in groups.items():
        df = reduce(lambda a, b: fuse_pair(a, b, drop_identical), group[1:], group[0].df)
        if len(groups) > 1:
            df = df.withColumn("mask", F.lit(mask).cast("string"))
        made.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def fuse_unique(sources: list[Source], keys: list[str]) -> DataFrame:
    """Sources with distinct columns that are each unique on ``keys``: one shuffle for all instead of one join each."""
    every = [c for s in sources for c in s.df.columns if c not in keys]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.df for s in sources))
    return stacked.groupBy(*map(q, keys)).agg(*(F.first(F.col(q(c)), ignorenulls=True).alias(c) for c in every))


def star_join(inference: DataFrame, reductions: list[DataFrame], clusters: DataFrame | None = None) -> DataFrame:
    """Predictions with coordinates and clusters by ``uid``; the surrogate and the features are dropped."""
    parts = [*reductions, *([clusters] if clusters is not None else [])]
    return reduce(lambda a, b: a.join(b, "uid", "left"), parts, inference).drop("uid", "features")


def read_masks(df: DataFrame, column: str = "mask") -> list[tuple[str | None, DataFrame]]:
    """One frame per mask tag, the null tag being one of its own; without the column one frame."""
    if column not in df.columns:
        return [(None, df)]
    tags = sorted((r[0] for r in df.select(column).distinct().collect()), key=lambda t: (t is not None, t))
    return [(t, df.filter(F.col(column).eqNullSafe(F.lit(t))).drop(column)) for t in tags]


def join_image_mask(images: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on the site; the image's folder wins."""
    other = masks.withColumnRenamed("directory", "__mask_directory") if "directory" in masks.columns else masks
    out = full_outer(images, other, keys)
    if "__mask_directory" in out.columns:
        out = out.withColumn("directory", F.coalesce("directory", "__mask_directory") if "directory" in images.columns else F.col("__mask_directory")).drop("__mask_directory")
    return out


def join_plate_metadata(df: DataFrame, metadata: DataFrame, well: str = "well") -> DataFrame:
    """Adds the metadata columns that ``df`` lacks, by the well in its normal form; the well's text stays as it was.

    A plate has few wells, so the optimizer broadcasts the metadata where it is small.
    """
    extra = [c for c in metadata.columns if c != well and c not in df.columns]
    meta = metadata.select(normalize_well(F.col(well)).alias("__well"), *extra).dropDuplicates(["__well"])
    return df.withColumn("__key", normalize_well(F.col(well))).join(meta, F.col("__key") == F.col("__well"), "left").drop("__key", "__well")


def join_sheets(sheets: list[DataFrame], key: str = "well") -> DataFrame:
    return reduce(lambda a, b: full_outer(a, b, [key]), sheets)


def unpivot_plate(matrix: DataFrame, row: str, value: str) -> DataFrame:
    """A plate matrix (one row column, one column per plate column) as well and value; blanks dropped."""
    columns = [c for c in matrix.columns if c != row]
    typed = matrix.select(F.col(row).cast("string").alias("__row"), *(F.col(q(c)).cast("string").alias(c) for c in columns))
    long = typed.unpivot("__row", [F.col(q(c)) for c in columns], "__col", value)
    return long.filter(F.col(value).isNotNull() & (F.trim(value) != "")).select(normalize_well(F.concat("__row", "__col")).alias("well"), value)


def numeric_if_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns whose non-null values are all numbers become doubles (one aggregate over all of them)."""
    counted = df.agg(*(F.struct(F.count(q(c)).alias("n"), F.count(F.col(q(c)).try_cast("double")).alias("m")).alias(c) for c in columns)).first()
    good = [c for c in columns if counted[c]["n"] == counted[c]["m"] > 0]
    return df.withColumns({c: F.col(q(c)).cast("double") for c in good})


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "directory") -> DataFrame:
    """The incoming rows replace all rows of their folders (null and empty folders too)."""
    gone = incoming.select(F.col(key).alias("__key")).distinct()
    kept = existing.join(gone, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def conform(df: DataFrame, schema: object) -> DataFrame:
    """Columns as in ``schema``: unknown ones dropped, missing ones null."""
    return df.select(*((F.col(q(f.name)) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def map_values(df: DataFrame, values: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a column looked up by ``key``; unknown keys give null."""
    return df.join(values.select(key, name), key, "left")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def refuse_duplicates(df: DataFrame, key: str) -> None:
    """An error with five examples if a key occurs twice."""
    found = [r[0] for r in duplicates(df, key).orderBy(key).limit(5).collect()]
    if found:
        raise ValueError(f"repeated {key}: {found}")


def combine_selection(current: Column, clicked: Column, mode: str) -> Column:
    """Array columns: ``replace``, ``add`` (union) or ``toggle`` (symmetric difference)."""
    if mode == "replace":
        return F.array_distinct(clicked)
    if mode == "add":
        return F.array_union(current, clicked)
    return F.array_union(F.array_except(current, clicked), F.array_except(clicked, current))
