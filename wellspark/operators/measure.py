"""All feature groups of one mask's objects as one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.operators import filters, kernels, pixels

SHAPE = ("area", "y0", "x0", "y1", "x1", "cy", "cx", "extent", "equivalent_diameter", "major_axis", "minor_axis", "eccentricity")
OUTLINE = ("perimeter", "area_convex", "solidity", "feret_max")


def measure_objects(
    px: DataFrame, site: list[str], channels: Sequence[str], height: Column, width: Column, *, intensity: Sequence[str], radial: Sequence[str] = (), granularity: Sequence[str] = (), texture: Sequence[str] = (),
    pairs: Sequence[tuple[str, str]] = (), parent: DataFrame | None = None, parent_name: str = "parent", metadata: DataFrame | None = None, bins: int = 4, steps: int = 16, granularity_options: dict | None = None, distance: int = 2, levels: int = 256,
) -> DataFrame:
    """One row per object of ``px`` (site, y, x, label and a column per channel), with these groups of columns:

    site and metadata (by site), label, the share of its outline at the image's border, its parent (of
    ``parent``: site, y, x, label), shape and outline, and per named channel intensity, rings, granularity
    and texture, and the correlation of channel pairs.  An unknown channel is an error.  Every group is an aggregate or a
    kernel over whole sites, and the groups meet by site and label.
    """
    for name in (*intensity, *radial, *granularity, *texture, *(c for p in pairs for c in p)):
        if name not in channels:
            raise ValueError(f"unknown channel {name}, known are {list(channels)}")
    key = [*site, "label"]
    own = px.filter("label > 0")
    out = pixels.edge_pixel_ratio(px.select(*site, "y", "x", "label"), site, height, width)
    groups: list[DataFrame] = []
    if parent is not None:
        column = f"parent_{parent_name}"
        found = pixels.parent_majority(px.select(*site, "y", "x", "label"), parent.select(*site, "y", "x", "label"), [*site, "y", "x"], site)
        groups.append(found.select(*site, F.col("child").alias("label"), F.col("parent").cast("long").alias(column)))
    shape = pixels.object_shape(own, key)
    groups.append(shape.select(*key, *(F.col(c).alias(f"shape_{c}") for c in SHAPE)))
    outline = kernels.per_site(px.select(*site, "y", "x", "label", F.lit(0.0).alias("value")), site, "outline", ["label", *OUTLINE])
    groups.append(outline.select(*key, *(F.col(c).alias(f"shape_{c}") for c in OUTLINE)))
    if intensity:
        f = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "std": F.stddev_pop, "sum": F.sum}
        groups.append(own.groupBy(*key).agg(*(g(c).alias(f"intensity_{n}_{c}") for c in intensity for n, g in f.items())))
    one = lambda c: px.select(*site, "y", "x", "label", F.col(c).cast("double").alias("value"))
    for c in radial:
        names = [f"{n}_{k}" for n in ("frac_at_d", "mean_frac", "radial_cv") for k in range(1, bins + 1)]
        groups.append(kernels.per_site(one(c), site, "radial", ["label", *names], bins=bins).select(*key, *(F.col(n).alias(f"{n}_{c}") for n in names)))
    for c in granularity:
        names = [f"granularity_{k}" for k in range(1, steps + 1)]
        made = kernels.per_site(one(c), site, "granularity", ["label", *names], steps=steps, **(granularity_options or {}))
        groups.append(made.select(*key, *(F.col(n).alias(f"{n}_{c}") for n in names)))
    for c in texture:
        made = pixels.glcm_features(one(c), site, distance, levels)
        groups.append(made.select(*key, *(F.col(n).alias(f"glcm_{n}_d{distance}_{c}") for n in pixels.TEXTURE)))
    if pairs:
        groups.append(pixels.pearson(own, key, list(channels), list(pairs)))
    for g in groups:
        renamed = g.withColumnsRenamed({k: f"__{k}" for k in key})
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
        condition = same[0]
        for s in same[1:]:
            condition &= s
        out = out.join(renamed, condition, "left").drop(*(f"__{k}" for k in key))
    extra: list[str] = []
    if metadata is not None:
        extra = [c for c in metadata.columns if c not in site]
        out = out.join(metadata, site, "left")
    return filters.reorder_columns(out, [*site, *extra])
