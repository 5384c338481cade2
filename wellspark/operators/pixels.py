"""Image operators on the long form: one row per (site, y, x) and channel value or label.

Everything here is groups, windows and equi-joins on pixel positions; no image is ever
collected.  Outside an image counts as label 0.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the percentiles of an image profile, in percent.
PERCENTILES = (0.1, 1.0, 25.0, 75.0, 99.0, 99.9)


def image_profile(px: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean, sum and six linear percentiles; zeros for an image without a positive value."""
    shares = F.array(*(F.lit(p / 100) for p in PERCENTILES))
    r = px.groupBy(*keys).agg(F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.percentile(value, shares).alias("__p"), F.max(F.abs(value)).alias("__m"))
    zero = F.col("__m") == 0
    cols = [F.when(zero, 0.0).otherwise(F.col("__p")[k]).alias(f"p{str(p).replace('.', '_')}") for k, p in enumerate(PERCENTILES)]
    return r.select(*keys, "mean", "sum", *cols)


def object_intensity(px: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean, median, population deviation and sum per object."""
    return px.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_pop(value).alias("std"), F.sum(value).alias("sum"))


def pearson(px: DataFrame, keys: list[str], channels: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Correlation per object and channel pair (all pairs unless given); null without variance."""
    pairs = pairs or list(combinations(channels, 2))
    return px.groupBy(*keys).agg(*(F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))).alias(f"corr_{a}_{b}") for a, b in pairs))


def object_shape(px: DataFrame, keys: list[str]) -> DataFrame:
    """area, bounding box, extent, equivalent diameter, axis lengths and eccentricity from second moments.

    A pixel is a unit square, so 1/12 is added to the variances.
    """
    xx, yy, xy = F.var_pop("x") + 1 / 12, F.var_pop("y") + 1 / 12, F.covar_pop("x", "y")
    r = px.groupBy(*keys).agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), xx.alias("__xx"), yy.alias("__yy"), xy.alias("__xy")
    )
    root = F.sqrt(4 * F.col("__xy") * F.col("__xy") + (F.col("__xx") - F.col("__yy")) * (F.col("__xx") - F.col("__yy")))
    big, small = (F.col("__xx") + F.col("__yy") + root) / 2, F.greatest(F.lit(0.0), (F.col("__xx") + F.col("__yy") - root) / 2)
    return r.select(
        *keys, "area", "y0", "x0", "y1", "x1", "cy", "cx", (F.col("area") / ((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1))).alias("extent"),
        F.sqrt(4 * F.col("area") / F.pi()).alias("equivalent_diameter"), (4 * F.sqrt(big)).alias("major_axis"), (4 * F.sqrt(small)).alias("minor_axis"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - small / big)).alias("eccentricity"),
    )


def neighbours(mask: DataFrame, site: list[str], label: str = "label") -> DataFrame:
    """Each pixel with the labels left, right, above and below; 0 outside (positions may be missing)."""
    row, col = Window.partitionBy(*site, "y").orderBy("x"), Window.partitionBy(*site, "x").orderBy("y")

    def shifted(w: Window, axis: str, step: int) -> Column:
        f = F.lag if step < 0 else F.lead
        return F.when(f(axis, 1).over(w) == F.col(axis) + step, f(label, 1).over(w)).otherwise(0)

    return mask.select("*", shifted(row, "x", -1).alias("left"), shifted(row, "x", 1).alias("right"), shifted(col, "y", -1).alias("up"), shifted(col, "y", 1).alias("down"))


def edge_pixel_ratio(mask: DataFrame, site: list[str], height: Column, width: Column, tolerance: int = 2) -> DataFrame:
    """The share of an object's outline pixels within ``tolerance`` pixels of the image's border."""
    n = neighbours(mask, site).filter("label > 0")
    outline = F.expr("left != label or right != label or up != label or down != label")
    near = (F.col("x") < tolerance) | (F.col("y") < tolerance) | (F.col("x") >= width - tolerance) | (F.col("y") >= height - tolerance)
    return n.groupBy(*site, "label").agg(F.coalesce(F.try_divide(F.count_if(outline & near), F.count_if(outline)), F.lit(0.0)).alias("edge_pixel_ratio"))


def drop_edge_objects(mask: DataFrame, site: list[str], height: Column, width: Column, most: float, tolerance: int = 2) -> DataFrame:
    bad = edge_pixel_ratio(mask, site, height, width, tolerance).filter(F.col("edge_pixel_ratio") > most)
    return mask.join(bad, [*site, "label"], "left_anti")


def labels_of(mask: DataFrame, site: list[str]) -> DataFrame:
    return mask.filter("label > 0").select(*site, "label").distinct()


def bounding_boxes(mask: DataFrame, site: list[str], height: Column, width: Column, padding: int = 4) -> DataFrame:
    """x, y, w, h of each object, padded and kept inside the image."""
    r = mask.filter("label > 0").groupBy(*site, "label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    x, y = F.greatest(F.lit(0), F.col("x0") - padding), F.greatest(F.lit(0), F.col("y0") - padding)
    x2, y2 = F.least(width - 1, F.col("x1") + padding), F.least(height - 1, F.col("y1") + padding)
    return r.select(*site, "label", x.alias("x"), y.alias("y"), (x2 - x + 1).alias("w"), (y2 - y + 1).alias("h"))


def crops(px: DataFrame, mask: DataFrame, site: list[str], height: Column, width: Column, padding: int = 4) -> DataFrame:
    """Pixels of every object's padded box; those of other objects and of the background are 0."""
    boxes = bounding_boxes(mask, site, height, width, padding).select(*site, F.col("label").alias("object"), F.col("x").alias("bx"), F.col("y").alias("by"), "w", "h")
    at = px.join(mask.select(*site, "y", "x", "label"), [*site, "y", "x"], "left")
    inside = (F.col("x") >= F.col("bx")) & (F.col("x") < F.col("bx") + F.col("w")) & (F.col("y") >= F.col("by")) & (F.col("y") < F.col("by") + F.col("h"))
    own = at.join(boxes, site).filter(inside)
    return own.select(*site, F.col("object").alias("label"), (F.col("y") - F.col("by")).alias("y"), (F.col("x") - F.col("bx")).alias("x"), F.when(F.col("label") == F.col("object"), F.col("value")).otherwise(0).alias("value"))


def parent_majority(child: DataFrame, parent: DataFrame, at: list[str], site: list[str]) -> DataFrame:
    """Each child's parent: the one with most of its pixels, the smallest label among equals, else 0.

    ``child`` and ``parent`` have the position columns ``at`` and a ``label``.
    """
    both = child.filter("label > 0").select(*at, F.col("label").alias("child")).join(parent.select(*at, F.col("label").alias("parent")), at, "left")
    n = both.groupBy(*site, "child", F.coalesce("parent", F.lit(0)).alias("parent")).agg(F.count("*").alias("n"))
    return n.groupBy(*site, "child").agg(F.coalesce(F.max_by(F.when(F.col("parent") > 0, F.col("parent")), F.when(F.col("parent") > 0, F.struct("n", -F.col("parent")))), F.lit(0)).alias("parent"))


def normalize(px: DataFrame, keys: list[str], value: str = "value", low: float = 0.0, high: float = 100.0, mode: str = "zscore") -> DataFrame:
    """Clipped to two percentiles of its group, then z-scored (0 without spread) or rescaled to 0..1.

    The statistics are one aggregate that is joined back: groups are images or channels, few
    beside their pixels.  Clipped mean and deviation need a second aggregate.
    """
    lim = px.groupBy(*keys).agg(F.percentile(value, F.lit(low / 100)).alias("__lo"), F.percentile(value, F.lit(high / 100)).alias("__hi"))
    clipped = px.join(lim, keys).withColumn("__v", F.greatest(F.col("__lo"), F.least(F.col("__hi"), F.col(value).cast("double"))))
    if mode == "rescale":
        return clipped.withColumn("normalized", F.coalesce(F.try_divide(F.col("__v") - F.col("__lo"), F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))), F.lit(0.0))).drop("__lo", "__hi", "__v")
    stats = clipped.groupBy(*keys).agg(F.avg("__v").alias("__m"), F.stddev_pop("__v").alias("__s"))
    z = F.when(F.col("__s") < 1e-6, 0.0).otherwise((F.col("__v") - F.col("__m")) / F.col("__s"))
    return clipped.join(stats, keys).withColumn("normalized", z).drop("__lo", "__hi", "__v", "__m", "__s")


def normalize_fixed(px: DataFrame, stats: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """A fixed transform: statistics (lo, hi, mean, std per key) from other images."""
    v = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col(value).cast("double")))
    return px.join(stats, keys).withColumn("normalized", F.when(F.col("std") < 1e-6, 0.0).otherwise((v - F.col("mean")) / F.col("std"))).drop("lo", "hi", "mean", "std")


def z_project(px: DataFrame, keys: list[str], how: str = "max", value: str = "value") -> DataFrame:
    """One plane per site and channel; means round half to even; the stack is called 0."""
    f = {"max": F.max(value), "min": F.min(value), "mean": F.bround(F.avg(value), 0)}[how]
    return px.groupBy(*keys, "y", "x").agg(f.alias(value)).withColumn("stack", F.lit("0"))


def tile(px: DataFrame, height: int, width: int, tile_h: int, tile_w: int) -> DataFrame:
    """Complete tiles only, numbered from 1 row by row, with positions inside the tile."""
    across, down = width // tile_w, height // tile_h
    inside = (F.col("y") < down * tile_h) & (F.col("x") < across * tile_w)
    number = F.floor(F.col("y") / tile_h) * across + F.floor(F.col("x") / tile_w) + 1
    return px.filter(inside).withColumn("tile", number.cast("int")).withColumn("y", F.pmod("y", F.lit(tile_h))).withColumn("x", F.pmod("x", F.lit(tile_w)))


def merge_channels(channels: list[Column], how: str = "mean") -> Column:
    if how == "mean":
        return sum(channels[1:], channels[0]) / len(channels)
    return (F.greatest if how == "max" else F.least)(*channels) if len(channels) > 1 else channels[0]


def foreground_fraction(px: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The share of positions with a nonzero value in any channel."""
    at = px.groupBy(*keys, "y", "x").agg(F.max((F.col(value) != 0).cast("int")).alias("__on"))
    return at.groupBy(*keys).agg(F.avg("__on").alias("foreground"))


#: Fixed value: the texture features of a co-occurrence matrix.
TEXTURE = (
    "contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm", "entropy", "variance", "sumaverage", "sumvariance", "sumentropy",
    "differencevariance", "differenceentropy", "infomeasure1", "infomeasure2",
)


def glcm_pairs(px: DataFrame, site: list[str], distance: int, levels: int, value: str = "value") -> DataFrame:
    """Symmetric grey-level pair counts inside objects, for four directions; levels count from 1.

    Values are quantised between the object's extremes, which get the first and the last level.  A
    diagonal step is the rounded projection of the distance.  Needs label, y, x, value.
    """
    own = px.filter("label > 0")
    lim = own.groupBy(*site, "label").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    grey = (F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("__lo"), span), F.lit(0.0)) * (levels - 1)) + 1).cast("int")
    quantised = own.join(lim, [*site, "label"]).select(*site, "label", "y", "x", grey.alias("i"))
    slant = round(distance * math.sqrt(0.5))
    steps = [(0, 0, distance), (1, slant, slant), (2, distance, 0), (3, slant, -slant)]
    away = F.explode(F.array(*(F.struct(F.lit(a).alias("angle"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for a, dy, dx in steps)))
    first = quantised.withColumn("__s", away).select(*site, "label", F.col("__s.angle").alias("angle"), (F.col("y") + F.col("__s.dy")).alias("y"), (F.col("x") + F.col("__s.dx")).alias("x"), "i")
    pairs = first.join(quantised.withColumnRenamed("i", "j"), [*site, "label", "y", "x"])
    both = pairs.select(*site, "label", "angle", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("__p"))
    return both.groupBy(*site, "label", "angle", F.col("__p.i").alias("i"), F.col("__p.j").alias("j")).agg(F.count("*").alias("n"))


def glcm_features(px: DataFrame, site: list[str], distance: int = 2, levels: int = 256) -> DataFrame:
    """The ``TEXTURE`` features of every object: means over four directions.

    A direction without a pair counts with zeros and a correlation of 1.  The matrix is symmetric, so one
    marginal distribution serves both sides; logarithms are to base 2.
    """
    keys = [*site, "label", "angle"]
    whole = Window.partitionBy(*keys)
    p = glcm_pairs(px, site, distance, levels).withColumn("p", F.col("n") / F.sum("n").over(whole))
    p = p.withColumn("px", F.sum("p").over(Window.partitionBy(*keys, "i"))).withColumn("py", F.sum("p").over(Window.partitionBy(*keys, "j")))
    d, entropy = F.col("i") - F.col("j"), lambda q: F.sum(-q * F.log2(q))

    def of(kind: str) -> DataFrame:
        """Mean, variance and entropy of the sums or differences of a pair's levels."""
        at = F.col("i") + F.col("j") if kind == "sum" else F.abs(d)
        q = p.groupBy(*keys, at.alias("k")).agg(F.sum("p").alias("q"))
        k, w = F.col("k"), F.col("q")
        return q.groupBy(*keys).agg(F.sum(w * k).alias(f"{kind}average"), (F.sum(w * k * k) - F.pow(F.sum(w * k), F.lit(2))).alias(f"{kind}variance"), entropy(w).alias(f"{kind}entropy"))

    m = p.groupBy(*keys).agg(
        F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") * F.abs(d)).alias("dissimilarity"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"),
        F.sum(F.col("p") * F.col("p")).alias("asm"), entropy(F.col("p")).alias("entropy"), F.sum(F.col("p") * F.col("i")).alias("__m"),
        F.sum(F.col("p") * F.col("i") * F.col("i")).alias("__q"), F.sum(F.col("p") * F.col("i") * F.col("j")).alias("__x"), F.sum(-F.col("p") * F.log2(F.col("px") * F.col("py"))).alias("__cross"),
    )
    side = p.groupBy(*keys, "i").agg(F.first("px").alias("q")).groupBy(*keys).agg(entropy(F.col("q")).alias("__side"))
    m = m.join(side, keys).join(of("sum"), keys).join(of("difference"), keys)
    var = F.col("__q") - F.col("__m") * F.col("__m")
    m = m.withColumn("variance", F.greatest(var, F.lit(0.0))).withColumn("energy", F.sqrt("asm"))
    m = m.withColumn("correlation", F.when(var < 1e-15, 1.0).otherwise(F.try_divide(F.col("__x") - F.col("__m") * F.col("__m"), F.nullif(var, F.lit(0.0)))))
    # the product of both marginals has twice the entropy of one
    m = m.withColumn("infomeasure1", F.coalesce(F.try_divide(F.col("entropy") - F.col("__cross"), F.nullif(F.col("__side"), F.lit(0.0))), F.lit(0.0)))
    m = m.withColumn("infomeasure2", F.sqrt(F.greatest(F.lit(0.0), 1 - F.exp(-2 * (2 * F.col("__side") - F.col("entropy"))))))
    mean = m.groupBy(*site, "label").agg(F.count("*").alias("__n"), *((F.sum(c) / 4).alias(c) for c in TEXTURE))
    out = labels_of(px, site).join(mean, [*site, "label"], "left")
    missing = (4 - F.coalesce("__n", F.lit(0))) / 4
    return out.select(*site, "label", *((F.coalesce(c, F.lit(0.0)) + (missing if c == "correlation" else F.lit(0.0))).alias(c) for c in TEXTURE))


def without_small(mask: DataFrame, site: list[str], least: int = 5) -> DataFrame:
    """Pixels of objects with at least ``least`` pixels."""
    big = mask.filter("label > 0").groupBy(*site, "label").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    return mask.join(big.drop("__n"), [*site, "label"], "left_semi")


def outlines(mask: DataFrame, site: list[str], least: int = 5) -> DataFrame:
    """The border of every object as unit segments between pixel centres' half steps: label, y0, x0, y1, x1.

    A segment is a pixel side with another label (or nothing) beyond it; together they close around the
    object, also at the image's border.  Objects of fewer than ``least`` pixels are left out.
    """
    big = without_small(mask, site, least).select(*site, "label").distinct()
    n = neighbours(mask, site).filter("label > 0").join(big, [*site, "label"], "left_semi")
    sides = [("left", -0.5, -0.5, 0.5, -0.5), ("right", -0.5, 0.5, 0.5, 0.5), ("up", -0.5, -0.5, -0.5, 0.5), ("down", 0.5, -0.5, 0.5, 0.5)]
    cut = F.array(*(F.when(F.col(k) != F.col("label"), F.struct((F.col("y") + a).alias("y0"), (F.col("x") + b).alias("x0"), (F.col("y") + c).alias("y1"), (F.col("x") + e).alias("x1"))) for k, a, b, c, e in sides))
    return n.select(*site, "label", F.explode(F.filter(cut, lambda c: c.isNotNull())).alias("s")).select(*site, "label", "s.*")


def to_float_max(value: Column, max_value: float | None) -> Column:
    """Integers as shares of the largest value; unchanged without one."""
    return value if max_value is None else value.cast("double") / float(max_value)


def reference_stats(px: DataFrame, site: list[str], channel: str = "channel", value: str = "value", low: float = 0.0, high: float = 100.0, method: str = "per_channel", masked: bool = True) -> DataFrame:
    """lo, hi, mean, std by site and channel, for ``normalize_fixed``: percentiles, then the rescaled values' statistics.

    With ``masked`` only pixels with a nonzero value in any channel count.  ``method`` is per_channel,
    global (all channels pooled) or null (mean 0, deviation 1); a channel without range gets zeros.
    """
    keys = [*site, channel]
    if masked:
        on = px.groupBy(*site, "y", "x").agg(F.max((F.col(value) != 0).cast("int")).alias("__on")).filter("__on = 1").drop("__on")
        px = px.join(on, [*site, "y", "x"], "left_semi")
    lim = px.groupBy(*keys).agg(F.percentile(value, F.lit(max(low, 0.0) / 100)).cast("double").alias("lo"), F.percentile(value, F.lit(min(high, 100.0) / 100)).cast("double").alias("hi"))
    flat = F.col("hi") <= F.col("lo")
    lim = lim.select(*keys, F.when(flat, 0.0).otherwise(F.col("lo")).alias("lo"), F.when(flat, 0.0).otherwise(F.col("hi")).alias("hi"))
    if method == "null":
        return lim.select("*", F.lit(0.0).alias("mean"), F.when(F.col("hi") > F.col("lo"), 1.0).otherwise(0.0).alias("std"))
    scaled = (F.greatest(F.col("lo"), F.least(F.col("hi"), F.col(value).cast("double"))) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    rows = px.join(lim, keys).withColumn("__v", F.coalesce(scaled, F.lit(0.0)))
    over = keys if method == "per_channel" else site
    stats = rows.groupBy(*over).agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"))
    some = F.col("hi") > F.col("lo")
    return lim.join(stats, over).select(*keys, "lo", "hi", F.when(some, F.col("mean")).otherwise(0.0).alias("mean"), F.when(some, F.col("std")).otherwise(0.0).alias("std"))


def normalize_by_reference(px: DataFrame, stats: DataFrame, keys: list[str], value: str = "value", inside: Column | None = None) -> DataFrame:
    """Clip, rescale to 0..1 and z-score by fixed ``reference_stats``; 0 without range or spread, and outside ``inside``."""
    scaled = (F.greatest(F.col("lo"), F.least(F.col("hi"), F.col(value).cast("double"))) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    z = F.when((F.col("hi") > F.col("lo")) & (F.col("std") > 1e-6), (scaled - F.col("mean")) / F.col("std")).otherwise(0.0)
    z = z if inside is None else F.when(inside, z).otherwise(0.0)
    return px.join(stats, keys).withColumn("normalized", z).drop("lo", "hi", "mean", "std")
