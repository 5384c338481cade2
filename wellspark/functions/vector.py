"""Column functions on numbers, arrays, maps and JSON."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, least: float = 1e-8) -> Column:
    return let(F.struct(doubles(v).alias("v"), F.greatest(norm(v), F.lit(least)).alias("n")), lambda r: F.transform(r["v"], lambda x: x / r["n"]))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit_distance(a: Column, b: Column) -> Column:
    """Distance of unit vectors from their product; rounding below zero counts as zero."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(a, b)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it (inside a lambda it would be computed for each element)."""
    return F.transform(F.array(value), f)[0]


def softmax(v: Column) -> Column:
    lifted = let(F.struct(v.alias("v"), F.array_max(v).alias("top")), lambda r: F.transform(r["v"], lambda x: F.exp(x - r["top"])))
    return let(lifted, lambda e: let(F.struct(e.alias("e"), total(e).alias("s")), lambda r: F.transform(r["e"], lambda x: x / r["s"])))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(v: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def topk_mean(v: Column, k: int) -> Column:
    """Mean of the k largest values, or of all if there are fewer; null for none."""
    best = F.slice(F.sort_array(v, asc=False), 1, k)
    return F.try_divide(total(best), F.size(best))


def probabilities(v: Column, classes: list[str]) -> list[Column]:
    return [F.get(v, F.lit(k)).alias(f"prob_{c}") for k, c in enumerate(classes)]


def sort_probabilities(names: Column, values: Column) -> Column:
    """(prob, name) structs, highest first, names in order among equals."""
    pairs = F.zip_with(values, names, lambda p, n: F.struct((-p).alias("minus"), n.alias("name")))
    return F.transform(F.array_sort(pairs), lambda s: F.struct((-s["minus"]).alias("prob"), s["name"].alias("name")))


def gamma(x: Column, low: float, high: float, g: float = 1.0, invert: bool = False) -> Column:
    """Contrast: rescale to 0..1 between the limits, clip, power; optionally inverted."""
    y = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))), F.lit(g))
    return 1 - y if invert else y


def bubble_area(x: Column, low: Column, high: Column, least: float = 10.0, most: float = 200.0) -> Column:
    """Marker area between two bounds, in proportion; the middle where all values are equal."""
    return F.coalesce(F.lit(least) + (most - least) * F.try_divide(x - low, F.nullif(high - low, F.lit(0.0))), F.lit((least + most) / 2))


def adaptive_scale(kth: Column, median: Column, power: float) -> Column:
    """A radius factor between 0.5 and 2 from the k-th neighbour's distance."""
    return F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.pow(kth / median, F.lit(power))))


def parse_probability(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def json_list(c: Column) -> Column:
    return F.from_json(c, "array<string>")


def json_first(c: Column) -> Column:
    """The first element of a JSON list of names; text that is no list stands for itself."""
    return F.coalesce(F.get(json_list(c), F.lit(0)), c)


def cache_key(*parts: Column) -> Column:
    """12 hex digits of the md5 of the parts as JSON."""
    return F.substring(F.md5(F.to_json(F.struct(*parts))), 1, 12)


def merge_maps(base: Column, overlay: Column) -> Column:
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(overlay, k)), overlay)


def deep_merge(base: dict, overlay: dict) -> dict:
    """Nested dictionaries, the overlay's values win."""
    out = dict(base)
    for k, v in overlay.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def warmup_cosine(step: int, base: float, final: float, steps: int, warmup: int = 0, start: float = 0.0) -> float:
    """A schedule's value: linear warm-up, then half a cosine to ``final``."""
    if step < warmup:
        return start + (base - start) * step / max(1, warmup)
    t = min(1.0, (step - warmup) / max(1, steps - warmup))
    return final + (base - final) * (1 + math.cos(math.pi * t)) / 2


def now_iso() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def decode_blob(c: Column, dtype: str = "float32") -> Column:
    """Bytes of little-endian numbers as an array of floats; null stays null."""
    @F.pandas_udf("array<float>")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else np.frombuffer(bytes(b), dtype).astype(np.float32))

    return decode(c)
