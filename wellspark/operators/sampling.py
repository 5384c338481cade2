"""Deterministic splits and samples: rows are ordered by a seeded hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *ids: str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *ids), *(F.col(i) for i in ids)]


def _ranked(df: DataFrame, keys: list[str], seed: int, ids: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("__rank", F.row_number().over(w.orderBy(*hash_order(seed, *ids)))).withColumn("__n", F.count("*").over(w))


def stratified_split(df: DataFrame, label: str, ratio: float, ids: list[str], seed: int = 0) -> DataFrame:
    """``is_val`` for int(n * ratio) rows of each label, at least one if there is more than one."""
    n = F.col("__n")
    take = F.when(n > 1, F.greatest(F.lit(1), F.floor(n * ratio))).otherwise(F.floor(n * ratio))
    return _ranked(df, [label], seed, ids).withColumn("is_val", F.col("__rank") <= take).drop("__rank", "__n")


def per_class(df: DataFrame, keys: list[str], most: int, ids: list[str], seed: int = 0) -> DataFrame:
    """Up to ``most`` rows of each group."""
    return _ranked(df, keys, seed, ids).filter(F.col("__rank") <= most).drop("__rank", "__n")


def per_dataset(df: DataFrame, root: str, label: str, most: int, ids: list[str], seed: int = 0) -> DataFrame:
    """Up to ``most`` rows of each root: an equal share of every label, the rest dealt label by label in turn.

    The turn order is (rank inside the label, label), so the first ``most`` rows in it are exactly
    the equal shares and then one more row from label after label.
    """
    ranked = _ranked(df, [root, label], seed, ids)
    turn = Window.partitionBy(root).orderBy("__rank", label)
    return ranked.withColumn("__turn", F.row_number().over(turn)).filter(F.col("__turn") <= most).drop("__rank", "__n", "__turn")


def sample_rows(df: DataFrame, n: int, ids: list[str], seed: int = 0) -> DataFrame:
    """``n`` rows (or all); a top-k by hash, without a full sort."""
    return df.orderBy(*hash_order(seed, *ids)).limit(n)


def shuffled(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    return df.orderBy(*hash_order(seed, *ids))


def densest(df: DataFrame, cluster: str, density: str, share: float, most: int, ids: list[str], seed: int = 0) -> DataFrame:
    """Up to ``most`` rows by hash out of each cluster's densest ``share``."""
    dense = Window.partitionBy(cluster).orderBy(F.col(density).desc(), *ids)
    kept = df.withColumn("__p", F.percent_rank().over(dense)).filter(F.col("__p") <= share).drop("__p")
    return per_class(kept, [cluster], most, ids, seed)


def group_quotas(sizes: list[int], target: int, ratio: float = 10.0, floor: int = 2) -> list[int]:
    """How many to keep of each group for about ``target`` in all.

    Sizes are compressed by a power so that the largest is at most ``ratio`` times the smallest;
    no group gets more than it has, and what that leaves over goes to the others in proportion.
    """
    if not sizes:
        return []
    if target >= sum(sizes):
        return list(sizes)
    import math

    spread = max(sizes) / max(1, min(sizes))
    power = 1.0 if spread <= ratio else math.log(ratio) / math.log(spread)
    weight = [s**power for s in sizes]
    quota = [0] * len(sizes)
    open_ = set(range(len(sizes)))
    left = target
    while open_:
        whole = sum(weight[i] for i in open_)
        full = [i for i in open_ if sizes[i] <= left * weight[i] / whole]
        if not full:
            share = {i: left * weight[i] / whole for i in open_}
            for i in open_:
                quota[i] = min(sizes[i], max(floor, int(share[i])))
            rest = left - sum(quota[i] for i in open_)
            for i in sorted(open_, key=lambda i: (int(share[i]) - share[i], i)):
                if rest <= 0:
                    break
                if quota[i] < sizes[i]:
                    quota[i] += 1
                    rest -= 1
            break
        for i in full:
            quota[i] = sizes[i]
            left -= sizes[i]
            open_.remove(i)
    return quota
