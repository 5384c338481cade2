"""Embedding-space operators.

Rows hold a vector column.  Where a set of reference vectors is compared with all rows, the
reference goes to the executors in blocks of bounded size and each Arrow batch is one matrix
product; nothing pairs rows through a shuffle.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspark.functions.vector import adaptive_scale, dot, l2_normalize, let, softmax, total

#: Bytes of reference vectors that one pass holds on an executor.
BLOCK_BYTES = 64 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


@dataclasses.dataclass
class Space:
    """Whitened principal axes: mean, axes (k x dim) and each axis' standard deviation."""

    mean: np.ndarray
    axes: np.ndarray
    scale: np.ndarray
    variance_share: np.ndarray


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance from per-batch sums: one pass, one dim x dim matrix per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, None, None
        for b in batches:
            x = matrix(b.column("v"))
            if len(x):
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                c = x.T @ x if c is None else c + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([c.ravel().tolist()])], names=["n", "s", "c"])

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "n long, s array<double>, c array<double>").collect()
    n = sum(p["n"] for p in parts)
    if n < 2:
        raise ValueError("at least two rows are needed")
    s = np.sum([p["s"] for p in parts], 0)
    c = np.sum([p["c"] for p in parts], 0).reshape(len(s), len(s))
    return n, s / n, (c - np.outer(s, s) / n) / (n - 1)


def fit_space(df: DataFrame, vector: str, k: int = 50) -> Space:
    """Whitened PCA; k is bounded by the rows and dimensions."""
    n, mean, cov = moments(df, vector)
    value, axes = np.linalg.eigh(cov)
    order = np.argsort(-value)
    k = min(k, n, len(mean))
    kept = order[:k]
    sign = np.sign(axes[np.abs(axes[:, kept]).argmax(0), kept])
    value = np.maximum(value, 0)
    return Space(mean, (axes[:, kept] * sign).T, np.sqrt(np.maximum(value[kept], 1e-12)), value[order] / max(value.sum(), 1e-300))


def apply_space(df: DataFrame, vector: str, space: Space, out: str = "w", normalize: bool = True) -> DataFrame:
    """Centred, projected and whitened, then scaled to length 1."""
    shared = df.sparkSession.sparkContext.broadcast((space.mean, space.axes, space.scale))

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        mean, axes, scale = shared.value
        if not len(v):
            return pd.Series([], dtype=object)
        w = (np.stack(v.to_numpy()).astype(float) - mean) @ axes.T / scale
        if normalize:
            w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-8)
        return pd.Series(list(w))

    return df.withColumn(out, project(F.col(vector).cast("array<double>")))


def dimension_for(space: Space, least: float = 0.9, most: int = 100) -> int:
    return int(min(most, np.searchsorted(np.cumsum(space.variance_share), least) + 1))


def reference_blocks(df: DataFrame, columns: list[str], vector: str) -> Iterator[pd.DataFrame]:
    """The reference rows in blocks of at most BLOCK_BYTES of vectors, one partition's worth at a time."""
    held: list[tuple] = []
    size = 0
    for row in df.select(*columns, F.col(vector).cast("array<double>").alias("v")).toLocalIterator():
        held.append((*row[:-1], np.array(row["v"])))
        size += 8 * len(row["v"])
        if size >= BLOCK_BYTES:
            yield pd.DataFrame(held, columns=[*columns, "v"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=[*columns, "v"])


#: Query rows and reference rows of one product; from so many reference rows on the queries are dealt anew, so many partitions a core.
QUERY_ROWS, TILE = 512, 4096
DEALT_FROM, DEALT = 4096, 4


def length(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def without_copies(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows by id, with the ``k`` smallest ids of equal vectors only: ties go by id, so no others are among the best k."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], np.ascontiguousarray(v[order])
    if v.shape[1]:
        _, at = np.unique(v.view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        rank = np.arange(len(v)) - np.repeat(first, np.diff(first, append=len(v)))
        keep = np.sort(order[rank < k])
        ids, v = ids[keep], v[keep]
    return ids, v


def _not_set(flags: np.ndarray, n: int) -> np.ndarray:
    """The places below ``n`` of flags that aren't set, eight at a time; there is room for eight more behind them."""
    flags[n : n + 8] = True
    words = np.flatnonzero(flags[: n + -n % 8].view(np.uint64) != 0x0101010101010101)
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return at[~flags[at]]


class Best:
    """Exact search for the highest products, rounded to ``digits``, ties by id.

    Products of single precision sort out what cannot be among the best: a row is passed over only if
    its product stays below the k-th best found so far by more than the bound of the rounding error.
    The others' products are computed in double precision, each by itself.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, digits: int = 12) -> None:
        self.ids, self.v, self.digits = ids, v, digits
        self.most = float(length(v).max(initial=0.0))
        self.order = np.argsort(ids, kind="stable")
        self.sorted = ids[self.order]
        self.low = v.astype(np.float32) if self.most < 1e15 else v

    def top(self, q: np.ndarray | None, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of ``x``, id and product, best first in each row; reference rows of the row's own id ``q`` are left out."""
        n = len(x)
        own = length(x)
        low = x.astype(np.float32) if self.low.dtype == np.float32 and own.max(initial=0.0) < 1e15 else x
        reference = self.low if low is not x else self.v
        with np.errstate(all="ignore"):
            error = (x.shape[1] + 8) * float(np.finfo(low.dtype).eps) * own * self.most + 10.0**-self.digits + 1e-37
        bound = np.full(n, -np.inf)
        row, at, product = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        mine, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if q is not None:
            first, last = np.searchsorted(self.sorted, q, "left"), np.searchsorted(self.sorted, q, "right")
            mine = np.repeat(np.arange(n), last - first)
            place = self.order[np.arange(len(mine)) + np.repeat(last - np.cumsum(last - first), last - first)]
        held, below = np.empty(n * min(TILE, len(self.v)), low.dtype), np.empty(n * min(TILE, len(self.v)) + 8, bool)
        for a in range(0, len(self.v), TILE):
            with np.errstate(all="ignore"):
                tile = reference[a : a + TILE]
                s = np.matmul(low, tile.T, out=held[: n * len(tile)].reshape(n, len(tile)))
                if low is x:
                    s[np.isnan(s)] = -np.inf
                inside = (place >= a) & (place < a + TILE)
                s[mine[inside], place[inside] - a] = -np.inf
                if s.shape[1] > k and not np.isfinite(bound).all():
                    bound = np.fmax(bound, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * error)
                limit = bound.astype(s.dtype)
                limit = np.where(limit > bound, np.nextafter(limit, s.dtype.type(-np.inf)), limit)
                np.less(s, limit[:, None], out=below[: s.size].reshape(s.shape))
                r, c = np.divmod(_not_set(below, s.size), s.shape[1])
                if not len(r):
                    continue
                c += a
                if q is not None:
                    other = self.ids[c] != q[r]
                    r, c = r[other], c[other]
                p = np.round(np.einsum("ij,ij->i", x[r], self.v[c]), self.digits)
            row, at, product = np.concatenate([row, r]), np.concatenate([at, c]), np.concatenate([product, p])
            order = np.lexsort((self.ids[at], -product, row))
            row, at, product = row[order], at[order], product[order]
            first = np.searchsorted(row, np.arange(n))
            kept = np.arange(len(row)) - first[row] < k
            row, at, product = row[kept], at[kept], product[kept]
            size = np.bincount(row, minlength=n)
            full = np.flatnonzero(size == k)
            with np.errstate(all="ignore"):
                bound[full] = np.fmax(bound[full], product[np.cumsum(size)[full] - 1] - error[full])
        return row, self.ids[at], product


def nearest(queries: DataFrame, reference: DataFrame, id_: str, vector: str, k: int, exclude_self: bool = False, digits: int = 12) -> DataFrame:
    """query, neighbour, similarity: each query's k most similar reference rows, ties by id.

    Products are rounded to ``digits`` so that ties don't depend on the batch.  One pass per
    block of reference vectors; a window merges the blocks' best.
    """
    kind = f"query long, neighbour long, similarity double"
    rows = queries.select(F.col(id_).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    context = queries.sparkSession.sparkContext
    dealt = None
    out = None
    for block in reference_blocks(reference, [id_], vector):
        ids = block[id_].to_numpy(np.int64)
        many = len(ids) >= DEALT_FROM
        again = int(np.unique(ids, return_counts=True)[1].max()) if exclude_self else 0
        shared = context.broadcast(without_copies(ids, np.stack(block["v"].to_numpy()), k + again))

        def run(batches: Iterable[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            best = Best(*shared.value, digits)
            for b in batches:
                for a in range(0, b.num_rows, QUERY_ROWS):
                    part = b.slice(a, QUERY_ROWS)
                    q = np.asarray(part.column("q"))
                    row, neighbour, similarity = best.top(q if exclude_self else None, matrix(part.column("v")), k)
                    good = np.isfinite(similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(q[row[good]]), pa.array(neighbour[good]), pa.array(similarity[good])], names=["query", "neighbour", "similarity"])

        if many and dealt is None:
            dealt = rows.repartition(DEALT * context.defaultParallelism, "q")
        part = (dealt if many else rows).mapInArrow(run, kind)
        out = (part, True) if out is None else (out[0].unionAll(part), False)
    if out is None:
        return queries.sparkSession.createDataFrame([], kind)
    if out[1]:
        return out[0]
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour")
    return out[0].withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def knn_graph(df: DataFrame, id_: str, vector: str, k: int = 15) -> DataFrame:
    """Undirected edges (src < dst): the union of the directed k-nearest edges."""
    n = nearest(df, df, id_, vector, k, exclude_self=True)
    return n.select(F.least("query", "neighbour").alias("src"), F.greatest("query", "neighbour").alias("dst")).distinct()


def knn_vote(queries: DataFrame, baseline: DataFrame, id_: str, vector: str, label: str, k: int) -> DataFrame:
    """query, predicted, confidence: the most frequent label of the k nearest (the smallest among equals) and its share."""
    n = nearest(queries, baseline, id_, vector, k)
    votes = n.join(baseline.select(F.col(id_).alias("neighbour"), F.col(label).alias("label")), "neighbour").groupBy("query", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("predicted"), (F.max("n") / F.sum("n")).alias("confidence"))


def similarity_rank(df: DataFrame, exemplars: DataFrame, id_: str, vector: str, limit: int) -> DataFrame:
    """The rows most similar to any exemplar, exemplars left out."""
    best = nearest(df.join(exemplars.select(id_), id_, "left_anti"), exemplars, id_, vector, 1)
    return best.select(F.col("query").alias(id_), "similarity").orderBy(F.col("similarity").desc(), id_).limit(limit)


def suggest_score(df: DataFrame, positives: DataFrame, negatives: DataFrame, id_: str, vector: str, k: int = 1, negative_weight: float = 0.5) -> DataFrame:
    """score: mean of the k best similarities to positives, less the weighted one to negatives.

    Without positives that part is -1, without negatives it is 0.
    """

    def part(exemplars: DataFrame, name: str) -> DataFrame:
        return nearest(df, exemplars, id_, vector, k).groupBy(F.col("query").alias(id_)).agg(F.avg("similarity").alias(name))

    both = df.select(id_).join(part(positives, "__p"), id_, "left").join(part(negatives, "__n"), id_, "left")
    return both.select(id_, (F.coalesce("__p", F.lit(-1.0)) - negative_weight * F.coalesce("__n", F.lit(0.0))).alias("score"))


def review_items(labelled: DataFrame, id_: str, vector: str, state: str) -> DataFrame:
    """Suspected mislabels: rows (state 0 or 1) nearer to the other state than to their own, leaving themselves out.

    margin is the difference of the two similarities, and ``evidence`` the nearest opposite row.
    """
    pos, neg = labelled.filter(F.col(state) == 1), labelled.filter(F.col(state) == 0)
    parts = []
    for own, other in ((pos, neg), (neg, pos)):
        mine = nearest(own, own, id_, vector, 1, exclude_self=True).select(F.col("query").alias(id_), F.col("similarity").alias("own"))
        far = nearest(own, other, id_, vector, 1).select(F.col("query").alias(id_), F.col("similarity").alias("other"), F.col("neighbour").alias("evidence"))
        parts.append(own.select(id_, state).join(far, id_).join(mine, id_, "left"))
    both = parts[0].unionAll(parts[1])
    return both.select(id_, state, "evidence", (F.col("other") - F.coalesce("own", F.lit(-1.0))).alias("margin")).filter("margin > 0")


def certainty(parts: list[Column]) -> Column:
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def medoids(df: DataFrame, id_: str, vector: str, cluster: str) -> DataFrame:
    """Each cluster's row with the highest mean cosine to its rows: the highest product with their sum."""
    unit = df.select(id_, cluster, l2_normalize(F.col(vector)).alias("__v"))
    sums = unit.select(cluster, F.posexplode("__v").alias("__k", "__x")).groupBy(cluster, "__k").agg(F.sum("__x").alias("__x"))
    sums = sums.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__x"))), lambda s: s["__x"]).alias("__sum"))
    scored = unit.join(sums, cluster).select(id_, cluster, F.round(dot(F.col("__v"), F.col("__sum")), 9).alias("__d"))
    return scored.groupBy(cluster).agg(F.max_by(id_, F.struct("__d", -F.col(id_))).alias("medoid"))


def distance_to_kept(df: DataFrame, kept: DataFrame, id_: str, vector: str) -> DataFrame:
    """Distance of unit vectors to the nearest kept row."""
    return nearest(df, kept, id_, vector, 1).select(F.col("query").alias(id_), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("distance"))


def selection_metrics(df: DataFrame, kept: DataFrame, id_: str, vector: str, radius: float) -> DataFrame:
    """Coverage at the radius and half of it, distances of dropped rows, and the kept rows' isolation."""
    far = distance_to_kept(df, kept, id_, vector).join(kept.select(id_, F.lit(True).alias("__k")), id_, "left")
    gone = F.when(F.col("__k").isNull(), F.col("distance"))
    a = far.agg(
        F.avg((F.col("distance") <= radius / 2).cast("double")).alias("coverage_half"), F.avg((F.col("distance") <= radius).cast("double")).alias("coverage"),
        F.percentile(gone, F.lit(0.5)).alias("drop_median"), F.avg(gone).alias("drop_mean"), F.percentile(gone, F.lit(0.95)).alias("drop_p95"),
    )
    alone = nearest(kept, kept, id_, vector, 1, exclude_self=True).select(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("d"))
    return a.join(F.broadcast(alone.agg(F.percentile("d", F.lit(0.5)).alias("isolation_median"), F.min("d").alias("isolation_min"))))


#: Rows of one chunk of the greedy walk and of one product inside it, and the neighbour whose distance tells the density.
CHUNK = 8192
COVER_ROWS = 256
DENSITY_K = 10


def density_scale(df: DataFrame, id_: str, vector: str, power: float, k: int = DENSITY_K) -> DataFrame:
    """id and ``scale``: (distance to the k-th nearest other row / the median of that) ** power, between 0.5 and 2.

    1 for all if there are too few rows, or if half of them have k equal ones.
    """
    far = nearest(df, df, id_, vector, k, exclude_self=True).groupBy(F.col("query").alias(id_)).agg(F.count("*").alias("__n"), F.min("similarity").alias("__s"))
    far = far.select(id_, F.when(F.col("__n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("__s")))).alias("__d"))
    middle = far.agg(F.percentile("__d", F.lit(0.5)).alias("__m"))
    return far.join(F.broadcast(middle)).select(id_, F.when((F.col("__m") > 0) & F.col("__d").isNotNull(), adaptive_scale(F.col("__d"), F.col("__m"), power)).otherwise(1.0).alias("scale"))


def cover_rows(v: np.ndarray, radius: np.ndarray, held: np.ndarray, chunk: int = CHUNK) -> list[int]:
    """The greedy walk over unit rows in the order given: which are kept.

    Chunk by chunk the rows beyond their own radius of what is held compete, the most isolated first (the
    first in order among equals); a row is kept if it is beyond its radius of those kept before it.
    """
    kept: list[int] = []
    apart = lambda dots: np.sqrt(np.maximum(0, 2 - 2 * dots))
    for start in range(0, len(v), chunk):
        part, limit = v[start : start + chunk], radius[start : start + chunk]
        near = np.full(len(part), -np.inf)
        found = Best(np.arange(len(held)), held)
        for a in range(0, len(part) if len(held) else 0, QUERY_ROWS):
            row, _, product = found.top(None, part[a : a + QUERY_ROWS], 1)
            near[a + row] = product
        open_ = np.flatnonzero(apart(near) > limit)
        open_ = open_[np.argsort(near[open_], kind="stable")]
        taken: list[int] = []
        while len(open_):
            # every open row is beyond its radius of all that is taken; a block of them is settled by one product
            block = open_[:COVER_ROWS]
            dots = part[block] @ part[open_].T
            covers = dots >= 1 - limit[open_] * limit[open_] / 2 - 1e-9
            i, j = np.nonzero(covers)
            covers[i, j] = apart(np.round(dots[i, j], 12)) <= limit[open_[j]]
            gone = np.zeros(len(open_), bool)
            for i in range(len(block)):
                if not gone[i]:
                    taken.append(int(block[i]))
                    gone |= covers[i]
            gone[: len(block)] = True
            open_ = open_[~gone]
        kept += [start + i for i in sorted(taken)]
        held = np.concatenate([held, part[sorted(taken)]])
    return kept


def greedy_cover(df: DataFrame, id_: str, vector: str, radius: float, seeds: DataFrame | None = None, cells: int = 1, seed: int = 0, scale: str | None = None) -> DataFrame:
    """kept rows: a greedy cover (see ``cover_rows``) in hash order; ``scale`` names a column of factors on the radius.

    The rule is sequential.  ``cells`` > 1 first covers hash cells independently and in parallel, then
    covers the union of what they kept, so the single last task holds kept rows only.  The cover
    property holds within a row's radius (1 cell) or twice the largest one (several).  ``seeds`` are rows
    that count as held; they are broadcast.
    """
    order = F.xxhash64(F.lit(seed), id_)
    factor = F.lit(1.0) if scale is None else F.col(scale).cast("double")
    rows = df.select(F.col(id_).cast("long").alias("id"), order.alias("o"), F.col(vector).cast("array<double>").alias("v"), (factor * radius).alias("r"), F.pmod(order, F.lit(cells)).alias("cell"))
    known = [] if seeds is None else [np.array(r[0]) for r in seeds.select(F.col(vector).cast("array<double>")).toLocalIterator()]
    shared = df.sparkSession.sparkContext.broadcast(np.stack(known) if known else None)

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "id"])
        v = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 1))
        held = shared.value if shared.value is not None else np.zeros((0, v.shape[1]))
        return pdf.iloc[cover_rows(v, pdf["r"].to_numpy(float), held)]

    schema = "id long, o long, v array<double>, r double, cell long"
    if cells > 1:
        rows = rows.groupBy("cell").applyInPandas(cover, schema)
    return rows.withColumn("cell", F.lit(0).cast("long")).groupBy("cell").applyInPandas(cover, schema).select(F.col("id").alias(id_))


def search_radius(df: DataFrame, id_: str, vector: str, target: int, rounds: int = 24, seeds: DataFrame | None = None, scale: str | None = None) -> float:
    """The tried radius whose cover came nearest to ``target`` rows, by bisection on [0, 2], ended within 1 %."""
    low, high, best = 0.0, 2.0, None
    for _ in range(rounds):
        middle = (low + high) / 2
        n = greedy_cover(df, id_, vector, middle, seeds, scale=scale).count()
        if best is None or abs(n - target) < best[0]:
            best = (abs(n - target), middle)
        if abs(n - target) <= max(1, round(0.01 * target)):
            break
        low, high = (middle, high) if n > target else (low, middle)
    return best[1]


def content_dependence(patches: DataFrame, image: str, patch: str, vector: str, anchor: int | None = None) -> DataFrame:
    """One row, ``index``: the mean correlation of different images' maps of similarity to their own anchor patch.

    The anchor is the middle patch unless given, and its own column is left out.  Near 1 every image
    has the same map.  With maps of length 1, the sum of all pairs is that of the summed map with itself.
    """
    unit = patches.select(image, patch, l2_normalize(F.col(vector)).alias("__v"))
    at = unit.agg(F.floor((F.max(patch) + 1) / 2).cast("int").alias("__a")) if anchor is None else patches.sparkSession.createDataFrame([(anchor,)], "__a int")
    named = unit.join(F.broadcast(at))
    own = named.filter(F.col(patch) == F.col("__a")).select(image, F.col("__v").alias("__w"))
    maps = named.filter(F.col(patch) != F.col("__a")).join(own, image).select(image, patch, dot(F.col("__v"), F.col("__w")).alias("__s"))
    stats = maps.groupBy(image).agg(F.avg("__s").alias("__m"), F.sqrt(F.sum(F.col("__s") * F.col("__s")) - F.count("*") * F.avg("__s") * F.avg("__s")).alias("__n"))
    scaled = maps.join(stats, image).select(image, patch, ((F.col("__s") - F.col("__m")) / F.greatest(F.col("__n"), F.lit(1e-8))).alias("__z"))
    whole = scaled.groupBy(patch).agg(F.sum("__z").alias("__t"), F.sum(F.col("__z") * F.col("__z")).alias("__q")).agg(F.sum(F.col("__t") * F.col("__t")).alias("__t"), F.sum("__q").alias("__q"))
    n = stats.agg(F.count("*").alias("__n"))
    return whole.join(F.broadcast(n)).select(F.when(F.col("__n") > 1, (F.col("__t") - F.col("__q")) / (F.col("__n") * (F.col("__n") - 1))).alias("index"))


def collapse_metrics(df: DataFrame, logits: str, student: str, teacher: str, temperature: float = 0.1) -> DataFrame:
    """One row: the mean deviation inside a row of logits, the mean normalised entropy, and the mean cosine of student and teacher."""
    z = F.col(logits)
    n = F.size(z)
    spread = let(F.struct(z.alias("z"), (total(z) / n).alias("m")), lambda r: F.sqrt(total(F.transform(r["z"], lambda x: (x - r["m"]) * (x - r["m"]))) / (n - 1)))
    entropy = let(softmax(F.transform(z, lambda x: x / temperature)), lambda p: -total(F.transform(p, lambda x: x * F.log(x + 1e-12)))) / F.log(n.cast("double"))
    same = dot(l2_normalize(F.col(student)), l2_normalize(F.col(teacher)))
    return df.agg(F.avg(spread).alias("head_logits_std"), F.avg(entropy).alias("head_entropy"), F.avg(same).alias("teacher_student_sim"))


def farthest_points(vectors: np.ndarray, m: int) -> list[int]:
    """A diverse order: the row farthest from the mean, then always the one farthest from those taken."""
    if not len(vectors):
        return []
    d = ((vectors - vectors.mean(0)) ** 2).sum(1)
    out = [int(d.argmax())]
    best = ((vectors - vectors[out[0]]) ** 2).sum(1)
    while len(out) < min(m, len(vectors)):
        out.append(int(best.argmax()))
        best = np.minimum(best, ((vectors - vectors[out[-1]]) ** 2).sum(1))
    return out


def fit_label_model(df: DataFrame, vector: str, state: str) -> object | None:
    """A balanced logistic regression (Spark ML); none with fewer than four rows of either state."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = {r[0]: r[1] for r in df.groupBy(state).count().collect()}
    if n.get(1, 0) < 4 or n.get(0, 0) < 4:
        return None
    both = n[0] + n[1]
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(state).cast("double").alias("label"), F.when(F.col(state) == 1, both / (2 * n[1])).otherwise(both / (2 * n[0])).alias("w"))
    return LogisticRegression(weightCol="w", regParam=1.0 / both, maxIter=100).fit(rows)


def pool(tokens: Column, weights: Column) -> Column:
    """The weighted mean of an array of equal-length vectors."""
    whole = total(weights)
    zero = F.transform(F.get(tokens, F.lit(0)), lambda _: F.lit(0.0))
    added = F.aggregate(F.zip_with(tokens, weights, lambda t, w: F.transform(t, lambda x: x * w)), zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    return F.transform(added, lambda x: F.try_divide(x, whole))


def score_batches(df: DataFrame, columns: list[str], scorer: object, classes: list[str], id_: str) -> DataFrame:
    """A pluggable batch scorer: ``scorer(pandas frame)`` gives logits (rows x classes); soft-max and the first largest class."""
    kind = ", ".join([f"{id_} long", "pred_class string", "pred_prob double", *(f"`prob_{c}` double" for c in classes)])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            z = np.asarray(scorer(pdf), float).reshape(len(pdf), len(classes))
            p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
            p = p / p.sum(1, keepdims=True) if len(z) else p
            best = p.argmax(1) if len(z) else np.zeros(0, int)
            out = pd.DataFrame({id_: pdf[id_].to_numpy(), "pred_class": [classes[i] for i in best], "pred_prob": p.max(1) if len(z) else []})
            for k, c in enumerate(classes):
                out[f"prob_{c}"] = p[:, k]
            yield out

    return df.select(id_, *[c for c in columns if c != id_]).mapInPandas(run, kind)
