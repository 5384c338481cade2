"""Dense numpy kernels for features that groups and windows can't express.

``per_site`` runs any of them on pixel rows.  Rows are dealt and sorted by site, and a task takes
whole sites of about ``BATCH_PIXELS`` at a time: the kernels here work on stacks of equally
large images or object boxes, so their Python cost is per stack and not per image or object.
Kernels are registered by name in ``KERNELS``.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
#: Pixels that a task handles at a time (or one larger site).
BATCH_PIXELS = 1 << 20
#: Pixels of one stack of object boxes (or one larger box).
STACK_PIXELS = 1 << 21


def _names(on: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Each pixel of a stack of boolean images takes the smallest place (from 1) of its component; 0 where off."""
    n, h, w = on.shape
    none = on.size + 1
    name = np.where(on, np.arange(1, none).reshape(on.shape), 0)
    steps = _EIGHT if connectivity == 8 else [(0, 1), (1, 0), (0, -1), (-1, 0)]
    while True:
        padded = np.pad(np.where(on, name, none), ((0, 0), (1, 1), (1, 1)), constant_values=none)
        low = name.copy()
        for dy, dx in steps:
            low = np.where(on, np.minimum(low, padded[:, 1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx]), 0)
        # jump: a pixel takes the name of the pixel that its name points at
        flat = low.ravel()
        for _ in range(3):
            flat = np.where(flat > 0, flat[np.maximum(flat - 1, 0)], 0)
        low = flat.reshape(on.shape)
        if (low == name).all():
            return name
        name = low


def components(on: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Connected components of a boolean image, numbered from 1 in reading order."""
    name = _names(on[None], connectivity)[0]
    _, out = np.unique(np.append(name.ravel(), 0), return_inverse=True)
    return out[:-1].reshape(on.shape)


def _to_nearest(off: np.ndarray) -> np.ndarray:
    """Distance of every pixel of a stack to the nearest pixel that is off in its image; infinite without any."""
    n, h, w = off.shape
    big = 1e6
    column = np.full(off.shape, big)
    far = np.full((n, w), big)
    for y in range(h):
        far = np.where(off[:, y], 0, far + 1)
        column[:, y] = far
    far = np.full((n, w), big)
    for y in range(h - 1, -1, -1):
        far = np.where(off[:, y], 0, far + 1)
        column[:, y] = np.minimum(column[:, y], far)
    x = np.arange(w)
    square = (x[:, None] - x[None, :]) ** 2
    out = np.empty(off.shape)
    per = max(1, STACK_PIXELS // (w * w))
    for y in range(h):
        for a in range(0, n, per):
            out[a : a + per, y] = (column[a : a + per, y, None, :] ** 2 + square).min(2)
    return np.where(out >= big, np.inf, np.sqrt(out))


def distance_inside(on: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest pixel that is off; outside the image counts as off."""
    return np.where(on, _to_nearest(~np.pad(on, 1)[None])[0][1:-1, 1:-1], 0)


def geodesic(on: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Path length inside each object of a stack from its pixel ``centre`` (flat), with diagonal steps of sqrt 2; infinite where unreachable."""
    n, h, w = on.shape
    d = np.full((n, h + 2, w + 2), np.inf)
    inner = d[:, 1:-1, 1:-1]
    inner[np.arange(n), centre // w, centre % w] = 0
    while True:
        low = inner.copy()
        for dy, dx in _EIGHT:
            np.minimum(low, d[:, 1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] + (math.sqrt(2) if dy and dx else 1.0), out=low)
        low[~on] = np.inf
        if not (low < inner - 1e-12).any():
            return low
        inner[:] = low


@dataclasses.dataclass
class Boxes:
    """Objects of similar box size: their places in the object list, and stacks of what is on, inside the box, and of values."""

    which: np.ndarray
    on: np.ndarray
    inside: np.ndarray
    value: np.ndarray


def object_boxes(px: pd.DataFrame) -> tuple[pd.DataFrame, Iterator[Boxes]]:
    """The objects (site number, label) of pixel rows (site, label, y, x, value), and their boxes in stacks."""
    px = px[px["label"] > 0].sort_values(["site", "label"], kind="stable")
    key = px[["site", "label"]].drop_duplicates().reset_index(drop=True)
    if not len(key):
        return key, iter(())
    y, x, v = px["y"].to_numpy(np.int64), px["x"].to_numpy(np.int64), px["value"].to_numpy(float)
    site, label = px["site"].to_numpy(), px["label"].to_numpy()
    first = np.flatnonzero(np.append(True, (site[1:] != site[:-1]) | (label[1:] != label[:-1])))
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(px))))
    y0, x0 = np.minimum.reduceat(y, first), np.minimum.reduceat(x, first)
    h, w = np.maximum.reduceat(y, first) - y0 + 1, np.maximum.reduceat(x, first) - x0 + 1
    tall, wide = -(-h // 8) * 8, -(-w // 8) * 8

    def stacks() -> Iterator[Boxes]:
        for a, b in sorted(set(zip(tall.tolist(), wide.tolist()))):
            of = np.flatnonzero((tall == a) & (wide == b))
            per = max(1, STACK_PIXELS // (a * b))
            for k in range(0, len(of), per):
                which = of[k : k + per]
                place = np.full(len(first), -1)
                place[which] = np.arange(len(which))
                own = np.flatnonzero(place[owner] >= 0)
                on, value = np.zeros((len(which), a, b), bool), np.zeros((len(which), a, b))
                at = (place[owner[own]], y[own] - y0[owner[own]], x[own] - x0[owner[own]])
                on[at], value[at] = True, v[own]
                inside = (np.arange(a)[None, :, None] < h[which, None, None]) & (np.arange(b)[None, None, :] < w[which, None, None])
                yield Boxes(which, on, inside, value)

    return key, stacks()


def radial_stack(b: Boxes, bins: int = 4) -> dict[str, np.ndarray]:
    """Per ring from the deepest point outwards: the share of intensity, that share over the share of area, and
    the variation between eight wedges.

    Depth is the distance to the nearest pixel of the box outside the object (of a full box: to its
    border).  Pixels that the deepest point doesn't reach belong to the innermost ring.  An object without
    intensity gives zeros.
    """
    n, h, w = b.on.shape
    edge = _to_nearest(~b.on & b.inside)
    full = np.isinf(edge[:, 0, 0])
    if full.any():
        edge[full] = _to_nearest(~np.pad(b.on[full], ((0, 0), (1, 1), (1, 1))))[:, 1:-1, 1:-1]
    centre = np.where(b.on, edge, -1).reshape(n, -1).argmax(1)
    d = geodesic(b.on, centre)
    with np.errstate(invalid="ignore"):
        ring = np.where(np.isfinite(d), np.floor(d / (d + edge + 1e-3) * bins), 0)
    ring = np.clip(np.nan_to_num(ring), 0, bins - 1).astype(int)
    dy, dx = np.arange(h)[None, :, None] - (centre // w)[:, None, None], np.arange(w)[None, None, :] - (centre % w)[:, None, None]
    wedge = (dx > 0) + 2 * (dy > 0) + 4 * (np.abs(dx) > np.abs(dy))
    o, y, x = np.nonzero(b.on)
    slot = (o * bins + ring[o, y, x]) * 8 + wedge[o, y, x]
    count = np.bincount(slot, minlength=n * bins * 8).reshape(n, bins, 8)
    summed = np.bincount(slot, weights=b.value[o, y, x], minlength=n * bins * 8).reshape(n, bins, 8)
    total, area = summed.sum((1, 2)), count.sum((1, 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(total[:, None] != 0, summed.sum(2) / total[:, None], 0)
        mean = np.where(count > 0, summed / count, np.nan)
        present = (count > 0).sum(2)
        middle = np.where(present > 0, np.nansum(mean, 2) / present, 0)
        spread = np.sqrt(np.where(present > 0, np.nansum((mean - middle[:, :, None]) ** 2, 2) / present, 0))
        cv = np.where((present > 1) & (middle > 0) & (total[:, None] != 0), spread / middle, 0)
        some = (count.sum(2) > 0) & (total[:, None] != 0)
        frac = np.where(some, share / (count.sum(2) / area[:, None] + np.finfo(float).eps), 0)
    return {f"{name}_{k + 1}": v[:, k] for name, v in (("frac_at_d", share), ("mean_frac", frac), ("radial_cv", cv)) for k in range(bins)}


def radial_distribution(on: np.ndarray, value: np.ndarray, bins: int = 4) -> dict[str, float]:
    """``radial_stack`` of one object, cut to its box."""
    yy, xx = np.nonzero(on)
    if not len(yy):
        return {f"{n}_{k + 1}": 0.0 for n in ("frac_at_d", "mean_frac", "radial_cv") for k in range(bins)}
    _, boxes = object_boxes(pd.DataFrame({"site": 0, "label": 1, "y": yy, "x": xx, "value": value[yy, xx]}))
    return {k: float(v[0]) for k, v in radial_stack(next(boxes), bins).items()}


def _local(image: np.ndarray, f: Callable, fill: float) -> np.ndarray:
    """Minimum or maximum over a pixel and its four neighbours, in the last two axes."""
    p = np.pad(image, [(0, 0)] * (image.ndim - 2) + [(1, 1), (1, 1)], constant_values=fill)
    return f.reduce([p[..., 1:-1, 1:-1], p[..., :-2, 1:-1], p[..., 2:, 1:-1], p[..., 1:-1, :-2], p[..., 1:-1, 2:]])


def erode(image: np.ndarray) -> np.ndarray:
    return _local(image, np.minimum, np.inf)


def dilate(image: np.ndarray) -> np.ndarray:
    return _local(image, np.maximum, -np.inf)


def over_disk(image: np.ndarray, radius: int, f: Callable, fill: float) -> np.ndarray:
    """Minimum or maximum over a disk, in the last two axes; outside doesn't count."""
    h, w = image.shape[-2:]
    out = image.copy()
    for dy in range(-min(radius, h - 1), min(radius, h - 1) + 1):
        reach = int(math.sqrt(radius * radius - dy * dy))
        rows = image[..., max(0, dy) : h + min(0, dy), :]
        p = np.pad(rows, [(0, 0)] * (image.ndim - 1) + [(reach, reach)], constant_values=fill)
        best = f.reduce([p[..., k : k + w] for k in range(2 * reach + 1)])
        part = out[..., max(0, -dy) : h + min(0, -dy), :]
        f(part, best, out=part)
    return out


def reconstruct(seed: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Grey reconstruction: dilate under the limit until nothing changes."""
    while True:
        new = np.minimum(dilate(seed), limit)
        if (new == seed).all():
            return new
        seed = new


def sample(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Linear interpolation at the grid of ``y`` and ``x``, in the last two axes."""
    h, w = image.shape[-2:]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], x - x0
    rows = image[..., y0, :] * (1 - fy) + image[..., y1, :] * fy
    return rows[..., x0] * (1 - fx) + rows[..., x1] * fx


def shrink(image: np.ndarray, factor: float) -> np.ndarray:
    """Every ``1 / factor``-th place from the first pixel on; the size is rounded down, 1 at least."""
    h, w = (max(1, int(s * factor)) for s in image.shape[-2:])
    return image if (h, w) == image.shape[-2:] else sample(image, np.arange(h) / factor, np.arange(w) / factor)


def stretch(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """To ``shape`` with the corners kept; a side of one pixel has no scale and gives NaN."""
    if image.shape[-2:] == tuple(shape):
        return image
    if 1 in shape:
        return np.full((*image.shape[:-2], *shape), np.nan)
    y, x = (np.arange(t) * ((s - 1) / (t - 1)) for s, t in zip(image.shape[-2:], shape))
    return sample(image, y, x)


def resize(image: np.ndarray, factor: float, nearest: bool = False) -> np.ndarray:
    """Scaled about pixel centres; linear, or the nearest pixel for masks."""
    h, w = (max(1, round(s * factor)) for s in image.shape)
    y = np.clip((np.arange(h) + 0.5) / h * image.shape[0] - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) / w * image.shape[1] - 0.5, 0, image.shape[1] - 1)
    return image[np.rint(y).astype(int)][:, np.rint(x).astype(int)] if nearest else sample(image, y, x)


def granularity_stack(value: np.ndarray, mask: np.ndarray, steps: int = 16, sub: float = 0.25, background: float = 0.25, radius: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, label, spectrum) of the objects of a stack of images.

    The spectrum is the loss of an object's mean (in percent of its mean in the image itself) at each of ``steps``
    erosions with reconstruction.  These work on the shrunk image, without its background: a grey opening
    by a disk on a still smaller one.
    """
    if steps < 1 or radius < 1 or not 0 < sub <= 1 or not 0 < background <= 1:
        raise ValueError("steps and radius are at least 1, the sizes above 0 and at most 1")
    n, h, w = mask.shape
    small = shrink(value.astype(float), sub)
    back = shrink(small, background)
    opened = over_disk(over_disk(back, radius, np.minimum, np.inf), radius, np.maximum, -np.inf)
    signal = np.maximum(small - stretch(opened, small.shape[-2:]), 0)
    names, inverse, count = np.unique(np.arange(n)[:, None, None] * (int(mask.max(initial=0)) + 1) + mask, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    image, label = names // (int(mask.max(initial=0)) + 1), names % (int(mask.max(initial=0)) + 1)
    mean = lambda a: np.bincount(inverse, weights=a.ravel(), minlength=len(names)) / count
    now = mean(value)
    start = np.where(np.isfinite(now) & (now > 0), now, np.finfo(float).eps)
    now, worn, spectrum = start, signal, []
    for _ in range(steps):
        worn = erode(worn)
        after = np.nan_to_num(mean(stretch(reconstruct(worn, signal), (h, w))))
        spectrum.append((now - after) * 100 / start)
        now = after
    own = label > 0
    return image[own], label[own], np.stack(spectrum, 1)[own]


def granularity(image: np.ndarray, mask: np.ndarray, steps: int = 16, sub: float = 0.25, background: float = 0.25, radius: int = 10) -> pd.DataFrame:
    """``granularity_stack`` of one image: label, granularity_1 and so on."""
    _, label, spectrum = granularity_stack(image[None], mask[None], steps, sub, background, radius)
    return pd.DataFrame({"label": label, **{f"granularity_{k + 1}": spectrum[:, k] for k in range(steps)}})


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of (y, x) points, counter-clockwise, without collinear points."""
    pts = sorted(map(tuple, points))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def outline_features(on: np.ndarray) -> dict[str, float]:
    """Perimeter (border steps with diagonal weights), convex area, solidity and the largest Feret diameter."""
    yy, xx = np.nonzero(on)
    corners = np.unique(np.concatenate([np.stack([yy + a, xx + b], 1) for a in (-0.5, 0.5) for b in (-0.5, 0.5)]), axis=0)
    h = hull(corners)
    y, x = h[:, 0], h[:, 1]
    convex = abs((y * np.roll(x, -1) - x * np.roll(y, -1)).sum()) / 2
    feret = math.sqrt(((h[:, None] - h[None]) ** 2).sum(2).max())
    p = np.pad(on, 2)
    inner = p & np.roll(p, 1, 0) & np.roll(p, -1, 0) & np.roll(p, 1, 1) & np.roll(p, -1, 1)
    border = p & ~inner
    straight = sum((border & np.roll(border, s, a)).sum() for s, a in ((1, 0), (1, 1)))
    diagonal = sum((border & np.roll(np.roll(border, 1, 0), s, 1) & ~np.roll(border, 1, 0) & ~np.roll(border, s, 1)).sum() for s in (1, -1))
    return {"perimeter": float(straight + math.sqrt(2) * diagonal), "area_convex": float(convex), "solidity": float(on.sum() / convex) if convex else 0.0, "feret_max": float(feret)}


def fit_illumination(stack: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(flat, dark) fields of n images: level x flat + dark, with smooth fields, re-weighted against outliers.

    Each round fits a line over the images' levels at every pixel: its slope is the flat field (mean 1), its
    offset the dark field.  A dark field can hold any multiple of the flat one if the levels make up for
    it; the one that isn't correlated with the flat field is taken, and none below zero.
    """
    n, h, w = stack.shape
    x = stack.reshape(n, -1).astype(float)
    level = x.mean(1)
    weight = np.ones_like(x)
    flat, dark = np.ones(h * w), np.zeros(h * w)
    for _ in range(rounds):
        s, sl, sll = weight.sum(0), weight.T @ level, weight.T @ level**2
        sx, slx = (weight * x).sum(0), (weight * x * level[:, None]).sum(0)
        spread = np.maximum(s * sll - sl**2, 1e-12)
        slope = smooth(((s * slx - sl * sx) / spread).reshape(h, w)).ravel()
        offset = smooth(((sll * sx - sl * slx) / spread).reshape(h, w)).ravel()
        if not np.isfinite(slope).all() or slope.mean() <= 0:  # all images of one level
            slope, offset = smooth(x.mean(0).reshape(h, w)).ravel(), np.zeros(h * w)
        flat = slope / slope.mean()
        varies = flat.var() > 1e-8
        share = ((offset - offset.mean()) * (flat - 1)).mean() / flat.var() if varies else offset.mean()
        dark = np.maximum(offset - share * flat, 0)
        level = np.maximum((weight * (x - dark) * flat).sum(1) / (weight * flat**2).sum(1), 1e-9)
        miss = np.abs(x - level[:, None] * flat - dark)
        weight = 1 / (1 + miss / (np.median(miss) + 1e-9))
    return flat.reshape(h, w), dark.reshape(h, w)


def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * math.sqrt(2 / n)
    m[0] /= math.sqrt(2)
    return m


def dct2(a: np.ndarray) -> np.ndarray:
    return dct_matrix(a.shape[0]) @ a @ dct_matrix(a.shape[1]).T


def idct2(a: np.ndarray) -> np.ndarray:
    return dct_matrix(a.shape[0]).T @ a @ dct_matrix(a.shape[1])


def smooth(a: np.ndarray, keep: float = 0.25) -> np.ndarray:
    c = dct2(a)
    ky, kx = (max(1, math.ceil(s * keep)) for s in a.shape)
    c[ky:] = 0
    c[:, kx:] = 0
    return idct2(c)


def correct_illumination(image: np.ndarray, flat: np.ndarray, dark: np.ndarray) -> np.ndarray:
    """(image - dark) / flat, clipped to the range of an integer image's type."""
    out = (image - dark) / np.maximum(flat, 1e-9)
    if np.issubdtype(image.dtype, np.integer):
        lim = np.iinfo(image.dtype)
        return np.clip(np.rint(out), lim.min, lim.max).astype(image.dtype)
    return out


def to_image(pdf: pd.DataFrame, column: str, dtype: type = float) -> np.ndarray:
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), dtype)
    out[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf[column].to_numpy()
    return out


def image_stacks(px: pd.DataFrame, columns: dict[str, type]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Sites (by number) of one image size, and a stack of images for each column."""
    size = px.groupby("site", sort=True)[["y", "x"]].max() + 1
    for (h, w), part in size.groupby(["y", "x"]):
        sites = part.index.to_numpy()
        own = px[px["site"].isin(sites)]
        at = (np.searchsorted(sites, own["site"].to_numpy()), own["y"].to_numpy(int), own["x"].to_numpy(int))
        stacks = []
        for name, kind in columns.items():
            stack = np.zeros((len(sites), int(h), int(w)), kind)
            stack[at] = own[name].to_numpy()
            stacks.append(stack)
        yield sites, stacks


def _threshold_rows(px: pd.DataFrame, threshold: float) -> pd.DataFrame:
    out = []
    for sites, (value,) in image_stacks(px, {"value": float}):
        on = value >= threshold
        name = _names(on)
        first = (name > 0) & (name == np.arange(1, name.size + 1).reshape(name.shape))
        area, count = on.sum((1, 2)).astype(float), first.sum((1, 2)).astype(float)
        out.append(pd.DataFrame({"site": sites, "object_area": area, "object_count": count, "object_mean_area": area / np.maximum(count, 1)}))
    return pd.concat(out)


def _radial_rows(px: pd.DataFrame, bins: int = 4) -> pd.DataFrame:
    key, stacks = object_boxes(px)
    parts = [pd.DataFrame(radial_stack(b, int(bins)), index=b.which) for b in stacks]
    return key.join(pd.concat(parts)) if parts else key


def _outline_rows(px: pd.DataFrame) -> pd.DataFrame:
    key, stacks = object_boxes(px)
    parts = [pd.DataFrame([outline_features(on) for on in b.on], index=b.which) for b in stacks]
    return key.join(pd.concat(parts)) if parts else key


def _granularity_rows(px: pd.DataFrame, steps: int = 16, **options: float) -> pd.DataFrame:
    out = []
    for sites, (value, mask) in image_stacks(px, {"value": float, "label": int}):
        image, label, spectrum = granularity_stack(value, mask, int(steps), **options)
        out.append(pd.DataFrame({"site": sites[image], "label": label, **{f"granularity_{k + 1}": spectrum[:, k] for k in range(spectrum.shape[1])}}))
    return pd.concat(out)


#: name -> kernel on the pixels of several sites (columns site, y, x, value and, for objects, label).
KERNELS: dict[str, Callable[..., pd.DataFrame]] = {"threshold_objects": _threshold_rows, "radial": _radial_rows, "outline": _outline_rows, "granularity": _granularity_rows}


def register_kernel(name: str, f: Callable[..., list[dict]]) -> None:
    """An extension point: ``f(pixels of one site, **options)`` gives dictionaries of features."""

    def rows(px: pd.DataFrame, **options: float) -> pd.DataFrame:
        return pd.DataFrame([{"site": k, **r} for k, part in px.groupby("site") for r in f(part.drop(columns="site"), **options)])

    KERNELS[name] = rows


def whole_sites(frames: Iterable[pd.DataFrame], site: list[str]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Rows sorted by site in frames of whole sites of about ``BATCH_PIXELS``, with their keys by number; ``site`` is the number."""

    def numbered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        code = pdf.groupby(site, dropna=False, sort=False).ngroup().to_numpy()
        first = np.unique(code, return_index=True)[1]
        return pdf[site].iloc[first].reset_index(drop=True), pdf.drop(columns=site).assign(site=code)

    held: list[pd.DataFrame] = []
    rows, limit = 0, BATCH_PIXELS
    for pdf in frames:
        held.append(pdf)
        rows += len(pdf)
        if rows >= limit:
            whole = pd.concat(held, ignore_index=True)
            code = whole.groupby(site, dropna=False, sort=False).ngroup().to_numpy()
            cut = int(np.searchsorted(code, code[-1]))
            if cut:
                yield numbered(whole.iloc[:cut])
            held, rows = [whole.iloc[cut:]], len(whole) - cut
            limit = max(BATCH_PIXELS, 2 * rows)
    if rows:
        yield numbered(pd.concat(held, ignore_index=True))


def per_site(px: DataFrame, site: list[str], kernel: str, features: list[str], **options: float) -> DataFrame:
    """A kernel's features (doubles; ``label`` long) for every site; a failing site gives no row here, see ``bad_sites``."""
    f = KERNELS[kernel]
    kinds = {s: px.schema[s].dataType.simpleString() for s in site}
    schema = ", ".join([*(f"`{s}` {t}" for s, t in kinds.items()), *(f"`{c}` {'long' if c == 'label' else 'double'}" for c in features)])

    def one(rows: pd.DataFrame) -> pd.DataFrame | None:
        try:
            return f(rows, **options)
        except (ValueError, IndexError, FloatingPointError):
            return None

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, rows in whole_sites(frames, [f"__{s}" for s in site]):
            got = one(rows)
            if got is None:  # find the failing ones
                got = pd.concat([g for _, part in rows.groupby("site") if (g := one(part)) is not None] or [pd.DataFrame({"site": []})])
            if len(got):
                out = keys.iloc[got["site"].to_numpy(int)].reset_index(drop=True)
                out.columns = site
                yield out.join(got.reset_index(drop=True).reindex(columns=features))

    taken = px.select(*(F.col(s).alias(f"__{s}") for s in site), *(c for c in ("y", "x", "value", "label") if c in px.columns and c not in site))
    return taken.repartition(*(f"__{s}" for s in site)).sortWithinPartitions(*(f"__{s}" for s in site)).mapInPandas(run, schema)


def map_images(px: DataFrame, site: list[str], f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Every site's image (y, x, value) through ``f``, as pixel rows again; a task holds whole sites."""
    kinds = {s: px.schema[s].dataType.simpleString() for s in site}
    schema = ", ".join([*(f"`{s}` {t}" for s, t in kinds.items()), "y int", "x int", "value double"])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, rows in whole_sites(frames, [f"__{s}" for s in site]):
            for k, part in rows.groupby("site"):
                image = f(to_image(part, "value"))
                y, x = np.indices(image.shape)
                out = keys.iloc[np.full(image.size, k)].reset_index(drop=True)
                out.columns = site
                yield out.assign(y=y.ravel(), x=x.ravel(), value=image.ravel().astype(float))

    taken = px.select(*(F.col(s).alias(f"__{s}") for s in site), "y", "x", "value")
    return taken.repartition(*(f"__{s}" for s in site)).sortWithinPartitions(*(f"__{s}" for s in site)).mapInPandas(run, schema)


def resize_images(px: DataFrame, site: list[str], factor: float, nearest: bool = False) -> DataFrame:
    """Images scaled linearly, masks (``nearest``) by the nearest pixel."""
    return map_images(px, site, lambda image: resize(image, factor, nearest))


def fit_fields(px: DataFrame, keys: list[str], site: list[str], n_images: int = 50, seed: int = 0) -> DataFrame:
    """flat and dark by ``keys`` (a channel), y and x, fitted on up to ``n_images`` images of each key, chosen by a hash.

    The bound is the fit's sample; a task holds that many images of one channel.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *site), *site)
    chosen = px.select(*keys, *site).distinct().withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n_images)
    kinds = ", ".join(f"`{k}` {px.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        numbered = pdf.rename(columns={"__n": "site"})
        stack = max((v[0] for _, v in image_stacks(numbered, {"value": float})), key=len)  # the most frequent size
        flat, dark = fit_illumination(stack)
        y, x = np.indices(flat.shape)
        out = pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "flat": flat.ravel(), "dark": dark.ravel()})
        for k, v in zip(reversed(keys), reversed(key)):
            out.insert(0, k, v)
        return out

    rows = px.join(chosen, [*keys, *site]).select(*keys, "__n", "y", "x", F.col("value").cast("double").alias("value"))
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, y int, x int, flat double, dark double")


def apply_fields(px: DataFrame, fields: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(value - dark) / flat at every pixel; an integer column is rounded and kept in its range."""
    kind = px.schema[value].dataType.simpleString()
    new = (F.col(value) - F.col("dark")) / F.greatest(F.col("flat"), F.lit(1e-9))
    limits = {"tinyint": 8, "smallint": 16, "int": 32}
    if kind in limits:
        top = 2 ** (limits[kind] - 1)
        new = F.greatest(F.lit(-top), F.least(F.lit(top - 1), F.bround(new, 0)))
    return px.join(fields, [*keys, "y", "x"]).withColumn(value, new.cast(kind)).drop("flat", "dark")


def bad_sites(px: DataFrame, result: DataFrame, site: list[str]) -> DataFrame:
    """Sites that gave no row: to be looked at, not deleted."""
    return px.select(*site).distinct().join(result.select(*site).distinct(), site, "left_anti")
