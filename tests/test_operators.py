import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspark.operators import cluster, embed, filters, fuse, kernels, labels, pixels, plate, sampling


def rows(df, *order):
    return sorted((tuple(r) for r in df.select(*order).collect()), key=str) if order else sorted((tuple(r) for r in df.collect()), key=str)


# --- fusion


def test_null_keys_match_and_repeats_fan_out(spark):
    a = spark.createDataFrame([("d", 1, 10.0), (None, 1, 20.0), ("d", 2, 30.0)], "directory string, label int, area double")
    b = spark.createDataFrame([("d", 1, 0.5), ("d", 1, 0.6), (None, 1, 0.7), ("e", 1, 0.8)], "directory string, label int, p double")
    out = fuse.fuse_pair(a, fuse.Source(b, "t", "s"))
    assert rows(out) == sorted([("d", 1, 10.0, 0.5), ("d", 1, 10.0, 0.6), (None, 1, 20.0, 0.7), ("d", 2, 30.0, None), ("e", 1, None, 0.8)], key=str)


def test_pairs_of_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(fuse, "CELL_ROWS", 8)
    a = spark.createDataFrame([(None if i % 2 else f"d{i % 40}", i % 5 % 2, i, float(i % 7)) for i in range(400)], "directory string, label int, site int, area double")
    b = spark.createDataFrame([(None if i % 3 else f"d{i % 60}", i % 4 % 3, i % 90, 0.5) for i in range(300)], "directory string, label int, site int, p double").withColumn("label", F.when(F.col("label") < 2, F.col("label")))
    for left, right in ((a, b), (b, a), (a, b.filter("p > 1")), (a.filter("site % 2 = 0"), b)):
        source = fuse.Source(right, "t", "s")
        plain, spread = fuse.fuse_pair(left, source), fuse.fuse_pair(left, source, spread=True)
        assert spread.dtypes == plain.dtypes and rows(spread) == rows(plain)
    got = fuse.fuse_pair(a, fuse.Source(b, "t", "s"), spread=True).filter("directory is null and label = 0").groupBy(F.spark_partition_id()).count().collect()
    whole = sum(r[1] for r in got)
    assert len(got) > 8 and max(r[1] for r in got) < whole / 4


@pytest.mark.parametrize("wide_keys", [0, 1, 32])
def test_rows_of_very_hot_keys_are_read_again_instead_of_copied(spark, monkeypatch, wide_keys):
    """A row of a very hot key is dealt once; beyond the wide keys it is copied a bounded number of times."""
    monkeypatch.setattr(fuse, "CELL_ROWS", 2)
    monkeypatch.setattr(fuse, "WIDE_KEYS", wide_keys)
    a = spark.createDataFrame([(None if i % 5 else "d", i % 2, i, 1.0) for i in range(200)], "directory string, label int, site int, area double")
    b = spark.createDataFrame([(None if i % 4 else "e", i % 2, i, 0.5) for i in range(160)], "directory string, label int, uid int, p double")
    source = fuse.Source(b, "t", "s")
    plain, spread = fuse.fuse_pair(a, source), fuse.fuse_pair(a, source, spread=True)
    assert rows(spread) == rows(plain)
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert ("CartesianProduct" in plan) == (wide_keys > 0)
    assert ("Generate explode" in plan) == (wide_keys < 2)


def test_without_a_label_sources_are_stacked(spark):
    a = spark.createDataFrame([("A1", 1.0)], "well string, x double")
    b = spark.createDataFrame([("A1", 2.0)], "well string, y double")
    assert rows(fuse.fuse_pair(a, fuse.Source(b, "t", "s"))) == [("A1", 1.0, None), ("A1", None, 2.0)]


def test_collisions_are_renamed_or_dropped(spark):
    a = spark.createDataFrame([(1, 1.0, "x")], "label int, area double, tag string")
    b = spark.createDataFrame([(1, 2.0, "x")], "label int, area double, tag string")
    assert fuse.fuse_pair(a, fuse.Source(b, "t", "s")).columns == ["label", "area", "tag", "s/area", "s/tag"]
    assert fuse.fuse_pair(a, fuse.Source(b, "t", "s"), drop_identical=True).columns == ["label", "area", "tag", "s/area"]


def test_prefixes_masks_and_unknown_mask(spark):
    a = spark.createDataFrame([("d", 1, "p")], "directory string, label int, pred_class string")
    two = fuse.fuse_sources([fuse.Source(a, "t", "a", "cell", True, "m1"), fuse.Source(a, "t", "b", "cell", True, "m2")])
    assert two.columns == ["directory", "label", "m1_pred_class", "m2_pred_class"]
    alone = fuse.fuse_sources([fuse.Source(a, "t", "a", "cell", True, "m1")])
    assert alone.columns == a.columns
    mixed = fuse.fuse_sources([fuse.Source(a, "t", "a", "cell"), fuse.Source(a.withColumnRenamed("pred_class", "q"), "t", "b", None)])
    assert "mask" not in mixed.columns and mixed.count() == 1
    stacked = fuse.fuse_sources([fuse.Source(a, "t", "a", "cell"), fuse.Source(a, "t", "b", "nuclei")])
    assert {r["mask"] for r in stacked.collect()} == {"cell", "nuclei"}


def test_odd_column_names(spark):
    a = spark.createDataFrame([(1, 2.0)], 'label int, `prob_we"ird` double')
    b = spark.createDataFrame([(1, 3.0)], "label int, `cluster_res_0.5` double")
    assert rows(fuse.fuse_pair(a, fuse.Source(b, "t", "s"))) == [(1, 2.0, 3.0)]


def test_one_shuffle_fusion_equals_joins(spark):
    a = spark.createDataFrame([(None, 1, 1.0), ("d", 1, 2.0)], "directory string, label int, a double")
    b = spark.createDataFrame([(None, 1, 3.0), ("e", 1, 4.0)], "directory string, label int, b double")
    s = [fuse.Source(a, "t", "a"), fuse.Source(b, "t", "b")]
    assert rows(fuse.fuse_unique(s, ["directory", "label"])) == rows(fuse.fuse_pair(a, s[1]))


def test_upsert_replaces_null_folders_too(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "directory string, v int")
    new = spark.createDataFrame([("b", 9, "x"), (None, 8, "y")], "directory string, v int, extra string")
    assert rows(fuse.upsert(old, new)) == sorted([("a", 1, None), ("b", 9, "x"), (None, 8, "y")], key=str)
    assert rows(fuse.upsert(fuse.upsert(old, new), new)) == rows(fuse.upsert(old, new))


def test_masks_keep_the_null_tag(spark):
    df = spark.createDataFrame([("cell", 1), (None, 2)], "mask string, label int")
    assert [(t, d.count()) for t, d in fuse.read_masks(df)] == [(None, 1), ("cell", 1)]


def test_plate_metadata(spark):
    df = spark.createDataFrame([("a01", 1), ("B2", 2), (None, 3)], "well string, batch int")
    meta = spark.createDataFrame([("A1", 7, "c"), ("b02", 8, "d")], "well string, batch int, condition string")
    assert rows(fuse.join_plate_metadata(df, meta)) == sorted([("a01", 1, "c"), ("B2", 2, "d"), (None, 3, None)], key=str)
    matrix = spark.createDataFrame([("A", "1", None), ("B", " ", "2")], "row string, `1` string, `2` string")
    long = fuse.unpivot_plate(matrix, "row", "v")
    assert rows(long) == [("A1", "1"), ("B2", "2")] and fuse.numeric_if_all(long, ["v"]).schema["v"].dataType.simpleString() == "double"


def test_repeated_keys_are_refused(spark):
    with pytest.raises(ValueError, match="repeated"):
        fuse.refuse_duplicates(spark.createDataFrame([("a",), ("a",)], "p string"), "p")


# --- filters


def test_regex_filter(spark):
    df = spark.createDataFrame([("src10",), ("x",), (None,)], "v string")
    assert rows(filters.filter_regex(df, "v", "1")) == [("src10",)]
    for bad in (("w", "x"), ("v", ""), ("v", "(")):
        with pytest.raises(Exception):
            filters.filter_regex(df, *bad)


def test_expression_filter(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (None, "d")], "v int, s string")
    assert rows(filters.filter_expression(df, "(v > 1) | (s == 'a b')")[0]) == [(1, "a b"), (2, "c")]
    assert rows(filters.filter_expression(df, "not (v in [1, 5]) and s != 'z'")[0]) == [(2, "c")]
    assert filters.filter_expression(df, "  ")[0].count() == 3 and filters.filter_expression(df, "v > ")[1] and filters.filter_expression(df, "nope == 1")[1]


def test_lookup_order_and_scope(spark):
    df = spark.createDataFrame([("A1", "1", "p/x"), ("A2", "1", "p/xy"), ("a01", "2", "p/x/z")], "well string, field string, directory string")
    assert [tuple(r)[:2] for r in filters.lookup_rows(df, ["A2", "A1"], ["2", "1"]).collect()] == [("A2", "1"), ("a01", "2"), ("A1", "1")]
    assert filters.scope_by_directory(df, ["p/x"]).count() == 2 and filters.scope_by_directory(df, ["q"]).count() == 3 and filters.scope_by_directory(df, ["."]).count() == 3


def test_continuous_colours(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("a"), F.lit("1").alias("b"), F.lit(1.0).alias("prob_x"), F.col("id").alias("cluster_res_1"))
    assert [filters.color_is_continuous(df, c) for c in df.columns] == [True, False, True, False]


# --- plate


def test_well_aggregates(spark):
    df = spark.createDataFrame([("A1", 1.0, None, 2), ("A1", 3.0, "y", 1), ("B1", None, "z", 1), ("C1", 5.0, None, 1), (None, 9.0, "n", 1)], "well string, v double, t string, o int")
    assert rows(plate.aggregate_by_well(df, "v")) == [("A1", 2.0), ("C1", 5.0)]
    assert rows(plate.aggregate_by_well(df, "v", "sum")) == [("A1", 4.0), ("B1", 0.0), ("C1", 5.0)]
    assert rows(plate.aggregate_by_well(df, "v", "std")) == [("A1", pytest.approx(2**0.5))]
    assert rows(plate.aggregate_by_well(df, "t", order="o")) == [("A1", "y"), ("B1", "z")]


def test_sem_box_and_size(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 1.0), (None, 1.0), ("b", None)], "g string, v double")
    sem = {r["g"]: r for r in plate.mean_sem(df, ["g"], "v").collect()}
    assert sem["a"]["mean"] == 22 and sem["b"]["sem"] is None and set(sem) == {"a", "b"}
    box = {r["g"]: r for r in plate.box_stats(df, ["g"], "v").collect()}["a"]
    assert (box["q1"], box["median"], box["q3"], box["whisker_low"], box["whisker_high"]) == (2, 3, 4, 1, 4)
    assert tuple(plate.plate_size(spark.createDataFrame([("H12",), ("AA3",), ("x",)], "well string")).first()) == (27, 12)


def test_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    s = {r["class"]: r["f1"] for r in plate.class_scores(df, "t", "p").collect()}
    assert s == {"a": 0.5, "b": pytest.approx(2 / 3), "c": 0.0}
    assert plate.accuracy_macro_f1(df, "t", "p").first()["accuracy"] == 0.5
    assert {r["truth"]: 1 for r in plate.confusion(df, "t", "p").groupBy("truth").agg(F.sum("share").alias("s")).filter("abs(s - 1) < 1e-9").collect()} == {"a": 1, "b": 1, "c": 1}


# --- labels


def test_label_history_and_exact_undo(spark):
    log = spark.createDataFrame([], labels.LOG)
    undone = spark.createDataFrame([], "op_id long")
    cell = lambda *ids: spark.createDataFrame([(i,) for i in ids], "cell_id long")
    states = lambda: rows(labels.current_states(log))
    log = labels.apply_batch(log, cell(1, 2), [5], 1)
    log = labels.apply_batch(log, cell(2), [5], 0)
    log = labels.apply_batch(log, cell(1), [6], 1, single=True)
    assert states() == [(1, 6, 1), (2, 5, 0)]
    log, undone = labels.undo(log, undone, 1)
    assert states() == [(1, 5, 1), (2, 5, 0)]
    log, undone = labels.undo(log, undone, 1)
    assert states() == [(1, 5, 1), (2, 5, 1)]
    log, undone = labels.undo(log, undone, 1)
    assert states() == []
    same, _ = labels.undo(log, undone, 1)
    assert same.count() == log.count()
    log = labels.apply_batch(log, cell(3), [5], None)
    assert states() == []


def test_registry(spark):
    reg = spark.createDataFrame([], "label_id long, name string, color string, sort_order int")
    for n in ("x", "y", "x"):
        reg = labels.add_label(reg, n, ["red", "blue"])
    assert rows(reg) == [(1, "x", "red", 0), (2, "y", "blue", 1)]
    assert rows(labels.reorder_labels(reg, [2, 1]), "label_id", "sort_order") == [(1, 1), (2, 0)]
    cells = labels.register_cells(spark.createDataFrame([(1, "a", "p")], "cell_id long, filepath string, preset string"), spark.createDataFrame([("b", "q"), ("a", "r"), ("b", "q")], "filepath string, preset string"))
    assert rows(cells) == [(1, "a", "r"), (2, "b", "q")]


# --- pixels


def image(spark, a, name="value", **extra):
    a = np.asarray(a)
    data = [(0, int(y), int(x), a[y, x].item(), *(np.asarray(v)[y, x].item() for v in extra.values())) for y in range(a.shape[0]) for x in range(a.shape[1])]
    kind = "int" if a.dtype.kind in "iu" else "double"
    return spark.createDataFrame(data, f"site int, y int, x int, {name} {kind}" + "".join(f", {k} {'int' if np.asarray(v).dtype.kind in 'iu' else 'double'}" for k, v in extra.items()))


def brute_edge_ratio(mask, tol):
    h, w = mask.shape
    out = {}
    for k in np.unique(mask[mask > 0]):
        border = [(y, x) for y in range(h) for x in range(w) if mask[y, x] == k and any(not (0 <= y + a < h and 0 <= x + b < w) or mask[y + a, x + b] != k for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
        near = [(y, x) for y, x in border if y < tol or x < tol or y >= h - tol or x >= w - tol]
        out[int(k)] = len(near) / len(border)
    return out


def test_edge_ratio_against_brute_force(spark):
    rng = np.random.default_rng(1)
    mask = np.zeros((12, 14), int)
    for k in range(1, 6):
        y, x = rng.integers(0, 9), rng.integers(0, 10)
        mask[y : y + rng.integers(1, 6), x : x + rng.integers(1, 6)] = k
    got = {r["label"]: r["edge_pixel_ratio"] for r in pixels.edge_pixel_ratio(image(spark, mask, "label"), ["site"], F.lit(12), F.lit(14)).collect()}
    assert got == pytest.approx(brute_edge_ratio(mask, 2))


def test_parent_majority_ties_and_background(spark):
    child, parent = np.array([[1, 1, 2, 2], [0, 3, 3, 3]]), np.array([[5, 4, 0, 0], [7, 7, 7, 9]])
    out = pixels.parent_majority(image(spark, child, "label"), image(spark, parent, "label"), ["site", "y", "x"], ["site"])
    assert rows(out, "child", "parent") == [(1, 4), (2, 0), (3, 7)]


def test_profiles_and_normalisation(spark):
    px = image(spark, np.zeros((3, 3)))
    r = pixels.image_profile(px, ["site"]).first()
    assert r["mean"] == 0 and r["p99_9"] == 0
    assert {x["normalized"] for x in pixels.normalize(px, ["site"]).collect()} == {0.0}
    v = np.arange(9.0).reshape(3, 3)
    z = sorted(x["normalized"] for x in pixels.normalize(image(spark, v), ["site"]).collect())
    assert z == pytest.approx(sorted((v - v.mean()).ravel() / v.std()))


def test_crop_and_projection(spark):
    mask = np.array([[1, 1, 2], [0, 1, 2]])
    out = pixels.crops(image(spark, mask * 10.0), image(spark, mask, "label"), ["site"], F.lit(2), F.lit(3), 0)
    assert rows(out.filter("label = 1"), "y", "x", "value") == [(0, 0, 10.0), (0, 1, 10.0), (1, 0, 0.0), (1, 1, 10.0)]
    px = image(spark, [[1.0, 2.0]]).unionByName(image(spark, [[2.0, 5.0]]))
    assert rows(pixels.z_project(px, ["site"], "mean"), "x", "value") == [(0, 2.0), (1, 4.0)]


# --- kernels


def test_components_and_distance():
    a = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool)
    assert kernels.components(a).tolist() == [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 0, 3]]
    assert kernels.components(a, 4).max() == 4
    rng = np.random.default_rng(0)
    on = rng.random((9, 11)) < 0.8
    p = np.pad(on, 1)
    off = np.argwhere(~p) - 1
    want = np.array([[0 if not on[y, x] else np.sqrt(((off - (y, x)) ** 2).sum(1).min()) for x in range(11)] for y in range(9)])
    assert np.allclose(kernels.distance_inside(on), want)


def test_radial_on_a_disk():
    yy, xx = np.indices((64, 64))
    disk = (yy - 32) ** 2 + (xx - 32) ** 2 <= 400
    r = kernels.radial_distribution(disk, np.ones((64, 64)))
    assert sum(r[f"frac_at_d_{k}"] for k in range(1, 5)) == pytest.approx(1) and all(r[f"radial_cv_{k}"] == pytest.approx(0) for k in range(1, 5))
    assert set(kernels.radial_distribution(disk, np.zeros((64, 64))).values()) == {0.0}


def test_outline_of_a_square():
    on = np.zeros((14, 14), bool)
    on[2:12, 2:12] = True
    f = kernels.outline_features(on)
    assert f["area_convex"] == 100 and f["solidity"] == 1 and f["feret_max"] == pytest.approx(np.hypot(10, 10)) and f["perimeter"] == pytest.approx(36)


def test_dct_and_illumination():
    rng = np.random.default_rng(1)
    a = rng.random((8, 6))
    assert np.allclose(kernels.idct2(kernels.dct2(a)), a)
    yy, xx = np.indices((16, 16))
    flat = 1 + 0.3 * np.cos(np.pi * (yy + 0.5) / 16)
    flat /= flat.mean()
    stack = np.stack([flat * level for level in (50, 80, 120, 60, 90)]) + rng.normal(0, 0.1, (5, 16, 16))
    got, dark = kernels.fit_illumination(stack)
    assert np.abs(got - flat).max() < 0.01 and np.abs(dark).max() < 1
    offset = 40 + 10 * np.sin(np.pi * xx / 16)
    stack = np.stack([flat * level + offset for level in rng.uniform(50, 300, 60)]) + rng.normal(0, 1, (60, 16, 16))
    got, dark = kernels.fit_illumination(stack)
    assert np.abs(got - flat).max() < 0.01 and np.abs(dark - offset).max() < 2
    assert kernels.correct_illumination(np.full((16, 16), 300, np.uint8 if False else np.uint16), got, dark).dtype == np.uint16


def test_granularity_is_brightness_invariant():
    rng = np.random.default_rng(2)
    v, m = rng.random((20, 20)), np.zeros((20, 20), int)
    m[3:15, 3:15] = 1
    a, b = (kernels.granularity(v * k, m, 3, 1.0, 1.0, 2) for k in (1, 7))
    assert np.allclose(a.filter(like="granularity"), b.filter(like="granularity"))


def plain_granularity(v, m, steps, sub, background, radius):
    """The same by loops over pixels."""

    def at(a, y, x):
        y0, x0 = int(np.floor(y)), int(np.floor(x))
        y1, x1 = min(y0 + 1, a.shape[0] - 1), min(x0 + 1, a.shape[1] - 1)
        fy, fx = y - y0, x - x0
        return (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy

    def smaller(a, f):
        h, w = (max(1, int(s * f)) for s in a.shape)
        return a if (h, w) == a.shape else np.array([[at(a, y / f, x / f) for x in range(w)] for y in range(h)])

    def larger(a, shape):
        h, w = shape
        return a if a.shape == shape else np.array([[at(a, y * (a.shape[0] - 1) / (h - 1), x * (a.shape[1] - 1) / (w - 1)) for x in range(w)] for y in range(h)])

    def around(a, r, f):
        h, w = a.shape
        return np.array([[f(a[j, i] for j in range(h) for i in range(w) if (j - y) ** 2 + (i - x) ** 2 <= r * r) for x in range(w)] for y in range(h)])

    small = smaller(v.astype(float), sub)
    back = around(around(smaller(small, background), radius, min), radius, max)
    signal = np.maximum(small - larger(back, small.shape), 0)
    names = [k for k in np.unique(m) if k]
    start = [v[m == k].mean() for k in names]
    now, worn, out = list(start), signal, []
    for _ in range(steps):
        worn = around(worn, 1, min)
        rec = worn
        while True:
            new = np.minimum(around(rec, 1, max), signal)
            if (new == rec).all():
                break
            rec = new
        after = [larger(rec, v.shape)[m == k].mean() for k in names]
        out.append([100 * (a - b) / s for a, b, s in zip(now, after, start)])
        now = after
    return names, np.array(out).T


def test_granularity_against_loops():
    rng = np.random.default_rng(8)
    v, m = rng.random((26, 31)) * 100, np.zeros((26, 31), int)
    m[2:14, 3:15], m[15:25, 10:30] = 4, 9
    for options in ((4, 0.5, 0.5, 2), (3, 1.0, 0.25, 10), (16, 0.25, 0.25, 10)):
        names, want = plain_granularity(v, m, *options)
        got = kernels.granularity(v, m, *options)
        assert got["label"].tolist() == names and np.allclose(got.drop(columns="label"), want)


def plain_radial(on, value, bins=4):
    """The same by a shortest-path search over pixels; the object is cut to its box."""
    import heapq

    yy, xx = np.nonzero(on)
    on, value = (a[yy.min() : yy.max() + 1, xx.min() : xx.max() + 1] for a in (on, value))
    off = np.argwhere(~on)
    h, w = on.shape
    if not len(off):
        off = np.array([(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1) if y in (-1, h) or x in (-1, w)])
    edge = np.array([[np.sqrt(((off - (y, x)) ** 2).sum(1).min()) if on[y, x] else -1 for x in range(w)] for y in range(h)])
    cy, cx = np.unravel_index(edge.argmax(), edge.shape)
    d, heap = {(cy, cx): 0.0}, [(0.0, cy, cx)]
    while heap:
        cost, y, x = heapq.heappop(heap)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                p = (y + dy, x + dx)
                if 0 <= p[0] < h and 0 <= p[1] < w and on[p] and cost + np.hypot(dy, dx) < d.get(p, np.inf) - 1e-12:
                    d[p] = cost + np.hypot(dy, dx)
                    heapq.heappush(heap, (d[p], *p))
    rings, total = {}, value[on].sum()
    for y, x in np.argwhere(on).tolist():
        k = min(bins - 1, int(d[y, x] / (d[y, x] + edge[y, x] + 1e-3) * bins)) if (y, x) in d else 0
        rings.setdefault(k, []).append((value[y, x], (x > cx) + 2 * (y > cy) + 4 * (abs(x - cx) > abs(y - cy))))
    out = {}
    for k in range(bins):
        v = rings.get(k, [])
        share = sum(a for a, _ in v) / total
        means = np.array([np.mean([a for a, b in v if b == q]) for q in sorted({b for _, b in v})])
        out |= {f"frac_at_d_{k + 1}": share, f"mean_frac_{k + 1}": share / (len(v) / on.sum()) if v else 0.0, f"radial_cv_{k + 1}": means.std() / means.mean() if len(means) > 1 and means.mean() > 0 else 0.0}
    return out


def test_radial_against_a_path_search():
    rng = np.random.default_rng(5)
    for size, share in ((9, 0.5), (14, 0.75), (7, 1.0), (23, 0.85)):
        on = rng.random((size, size + 3)) < share
        on[3, 3] = True
        value = rng.random(on.shape)
        got, want = kernels.radial_distribution(on, value), plain_radial(on, value)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_kernels_take_many_sites_at_a_time(spark, monkeypatch):
    """The same features whatever the batch, for sites of several sizes, null keys and objects of any box."""
    rng = np.random.default_rng(6)
    rows = []
    for site in range(12):
        h, w = rng.integers(4, 30, 2)
        mask = rng.integers(0, 3, (h, w))
        rows += [(None if site == 5 else site, int(y), int(x), int(mask[y, x]), float(rng.random())) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "site long, y int, x int, label int, value double").cache()
    names = {"radial": ["label", "frac_at_d_1", "radial_cv_4"], "granularity": ["label", "granularity_1"], "outline": ["label", "perimeter", "solidity"], "threshold_objects": ["object_area", "object_count"]}
    options = {"granularity": {"steps": 2, "sub": 0.5}, "threshold_objects": {"threshold": 0.5}}
    for kernel, features in names.items():
        seen = []
        for batch, stack in ((1 << 20, 1 << 21), (100, 64)):
            monkeypatch.setattr(kernels, "BATCH_PIXELS", batch)
            monkeypatch.setattr(kernels, "STACK_PIXELS", stack)
            seen.append(sorted((tuple(r) for r in kernels.per_site(px, ["site"], kernel, features, **options.get(kernel, {})).collect()), key=str))
        assert seen[0] == seen[1] and len({r[0] for r in seen[0]}) == 12


def test_a_failing_site_gives_no_row(spark):
    def only_small(pdf, **_):
        if len(pdf) > 3:
            raise ValueError("too large")
        return [{"n": float(len(pdf))}]

    kernels.register_kernel("only_small", only_small)
    px = image(spark, [[1.0, 2.0]]).unionByName(image(spark, [[1.0] * 5]).withColumn("site", F.lit(9).cast("long")))
    got = kernels.per_site(px, ["site"], "only_small", ["n"])
    assert [r["n"] for r in got.collect()] == [2.0] and [r["site"] for r in kernels.bad_sites(px, got, ["site"]).collect()] == [9]


def test_illumination_and_sizes_of_tables(spark):
    rng = np.random.default_rng(3)
    yy, xx = np.indices((12, 10))
    flat = 1 + 0.2 * np.cos(np.pi * (yy + 0.5) / 12)
    flat /= flat.mean()
    rows = [("a", k, int(y), int(x), float(v)) for k, level in enumerate(rng.uniform(50, 200, 20)) for (y, x), v in np.ndenumerate(flat * level + 30)]
    px = spark.createDataFrame(rows, "channel string, site long, y int, x int, value double")
    fields = kernels.fit_fields(px, ["channel"], ["site"])
    even = kernels.apply_fields(px, fields, ["channel"]).groupBy("site").agg(F.stddev_pop("value").alias("s"), F.avg("value").alias("m"))
    assert fields.count() == 120 and all(r["s"] < 0.02 * r["m"] for r in even.collect())
    half = kernels.resize_images(px.drop("channel"), ["site"], 0.5)
    assert half.groupBy("site").agg(F.count("*").alias("n")).filter("n = 30").count() == 20
    mask = px.select("site", "y", "x", (F.col("x") > 4).cast("double").alias("value"))
    assert {r["value"] for r in kernels.resize_images(mask, ["site"], 2.0, True).select("value").distinct().collect()} == {0.0, 1.0}


# --- embeddings, clusters, samples


def blobs(spark, k=3, n=12, dim=16, noise=0.05):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(k, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    v = np.repeat(centre, n, 0) + noise * rng.normal(size=(k * n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, x.tolist(), i // n) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label long"), v


def test_nearest_in_blocks(spark, monkeypatch):
    df, v = blobs(spark)
    want = {i: [j for j in np.lexsort((np.arange(36), -np.round(v @ v[i], 12))).tolist() if j != i][:4] for i in range(36)}
    for size in (1 << 20, 16 * 8 * 7):
        monkeypatch.setattr(embed, "BLOCK_BYTES", size)
        got = {}
        for r in embed.nearest(df, df, "vec_id", "embedding", 4, exclude_self=True).orderBy("query", F.col("similarity").desc(), "neighbour").collect():
            got.setdefault(r["query"], []).append(r["neighbour"])
        assert got == want


@pytest.mark.parametrize("k,own", [(3, True), (1, False), (40, True)])
def test_best_products_against_sorting_all(k, own):
    """Copies, ties, nulls of length, values that single precision can't hold, and rows that aren't numbers."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(5000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[2000:2600], v[4500:4510] = v[0], 0
    v[70:90] += 1e-7 * rng.normal(size=(20, 8))
    v[60:70] = v[70:80]
    ids = rng.permutation(5000) * 3
    for odd in ({}, {9: 1e20, 11: np.inf, 12: np.nan}):
        for i, x in odd.items():
            v[i] = x
        best = embed.Best(*embed.without_copies(ids, v, k + 1))
        assert len(best.ids) <= 5000 - 599 + k
        for a in (0, 2000, 4490):
            x, q = v[a : a + 100], ids[a : a + 100]
            with np.errstate(all="ignore"):
                s = np.round(np.einsum("ij,kj->ik", x, v), 12)
            if own:
                s[q[:, None] == ids] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            good = np.isfinite(np.take_along_axis(s, order, 1))
            with np.errstate(all="ignore"):
                row, found, product = best.top(q if own else None, x, k)
            use = np.isfinite(product)
            assert row[use].tolist() == np.nonzero(good)[0].tolist()
            if not odd:
                assert found[use].tolist() == ids[order][good].tolist()
            assert np.allclose(product[use], np.take_along_axis(s, order, 1)[good], rtol=1e-12, atol=2e-12)


def test_cover_walk_is_the_plain_one_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(9)
    v = rng.normal(size=(6000, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:400] = v[5]
    radius, held = 0.35 * rng.uniform(0.5, 2, 6000), v[5000:]
    apart = lambda dots: np.sqrt(np.maximum(0, 2 - 2 * np.round(dots, 12)))
    want: list[int] = []
    for a in range(0, 2000, 500):
        part, near = v[a : a + 500], (v[a : a + 500] @ np.concatenate([held, v[want]]).T).max(1)
        new: list[int] = []
        for i in np.argsort(np.round(near, 12), kind="stable"):
            if apart(near[i]) > radius[a + i] and (not new or (apart(part[new] @ part[i]) > radius[a + i]).all()):
                new.append(int(i))
        want += [a + i for i in sorted(new)]
    assert embed.cover_rows(v[:2000], radius[:2000], held, 500) == want
    tracemalloc.start()
    embed.cover_rows(v[:2000], radius[:2000], np.repeat(held, 12, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all products at once take 192 MB


def test_adaptive_cover_finds_the_neighbours_once(spark, tmp_path, monkeypatch):
    from wellspark.plans import more

    df, _ = blobs(spark)
    df.withColumn("label", F.col("label").cast("int")).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = []
    monkeypatch.setattr(embed, "density_scale", lambda *a, f=embed.density_scale: made.append(f(*a)) or made[-1])
    assert [tuple(r) for r in more.adaptive_cover(spark, str(tmp_path)).collect()] == [(36, 0)]
    assert len(made) == 1 and made[0].is_cached
    spark.catalog.clearCache()


def test_each_resolution_is_clustered_once(spark, monkeypatch):
    df, _ = blobs(spark)
    edges = embed.knn_graph(df, "vec_id", "embedding", 6)
    tried = []
    monkeypatch.setattr(cluster, "_clusters", lambda e, n, r, s, f=cluster._clusters: tried.append(r) or f(e, n, r, s))
    made = cluster.Clusterings(edges)
    chosen, r = cluster.cluster_groups(made, (0.5, 1.0, 2.0))
    wanted, high = cluster.resolution_for(made, 5)
    assert {0.5, 1.0, 2.0, high} <= set(tried) and len(tried) == len(set(tried))
    for got, at in ((chosen, r), (wanted, high)):
        assert rows(got) == rows(cluster.cluster_edges(edges, at))
    assert rows(cluster.resolution_for(edges, 5)[0]) == rows(wanted) and rows(cluster.cluster_groups(edges, (0.5, 1.0, 2.0))[0]) == rows(chosen)


@pytest.mark.parametrize("below", [50, 2**62])
def test_sums_and_highest_by_node(below):
    rng = np.random.default_rng(2)
    key, w = rng.integers(0, 50, 400), rng.integers(1, 9, 400)
    got, total = cluster._summed(key, w, below)
    assert got.tolist() == sorted(set(key.tolist())) and total.tolist() == [float(w[key == k].sum()) for k in got]
    v, gain = np.sort(rng.integers(0, 30, 200)), rng.integers(0, 4, 200).astype(float)
    assert cluster._highest(v, gain).tolist() == [int(np.flatnonzero((v == k) & (gain == gain[v == k].max()))[0]) for k in sorted(set(v.tolist()))]
    assert not len(cluster._highest(v[:0], gain[:0])) and not len(cluster._summed(key[:0], w[:0], below)[0])


def test_clusters_medoids_and_votes(spark):
    df, v = blobs(spark)
    graph = embed.knn_graph(df, "vec_id", "embedding", 6)
    got = {r["node"]: r["cluster"] for r in cluster.cluster_edges(graph).collect()}
    assert len({got[i] for i in range(36)}) == 3 and all(len({got[i] for i in range(12 * k, 12 * k + 12)}) == 1 for k in range(3))
    assert cluster.modularity(graph, df.select(F.col("vec_id").alias("node"), F.col("label").alias("cluster"))).first()[0] > 0.5
    medoid = {r["label"]: r["medoid"] for r in embed.medoids(df, "vec_id", "embedding", "label").collect()}
    for k in range(3):
        part = v[12 * k : 12 * k + 12]
        assert medoid[k] == 12 * k + int((part @ part.sum(0)).argmax())
    votes = embed.knn_vote(df, df, "vec_id", "embedding", "label", 5)
    assert all(r["predicted"] == r["query"] // 12 for r in votes.collect())
    assert rows(cluster.propagate(graph, 5).groupBy("cluster").count())


def planted_graph(n, pairs, seed=7):
    """Edges mostly inside five groups, with a loop, and node ids far apart."""
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 5, n)
    return sorted({(a * 1_000_003, b * 1_000_003) for a, b in rng.integers(0, n, (pairs, 2)).tolist() if group[a] == group[b] or rng.random() < 0.1} | {(-5, -5)})


def test_large_graphs_get_the_same_communities(spark, monkeypatch):
    """Joins and one task agree level by level, and the whole way when the first level is by joins."""
    pairs = planted_graph(40, 300)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    with monkeypatch.context() as m:
        m.setattr(cluster, "SHARES", cluster.SHARES[1:3])
        m.setattr(cluster, "REFINING", 2)
        a, f = cluster.Arrays.of_edges(*np.array(pairs).T), cluster.Frames.of_edges(edges)
        pa_, pf = a.own(), f.own()
        for level in range(2):
            pa_, pf = cluster.local_moves(a, pa_, 1.2, 3, level), cluster.local_moves(f, pf, 1.2, 3, level)
            assert dict(zip(a.ids.tolist(), a.ids[pa_].tolist())) == {r["node"]: r["part"] for r in pf.collect()}
            ra, rf = cluster.refinement(a, pa_, 1.2, 3, level), cluster.refinement(f, pf, 1.2, 3, level)
            assert dict(zip(a.ids.tolist(), a.ids[ra].tolist())) == {r["node"]: r["ref"] for r in rf.collect()}
            assert len(set(ra.tolist())) < len(ra)
            (a, pa_), (f, pf) = a.merged(ra, pa_), f.merged(rf)
            assert dict(zip(a.ids.tolist(), zip(a.degree.tolist(), a.ids[pa_].tolist()))) == {r["node"]: (r["degree"], r["part"]) for r in pf.collect()}
            links = {(a.ids[x], a.ids[y], w) for x, y, w in zip(a.src, a.dst, a.w.tolist())}
            assert links == {tuple(r) for r in f.links.select("src", "dst", "w").collect()}
    want = rows(cluster.cluster_edges(edges, 1.2, 3), "node", "cluster")
    monkeypatch.setattr(cluster, "TURNS", 1)  # both ways on the driver
    one = cluster.Arrays.of_edges(*np.array(pairs).T)
    first = dict(zip(one.ids.tolist(), cluster.leiden(one, 1.2, 3).tolist()))
    monkeypatch.setattr(cluster, "MAX_EDGES", len(one.src) // 2 - 1)
    got = {r["node"]: r["cluster"] for r in cluster.cluster_edges(edges, 1.2, 3).collect()}
    assert {frozenset(n for n in got if got[n] == c) for c in got.values()} == {frozenset(n for n in first if first[n] == c) for c in first.values()}
    assert len(want) == len(got)


def test_links_of_a_graph_take_twelve_bytes():
    """Places and weights in four bytes each, products of places still whole: the nodes' square doesn't fit four bytes."""
    n = 70_000
    graph = cluster.Arrays.of_edges(np.arange(n) * 3, (np.arange(n) + 1) % n * 3)
    assert graph.src.itemsize + graph.dst.itemsize + graph.w.itemsize == 12 and len(graph.src) == 2 * n and set(graph.degree.tolist()) == {2}
    part = graph.moved(graph.own(), 0.1, 5, cluster.PRIME)
    assert all((a - b) % n in (0, 1, n - 1) for a, b in zip(part.tolist(), range(n))) and (part != graph.own()).any()
    ref = graph.refined(np.zeros(n, np.int64), 0.1, [1, 2], cluster.PRIME // 2)
    merged, _ = graph.merged(ref, np.zeros(n, np.int64))
    assert merged.weight == graph.weight and len(merged.ids) < n


@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000, 1003])
def test_places_of_flags_that_are_not_set(n):
    rng = np.random.default_rng(n)
    for share in (0.0, 0.5, 0.99, 1.0):
        flags = rng.random(n + 8) < share
        want = np.flatnonzero(~flags[:n]).tolist()
        assert embed._not_set(flags, n).tolist() == want


@pytest.mark.parametrize("resolution", [0.5, 1.0, 3.0])
def test_refined_communities_hang_together(resolution):
    graph = cluster.Arrays.of_edges(*np.array(planted_graph(300, 1500, 11)).T)
    part = cluster.local_moves(graph, graph.own(), resolution, 0, 0)
    ref = cluster.refinement(graph, part, resolution, 0, 0)
    assert all(len(set(part[ref == c].tolist())) == 1 for c in set(ref.tolist()))

    def pieces(of):
        """Connected pieces inside the communities, by plain search."""
        near = {}
        for x, y in zip(graph.src.tolist(), graph.dst.tolist()):
            if of[x] == of[y]:
                near.setdefault(x, []).append(y)
        left, n = set(range(len(of))), 0
        while left:
            todo, n = [left.pop()], n + 1
            while todo:
                new = {y for y in near.get(todo.pop(), ()) if y in left}
                left -= new
                todo += new
        return n

    assert pieces(ref) == len(set(ref.tolist()))
    found = cluster.leiden(graph, resolution)
    assert pieces(found) == len(set(found.tolist()))

    def value(p):
        cross, squares = graph.quality(np.unique(p, return_inverse=True)[1])
        return graph.weight * (graph.weight - cross) - resolution * squares

    assert value(found) >= value(part)


def test_whitened_space_and_cover(spark):
    df, v = blobs(spark)
    space = embed.fit_space(df, "embedding", 5)
    w = np.array([r["w"] for r in embed.apply_space(df, "embedding", space, normalize=False).orderBy("vec_id").collect()])
    assert np.allclose(np.cov(w.T), np.eye(5), atol=1e-6)
    for cells in (1, 3):
        kept = {r[0] for r in embed.greedy_cover(df, "vec_id", "embedding", 0.6, cells=cells).collect()}
        d = np.sqrt(np.maximum(0, 2 - 2 * v @ v[sorted(kept)].T)).min(1)
        assert (d <= 0.6 * cells).all() and len(kept) < 36
    with pytest.raises(ValueError):
        embed.fit_space(df.limit(1), "embedding", 5)
    assert len(set(embed.farthest_points(v, 3))) == 3 and {i // 12 for i in embed.farthest_points(v, 3)} == {0, 1, 2}


def test_review_finds_a_planted_mislabel(spark):
    df, _ = blobs(spark, 2)
    df = df.withColumn("state", F.when(F.col("vec_id") == 3, 1 - F.col("label")).otherwise(F.col("label")).cast("int"))
    assert 3 in {r["vec_id"] for r in embed.review_items(df, "vec_id", "embedding", "state").collect()}
    assert embed.fit_label_model(df.limit(5), "embedding", "state") is None
    assert embed.fit_label_model(df, "embedding", "state") is not None


def test_batch_scorer(spark):
    df, _ = blobs(spark)
    out = embed.score_batches(df, ["embedding"], lambda pdf: np.stack([[x[0], -x[0]] for x in pdf["embedding"]]), ["p", "n"], "vec_id").collect()
    assert len(out) == 36 and all(abs(r["prob_p"] + r["prob_n"] - 1) < 1e-9 and r["pred_class"] in "pn" for r in out)


def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else "c", "r") for i in range(100)], "id long, label string, root string")
    n = {r["label"]: r["n"] for r in sampling.stratified_split(df, "label", 0.1, ["id"]).filter("is_val").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 9, "b": 1}
    assert {r["label"]: r["count"] for r in sampling.per_class(df, ["root", "label"], 5, ["id"]).groupBy("label").count().collect()} == {"a": 5, "b": 5, "c": 1}
    assert {r["label"]: r["count"] for r in sampling.per_dataset(df, "root", "label", 20, ["id"]).groupBy("label").count().collect()} == {"a": 10, "b": 9, "c": 1}
    assert sampling.sample_rows(df, 7, ["id"], 3).count() == 7


@pytest.mark.parametrize("sizes,target,ratio,want", [([10000, 100], 1100, 10, [1000, 100]), ([10000, 100], 2000, 10, [1900, 100]), ([100, 50], 30, 10, [20, 10]), ([10000, 10], 2000, 10, [1990, 10]), ([5, 5], 100, 10, [5, 5])])
def test_quotas(sizes, target, ratio, want):
    assert sampling.group_quotas(sizes, target, ratio) == want
