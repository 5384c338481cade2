import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspark.sources import catalog, images, tables
from wellspark.streaming import stream


def test_codecs_round_trip():
    rng = np.random.default_rng(0)
    for dtype in (np.uint8, np.uint16, np.float32):
        a = (rng.random((7, 9)) * 200).astype(dtype)
        for compress in (True, False):
            assert (images.read_image(images.write_tiff(a, compress)) == a).all()
    stack = rng.integers(0, 999, (3, 5, 4)).astype(np.uint16)
    raw = images.write_tiff(stack)
    assert (images.read_channels(raw, [3, 1]) == stack[[2, 0]].transpose(1, 2, 0)).all() and images.properties(raw) == (5, 4, 3, "uint16")
    with pytest.raises(ValueError, match="page"):
        images.read_image(images.write_tiff(rng.integers(0, 9, (7, 30, 40)).astype(np.uint8)))
    for shape, dtype in (((6, 5), np.uint8), ((6, 5), np.uint16), ((6, 5, 3), np.uint8), ((6, 5, 4), np.uint8)):
        a = rng.integers(0, 255, shape).astype(dtype)
        assert (images.decode(images.write_png(a)) == a).all()
    with pytest.raises(ValueError):
        images.decode(b"not a real tiff")


@pytest.fixture
def plate(tmp_path):
    for r, c in ((1, 1), (2, 10)):
        for ch in (1, 2):
            (tmp_path / f"r{r:02}c{c:02}f01p01-ch{ch}sk1fk1fl1.tiff").write_bytes(images.write_tiff(np.full((4, 4), ch * 1000, np.uint16)))
    (tmp_path / "r01c01f01p01-ch1sk1fk1fl1_cp_masks_cell.png").write_bytes(images.write_png(np.eye(4, dtype=np.uint8)))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r03c01f01p01-ch1sk1fk1fl1.tiff").write_bytes(b"not a real tiff")
    return tmp_path


def test_catalogue(spark, plate):
    files = catalog.list_files(spark, str(plate))
    pngs = files.filter(F.col("path").endswith(".png"))
    sites = catalog.site_metadata(files.filter(F.col("path").endswith(".tiff")), pngs).collect()
    assert [r["well"] for r in sites] == ["A1", "B10", "C1"] and sites[0]["field"] == "1" and sites[0]["timepoint"] == "1"
    assert sites[0]["ch1"].endswith("-ch1sk1fk1fl1.tiff") and sites[2]["ch2"] is None and sites[0]["mask_cell"].endswith("cell.png") and sites[1]["mask_cell"] is None
    assert catalog.cell_table(files, r"r(?P<row>\d+)c(?P<col>\d+)").count() == 5
    assert catalog.list_files(spark, str(plate), subdir="su*").count() == 1
    with pytest.raises(ValueError):
        catalog.refuse_reserved(r"(?P<uid>\d)", {"uid"})
    assert catalog.roles(r"(?P<well>\w)(?P<t10>\d)(?P<t2>\d)(?P<channel>\d)(?P<ext>\w)").metadata == ["well", "t2", "t10"]


def test_decoding_routes_failures(spark, plate):
    decoded = images.decode_files(images.read_files(spark, str(plate), "*.tiff"))
    bad = decoded.filter("error is not null").collect()
    assert len(bad) == 1 and "r03" in bad[0]["path"] and decoded.count() == 5
    assert images.to_pixels(decoded).agg(F.sum("value")).first()[0] == 2 * 16 * 3000


def test_lists_and_manifests(spark, tmp_path):
    (tmp_path / "l.csv").write_text("filepath,label\nx.tif,a\n/abs/y.tif,b\nx.tif,c\n")
    assert {tuple(r) for r in catalog.label_csv(spark, f"{tmp_path}/l.csv").collect()} == {(f"{tmp_path}/x.tif", "c"), ("/abs/y.tif", "b")}
    (tmp_path / "f.csv").write_text("filepath,label\nx.tif,\ny.tif, b \n")
    assert {tuple(r) for r in catalog.file_list(spark, f"{tmp_path}/f.csv").collect()} == {("x.tif", None), ("y.tif", "b")}
    rows = spark.createDataFrame([("a", "1")], "p string, q string")
    tables.append_manifest(spark, f"{tmp_path}/m", rows)
    tables.append_manifest(spark, f"{tmp_path}/m", rows)
    assert spark.read.option("header", True).csv(f"{tmp_path}/m").count() == 2
    with pytest.raises(ValueError):
        tables.append_manifest(spark, f"{tmp_path}/m", rows.withColumnRenamed("q", "z"))


def test_tables(spark, tmp_path):
    a = spark.createDataFrame([("d1", 1, 2.0), ("d2", 1, 3.0)], "directory string, label int, area double")
    tables.save_table(a, "obj_a", "replace")
    tables.save_table(a.withColumn("late", F.lit(1)).drop("area"), "obj_a", "append")
    assert tables.table_columns(spark, "obj_a") == ["directory", "label", "area"] and tables.read_table(spark, "obj_a").count() == 4
    with pytest.raises(Exception):
        tables.save_table(a, "obj_a")
    assert "obj_a" in tables.list_tables(spark)
    assert catalog.completeness(spark, a, {"obj_a": ["area", "x"], "none": []}) == {"obj_a": "no columns ['x']", "none": "no table"}
    with pytest.raises(ValueError):
        tables.label_table(spark, "obj_a", a)
    tables.drop_table(spark, "obj_a")
    path = f"{tmp_path}/masks"
    tables.write_mask_table(spark, path, a)
    tables.write_mask_table(spark, path, spark.createDataFrame([("d2", 7, 9.0)], a.schema))
    assert {tuple(r) for r in tables.read_mask_table(spark, path).select("directory", "label").collect()} == {("d1", 1), ("d2", 7)}


def test_inference_star(spark):
    inf = spark.createDataFrame([(1, "d", "x_CID12_.tif", "cell", 1, "p", 0.9, 0.1, [1.0])], "uid long, directory string, filename string, mask_name string, label long, pred_class string, prob_p double, prob_q double, features array<float>")
    red = spark.createDataFrame([(1, 0.5, 0.6)], "uid long, umap_1 double, umap_2 double")
    (s,) = tables.inference_sources(inf, [red], None, "db")
    assert s.mask == "cell" and "uid" not in s.df.columns and "umap_1" in s.df.columns
    c = tables.load_coordinates(inf, red, "umap").first()
    assert c["compound"] == "CID12" and [p["name"] for p in c["probabilities"]] == ["p", "q"]
    with pytest.raises(Exception, match="null features"):
        tables.load_features(inf.withColumn("features", F.lit(None).cast("array<float>"))).collect()
    merged = tables.merged_table([s])
    assert {r["mask"] for r in merged.collect()} == {"cell"} and tables.merged_table([]) is None


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(f"{tmp_path}/in")
    live = stream.window_counts(stream.read_stream(spark, f"{tmp_path}/in", e.schema), "ts", ["event_type"], late="1 minute")
    q = live.writeStream.outputMode("complete").format("memory").queryName("live_counts").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r["start"]), r["event_type"], r["n"])
    assert sorted(map(key, spark.table("live_counts").collect())) == sorted(map(key, stream.window_counts(e, "ts", ["event_type"]).collect()))
    log = spark.createDataFrame([(1, None, 1, 1, 5, 1, 1), (2, None, 1, 2, 5, 1, None), (3, None, 1, 3, 6, 1, 0)], "log_id long, ts string, session_id long, op_id long, cell_id long, label_id long, state int")
    log.write.parquet(f"{tmp_path}/log")
    sink = stream.decision_log_sink(f"{tmp_path}/decisions")
    q = stream.read_stream(spark, f"{tmp_path}/log", log.schema).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    sink(log, 0)
    assert [tuple(r) for r in stream.decision_state(spark, f"{tmp_path}/decisions").collect()] == [(6, 1, 0)]


def test_entry_without_the_subpackage(spark, monkeypatch):
    """The entry module works when the training-data folders are gone."""
    import importlib.util as util

    real = util.find_spec
    monkeypatch.setattr(util, "find_spec", lambda name, *a: None if name in ("wellspark.llm", "corpus_pipeline") else real(name, *a))
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert "flagship" in e.queries() and not [n for n in e.queries() if n.startswith("op1")] and "pipeline" not in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
