"""Further queries, each calling one operator on whole tables: catalogue, tables and sinks, label store, conformed columns, vectors, samples, clusters.

Tables that a query writes go to the session's warehouse under a name of their own.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.functions import text as tx
from wellspark.functions import vector as vec
from wellspark.operators import cluster, embed, filters, fuse, kernels, labels, measure, pixels, plate, sampling
from wellspark.plans.queries import _DOT, _LOG, _STATES, _TILES, decision_log, query, read, rounded, tiles, vectors
from wellspark.sources import catalog, config, images, tables


def scratch(spark: SparkSession, name: str) -> str:
    """A table name that nobody has."""
    return f"wellspark_{name}_{uuid.uuid4().hex[:12]}"


def folder(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{scratch(spark, name)}"


def facts(spark: SparkSession, rows: list[tuple[str, object]]) -> DataFrame:
    """Small facts as text: name, value."""
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "name string, value string")


def _facts(rows: list[tuple[str, object]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows) + ") v(name, value)"


# --- catalogue: an order is an image file, a customer a mask file


def image_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.format_string("/plate/images/r%02dc%02df%02dp01-ch%dsk1fk1fl1-%d.tiff", k % 3 + 1, k % 5 + 1, k % 7 + 1, k % 2 + 1, k)
    return read(spark, d, "orders").select(name.alias("path"))


_IMAGES = """f AS (SELECT printf('/plate/images/r%02dc%02df%02dp01-ch%dsk1fk1fl1-%d.tiff', o_orderkey % 3 + 1, o_orderkey % 5 + 1, o_orderkey % 7 + 1, o_orderkey % 2 + 1, o_orderkey) AS path,
  chr(CAST(65 + o_orderkey % 3 AS INT)) || (o_orderkey % 5 + 1) AS well, CAST(o_orderkey % 7 + 1 AS VARCHAR) AS field, o_orderkey % 2 + 1 AS ch FROM orders),
sites AS (SELECT well, field, '1' AS stack, '1' AS timepoint, max(path) FILTER (ch = 1) AS ch1, max(path) FILTER (ch = 2) AS ch2, '/plate/images' AS directory FROM f GROUP BY well, field)"""


@query(
    """SELECT printf('/plate/images/r%02dc%02df%02dp01-ch%dsk1fk1fl1-%d.tiff', o_orderkey % 3 + 1, o_orderkey % 5 + 1, o_orderkey % 7 + 1, o_orderkey % 2 + 1, o_orderkey) AS path,
printf('%02d', o_orderkey % 3 + 1) AS row, printf('%02d', o_orderkey % 5 + 1) AS col, CAST(o_orderkey % 7 + 1 AS VARCHAR) AS field, '1' AS stack, CAST(o_orderkey % 2 + 1 AS VARCHAR) AS channel, '1' AS timepoint FROM orders"""
)
def scan_images(spark: SparkSession, d: str) -> DataFrame:
    """The default pattern's captures, and files of other names left out."""
    files = image_files(spark, d)
    return catalog.parse(files.unionByName(read(spark, d, "pages").select(F.col("url").alias("path"))), catalog.IMAGE_PATTERN)


@query(f"WITH {_IMAGES} SELECT * FROM sites")
def site_table(spark: SparkSession, d: str) -> DataFrame:
    return catalog.site_table(image_files(spark, d))


def mask_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.format_string("/plate/masks/r%02dc%02df%02dp01-ch1sk1fk1fl1-%d_cp_masks_%s.png", k % 4 + 1, k % 5 + 1, k % 7 + 1, k, F.when(k % 2 == 0, "cell").otherwise("nuclei"))
    return read(spark, d, "customer").select(name.alias("path"))


_MASKS = """g AS (SELECT printf('/plate/masks/r%02dc%02df%02dp01-ch1sk1fk1fl1-%d_cp_masks_%s.png', c_custkey % 4 + 1, c_custkey % 5 + 1, c_custkey % 7 + 1, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'cell' ELSE 'nuclei' END) AS path,
  chr(CAST(65 + c_custkey % 4 AS INT)) || (c_custkey % 5 + 1) AS well, CAST(c_custkey % 7 + 1 AS VARCHAR) AS field, c_custkey % 2 AS odd FROM customer),
masks AS (SELECT well, field, '1' AS stack, '1' AS timepoint, max(path) FILTER (odd = 0) AS mask_cell, max(path) FILTER (odd = 1) AS mask_nuclei FROM g GROUP BY well, field)"""


@query(f"WITH {_MASKS} SELECT path, CAST(odd AS BIGINT) AS odd, CASE WHEN odd = 0 THEN 'cell' ELSE 'nuclei' END AS mask_name, field FROM g")
def scan_masks(spark: SparkSession, d: str) -> DataFrame:
    parsed = catalog.parse(mask_files(spark, d), catalog.MASK_PATTERN)
    return parsed.select("path", (F.col("mask_name") == "nuclei").cast("long").alias("odd"), "mask_name", "field")


@query(
    f"""WITH {_IMAGES}, {_MASKS} SELECT coalesce(s.well, m.well) AS well, coalesce(s.field, m.field) AS field, coalesce(s.stack, m.stack) AS stack, coalesce(s.timepoint, m.timepoint) AS timepoint, ch1, ch2, coalesce(s.directory, '/plate/masks') AS directory, mask_cell, mask_nuclei
FROM sites s FULL JOIN masks m ON s.well = m.well AND s.field = m.field AND s.stack = m.stack AND s.timepoint = m.timepoint"""
)
def site_metadata(spark: SparkSession, d: str) -> DataFrame:
    return catalog.site_metadata(image_files(spark, d), mask_files(spark, d))


@query(f"WITH {_IMAGES}, {_MASKS} SELECT count(*) AS n FROM sites s JOIN masks m ON s.well = m.well AND s.field = m.field WHERE mask_cell IS NOT NULL AND mask_nuclei IS NOT NULL")
def sites_with_masks(spark: SparkSession, d: str) -> DataFrame:
    sites = catalog.site_metadata(image_files(spark, d), mask_files(spark, d)).filter("ch1 IS NOT NULL OR ch2 IS NOT NULL")
    return catalog.with_masks(sites, ["cell", "nuclei"]).agg(F.count("*").alias("n"))


@query("SELECT 'item' || p_partkey AS stem, '/cells/' || p_brand || '/item' || p_partkey || '.TIF' AS path, '/cells/' || p_brand AS directory, CAST(p_partkey AS VARCHAR) AS number FROM part")
def cell_table(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    files = p.select(F.concat(F.lit("/cells/"), "p_brand", F.lit("/item"), F.col("p_partkey").cast("string"), F.lit(".TIF")).alias("path"))
    other = p.select(F.concat(F.lit("/cells/"), F.col("p_name"), F.lit(".png")).alias("path"))
    return catalog.cell_table(files.unionByName(other), r"item(?P<number>\d+)")


@query("SELECT '/x/' || p_brand || '/' || p_name AS filepath, max_by(p_type, p_partkey) AS label FROM part GROUP BY ALL")
def label_csv(spark: SparkSession, d: str) -> DataFrame:
    """Absolute and relative paths of one CSV; of repeated paths the last line counts."""
    path = folder(spark, "labels")
    p = read(spark, d, "part")
    near = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"))
    rows = p.coalesce(1).sortWithinPartitions("p_partkey").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/x/"), near)).otherwise(F.concat(F.lit("/x\\"), near)).alias("filepath"), F.col("p_type").alias("label"))
    rows.write.option("header", True).csv(path)
    return catalog.label_csv(spark, path)


@query("SELECT 'cells/' || c_custkey AS filepath, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS label FROM customer")
def file_list(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "files")
    c = read(spark, d, "customer")
    c.select(F.concat(F.lit("cells/"), F.col("c_custkey").cast("string"), F.lit("/")).alias("filepath"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("  ").alias("label")).write.option("header", True).csv(path)
    return catalog.file_list(spark, path)


@query("SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 50 = 0)")
def registered_only(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumnRenamed("source", "filepath")
    return catalog.only_subset(docs, docs.filter("doc_id % 50 = 0")).select("doc_id")


@query(
    _facts([
        ("well", "C12"), ("structural", "well,field"), ("extra", "t2,t10"), ("infer", "infer_net.db"), ("model", "net"), ("no model", "None"), ("reduction", "reduction_pca"), ("mask", "mask_cell"), ("bare", "cell"),
        ("stem", "best"), ("folder stem", "run7"), ("names", "a,b"), ("tag", "0.5"), ("absolute", "/a/b"), ("merged", "1,3,2"), ("warm", "0.05"), ("last", "0.01"), ("datasets", "0"), ("override", "9"),
    ])
)
def names_and_configs(spark: SparkSession, d: str) -> DataFrame:
    """Driver-side naming and configuration rules."""
    well = spark.createDataFrame([("03", "12")], "row string, col string")
    r = catalog.roles(r"(?P<well>\w)(?P<t10>\d)(?P<t2>\d)(?P<channel>\d)(?P<field>\d)")
    merged = vec.deep_merge({"a": {"x": 1, "y": 2}, "b": 2}, {"a": {"y": 3}})
    cfg = config.load_config(None, ["objects=[{\"mask\": \"cell\", \"bins\": 9}]"])
    return facts(spark, [
        ("well", catalog.merge_well(well, catalog.Roles([], [], True)).first()["well"]), ("structural", ",".join(r.structural)), ("extra", ",".join(r.extra)), ("infer", tx.infer_db_name("net")), ("model", tx.model_of_infer_db("infer_net.db")),
        ("no model", tx.model_of_infer_db("other.db")), ("reduction", tx.reduction_table("pca")), ("mask", tx.mask_column("cell")), ("bare", tx.bare_mask("mask_cell")), ("stem", catalog.suggest_model_name("/m/run7/best.pt")),
        ("folder stem", catalog.suggest_model_name("/m/run7/model.pt")), ("names", ",".join(tx.shorten_paths(["/r/a/x", "/r/b/x"]))), ("tag", tx.resolution_tag(0.50)), ("absolute", catalog.resolve_directory("/a//b/", "/r")),
        ("merged", f"{merged['a']['x']},{merged['a']['y']},{merged['b']}"), ("warm", round(vec.warmup_cosine(5, 0.1, 0.01, 100, 10), 6)), ("last", round(vec.warmup_cosine(100, 0.1, 0.01, 100, 10), 6)),
        ("datasets", len(catalog.resolve_datasets("/no/such/folder", "x"))), ("override", cfg.objects[0].bins),
    ])


@query("SELECT event_id, 'well=' || user_id || CASE WHEN event_id % 2 = 0 THEN '|field=' || event_type ELSE '' END AS stem FROM events")
def field_stem(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("well"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("field"))
    parts = F.concat_ws("|", *(F.concat(F.lit(f"{n}="), F.nullif(F.col(n), F.lit(""))) for n in ("well", "field")))
    return e.select("event_id", parts.alias("stem"))


@query("SELECT o_orderkey, o_orderpriority || ' | ' || o_orderstatus AS label FROM orders")
def group_label(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", tx.group_label([F.col("o_orderpriority"), F.col("o_orderstatus")]).alias("label"))


@query("SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS directory FROM pages")
def source_directory(spark: SparkSession, d: str) -> DataFrame:
    """The folder of the first path that isn't null."""
    return read(spark, d, "pages").select("page_id", tx.source_directory([F.when(F.col("page_id") % 2 == 0, F.col("url")), F.col("url")]).alias("directory"))


# --- tables and sinks


@query("SELECT n_nationkey AS a, n_name AS b FROM nation UNION ALL SELECT r_regionkey, NULL FROM region")
def save_append(spark: SparkSession, d: str) -> DataFrame:
    """A new table, then rows with a column less and one more, fitted to it."""
    name = scratch(spark, "append")
    tables.save_table(read(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b")), name)
    tables.save_table(read(spark, d, "region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("other")), name, "append")
    return tables.read_table(spark, name)


@query("SELECT r_regionkey AS a FROM region")
def save_replace(spark: SparkSession, d: str) -> DataFrame:
    name = scratch(spark, "replace")
    tables.save_table(read(spark, d, "nation").select(F.col("n_nationkey").alias("a")), name)
    tables.save_table(read(spark, d, "region").select(F.col("r_regionkey").alias("a")), name, "replace")
    return tables.read_table(spark, name)


@query("SELECT 'there' AS name, 'True' AS value UNION ALL SELECT 'columns', 'l_orderkey,l_quantity' UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM lineitem UNION ALL SELECT 'preview', '20' UNION ALL SELECT 'dropped', 'False'")
def table_facts(spark: SparkSession, d: str) -> DataFrame:
    name = scratch(spark, "facts")
    tables.save_table(read(spark, d, "lineitem").select("l_orderkey", "l_quantity"), name)
    there, columns = name in tables.list_tables(spark), tables.table_columns(spark, name)
    shown, n = tables.preview(tables.read_table(spark, name))
    rows = [("there", there), ("columns", ",".join(columns)), ("rows", n), ("preview", shown.count())]
    tables.drop_table(spark, name)
    return facts(spark, [*rows, ("dropped", name in tables.list_tables(spark))])


@query("SELECT CAST(o_orderkey AS BIGINT) AS label, o_orderpriority AS directory, CASE WHEN o_orderpriority LIKE '1%' THEN 'new' END AS state FROM orders WHERE o_orderpriority NOT LIKE '1%' OR o_orderkey % 2 = 0")
def mask_table_sink(spark: SparkSession, d: str) -> DataFrame:
    """A folder's rows are replaced, the others stay; the late column is null for them."""
    path = folder(spark, "mask")
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("label"), F.col("o_orderpriority").alias("directory"))
    tables.write_mask_table(spark, path, o)
    tables.write_mask_table(spark, path, o.filter("directory LIKE '1%' AND label % 2 = 0").withColumn("state", F.lit("new")))
    return tables.read_mask_table(spark, path).select("label", "directory", "state")


_INFER = "uid, directory, filename, pred_class, pred_prob, prob_a, prob_b"


@query(
    f"""WITH w AS (SELECT CAST(doc_id AS BIGINT) AS uid, CASE WHEN doc_id % 9 > 0 THEN source END AS directory, 'f' || doc_id AS filename, 'a' AS pred_class, 0.5 AS pred_prob, 0.5 AS prob_a, 0.5 AS prob_b FROM documents),
n AS (SELECT uid, directory, filename, 'b' AS pred_class, 0.75 AS pred_prob, 0.25 AS prob_a, 0.75 AS prob_b FROM w WHERE uid % 4 = 0 AND (directory IS NULL OR directory < 'src2')),
k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.directory IS NOT DISTINCT FROM w.directory))
SELECT {_INFER} FROM k UNION ALL SELECT {_INFER} FROM n"""
)
def write_inference(spark: SparkSession, d: str) -> DataFrame:
    """New predictions replace those of their folders, null folders too."""
    base = read(spark, d, "documents").select(F.col("doc_id").cast("long").alias("uid"), F.when(F.col("doc_id") % 9 > 0, F.col("source")).alias("directory"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"))
    shares = lambda df, name, a: df.withColumn("pred_class", F.lit(name)).withColumn("pred_prob", F.lit(max(a, 1 - a))).withColumn("prob_a", F.lit(a)).withColumn("prob_b", F.lit(1 - a))
    old = tables.write_inference(None, shares(base, "a", 0.5), [], ["a", "b"])
    new = shares(base.filter("uid % 4 = 0 AND (directory IS NULL OR directory < 'src2')"), "b", 0.25)
    return tables.write_inference(old, new, [], ["a", "b"]).select(*_INFER.split(", "))


@query("SELECT CAST(doc_id AS BIGINT) AS uid, CAST(n_chars AS DOUBLE) AS pca_1, CAST(length(text) AS DOUBLE) AS pca_2 FROM documents WHERE source = (SELECT min(source) FROM documents)")
def reduction_sink(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("source", F.col("doc_id").cast("long").alias("uid"), F.col("n_chars").cast("double").alias("x"), F.length("text").cast("double").alias("y"))
    first = docs.agg(F.min("source").alias("source"))
    return tables.reduction_tables(docs, "pca", docs.join(first, "source").select("source", "uid"))


@query("SELECT 'A' || n_regionkey AS well, CAST(n_nationkey AS BIGINT) AS label, n_name AS class FROM nation WHERE n_nationkey > 3")
def label_table_sink(spark: SparkSession, d: str) -> DataFrame:
    name = scratch(spark, "label")
    rows = read(spark, d, "nation").select(F.concat(F.lit("A"), F.col("n_regionkey").cast("string")).alias("well"), F.col("n_nationkey").cast("long").alias("label"), F.col("n_name").alias("class"))
    tables.label_table(spark, name, rows)
    tables.label_table(spark, name, rows.filter("label > 3"))
    return spark.table(name)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS filepath FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region")
def manifest_sink(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "manifest")
    tables.append_manifest(spark, path, read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("filepath")))
    tables.append_manifest(spark, path, read(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("filepath")))
    return spark.read.option("header", True).csv(path)


@query("SELECT doc_id, doc_id % 5 = 0 AS keep FROM documents")
def selection_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("filepath", F.col("doc_id").cast("string"))
    return tables.selection_outputs(docs, docs.filter("doc_id % 5 = 0"), "doc_id")["manifest"].select("doc_id", "keep")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 5 = 0")
def selection_curated(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("filepath", F.col("doc_id").cast("string"))
    return tables.selection_outputs(docs, docs.filter("doc_id % 5 = 0"), "doc_id")["curated"].select("doc_id", "lang")


@query("SELECT source, filepath, CAST(row_number() OVER (ORDER BY source, filepath) AS BIGINT) AS place FROM (SELECT source, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS filepath FROM documents)")
def sorted_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.sorted_manifest(read(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("filepath")))
    numbered = rows.coalesce(1).select("*", F.monotonically_increasing_id().alias("at"))
    return numbered.select("source", "filepath", (F.col("at") + 1).alias("place"))


@query("SELECT n_nationkey AS a, n_name AS b, NULL::INT AS c FROM nation UNION ALL SELECT r_regionkey, NULL, 7 FROM region")
def stacked(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b"))
    return tables.stack([a, read(spark, d, "region").select(F.col("r_regionkey").alias("a"), F.lit(7).alias("c"))])


@query("SELECT n_name AS b, CAST(NULL AS DOUBLE) AS z, CAST(n_nationkey AS VARCHAR) AS a FROM nation")
def conformed(spark: SparkSession, d: str) -> DataFrame:
    schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("z", T.DoubleType()), T.StructField("a", T.StringType())])
    return fuse.conform(read(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b"), F.lit(1).alias("x")), schema)


@query("SELECT n_nationkey AS a, n_name AS b FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey >= 10")
def batch_writer(spark: SparkSession, d: str) -> DataFrame:
    """The first flush fixes the columns; a later column is dropped and a missing one null."""
    n = read(spark, d, "nation")
    name = scratch(spark, "batches")
    w = tables.BatchWriter(name, 2)
    for low in (0, 5):
        w.add(n.filter(f"n_nationkey >= {low} AND n_nationkey < {low + 5}").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b")))
    w.add(n.filter("n_nationkey >= 10").select(F.col("n_nationkey").alias("a"), F.lit("x").alias("late")))
    w.close()
    return spark.table(name)


@query("SELECT 'new' AS name, 'True' AS value UNION ALL SELECT 'again', 'False' UNION ALL SELECT 'other columns', 'True' UNION ALL SELECT 'cached', CAST(count(*) AS VARCHAR) FROM region UNION ALL SELECT 'metrics', '2'")
def tables_anew(spark: SparkSession, d: str) -> DataFrame:
    """A table of other columns is made anew, broken caches too; metrics are appended."""
    name, path = scratch(spark, "init"), folder(spark, "cache")
    kind = tables.infer_schema([], ["a"])
    rows = [("new", tables.init_table(spark, name, kind)), ("again", tables.init_table(spark, name, kind)), ("other columns", tables.init_table(spark, name, tables.infer_schema([], ["b"])))]
    made = tables.cached(spark, path, lambda: read(spark, d, "region"))
    again = tables.cached(spark, path, lambda: read(spark, d, "nation"))
    log = folder(spark, "metrics")
    for k in (1, 2):
        tables.log_metrics(spark, log, [("train", k, 0, {"loss": 1.0 / k, "f1": 0.5})])
    return facts(spark, [*rows, ("cached", min(made.count(), again.count())), ("metrics", spark.read.option("header", True).csv(log).count())])


def star(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = read(spark, d, "documents")
    uid = F.col("doc_id").cast("long").alias("uid")
    inference = docs.select(uid, F.col("source").alias("directory"), F.col("doc_id").cast("long").alias("label"), F.when(F.col("doc_id") % 3 > 0, "cell").alias("mask_name"), F.concat(F.lit("CID"), F.col("doc_id").cast("string"), F.lit("_x.tif")).alias("filename"), F.lit(0.25).alias("prob_a"), F.lit(0.75).alias("prob_b"), F.array(F.lit(1.0)).alias("features"))
    return inference, docs.select(uid, F.col("n_chars").cast("double").alias("pca_1"), F.lit(2.0).alias("pca_2")), docs.filter("doc_id % 2 = 0").select(uid, (F.col("doc_id") % 7).cast("long").alias("cluster"))


@query("SELECT source AS directory, CAST(doc_id AS BIGINT) AS label, 'CID' || doc_id || '_x.tif' AS filename, CAST(n_chars AS DOUBLE) AS pca_1, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 7 AS BIGINT) END AS cluster, CASE WHEN doc_id % 3 > 0 THEN 'cell' ELSE 'net' END AS mask FROM documents")
def absorb_inference(spark: SparkSession, d: str) -> DataFrame:
    """One wide table per mask out of a star; rows without a mask go by the star's name."""
    inference, reduction, clusters = star(spark, d)
    parts = tables.absorbed(inference, [reduction], clusters, "net")
    return tables.stack([df.select("directory", "label", "filename", "pca_1", "cluster").withColumn("mask", F.lit(m)) for m, df in sorted(parts.items())])


@query("SELECT CAST(doc_id AS BIGINT) AS uid, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 7 AS BIGINT) END AS cluster, 1 AS n FROM documents")
def load_features(spark: SparkSession, d: str) -> DataFrame:
    inference, _, clusters = star(spark, d)
    return tables.load_features(inference, clusters).select("uid", "cluster", F.size("features").alias("n"))


@query("SELECT CAST(doc_id AS BIGINT) AS uid, CAST(n_chars AS DOUBLE) AS x, 2.0 AS y, 'CID' || doc_id AS compound, 'b' AS first, 0.25 AS second FROM documents")
def load_coordinates(spark: SparkSession, d: str) -> DataFrame:
    inference, reduction, _ = star(spark, d)
    p = F.col("probabilities")
    return tables.load_coordinates(inference, reduction, "pca").select("uid", "x", "y", "compound", p[0]["name"].alias("first"), p[1]["prob"].alias("second"))


@query(
    """WITH o AS (SELECT l_orderkey AS directory, l_linenumber AS label, sum(l_quantity) AS area FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey AS directory, l_linenumber AS label, max(l_tax) AS prob FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL)
SELECT directory, label, area, prob, 'cell' AS mask FROM o LEFT JOIN p USING (directory, label)"""
)
def build_merged(spark: SparkSession, d: str) -> DataFrame:
    """Object tables and an inference star of one mask as one merged table; a stale one without sources goes."""
    li = read(spark, d, "lineitem")
    keys = ["directory", "label"]
    own = li.groupBy(F.col("l_orderkey").alias("directory"), F.col("l_linenumber").alias("label")).agg(F.sum("l_quantity").alias("area")).withColumn("mask", F.lit("cell"))
    found = li.filter("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").alias("directory"), F.col("l_linenumber").alias("label")).agg(F.max("l_tax").alias("prob"))
    inference = found.select(*keys, "prob", F.lit("cell").alias("mask_name"), (F.col("directory") * 100 + F.col("label")).alias("uid"), F.array(F.lit(1.0)).alias("features"))
    name = scratch(spark, "merged")
    tables.build_merged(spark, name, {"profile": {"cells": own}})
    if tables.build_merged(spark, name, {}) is not None or spark.catalog.tableExists(name):
        raise ValueError("a stale table stayed")
    return tables.build_merged(spark, name, {"profile": {"cells": own}, "net": {"inference": inference}}).select(*keys, "area", "prob", "mask")


@query("SELECT vec_id, 64 AS n, round(sum(v), 4) AS total FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY vec_id")
def blob_decode(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as bytes and back."""
    pack = F.pandas_udf(lambda v: v.map(lambda a: np.asarray(a, "<f4").tobytes()), "binary")
    v = read(spark, d, "embeddings").select("vec_id", vec.decode_blob(pack(F.col("embedding").cast("array<double>"))).alias("v"))
    return rounded(v.select("vec_id", F.size("v").alias("n"), vec.total(vec.doubles(F.col("v"))).alias("total")), 4)


@query(f"WITH {_TILES} SELECT vec_id, 'uint8' AS dtype, 1 AS channel, count(*) AS n, sum(CAST(round_even(least(255, greatest(0, value * 100 + 100)), 0) AS BIGINT)) AS total FROM t GROUP BY vec_id UNION ALL SELECT vec_id, 'uint16', 1, count(*), sum(CAST(round_even(least(255, greatest(0, value * 100 + 100)), 0) AS BIGINT)) FROM t GROUP BY vec_id")
def image_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Tiles written as PNG of 8 bits and TIFF of 16, decoded again to pixels."""
    both = F.pandas_udf(lambda v: v.map(lambda a: [images.write_png(_grey(a, np.uint8)), images.write_tiff(_grey(a, np.uint16))]), "array<binary>")
    e = read(spark, d, "embeddings").select("vec_id", both(F.col("embedding").cast("array<double>")).alias("raw"))
    files = e.select(F.explode(F.array(*(F.struct(F.concat(F.col("vec_id").cast("string"), F.lit(f" {k}")).alias("path"), F.col("raw")[i].alias("content")) for i, k in enumerate(("uint8", "uint16"))))).alias("f")).select("f.*")
    decoded = images.decode_files(files)
    px = images.to_pixels(decoded)
    at = F.split("path", " ")
    return px.groupBy(at[0].cast("long").alias("vec_id"), at[1].alias("dtype"), "channel").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


def _grey(a: np.ndarray, kind: type) -> np.ndarray:
    return np.rint(np.clip(np.asarray(a, float) * 100 + 100, 0, 255)).astype(kind).reshape(8, 8)


# --- label store


@query("SELECT CAST(max(event_id) + 1 AS BIGINT) AS log_id, CAST(max(event_id // 3) + 1 AS BIGINT) AS op_id FROM events")
def next_numbers(spark: SparkSession, d: str) -> DataFrame:
    log = decision_log(spark, d)
    return spark.createDataFrame([(labels.next_number(log, "log_id"), labels.next_number(log, "op_id"))], "log_id long, op_id long")


@query(f"WITH {_LOG} SELECT cell_id, label_id, state FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, label_id ORDER BY log_id DESC) AS k FROM g WHERE log_id < 500) WHERE k = 1")
def state_before(spark: SparkSession, d: str) -> DataFrame:
    return labels.state_before(decision_log(spark, d), 500)


@query(
    f"""WITH {_STATES}, c AS (SELECT DISTINCT c_custkey AS cell_id FROM customer) SELECT cell_id, CAST(2 AS BIGINT) AS label_id, 1 AS state FROM c
UNION ALL SELECT cell_id, label_id, state FROM s WHERE label_id <> 2 AND NOT (state = 1 AND cell_id IN (SELECT cell_id FROM c)) UNION ALL SELECT cell_id, label_id, state FROM s WHERE label_id = 2 AND cell_id NOT IN (SELECT cell_id FROM c)"""
)
def label_batch_single(spark: SparkSession, d: str) -> DataFrame:
    """One label set on all customers' cells; their other positives are cleared in the same operation."""
    cells = read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("cell_id"))
    return labels.current_states(labels.apply_batch(decision_log(spark, d), cells, [2], 1, single=True))


@query(
    """WITH k AS (SELECT CAST(c_custkey AS BIGINT) AS cell_id, c_name AS filepath, 'old' AS preset FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_name AS filepath FROM customer WHERE c_custkey % 3 = 0)
SELECT cell_id, filepath, CASE WHEN filepath IN (SELECT filepath FROM n) THEN 'new' ELSE preset END AS preset FROM k
UNION ALL SELECT CAST((SELECT max(cell_id) FROM k) + row_number() OVER (ORDER BY filepath) AS BIGINT), filepath, 'new' FROM n WHERE filepath NOT IN (SELECT filepath FROM k)"""
)
def register_cells(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    known = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("long").alias("cell_id"), F.col("c_name").alias("filepath"), F.lit("old").alias("preset"))
    return labels.register_cells(known, c.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("filepath"), F.lit("new").alias("preset")))


@query("SELECT CAST(r_regionkey + 1 AS BIGINT) AS label_id, r_name AS name, 'c' || r_regionkey AS color, CAST(CASE r_regionkey WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE r_regionkey END AS INT) AS sort_order FROM region WHERE r_regionkey <> 4 UNION ALL SELECT 6, 'extra', 'red', 5")
def label_registry(spark: SparkSession, d: str) -> DataFrame:
    """A new label, a known one again, one deleted, two put in order."""
    r = read(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("label_id"), F.col("r_name").alias("name"), F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("color"), F.col("r_regionkey").cast("int").alias("sort_order"))
    more = labels.add_label(labels.add_label(r, "extra", ["red", "green", "blue", "black", "white"]), "extra", ["red"])
    left, _ = labels.delete_label(more, decision_log(spark, d), 5)
    return labels.reorder_labels(left, [4, 2])


@query(f"WITH {_STATES} SELECT * FROM s WHERE label_id <> 1")
def delete_label(spark: SparkSession, d: str) -> DataFrame:
    """A deleted label's decisions go, the log stays."""
    return labels.delete_label(spark.createDataFrame([(1,)], "label_id long"), decision_log(spark, d), 1)[1]


@query(
    f"""WITH {_STATES}, c AS (SELECT c_custkey AS cell_id FROM customer WHERE c_nationkey = 3) SELECT cell_id, CAST(1 AS BIGINT) AS label_id, 0 AS state FROM c WHERE cell_id NOT IN (SELECT cell_id FROM s WHERE label_id = 1) UNION ALL SELECT * FROM s"""
)
def annotate_cluster(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("cell_id"), F.col("c_nationkey").alias("cluster"))
    return labels.current_states(labels.annotate_cluster(decision_log(spark, d), cells, 3, 1, 0))


@query("SELECT c_custkey AS cell_id, (SELECT string_agg(label || ':' || source, ',' ORDER BY score DESC, label) FROM (SELECT user_id, CAST(event_id AS VARCHAR) AS label, event_id AS score, event_type AS source FROM events) e WHERE e.user_id = c_custkey) AS suggestions FROM customer")
def cell_payload(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"))
    s = read(spark, d, "events").select(F.col("user_id").alias("cell_id"), F.col("event_id").cast("double").alias("score"), F.col("event_id").alias("label_id"), F.col("event_type").alias("source"))
    shown = F.transform("suggestions", lambda x: F.concat_ws(":", x["label_id"].cast("string"), x["source"]))
    return labels.payload(cells, s).select("cell_id", F.when(F.col("suggestions").isNotNull(), F.array_join(shown, ",")).alias("suggestions"))


# --- columns, groups, order


@query(_facts([("numeric", "p_partkey,p_size,p_retailprice"), ("categorical", "p_name,p_brand,p_type"), ("continuous price", "True"), ("continuous type", "False"), ("continuous prob_x", "True"), ("plain", "p_name"), ("order", "well,label,parent_a,p_name,x")]))
def column_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    wide = p.select("p_name", F.lit(1).alias("x"), F.lit(2).alias("parent_a"), F.lit("A1").alias("well"), F.lit(3).alias("label"))
    blobs = p.select("p_name", F.lit(b"x").alias("raw"), F.array("p_size").alias("many"), "p_size")
    return facts(spark, [
        ("numeric", ",".join(filters.numeric_columns(p))), ("categorical", ",".join(filters.categorical_columns(p))), ("continuous price", filters.color_is_continuous(p, "p_retailprice")), ("continuous type", filters.color_is_continuous(p, "p_type")),
        ("continuous prob_x", filters.color_is_continuous(p, "prob_x")), ("plain", ",".join(filters.without_binary(blobs, ("p_size",)).columns)), ("order", ",".join(filters.reorder_columns(wide, ["well"]).columns)),
    ])


@query("SELECT w, CAST(row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS BIGINT) AS place FROM (SELECT *, chr(CAST(65 + n_regionkey AS INT)) || n_nationkey AS w FROM nation)")
def natural_rows(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.concat(F.char((65 + F.col("n_regionkey")).cast("long")), F.col("n_nationkey").cast("string")).alias("w"))
    ordered = plate.natural_sort(n, ["w"]).coalesce(1)
    return ordered.select("w", (F.monotonically_increasing_id() + 1).alias("place"))


@query("SELECT least(8, min(k)) AS k FROM (SELECT k, sum(s) OVER (ORDER BY k) AS c FROM (SELECT CAST(n_nationkey + 1 AS INT) AS k, 0.5 / pow(2, n_nationkey) AS s FROM nation)) WHERE c >= 0.9")
def cumulative_dimension(spark: SparkSession, d: str) -> DataFrame:
    shares = read(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("k"), (0.5 / F.pow(F.lit(2.0), F.col("n_nationkey"))).alias("share"))
    return plate.cumulative_dimension(shares, 0.9, 8)


@query("SELECT o_orderpriority, o_orderstatus, count(o_totalprice) AS n, round(min(o_totalprice), 4) AS low, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) - 1 AS INT) AS place FROM orders GROUP BY 1, 2")
def grouped_series(spark: SparkSession, d: str) -> DataFrame:
    s = plate.grouped_series(read(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return rounded(s.select("o_orderpriority", "o_orderstatus", F.size("values").cast("long").alias("n"), F.col("values")[0].alias("low"), "place"), 4)


@query(
    """WITH r AS (SELECT source, 'cluster_' || row_number() OVER (ORDER BY count(*) DESC, source) AS g FROM documents GROUP BY source)
SELECT doc_id, g AS by_cluster, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'unknown' END AS by_label, source AS by_source FROM documents JOIN r USING (source)"""
)
def resolve_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("cluster"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("label"), F.concat(F.lit("/data/"), "source", F.lit("/")).alias("source"))
    for by in ("cluster", "label", "source"):
        docs = plate.resolve_groups(docs, by).withColumnRenamed("group", f"by_{by}")
    return docs.select("doc_id", "by_cluster", "by_label", "by_source")


@query(
    """WITH m AS (SELECT list_filter(['g', 't'], lambda x: (x = 'g' AND quality = 1) OR (x = 't' AND toxic = 1)) AS truth, [CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.1 END, CASE WHEN toxic = 1 THEN 0.9 ELSE 0.4 END] AS p FROM labels),
c AS (SELECT ['g', 't'][k] AS class, list_contains(truth, ['g', 't'][k]) AS t, p[k] >= 0.5 AS s FROM m, (VALUES (1), (2)) v(k))
SELECT class, count(*) FILTER (t) AS n_true, count(*) FILTER (s) AS n_predicted, count(*) FILTER (t AND s) AS n_right, round(coalesce(2.0 * count(*) FILTER (t AND s) / nullif(count(*) FILTER (t) + count(*) FILTER (s), 0), 0), 6) AS f1 FROM c GROUP BY class"""
)
def multi_label_scores(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "labels")
    truth = F.filter(F.array(F.when(F.col("quality") == 1, "g"), F.when(F.col("toxic") == 1, "t")), lambda x: x.isNotNull())
    p = F.array(F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(0.1), F.when(F.col("toxic") == 1, 0.9).otherwise(0.4))
    return rounded(plate.multi_label_scores(m, truth, p, ["g", "t"]))


@query("SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels")
def subset_accuracy(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "labels")
    r = plate.subset_accuracy(m, F.array(F.col("quality"), F.lit(7)), F.array(F.lit(7), F.col("toxic")))
    return rounded(r.toDF("accuracy"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a=1,b=9,c=3' ELSE 'a=1,b=2' END AS merged FROM part")
def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    over = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("b"), F.lit(9), F.lit("c"), F.lit(3))).otherwise(F.create_map().cast("map<string,int>"))
    entries = F.array_sort(F.map_entries(vec.merge_maps(base, over)))
    return read(spark, d, "part").select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("merged"))


# --- vectors


@query("SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS first, round(list_max(v), 6) AS p, round(v[1], 6) AS prob_a FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def sorted_probabilities(spark: SparkSession, d: str) -> DataFrame:
    v = vec.doubles(F.col("embedding"))
    names = F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda k: k)
    best = vec.sort_probabilities(names, v)
    return rounded(read(spark, d, "embeddings").select("vec_id", best[0]["name"].alias("first"), best[0]["prob"].alias("p"), *vec.probabilities(v, ["a"])))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS first, 2 AS n FROM events")
def json_channels(spark: SparkSession, d: str) -> DataFrame:
    raw = F.to_json(F.array(F.col("user_id").cast("string"), F.lit("b")))
    return read(spark, d, "events").select("event_id", vec.json_list(raw)[0].alias("first"), F.size(vec.json_list(raw)).alias("n"))


@query("SELECT count(*) AS n, count(*) AS good FROM region")
def now_iso(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "region").select(vec.now_iso().alias("t")).agg(F.count("*").alias("n"), F.count_if(F.col("t").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$")).alias("good"))


@query("SELECT p_partkey, round(coalesce(10 + 190 * (p_size - a) / nullif(b - a, 0), 105), 6) AS area, round(p_size / 255.0, 6) AS unit, CAST(p_size AS INT) AS raw FROM part, (SELECT min(p_size) AS a, max(p_size) AS b FROM part)")
def scaled_values(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    lim = p.agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"))
    return rounded(p.join(F.broadcast(lim)).select("p_partkey", vec.bubble_area(F.col("p_size"), F.col("a"), F.col("b")).alias("area"), pixels.to_float_max(F.col("p_size"), 255).alias("unit"), pixels.to_float_max(F.col("p_size"), None).cast("int").alias("raw")))


@query(
    f"""WITH n AS (SELECT a.vec_id, sqrt(greatest(0, 2 - 2 * round({_DOT}, 12))) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 12) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
f AS (SELECT vec_id, dist FROM n WHERE k = 10), m AS (SELECT quantile_cont(dist, 0.5) AS m FROM f) SELECT vec_id, round(least(2, greatest(0.5, pow(dist / m, 0.7))), 4) AS scale FROM f, m"""
)
def density_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(embed.density_scale(vectors(spark, d), "vec_id", "embedding", 0.7), 4)


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS uncovered FROM embeddings")
def adaptive_cover(spark: SparkSession, d: str) -> DataFrame:
    """With a radius of its own every row is within it of a kept one."""
    v = vectors(spark, d)
    unit = v.select("vec_id", vec.l2_normalize(vec.doubles(F.col("embedding"))).alias("embedding"))
    scale = embed.density_scale(unit, "vec_id", "embedding", 1.0).cache()
    own = unit.join(scale, "vec_id")
    kept = unit.join(embed.greedy_cover(own, "vec_id", "embedding", 1.0, scale="scale"), "vec_id")
    far = embed.distance_to_kept(unit, kept, "vec_id", "embedding").join(scale, "vec_id")
    return far.agg(F.count("*").alias("n"), F.count_if(F.col("distance") > F.col("scale") + 1e-9).alias("uncovered"))


@query("SELECT greatest(1, CAST(count(*) // 10 AS BIGINT)) AS target, true AS near FROM embeddings")
def search_radius(spark: SparkSession, d: str) -> DataFrame:
    """The radius found keeps about the number asked for."""
    v = vectors(spark, d)
    unit = v.select("vec_id", vec.l2_normalize(vec.doubles(F.col("embedding"))).alias("embedding")).cache()
    target = max(1, unit.count() // 10)
    kept = embed.greedy_cover(unit, "vec_id", "embedding", embed.search_radius(unit, "vec_id", "embedding", target)).count()
    return spark.createDataFrame([(target, abs(kept - target) <= max(2, 0.05 * target))], "target long, near boolean")


@query(
    f"""WITH c AS (SELECT vec_id // 10 AS image, vec_id % 10 AS patch, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id // 10 < (SELECT max(vec_id) + 1 FROM embeddings) // 10),
u AS (SELECT image, patch, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) AS v FROM c), p AS (SELECT a.image, a.patch, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.image = b.image AND b.patch = 5 WHERE a.patch <> 5),
m AS (SELECT image, avg(s) AS m, sqrt(sum(s * s) - count(*) * avg(s) * avg(s)) AS n FROM p GROUP BY image), z AS (SELECT image, patch, (s - m) / greatest(n, 1e-8) AS z FROM p JOIN m USING (image))
SELECT round(avg(r), 6) AS index FROM (SELECT sum(a.z * b.z) AS r FROM z a JOIN z b ON a.patch = b.patch AND a.image < b.image GROUP BY a.image, b.image)"""
)
def content_dependence(spark: SparkSession, d: str) -> DataFrame:
    """Ten vectors make the patches of one image."""
    v = vectors(spark, d)
    whole = v.agg(F.floor((F.max("vec_id") + 1) / 10).alias("n"))
    patches = v.withColumn("image", F.floor(F.col("vec_id") / 10)).join(F.broadcast(whole)).filter("image < n").select("image", (F.col("vec_id") % 10).cast("int").alias("patch"), vec.doubles(F.col("embedding")).alias("v"))
    return rounded(embed.content_dependence(patches, "image", "patch", "v"))


@query(
    """WITH r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: exp(x / 0.1)) AS e, v FROM r), p AS (SELECT vec_id, v, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT round(avg(list_stddev_samp(v)), 6) AS head_logits_std, round(avg(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))) / ln(64)), 6) AS head_entropy, 1.0 AS teacher_student_sim FROM p"""
)
def collapse_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select(vec.doubles(F.col("embedding")).alias("v"))
    return rounded(embed.collapse_metrics(v, "v", "v", "v"))


@query("SELECT label, round(sum(w * x) / sum(w), 5) AS first FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, vec_id + 1 AS w FROM embeddings) GROUP BY label")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).groupBy(F.col("label").cast("int").alias("label")).agg(F.collect_list(F.struct(vec.doubles(F.col("embedding")).alias("v"), (F.col("vec_id") + 1).cast("double").alias("w"))).alias("t"))
    return rounded(rows.select("label", embed.pool(F.transform("t", lambda x: x["v"]), F.transform("t", lambda x: x["w"]))[0].alias("first")), 5)


@query("SELECT vec_id, CASE WHEN x >= 0 THEN 'p' ELSE 'n' END AS pred_class, round(1 / (1 + exp(-2 * x)), 6) AS prob_p FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def batch_scores(spark: SparkSession, d: str) -> DataFrame:
    """A plugged-in scorer: the logits are a vector's first number and its negative."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")[0].cast("double").alias("x"))
    s = embed.score_batches(v, ["x"], lambda pdf: np.stack([pdf["x"], -pdf["x"]], 1), ["p", "n"], "vec_id")
    return rounded(s.select("vec_id", "pred_class", "prob_p"))


@query("SELECT event_id, round(greatest(1 - value / 200, value / 300), 6) AS certainty FROM events")
def certainty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(read(spark, d, "events").select("event_id", embed.certainty([1 - F.col("value") / 200, F.col("value") / 300]).alias("certainty")))


@query("SELECT 'first' AS name, 'True' AS value UNION ALL SELECT 'distinct', 'True' UNION ALL SELECT 'spread', 'True' UNION ALL SELECT 'dimension', 'True' UNION ALL SELECT 'model', 'True' UNION ALL SELECT 'no model', 'True'")
def diverse_and_fitted(spark: SparkSession, d: str) -> DataFrame:
    """A diverse order, the dimension of a space, and label models, checked by what defines them."""
    v = vectors(spark, d)
    x = np.stack([r[0] for r in v.orderBy("vec_id").select("embedding").toLocalIterator()]).astype(float)
    order = embed.farthest_points(x, 20)
    gap = [((x[order[k]] - x[order[:k]]) ** 2).sum(1).min() for k in range(1, len(order))]
    space = embed.fit_space(v, "embedding", 64)
    k = embed.dimension_for(space, 0.9)
    share = np.cumsum(space.variance_share)
    state = v.withColumn("state", (F.col("label") == 1).cast("int"))
    return facts(spark, [
        ("first", order[0] == int(((x - x.mean(0)) ** 2).sum(1).argmax())), ("distinct", len(set(order)) == len(order)), ("spread", all(a >= b - 1e-9 for a, b in zip(gap, gap[1:]))), ("dimension", bool(share[k - 1] >= 0.9 - 1e-12 and (k == 1 or share[k - 2] < 0.9))),
        ("model", embed.fit_label_model(state, "embedding", "state") is not None), ("no model", embed.fit_label_model(state.filter("state = 0"), "embedding", "state") is None),
    ])


# --- clusters and samples


@query("SELECT n_regionkey AS cluster, CAST(row_number() OVER (ORDER BY round(sqrt(avg(n_nationkey) * avg(n_nationkey) + avg(length(n_name)) * avg(length(n_name))), 9), n_regionkey) AS INT) AS rank FROM nation GROUP BY n_regionkey")
def centroid_order(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_nationkey").alias("x"), F.length("n_name").alias("y"))
    return cluster.order_by_centroid(n, "cluster", "x", "y")


@query("SELECT 'better than labels' AS name, 'True' AS value UNION ALL SELECT 'about the target', 'True' UNION ALL SELECT 'within tolerance', 'True' UNION ALL SELECT 'by size', 'True'")
def cluster_choice(spark: SparkSession, d: str) -> DataFrame:
    """Communities, a ladder of resolutions and a target number, checked by what defines them."""
    v = vectors(spark, d)
    edges = embed.knn_graph(v, "vec_id", "embedding", 10).cache()
    made = cluster.Clusterings(edges)
    found = made.at(1.0)
    score = lambda c: cluster.modularity(edges, c).first()[0]
    known = score(v.select(F.col("vec_id").alias("node"), F.col("label").alias("cluster")))
    sizes = [r["n"] for r in found.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").collect()]
    chosen, _ = cluster.cluster_groups(made, (0.5, 1.0, 2.0))
    best = max(made.modularity(r) for r in (0.5, 1.0, 2.0))
    wanted, _ = cluster.resolution_for(made, 6)
    n = wanted.agg(F.count_distinct("cluster")).first()[0]
    return facts(spark, [("better than labels", score(found) >= known - 1e-9), ("about the target", 3 <= n <= 12), ("within tolerance", score(chosen) >= 0.95 * best - 1e-9), ("by size", sizes == sorted(sizes, reverse=True))])


@query(
    """WITH r AS (SELECT event_type, percent_rank() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS p FROM events) SELECT event_type, least(7, count(*) FILTER (p <= 0.25)) AS n FROM r GROUP BY event_type"""
)
def densest_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.densest(read(spark, d, "events"), "event_type", "value", 0.25, 7, ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT 'proportional' AS name, '1000,100' AS value UNION ALL SELECT 'small', '5,5' UNION ALL SELECT 'compressed', '1990,10' UNION ALL SELECT 'none', ''")
def group_quotas(spark: SparkSession, d: str) -> DataFrame:
    shown = lambda *a: ",".join(map(str, sampling.group_quotas(*a)))
    return facts(spark, [("proportional", shown([10000, 100], 1100)), ("small", shown([5, 5], 100)), ("compressed", shown([10000, 10], 2000)), ("none", shown([], 5))])


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids, true AS moved FROM events")
def shuffled_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same rows in another order for another seed."""
    e = read(spark, d, "events")
    ids = [[r[0] for r in sampling.shuffled(e, ["event_id"], s).select("event_id").limit(50).toLocalIterator()] for s in (1, 2)]
    rows = sampling.shuffled(e, ["event_id"], 1)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids")).withColumn("moved", F.lit(ids[0] != ids[1]))


@query("SELECT user_id, least(3, count(*)) AS n FROM events GROUP BY user_id")
def most_per_image(spark: SparkSession, d: str) -> DataFrame:
    return sampling.per_class(read(spark, d, "events"), ["user_id"], 3, ["event_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, least(2, count(*)) AS images FROM (SELECT DISTINCT event_type FROM events)")
def fit_sample(spark: SparkSession, d: str) -> DataFrame:
    """A bounded sample of images (here event types) for a fit."""
    all_ = read(spark, d, "events").select("event_type").distinct()
    return all_.agg(F.count("*").alias("n")).join(sampling.sample_rows(all_, 2, ["event_type"]).agg(F.count("*").alias("images")))


# --- image operators


@query(
    f"""WITH {_TILES}, n AS (SELECT a.vec_id, a.label, a.y, a.x, (SELECT count(*) FROM t b WHERE b.vec_id = a.vec_id AND b.label = a.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1) AS same FROM t a WHERE a.label > 0),
r AS (SELECT vec_id, label, coalesce(count(*) FILTER (same < 4 AND (y < 1 OR x < 1 OR y >= 7 OR x >= 7)) / nullif(count(*) FILTER (same < 4), 0), 0) AS ratio FROM n GROUP BY vec_id, label)
SELECT vec_id, label, count(*) AS n FROM t JOIN r USING (vec_id, label) WHERE ratio <= 0.4 GROUP BY vec_id, label"""
)
def drop_edge_objects(spark: SparkSession, d: str) -> DataFrame:
    kept = pixels.drop_edge_objects(tiles(spark, d), ["vec_id"], F.lit(8), F.lit(8), 0.4, 1)
    return kept.filter("label > 0").groupBy("vec_id", "label").agg(F.count("*").alias("n"))


@query(f"WITH {_TILES} SELECT DISTINCT vec_id, label FROM t WHERE label > 0")
def object_labels(spark: SparkSession, d: str) -> DataFrame:
    return pixels.labels_of(tiles(spark, d), ["vec_id"])


@query(f"WITH {_TILES} SELECT vec_id, label, count(*) AS n FROM t WHERE label > 0 GROUP BY vec_id, label HAVING count(*) >= 12")
def without_small(spark: SparkSession, d: str) -> DataFrame:
    return pixels.without_small(tiles(spark, d), ["vec_id"], 12).groupBy("vec_id", "label").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_TILES}, big AS (SELECT vec_id, label FROM t WHERE label > 0 GROUP BY ALL HAVING count(*) >= 5), o AS (SELECT t.* FROM t JOIN big USING (vec_id, label))
SELECT a.vec_id, a.label, count(*) AS segments, round(sum(a.y + dy / 2.0), 4) AS y FROM o a, (VALUES (0, -1), (0, 1), (-1, 0), (1, 0)) s(dy, dx)
WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.vec_id = a.vec_id AND b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx) GROUP BY a.vec_id, a.label"""
)
def outline_segments(spark: SparkSession, d: str) -> DataFrame:
    s = pixels.outlines(tiles(spark, d), ["vec_id"])
    return rounded(s.groupBy("vec_id", "label").agg(F.count("*").alias("segments"), F.sum((F.col("y0") + F.col("y1")) / 2).alias("y")), 4)


@query(f"WITH {_TILES} SELECT vec_id, y, x, round((value + label) / 2, 6) AS mean, round(greatest(value, label), 6) AS most, round(least(value, label), 6) AS least FROM t")
def merged_channels(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col("value"), F.col("label").cast("double")]
    return rounded(tiles(spark, d).select("vec_id", "y", "x", *(pixels.merge_channels(c, how).alias(n) for how, n in (("mean", "mean"), ("max", "most"), ("min", "least")))))


@query(
    f"""WITH {_TILES}, o AS (SELECT * FROM t WHERE value <> 0), l AS (SELECT vec_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM o GROUP BY vec_id), s AS (SELECT vec_id, lo, hi, (greatest(lo, least(hi, value)) - lo) / (hi - lo) AS v FROM o JOIN l USING (vec_id)),
m AS (SELECT vec_id, any_value(lo) AS lo, any_value(hi) AS hi, avg(v) AS m, stddev_pop(v) AS s FROM s GROUP BY vec_id)
SELECT vec_id, y, x, round(CASE WHEN label > 0 THEN ((greatest(lo, least(hi, value)) - lo) / (hi - lo) - m) / s ELSE 0 END, 5) + 0.0 AS normalized FROM t JOIN m USING (vec_id)"""
)
def normalize_by_reference(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the pixels with a value, applied as a fixed transform inside the objects."""
    px = tiles(spark, d).withColumn("channel", F.lit("1"))
    stats = pixels.reference_stats(px, ["vec_id"], low=5, high=95)
    return rounded(pixels.normalize_by_reference(px, stats, ["vec_id", "channel"], inside=F.col("label") > 0).select("vec_id", "y", "x", "normalized"), 5)


@query(f"WITH {_TILES} SELECT vec_id, y, x, round(greatest(0.0, least(0.2, value)) / 0.2 * 2 - 1 + 1e-9, 4) + 0.0 AS normalized FROM t")
def normalize_fixed(spark: SparkSession, d: str) -> DataFrame:
    px = tiles(spark, d).withColumn("channel", F.lit("1"))
    stats = spark.createDataFrame([("1", 0.0, 0.2, 0.1, 0.1)], "channel string, lo double, hi double, mean double, std double")
    return rounded(pixels.normalize_fixed(px, stats, ["channel"]).select("vec_id", "y", "x", (F.col("normalized") + 1e-9).alias("normalized")), 4)


@query(f"WITH {_TILES}, k AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, avg(value) AS value FROM t GROUP BY ALL) SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(value, 5) AS value FROM k")
def resize_images(spark: SparkSession, d: str) -> DataFrame:
    """At half size a pixel is the mean of four."""
    return rounded(kernels.resize_images(tiles(spark, d), ["vec_id"], 0.5), 5)


@query(f"WITH {_TILES} SELECT vec_id, round(sum(value * value), 5) AS energy FROM t GROUP BY vec_id")
def dct_energy(spark: SparkSession, d: str) -> DataFrame:
    """The cosine transform keeps the sum of squares."""
    px = kernels.map_images(tiles(spark, d), ["vec_id"], kernels.dct2)
    return rounded(px.groupBy("vec_id").agg(F.sum(F.col("value") * F.col("value")).alias("energy")), 5)


@query("SELECT 64 AS pixels, true AS even")
def illumination(spark: SparkSession, d: str) -> DataFrame:
    """Images of one uneven field, corrected: what is left of the unevenness is small."""
    px = tiles(spark, d).select("vec_id", "y", "x", ((1 + 0.3 * F.cos(F.pi() * (F.col("y") + 0.5) / 8)) * (100 + F.pmod(F.col("vec_id"), F.lit(17)) * 10) + 20).alias("value")).withColumn("channel", F.lit("1"))
    fields = kernels.fit_fields(px, ["channel"], ["vec_id"])
    even = kernels.apply_fields(px, fields, ["channel"]).groupBy("vec_id").agg((F.stddev_pop("value") / F.avg("value")).alias("s")).agg((F.max("s") < 0.02).alias("even"))
    return fields.agg(F.count("*").cast("int").alias("pixels")).join(F.broadcast(even))


@query(f"WITH {_TILES} SELECT vec_id, round(max(value) - min(value), 6) AS range FROM t GROUP BY vec_id")
def registered_kernel(spark: SparkSession, d: str) -> DataFrame:
    """A kernel of one's own, by name."""
    kernels.register_kernel("range", lambda pdf: [{"range": float(pdf["value"].max() - pdf["value"].min())}])
    return rounded(kernels.per_site(tiles(spark, d), ["vec_id"], "range", ["range"]))


@query("SELECT CAST(NULL AS BIGINT) AS vec_id WHERE false")
def quarantined(spark: SparkSession, d: str) -> DataFrame:
    """No site fails, so none is set aside."""
    t = tiles(spark, d)
    return kernels.bad_sites(t, kernels.per_site(t, ["vec_id"], "threshold_objects", ["object_area"], threshold=0.1), ["vec_id"]).select(F.col("vec_id").cast("long").alias("vec_id"))


@query(
    f"""WITH {_TILES}, c AS (SELECT vec_id, y, x, label, value AS a, value * value AS b FROM t), p AS (SELECT vec_id, label, CASE WHEN (x + y) % 3 > 0 THEN CASE WHEN x < 4 THEN 5 ELSE 6 END ELSE 0 END AS parent, count(*) AS n FROM c WHERE label > 0 GROUP BY ALL),
m AS (SELECT vec_id, label, parent FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY n DESC, parent) AS k FROM p WHERE parent > 0) WHERE k = 1)
SELECT c.vec_id, 'A' || (c.vec_id % 3) AS well, c.label, CAST(coalesce(any_value(m.parent), 0) AS BIGINT) AS parent_organ, count(*) AS shape_area, round(avg(a), 6) AS intensity_mean_a, round(quantile_cont(b, 0.5), 6) AS intensity_median_b,
round(coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), -9), 6) AS corr FROM c LEFT JOIN m USING (vec_id, label) WHERE c.label > 0 GROUP BY c.vec_id, c.label"""
)
def measure_objects(spark: SparkSession, d: str) -> DataFrame:
    """All feature groups of every object; the columns that SQL can express are shown."""
    px = tiles(spark, d).select("vec_id", "y", "x", "label", F.col("value").alias("a"), (F.col("value") * F.col("value")).alias("b"))
    organ = px.select("vec_id", "y", "x", F.when((F.col("x") + F.col("y")) % 3 > 0, F.when(F.col("x") < 4, 5).otherwise(6)).otherwise(0).alias("label"))
    meta = read(spark, d, "embeddings").select("vec_id", F.concat(F.lit("A"), (F.col("vec_id") % 3).cast("string")).alias("well"))
    out = measure.measure_objects(px, ["vec_id"], ["a", "b"], F.lit(8), F.lit(8), intensity=["a", "b"], radial=["a"], granularity=["b"], texture=["a"], pairs=[("a", "b")], parent=organ, parent_name="organ", metadata=meta)
    return rounded(out.select("vec_id", "well", "label", "parent_organ", "shape_area", "intensity_mean_a", "intensity_median_b", F.coalesce("corr_a_b", F.lit(-9.0)).alias("corr")))
