"""The library's queries on the star-schema tables, each with the SQL that gives the same rows.

``lineitem`` rows stand for object measurements (order = folder, line = object), ``orders`` for
sites, ``events`` for wells and decisions, ``embeddings`` for features, or for 8 x 8 images.
Floating results are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspark.functions import text as tx
from wellspark.functions import vector as vec
from wellspark.operators import cluster, embed, filters, fuse, kernels, labels, pixels, plate, sampling
from wellspark.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; negative zero becomes zero."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


# --- the flagship: fuse objects and predictions, add plate metadata, filter, aggregate


def objects(spark: SparkSession, d: str) -> DataFrame:
    """One row per object: raw keys repeat, so they are reduced first; every 11th folder is null."""
    li = read(spark, d, "lineitem")
    one = li.groupBy("l_orderkey", F.col("l_linenumber").alias("label")).agg(F.sum("l_quantity").alias("area"), F.avg("l_extendedprice").alias("intensity"))
    return one.select(F.when(F.col("l_orderkey") % 11 != 0, F.col("l_orderkey")).alias("directory"), F.col("l_orderkey").alias("site"), "label", "area", "intensity")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").filter(F.col("l_orderkey") % 7 != 0)
    one = li.groupBy("l_orderkey", F.col("l_linenumber").alias("label")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("pred_prob"))
    return one.select(F.when(F.col("l_orderkey") % 11 != 0, F.col("l_orderkey")).alias("directory"), "label", F.col("l_orderkey").alias("uid"), "pred_prob")


_OBJECTS = """
o AS (SELECT CASE WHEN l_orderkey % 11 <> 0 THEN l_orderkey END AS directory, l_orderkey AS site, l_linenumber AS label, sum(l_quantity) AS area, avg(l_extendedprice) AS intensity
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
p AS (SELECT CASE WHEN l_orderkey % 11 <> 0 THEN l_orderkey END AS directory, l_linenumber AS label, l_orderkey AS uid, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS pred_prob
  FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY l_orderkey, l_linenumber)"""


@query(
    f"""WITH {_OBJECTS},
f AS (SELECT coalesce(o.directory, p.directory) AS directory, area, pred_prob FROM o FULL JOIN p ON o.directory IS NOT DISTINCT FROM p.directory AND o.label = p.label WHERE o.directory IS NOT NULL OR p.directory IS NOT NULL),
m AS (SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name AS well, count(*) AS n, round(avg(area), 6) AS mean_area, round(stddev_samp(area) / sqrt(count(area)), 6) AS sem_area, round(avg(pred_prob), 6) AS mean_prob
FROM f JOIN m ON f.directory = o_orderkey WHERE regexp_matches(n_name, '[0-4]$') GROUP BY n_name"""
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Null-safe fusion of two tables per object, plate metadata, a regex filter, and well statistics."""
    own = objects(spark, d).drop("site").filter("directory is not null")
    pred = predictions(spark, d).drop("uid").filter("directory is not null")
    fused = fuse.fuse_unique([fuse.Source(own, "cell", "a"), fuse.Source(pred, "inference", "b", is_infer=True)], ["directory", "label"])
    people = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    meta = read(spark, d, "orders").select(F.col("o_orderkey").alias("directory"), "o_custkey").join(people, F.col("o_custkey") == F.col("c_custkey")).select("directory", F.col("n_name").alias("well"))
    rows = filters.filter_regex(fused.join(meta, "directory"), "well", "[0-4]$")
    sem = F.try_divide(F.stddev_samp("area"), F.sqrt(F.count("area")))
    return rounded(rows.groupBy("well").agg(F.count("*").alias("n"), F.avg("area").alias("mean_area"), sem.alias("sem_area"), F.avg("pred_prob").alias("mean_prob")))


# --- joins and fusion


@query(
    f"""WITH {_OBJECTS}, a AS (SELECT directory, label, site, area FROM o), b AS (SELECT directory, label, uid AS site_b, pred_prob FROM p)
SELECT coalesce(a.directory, b.directory) AS directory, coalesce(a.label, b.label) AS label, a.site, area, b.site_b AS "infer/site", round(pred_prob, 6) AS pred_prob
FROM a FULL JOIN b ON a.directory IS NOT DISTINCT FROM b.directory AND a.label IS NOT DISTINCT FROM b.label"""
)
def fuse_outer(spark: SparkSession, d: str) -> DataFrame:
    """Null folders match each other and fan out (the square of their rows); a clashing column is renamed.  Rounding comes before the fan-out."""
    b = predictions(spark, d).withColumnRenamed("uid", "site")
    return fuse.fuse_pair(rounded(objects(spark, d).drop("intensity")), fuse.Source(rounded(b), "inference", "infer"), spread=True)


@query(
    f"""WITH {_OBJECTS} SELECT directory, label, site, area, NULL::BIGINT AS uid, NULL::DOUBLE AS pred_prob, 'cell' AS mask FROM o
UNION ALL SELECT directory, label, NULL, NULL, uid, round(pred_prob, 6), 'nuclei' FROM p"""
)
def fuse_stack(spark: SparkSession, d: str) -> DataFrame:
    """Sources of different masks are stacked by name."""
    s = [fuse.Source(objects(spark, d).drop("intensity"), "cell", "x", "cell"), fuse.Source(predictions(spark, d), "nuclei", "x", "nuclei")]
    return rounded(fuse.fuse_sources(s))


@query(
    f"""WITH {_OBJECTS} SELECT coalesce(o.directory, p.directory) AS directory, coalesce(o.label, p.label) AS label, o.area AS m1_area, round(p.pred_prob, 6) AS m2_pred_prob
FROM (SELECT * FROM o WHERE directory IS NOT NULL) o FULL JOIN (SELECT * FROM p WHERE directory IS NOT NULL) p ON o.directory = p.directory AND o.label = p.label"""
)
def fuse_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Two models' prefixes go to all columns but the identity."""
    a = objects(spark, d).filter("directory is not null").select("directory", "label", "area")
    b = predictions(spark, d).filter("directory is not null").select("directory", "label", "pred_prob")
    return rounded(fuse.fuse_sources([fuse.Source(a, "t", "a", "cell", True, "m1"), fuse.Source(b, "t", "b", "cell", True, "m2")]))


@query("""SELECT doc_id, lang, quality, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS size FROM documents LEFT JOIN labels USING (doc_id)""")
def uid_left_join(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").withColumnRenamed("doc_id", "uid")
    inference = docs.select("uid", "lang", F.lit(None).cast("binary").alias("features"))
    reduction = read(spark, d, "labels").select(F.col("doc_id").alias("uid"), "quality")
    clusters = docs.filter(F.col("uid") % 3 == 0).select("uid", F.col("n_chars").alias("size"))
    with_id = inference.withColumn("doc_id", F.col("uid"))
    return fuse.star_join(with_id, [reduction], clusters).select("doc_id", "lang", "quality", "size")


@query(
    """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS directory, o_totalprice AS price FROM orders),
e AS (SELECT * FROM o WHERE o_orderkey % 2 = 0), i AS (SELECT o_orderkey, directory, price + 1 AS price FROM o WHERE o_orderkey % 2 = 1 AND directory LIKE '%-03')
SELECT o_orderkey, directory, round(price, 6) AS price FROM e WHERE directory NOT IN (SELECT directory FROM i) UNION ALL SELECT o_orderkey, directory, round(price, 6) FROM i"""
)
def upsert_by_directory(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("directory"), F.col("o_totalprice").alias("price"))
    new = o.filter((F.col("o_orderkey") % 2 == 1) & F.col("directory").endswith("-03")).withColumn("price", F.col("price") + 1)
    return rounded(fuse.upsert(o.filter(F.col("o_orderkey") % 2 == 0), new))


@query(
    """WITH s(well, a) AS (SELECT 'A' || n_nationkey, CAST(n_nationkey AS BIGINT) FROM nation WHERE n_nationkey % 2 = 0), t(well, b) AS (SELECT 'A' || n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0)
SELECT coalesce(s.well, t.well) AS well, a, b FROM s FULL JOIN t ON s.well = t.well"""
)
def join_sheets(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    well = F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("well")
    return fuse.join_sheets([n.filter("n_nationkey % 2 = 0").select(well, F.col("n_nationkey").cast("long").alias("a")), n.filter("n_nationkey % 3 = 0").select(well, F.col("n_name").alias("b"))])


@query("""SELECT chr(65 + n_regionkey) || c AS well, CAST(n_nationkey * c AS VARCHAR) AS value FROM nation, (VALUES (1), (2), (3)) t(c) WHERE n_nationkey % 5 <> c""")
def plate_unpivot(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    wide = n.select(F.char(F.lit(97) + F.col("n_regionkey").cast("long")).alias("row"), *(F.when(F.col("n_nationkey") % 5 != c, F.col("n_nationkey") * c).alias(f"0{c}") for c in (1, 2, 3)))
    return fuse.unpivot_plate(wide, "row", "value")


@query(
    """SELECT event_id, 'a0' || (user_id % 7) AS well, CASE WHEN user_id % 7 IN (1, 2, 3) THEN 'batch ' || (user_id % 7) END AS batch FROM events"""
)
def join_plate_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Wells match in their normal form; the original text stays."""
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("a0"), (F.col("user_id") % 7).cast("string")).alias("well"))
    meta = spark.createDataFrame([(f"A{k}", f"batch {k}") for k in (1, 2, 3)], "well string, batch string")
    return fuse.join_plate_metadata(e, meta)


@query("""SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    regions = read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return fuse.map_values(read(spark, d, "nation"), regions, "n_regionkey", "r_name").select("n_name", "r_name")


@query(
    """WITH n AS (SELECT l_orderkey AS child, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE l_suppkey END AS parent, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT child, parent, row_number() OVER (PARTITION BY child ORDER BY n DESC, parent) AS k FROM n WHERE parent > 0)
SELECT c.child, CAST(coalesce(r.parent, 0) AS BIGINT) AS parent FROM (SELECT DISTINCT child FROM n WHERE child > 0) c LEFT JOIN r ON r.child = c.child AND k = 1"""
)
def parent_majority(spark: SparkSession, d: str) -> DataFrame:
    """A row is a pixel: its order is the child object and its supplier the parent; every fourth supplier is background."""
    px = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy(F.lit(0))).alias("copy"))
    at = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copy"]
    child = px.select(*at, F.col("l_orderkey").alias("label"))
    parent = px.select(*at, F.when(F.col("l_suppkey") % 4 == 0, 0).otherwise(F.col("l_suppkey")).alias("label"))
    return pixels.parent_majority(child, parent, at, []).select("child", F.col("parent").cast("long").alias("parent"))


# --- aggregates


def wells(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("well"), "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"))


_WELLS = "w AS (SELECT CAST(user_id AS VARCHAR) AS well, event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value, CASE WHEN event_id % 3 <> 0 THEN event_type END AS kind FROM events)"


@query(f"WITH {_WELLS} SELECT well, round(avg(value), 6) AS value FROM w GROUP BY well HAVING avg(value) IS NOT NULL")
def well_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plate.aggregate_by_well(wells(spark, d), "value", "mean"))


@query(f"WITH {_WELLS} SELECT well, round(coalesce(sum(value), 0), 4) AS value FROM w GROUP BY well")
def well_sum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plate.aggregate_by_well(wells(spark, d), "value", "sum"), 4)


@query(f"WITH {_WELLS} SELECT well, round(stddev_samp(value), 6) AS value FROM w GROUP BY well HAVING stddev_samp(value) IS NOT NULL")
def well_std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plate.aggregate_by_well(wells(spark, d), "value", "std"))


@query(f"WITH {_WELLS} SELECT well, arg_min(kind, event_id) FILTER (kind IS NOT NULL) AS value FROM w GROUP BY well HAVING count(kind) > 0")
def well_first(spark: SparkSession, d: str) -> DataFrame:
    return plate.aggregate_by_well(wells(spark, d), "kind", order="event_id")


@query("SELECT l_suppkey AS well, count(DISTINCT l_linenumber) AS n_labels FROM lineitem GROUP BY 1")
def object_counts(spark: SparkSession, d: str) -> DataFrame:
    return plate.object_counts(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("well"), F.col("l_linenumber").alias("label")))


@query("SELECT min(value) AS low, max(value) AS high FROM events")
def global_minmax(spark: SparkSession, d: str) -> DataFrame:
    return plate.color_range(read(spark, d, "events"), "value")


@query(
    """SELECT event_type, round(avg(value), 6) AS mean, round(sum(value), 3) AS sum, round(quantile_cont(value, 0.001), 6) AS p0_1, round(quantile_cont(value, 0.01), 6) AS p1_0, round(quantile_cont(value, 0.25), 6) AS p25_0,
round(quantile_cont(value, 0.75), 6) AS p75_0, round(quantile_cont(value, 0.99), 6) AS p99_0, round(quantile_cont(value, 0.999), 6) AS p99_9 FROM events GROUP BY event_type"""
)
def image_quantiles(spark: SparkSession, d: str) -> DataFrame:
    r = pixels.image_profile(read(spark, d, "events"), ["event_type"])
    return rounded(r).withColumn("sum", F.round("sum", 3))


@query(
    """SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(stddev_pop(l_quantity), 6) AS std, round(sum(l_quantity), 3) AS sum FROM lineitem GROUP BY l_suppkey"""
)
def object_intensity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pixels.object_intensity(read(spark, d, "lineitem"), ["l_suppkey"], "l_quantity"))


@query(
    """SELECT l_suppkey, round(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 6) AS corr_l_quantity_l_extendedprice,
round(covar_pop(l_quantity, l_discount) / nullif(stddev_pop(l_quantity) * stddev_pop(l_discount), 0), 6) AS corr_l_quantity_l_discount,
round(covar_pop(l_extendedprice, l_discount) / nullif(stddev_pop(l_extendedprice) * stddev_pop(l_discount), 0), 6) AS corr_l_extendedprice_l_discount FROM lineitem GROUP BY l_suppkey"""
)
def object_pearson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pixels.pearson(read(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount"]))


@query(
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS sem FROM orders GROUP BY 1, 2"""
)
def mean_sem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plate.mean_sem(read(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice"), 4)


@query(
    """WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT g AS o_orderpriority, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
max(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1) AND o_totalprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high FROM orders JOIN q ON g = o_orderpriority GROUP BY g, q1, median, q3"""
)
def box_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plate.box_stats(read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), 4)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return plate.facets(read(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plate.confusion(read(spark, d, "labels"), "quality", "toxic"))


@query(
    """WITH c AS (SELECT c, (SELECT count(*) FROM labels WHERE quality = c) AS t, (SELECT count(*) FROM labels WHERE toxic = c) AS p, (SELECT count(*) FROM labels WHERE quality = c AND toxic = c) AS r FROM (VALUES (0), (1)) v(c))
SELECT round(sum(r) / sum(t), 6) AS accuracy, round(avg(2.0 * r / (t + p)), 6) AS macro_f1 FROM c"""
)
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plate.accuracy_macro_f1(read(spark, d, "labels"), "quality", "toxic"))


@query("SELECT c AS class, count(*) AS n FROM (SELECT unnest(CASE WHEN quality = 1 AND toxic = 1 THEN ['good', 'toxic'] WHEN quality = 1 THEN ['good'] WHEN toxic = 1 THEN ['toxic'] ELSE [] END) AS c FROM labels) GROUP BY c")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat_ws(" ; ", F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))
    return plate.class_distribution(read(spark, d, "labels").select(named.alias("l")), tx.split_labels(F.col("l")))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS n_kept, count(*) AS n_total FROM lineitem GROUP BY 1")
def per_group_summary(spark: SparkSession, d: str) -> DataFrame:
    return plate.summary_per_group(read(spark, d, "lineitem").withColumn("kept", F.col("l_returnflag") == "R"), "l_suppkey", "kept")


@query("SELECT source, count(*) AS n, 'cluster_' || row_number() OVER (ORDER BY count(*) DESC, source) AS name FROM documents GROUP BY source")
def cluster_size_rank(spark: SparkSession, d: str) -> DataFrame:
    return plate.size_rank(read(spark, d, "documents"), "source")


@query("SELECT CAST(max(ascii(substr(w, 1, 1)) - 64) AS INT) AS rows, CAST(max(CAST(substr(w, 2) AS INT)) AS INT) AS cols FROM (SELECT chr(CAST(65 + n_nationkey % 8 AS INT)) || (n_nationkey + 1) AS w FROM nation)")
def plate_dims(spark: SparkSession, d: str) -> DataFrame:
    w = F.concat(F.char((65 + F.col("n_nationkey") % 8).cast("long")), (F.col("n_nationkey") + 1).cast("string"))
    return plate.plate_size(read(spark, d, "nation").select(w.alias("well")))


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || q, ',' ORDER BY l_linenumber) AS vals FROM (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def per_object_values(spark: SparkSession, d: str) -> DataFrame:
    one = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("q"))
    m = plate.per_object_values(one, ["l_orderkey"], "l_linenumber", "q")
    return m.select("l_orderkey", F.array_join(F.transform(F.map_entries("values"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("vals"))


@query(
    """WITH l AS (SELECT min(value) AS a, max(value) AS b, count(*) AS n FROM events)
SELECT CAST(least(9, floor((value - a) / ((b - a) / 10))) AS INT) AS bin, count(*) AS n, round(count(*) / (any_value(n) * any_value((b - a) / 10)), 6) AS density FROM events, l GROUP BY 1"""
)
def pdf_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plate.density(read(spark, d, "events"), "value", 10))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 1")
def duplicate_detection(spark: SparkSession, d: str) -> DataFrame:
    return fuse.duplicates(read(spark, d, "lineitem"), "l_suppkey")


# --- filters, text, order


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'ring|^s') AND regexp_matches(p_brand, '#[12]')")
def filter_regex(spark: SparkSession, d: str) -> DataFrame:
    return filters.apply_filters(read(spark, d, "part"), [("p_name", "ring|^s"), ("p_brand", "#[12]"), ("p_type", ""), (None, "x")]).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE (p_type = 'ECONOMY' AND p_size > 10 AND NOT p_brand IN ('Brand#1', 'Brand#2')) OR p_retailprice >= 1500")
def filter_expr(spark: SparkSession, d: str) -> DataFrame:
    out, error = filters.filter_expression(read(spark, d, "part"), "((p_type == 'ECONOMY') & (p_size > 10) & ~(p_brand in [\"Brand#1\", 'Brand#2'])) | (p_retailprice >= 1500)")
    if error:
        raise ValueError(error)
    return out.select("p_partkey")


@query(
    """WITH p AS (SELECT page_id, split_part(url, '/', 3) AS directory FROM pages), m AS (SELECT * FROM p WHERE directory = 'therha.example.com' OR starts_with(directory, 'therha.example.com/'))
SELECT * FROM m UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM m)"""
)
def scope_by_directory(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", F.split("url", "/")[2].alias("directory"))
    return filters.scope_by_directory(p, ["therha.example.com"])


@query("SELECT page_id, split_part(url, '/', 3) AS directory FROM pages")
def scope_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", F.split("url", "/")[2].alias("directory"))
    return filters.scope_by_directory(p, ["no.such.host"])


@query("SELECT event_id, 'A' || (user_id % 5) AS well, CAST(user_id % 3 AS VARCHAR) AS field FROM events WHERE user_id % 5 IN (2, 4) AND user_id % 3 IN (1, 0)")
def lookup_rows(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("A"), (F.col("user_id") % 5).cast("string")).alias("well"), (F.col("user_id") % 3).cast("string").alias("field"))
    return filters.lookup_rows(e, ["a04", "A2"], ["1", "0"])


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#3') AND CAST(p_size AS VARCHAR) IN ('5', '6', '7')")
def filter_rows_by_extra(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_extra(read(spark, d, "part"), {"p_brand": ["Brand#1", "Brand#3"], "p_size": ["5", "6", "7"], "unknown": ["x"], "p_type": []}).select("p_partkey")


@query("SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#([0-9]+)', 1) AS kind, regexp_extract(c_name, '^([A-Za-z]+)#([0-9]+)', 2) AS number FROM customer")
def regex_capture(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", *(c.alias(n) for n, c in tx.captures(F.col("c_name"), r"(?P<kind>[A-Za-z]+)#(?P<number>[0-9]+)").items()))


@query(
    """SELECT p_partkey, CASE WHEN r <= 26 THEN chr(CAST(64 + r AS INT)) ELSE chr(CAST(64 + (r - 1) // 26 AS INT)) || chr(CAST(65 + (r - 1) % 26 AS INT)) END || p_size AS well FROM (SELECT *, p_partkey % 300 + 1 AS r FROM part)"""
)
def derive_well(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", tx.derive_well((F.col("p_partkey") % 300 + 1).cast("string"), F.concat(F.lit("0"), F.col("p_size").cast("string"))).alias("well"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'B' || p_size ELSE p_brand END AS well FROM part")
def normalize_well(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("b00"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))
    return read(spark, d, "part").select("p_partkey", tx.normalize_well(w).alias("well"))


@query("SELECT s AS value FROM (SELECT DISTINCT source AS s FROM documents) ORDER BY CAST(substr(s, 4) AS INT) LIMIT 12")
def natsort_top(spark: SparkSession, d: str) -> DataFrame:
    return plate.natural_distinct(read(spark, d, "documents"), "source", 12)


@query("SELECT s AS level, CAST(row_number() OVER (ORDER BY CAST(substr(s, 4) AS INT)) - 1 AS INT) AS place FROM (SELECT DISTINCT source AS s FROM documents)")
def axis_index(spark: SparkSession, d: str) -> DataFrame:
    return plate.axis_index(read(spark, d, "documents"), "source")


@query(
    """SELECT o_orderkey, 'priority=' || o_orderpriority || CASE WHEN o_orderkey % 4 <> 0 THEN '|status=' || o_orderstatus ELSE '' END AS site_key, CASE WHEN o_orderkey % 10 < 5 THEN 'ch' || o_orderkey ELSE 'x' || o_orderkey END AS channel FROM orders"""
)
def shared_key(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("status"))
    channel = F.when(F.col("o_orderkey") % 10 < 5, F.col("o_orderkey").cast("string")).otherwise(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", tx.shared_key(["priority", "status"]).alias("site_key"), tx.channel_column(channel).alias("channel"))


@query(
    """SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS directory, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN page_id % 3 = 0 THEN 'mapped' ELSE regexp_extract(regexp_replace(regexp_replace(url, '/[^/]*$', ''), '/+$', ''), '([^/]*)$', 1) END AS truth FROM pages"""
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    folder = tx.source_directory([F.lit(None).cast("string"), u])
    return read(spark, d, "pages").select("page_id", folder.alias("directory"), tx.base_name(u).alias("name"), tx.truth_from_directory(folder, F.when(F.col("page_id") % 3 == 0, "mapped")).alias("truth"))


@query("SELECT p_partkey, (10000 + p_size) || p_brand AS tile, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS clean, 'x' || '0' || substr(p_name, 3) AS spliced FROM part")
def naming(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    dirty = F.when(F.col("p_partkey") % 5 == 0, F.when(F.col("p_partkey") % 2 == 0, "None").otherwise("NULL")).otherwise(F.col("p_type"))
    fixed = F.concat(F.lit("x"), F.substring("p_name", 2, 1000))
    return p.select("p_partkey", tx.tile_name(F.col("p_brand"), F.col("p_size")).alias("tile"), tx.null_strings(dirty).alias("clean"), tx.splice(fixed, F.lit(2), F.lit(1), F.lit("0")).alias("spliced"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS first FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    names = F.to_json(F.array("event_type", F.lit("b")))
    text = F.when(F.col("event_id") % 2 == 0, names).otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), vec.json_first(text).alias("first"))


@query("""SELECT event_id, substr(md5('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 12) AS k FROM events""")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", vec.cache_key(F.col("event_type"), F.col("user_id")).alias("k"))


@query(
    """SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS sig, round(greatest(0, least(1, (value - 10) / 80)), 6) AS scaled, round(1 - pow(greatest(0, least(1, (value - 10) / 80)), 0.5), 6) AS inverted, round(least(2, greatest(0.5, pow((value + 1) / 50, 0.7))), 6) AS scale, round(value / 255, 6) AS unit FROM events"""
)
def scalar_math(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return rounded(read(spark, d, "events").select("event_id", vec.sigmoid(v / 100).alias("sig"), vec.gamma(v, 10, 90).alias("scaled"), vec.gamma(v, 10, 90, 0.5, True).alias("inverted"), vec.adaptive_scale(v + 1, F.lit(50.0), 0.7).alias("scale"), (v / 255).alias("unit")))


@query("SELECT c_custkey, coalesce(try_cast(CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE), 0.0) AS p FROM customer")
def parse_probability(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return read(spark, d, "customer").select("c_custkey", vec.parse_probability(t).alias("p"))


@query("SELECT p_partkey, list_sort(list_distinct(CASE WHEN p_size % 2 = 0 THEN ['A1', 'B2'] ELSE ['B2', 'C3'] END || ['C3']))::VARCHAR AS added, CASE WHEN p_size % 2 = 0 THEN '[A1, B2, C3]' ELSE '[B2]' END AS toggled FROM part")
def combine_selection(spark: SparkSession, d: str) -> DataFrame:
    now = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("A1"), F.lit("B2"))).otherwise(F.array(F.lit("B2"), F.lit("C3")))
    shown = lambda a: F.concat(F.lit("["), F.array_join(F.array_sort(a), ", "), F.lit("]"))
    c = F.array(F.lit("C3"))
    return read(spark, d, "part").select("p_partkey", shown(fuse.combine_selection(now, c, "add")).alias("added"), shown(fuse.combine_selection(now, c, "toggle")).alias("toggled"))


# --- label project


def decision_log(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    state = F.when(F.col("event_id") % 7 == 0, None).otherwise((F.col("value") > 50).cast("int"))
    return e.select(
        F.col("event_id").alias("log_id"), F.lit(None).cast("string").alias("ts"), F.lit(1).cast("long").alias("session_id"), F.floor(F.col("event_id") / 3).cast("long").alias("op_id"),
        F.col("user_id").alias("cell_id"), (F.length("event_type") % 3).cast("long").alias("label_id"), state.cast("int").alias("state"),
    )


_LOG = "g AS (SELECT event_id AS log_id, event_id // 3 AS op_id, user_id AS cell_id, CAST(length(event_type) % 3 AS BIGINT) AS label_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN value > 50 THEN 1 ELSE 0 END AS state FROM events)"
_STATES = f"{_LOG}, s AS (SELECT cell_id, label_id, state FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, label_id ORDER BY log_id DESC) AS k FROM g) WHERE k = 1 AND state IS NOT NULL)"


@query(f"WITH {_STATES} SELECT * FROM s")
def label_current_state(spark: SparkSession, d: str) -> DataFrame:
    return labels.current_states(decision_log(spark, d))


@query(f"WITH {_STATES} SELECT l AS label_id, (SELECT count(*) FROM s WHERE label_id = l AND state = 1) AS n_pos, (SELECT count(*) FROM s WHERE label_id = l AND state = 0) AS n_neg FROM range(4) t(l)")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_counts(spark.range(4).withColumnRenamed("id", "label_id"), labels.current_states(decision_log(spark, d)))


@query(
    f"""WITH {_LOG}, t AS (SELECT DISTINCT cell_id, label_id FROM g WHERE op_id = (SELECT max(op_id) FROM g)), f AS (SELECT min(log_id) AS first FROM g WHERE op_id = (SELECT max(op_id) FROM g)),
b AS (SELECT cell_id, label_id, state FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, label_id ORDER BY log_id DESC) AS k FROM g WHERE log_id < (SELECT first FROM f)) WHERE k = 1 AND state IS NOT NULL)
SELECT * FROM b"""
)
def label_undo(spark: SparkSession, d: str) -> DataFrame:
    """The states after the last operation is undone are those before it."""
    undone = spark.createDataFrame([], "op_id long")
    log, _ = labels.undo(decision_log(spark, d), undone, 1)
    return labels.current_states(log)


@query(f"WITH {_STATES} SELECT count(DISTINCT c_custkey) AS total, count(DISTINCT cell_id) AS labelled, count(DISTINCT c_custkey) - count(DISTINCT cell_id) AS unlabelled FROM customer LEFT JOIN s ON c_custkey = cell_id")
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"))
    return labels.project_stats(cells, labels.current_states(decision_log(spark, d)))


@query(f"WITH {_STATES} SELECT 'cell/' || cell_id AS filepath, string_agg('label ' || label_id, ';' ORDER BY label_id) AS labels FROM s WHERE state = 1 GROUP BY cell_id")
def label_export(spark: SparkSession, d: str) -> DataFrame:
    states = labels.current_states(decision_log(spark, d))
    cells = states.select("cell_id").distinct().withColumn("filepath", F.concat(F.lit("cell/"), F.col("cell_id").cast("string")))
    names = spark.range(4).select(F.col("id").alias("label_id"), F.concat(F.lit("label "), F.col("id").cast("string")).alias("name"))
    return labels.export_labels(cells, names, states)


@query("SELECT event_id AS cell_id, value FROM events ORDER BY abs(value / 100 - 0.5), event_id LIMIT 50 OFFSET 10")
def label_queue(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "events").select(F.col("event_id").alias("cell_id"), "value")
    return labels.queue(cells, labels.uncertainty(F.col("value") / 100), True, 10, 50)


@query(
    f"""WITH {_STATES}, m AS (SELECT c_custkey AS cell_id, max(state) FILTER (label_id = 1) AS s1, max(state) AS any_, min(state) AS low FROM customer LEFT JOIN s ON c_custkey = cell_id GROUP BY 1)
SELECT count(*) FILTER (s1 IS NULL) AS undecided, count(*) FILTER (s1 = 1) AS with_label, count(*) FILTER (coalesce(s1, 0) <> 1) AS without_label, count(*) FILTER (s1 = 0) AS negative, count(*) FILTER (any_ IS NULL) AS untouched, count(*) FILTER (any_ = 1) AS any_positive FROM m"""
)
def label_scopes(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"))
    df = labels.states_per_cell(cells, labels.current_states(decision_log(spark, d)))
    at = partial(filters.in_scope, df)
    return df.agg(F.count_if(at("undecided", 1)).alias("undecided"), F.count_if(at("with", 1)).alias("with_label"), F.count_if(at("without", 1)).alias("without_label"), F.count_if(at("negative", 1)).alias("negative"), F.count_if(at("undecided")).alias("untouched"), F.count_if(at("with")).alias("any_positive"))


@query(f"WITH {_STATES} SELECT c_nationkey AS cluster, count(*) AS size, count(*) FILTER (c_custkey NOT IN (SELECT cell_id FROM s)) AS undecided FROM customer GROUP BY 1")
def cluster_cards(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("cluster"))
    return labels.cluster_cards(cells, labels.current_states(decision_log(spark, d)))


# --- pixels: every embedding is an 8 x 8 image; large values form an object of two bands


def tiles(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    v = F.col("v").cast("double")
    return e.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), v.alias("value"), F.when(v > 0.05, F.when(F.col("i") < 32, 1).otherwise(2)).otherwise(0).alias("label"))


_TILES = "t AS (SELECT vec_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(embedding[i + 1] AS DOUBLE) AS value, CASE WHEN CAST(embedding[i + 1] AS DOUBLE) > 0.05 THEN CASE WHEN i < 32 THEN 1 ELSE 2 END ELSE 0 END AS label FROM embeddings, range(64) r(i))"


@query(
    f"""WITH {_TILES}, n AS (SELECT a.vec_id, a.label, a.y, a.x, (SELECT count(*) FROM t b WHERE b.vec_id = a.vec_id AND b.label = a.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1) AS same FROM t a WHERE a.label > 0)
SELECT vec_id, label, round(coalesce(count(*) FILTER (same < 4 AND (y < 2 OR x < 2 OR y >= 6 OR x >= 6)) / nullif(count(*) FILTER (same < 4), 0), 0), 6) AS edge_pixel_ratio FROM n GROUP BY vec_id, label"""
)
def edge_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pixels.edge_pixel_ratio(tiles(spark, d), ["vec_id"], F.lit(8), F.lit(8)))


@query(f"WITH {_TILES} SELECT vec_id, label, greatest(0, min(x) - 1) AS x, greatest(0, min(y) - 1) AS y, least(7, max(x) + 1) - greatest(0, min(x) - 1) + 1 AS w, least(7, max(y) + 1) - greatest(0, min(y) - 1) + 1 AS h FROM t WHERE label > 0 GROUP BY vec_id, label")
def bbox(spark: SparkSession, d: str) -> DataFrame:
    return pixels.bounding_boxes(tiles(spark, d), ["vec_id"], F.lit(8), F.lit(8), 1)


@query(
    f"""WITH {_TILES}, b AS (SELECT vec_id, label, greatest(0, min(x) - 1) AS x0, greatest(0, min(y) - 1) AS y0, least(7, max(x) + 1) AS x1, least(7, max(y) + 1) AS y1 FROM t WHERE label > 0 GROUP BY vec_id, label)
SELECT t.vec_id, b.label, y - y0 AS y, x - x0 AS x, CASE WHEN t.label = b.label THEN value ELSE 0.0 END AS value FROM t JOIN b ON t.vec_id = b.vec_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"""
)
def crop_cells(spark: SparkSession, d: str) -> DataFrame:
    t = tiles(spark, d)
    return pixels.crops(t.drop("label"), t, ["vec_id"], F.lit(8), F.lit(8), 1)


@query(
    f"""WITH {_TILES}, m AS (SELECT vec_id, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS box, var_pop(x) + 1.0 / 12 AS xx, var_pop(y) + 1.0 / 12 AS yy, covar_pop(x, y) AS xy FROM t WHERE label > 0 GROUP BY vec_id, label),
e AS (SELECT *, (xx + yy + sqrt(4 * xy * xy + (xx - yy) * (xx - yy))) / 2 AS big, greatest(0, (xx + yy - sqrt(4 * xy * xy + (xx - yy) * (xx - yy))) / 2) AS small FROM m)
SELECT vec_id, label, area, round(cy, 6) AS cy, round(cx, 6) AS cx, round(area / box, 6) AS extent, round(4 * sqrt(big), 6) AS major_axis, round(4 * sqrt(small), 5) AS minor_axis, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter FROM e"""
)
def object_shape(spark: SparkSession, d: str) -> DataFrame:
    s = pixels.object_shape(tiles(spark, d).filter("label > 0"), ["vec_id", "label"])
    return rounded(s.select("vec_id", "label", "area", "cy", "cx", "extent", "major_axis", F.round("minor_axis", 5).alias("minor_axis"), "equivalent_diameter"))


def stacks(spark: SparkSession, d: str) -> DataFrame:
    """Ten tiles make one stack; values in whole hundredths."""
    return tiles(spark, d).select(F.floor(F.col("vec_id") / 10).cast("long").alias("site"), "y", "x", F.rint(F.col("value") * 100).alias("value"))


_STACKS = f"{_TILES}, k AS (SELECT vec_id // 10 AS site, y, x, round_even(value * 100, 0) AS value FROM t)"


@query(f"WITH {_STACKS} SELECT site, y, x, max(value) AS value, '0' AS stack FROM k GROUP BY site, y, x")
def zproject_max(spark: SparkSession, d: str) -> DataFrame:
    return pixels.z_project(stacks(spark, d), ["site"])


@query(f"WITH {_STACKS} SELECT site, y, x, min(value) AS value, '0' AS stack FROM k GROUP BY site, y, x")
def zproject_min(spark: SparkSession, d: str) -> DataFrame:
    return pixels.z_project(stacks(spark, d), ["site"], "min")


@query(f"WITH {_STACKS} SELECT site, y, x, round_even(avg(value), 0) + 0.0 AS value, '0' AS stack FROM k GROUP BY site, y, x")
def zproject_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pixels.z_project(stacks(spark, d), ["site"], "mean"))


@query(f"WITH {_TILES} SELECT vec_id, CAST((y // 3) * 2 + x // 3 + 1 AS INT) AS tile, y % 3 AS y, x % 3 AS x, value FROM t WHERE y < 6 AND x < 6")
def tile_index(spark: SparkSession, d: str) -> DataFrame:
    return pixels.tile(tiles(spark, d), 8, 8, 3, 3).select("vec_id", "tile", "y", "x", "value")


@query(
    f"""WITH {_TILES}, l AS (SELECT vec_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM t GROUP BY vec_id), c AS (SELECT vec_id, y, x, greatest(lo, least(hi, value)) AS v FROM t JOIN l USING (vec_id)),
s AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM c GROUP BY vec_id) SELECT vec_id, y, x, round(CASE WHEN s < 1e-6 THEN 0 ELSE (v - m) / s END, 5) + 0.0 AS normalized FROM c JOIN s USING (vec_id)"""
)
def normalize_per_channel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pixels.normalize(tiles(spark, d), ["vec_id"], low=1, high=99).select("vec_id", "y", "x", "normalized"), 5)


@query(f"WITH {_TILES}, l AS (SELECT vec_id, min(value) AS lo, max(value) AS hi FROM t GROUP BY vec_id) SELECT vec_id, y, x, round((value - lo) / (hi - lo), 6) AS normalized FROM t JOIN l USING (vec_id)")
def clip_rescale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pixels.normalize(tiles(spark, d), ["vec_id"], mode="rescale").select("vec_id", "y", "x", "normalized"))


@query(f"WITH {_TILES} SELECT vec_id, round(avg(CASE WHEN value > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS foreground FROM t GROUP BY vec_id")
def foreground_fraction(spark: SparkSession, d: str) -> DataFrame:
    t = tiles(spark, d).withColumn("value", F.when(F.col("label") > 0, F.col("value")).otherwise(0.0))
    return rounded(pixels.foreground_fraction(t, ["vec_id"]))


@query(
    f"""WITH {_TILES}, l AS (SELECT vec_id, label, min(value) AS lo, max(value) AS hi FROM t WHERE label > 0 GROUP BY ALL),
g AS (SELECT vec_id, label, y, x, CAST(floor(coalesce((value - lo) / nullif(hi - lo, 0), 0) * 255) + 1 AS INT) AS i FROM t JOIN l USING (vec_id, label)),
r AS (SELECT a.vec_id, a.label, k, a.i, b.i AS j FROM g a JOIN (VALUES (0, 0, 2), (1, 1, 1), (2, 2, 0), (3, 1, -1)) s(k, dy, dx) ON true JOIN g b ON a.vec_id = b.vec_id AND a.label = b.label AND b.y = a.y + dy AND b.x = a.x + dx),
c AS (SELECT vec_id, label, k, i, j, count(*) AS n FROM (SELECT * FROM r UNION ALL SELECT vec_id, label, k, j, i FROM r) GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY vec_id, label, k) AS p FROM c),
m AS (SELECT vec_id, label, k, i, sum(p) AS q FROM p GROUP BY ALL), h AS (SELECT vec_id, label, k, -sum(q * log2(q)) AS side FROM m GROUP BY ALL),
s AS (SELECT vec_id, label, k, i + j AS v, sum(p) AS w FROM p GROUP BY ALL), sf AS (SELECT vec_id, label, k, sum(w * v) AS sumaverage, sum(w * v * v) - pow(sum(w * v), 2) AS sumvariance, -sum(w * log2(w)) AS sumentropy FROM s GROUP BY ALL),
e AS (SELECT vec_id, label, k, abs(i - j) AS v, sum(p) AS w FROM p GROUP BY ALL), ef AS (SELECT vec_id, label, k, sum(w * v * v) - pow(sum(w * v), 2) AS differencevariance, -sum(w * log2(w)) AS differenceentropy FROM e GROUP BY ALL),
f AS (SELECT p.vec_id, p.label, p.k, sum(p * (p.i - j) * (p.i - j)) AS contrast, sum(p * abs(p.i - j)) AS dissimilarity, sum(p / (1 + (p.i - j) * (p.i - j))) AS homogeneity, sum(p * p) AS asm, -sum(p * log2(p)) AS entropy, sum(p * p.i) AS mu, sum(p * p.i * p.i) - pow(sum(p * p.i), 2) AS var,
  sum(p * p.i * j) AS x, -sum(p * log2(a.q * b.q)) AS cross_ FROM p JOIN m a ON a.vec_id = p.vec_id AND a.label = p.label AND a.k = p.k AND a.i = p.i JOIN m b ON b.vec_id = p.vec_id AND b.label = p.label AND b.k = p.k AND b.i = p.j GROUP BY ALL),
z AS (SELECT *, CASE WHEN var < 1e-15 THEN 1.0 ELSE (x - mu * mu) / var END AS correlation, coalesce((entropy - cross_) / nullif(side, 0), 0) AS infomeasure1, sqrt(greatest(0, 1 - exp(-2 * (2 * side - entropy)))) AS infomeasure2 FROM f JOIN h USING (vec_id, label, k) JOIN sf USING (vec_id, label, k) JOIN ef USING (vec_id, label, k))
SELECT l.vec_id, l.label, {", ".join(f"round(coalesce(sum({c}), 0) / 4 + {'(4 - count(k)) / 4.0' if c == 'correlation' else '0'} + 1e-9, 4) + 0.0 AS {c}" for c in ("contrast", "dissimilarity", "homogeneity", "correlation", "asm", "entropy", "sumaverage", "sumvariance", "sumentropy", "differencevariance", "differenceentropy", "infomeasure1", "infomeasure2"))},
round(coalesce(sum(sqrt(asm)), 0) / 4 + 1e-9, 4) AS energy, round(coalesce(sum(greatest(0, var)), 0) / 4 + 1e-9, 4) + 0.0 AS variance FROM l LEFT JOIN z USING (vec_id, label) GROUP BY l.vec_id, l.label"""
)
def glcm_texture(spark: SparkSession, d: str) -> DataFrame:
    """All features with the default distance and levels; a direction without pairs counts as zeros.

    1e-9 keeps halves from being rounded by the order of a sum.
    """
    g = pixels.glcm_features(tiles(spark, d), ["vec_id"])
    return rounded(g.select("vec_id", "label", *((F.col(c) + 1e-9).alias(c) for c in pixels.TEXTURE)), 4)


@query()
def radial(spark: SparkSession, d: str) -> DataFrame:
    names = [f"{n}_{k}" for n in ("frac_at_d", "mean_frac", "radial_cv") for k in range(1, 5)]
    return kernels.per_site(tiles(spark, d), ["vec_id"], "radial", ["label", *names])


@query()
def outline(spark: SparkSession, d: str) -> DataFrame:
    return kernels.per_site(tiles(spark, d), ["vec_id"], "outline", ["label", "perimeter", "area_convex", "solidity", "feret_max"])


@query()
def granularity(spark: SparkSession, d: str) -> DataFrame:
    return kernels.per_site(tiles(spark, d), ["vec_id"], "granularity", ["label", *(f"granularity_{k}" for k in range(1, 17))])


@query(
    f"""WITH RECURSIVE {_TILES}, o AS (SELECT vec_id, y * 8 + x AS i, y, x FROM t WHERE value >= 0.1),
e AS (SELECT a.vec_id, a.i, b.i AS j FROM o a JOIN o b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r(vec_id, i, j) AS (SELECT vec_id, i, i FROM o UNION SELECT r.vec_id, r.i, e.j FROM r JOIN e ON r.vec_id = e.vec_id AND r.j = e.i), c AS (SELECT vec_id, i, min(j) AS c FROM r GROUP BY vec_id, i)
SELECT v.vec_id, CAST(count(c) AS DOUBLE) AS object_area, CAST(count(DISTINCT c) AS DOUBLE) AS object_count, round(coalesce(count(c) / nullif(count(DISTINCT c), 0), 0), 6) AS object_mean_area FROM embeddings v LEFT JOIN c USING (vec_id) GROUP BY v.vec_id"""
)
def threshold_objects(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kernels.per_site(tiles(spark, d), ["vec_id"], "threshold_objects", ["object_area", "object_count", "object_mean_area"], threshold=0.1))


# --- embeddings


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").withColumn("label", F.col("label").cast("long"))


_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT query, neighbour, round(s, 4) AS similarity FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, {_DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 12) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE k <= 3")
def l2_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(embed.nearest(v, v, "vec_id", "embedding", 3, exclude_self=True), 4)


@query(f"SELECT DISTINCT least(q, n) AS src, greatest(q, n) AS dst FROM (SELECT a.vec_id AS q, b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 12) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE k <= 5")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return embed.knn_graph(vectors(spark, d), "vec_id", "embedding", 5)


@query(
    f"""WITH s AS (SELECT a.vec_id, max({_DOT}) FILTER (b.label = 1) AS p, max({_DOT}) FILTER (b.label = 2) AS n FROM embeddings a JOIN embeddings b ON b.label IN (1, 2) GROUP BY a.vec_id) SELECT vec_id, round(coalesce(p, -1) - 0.5 * coalesce(n, 0), 4) AS score FROM s"""
)
def suggest_score(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(embed.suggest_score(v, v.filter("label = 1"), v.filter("label = 2"), "vec_id", "embedding"), 4)


@query(
    f"""WITH l AS (SELECT vec_id, CAST(label % 2 AS INT) AS state, embedding FROM embeddings), s AS (SELECT a.vec_id, a.state, max({_DOT}) FILTER (b.state = a.state) AS own, max({_DOT}) FILTER (b.state <> a.state) AS other,
arg_min(b.vec_id, (-round({_DOT}, 12), b.vec_id)) FILTER (b.state <> a.state) AS evidence FROM l a JOIN l b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.state)
SELECT vec_id, state, evidence, round(other - coalesce(own, -1), 4) AS margin FROM s WHERE round(other, 12) - coalesce(round(own, 12), -1) > 0"""
)
def review_items(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("state", (F.col("label") % 2).cast("int"))
    return rounded(embed.review_items(v, "vec_id", "embedding", "state"), 4)


@query(
    """WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-8) AS n FROM embeddings),
w AS (SELECT a.vec_id, a.label, sum(list_dot_product(a.v, b.v) / a.n / b.n) AS s FROM u a JOIN u b ON a.label = b.label GROUP BY a.vec_id, a.label)
SELECT CAST(label AS BIGINT) AS label, arg_min(vec_id, (-round(s, 9), vec_id)) AS medoid FROM w GROUP BY label"""
)
def medoid(spark: SparkSession, d: str) -> DataFrame:
    return embed.medoids(vectors(spark, d), "vec_id", "embedding", "label")


@query(
    f"""WITH n AS (SELECT a.vec_id AS query, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 12) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
c AS (SELECT query, label, count(*) AS n FROM n WHERE k <= 7 GROUP BY 1, 2) SELECT query, CAST(arg_min(label, (-n, label)) AS BIGINT) AS predicted, round(max(n) / sum(n), 6) AS confidence FROM c GROUP BY query"""
)
def knn_vote(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(embed.knn_vote(v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1"), "vec_id", "embedding", "label", 7))


@query(
    f"""WITH f AS (SELECT a.vec_id, a.vec_id % 10 = 0 AS kept, sqrt(greatest(0, 2 - 2 * max({_DOT}))) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id % 10 = 0 GROUP BY a.vec_id),
i AS (SELECT sqrt(greatest(0, 2 - 2 * max({_DOT}))) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 10 = 0 AND b.vec_id % 10 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id)
SELECT round(avg(CASE WHEN dist <= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS coverage_half, round(avg(CASE WHEN dist <= 1.0 THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(quantile_cont(dist, 0.5) FILTER (NOT kept), 4) AS drop_median, round(avg(dist) FILTER (NOT kept), 4) AS drop_mean,
round(quantile_cont(dist, 0.95) FILTER (NOT kept), 4) AS drop_p95, (SELECT round(quantile_cont(dist, 0.5), 4) FROM i) AS isolation_median, (SELECT round(min(dist), 4) FROM i) AS isolation_min FROM f"""
)
def selection_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(embed.selection_metrics(v, v.filter("vec_id % 10 = 0"), "vec_id", "embedding", 1.0), 4)


@query("SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS best, round(list_max(v), 6) AS top, round((list_reverse_sort(v)[1] + list_reverse_sort(v)[2] + list_reverse_sort(v)[3]) / 3, 6) AS top3, round(sqrt(list_dot_product(v, v)), 4) AS norm, round(exp(v[1]) / list_sum(list_transform(v, lambda x: exp(x))), 6) AS p0 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def vector_math(spark: SparkSession, d: str) -> DataFrame:
    v = vec.doubles(F.col("embedding"))
    r = vectors(spark, d).select("vec_id", vec.argmax(v).alias("best"), F.array_max(v).alias("top"), vec.topk_mean(v, 3).alias("top3"), F.round(vec.norm(v), 4).alias("norm"), vec.softmax(v)[0].alias("p0"))
    return rounded(r)


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS too_near FROM embeddings")
def radius_cover(spark: SparkSession, d: str) -> DataFrame:
    """Every row is within the radius of a kept one, and no two kept ones are."""
    v = vectors(spark, d)
    unit = v.select("vec_id", vec.l2_normalize(vec.doubles(F.col("embedding"))).alias("embedding"))
    kept = unit.join(embed.greedy_cover(unit, "vec_id", "embedding", 1.0), "vec_id")
    far = embed.distance_to_kept(unit, kept, "vec_id", "embedding").agg(F.count("*").alias("n"), F.count_if(F.col("distance") > 1 + 1e-9).alias("uncovered"))
    alone = embed.nearest(kept, kept, "vec_id", "embedding", 1, exclude_self=True).agg(F.count_if(F.col("similarity") > 0.5 + 1e-9).alias("too_near"))
    return far.join(F.broadcast(alone))


@query()
def leiden_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_edges(embed.knn_graph(vectors(spark, d), "vec_id", "embedding", 15))


@query(
    f"""WITH e AS (SELECT DISTINCT least(q, n) AS src, greatest(q, n) AS dst FROM (SELECT a.vec_id AS q, b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 12) DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE k <= 5),
c AS (SELECT vec_id AS node, label AS cluster FROM embeddings), x AS (SELECT a.cluster AS ca, b.cluster AS cb FROM e JOIN c a ON a.node = src JOIN c b ON b.node = dst), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM x),
d AS (SELECT c, count(*) AS degree FROM (SELECT ca AS c FROM x UNION ALL SELECT cb FROM x) GROUP BY c), i AS (SELECT ca AS c, count(*) AS n FROM x WHERE ca = cb GROUP BY ca)
SELECT round(sum(coalesce(i.n, 0) / m - (degree / (2 * m)) * (degree / (2 * m))), 6) AS modularity FROM d LEFT JOIN i USING (c), m"""
)
def modularity(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(cluster.modularity(embed.knn_graph(v, "vec_id", "embedding", 5), v.select(F.col("vec_id").alias("node"), F.col("label").alias("cluster"))))


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS covariance FROM range(16) a(i), range(16) b(j)")
def whiten_pca(spark: SparkSession, d: str) -> DataFrame:
    """Whitened axes are uncorrelated and of variance 1."""
    v = vectors(spark, d)
    w = embed.apply_space(v, "embedding", embed.fit_space(v, "embedding", 16), normalize=False)
    pairs = w.select(F.posexplode("w").alias("i", "a"), "w").select("i", "a", F.posexplode("w").alias("j", "b"))
    return rounded(pairs.groupBy("i", "j").agg(F.covar_samp("a", "b").alias("covariance")), 4)


@query(f"SELECT a.vec_id, round(max({_DOT}), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.label <> 3 AND b.label = 3 GROUP BY a.vec_id ORDER BY round(max({_DOT}), 12) DESC, a.vec_id LIMIT 50")
def similarity_rank(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return rounded(embed.similarity_rank(v, v.filter("label = 3"), "vec_id", "embedding", 50), 4)


# --- sampling: strata are compared, not the chosen rows


@query("SELECT toxic, count(*) AS n, CAST(CASE WHEN count(*) > 1 THEN greatest(1, floor(count(*) * 0.2)) ELSE floor(count(*) * 0.2) END AS BIGINT) AS n_val FROM labels GROUP BY toxic")
def stratified_split_counts(spark: SparkSession, d: str) -> DataFrame:
    s = sampling.stratified_split(read(spark, d, "labels"), "toxic", 0.2, ["doc_id"], 1)
    return s.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("is_val").alias("n_val"))


@query("SELECT event_type, user_id % 4 AS root, least(50, count(*)) AS n FROM events GROUP BY 1, 2")
def subsample_counts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("root", F.col("user_id") % 4)
    return sampling.per_class(e, ["event_type", "root"], 50, ["event_id"]).groupBy("event_type", "root").agg(F.count("*").alias("n"))


@query("SELECT root, least(103, count(*)) AS n FROM (SELECT user_id % 4 AS root FROM events) GROUP BY root")
def per_dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("root", F.col("user_id") % 4)
    return sampling.per_dataset(e, "root", "event_type", 103, ["event_id"]).groupBy("root").agg(F.count("*").alias("n"))


@query("SELECT least(500, count(*)) AS n FROM events")
def point_cap(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_rows(read(spark, d, "events"), 500, ["event_id"]).agg(F.count("*").alias("n"))


# --- batch forms of the streaming extension


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return stream.window_counts(read(spark, d, "events"), "ts", ["event_type"])


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return stream.sessions(read(spark, d, "events"), "ts", ["user_id"])
