import math

import pytest
from pyspark.sql import functions as F

from wellspark.functions import text as tx
from wellspark.functions import vector as vec


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_natural_order(spark):
    rows = spark.createDataFrame([(x,) for x in ["A10", "A2", "10", "2", "A1", "B", "a1b2", "a1b10", "", "A002"]], "v string")
    got = [r[0] for r in rows.orderBy(tx.natural_key(F.col("v")), "v").collect()]
    assert got == ["", "2", "10", "A1", "A002", "A2", "A10", "B", "a1b2", "a1b10"]


def test_captures_are_anchored_and_positional(spark):
    caps = tx.captures(F.col("v"), r"r(?P<row_no>\d+)c(?P<col>\d+)(?:-(?P<tail>\w+))?")
    rows = spark.createDataFrame([("r01c02-x",), ("zr1c2",), ("r3c4",), (None,)], "v string").select(*(c.alias(n) for n, c in caps.items())).collect()
    assert [tuple(r) for r in rows] == [("01", "02", "x"), (None, None, None), ("3", "4", ""), (None, None, None)]
    assert tx.java_pattern(r"(?P<a_b>x)(?P=a_b)") == (r"(x)\1", {"a_b": 1})


@pytest.mark.parametrize("row,want", [("1", "A"), ("26", "Z"), ("27", "AA"), ("702", "ZZ"), ("703", "AAA"), ("b", "B"), ("0", "0"), ("-1", "-1"), ("1.5", "1.5"), (None, None)])
def test_row_letter(spark, row, want):
    assert one(spark, tx.row_letter(F.lit(row).cast("string"))) == (want,)


def test_wells(spark):
    rows = spark.createDataFrame([("a01", "A1"), ("B12", "B12"), ("aa003", "AA3"), ("12", "12"), ("A-1", "A-1"), (None, None)], "v string, want string")
    assert all(r[0] == r[1] for r in rows.select(tx.normalize_well(F.col("v")), "want").collect())
    assert one(spark, tx.derive_well(F.lit("2"), F.lit("03")), tx.derive_well(F.lit("2"), F.lit("1.5"))) == ("B3", None)


def test_names_and_paths(spark):
    got = one(
        spark, tx.channel_column(F.lit("1")), tx.channel_column(F.lit("DAPI")), tx.portable_path(F.lit("a\\b\\")), tx.stem(F.lit("x/y.z.tif")), tx.null_strings(F.lit("None")), tx.splice(F.lit("abcdef"), F.lit(3), F.lit(2), F.lit("-")),
        tx.truth_from_directory(F.lit("p/q"), F.lit(None).cast("string")), tx.group_label([F.lit("a"), F.lit(None).cast("string"), F.lit(2)]),
    )
    assert got == ("ch1", "DAPI", "a/b", "y.z", None, "ab-ef", "q", "a | 2")
    assert one(spark, tx.split_labels(F.lit(" a; ;b ;"))) == (["a", "b"],)
    assert tx.unique_name("x", {"x"}, "s", "t") == "s/x" and tx.unique_name("x", {"x", "s/x", "s/t/x"}, "s", "t") == "s/t/x (2)"
    assert tx.model_of_infer_db(tx.infer_db_name("m")) == "m" and tx.model_of_infer_db("x.db") is None
    assert tx.shorten_paths(["/a/b/x/im", "/a/b/y/im"]) == ["x", "y"] and tx.shorten_paths(["a/b"]) == ["b"] and tx.shorten_paths(["a/x", "a/x"]) == ["x", "x"]
    assert tx.resolution_tag(0.50) == "0.5" and tx.mask_column("cell") == "mask_cell" and tx.bare_mask("mask_cell") == "cell"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0))
    got = one(spark, vec.dot(a, b), vec.norm(a), vec.cosine(a, b), vec.unit_distance(b, b), vec.argmax(a), vec.topk_mean(a, 1), vec.topk_mean(a, 5), vec.cosine(a, F.array(F.lit(0.0), F.lit(0.0))))
    assert got == (3.0, 5.0, 0.6, 0.0, 1, 4.0, 3.5, None)
    s = one(spark, vec.softmax(a), vec.sigmoid(F.lit(0.0)), vec.l2_normalize(a))
    assert math.isclose(sum(s[0]), 1) and s[1] == 0.5 and s[2] == [0.6, 0.8]
    ranked = one(spark, vec.sort_probabilities(F.array(F.lit("x"), F.lit("a"), F.lit("b")), F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))))[0]
    assert [r["name"] for r in ranked] == ["a", "b", "x"]


def test_scalars(spark):
    got = one(spark, vec.gamma(F.lit(5.0), 0, 10), vec.gamma(F.lit(50.0), 0, 10, 2.0, True), vec.parse_probability(F.lit("x")), vec.parse_probability(F.lit("0.5")), vec.json_first(F.lit('["p","q"]')), vec.json_first(F.lit("plain")))
    assert got == (0.5, 0.0, 0.0, 0.5, "p", "plain")
    assert vec.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert vec.warmup_cosine(0, 1, 0, 100, 10) == 0 and vec.warmup_cosine(10, 1, 0, 100, 10) == 1 and abs(vec.warmup_cosine(100, 1, 0, 100, 10)) < 1e-12
    m = one(spark, vec.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(9))))[0]
    assert m == {"a": 9, "b": 2}
