"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import math
import random

import pytest

from wellspark.plans import more, queries  # noqa: F401

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, con, name):
    r = con.execute(queries.SQL[name])
    columns = [c[0] for c in r.description]
    want = sorted(([plain(v) for v in row] for row in r.fetchall()), key=str)
    df = queries.QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(([plain(v) for v in row] for row in df.select(*(f"`{c}`" for c in columns)).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, D).limit(5).count() > 0


def test_outer_fusion_on_whole_tables(spark, tmp_path):
    """Every row takes part, whatever its id; null folders against brute force."""
    rng = random.Random(3)
    rows = [(k, line, float(rng.randint(1, 50)), 1.0, rng.choice("RN")) for k in (1009, 14, 15, 2018, 399, 400, 401, 7063, 440, 9081, 5005, 90001) for line in (1, 2) for _ in range(rng.randint(0, 3))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = lambda k: k if k % 11 else None
    keys = sorted({r[:2] for r in rows})
    own = {k: [r for r in rows if r[:2] == k] for k in keys}
    a = [(folder(k[0]), k[1], k[0], sum(r[2] for r in own[k])) for k in keys]
    b = [(folder(k[0]), k[1], k[0], round(sum(r[4] == "R" for r in own[k]) / len(own[k]), 6)) for k in keys if k[0] % 7]
    want = [(*x, *y[2:]) for x in a for y in b if x[:2] == y[:2]]
    want += [(*x, None, None) for x in a if x[:2] not in {y[:2] for y in b}] + [(*y[:2], None, None, *y[2:]) for y in b if y[:2] not in {x[:2] for x in a}]
    got = queries.QUERIES["fuse_outer"](spark, str(tmp_path)).select("directory", "label", "site", "area", "`infer/site`", "pred_prob")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_threshold_objects_on_the_whole_table(spark, tmp_path):
    rng = random.Random(4)
    images = {k: [rng.choice((0.0, 0.0, 0.5)) for _ in range(64)] for k in (3, 59, 60, 777, 10**6)} | {61: [0.0] * 64}
    spark.createDataFrame(list(images.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = []
    for k, v in images.items():
        left = {(i // 8, i % 8) for i in range(64) if v[i] >= 0.1}
        area, count = len(left), 0
        while left:
            count += 1
            todo = [left.pop()]
            while todo:
                y, x = todo.pop()
                near = {p for p in left if abs(p[0] - y) <= 1 and abs(p[1] - x) <= 1}
                left -= near
                todo += near
        want.append((k, float(area), float(count), round(area / count, 6) if count else 0.0))
    got = queries.QUERIES["threshold_objects"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
