import random
from collections import Counter

import corpus_pipeline
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, nothing, odd_documents, words
from tests.llm.test_text_operators import toxic_corpus
from wellspark.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_names():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names) and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A corpus with planted cases, as tables in a folder."""
    folder = tmp_path_factory.mktemp("planted")
    docs, labels = toxic_corpus(spark, 200)
    rng = random.Random(11)
    base, passage = words(rng, 150), words(rng, 70)
    items = [(k, words(rng, 30)) for k in range(5)]
    near = base.split()
    near[70] = "x"
    rows = [(1000, base), (1001, base), (1002, " ".join(near)), (1003, words(rng, 40) + " " + passage + " " + words(rng, 40)), (1004, words(rng, 30) + " " + passage + " " + words(rng, 50)), (1005, words(rng, 40) + " " + items[2][1] + " " + words(rng, 40)), (1006, words(rng, 80))]
    more = spark.createDataFrame([(i, t, "en", "s", len(t), None, None, None, None) for i, t in rows], SCHEMA)
    docs.unionByName(more).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), passage, base


def test_pipeline_catches_planted_cases(spark, planted):
    folder, passage, base = planted
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    toxic = {k for k in range(200) if k % 4 == 0}
    assert len(toxic & set(out)) <= 2 and len({k for k in range(200) if k % 4} - set(out)) <= 2
    assert 1000 in out and 1001 not in out and 1002 not in out and out[1000]["text"] == base
    assert passage[:200] not in out[1003]["text"] and passage[:200] not in out[1004]["text"]
    assert 1005 not in out and 1006 in out
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.values())


def test_each_stage_keeps_the_columns(spark, planted, tmp_path):
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("source", "source")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        assert docs.columns[: len(names)] == names or k == 4, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {"ids", "n_tokens"} <= set(docs.columns)
    assert pq.read_table(str(tmp_path / "bpe_encoding")).num_rows == docs.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles_on_the_smallest_tables(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = sorted((tuple(r) for r in want.fetchall()), key=str)
    got = queries.queries()[name](spark, SMALL).select(*columns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == rows


def test_run_leaves_one_table_of_its_own(spark, planted):
    """Tables between stages are deleted once the next one is written; those of the input stay."""
    from pathlib import Path

    from wellspark.llm.common import shared_folder

    folder, _, _ = planted
    own = Path(shared_folder(spark).removeprefix("file:"))
    before = set(own.glob("written-*"))
    out = corpus_pipeline.run(spark, folder)
    assert len(set(own.glob("written-*")) - before) == 1 and out.count() > 0 and spark.read.parquet(f"{folder}/documents.parquet").count() > out.count()


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls, blanks, repeated rows, clashing names and no rows at all pass every stage."""
    for name, docs in (("odd", odd_documents(spark)), ("none", nothing(spark))):
        folder = tmp_path / name
        docs.withColumn("ids", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert set(out.columns) == {*docs.columns, "ids"} and dict(out.dtypes)["n_tokens"] == "int"
        texts = Counter(r["text"] for r in out.collect())
        assert sum(texts.values()) == 0 if name == "none" else texts[None] == 2 and texts[""] >= 1 and texts["one two"] == 1
