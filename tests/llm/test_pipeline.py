"""The stages in turn, and the fingerprints of the contract on given tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from netweir.llm import queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
        if i < 3:
            assert 0.5 * before < docs.count() <= before
            before = docs.count()
    assert {"shard", "slot"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_on_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Helper columns of the operators do not meet those of a user."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = ["score", "predicted", "n_sentences", "worst_sentence", "_key", "_row", "_range", "_at", "_piece", "_task", "_text", "_doc", "_id", "_h", "node", "root", "_alone", "_best", "block", "start", "_draws", "taken"]
    marked = docs.select("*", *[F.concat(F.lit(n + ":"), F.col("doc_id").cast("string")).alias(n) for n in own])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, marked, sf_dir)
        row = out.first()
        assert all(row[n] == f"{n}:{row['doc_id']}" for n in own)
        assert set(marked.columns) <= set(out.columns)
