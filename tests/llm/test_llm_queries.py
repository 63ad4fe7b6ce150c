"""The queries against their SQL and against checks over whole small tables, and the pipeline's stages."""

from __future__ import annotations

import pytest
from conftest import DATA
from oracles import same
from pyspark.sql import functions as F

from proxima.llm.queries import ORACLE_SQL, QUERIES

SMALL = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, QUERIES, ORACLE_SQL, name, SMALL)


def test_a_row_per_document(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op1_sharding", "op4_simhash", "op5_quality_rules", "op6_bpe", "op7_pii", "op8_quality_cnn", "op9_lm_scoring"):
        ids = [r["doc_id"] for r in QUERIES[name](spark, str(SMALL)).select("doc_id").collect()]
        assert len(ids) == len(set(ids)) == n, name


def test_pipeline(spark, tmp_path):
    """Each stage keeps columns and only rows of its input; what the stages decide is in the packed result."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, ids = [docs.count()], None
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, str(SMALL)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == P.COLUMNS and after.join(docs, "doc_id", "left_anti").count() == 0
        sizes.append(after.count())
        docs = after
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
    assert docs.where(F.col("text").rlike("[a-z]@[a-z]")).count() == 0
    ids = {r["doc_id"] for r in docs.collect()}
    packed = P.STAGES[-1][1](spark, docs, str(SMALL))
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert {r["doc_id"] for r in P.run(spark, str(SMALL)).collect()} == ids


def test_stages_on_empty_and_odd_tables(spark):
    """No rows give no rows; null texts, ids and languages and columns with the names of helpers give no error."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(30).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", None, 0), (10**9, "", "en", None, 0)], docs.schema))
    odd = odd.withColumns({c: F.lit(1) for c in ("keep", "score", "spans", "base_spans", "n_words", "h", "s", "t", "g", "distance", "__h", "c0", "length")})
    for name, stage in P.STAGES:
        none = stage(spark, docs.where("false"), str(SMALL))
        assert none.count() == 0, name
        got = stage(spark, odd, str(SMALL))
        assert name == P.STAGES[-1][0] or got.columns == P.COLUMNS and got.count() <= 33, name
