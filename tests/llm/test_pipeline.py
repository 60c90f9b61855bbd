"""Stages keep the columns of documents and act; queries are registered."""

from __future__ import annotations

import corpus_pipeline
from tributary.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_act_and_the_last_packs_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
    left = {r.doc_id for r in docs.collect()}
    assert 0 < len(left) < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == left
    docs.unpersist()


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "packing"]


def test_exact_search_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(map(tuple, con.execute(queries.ORACLE_SQL["op5_exact_search"]).fetchall()))
    assert sorted(map(tuple, queries.QUERIES["op5_exact_search"](spark, SF).collect())) == want


def test_run_writes_and_reads_every_stage(spark, tmp_path):
    """Repeated, null and wrongly declared rows; clean documents are all packed."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = docs.agg({"doc_id": "max"}).first()[0]
    odd = [(last + 1, None, "en", "s", 0), (last + 2, "", "en", "s", 0), (None, "the and of is that was for with this", "en", "s", 9)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    assert last + 1 not in kept and last + 2 not in kept
    apart = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        apart = stage(spark, apart, SF)
    want = {r.doc_id for r in apart.collect()}
    assert len(kept - {None}) > 100 and len(want ^ (kept - {None})) <= 0.02 * len(want)
    assert sum(r.length for r in rows) > 0 and spark.read.parquet(str(tmp_path / "documents.parquet")).count() == docs.count() + 3
