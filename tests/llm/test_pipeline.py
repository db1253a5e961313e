from pathlib import Path

import corpus_pipeline
from brightloom import session
from brightloom.llm import queries

import __spark_entry__ as entry


def test_all_operators_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_stages_keep_the_columns_and_pack_what_is_left(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).persist()
        n = docs.count()
        assert docs.columns == columns and 0 < n <= left, name
        left = n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.agg({"length": "sum"}).first()[0] == pieces.agg({"length": "sum"}).first()[0]


def test_short_tables_between_rounds_have_few_files(spark, sf_dir):
    """As many files as rows call for, not one for each shuffle partition, and the same rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    session.cut_lineage(spark.range(1))  # names the folder

    def files():
        return sum(1 for _ in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*"))

    for name, stage in corpus_pipeline.STAGES[1:4]:
        rows = sorted((r.doc_id, r.text) for r in stage(spark, docs, sf_dir).collect())
        for k, v in many.items():
            spark.conf.set(k, v)
        try:
            n = files()
            assert sorted((r.doc_id, r.text) for r in stage(spark, docs, sf_dir).collect()) == rows
            assert 0 < files() - n < 64, name
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
