"""The stages on planted cases and odd rows."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from cellwatch.llm.queries import ORACLES


def test_stages_keep_clean_rows_and_take_odd_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    own = " ".join(f"only{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}{i}" for i in range(80))
    odd = [(900001, own, "en", "s", 1), (900002, own, "en", "s", 1), (900003, f"{own[:200]} {item}", "en", "s", 1), (900004, None, None, None, None), (900005, "", "en", "s", 0), (None, "a b c", "en", "s", 5)]
    rows = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit(1)).withColumn("n_dropped", F.lit(2))
    ids = []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == pipeline.COLUMNS, name
        rows = spark.createDataFrame(out.collect(), docs.schema)
        ids.append({r.doc_id for r in rows.select("doc_id").collect()})
    assert {900001, 900002, 900003, 900004, 900005, None} <= ids[1]
    assert 900001 in ids[2] and 900002 not in ids[2]
    assert 900003 in ids[2] and 900003 not in ids[3] and {900001, 900004, 900005, None} <= ids[3]
    encoded = pipeline.encode(spark, rows, sf_dir)
    assert encoded.count() == rows.count() and encoded.where("NOT decodes").count() == 0


def test_stages_take_empty_tables(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name


def test_oracles_name_registered_queries():
    from cellwatch.llm.queries import QUERIES

    assert set(ORACLES) <= set(QUERIES)
