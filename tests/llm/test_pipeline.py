"""The pipeline: its stages on made-up documents, and the registered queries on the smallest tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutloom.llm import decontaminate, linededup, packing, quality, queries, simhash, stages

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") != 173).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct().write.parquet(f"{d}/labels.parquet")
    text = docs.where("doc_id = 21").first()["text"]
    spark.createDataFrame([(1, text), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "contamination", "packing"]


def test_stages(spark, docs, folder):
    cols = list(stages.COLUMNS)
    good = corpus_pipeline.keep_good(spark, docs, folder)
    assert good.columns == cols
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert good.count() == quality.score(docs, model).where("score >= 0.3").count()
    lines = corpus_pipeline.drop_shared_lines(spark, docs, folder)
    assert lines.columns == cols
    assert lines.count() == docs.count()
    assert lines.where("n_chars <> char_length(text)").count() == 0
    assert Counter(r["text"] for r in lines.collect()) == Counter(r["text"] for r in linededup.dedup_lines(docs).collect())
    single = corpus_pipeline.keep_one_of_each_group(spark, docs, folder)
    assert single.columns == cols
    names = {r["component_id"] for r in simhash.similar_documents(docs).where("component_id is not null").collect()}
    assert {r["doc_id"] for r in single.collect()} == names | {None}
    clean = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert clean.columns == cols
    leaks = {r["doc_id"] for r in decontaminate.leaked(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert 21 in leaks
    assert clean.count() == docs.where(~F.col("doc_id").isin(*leaks) | F.col("doc_id").isNull()).count()


def test_run_is_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
    want = packing.pack(kept, queries.TOKENIZER)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got.select(key).collect())) == Counter(map(tuple, want.select(key).collect()))


def test_stages_on_nothing(spark, empty, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


@here
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries(spark, name):
    got = queries.queries()[name](spark, SF)
    assert got.columns
    n = got.count()
    whole = {"op1", "op3", "op5", "op7", "op11", "op12"}
    if name.split("_")[0] in whole:
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name.startswith("op9"):
        assert n == spark.read.parquet(f"{SF}/pages.parquet").count()


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    out = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert Counter(tuple(r[names.index(c)] for c in cols) for r in out.fetchall()) == Counter(tuple(r[c] for c in cols) for r in got.collect())
