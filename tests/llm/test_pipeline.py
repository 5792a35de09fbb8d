import corpus_pipeline
from faktum.llm import exact_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = exact_dedup.cut(stage(spark, before, SF))
        assert after.columns == columns and after.exceptAll(before).isEmpty(), name
        before = after
    left = {r.doc_id for r in before.collect()}
    assert before.count() == len(left) == before.select("text").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r.doc_id for r in packed} == left
    # of equal texts the first that came so far stays
    exact = corpus_pipeline.distinct(spark, docs, SF)
    firsts = docs.selectExpr("doc_id", "regexp_replace(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+', ' ') AS t").groupBy("t").agg({"doc_id": "min"})
    assert {r[0] for r in exact.select("doc_id").collect()} == {r[1] for r in firsts.collect()}


def test_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
