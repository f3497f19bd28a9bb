"""The pipeline's stages against what their decisions should be."""

import re

import corpus_pipeline
from quire.llm import quality_rules


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts, found = docs.columns, [docs.count()], [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        counts.append(docs.count())
        found.append(docs)
    assert len(corpus_pipeline.STAGES) == 5 and counts[0] > counts[1] > counts[2] == counts[3] and counts[4] == counts[5]
    report = quality_rules.rule_report(found[0]).where("kept").select("doc_id")
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, found[1].select("doc_id").collect()))
    texts = [r.text for r in found[3].collect()]
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in texts) and any("[CARD]" in t for t in texts)
    assert all(r.n_chars == len(r.text) for r in found[3].collect())
    assert found[4].groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    assert docs.columns == ["doc_id", "ids", "decoded"] and all(len(r.ids) == (len(r.decoded.split(" ")) if r.decoded else 0) for r in docs.collect())


def test_run_equals_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda r: (r.doc_id, tuple(r.ids), r.decoded)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, docs.collect()))


ROW = "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>, `row` string, __text string, __key int"
LONG = " ".join(f"word{k % 977} of{k}" for k in range(9000))


def test_stages_with_odd_rows(spark, sf):
    clean = [" ".join(f"plain{k}{j} words of prose." for j in range(12)) + f"\nAnd a second line {k}." for k in range(6)]
    rows = [(k, t, "en", "a", len(t), {"x": k}, "k", "t", 1) for k, t in enumerate(clean)]
    rows += [(10, clean[0], None, None, None, None, None, None, None), (None, clean[1], "en", "a", 1, None, None, None, None), (11, None, "en", "b", None, None, None, None, None), (12, "", "en", "b", 0, None, None, None, None)]
    rows += [(13, LONG + " mail me@example.org", "en", "b", len(LONG), None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, ROW)
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, sf)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "2", "3", "4", "5", "10", "None", "13", "13"])
    one = stages[1](spark, kept, sf)
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == sorted(["0", "1", "2", "3", "4", "5", "13"])
    clean_of = stages[2](spark, one, sf)
    assert clean_of.columns == docs.columns and [r.text[-12:] for r in clean_of.where("doc_id = 13").collect()] == ["mail [EMAIL]"]
    mix = stages[3](spark, clean_of, sf)
    assert mix.columns == docs.columns and mix.count() > 0
    coded = stages[4](spark, mix, sf)
    assert coded.count() == mix.count() and coded.where("size(ids) = 0").count() == 0


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], ROW)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
