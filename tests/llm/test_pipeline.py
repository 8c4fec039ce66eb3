import importlib

import corpus_pipeline

from perkolat.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.written(stage(spark, docs, SF), "t")
        if i < 4:
            assert out.columns == docs.columns
        if i == 1:
            assert out.select("doc_id").distinct().count() == out.count()
        if i == 2:
            m = decontaminate.Matcher(bench)
            gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out.collect()}
            assert gone == {r["doc_id"] for r in docs.collect() if m.find(r["text"] or "")}
        docs = out
        sizes.append(out.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5]


def test_entry_has_all_queries():
    names = importlib.import_module("__spark_entry__").queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
