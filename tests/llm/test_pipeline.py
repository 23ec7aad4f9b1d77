"""The pipeline: each stage on what the one before kept, and all queries of the subpackage registered."""

import corpus_pipeline
from __spark_entry__ import queries
from candlelake.llm.shared import keep

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "secret scan", "source mixing"]
    counts = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = keep(stage(spark, docs, SF))
        counts.append(docs.count())
        if number < 5:
            assert docs.columns == columns
    assert 200 > counts[0] > counts[1] >= counts[2] == counts[3] > 100
    assert set(columns) < set(docs.columns) and corpus_pipeline.run(spark, SF).count() == counts[4]


def test_queries_are_registered():
    names = queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
