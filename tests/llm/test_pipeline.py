"""The corpus pipeline stage by stage."""

import corpus_pipeline
from roadveil.llm import pii

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(spark, stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True)
    assert sizes[1] >= 0.8 * sizes[0] and sizes[2] >= 0.95 * sizes[1] and sizes[3] >= 0.8 * sizes[2] and sizes[4] == sizes[3]
    assert not any(pii.base_spans(r[0] or "") for r in docs.select("text").collect())
    pieces = corpus_pipeline.packing_stage(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == sizes[4]


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "pii", "packing"]
