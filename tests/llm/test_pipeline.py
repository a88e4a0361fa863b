"""The corpus pipeline's stages, each against its operator by force, on a small table."""

import corpus_pipeline
from tests.llm.test_operators import components_by_force

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs
    texts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SF).toPandas(), docs.schema)
        assert after.columns == columns, name
        texts.append({r["doc_id"]: r["text"] for r in after.collect()})
        before = after
    quality, toxicity, near, pii = texts
    assert set(quality) > set(toxicity) and set(toxicity) >= set(near) and set(near) == set(pii)
    assert set(near) == {d for d, (_, root) in components_by_force(toxicity).items() if d == root}
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF).toPandas()
    assert set(out["doc_id"]) == set(pii) and (out.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
