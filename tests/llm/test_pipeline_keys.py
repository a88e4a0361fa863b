"""Stages of the pipeline judge rows, not keys: null keys and keys that come again with other texts."""

import corpus_pipeline
from stratograph.llm import queries

SF = "/root/testdata/sf0.001"


def test_rows_with_null_and_repeated_keys(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdicts = (
        (corpus_pipeline.quality_rules, queries.op10_quality_rules(spark, SF).filter("NOT kept")),
        (corpus_pipeline.non_toxic, queries.op1_toxicity(spark, SF).filter("predicted = 1")),
    )
    for i, (stage, rejected) in enumerate(verdicts):
        bad = {r["doc_id"] for r in rejected.collect()}
        rows = docs.collect()
        good = [r for r in rows if r["doc_id"] not in bad]
        assert bad and good
        # half of what is rejected loses its key, the rest takes the key of a row that stays
        key = {d: None if k % 2 else good[k % len(good)]["doc_id"] for k, d in enumerate(sorted(bad))}
        changed = [(key.get(r["doc_id"], r["doc_id"]), *r[1:]) for r in rows]
        path = str(tmp_path / str(i))
        spark.createDataFrame(changed, docs.schema).write.parquet(path)
        out = stage(spark, spark.read.parquet(path), SF)
        assert out.columns == docs.columns
        if stage is corpus_pipeline.quality_rules:  # judged by texts alone
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in good)
        else:  # keys choose the labels that are learned from, so verdicts may differ in few rows
            kept = [r["doc_id"] for r in out.collect()]
            assert kept.count(None) < sum(v is None for v in key.values()) and len(set(kept) - {None}) > 0.9 * len(good)
