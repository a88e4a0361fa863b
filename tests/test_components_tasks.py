"""Rounds over few links leave few files, and rounds over many are dealt as before; labels are the same."""

import pytest

from pyspark.sql import functions as F

from stratograph.operators import components


@pytest.mark.parametrize("rows", [100_000, 40])
def test_rounds_over_few_links_take_few_tasks(spark, monkeypatch, rows):
    monkeypatch.setattr(components, "ROUND_ROWS", rows)
    tasks, real = [], components.checkpoint
    monkeypatch.setattr(components, "checkpoint", lambda df: tasks.append(df.rdd.getNumPartitions()) or real(df))
    n = 90  # chains of 30
    links = spark.range(n).filter("id % 30 != 29").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(7)
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        found = {r["id"]: r["label"] for r in components.connected(links).collect()}
    finally:
        spark.conf.set(conf, before)
    assert found == {i: i - i % 30 for i in range(n)}
    assert max(tasks[1:]) == 1 if rows == 100_000 else max(tasks[1:]) > 1
