"""Large code bases are gone through in slices of their projects, and what was shuffled for a table that is written is removed."""

import time

import pytest

from pyspark.sql import functions as F

from stratograph.operators import analysis, graph, lineage
from stratograph.plans import catalog, codebase

SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["lkp1_resolve", "str3_edge_lines", "agg5_graph_size", "arc1_architecture", "arc3_rules"])
def test_slices_give_what_the_whole_gives(spark, monkeypatch, name):
    whole, put = _rows(catalog.QUERIES[name](spark, SMALL)), []
    monkeypatch.setattr(codebase, "SLICE_LINES", 3500)
    monkeypatch.setattr(catalog, "written", lambda df: put.append(lineage.written(df)) or put[-1])
    sliced = catalog.QUERIES[name](spark, SMALL)
    assert _rows(sliced) == whole and len(put) >= 2
    projects = [{r[0] for r in df.select("project_id").distinct().collect()} for df in put if "project_id" in df.columns]
    assert all(0 < len(some) < 25 for some in projects)


def test_slices_have_each_row_once(spark, tmp_path):
    """Also those of customers without a nation, which the first slice has."""
    for table, df in codebase.tables(spark, SMALL).items():
        if table == "customer":
            df = df.withColumn("c_nationkey", F.when(F.col("c_custkey") % 9 > 0, F.col("c_nationkey")))
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    bought = codebase._bought(codebase.tables(spark, str(tmp_path)), 3)
    sold = codebase.sales(spark, str(tmp_path))
    parts = [codebase.Slice(rest, 4, bought) for rest in range(4)]
    for rows in (codebase.classes, codebase.references):
        each = [_rows(rows(spark, str(tmp_path), sold, part=part)) for part in parts]
        assert sorted(sum(each, [])) == _rows(rows(spark, str(tmp_path))) and all(each)


def test_shuffles_of_a_written_table_are_removed(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (found.apply(i).toString() for i in range(found.size())) if "/shuffle_" in f}

    before, set_before = files(), spark.conf.get(lineage.CLEANUP, None)
    table = lineage.written(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(lineage.CLEANUP, None) == set_before
    assert _rows(table.orderBy("k")) == [f"Row(k={k}, count=100)" for k in range(10)]


def test_counts_by_target_are_those_of_edges(spark):
    """Classes of one name in two files, before, after and in the file that first refers to it, and a name that no class has."""
    classes = spark.createDataFrame(
        [("P", 1, "Aa", "a", "CONTROLLER"), ("P", 2, "Bb", "b", "ENTITY"), ("P", 3, "Bb", "c", "REPOSITORY"), ("P", 4, "Cc", "d", "SERVICE"), ("P", 5, "Cc", "e", "ENTITY"), ("P", 6, None, "f", "DTO"), ("Q", 1, "Dd", "g", "SERVICE")],
        "project_id string, file_seq long, class_name string, package_name string, component_type string",
    )
    refs = spark.createDataFrame([("P", f, r, "FIELD", t) for f, r, t in ((1, 0, "Bb"), (1, 1, "Zoo"), (5, 0, "Cc"), (4, 1, "Bb"), (6, 0, "Cc"), (3, 0, "Aa"))], "project_id string, file_seq long, ref_seq long, ref_kind string, raw_type string")
    edges = graph.edges(graph.resolved(classes, refs))
    targets = graph.by_target(analysis.denied(edges), n=F.count(F.lit(1)), denied=F.count_if("denied"))
    nodes = graph.nodes_of(classes, edges)
    assert _rows(graph.node_roles(classes, targets)) == _rows(nodes.drop("file_seq", "ref_seq"))
    assert {tuple(r) for r in graph.sizes(classes, targets).collect()} == {("P", nodes.filter("project_id = 'P'").count(), edges.count()), ("Q", 1, 0)}
    assert targets.agg(F.sum("denied")).first()[0] == analysis.violations(edges).count() > 0
