"""What queries over the shop's edges and nodes share: nothing is made distinct or moved that the next step doesn't need."""

import pytest

from pyspark.sql import functions as F

from stratograph.functions import expressions as E
from stratograph.operators import graph
from stratograph.plans import catalog, codebase

SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("placed", [False, True])
def test_repeated_references_are_those_of_the_sql(spark, placed):
    some = codebase.references(spark, SMALL, placed=placed, repeats=True)
    assert _rows(some.distinct()) == _rows(codebase.references(spark, SMALL)) and some.count() > some.distinct().count()


def test_edges_and_nodes_take_repeated_references(spark):
    classes, refs = codebase.classes(spark, SMALL), codebase.references(spark, SMALL)
    twice = refs.union(refs)
    assert _rows(graph.edges(graph.resolved(classes, twice))) == _rows(graph.edges(graph.resolved(classes, refs)))
    assert _rows(graph.nodes_of(classes, graph.entering(twice))) == _rows(graph.nodes_of(classes, graph.entering(refs)))


def test_nodes_deal_no_reference_by_file(spark):
    assert "hashpartitioning(file_seq" not in _plan(catalog.QUERIES["set1_nodes"](spark, SMALL))


def test_orders_and_parts_are_joined_in_tasks_of_bounded_size(spark):
    """Also where customers and parts are too many to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sold = codebase.sales(spark, SMALL)
        plan = _plan(codebase.classes(spark, SMALL, sold)) + _plan(codebase.references(spark, SMALL, sold))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [o_custkey" not in plan and "SortMergeJoin [partkey" not in plan


def test_names_of_types_with_spaces_and_control_characters(spark):
    raw = ["", " ", "\t", "A1", " Bb ", "\x01 Bb\x1f", "Bb\x00", " Bbé ", "a. Cc", "List< Dd >", "Map<A, \tEe\n>", "? extends  Ff", "X<? extends  Gg >", "Map<List<A>, ? extends B>", ">Hh<", "<>", None]
    named = ["", "", "", "A1", "Bb", "Bb", "Bb", " Bbé", " Cc", "Dd", "Ee", None, "Gg", None, "", "", ""]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw_type string")
    for found in (graph.named(df, "n"), df.withColumn("n", E.normalize_type(F.col("raw_type")))):
        assert [r["n"] for r in found.orderBy("i").collect()] == named
    plan = _plan(graph.named(df, "n"))
    assert plan.count("Generate") == 3


def test_nodes_write_out_only_the_first_reference_of_a_type(spark):
    """Of references that are alike but for their file; nodes of them are those of all, and nothing is sold twice on the way to them."""
    few = codebase.references(spark, SMALL, codebase.first_sales(spark, SMALL), repeats=True)
    every, classes = codebase.references(spark, SMALL), codebase.classes(spark, SMALL)
    assert few.join(every, every.columns, "left_anti").isEmpty() and few.count() < every.count()
    built = few.filter("ref_kind = 'CONSTRUCTOR'")
    assert built.select("project_id", "raw_type").distinct().count() == built.count() < every.filter("ref_kind = 'CONSTRUCTOR'").count()
    assert _rows(graph.nodes_of(classes, graph.entering(few))) == _rows(graph.nodes_of(classes, graph.entering(every)))
    firsts = codebase.classes(spark, SMALL, codebase.first_sales(spark, SMALL))
    assert _rows(firsts.select("project_id", "file_seq", "class_name")) == _rows(classes.select("project_id", "file_seq", "class_name"))


def test_nodes_are_sorted_once(spark):
    """Classes and what refers to them go to their name together."""
    plan = _plan(catalog.QUERIES["set1_nodes"](spark, SMALL))
    assert "SortAggregate" not in plan and "SortMergeJoin [_key" not in plan and plan.count("Window [") == 1


def test_empty_lists_of_classes_are_not_cut(spark):
    rows = codebase.unclassified(spark, SMALL)
    plain = codebase.derive(spark, SMALL, codebase.CLASSES).select("file_seq", "project_id", *(F.array_remove(F.split(c, ","), "").alias(c) for c in ("annotations", "interfaces")))
    assert _rows(rows.select(*plain.columns)) == _rows(plain)
    plan = _plan(rows)
    assert plan.count("array_remove(split(") == plan.count("ELSE array_remove(split(") > 0
