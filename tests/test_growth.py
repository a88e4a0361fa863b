"""The derived code base and its reports over many rows: tasks that grow with the input, texts put together from pieces."""

from pyspark.sql import functions as F

from stratograph.functions import expressions as E
from stratograph.operators import graph, lineage, render
from stratograph.plans import catalog, codebase

SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


def test_derivation_gives_the_rows_of_its_sql(spark, tmp_path):
    """With doubled parts, suppliers and sales, and a part without a key, which the SQL makes distinct."""
    for table, df in codebase.tables(spark, SMALL).items():
        if table in ("part", "supplier", "lineitem"):
            df = df.union(df.limit(50))
        if table == "part":
            df = df.union(df.limit(20).withColumn("p_size", F.lit(3).cast(df.schema["p_size"].dataType)))
        if table == "lineitem":
            df = df.union(df.limit(5).withColumn("l_partkey", F.lit(None).cast("long")))
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    own = codebase.tables(spark, str(tmp_path))
    sales = spark.sql(codebase.SALES, **{t: own[t] for t in ("lineitem", "orders", "customer")})
    for sql in (codebase.CLASSES, codebase.REFERENCES):
        used = {t: df for t, df in {**own, "sales": sales}.items() if "{" + t + "}" in sql}
        assert _rows(codebase.derive(spark, str(tmp_path), sql)) == _rows(spark.sql(sql, **used))


def test_a_task_takes_no_more_of_a_larger_table(spark, monkeypatch):
    few = catalog._edges(spark, SMALL)
    expected = _rows(few.select("project_id", "src", "dst", "dependency_type", "file_seq", "ref_seq", "dst_type"))
    monkeypatch.setattr(lineage, "TASK_ROWS", 500)
    many = catalog._edges(spark, SMALL)
    assert many.rdd.getNumPartitions() >= codebase.tables(spark, SMALL)["lineitem"].count() / 500
    assert _rows(many.select("project_id", "src", "dst", "dependency_type", "file_seq", "ref_seq", "dst_type")) == expected


def test_distinct_sales_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(lineage, "TASK_ROWS", 500)
    dealt_into, real = [], codebase.written
    monkeypatch.setattr(codebase, "written", lambda df: dealt_into.append(df.rdd.getNumPartitions()) or real(df))
    sold = codebase.sales(spark, SMALL)
    assert len(dealt_into) == len(sold) == 3 and min(dealt_into) >= codebase.tables(spark, SMALL)["lineitem"].count() / 500


def test_nodes_of_edges_are_those_of_references(spark):
    classes, found = catalog._shop(spark, SMALL)
    assert _rows(graph.nodes(classes, graph.edges(found).drop(graph.KEY))) == _rows(graph.nodes(classes, found))


def test_texts_from_pieces(spark):
    """A batch holds 10,000 lines; projects' lines are mixed, one project has none, one has lines but no head."""
    rows = spark.range(70_000).select(F.concat(F.lit("P"), (F.col("id") % 3).cast("string")).alias("project_id"), (70_000 - F.col("id")).alias("file_seq"), F.lit(0).alias("ref_seq"), F.col("id").cast("string").alias("line"))
    around = spark.createDataFrame([("P0", "h0", "t0"), ("P1", "h1", None), ("P9", "h9", "none")], "project_id string, head string, tail string")
    found = {r["project_id"]: r["report"] for r in render.whole_texts(rows, around, 5).collect()}
    lines = lambda p: [str(i) for i in range(69_999, -1, -1) if i % 3 == p]
    assert found == {"P0": "\n".join(["h0", *lines(0), "t0"]), "P1": "\n".join(["h1", *lines(1)]), "P9": "h9\nnone"}


def test_edges_and_nodes_without_lookups(spark):
    """Files that share a class name, a class that refers to itself, files without a class, a reference of no file, unknown targets."""
    classes = spark.createDataFrame(
        [("P", 1, "Aa", "a", "SERVICE"), ("P", 2, "Aa", "b", "DTO"), ("P", 3, None, "c", "UNKNOWN"), ("P", 4, "Bb", "d", None), ("Q", 1, "Bb", "e", "ENTITY"), ("P", 5, " ", "f", "DTO"), (None, 6, "Aa", "g", "DTO")],
        "project_id string, file_seq long, class_name string, package_name string, component_type string",
    )
    refs = spark.createDataFrame(
        [("P", f, r, k, t) for f, r, k, t in ((2, 0, "FIELD", "Bb"), (1, 1, "FIELD", "Bb"), (1, 0, "FIELD", "List<Bb>"), (1, 2, "METHOD_PARAMETER", "Bb"), (1, 3, "FIELD", "Aa"), (3, 0, "FIELD", "Bb"), (3, 1, "FIELD", "Zoo"), (4, 0, "FIELD", "Zoo"), (2, 1, "FIELD", "Aa"))],
        "project_id string, file_seq long, ref_seq long, ref_kind string, raw_type string",
    )
    found = graph.resolved(classes, refs)
    edge = ("project_id", "src", "dst", "dependency_type", "file_seq", "ref_seq", "src_type")
    lone = spark.createDataFrame([("P", 9, 0, "FIELD", "Bb")], refs.schema)
    bare = graph.edges_by_source(graph.sourced(classes, refs.union(lone), 3), 3)
    assert _rows(bare.select(*edge)) == _rows(graph.edges(found).select(*edge)) and bare.count() == 5
    nodes = _rows(graph.nodes(classes, found))
    assert _rows(graph.nodes_of(classes, graph.entering(refs))) == _rows(graph.nodes_of(classes, graph.edges(found), 3)) == nodes and len(nodes) == 5
    targets = {r["src"]: r["targets"] for r in graph.adjacency(bare.filter("src IS NOT NULL")).collect()}
    assert targets == {"Aa": ["Bb", "Bb"], "Bb": ["Zoo"]}


def test_edge_lines_look_up_and_sort_no_more_than_they_need(spark):
    plan = catalog.QUERIES["str3_edge_lines"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [file_seq" not in plan and "max_by" not in plan and "format_string" not in plan


def test_lines_with_nulls(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS n, 'X' AS x")
    lines = row.select(E.edge_line(F.col("n"), F.col("x"), F.col("n")), E.node_line(F.col("n"), F.col("n")), E.violation_message(*map(F.col, "xnxn"))).first()
    assert tuple(lines) == ("null --(X)--> null", "null (null)", "X 'null' must not depend on X 'null'")
