"""Reports and responses as text, a row per project."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import fixed
from ..sources.archives import shown_id
from .lineage import tasks_for

_CHUNK = "project_id string, part int, file_seq long, ref_seq long, chunk long, text string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each batch, which are in order, as one text for each project, with the place of its first line."""
    for i, batch in enumerate(batches):
        first: dict[str, int] = {}
        lines: dict[str, list[str]] = {}
        for k, (project, line) in enumerate(zip(batch["project_id"].to_pylist(), batch["line"].to_pylist())):
            first.setdefault(project, k)
            lines.setdefault(project, []).append(line)
        at = pa.array(first.values(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch[c].take(at) for c in ("project_id", "part", "file_seq", "ref_seq")), pa.array([i] * len(first), pa.int64()), pa.array(map("\n".join, lines.values()), pa.string())],
            names=["project_id", "part", "file_seq", "ref_seq", "chunk", "text"],
        )


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each project, which come one after the other and in order, as one; a project whose first piece isn't a head is left
    out. A text is held once, in a buffer that it is also sent from."""
    project, text, headed = batches, bytearray(), False  # no project's name

    def row() -> pa.RecordBatch:
        report = pa.Array.from_buffers(pa.string(), 1, [None, pa.array([0, len(text)], pa.int32()).buffers()[1], pa.py_buffer(text)])
        return pa.RecordBatch.from_arrays([pa.array([project], pa.string()), report], names=["project_id", "report"])

    for batch in batches:
        column = batch["text"]
        for i, (name, part) in enumerate(zip(batch["project_id"].to_pylist(), batch["part"].to_pylist())):
            if name != project:
                if headed:
                    yield row()
                project, text, headed = name, bytearray(), part == 0
            elif headed:
                text += b"\n"
            if headed:
                text += column[i].as_buffer()
        del batch, column
    if headed:
        yield row()


def _two_cores(df: DataFrame) -> ResourceProfile | None:
    """That a task counts as two, where executors are known to have two cores for it: half as many texts are then held at once."""
    sc = df.sparkSession.sparkContext
    cores = re.match(r"local-cluster\[\s*\d+\s*,\s*(\d+)", sc.master)
    cores = int(cores[1] if cores else sc.getConf().get("spark.executor.cores", "0"))
    if cores < 2 or sc.master.startswith("local["):
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(2)).build


def whole_texts(lines: DataFrame, around: DataFrame, parts: int | None = None) -> DataFrame:
    """project_id, report: for each row of ``around`` (project_id, head, and tail or null), head, ``lines`` (project_id, file_seq, ref_seq,
    line) in order, tail. Lines are dealt by ranges and joined by the batch, so only a project's joined pieces meet in a task, never
    its lines. They are sorted there and put together as they pass, by tasks that take two cores: what is held of
    a row that large, here and by its writer, adds up in an executor."""
    order = ("project_id", "file_seq", "ref_seq")
    ranges = lines.filter("project_id IS NOT NULL").select("project_id", F.lit(1).alias("part"), F.col("file_seq").cast("long"), F.col("ref_seq").cast("long"), "line")
    ranges = ranges.repartitionByRange(parts, *order) if parts else ranges.repartitionByRange(*order)
    chunks = ranges.sortWithinPartitions("file_seq", "ref_seq", "project_id", "line").mapInArrow(_joined, _CHUNK)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("head").alias("text")), F.struct(F.lit(2).alias("part"), F.col("tail").alias("text"))))
    none = F.lit(None).cast("long")
    outer = around.select("project_id", ends.alias("x")).select("project_id", "x.part", none.alias("file_seq"), none.alias("ref_seq"), none.alias("chunk"), "x.text")
    every = chunks.union(outer.filter("text IS NOT NULL")).repartition(8 * tasks_for(lines, 0), "project_id")
    return every.sortWithinPartitions("project_id", "part", "file_seq", "ref_seq", "chunk").select("project_id", "part", "text").mapInArrow(_put_together, "project_id string, report string", profile=_two_cores(lines))


def plantuml(edges: DataFrame) -> DataFrame:
    """A diagram's source: a line for each edge, so for each kind of dependency."""
    lines = E.ordered_lines(F.concat(F.coalesce("src", F.lit("null")), F.lit(" --> "), F.col("dst")), F.col("file_seq"), F.col("ref_seq"))
    return edges.groupBy("project_id").agg(lines.alias("l")).select("project_id", F.concat(F.lit("@startuml\n\n"), F.col("l"), F.lit("\n\n@enduml")).alias("plantuml"))


def graph_text(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Counts and edges of the graph in order, of ``parts`` ranges of lines (None: as many as the session says)."""
    count = nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sized_text(count.join(edges.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_edges")), "project_id", "left").fillna(0, ["n_edges"]), edges, parts)


def sized_text(sizes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """``graph_text`` of projects whose ``sizes`` (project_id, n_nodes, n_edges) are known."""
    line = E.edge_line(F.col("src"), F.col("dependency_type"), F.col("dst"))
    head = F.format_string("Dependency Graph\nNodes : %d\nEdges : %d", "n_nodes", "n_edges")
    around = sizes.select("project_id", head.alias("head"), F.when(F.col("n_edges") == 0, F.lit("No dependencies found.")).alias("tail"))
    return whole_texts(edges.select("project_id", "file_seq", "ref_seq", line.alias("line")), around, parts)


def summary_text(summary: DataFrame) -> DataFrame:
    """Counted roles in report order."""
    lines = E.ordered_lines(F.format_string("%-20s : %d", "component_type", "n"), F.col("ordinal"))
    return summary.filter("n > 0").groupBy("project_id").agg(lines.alias("report"))


#: Headings, rules and labels of the reports.
DOUBLE, SINGLE, PLAN_DOUBLE, DASHES = "=" * 47, "-" * 47, "=" * 41, "-" * 40
LAYER_LABELS = {"CONTROLLER": "Controllers", "SERVICE": "Services", "REPOSITORY": "Repositories", "ENTITY": "Entities", "COMPONENT": "Components", "CONFIGURATION": "Configurations"}
MAPPING_LABELS = {
    "Class": "class_name", "Module": "module_name", "Folder": "folder_type", "Source Package": "source_package", "Base Package": "base_package", "Target Package": "target_package", "Target File": "target_file",
}


def _titled(title: str, *body: Column) -> Column:
    """A report between double rules."""
    return F.concat(F.lit(f"{DOUBLE}\n{title}\n{DOUBLE}\n"), *body, F.lit(f"\n{DOUBLE}"))


def _labelled(label: str, value: Column, width: int) -> Column:
    return F.concat(F.lit(f"{label:<{width}}: "), F.coalesce(value.cast("string"), F.lit("null")))


def _for_all(blocks: DataFrame, projects: DataFrame | None, without: str) -> DataFrame:
    """``blocks`` (project_id, l), and for those of ``projects`` without one the text that says so."""
    if projects is None:
        return blocks
    return projects.select("project_id").distinct().join(blocks, "project_id", "left").fillna(without, ["l"])


def architecture_text(report: DataFrame, violations: DataFrame, parts: int | None = None) -> DataFrame:
    """Layer counts and dependencies of each project, and its violations in the order of edges, of ``parts`` ranges of them."""
    counts = F.concat_ws("\n", *(_labelled(LAYER_LABELS[t], F.col(t.lower()), 17) for t in fixed.COUNTED_LAYERS), _labelled("Dependencies", F.col("dependencies"), 17))
    head = F.concat(F.lit(f"{DOUBLE}\nARCHITECTURE REPORT\n{DOUBLE}\n"), counts, F.lit(f"\n\nArchitecture Violations\n{SINGLE}"))
    tail = F.concat(F.when(F.col("violations") == 0, F.lit("No architecture violations detected.\n")).otherwise(F.lit("")), F.lit(DOUBLE))
    around = report.select("project_id", head.alias("head"), tail.alias("tail"))
    return whole_texts(violations.select("project_id", "file_seq", "ref_seq", F.col("message").alias("line")), around, parts)


def cycles_text(cycles: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Cycles in order, a node a line. With ``projects`` (project_id) given, those without a cycle have a report that says so."""
    line = F.concat(F.format_string("Cycle %d\n\n", "cycle_seq"), F.array_join("path", "\n   ↓\n"), F.lit("\n"))
    blocks = cycles.groupBy("project_id").agg(E.ordered_lines(line, F.col("cycle_seq")).alias("l"))
    told = _for_all(blocks, projects, "No circular dependencies found.")
    return told.select("project_id", _titled("CIRCULAR DEPENDENCY REPORT", F.col("l")).alias("report"))


def modules_text(modules: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Modules with their members in order; needs module_seq and member_seq. With ``projects`` (project_id) given, those without a module
    have a report that says so."""
    line = F.concat(F.lit("   - "), F.coalesce("class_name", F.lit("null")))
    each = modules.groupBy("project_id", "module_seq", "module_name").agg(E.ordered_lines(line, F.col("member_seq")).alias("l"))
    block = F.concat(F.col("module_name"), F.lit("\n"), F.col("l"), F.lit("\n"))
    blocks = each.groupBy("project_id").agg(E.ordered_lines(block, F.col("module_seq")).alias("l"))
    text = F.concat(F.lit("\n========== DISCOVERED MODULES ==========\n"), F.col("l"), F.lit("\n" + "=" * 40))
    return _for_all(blocks, projects, "No modules discovered.").select("project_id", text.alias("report"))


def layout_text(modules: DataFrame) -> DataFrame:
    """Modules in order, their folder kinds in the order in which members first need them, and each folder's classes in member order;
    needs module_seq and member_seq."""
    rows = modules.withColumn("folder_type", E.folder_type(F.col("component_type")))
    line = F.concat(F.lit("      - "), F.coalesce("class_name", F.lit("null")))
    folders = rows.groupBy("project_id", "module_seq", "module_name", "folder_type").agg(F.min("member_seq").alias("first"), E.ordered_lines(line, F.col("member_seq")).alias("l"))
    folder = F.concat(F.lit("  "), F.col("folder_type"), F.lit("\n"), F.col("l"))
    each = folders.groupBy("project_id", "module_seq", "module_name").agg(E.ordered_lines(folder, F.col("first")).alias("l"))
    block = F.concat(F.lit("Module : "), F.col("module_name"), F.lit("\n"), F.col("l"), F.lit("\n"))
    return each.groupBy("project_id").agg(_titled("MODULE LAYOUT", E.ordered_lines(block, F.col("module_seq"))).alias("report"))


def mapping_block() -> Column:
    """A mapping as a block of seven labelled lines between dashes."""
    return F.concat_ws("\n", F.lit(DASHES), *(_labelled(label, F.col(c), 16) for label, c in MAPPING_LABELS.items()), F.lit(DASHES))


def mapping_text(mappings: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """All mappings of a project: by module_seq and member_seq if there are such, else by name. With ``projects`` (project_id) given, those
    without a mapping have a report that says so."""
    order = ("module_seq", "member_seq") if "member_seq" in mappings.columns else ("module_name", "class_name")
    blocks = mappings.groupBy("project_id").agg(E.ordered_lines(F.concat(mapping_block(), F.lit("\n")), *map(F.col, order)).alias("l"))
    text = F.concat(F.lit("\n========== TRANSFORMATION PLAN ==========\n"), F.col("l"), F.lit(f"\n{PLAN_DOUBLE}"))
    return _for_all(blocks, projects, "No transformation mappings generated.").select("project_id", text.alias("report"))


def response(success: Column, message: Column, data: Column) -> Column:
    """The JSON that an upload is answered with; fields without a value are written as null."""
    return F.to_json(F.struct(success.alias("success"), message.alias("message"), data.alias("data")), {"ignoreNullFields": "false"})


def upload_response(projects: DataFrame) -> DataFrame:
    """For accepted projects (project_id, project_name, file_size): the response, whose status is always UPLOADED."""
    data = F.struct(shown_id(F.col("project_id")).alias("projectId"), F.col("project_name").alias("projectName"), F.col("file_size").alias("fileSize"), F.lit("UPLOADED").alias("status"))
    return projects.select("project_id", response(F.lit(True), F.lit("Project uploaded successfully."), data).alias("response"))
