"""Modules around controllers, their layout in folders, and where each class would move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from .graph import NO_CLASS, components, traversal


def discover(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules as sets: each controller with all members of its component. project_id, module_name, class_name,
    component_type, package_name.

    Members stay keyed by their component; they are expanded to controllers last, as one join.
    """
    member = components(edges, nodes)
    named = member.join(nodes.select("project_id", "class_name", "component_type", "package_name"), ["project_id", "class_name"], "left")
    controllers = named.filter("component_type = 'CONTROLLER'").select("project_id", "label", F.col("class_name").alias("module_name"))
    rows = controllers.join(named, ["project_id", "label"])
    return rows.select("project_id", "module_name", F.nullif(F.col("class_name"), F.lit(NO_CLASS)).alias("class_name"), "component_type", "package_name").distinct()


def discover_ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same with the order of the depth-first search: module_seq and member_seq."""
    found = traversal(nodes, edges).withColumnsRenamed({"start_seq": "module_seq", "start": "module_name"})
    return found.join(nodes.select("project_id", "class_name", "component_type", "package_name"), ["project_id", "class_name"], "left")


def layout(modules: DataFrame) -> DataFrame:
    """Class names of each module by folder kind, in member order if there is one."""
    order = F.col("member_seq") if "member_seq" in modules.columns else F.col("class_name")
    rows = modules.withColumn("folder_type", E.folder_type(F.col("component_type")))
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("class_name").alias("c"))))
    return rows.groupBy("project_id", "module_name", "folder_type").agg(F.transform(listed, lambda r: r["c"]).alias("classes"))


def base_package(modules: DataFrame) -> DataFrame:
    """The longest common package of all module members: project_id, base_package ('' without any). It is that of the least
    and the greatest package, split into segments."""
    segments = F.split("package_name", r"\.")
    known = F.when(~E.is_blank(F.col("package_name")), segments)
    ends = modules.groupBy("project_id").agg(F.min(known).alias("low"), F.max(known).alias("high"))
    common = E.common_prefix(F.array_join("low", "."), F.array_join("high", "."))
    return ends.select("project_id", F.coalesce(common, F.lit("")).alias("base_package"))


def mappings(modules: DataFrame) -> DataFrame:
    """For each member of each module, its folder, target package and target file. A class in two modules has two rows."""
    rows = modules.join(base_package(modules), "project_id").withColumn("folder_type", E.folder_type(F.col("component_type")))
    rows = rows.withColumn("target_package", E.target_package(F.col("base_package"), F.col("module_name"), F.col("folder_type")))
    file = E.target_file(F.col("target_package"), F.col("class_name"))
    return rows.select(
        "project_id", "class_name", "module_name", "folder_type", F.col("package_name").alias("source_package"), "base_package", "target_package",
        file.alias("target_file"), *(c for c in ("module_seq", "member_seq") if c in modules.columns),
    )


def module_counts(modules: DataFrame) -> DataFrame:
    return modules.groupBy("project_id", "module_name").agg(F.count(F.lit(1)).alias("classes"))
