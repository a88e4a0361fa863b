"""One module for each class, how modules hang together, and classes that all of them share. Extensions of controller modules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import NO_CLASS, components
from .lineage import checkpoint

#: What a step along a dependency of a kind costs: a class is closest to what it cannot be made without.
STEP_COSTS = {"CONSTRUCTOR": 1, "FIELD": 2, "METHOD_PARAMETER": 3}
#: The cost of kinds that are not listed.
OTHER_COST = 3


def _links(edges: DataFrame, cost: Column) -> DataFrame:
    """Both directions of the links between classes: project_id, a, b, cost (the least of a pair)."""
    src = F.coalesce("src", F.lit(NO_CLASS))
    ways = edges.select("project_id", src.alias("a"), F.col("dst").alias("b"), cost.alias("cost"))
    both = ways.unionByName(ways.select("project_id", F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    return both.filter("a != b").groupBy("project_id", "a", "b").agg(F.min("cost").alias("cost"))


def primary_modules(nodes: DataFrame, edges: DataFrame, role: str = "CONTROLLER", costs: Mapping[str, int] = STEP_COSTS) -> DataFrame:
    """The one module of each class: project_id, class_name, module_name, distance. It is the module of the node of ``role`` that is
    nearest over undirected links, a link costing its cheapest kind; of nodes as near, the first in node order. Classes that no
    such node reaches have no module, and neither (null, null). Files without a class carry paths but are no row.

    All starts spread at once. A round sends only what the last one improved, and keeps the least (distance, start) of each
    class, so rows stay at one a class whatever the number of starts. Costs must be positive.
    """
    cost = F.coalesce(*(F.when(F.col("dependency_type") == kind, c) for kind, c in costs.items()), F.lit(OTHER_COST)).cast("long")
    links = checkpoint(_links(edges, cost))
    starts = nodes.filter(F.col("component_type") == role)
    at_start = F.struct(F.lit(0).cast("long").alias("distance"), "file_seq", "ref_seq", F.col("class_name").alias("module_name"))
    best = fresh = checkpoint(starts.select("project_id", F.col("class_name").alias("id"), at_start.alias("m")))
    while not fresh.isEmpty():
        further = F.struct((F.col("m.distance") + F.col("cost")).alias("distance"), "m.file_seq", "m.ref_seq", "m.module_name")
        sent = fresh.withColumnRenamed("id", "a").join(links, ["project_id", "a"]).select("project_id", F.col("b").alias("id"), further.alias("n"))
        sent = sent.groupBy("project_id", "id").agg(F.min("n").alias("n"))
        better = F.col("m").isNull() | (F.col("n") < F.col("m"))
        merged = best.join(sent, ["project_id", "id"], "full").withColumn("improved", F.col("n").isNotNull() & better)
        merged = checkpoint(merged.select("project_id", "id", F.when(F.col("improved"), F.col("n")).otherwise(F.col("m")).alias("m"), "improved"))
        best, fresh = merged.drop("improved"), merged.filter("improved").drop("improved")
    found = nodes.select("project_id", "class_name").join(best.withColumnRenamed("id", "class_name"), ["project_id", "class_name"], "left")
    return found.select("project_id", "class_name", "m.module_name", "m.distance")


def cohesion(primary: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each module of ``primary`` (every kind of dependency counts): project_id, module_name, classes, internal, outgoing,
    incoming, cohesion (internal edges' share) and coupling (the others'); both null without an edge. Classes without a module
    are outside of all."""
    of = primary.filter("module_name IS NOT NULL").select("project_id", "class_name", "module_name")
    here = lambda end, name: of.select("project_id", F.col("class_name").alias(end), F.col("module_name").alias(name))
    placed = edges.select("project_id", "src", "dst").join(here("src", "from"), ["project_id", "src"], "left").join(here("dst", "to"), ["project_id", "dst"], "left")
    # an edge inside counts once, one across once at each end
    same = F.col("from").eqNullSafe(F.col("to"))
    ends = F.when(same, F.array(F.struct(F.col("from").alias("module_name"), F.lit("internal").alias("way")))).otherwise(
        F.array(F.struct(F.col("from").alias("module_name"), F.lit("outgoing").alias("way")), F.struct(F.col("to").alias("module_name"), F.lit("incoming").alias("way")))
    )
    counted = placed.select("project_id", F.explode(ends).alias("e")).select("project_id", "e.*").filter("module_name IS NOT NULL")
    ways = ("internal", "outgoing", "incoming")
    counted = counted.groupBy("project_id", "module_name").agg(*(F.count_if(F.col("way") == w).alias(w) for w in ways))
    sizes = of.groupBy("project_id", "module_name").agg(F.count(F.lit(1)).alias("classes"))
    out = sizes.join(counted, ["project_id", "module_name"], "left").fillna(0, list(ways))
    every = F.nullif(F.col("internal") + F.col("outgoing") + F.col("incoming"), F.lit(0))
    return out.select(
        "project_id", "module_name", "classes", *ways, (F.col("internal") / every).alias("cohesion"), ((F.col("outgoing") + F.col("incoming")) / every).alias("coupling")
    )


def core(edges: DataFrame, k: int) -> DataFrame:
    """The k-core of the undirected graph, parallel and opposite edges counted once: project_id, class_name, neighbours (in the
    core). Classes with fewer than k neighbours go until none does; files without a class are one like others."""
    links = checkpoint(_links(edges, F.lit(1)).drop("cost"))
    left = links.count()
    while True:
        degree = links.groupBy("project_id", "a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        if not left:
            break
        stay = degree.select("project_id", "a")
        links = checkpoint(links.join(stay, ["project_id", "a"], "left_semi").join(stay.withColumnRenamed("a", "b"), ["project_id", "b"], "left_semi").select("project_id", "a", "b"))
        now = links.count()
        if now == left:
            break
        left = now
    found = links.groupBy("project_id", F.col("a").alias("class_name")).agg(F.count(F.lit(1)).alias("neighbours"))
    return found.filter(F.col("class_name") != NO_CLASS)


def shared_classes(nodes: DataFrame, edges: DataFrame, k: int = 3, dependents: int = 5, role: str = "CONTROLLER") -> DataFrame:
    """Shared infrastructure: project_id, class_name, dependents. Classes of the k-core, but for those of ``role``, that at least so
    many different classes depend on."""
    counted = edges.filter("src IS NOT NULL").groupBy("project_id", F.col("dst").alias("class_name")).agg(F.count_distinct("src").alias("dependents"))
    often = counted.filter(F.col("dependents") >= dependents)
    starts = nodes.filter(F.col("component_type") == role).select("project_id", "class_name")
    return often.join(core(edges, k).drop("neighbours"), ["project_id", "class_name"], "left_semi").join(starts, ["project_id", "class_name"], "left_anti")


def modules_without(nodes: DataFrame, edges: DataFrame, shared: DataFrame, role: str = "CONTROLLER") -> DataFrame:
    """Modules before and after ``shared`` classes (project_id, class_name) are set apart: project_id, module_name, classes_before,
    classes_after, shared (how many of them the module depends on). A module is the component of a node of ``role``; sizes are
    counted by component, nothing is expanded."""
    gone = checkpoint(shared.select("project_id", "class_name").distinct())
    starts = nodes.filter(F.col("component_type") == role).select("project_id", "class_name")

    def labelled(n: DataFrame, e: DataFrame) -> DataFrame:
        return checkpoint(components(e, n))

    def sizes(members: DataFrame, name: str) -> DataFrame:
        n = members.groupBy("project_id", "label").agg(F.count(F.lit(1)).alias(name))
        return starts.join(members, ["project_id", "class_name"]).join(n, ["project_id", "label"])

    rest_nodes = nodes.join(gone, ["project_id", "class_name"], "left_anti")
    rest = edges
    for end in ("src", "dst"):
        rest = rest.join(gone.withColumnRenamed("class_name", end), ["project_id", end], "left_anti")
    before, after = labelled(nodes, edges), labelled(rest_nodes, rest)
    uses = edges.join(gone.withColumnRenamed("class_name", "dst"), ["project_id", "dst"], "left_semi").select("project_id", F.coalesce("src", F.lit(NO_CLASS)).alias("class_name"), "dst")
    used = uses.join(after, ["project_id", "class_name"]).groupBy("project_id", "label").agg(F.count_distinct("dst").alias("shared"))
    out = sizes(before, "classes_before").drop("label").join(sizes(after, "classes_after").join(used, ["project_id", "label"], "left").drop("label"), ["project_id", "class_name"], "left")
    return out.select("project_id", F.col("class_name").alias("module_name"), "classes_before", F.coalesce("classes_after", F.lit(0)).alias("classes_after"), F.coalesce("shared", F.lit(0)).alias("shared"))
