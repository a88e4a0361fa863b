"""The class-dependency graph of many projects at once.

Every table is keyed by project_id. The order that insertion has in a single program is carried by (file_seq, ref_seq): files in
path order, and in a file fields before constructors before methods.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as E
from .components import connected
from .lineage import checkpoint, dealt

#: Stands for the one node that all files without a class share.
NO_CLASS = "(no class)"


#: What a file is known by, and its class and its references meet on. Rows are dealt by all of it: Spark takes no part for both sides.
PLACE = ("file_seq", "project_id")
#: A hash of project and target (or class name), by which rows are dealt. It goes before them in joins, groups and windows: a sort
#: then compares numbers, and texts (of few projects, with names that begin alike) only where those are the same.
KEY = "_key"


def keyed(df: DataFrame, parts: int | None, name: str) -> DataFrame:
    """``df`` dealt into ``parts`` tasks (None: as many as the session says) by project and ``name``, with KEY, which isn't moved."""
    return dealt(df, parts, "project_id", name).withColumn(KEY, F.xxhash64("project_id", name))


def _first(df: DataFrame, columns: Sequence[str], order: Sequence[str], few: bool = False) -> DataFrame:
    """The first row in ``order`` of each value of ``columns``. Columns that nobody reads aren't carried, as an aggregate's would be. Where
    a value has ``few`` rows, the first is told by having none before it: Spark would first cut groups that a number limits, which
    costs as much again for each group."""
    window = Window.partitionBy(*columns).orderBy(*order)
    if few:
        return df.withColumn("_n", F.lag(F.lit(1)).over(window)).filter("_n IS NULL").drop("_n")
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def registry(classes: DataFrame, parts: int | None = None) -> DataFrame:
    """project_id, class_name, package_name, component_type: of files with the same class name the last one."""
    last = F.max_by(F.struct("package_name", "component_type"), "file_seq").alias("r")
    rows = keyed(classes.select("project_id", "class_name", "file_seq", "package_name", "component_type"), parts, "class_name")
    return rows.groupBy(KEY, "project_id", "class_name").agg(last).select("project_id", "class_name", "r.*")


#: What an extractor gives: the kind of its references and the column whose type texts they are, in the order of a file's references.
EXTRACTORS: tuple[tuple[str, str | Column], ...] = (("FIELD", "field_types"), ("CONSTRUCTOR", "constructor_types"), ("METHOD_PARAMETER", "parameter_types"))


def more_extractors() -> tuple[tuple[str, str | Column], ...]:
    """EXTRACTORS and, as an extension, superclasses, interfaces and type arguments at every level."""
    written = F.concat("field_types", "constructor_types", "parameter_types")
    arguments = F.flatten(F.transform(written, type_arguments))
    return (*EXTRACTORS, ("INHERITANCE", F.array_compact(F.array("super_class"))), ("IMPLEMENTATION", F.col("interfaces")), ("GENERIC", arguments))


def type_arguments(raw: Column) -> Column:
    """All types named within the brackets of a type text, at any level, in order; wildcards aren't types."""
    inside = F.when(F.locate("<", raw) > 0, F.substr(raw, F.locate("<", raw) + 1)).otherwise(F.lit(""))
    return F.filter(F.regexp_extract_all(inside, F.lit(r"[\p{L}_$][\p{L}\p{N}_$.]*"), F.lit(0)), lambda t: ~t.isin("extends", "super"))


def type_references(classes: DataFrame, extractors: Sequence[tuple[str, str | Column]] = EXTRACTORS) -> DataFrame:
    """Explode the columns of type texts that ``extractors`` name: project_id, file_seq, ref_seq, ref_kind, raw_type. An extractor is a
    kind and an array column, or an expression that gives one; a null array has no references."""
    none = F.array().cast("array<string>")

    def tagged(kind: str, types: str | Column) -> Column:
        column = F.col(types) if isinstance(types, str) else types
        return F.transform(F.coalesce(column, none), lambda t: F.struct(F.lit(kind).alias("ref_kind"), t.alias("raw_type")))

    every = F.concat(*(tagged(kind, types) for kind, types in extractors))
    rows = classes.select("project_id", "file_seq", F.posexplode(every).alias("ref_seq", "r"))
    return rows.select("project_id", "file_seq", F.col("ref_seq").cast("long").alias("ref_seq"), "r.*")


#: What a dependency of a kind weighs; those not listed weigh one.
WEIGHTS = {"INHERITANCE": 5, "IMPLEMENTATION": 4, "CONSTRUCTOR": 3, "FIELD": 2, "METHOD_PARAMETER": 1, "GENERIC": 1}


def dependency_weights(found: DataFrame, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """Of resolved references, a row for each two classes: project_id, src, dst, kinds (sorted), refs (places where one is written) and
    weight, the sum over them. No row leads from a class to itself."""
    weight = F.coalesce(*(F.when(F.col("ref_kind") == kind, w) for kind, w in weights.items()), F.lit(1))
    rows = found.filter(~F.col("src").eqNullSafe(F.col("dst")))
    return rows.groupBy("project_id", "src", "dst").agg(F.array_sort(F.collect_set("ref_kind")).alias("kinds"), F.count(F.lit(1)).alias("refs"), F.sum(weight).alias("weight"))


def named(refs: DataFrame, name: str) -> DataFrame:
    """``refs`` with the normalized type as ``name``. It is generated, not projected, so that no later filter or join writes its
    long expression out again for each place that names it; so are the trimmed text and the part of it that the name stands in, which
    the next step names several times."""
    once = lambda df, c, value: df.withColumn(c, F.explode(F.array(value)))
    trimmed = once(refs, "_trimmed", E.trim_java(F.col("raw_type")))
    parted = once(trimmed, "_part", E.name_part(F.col("_trimmed")))
    return once(parted, name, E.normalize_part(F.col("_trimmed"), F.col("_part"))).drop("_trimmed", "_part")


def sourced(classes: DataFrame, refs: DataFrame, parts: int | None = None, placed: bool = False) -> DataFrame:
    """References that enter the graph, with the attributes of their own file. Both are dealt by file into ``parts`` tasks unless they
    are ``placed`` so. A task keeps its share of classes as a table, so neither side is sorted."""
    deal = (lambda df: df) if placed else (lambda df: dealt(df, parts, *PLACE))
    entering = named(refs, "dst").filter(~E.is_ignored(F.col("dst")))
    own = classes.select("project_id", "file_seq", F.col("class_name").alias("src"), F.col("package_name").alias("src_package"), F.col("component_type").alias("src_type"))
    return deal(entering).join(deal(own).hint("shuffle_hash"), list(PLACE))


def resolved(classes: DataFrame, refs: DataFrame, parts: int | None = None, own: DataFrame | None = None) -> DataFrame:
    """References that enter the graph, with the attributes of their own file and of what they resolve to (null: external). They are
    dealt by project and target into ``parts`` tasks (None: as many as the session says), with KEY, so edges and nodes follow without
    a shuffle. Where references are dealt by file already, ``own`` are the classes dealt likewise."""
    known = registry(classes, parts).select("project_id", F.col("class_name").alias("dst"), F.col("package_name").alias("dst_package"), F.col("component_type").alias("dst_type"))
    found = sourced(classes, refs, parts) if own is None else sourced(own, refs, parts, placed=True)
    joined = dealt(found, parts, "project_id", "dst").join(known.hint("shuffle_hash"), ["project_id", "dst"], "left")
    return joined.withColumn(KEY, F.xxhash64("project_id", "dst"))


def type_errors(refs: DataFrame) -> DataFrame:
    """References whose type cannot be normalized, as rows of the error table."""
    message = F.concat(F.lit("cannot normalize type "), F.col("raw_type"))
    return named(refs, "name").filter("name IS NULL").select("project_id", F.lit("JavaParsing").alias("kind"), F.lit(400).alias("http_status"), message.alias("message"))


def edges(found: DataFrame, null_sources: bool = True) -> DataFrame:
    """Distinct edges (source, target, kind) of resolved references, the first one's attributes kept; no self-loops.

    Files without a class are one source, null; ``null_sources=False`` leaves their edges out.
    """
    rows = found.filter(~F.col("src").eqNullSafe(F.col("dst")))
    if not null_sources:
        rows = rows.filter(F.col("src").isNotNull())
    kept = _first_of_each(rows)
    return kept.select("project_id", "src", "dst", F.col("ref_kind").alias("dependency_type"), "file_seq", "ref_seq", "src_package", "src_type", "dst_package", "dst_type")


def _first_of_each(rows: DataFrame) -> DataFrame:
    """The first reference of each edge, of references dealt with KEY. A hash of the edge goes first, so a sort compares hardly more."""
    edge = ("project_id", "src", "dst", "ref_kind")
    return _first(rows.withColumn("_edge", F.xxhash64(*edge)), ("_edge", KEY, *edge), ("file_seq", "ref_seq"), few=True)


def edges_by_source(found: DataFrame, parts: int | None = None) -> DataFrame:
    """``edges`` of ``sourced`` references, without attributes of targets, for those who need none. They are dealt by project and
    source, so what is grouped by these follows without a shuffle."""
    rows = keyed(found.filter(~F.col("src").eqNullSafe(F.col("dst"))), parts, "src")
    return _first_of_each(rows).select(KEY, "project_id", "src", "dst", F.col("ref_kind").alias("dependency_type"), "file_seq", "ref_seq", "src_package", "src_type")


def nodes_of(classes: DataFrame, targets: DataFrame, parts: int | None = None) -> DataFrame:
    """``nodes`` of classes and ``targets`` (project_id, dst, file_seq, ref_seq), which may be edges, or references of files that are all
    among the classes (``entering``): attributes of targets are those of the registry, so no source is looked up."""
    own = classes.filter(F.col("class_name").isNotNull() & ~E.is_blank(F.col("class_name")))
    told = F.struct("package_name", "component_type")
    rows = own.select("project_id", "class_name", "file_seq", F.lit(-1).cast("long").alias("ref_seq"), told.alias("told"))
    met = targets.select("project_id", F.col("dst").alias("class_name"), "file_seq", "ref_seq", F.lit(None).cast(rows.schema["told"].dataType).alias("told"))
    # classes and targets of a name are sorted together, once: the first is the node, the last class is what the registry knows
    name = Window.partitionBy(KEY, "project_id", "class_name").orderBy("file_seq", "ref_seq")
    known = F.last("told", ignorenulls=True).over(name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = keyed(rows.union(met), parts, "class_name").select("*", F.row_number().over(name).alias("_n"), known.alias("_known")).filter("_n = 1")
    return first.select("project_id", "class_name", "file_seq", "ref_seq", F.coalesce("told", "_known").alias("t")).select("project_id", "class_name", "file_seq", "ref_seq", "t.*")


def by_target(graph_edges: DataFrame, **told: Column) -> DataFrame:
    """A row for each target of edges: project_id, dst, file_seq (the first that refers to it) and aggregates of its edges. Where edges are
    dealt by project and target, as ``edges`` are, they don't move."""
    return graph_edges.groupBy("project_id", "dst").agg(F.min("file_seq").alias("file_seq"), *(c.alias(name) for name, c in told.items()))


def node_roles(classes: DataFrame, targets: DataFrame, parts: int | None = None) -> DataFrame:
    """What ``nodes_of`` knows of each node but its place, of ``by_target`` rows: a class comes before the references of its own file, so the
    first file tells whether a class or a reference was there first."""
    return nodes_of(classes, targets.withColumn("ref_seq", F.lit(0).cast("long")), parts).drop("file_seq", "ref_seq")


def sizes(classes: DataFrame, targets: DataFrame, parts: int | None = None) -> DataFrame:
    """project_id, n_nodes, n_edges of ``by_target`` rows with n, the number of edges. Nodes are told by their names alone."""
    own = classes.filter(F.col("class_name").isNotNull() & ~E.is_blank(F.col("class_name"))).select("project_id", "class_name", F.lit(0).cast("long").alias("n"))
    each = dealt(own.union(targets.select("project_id", "dst", "n")), parts, "project_id", "class_name").groupBy("project_id", "class_name").agg(F.sum("n").alias("n"))
    return each.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n").alias("n_edges"))


def entering(refs: DataFrame) -> DataFrame:
    """References that enter the graph, by their files and targets: project_id, dst, file_seq, ref_seq."""
    rows = refs.filter(F.col("file_seq").isNotNull() & F.col("project_id").isNotNull()).select("project_id", "file_seq", "ref_seq", "raw_type")
    return named(rows, "dst").filter(~E.is_ignored(F.col("dst"))).select("project_id", "dst", "file_seq", "ref_seq")


def nodes(classes: DataFrame, found: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct nodes by name, the first one's attributes kept: a file's own class, then what it refers to. ``found`` are resolved
    references or the edges made of them: an edge keeps the first one, and a class that refers to itself comes before. Without KEY
    they are dealt into ``parts`` tasks here."""
    found = found if KEY in found.columns else keyed(found, parts, "dst")
    own = classes.filter(F.col("class_name").isNotNull() & ~E.is_blank(F.col("class_name"))).select("project_id", "class_name", "file_seq", F.lit(-1).cast("long").alias("ref_seq"), "package_name", "component_type")
    targets = found.select(KEY, "project_id", F.col("dst").alias("class_name"), "file_seq", "ref_seq", F.col("dst_package").alias("package_name"), F.col("dst_type").alias("component_type"))
    name, told = (KEY, "project_id", "class_name"), F.struct("file_seq", "ref_seq", "package_name", "component_type")
    a, b = (_first(rows, name, ("file_seq", "ref_seq")).select(*name, told.alias(side)) for rows, side in ((keyed(own, parts, "class_name"), "a"), (targets, "b")))
    return a.join(b, list(name), "full").select("project_id", "class_name", F.least("a", "b").alias("n")).select("project_id", "class_name", "n.*")


def outgoing(graph_edges: DataFrame, name: str) -> DataFrame:
    return graph_edges.filter(F.col("src") == name)


def incoming(graph_edges: DataFrame, name: str) -> DataFrame:
    return graph_edges.filter(F.col("dst") == name)


def node_named(graph_nodes: DataFrame, name: str) -> DataFrame:
    return graph_nodes.filter(F.col("class_name") == name)


def adjacency(graph_edges: DataFrame) -> DataFrame:
    """project_id, src and its targets in edge order, a target once for each kind of dependency. Edges with KEY (``edges_by_source``)
    are grouped where they are."""
    rows = F.sort_array(F.collect_list(F.struct("file_seq", "ref_seq", "dst")))
    by = [c for c in (KEY, "project_id", "src") if c in graph_edges.columns]
    return graph_edges.groupBy(*by).agg(F.transform(rows, lambda r: r["dst"]).alias("targets")).drop(KEY)


def components(graph_edges: DataFrame, graph_nodes: DataFrame | None = None) -> DataFrame:
    """Undirected connected components: project_id, class_name (NO_CLASS: files without one), label (least member). With
    nodes given, those without an edge are components of their own. Projects don't mix."""
    key = lambda c: F.coalesce(F.col(c), F.lit(NO_CLASS))
    links = graph_edges.select("project_id", key("src").alias("u"), key("dst").alias("v"))
    found = connected(links, by=("project_id",)).withColumnRenamed("id", "class_name")
    if graph_nodes is None:
        return found
    return graph_nodes.select("project_id", "class_name").join(found, ["project_id", "class_name"], "full").withColumn("label", F.coalesce("label", "class_name"))


def reachable(graph_nodes: DataFrame, graph_edges: DataFrame, role: str = "CONTROLLER") -> DataFrame:
    """What undirected paths reach from each node of a role, as a set: project_id, start, class_name (null: files without a class).
    It is the start's component; nothing is walked."""
    members = components(graph_edges, graph_nodes)
    starts = graph_nodes.filter(F.col("component_type") == role).select("project_id", F.col("class_name").alias("start"))
    labelled = starts.join(members.withColumnRenamed("class_name", "start"), ["project_id", "start"])
    return labelled.join(members, ["project_id", "label"]).select("project_id", "start", F.nullif(F.col("class_name"), F.lit(NO_CLASS)).alias("class_name"))


def _per_component(graph_nodes: DataFrame, graph_edges: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on the ordered nodes and edges of each undirected component of each project. A walk never leaves its component, so what
    a task holds is one component, not one project. Files without a class are the node NO_CLASS."""
    key = F.coalesce(F.col("src"), F.lit(NO_CLASS))
    labels = checkpoint(components(graph_edges, graph_nodes))
    n = graph_nodes.select("project_id", "class_name", "component_type", "file_seq", "ref_seq").join(labels, ["project_id", "class_name"])
    e = graph_edges.select("project_id", key.alias("src"), "dst", "file_seq", "ref_seq").join(labels.toDF("project_id", "src", "label"), ["project_id", "src"])
    e = e.toDF(*e.columns)  # columns of its own, as both sides have labels

    def both(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        return run(n.sort_values(["file_seq", "ref_seq"]), e.sort_values(["file_seq", "ref_seq"]))

    by = ("project_id", "label")
    return n.groupBy(*by).cogroup(e.groupBy(*by)).applyInPandas(both, schema)


def _depth_first(start: str, neighbours: dict[str, list[str]]) -> Iterator[str]:
    """Pre-order, neighbours in their order; a stack of iterators, so a chain of any length is fine."""
    seen = {start}
    yield start
    stack = [iter(neighbours.get(start, ()))]
    while stack:
        for name in stack[-1]:
            if name not in seen:
                seen.add(name)
                yield name
                stack.append(iter(neighbours.get(name, ())))
                break
        else:
            stack.pop()


def traversal(graph_nodes: DataFrame, graph_edges: DataFrame, role: str = "CONTROLLER") -> DataFrame:
    """From each node of a role, what undirected paths reach, in depth-first order: project_id, start_seq, start, member_seq,
    class_name (null: files without a class). The order is that of edges; as a set it is the start's component."""

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for a, b in zip(e["src"], e["dst"]):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        project = (n if len(n) else e)["project_id"].iloc[0]
        starts = n[n["component_type"] == role]["class_name"]
        rows = [(project, s, k, None if m == NO_CLASS else m) for s in starts for k, m in enumerate(_depth_first(s, near), 1)]
        return pd.DataFrame(rows, columns=["project_id", "start", "member_seq", "class_name"])

    # starts are numbered in a project, whatever component they lie in
    order = Window.partitionBy("project_id").orderBy("file_seq", "ref_seq")
    starts = graph_nodes.filter(F.col("component_type") == role).select("project_id", F.col("class_name").alias("start"), F.row_number().over(order).alias("start_seq"))
    walked = _per_component(graph_nodes, graph_edges, run, "project_id string, start string, member_seq int, class_name string")
    return walked.join(starts, ["project_id", "start"]).select("project_id", "start_seq", "start", "member_seq", "class_name")


def cycles(graph_nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """Directed cycles as a depth-first search in node order meets them: project_id, cycle_seq, path (its first node again at
    the end). A back edge that several kinds of dependency have counts once for each.

    Which cycles a search meets depends on where it enters, so components are walked whole; those without a strongly connected
    part have no cycle and aren't walked.
    """
    cyclic = checkpoint(strong_components(graph_edges).select("project_id", "class_name"))
    labels = checkpoint(components(graph_edges, graph_nodes))
    worth = checkpoint(labels.join(cyclic, ["project_id", "class_name"], "left_semi").select("project_id", "label").distinct())
    walked = labels.join(worth, ["project_id", "label"], "left_semi").select("project_id", "class_name")
    nodes_ = graph_nodes.join(walked, ["project_id", "class_name"], "left_semi")
    edges_ = graph_edges.filter(F.col("src").isNotNull()).join(walked.withColumnRenamed("class_name", "src"), ["project_id", "src"], "left_semi")

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for a, b in zip(e["src"], e["dst"]):
            near.setdefault(a, []).append(b)
        project = (n if len(n) else e)["project_id"].iloc[0]
        seen: set[str] = set()
        found: list[tuple] = []
        for start, file, ref in zip(n["class_name"], n["file_seq"], n["ref_seq"]):
            if start in seen:
                continue
            seen.add(start)
            path, place, stack = [start], {start: 0}, [iter(near.get(start, ()))]
            while stack:
                for name in stack[-1]:
                    if name not in seen:
                        seen.add(name)
                        place[name] = len(path)
                        path.append(name)
                        stack.append(iter(near.get(name, ())))
                        break
                    if name in place:
                        found.append((project, file, ref, len(found), [*path[place[name] :], name]))
                else:
                    stack.pop()
                    del place[path.pop()]
        return pd.DataFrame(found, columns=["project_id", "file_seq", "ref_seq", "k", "path"])

    met = _per_component(nodes_, edges_, run, "project_id string, file_seq long, ref_seq long, k int, path array<string>")
    order = Window.partitionBy("project_id").orderBy("file_seq", "ref_seq", "k")
    return met.select("project_id", F.row_number().over(order).alias("cycle_seq"), "path")


def _without_ends(edges: DataFrame) -> DataFrame:
    """Edges but for those of nodes that nothing leads to or that lead to nothing: they lie on no cycle. Repeated until none goes."""
    own, left = edges, edges.count()
    while left:
        sources, targets = own.select("project_id", F.col("u").alias("v")).distinct(), own.select("project_id", F.col("v").alias("u")).distinct()
        own = checkpoint(own.join(targets, ["project_id", "u"], "left_semi").join(sources, ["project_id", "v"], "left_semi").select(*edges.columns))
        now = own.count()
        if now == left:
            break
        left = now
    return own


def strong_components(graph_edges: DataFrame) -> DataFrame:
    """Classes on directed cycles, by strongly connected component: project_id, class_name, component (its greatest member).

    Forward and backward colouring: what lies on no cycle is trimmed; a node's colour is the greatest name that leads to it, spread
    along edges until nothing changes; what leads back to the name of its colour within the colour is a component; the rest
    goes round again. Each step is a join and an aggregate keyed by project and node. Files without a class and loops of one
    node (the graph has none) are left out.
    """
    edges = graph_edges.filter(F.col("src").isNotNull() & (F.col("src") != F.col("dst"))).select("project_id", F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    left, found = _without_ends(checkpoint(edges)), []
    while not left.isEmpty():
        nodes_ = left.select("project_id", F.col("u").alias("id")).union(left.select("project_id", F.col("v").alias("id"))).distinct()
        colours = checkpoint(nodes_.withColumn("colour", F.col("id")))
        while True:
            led = left.join(colours.withColumnRenamed("id", "u"), ["project_id", "u"]).groupBy("project_id", F.col("v").alias("id")).agg(F.max("colour").alias("more"))
            spread = colours.join(led, ["project_id", "id"], "left").select("project_id", "id", F.greatest("colour", "more").alias("colour"), (F.col("more") > F.col("colour")).alias("changed"))
            spread = checkpoint(spread)
            colours = spread.drop("changed")
            if spread.filter("changed").isEmpty():
                break
        ends = colours.withColumnsRenamed({"id": "u", "colour": "cu"}), colours.withColumnsRenamed({"id": "v", "colour": "cv"})
        inside = checkpoint(left.join(ends[0], ["project_id", "u"]).join(ends[1], ["project_id", "v"]).filter("cu = cv").select("project_id", "u", "v", F.col("cu").alias("colour")))
        reached = fresh = checkpoint(colours.filter("id = colour"))
        while not fresh.isEmpty():
            back = inside.join(fresh.withColumnRenamed("id", "v"), ["project_id", "v", "colour"]).select("project_id", F.col("u").alias("id"), "colour").distinct()
            fresh = checkpoint(back.join(reached, ["project_id", "id"], "left_anti"))
            reached = checkpoint(reached.union(fresh))
        found.append(reached)
        done = reached.select("project_id", "id")
        rest = left.join(done.withColumnRenamed("id", "u"), ["project_id", "u"], "left_anti").join(done.withColumnRenamed("id", "v"), ["project_id", "v"], "left_anti")
        left = _without_ends(checkpoint(rest.select("project_id", "u", "v")))
    if not found:
        return edges.select("project_id", F.col("u").alias("class_name"), F.col("u").alias("component")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    size = F.count(F.lit(1)).over(Window.partitionBy("project_id", "colour"))
    return every.withColumn("n", size).filter("n > 1").select("project_id", F.col("id").alias("class_name"), F.col("colour").alias("component"))
