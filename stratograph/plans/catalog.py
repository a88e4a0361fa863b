"""Registered queries of the architecture engine, named by operator, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import fixed
from ..operators import analysis, assignment, comparison, graph, modules, render
from ..operators.lineage import checkpoint, dealt, written
from ..sources import archives, java
from . import codebase

FLAGSHIP = "arc2_violations"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- the same steps in the checking engine's SQL


def _case(rows, test: str, column: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(c=column, x=name)} THEN '{role}'" for name, role in rows) + " END"


_ROLES = {
    "by_annotation": _case(fixed.ANNOTATION_ROLES, "list_contains(string_split({c}, ','), '{x}')", "annotations"),
    "by_superclass": _case(fixed.SUPERCLASS_ROLES.items(), "{c} = '{x}'", "super_class"),
    "by_interface": _case(fixed.INTERFACE_ROLES, "list_contains(string_split({c}, ','), '{x}')", "interfaces"),
    "by_name": "CASE WHEN is_interface = 1 THEN (CASE WHEN class_name LIKE '%Repository' THEN 'REPOSITORY' END) ELSE " + _case(fixed.SUFFIX_ROLES, "{c} LIKE '%{x}'", "class_name") + " END",
    "by_package": _case(fixed.PACKAGE_ROLES.items(), "list_last(string_split(lower({c}), '.')) = '{x}'", "package_name"),
}
_NORMALIZED = """CASE WHEN raw_type IS NULL THEN '' WHEN contains(t, '? extends') THEN
  CASE WHEN strpos(t, '>') > 0 AND strpos(t, 'extends') + 8 <= strpos(t, '>') THEN trim(substr(t, strpos(t, 'extends') + 8, strpos(t, '>') - strpos(t, 'extends') - 8)) END
  WHEN contains(t, '<') AND contains(t, '>') THEN trim(list_last(string_split(regexp_extract(t, '<(.*)>', 1), ',')))
  ELSE list_last(string_split(t, '.')) END"""
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_IGNORED = f"(n IS NULL OR trim(n) = '' OR regexp_matches(n, '^[A-Z]$') OR n LIKE '%[]' OR n IN ({_LIST(fixed.PRIMITIVES + fixed.IGNORED_TYPES)}))"
_FOLDER = "coalesce(" + _case(fixed.ROLE_FOLDERS.items(), "{c} = '{x}'", "component_type") + ", 'COMMON')"
_FOLDER_NAME = _case(fixed.FOLDER_NAMES.items(), "{c} = '{x}'", "folder_type")
_RULES = "(VALUES " + ", ".join(f"({i}, '{a}', '{b}', {str(ok).lower()})" for i, (a, b, ok) in enumerate(fixed.LAYER_RULES, 1)) + ") r(rule_seq, source, target, allowed)"
_ORDINAL = _case([(n, i) for i, n in enumerate(fixed.COMPONENT_TYPES)], "{c} = '{x}'", "component_type").replace("THEN '", "THEN ").replace("' WHEN", " WHEN").replace("' END", " END")
_GRAPH = f"""
classes AS (SELECT *, CASE WHEN class_name IS NULL THEN 'UNKNOWN' ELSE coalesce({", ".join(_ROLES.values())}, 'UNKNOWN') END AS component_type FROM raw_classes),
""" + f"""
normalized AS (SELECT *, {_NORMALIZED} AS n FROM (SELECT *, trim(raw_type) AS t FROM refs)),
registry AS (SELECT project_id, class_name, max_by(package_name, file_seq) AS package_name, max_by(component_type, file_seq) AS component_type FROM classes GROUP BY ALL),
resolved AS (SELECT x.project_id, x.file_seq, x.ref_seq, x.ref_kind, c.class_name AS src, c.package_name AS src_package, c.component_type AS src_type, n AS dst,
  g.package_name AS dst_package, g.component_type AS dst_type
  FROM normalized x JOIN classes c ON x.project_id = c.project_id AND x.file_seq = c.file_seq LEFT JOIN registry g ON g.project_id = x.project_id AND g.class_name = n WHERE NOT {_IGNORED}),
edges AS (SELECT project_id, src, dst, ref_kind AS dependency_type, file_seq, ref_seq, src_package, src_type, dst_package, dst_type FROM resolved WHERE src IS DISTINCT FROM dst
  QUALIFY row_number() OVER (PARTITION BY project_id, src, dst, ref_kind ORDER BY file_seq, ref_seq) = 1),
nodes AS (SELECT * FROM (SELECT project_id, class_name, file_seq, -1 AS ref_seq, package_name, component_type FROM classes WHERE class_name IS NOT NULL
  UNION ALL SELECT project_id, dst, file_seq, ref_seq, dst_package, dst_type FROM resolved)
  QUALIFY row_number() OVER (PARTITION BY project_id, class_name ORDER BY file_seq, ref_seq) = 1)
"""
_SHOP = f"WITH sales AS ({codebase.duckdb_sql(codebase.SALES)}), raw_classes AS ({codebase.duckdb_sql(codebase.CLASSES)}), refs AS ({codebase.duckdb_sql(codebase.REFERENCES)}), {_GRAPH} "
_MODULES = _GRAPH.partition("FROM raw_classes),")[2] + """,
links AS (SELECT project_id, src AS a, dst AS b FROM edges UNION SELECT project_id, dst, src FROM edges),
reach AS (SELECT project_id, class_name AS start, class_name AS member FROM nodes UNION SELECT r.project_id, start, b FROM reach r JOIN links l ON member = a AND r.project_id = l.project_id),
labels AS (SELECT project_id, start AS class_name, min(member) AS label FROM reach GROUP BY 1, 2),
members AS (SELECT n.project_id, m.class_name AS module_name, n.class_name, n.component_type, n.package_name FROM nodes m JOIN reach r ON r.start = m.class_name AND r.project_id = m.project_id
  JOIN nodes n ON n.class_name = member AND n.project_id = r.project_id WHERE m.component_type = 'CONTROLLER'),
ends AS (SELECT project_id, min(string_split(package_name, '.')) AS a, max(string_split(package_name, '.')) AS b FROM members GROUP BY 1),
base AS (SELECT project_id, coalesce(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[1:i] = b[1:i]), lambda i: a[i]), '.'), '') AS base_package FROM ends)
"""
_SPARSE = f"WITH RECURSIVE classes AS ({codebase.duckdb_sql(codebase.SPARSE_CLASSES)}), refs AS ({codebase.duckdb_sql(codebase.SPARSE_REFERENCES)}), {_MODULES}"


Build = Callable[[DataFrame], DataFrame]


def _slices(spark: SparkSession, sf_dir: str) -> Iterator[tuple[int, bool, Callable[..., DataFrame], Callable[..., DataFrame]]]:
    """Of each slice of the projects: tasks, whether it is the only one, and what gives its classes and its references."""
    sold = None
    for part in codebase.slices(spark, sf_dir):
        sold = sold or codebase.sales(spark, sf_dir, part)
        of = {"sold": sold, "part": part}
        classes = lambda of=of, **how: codebase.classes(spark, sf_dir, **of, **how)
        refs = lambda of=of, **how: codebase.references(spark, sf_dir, placed=True, **of, **how)
        yield codebase.tasks(spark, sf_dir, part.of), part.of == 1, classes, refs


def _shops(spark: SparkSession, sf_dir: str, repeats: bool = False) -> Iterator[tuple[int, bool, DataFrame, DataFrame]]:
    """Tasks, whether it is the only one, classes and resolved references of each slice of the derived shop. Both are used more than once,
    so what they start from is written. With ``repeats`` references may come more than once, for edges, of which the first is kept
    anyway."""
    for parts, alone, classes, refs in _slices(spark, sf_dir):
        own = written(classes().select("project_id", "file_seq", "class_name", "package_name", "component_type"))
        yield parts, alone, own, graph.resolved(own, refs(repeats=repeats), parts, dealt(own, parts, *graph.PLACE))


def _shop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Classes and resolved references of a shop of one slice."""
    ((_, _, classes, found),) = _shops(spark, sf_dir)
    return classes, found


def _together(slices: Iterator[tuple[bool, DataFrame]]) -> DataFrame:
    """Rows of all slices: those of one are written before the next is begun, a lone one's are not."""
    return reduce(DataFrame.union, (df if alone else written(df) for alone, df in slices))


def _resolved(spark: SparkSession, sf_dir: str, then: Build) -> DataFrame:
    """What ``then`` makes of resolved references. Here and below it is given whole projects, but not all of them at once."""
    return _together((alone, then(found)) for _, alone, _, found in _shops(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str, then: Build = lambda edges: edges) -> DataFrame:
    return _together((alone, then(graph.edges(found))) for _, alone, _, found in _shops(spark, sf_dir, repeats=True))


def _edges_by_source(spark: SparkSession, sf_dir: str, then: Build) -> DataFrame:
    """Edges for queries that read nothing of targets but their names: classes are read once and no target is looked up."""
    found = lambda parts, classes, refs: graph.edges_by_source(graph.sourced(classes(placed=True), refs(repeats=True), parts, placed=True), parts)
    return _together((alone, then(found(parts, classes, refs))) for parts, alone, classes, refs in _slices(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes. All files that references stand in are classes (both come from the same sales), so their sources aren't looked up. As a node
    keeps the first reference to it, of references that are alike but for their file only the first is written out."""
    sold = codebase.first_sales(spark, sf_dir)
    classes, refs = codebase.classes(spark, sf_dir, sold), codebase.references(spark, sf_dir, sold, repeats=True)
    return graph.nodes_of(classes, graph.entering(refs), codebase.tasks(spark, sf_dir))


def _sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    classes, refs = codebase.sparse(spark, sf_dir)
    found = graph.resolved(classes, refs)
    return graph.nodes(classes, found), graph.edges(found)


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.discover(*_sparse(spark, sf_dir))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


# ---- roles of classes

_TOLD = {
    "cls1_annotation": (E.role_by_annotation, ["annotations"], "by_annotation"),
    "cls2_superclass": (E.role_by_superclass, ["super_class"], "by_superclass"),
    "cls3_interface": (E.role_by_interface, ["interfaces"], "by_interface"),
    "cls4_name_suffix": (E.role_by_name, ["class_name", "is_interface"], "by_name"),
    "cls5_package": (E.role_by_package, ["package_name"], "by_package"),
}
for _name, (_rule, _columns, _sql) in _TOLD.items():

    @query(_name, _SHOP + f"SELECT project_id, file_seq, {_ROLES[_sql]} AS role FROM classes WHERE class_name IS NOT NULL")
    def _by_rule(spark: SparkSession, sf_dir: str, rule=_rule, columns=_columns) -> DataFrame:
        rows = codebase.unclassified(spark, sf_dir).filter("class_name IS NOT NULL")
        return rows.select("project_id", "file_seq", rule(*map(F.col, columns)).alias("role"))


@query("cls0_component_type", _SHOP + "SELECT project_id, file_seq, class_name, component_type FROM classes")
def cls0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebase.classes(spark, sf_dir).select("project_id", "file_seq", "class_name", "component_type")


# ---- type references


@query("str1_normalize_type", _SHOP + "SELECT project_id, file_seq, ref_seq, raw_type, n AS normalized FROM normalized")
def str1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.named(codebase.references(spark, sf_dir), "normalized").select("project_id", "file_seq", "ref_seq", "raw_type", "normalized")


@query("flt1_ignored_types", _SHOP + f"SELECT project_id, n AS name, count(*) AS refs FROM normalized WHERE {_IGNORED} GROUP BY ALL")
def flt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = graph.named(codebase.references(spark, sf_dir), "name").select("project_id", "name")
    return named.filter(E.is_ignored(F.col("name"))).groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("refs"))


@query("flt2_primitives", _SHOP + f"SELECT project_id, file_seq, ref_seq, n AS name FROM normalized WHERE n IN ({_LIST(fixed.PRIMITIVES)})")
def flt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = graph.named(codebase.references(spark, sf_dir), "name").select("project_id", "file_seq", "ref_seq", "name")
    return named.filter(E.is_primitive(F.col("name")))


@query("flt3_stop_list", _SHOP + f"SELECT project_id, file_seq, ref_seq, n AS name FROM normalized WHERE n IN ({_LIST(fixed.IGNORED_TYPES)})")
def flt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = graph.named(codebase.references(spark, sf_dir), "name").select("project_id", "file_seq", "ref_seq", "name")
    return named.filter(E.is_stop_listed(F.col("name")))


@query("flt4_node_guard", _SHOP + "SELECT count(*) AS files, count(class_name) AS with_class FROM classes")
def flt4(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("class_name").isNotNull() & ~E.is_blank(F.col("class_name"))
    return codebase.classes(spark, sf_dir).agg(F.count(F.lit(1)).alias("files"), F.count_if(good).alias("with_class"))


@query("flt5_self_loops", _SHOP + "SELECT project_id, file_seq, src FROM resolved WHERE src = dst")
def flt5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, lambda found: found.filter(F.col("src").eqNullSafe(F.col("dst"))).select("project_id", "file_seq", "src"))


@query("q6_type_errors", _SHOP + "SELECT project_id, 'JavaParsing' AS kind, 400 AS http_status, 'cannot normalize type ' || raw_type AS message FROM normalized WHERE n IS NULL")
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_errors(codebase.references(spark, sf_dir))


# ---- the graph


@query("agg8_registry", _SHOP + "SELECT project_id, class_name, package_name, component_type FROM registry")
def agg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.registry(codebase.classes(spark, sf_dir), codebase.tasks(spark, sf_dir))


@query("lkp1_resolve", _SHOP + "SELECT project_id, file_seq, ref_seq, ref_kind, src, dst, dst_package, dst_type FROM resolved")
def lkp1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, lambda found: found.select("project_id", "file_seq", "ref_seq", "ref_kind", "src", "dst", "dst_package", "dst_type"))


@query("lkp2_internal_refs", _SHOP + "SELECT project_id, file_seq, ref_seq, n AS name FROM normalized x WHERE EXISTS (SELECT 1 FROM registry g WHERE g.project_id = x.project_id AND g.class_name = x.n)")
def lkp2(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = graph.named(codebase.references(spark, sf_dir), "name").select("project_id", "file_seq", "ref_seq", "name")
    known = graph.registry(codebase.classes(spark, sf_dir)).select("project_id", F.col("class_name").alias("name"))
    return named.join(known, ["project_id", "name"], "left_semi").select("project_id", "file_seq", "ref_seq", "name")


@query("set1_nodes", _SHOP + "SELECT project_id, class_name, package_name, component_type, file_seq, CAST(ref_seq AS BIGINT) AS ref_seq FROM nodes")
def set1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("project_id", "class_name", "package_name", "component_type", "file_seq", "ref_seq")


@query("set2_edges", _SHOP + "SELECT project_id, src, dst, dependency_type, file_seq, ref_seq, src_type, dst_type FROM edges")
def set2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, lambda edges: edges.select("project_id", "src", "dst", "dependency_type", "file_seq", "ref_seq", "src_type", "dst_type"))


@query("set3_module_members", _SPARSE + "SELECT DISTINCT project_id, module_name, class_name FROM members")
def set3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modules(spark, sf_dir).select("project_id", "module_name", "class_name").dropDuplicates()


@query("gb2_external_nodes", _SHOP + "SELECT project_id, class_name FROM nodes WHERE component_type IS NULL")
def gb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).filter("component_type IS NULL").select("project_id", "class_name")


@query("q1_no_class_edges", _SHOP + "SELECT project_id, dst, dependency_type FROM edges WHERE src IS NULL")
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, lambda edges: edges.filter("src IS NULL").select("project_id", "dst", "dependency_type"))


@query("jadj_adjacency", _SHOP + "SELECT project_id, src, string_agg(dst, ',' ORDER BY file_seq, ref_seq) AS targets FROM edges WHERE src IS NOT NULL GROUP BY ALL")
def jadj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges_by_source(spark, sf_dir, lambda edges: graph.adjacency(edges.filter("src IS NOT NULL")).select("project_id", "src", F.array_join("targets", ",").alias("targets")))


@query("agg5_graph_size", _SHOP + "SELECT project_id, count(*) AS n_nodes, (SELECT count(*) FROM edges e WHERE e.project_id = n.project_id) AS n_edges FROM nodes n GROUP BY project_id")
def agg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges are counted by target where they are, and only targets meet the classes."""
    size = lambda parts, classes, found: graph.sizes(classes, graph.by_target(graph.edges(found), n=F.count(F.lit(1))), parts)
    return _together((alone, size(parts, classes, found)) for parts, alone, classes, found in _shops(spark, sf_dir, repeats=True))


@query("dead3_outgoing", _SHOP + "SELECT project_id, src, dst, dependency_type FROM edges WHERE src = 'Customer1Controller'")
def dead3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, lambda edges: graph.outgoing(edges, "Customer1Controller").select("project_id", "src", "dst", "dependency_type"))


@query("dead4_incoming", _SHOP + "SELECT project_id, src, dst, dependency_type FROM edges WHERE dst = 'Nation3Dto'")
def dead4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, lambda edges: graph.incoming(edges, "Nation3Dto").select("project_id", "src", "dst", "dependency_type"))


@query("dead5_find_node", _SHOP + "SELECT project_id, class_name, package_name, component_type FROM nodes WHERE class_name = 'Supplier5Entity'")
def dead5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_named(_nodes(spark, sf_dir), "Supplier5Entity").select("project_id", "class_name", "package_name", "component_type")


@query("str3_edge_lines", _SHOP + "SELECT project_id, file_seq, ref_seq, coalesce(src, 'null') || ' --(' || dependency_type || ')--> ' || dst AS line FROM edges")
def str3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges_by_source(spark, sf_dir, lambda edges: edges.select("project_id", "file_seq", "ref_seq", E.edge_line(F.col("src"), F.col("dependency_type"), F.col("dst")).alias("line")))


@query("str4_node_lines", _SHOP + "SELECT project_id, class_name || ' (' || coalesce(component_type, 'null') || ')' AS line FROM nodes")
def str4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("project_id", E.node_line(F.col("class_name"), F.col("component_type")).alias("line"))


_LINES = "string_agg(coalesce(src, 'null') || ' --(' || dependency_type || ')--> ' || dst, chr(10) ORDER BY file_seq, ref_seq)"


@query("str5_graph_text", _SHOP + f"SELECT n.project_id, 'Dependency Graph' || chr(10) || 'Nodes : ' || n.c || chr(10) || 'Edges : ' || e.c || chr(10) || e.l AS report FROM (SELECT project_id, count(*) c FROM nodes GROUP BY 1) n JOIN (SELECT project_id, count(*) c, {_LINES} l FROM edges GROUP BY 1) e ON n.project_id = e.project_id")
def str5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines are made of is written, once; texts are put together of all slices."""
    every, sizes = [], []
    for parts, _, classes, found in _shops(spark, sf_dir, repeats=True):
        every.append(written(graph.edges(found).select("project_id", "src", "dst", "dependency_type", "file_seq", "ref_seq")))
        sizes.append(written(graph.sizes(classes, graph.by_target(every[-1], n=F.count(F.lit(1))), parts)))
    return render.sized_text(reduce(DataFrame.union, sizes), reduce(DataFrame.union, every), codebase.tasks(spark, sf_dir))


@query("dead1_plantuml", _SPARSE + "SELECT project_id, '@startuml' || chr(10) || chr(10) || string_agg(src || ' --> ' || dst, chr(10) ORDER BY file_seq, ref_seq) || chr(10) || chr(10) || '@enduml' AS plantuml FROM edges GROUP BY 1")
def dead1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.plantuml(_sparse(spark, sf_dir)[1])


# ---- analysis


@query("jrl_edge_verdicts", _SHOP + f"SELECT project_id, file_seq, ref_seq, coalesce(r.allowed, true) AS allowed FROM edges LEFT JOIN {_RULES} ON src_type = r.source AND dst_type = r.target WHERE src_type IS NOT NULL AND dst_type IS NOT NULL")
def jrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, lambda edges: analysis.edge_verdicts(edges).select("project_id", "file_seq", "ref_seq", "allowed"))


_VIOLATIONS = f"SELECT project_id, file_seq, ref_seq, src_type || ' ''' || coalesce(src, 'null') || ''' must not depend on ' || dst_type || ' ''' || dst || '''' AS message FROM edges JOIN {_RULES} ON src_type = r.source AND dst_type = r.target WHERE NOT r.allowed"


@query("arc2_violations", _SHOP + _VIOLATIONS)
def arc2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, lambda edges: analysis.violations(edges).select("project_id", "file_seq", "ref_seq", "message"))


@query("arc3_rules", _SHOP + f"SELECT r.rule_seq, r.source, r.target, r.allowed, count(e.dst) AS edges FROM {_RULES} LEFT JOIN edges e ON e.src_type = r.source AND e.dst_type = r.target GROUP BY ALL")
def arc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lambda edges: edges.groupBy(F.col("src_type").alias("source"), F.col("dst_type").alias("target")).agg(F.count(F.lit(1)).alias("edges"))
    counts = _edges(spark, sf_dir, counted).groupBy("source", "target").agg(F.sum("edges").alias("edges"))
    return analysis.layer_rules(spark).join(counts, ["source", "target"], "left").fillna(0, ["edges"]).select("rule_seq", "source", "target", "allowed", "edges")


#: Rules in order, with a repeated pair, a denial behind a permission, and wildcards.
_OWN_RULES = (("SERVICE", "REPOSITORY", False), ("SERVICE", "REPOSITORY", True), ("CONTROLLER", "REPOSITORY", True), ("CONTROLLER", "*", False), ("*", "DTO", True), ("REPOSITORY", "*", False))
_OWN_TABLE = "(VALUES " + ", ".join(f"({i}, '{a}', '{b}', {str(ok).lower()})" for i, (a, b, ok) in enumerate(_OWN_RULES, 1)) + ") r(rule_seq, source, target, allowed)"


@query("jrl2_ordered_rules", _SHOP + f"""SELECT project_id, file_seq, ref_seq, rule_seq, coalesce(allowed, true) AS allowed FROM (
  SELECT e.*, r.rule_seq, r.allowed, row_number() OVER (PARTITION BY e.project_id, e.src, e.dst, e.dependency_type ORDER BY r.rule_seq) AS k FROM edges e
  LEFT JOIN {_OWN_TABLE} ON r.source IN (e.src_type, '*') AND r.target IN (e.dst_type, '*') WHERE src_type IS NOT NULL AND dst_type IS NOT NULL) WHERE k = 1""")
def jrl2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An own table of rules: of those that fit an edge the first decides, once."""
    rules = analysis.layer_rules(spark, _OWN_RULES)
    return _edges(spark, sf_dir, lambda edges: analysis.edge_verdicts(edges, rules).select("project_id", "file_seq", "ref_seq", F.col("rule_seq").cast("int").alias("rule_seq"), "allowed"))


@query("agg1_component_summary", _SHOP + f"SELECT project_id, component_type, count(*) AS n, {_ORDINAL} AS ordinal FROM classes GROUP BY ALL")
def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.component_summary(codebase.classes(spark, sf_dir)).select("project_id", "component_type", "n", "ordinal")


_LAYERS = ", ".join(f"count(*) FILTER (component_type = '{t}') AS {t.lower()}" for t in fixed.COUNTED_LAYERS)


@query("agg2_layer_counts", _SHOP + f"SELECT project_id, {_LAYERS} FROM nodes GROUP BY project_id")
def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.layer_counts(_nodes(spark, sf_dir))


@query("arc1_architecture", _SHOP + f"SELECT n.*, e.dependencies, coalesce(v.violations, 0) AS violations FROM (SELECT project_id, {_LAYERS} FROM nodes GROUP BY project_id) n JOIN (SELECT project_id, count(*) AS dependencies FROM edges GROUP BY 1) e ON e.project_id = n.project_id LEFT JOIN (SELECT project_id, count(*) AS violations FROM ({_VIOLATIONS}) GROUP BY 1) v ON v.project_id = n.project_id")
def arc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges are counted by target where they are, and only the counts are written."""
    counted = lambda found: written(graph.by_target(analysis.denied(graph.edges(found)), n=F.count(F.lit(1)), denied=F.count_if("denied")))
    report = lambda parts, classes, targets: analysis.targets_report(graph.node_roles(classes, targets, parts), targets)
    return _together((alone, report(parts, classes, counted(found))) for parts, alone, classes, found in _shops(spark, sf_dir, repeats=True))


@query("snk2_summary_text", _SHOP + f"SELECT project_id, string_agg(rpad(component_type, 20, ' ') || ' : ' || n, chr(10) ORDER BY ordinal) AS report FROM (SELECT project_id, component_type, count(*) AS n, {_ORDINAL} AS ordinal FROM classes GROUP BY ALL) GROUP BY 1")
def snk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.summary_text(analysis.component_summary(codebase.classes(spark, sf_dir)))


_TITLED = "repeat('=', 47) || chr(10) || '{0}' || chr(10) || repeat('=', 47) || chr(10) || {1} || chr(10) || repeat('=', 47)"
_COUNTS = " || chr(10) || ".join(f"'{label:<17}: ' || {c}" for label, c in (*((render.LAYER_LABELS[t], t.lower()) for t in fixed.COUNTED_LAYERS), ("Dependencies", "dependencies")))
_DENIED = _COUNTS + " || chr(10) || chr(10) || 'Architecture Violations' || chr(10) || repeat('-', 47) || chr(10) || coalesce(l, 'No architecture violations detected.')"


@query("snk2_architecture_text", _SHOP + f"""SELECT n.project_id, {_TITLED.format("ARCHITECTURE REPORT", _DENIED)} AS report FROM (SELECT project_id, {_LAYERS} FROM nodes GROUP BY project_id) n
  JOIN (SELECT project_id, count(*) AS dependencies FROM edges GROUP BY 1) e ON e.project_id = n.project_id
  LEFT JOIN (SELECT project_id, string_agg(message, chr(10) ORDER BY file_seq, ref_seq) AS l FROM ({_VIOLATIONS}) GROUP BY 1) v ON v.project_id = n.project_id""")
def snk2_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of edges their places, targets and, if they are denied, messages are written, once; texts are put together of all slices."""
    reports, lines = [], []
    message = F.when(F.col("denied"), E.violation_message(*(F.col(c) for c in ("src_type", "src", "dst_type", "dst")))).alias("message")
    for parts, _, classes, found in _shops(spark, sf_dir, repeats=True):
        told = written(analysis.denied(graph.edges(found)).select("project_id", "dst", "file_seq", "ref_seq", message))
        targets = written(graph.by_target(told, n=F.count(F.lit(1)), denied=F.count("message")))
        reports.append(written(analysis.targets_report(graph.node_roles(classes, targets, parts), targets)))
        lines.append(told.filter("message IS NOT NULL"))
    return render.architecture_text(reduce(DataFrame.union, reports), reduce(DataFrame.union, lines), codebase.tasks(spark, sf_dir))


# ---- traversal, modules, mappings


@query("dead8_components", _SPARSE + "SELECT n.project_id, n.class_name, label FROM nodes n JOIN labels l ON l.class_name = n.class_name AND l.project_id = n.project_id")
def dead8(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _sparse(spark, sf_dir)
    return graph.components(e, n).select("project_id", "class_name", "label")


@query("grf1_reachability", _SPARSE + "SELECT DISTINCT project_id, module_name AS start, class_name FROM members")
def grf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(*_sparse(spark, sf_dir)).select("project_id", "start", "class_name")


_WALK = f"""WITH RECURSIVE classes AS ({codebase.duckdb_sql(codebase.SPARSE_CLASSES)}), refs AS ({codebase.duckdb_sql(codebase.CYCLE_REFERENCES)}), {_GRAPH.partition("FROM raw_classes),")[2]},
walk AS (SELECT project_id, src AS start, src AS here, [src] AS path, 0 AS closed FROM edges UNION ALL
  SELECT w.project_id, start, e.dst, list_append(path, e.dst), CASE WHEN e.dst = start THEN 1 ELSE 0 END FROM walk w JOIN edges e ON e.src = here AND e.project_id = w.project_id
  WHERE closed = 0 AND (e.dst = start OR NOT list_contains(path, e.dst))),
found AS (SELECT project_id, array_to_string(path, ' > ') AS cycle FROM walk WHERE closed = 1 AND start = list_aggregate(path, 'min')) """


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles (project_id, cycle_seq, path), each turned so that its least member comes first."""
    classes, _ = codebase.sparse(spark, sf_dir)
    found = graph.resolved(classes, codebase.derive(spark, sf_dir, codebase.CYCLE_REFERENCES))
    ring = graph.cycles(graph.nodes(classes, found), graph.edges(found)).withColumn("ring", F.slice("path", 1, F.size("path") - 1))
    at = F.array_position("ring", F.array_min("ring")).cast("int")
    turned = F.concat(F.slice("ring", at, F.size("ring")), F.slice("ring", F.lit(1), at - 1), F.array(F.array_min("ring")))
    return ring.select("project_id", "cycle_seq", turned.alias("path"))


@query("grf2_cycles", _WALK + "SELECT project_id, cycle FROM found")
def grf2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles, each turned so that its least member comes first."""
    return _turned(spark, sf_dir).select("project_id", F.array_join("path", " > ").alias("cycle"))


@query("agg9_cycle_count", _WALK + "SELECT project_id, count(*) AS cycles FROM found GROUP BY 1")
def agg9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grf2(spark, sf_dir).groupBy("project_id").agg(F.count(F.lit(1)).alias("cycles"))


_DENSE = f"""WITH RECURSIVE classes AS ({codebase.duckdb_sql(codebase.SPARSE_CLASSES)}), refs AS ({codebase.duckdb_sql(codebase.TANGLED_REFERENCES)}), {_GRAPH.partition("FROM raw_classes),")[2]},
reach AS (SELECT project_id, src AS a, dst AS b FROM edges UNION SELECT r.project_id, a, dst FROM reach r JOIN edges e ON e.project_id = r.project_id AND e.src = b) """


@query("scc_components", _DENSE + "SELECT x.project_id, x.a AS class_name, max(x.b) AS component FROM reach x JOIN reach y ON x.project_id = y.project_id AND x.a = y.b AND x.b = y.a GROUP BY 1, 2")
def scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes on cycles, by strongly connected component, of a graph with several ways on from a class, parallel edges, and a hub."""
    classes, _ = codebase.sparse(spark, sf_dir)
    found = graph.resolved(classes, codebase.derive(spark, sf_dir, codebase.TANGLED_REFERENCES))
    return graph.strong_components(graph.edges(found))


#: The sparse graph is a forest, so a depth-first walk is the order of paths: an edge's place decides which neighbour comes first.
_WALKED = _SPARSE.rstrip() + """,
ways AS (SELECT project_id, src AS a, dst AS b, [file_seq, ref_seq] AS way FROM edges UNION ALL SELECT project_id, dst, src, [file_seq, ref_seq] FROM edges),
starts AS (SELECT project_id, class_name AS start, row_number() OVER (PARTITION BY project_id ORDER BY file_seq, ref_seq) AS start_seq FROM nodes WHERE component_type = 'CONTROLLER'),
steps AS (SELECT project_id, start_seq, start, start AS here, '' AS back, CAST([] AS BIGINT[][]) AS path FROM starts
  UNION ALL SELECT s.project_id, start_seq, start, b, here, list_append(path, way) FROM steps s JOIN ways w ON w.project_id = s.project_id AND w.a = here AND b <> back),
walked AS (SELECT project_id, start_seq, start, row_number() OVER (PARTITION BY project_id, start ORDER BY path) AS member_seq, here AS class_name FROM steps),
ordered AS (SELECT DISTINCT w.project_id, start_seq AS module_seq, start AS module_name, member_seq, w.class_name, component_type, package_name FROM walked w JOIN nodes n ON n.project_id = w.project_id AND n.class_name = w.class_name)
"""


@query("grf1_depth_first", _WALKED + "SELECT project_id, CAST(start_seq AS INT) AS start_seq, start, CAST(member_seq AS INT) AS member_seq, class_name FROM walked")
def grf1_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traversal(*_sparse(spark, sf_dir))


@query("grf3_ordered_modules", _WALKED + "SELECT project_id, CAST(module_seq AS INT) AS module_seq, module_name, CAST(member_seq AS INT) AS member_seq, class_name, component_type, package_name FROM ordered")
def grf3_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.discover_ordered(*_sparse(spark, sf_dir)).select("project_id", "module_seq", "module_name", "member_seq", "class_name", "component_type", "package_name")


_ORDERED_MAPPED = f"""SELECT project_id, CAST(module_seq AS INT) AS module_seq, CAST(member_seq AS INT) AS member_seq, class_name, target_package
FROM (SELECT *, CASE WHEN base_package = '' THEN '' ELSE base_package || '.' END || lower(module_name) || '.' || {_FOLDER_NAME} AS target_package
  FROM (SELECT *, {_FOLDER} AS folder_type FROM ordered JOIN base USING (project_id)))"""


@query("map1_ordered_mappings", _WALKED + _ORDERED_MAPPED)
def map1_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = modules.mappings(checkpoint(modules.discover_ordered(*_sparse(spark, sf_dir))))
    return found.select("project_id", "module_seq", "member_seq", "class_name", "target_package")


@query("agg6_ordered_layout", _WALKED + f"SELECT project_id, module_name, {_FOLDER} AS folder_type, string_agg(class_name, ',' ORDER BY member_seq) AS classes FROM ordered GROUP BY ALL")
def agg6_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.layout(modules.discover_ordered(*_sparse(spark, sf_dir))).withColumn("classes", F.array_join("classes", ","))


_MODULE_LINES = "SELECT project_id, module_seq, module_name || chr(10) || string_agg('   - ' || class_name, chr(10) ORDER BY member_seq) || chr(10) AS b FROM ordered GROUP BY project_id, module_seq, module_name"
_LAYOUT_LINES = f"""SELECT project_id, module_seq, 'Module : ' || module_name || chr(10) || string_agg(l, chr(10) ORDER BY foremost) || chr(10) AS b FROM (
  SELECT project_id, module_seq, module_name, min(member_seq) AS foremost, '  ' || folder_type || chr(10) || string_agg('      - ' || class_name, chr(10) ORDER BY member_seq) AS l
  FROM (SELECT *, {_FOLDER} AS folder_type FROM ordered) GROUP BY project_id, module_seq, module_name, folder_type) GROUP BY project_id, module_seq, module_name"""
_BLOCKS = "string_agg(b, chr(10) ORDER BY module_seq)"


@query("snk2_modules_text", _WALKED + f"SELECT project_id, chr(10) || '========== DISCOVERED MODULES ==========' || chr(10) || {_BLOCKS} || chr(10) || repeat('=', 40) AS report FROM ({_MODULE_LINES}) GROUP BY 1")
def snk2_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.modules_text(modules.discover_ordered(*_sparse(spark, sf_dir)))


@query("snk2_layout_text", _WALKED + f"SELECT project_id, {_TITLED.format('MODULE LAYOUT', _BLOCKS)} AS report FROM ({_LAYOUT_LINES}) GROUP BY 1")
def snk2_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.layout_text(modules.discover_ordered(*_sparse(spark, sf_dir)))


_LABELS = " || chr(10) || ".join(f"'{label:<16}: ' || {c}" for label, c in render.MAPPING_LABELS.items())


@query("str9_mapping_text", _WALKED + f"""SELECT project_id, chr(10) || '========== TRANSFORMATION PLAN ==========' || chr(10) || string_agg(repeat('-', 40) || chr(10) || {_LABELS} || chr(10) || repeat('-', 40) || chr(10), chr(10) ORDER BY module_seq, member_seq)
  || chr(10) || repeat('=', 41) AS report FROM (SELECT *, package_name AS source_package, 'src/main/java/' || replace(target_package, '.', '/') || '/' || class_name || '.java' AS target_file
  FROM (SELECT *, CASE WHEN base_package = '' THEN '' ELSE base_package || '.' END || lower(module_name) || '.' || {_FOLDER_NAME} AS target_package FROM (SELECT *, {_FOLDER} AS folder_type FROM ordered JOIN base USING (project_id)))) GROUP BY 1""")
def str9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.mapping_text(modules.mappings(checkpoint(modules.discover_ordered(*_sparse(spark, sf_dir)))))


@query("snk2_cycles_text", _WALK + f""", listed AS (SELECT project_id, 'Cycle 1' || chr(10) || chr(10) || replace(any_value(cycle), ' > ', chr(10) || '   ↓' || chr(10)) || chr(10) AS l FROM found GROUP BY 1 HAVING count(*) = 1)
SELECT p.project_id, {_TITLED.format("CIRCULAR DEPENDENCY REPORT", "coalesce(l, 'No circular dependencies found.')")} AS report FROM (SELECT DISTINCT project_id FROM classes) p LEFT JOIN listed USING (project_id)
WHERE (SELECT count(*) FROM found f WHERE f.project_id = p.project_id) < 2""")
def snk2_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of projects with at most one cycle, turned so that its least member is first: the order of several is the search's own."""
    classes, _ = codebase.sparse(spark, sf_dir)
    found = checkpoint(_turned(spark, sf_dir))
    several = found.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return render.cycles_text(found, classes).join(several, "project_id", "left_anti")


@query("grf3_modules", _SPARSE + "SELECT DISTINCT * FROM members")
def grf3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modules(spark, sf_dir)


@query("agg7_module_counts", _SPARSE + "SELECT project_id, module_name, count(DISTINCT class_name) AS classes FROM members GROUP BY ALL")
def agg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.module_counts(_modules(spark, sf_dir))


@query("dead6_module_lookup", _SPARSE + "SELECT project_id, module_name, class_name FROM members WHERE module_name = 'Supplier10'")
def dead6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modules(spark, sf_dir).filter("module_name = 'Supplier10'").select("project_id", "module_name", "class_name")


@query("agg6_layout", _SPARSE + f"SELECT project_id, module_name, {_FOLDER} AS folder_type, string_agg(class_name, ',' ORDER BY class_name) AS classes FROM (SELECT DISTINCT * FROM members) GROUP BY ALL")
def agg6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.layout(_modules(spark, sf_dir)).withColumn("classes", F.array_join("classes", ","))


@query("agg3_base_package", _SPARSE + "SELECT project_id, base_package FROM base")
def agg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.base_package(_modules(spark, sf_dir))


@query("agg4_packages", _SPARSE + "SELECT DISTINCT project_id, package_name FROM members")
def agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modules(spark, sf_dir).filter(~E.is_blank(F.col("package_name"))).select("project_id", "package_name").distinct()


_MAPPED = f"""SELECT project_id, class_name, module_name, folder_type, package_name AS source_package, base_package, target_package,
  'src/main/java/' || replace(target_package, '.', '/') || '/' || class_name || '.java' AS target_file
FROM (SELECT *, CASE WHEN base_package = '' THEN '' ELSE base_package || '.' END || lower(module_name) || '.' || {_FOLDER_NAME} AS target_package
  FROM (SELECT *, {_FOLDER} AS folder_type FROM (SELECT DISTINCT * FROM members) JOIN base USING (project_id)))"""


@query("map1_mappings", _SPARSE + _MAPPED)
def map1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.mappings(_modules(spark, sf_dir))


@query("fol1_folders", _SHOP + f"SELECT component_type, {_FOLDER} AS folder_type, count(*) AS n FROM nodes GROUP BY ALL")
def fol1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir).select("component_type", E.folder_type(F.col("component_type")).alias("folder_type"))
    return rows.groupBy("component_type", "folder_type").agg(F.count(F.lit(1)).alias("n"))


_HEURISTIC = "class_name"
for _part in fixed.NAME_PARTS:
    _HEURISTIC = f"replace({_HEURISTIC}, '{_part}', '')"


@query("dead2_naming", _SHOP + f"SELECT project_id, file_seq, CASE WHEN class_name IS NULL OR trim({_HEURISTIC}) = '' THEN 'common' ELSE lower({_HEURISTIC}) END AS module FROM classes")
def dead2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebase.classes(spark, sf_dir).select("project_id", "file_seq", E.naming_heuristic(F.col("class_name")).alias("module"))


# ---- extensions: one module for each class, shared classes, two states of a code base


def _tangled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    classes, _ = codebase.sparse(spark, sf_dir)
    found = checkpoint(graph.resolved(classes, codebase.derive(spark, sf_dir, codebase.TANGLED_REFERENCES)))
    return graph.nodes(classes, found), graph.edges(found)


_COST = "CASE dependency_type " + " ".join(f"WHEN '{kind}' THEN {c}" for kind, c in assignment.STEP_COSTS.items()) + f" ELSE {assignment.OTHER_COST} END"
#: A path without a node twice has fewer steps than nodes; no step costs more than the dearest kind.
_NEAREST = _DENSE.rstrip() + f""",
ways AS (SELECT project_id, a, b, min(c) AS c FROM (SELECT project_id, src AS a, dst AS b, {_COST} AS c FROM edges UNION ALL SELECT project_id, dst, src, {_COST} FROM edges) GROUP BY 1, 2, 3),
sizes AS (SELECT project_id, {max(assignment.STEP_COSTS.values())} * count(*) AS most FROM nodes GROUP BY 1),
far AS (SELECT project_id, class_name AS start, file_seq, class_name AS here, 0 AS d FROM nodes WHERE component_type = 'CONTROLLER'
  UNION SELECT f.project_id, start, file_seq, b, d + c FROM far f JOIN ways w ON w.project_id = f.project_id AND w.a = here JOIN sizes s ON s.project_id = f.project_id WHERE d + c < most),
nearest AS (SELECT project_id, here AS class_name, start AS module_name, d AS distance FROM far QUALIFY row_number() OVER (PARTITION BY project_id, here ORDER BY d, file_seq) = 1),
owned AS (SELECT n.project_id, n.class_name, module_name, distance FROM nodes n LEFT JOIN nearest USING (project_id, class_name))
"""


@query("mod1_primary_module", _NEAREST + "SELECT project_id, class_name, module_name, CAST(distance AS BIGINT) AS distance FROM owned")
def mod1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.primary_modules(*_tangled(spark, sf_dir))


@query("mod2_cohesion", _NEAREST + """, placed AS (SELECT e.project_id, s.module_name AS f, d.module_name AS t FROM edges e LEFT JOIN owned s ON s.project_id = e.project_id AND s.class_name = e.src LEFT JOIN owned d ON d.project_id = e.project_id AND d.class_name = e.dst),
counted AS (SELECT m.project_id, m.module_name, m.classes, (SELECT count(*) FROM placed p WHERE p.project_id = m.project_id AND f = m.module_name AND t = m.module_name) AS internal,
  (SELECT count(*) FROM placed p WHERE p.project_id = m.project_id AND f = m.module_name AND t IS DISTINCT FROM m.module_name) AS outgoing,
  (SELECT count(*) FROM placed p WHERE p.project_id = m.project_id AND t = m.module_name AND f IS DISTINCT FROM m.module_name) AS incoming
  FROM (SELECT project_id, module_name, count(*) AS classes FROM owned WHERE module_name IS NOT NULL GROUP BY 1, 2) m)
SELECT *, internal / nullif(internal + outgoing + incoming, 0) AS cohesion, (outgoing + incoming) / nullif(internal + outgoing + incoming, 0) AS coupling FROM counted""")
def mod2(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _tangled(spark, sf_dir)
    return assignment.cohesion(checkpoint(assignment.primary_modules(nodes, edges)), edges)


#: The k-core by taking links away from a project's list until none goes.
_CORE = _DENSE.rstrip() + """,
linked AS (SELECT DISTINCT project_id, a, b FROM (SELECT project_id, src AS a, dst AS b FROM edges UNION ALL SELECT project_id, dst, src FROM edges)),
peel AS (SELECT project_id, list({'a': a, 'b': b}) AS es, -1 AS n FROM linked GROUP BY 1
  UNION ALL SELECT project_id, list_filter(es, lambda e: len(list_filter(es, lambda x: x.a = e.a)) >= 2 AND len(list_filter(es, lambda x: x.a = e.b)) >= 2), len(es) FROM peel WHERE n <> len(es)),
core AS (SELECT DISTINCT project_id, e.a AS class_name FROM (SELECT project_id, unnest(es) AS e FROM peel WHERE n = len(es))),
shared AS (SELECT project_id, dst AS class_name, count(DISTINCT src) AS dependents FROM edges e WHERE (project_id, dst) IN (SELECT (project_id, class_name) FROM core)
  AND (project_id, dst) NOT IN (SELECT (project_id, class_name) FROM nodes WHERE component_type = 'CONTROLLER') GROUP BY 1, 2 HAVING count(DISTINCT src) >= 4)
"""


@query("mod3_shared_classes", _CORE + "SELECT project_id, class_name, dependents FROM shared")
def mod3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.shared_classes(*_tangled(spark, sf_dir), k=2, dependents=4)


_KEPT = "(project_id, {0}) NOT IN (SELECT (project_id, class_name) FROM shared)"


@query("mod4_modules_without_shared", _CORE.rstrip() + f""",
everywhere AS (SELECT project_id, class_name AS s, class_name AS m FROM nodes UNION SELECT r.project_id, s, b FROM everywhere r JOIN linked l ON l.project_id = r.project_id AND l.a = m),
rest AS (SELECT project_id, class_name AS s, class_name AS m FROM nodes WHERE {_KEPT.format("class_name")}
  UNION SELECT r.project_id, s, b FROM rest r JOIN (SELECT * FROM linked WHERE {_KEPT.format("a")} AND {_KEPT.format("b")}) l ON l.project_id = r.project_id AND l.a = m)
SELECT project_id, class_name AS module_name, (SELECT count(*) FROM everywhere e WHERE e.project_id = n.project_id AND e.s = n.class_name) AS classes_before,
  (SELECT count(*) FROM rest e WHERE e.project_id = n.project_id AND e.s = n.class_name) AS classes_after,
  (SELECT count(DISTINCT x.dst) FROM rest r JOIN edges x ON x.project_id = r.project_id AND x.src = r.m JOIN shared h ON h.project_id = x.project_id AND h.class_name = x.dst WHERE r.project_id = n.project_id AND r.s = n.class_name) AS shared
FROM nodes n WHERE component_type = 'CONTROLLER'""")
def mod4(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _tangled(spark, sf_dir)
    return assignment.modules_without(nodes, edges, assignment.shared_classes(nodes, edges, k=2, dependents=4))


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Classes and edges of a code base, and of the same some time later."""
    out = []
    for classes, refs in ((codebase.SPARSE_CLASSES, codebase.EARLIER_REFERENCES), (codebase.LATER_CLASSES, codebase.LATER_REFERENCES)):
        own = checkpoint(codebase.derive(spark, sf_dir, classes))
        out += [own, checkpoint(graph.edges(graph.resolved(own, codebase.derive(spark, sf_dir, refs))))]
    return tuple(out)


def _state_sql(classes: str, refs: str, suffix: str) -> str:
    """Tables of one state as nested queries named with a suffix."""
    body = f"WITH classes AS ({codebase.duckdb_sql(classes)}), refs AS ({codebase.duckdb_sql(refs)}), {_GRAPH.partition('FROM raw_classes),')[2]}"
    return f"edges_{suffix} AS ({body} SELECT * FROM edges), classes_{suffix} AS ({body} SELECT * FROM registry WHERE class_name IS NOT NULL)"


_DIFF = f"""WITH {_state_sql(codebase.SPARSE_CLASSES, codebase.EARLIER_REFERENCES, "b")}, {_state_sql(codebase.LATER_CLASSES, codebase.LATER_REFERENCES, "a")},
gone AS (SELECT * FROM classes_b WHERE (project_id, class_name) NOT IN (SELECT (project_id, class_name) FROM classes_a)), came AS (SELECT * FROM classes_a WHERE (project_id, class_name) NOT IN (SELECT (project_id, class_name) FROM classes_b)),
""" + ", ".join(
    f"near_{x} AS (SELECT c.project_id, c.class_name, list_distinct(list(w)) AS w FROM {t} c JOIN (SELECT project_id, src AS class_name, 'to|' || dependency_type || '|' || dst AS w FROM edges_{x} UNION ALL SELECT project_id, dst, 'from|' || dependency_type || '|' || src FROM edges_{x}) USING (project_id, class_name) GROUP BY 1, 2)"
    for x, t in (("b", "gone"), ("a", "came"))
) + """,
scored AS (SELECT *, n + 0.0 AS k, m - n AS total FROM (SELECT b.project_id, b.class_name AS x, a.class_name AS y, len(list_intersect(b.w, a.w)) AS n, len(b.w) + len(a.w) AS m FROM near_b b JOIN near_a a USING (project_id)) WHERE n * 100 >= (m - n) * 50 AND n > 0),
pairs AS (SELECT project_id, x, y FROM scored QUALIFY row_number() OVER (PARTITION BY project_id, x ORDER BY n / total DESC, y) = 1 AND row_number() OVER (PARTITION BY project_id, y ORDER BY n / total DESC, x) = 1)
"""


@query("cmp1_changes", _DIFF + """SELECT project_id, CASE WHEN b.package_name IS DISTINCT FROM a.package_name THEN 'MOVED' ELSE 'RETYPED' END AS change, class_name, class_name AS new_name, b.package_name AS old_package, a.package_name AS new_package,
  b.component_type AS old_type, a.component_type AS new_type FROM classes_b b JOIN classes_a a USING (project_id, class_name) WHERE b.package_name IS DISTINCT FROM a.package_name OR b.component_type IS DISTINCT FROM a.component_type
UNION ALL SELECT g.project_id, CASE WHEN y IS NULL THEN 'REMOVED' ELSE 'RENAMED' END, g.class_name, y, g.package_name, c.package_name, g.component_type, c.component_type
  FROM gone g LEFT JOIN pairs p ON p.project_id = g.project_id AND p.x = g.class_name LEFT JOIN came c ON c.project_id = g.project_id AND c.class_name = y
UNION ALL SELECT c.project_id, 'ADDED', NULL, c.class_name, NULL, c.package_name, NULL, c.component_type FROM came c LEFT JOIN pairs p ON p.project_id = c.project_id AND p.y = c.class_name WHERE p.y IS NULL""")
def cmp1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.changes(*_states(spark, sf_dir))


#: Rules for the comparison of states, in which services may not use the rarer roles.
_STATE_RULES = (("SERVICE", "CONTROLLER", False), ("SERVICE", "REPOSITORY", False), ("CONTROLLER", "REPOSITORY", False), ("*", "*", True))
_STATE_DENIED = "SELECT project_id, src, dst, dependency_type, src_type || ' ''' || src || ''' must not depend on ' || dst_type || ' ''' || dst || '''' AS message FROM edges_{0} WHERE (src_type = 'SERVICE' AND dst_type IN ('CONTROLLER', 'REPOSITORY')) OR (src_type = 'CONTROLLER' AND dst_type = 'REPOSITORY')"


@query("cmp2_new_violations", _DIFF + f"""SELECT n.project_id, src, dst, dependency_type, message FROM ({_STATE_DENIED.format("a")}) n LEFT JOIN pairs s ON s.project_id = n.project_id AND s.y = src LEFT JOIN pairs d ON d.project_id = n.project_id AND d.y = dst
WHERE NOT EXISTS (SELECT 1 FROM ({_STATE_DENIED.format("b")}) o WHERE o.project_id = n.project_id AND o.src = coalesce(s.x, n.src) AND o.dst = coalesce(d.x, n.dst) AND o.dependency_type = n.dependency_type)""")
def cmp2(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, edges_before, after, edges_after = _states(spark, sf_dir)
    found = checkpoint(comparison.changes(before, edges_before, after, edges_after))
    return comparison.new_violations(edges_before, edges_after, found, analysis.layer_rules(spark, _STATE_RULES))


# ---- archives and Java sources

_SUPPLIER_ARCHIVE = "'nation' || s_nationkey || '-' || (s_suppkey // 400) || '.zip'"
_SUPPLIER_PROJECT = f"'PROJECT-' || upper(substr(sha256('/in/' || {_SUPPLIER_ARCHIVE}), 1, 32))"
_ARCHIVE = "CASE o_orderkey % 7 WHEN 0 THEN 'a.ZIP' WHEN 1 THEN 'b.tar' WHEN 2 THEN '  ' ELSE 'p' || CAST(o_orderkey AS STRING) || '.zip' END"
_SIZE = "CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 524288001 ELSE 1000 + o_orderkey END"


@query("src2_archive_checks", f"SELECT o_orderkey, CASE WHEN s = 0 THEN 'File is empty' WHEN trim(a) = '' THEN 'File name is missing' WHEN NOT lower(trim(a)) LIKE '%.zip' THEN 'Only ZIP files are supported' WHEN s > 524288000 THEN 'File is larger than 500 MB' END AS reject_reason FROM (SELECT o_orderkey, {_ARCHIVE} AS a, {_SIZE} AS s FROM orders)")
def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = codebase.tables(spark, sf_dir)["orders"].select("o_orderkey", F.expr(_ARCHIVE).alias("a"), F.expr(_SIZE).alias("s"))
    return named.select("o_orderkey", archives.reject_reason(F.col("a"), F.col("s")).alias("reject_reason"))


@query("src10_project_ids", f"SELECT DISTINCT s_nationkey, {_SUPPLIER_PROJECT} AS project_id FROM supplier")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebase.tables(spark, sf_dir)["supplier"].select("s_nationkey", archives.project_id(codebase.archive_path()).alias("project_id")).distinct()


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the derived archives, written once: roots and sources both start from them."""
    return checkpoint(archives.explode_entries(archives.admitted(codebase.java_archives(spark, sf_dir))))


@query("src6_zip_entries", f"SELECT {_SUPPLIER_PROJECT} AS project_id, 'app/src/main/java/com/mart/n' || s_nationkey || '/Supplier' || s_suppkey || '.java' AS path FROM supplier UNION ALL SELECT DISTINCT {_SUPPLIER_PROJECT}, p FROM supplier, (VALUES ('app/pom.xml'), ('app/sub/pom.xml'), ('app/src/test/java/ATest.java')) v(p)")
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("project_id", "path")


@query("src7_project_roots", f"SELECT DISTINCT {_SUPPLIER_PROJECT} AS project_id, 'app' AS root FROM supplier")
def src7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.project_roots(_entries(spark, sf_dir))


_FILES = f"SELECT {_SUPPLIER_PROJECT} AS project_id, row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 400 ORDER BY lower('Supplier' || s_suppkey || '.java')) AS file_seq, * FROM supplier"


@query("src8_java_sources", f"SELECT project_id, file_seq, 'app/src/main/java/com/mart/n' || s_nationkey || '/Supplier' || s_suppkey || '.java' AS path FROM ({_FILES})")
def src8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.java_sources(_entries(spark, sf_dir)).select("project_id", "file_seq", "path")


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.parsed(java.extract(archives.java_sources(_entries(spark, sf_dir))))


@query("prj_class_metadata", f"SELECT project_id, file_seq, 'Supplier' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN 'Controller' ELSE '' END AS class_name, 'com.mart.n' || s_nationkey AS package_name, false AS is_interface, 'Base' AS super_class, 'Named' AS interfaces, CASE WHEN s_suppkey % 5 = 0 THEN 'Slf4j' WHEN s_suppkey % 2 = 0 THEN 'Service' ELSE 'Component' END AS annotations, 'run' AS methods, 'java.util,com.mart.n' || s_nationkey || '.Nation' || s_nationkey AS imports, 'private List<Nation' || s_nationkey || '> nations, more[];' AS fields FROM ({_FILES})")
def prj(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = [F.array_join(c, ",").alias(c) for c in ("interfaces", "annotations", "methods", "imports", "fields")]
    return _extracted(spark, sf_dir).select("project_id", "file_seq", "class_name", "package_name", "is_interface", "super_class", *joined)


_WRITTEN = f"""SELECT project_id, file_seq, unnest(range(0, 6)) AS ref_seq, unnest(['FIELD', 'FIELD', 'FIELD', 'CONSTRUCTOR', 'CONSTRUCTOR', 'METHOD_PARAMETER']) AS ref_kind,
  unnest(['List<Nation' || s_nationkey || '>', 'List<Nation' || s_nationkey || '>[]', 'Extra' || (s_suppkey % 7), 'Map<String, Region' || s_nationkey || '>', 'int', 'Order' || s_suppkey]) AS raw_type FROM ({_FILES})"""


@query("ext_type_references", _WRITTEN)
def ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_references(_extracted(spark, sf_dir))


@query("ext2_more_kinds", f"""SELECT project_id, file_seq, unnest(range(0, 12)) AS ref_seq, unnest(['FIELD', 'FIELD', 'FIELD', 'CONSTRUCTOR', 'CONSTRUCTOR', 'METHOD_PARAMETER', 'INHERITANCE', 'IMPLEMENTATION', 'GENERIC', 'GENERIC', 'GENERIC', 'GENERIC']) AS ref_kind,
  unnest(['List<Nation' || s_nationkey || '>', 'List<Nation' || s_nationkey || '>[]', 'Extra' || (s_suppkey % 7), 'Map<String, Region' || s_nationkey || '>', 'int', 'Order' || s_suppkey, 'Base', 'Named', 'Nation' || s_nationkey, 'Nation' || s_nationkey, 'String', 'Region' || s_nationkey]) AS raw_type FROM ({_FILES})""")
def ext2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three kinds of references and, as an extension, superclasses, interfaces and type arguments."""
    return graph.type_references(_extracted(spark, sf_dir), graph.more_extractors())


@query("ext3_dependency_weights", _SHOP + "SELECT project_id, src, dst, string_agg(DISTINCT ref_kind, ',' ORDER BY ref_kind) AS kinds, count(*) AS refs, CAST(sum(CASE ref_kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in graph.WEIGHTS.items()) + " ELSE 1 END) AS BIGINT) AS weight FROM resolved WHERE src IS DISTINCT FROM dst GROUP BY 1, 2, 3")
def ext3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, lambda found: graph.dependency_weights(found).withColumn("kinds", F.array_join("kinds", ",")))


@query("map3_archives_to_mappings", f"""WITH RECURSIVE classes AS (SELECT project_id, file_seq, 'Supplier' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN 'Controller' ELSE '' END AS class_name,
  'com.mart.n' || s_nationkey AS package_name, CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'CONTROLLER' ELSE 'UNKNOWN' END WHEN s_suppkey % 2 = 0 THEN 'SERVICE' ELSE 'COMPONENT' END AS component_type
  FROM ({_FILES})), refs AS ({_WRITTEN}), {_MODULES} {_MAPPED}""")
def map3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All the way from archives to mappings. What is used more than once is written once: an archive is opened once, a file
    read once."""
    classes = checkpoint(analysis.classify(_extracted(spark, sf_dir)))
    found = checkpoint(graph.resolved(classes, graph.type_references(classes)))
    return modules.mappings(checkpoint(modules.discover(graph.nodes(classes, found), graph.edges(found))))


@query("snk1_responses", f"SELECT project_id, '{{\"success\":true,\"message\":\"Project uploaded successfully.\",\"data\":{{\"projectId\":\"' || substr(project_id, 1, 16) || '\",\"projectName\":\"' || archive || '\",\"fileSize\":' || 1000 || ',\"status\":\"UPLOADED\"}}}}' AS response FROM (SELECT DISTINCT {_SUPPLIER_ARCHIVE} AS archive, {_SUPPLIER_PROJECT} AS project_id FROM supplier)")
def snk1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codebase.tables(spark, sf_dir)["supplier"].select(codebase.archive_path().alias("path"), F.lit(1000).cast("long").alias("length")).distinct()
    return render.upload_response(archives.admitted(found).withColumnRenamed("length", "file_size"))


#: What each fault of a damaged archive is reported as.
_FAULTS = """(VALUES (1, ['InvalidZip', 'InvalidProjectStructure'], [400, 400], ['Invalid or corrupted ZIP file: File is not a zip file', 'No pom.xml found']), (2, ['InvalidProjectStructure'], [400], ['No pom.xml found']),
  (3, ['SourceCodeNotFound'], [400], ['No Java source under src/main/java']), (4, ['ProjectExtraction', 'JavaParsing'], [500, 400], ['Entry leaves the archive: ../evil.java', 'app/src/main/java/Broken.java: unclosed ('])) f(fault, kinds, codes, messages)"""


@query("snk3_errors", f"SELECT 'PROJECT-' || upper(substr(sha256(CAST(o_orderkey AS STRING) || '/' || a), 1, 32)) AS project_id, 'InvalidZip' AS kind, 400 AS http_status, CASE WHEN s = 0 THEN 'File is empty' WHEN trim(a) = '' THEN 'File name is missing' WHEN NOT lower(trim(a)) LIKE '%.zip' THEN 'Only ZIP files are supported' ELSE 'File is larger than 500 MB' END AS message FROM (SELECT o_orderkey, {_ARCHIVE} AS a, {_SIZE} AS s FROM orders) WHERE s = 0 OR trim(a) = '' OR NOT lower(trim(a)) LIKE '%.zip' OR s > 524288000 UNION ALL SELECT DISTINCT {_SUPPLIER_PROJECT}, unnest(kinds), unnest(codes), unnest(messages) FROM supplier JOIN {_FAULTS} ON fault = s_nationkey % 5")
def snk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), F.expr(_ARCHIVE))
    found = codebase.tables(spark, sf_dir)["orders"].select(path.alias("path"), F.expr(_SIZE).alias("length"), F.lit(None).cast("binary").alias("content"))
    refused = archives.errors(archives.admitted(found).filter("reject_reason IS NOT NULL"), archives.explode_entries(archives.admitted(found.limit(0))))
    admitted = archives.admitted(codebase.java_archives(spark, sf_dir, damaged=True))
    entries = checkpoint(archives.explode_entries(admitted))
    extracted = java.extract(archives.java_sources(entries.filter("error IS NULL")))
    return refused.union(archives.errors(admitted, entries, extracted))
