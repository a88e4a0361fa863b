"""Reports on the architecture: roles, layers, violations of layer rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import fixed
from . import graph


def classify(classes: DataFrame) -> DataFrame:
    """Add component_type to extracted classes."""
    role = E.component_type(*(F.col(c) for c in ("class_name", "is_interface", "annotations", "super_class", "interfaces", "package_name")))
    return classes.withColumn("component_type", role)


#: In a rule, stands for any role.
ANY = "*"
RULES_SCHEMA = "rule_seq int, source string, target string, allowed boolean"


def layer_rules(spark: SparkSession, rules: Sequence[tuple[str, str, bool]] = fixed.LAYER_RULES) -> DataFrame:
    """A rule table in order: rule_seq, source, target, allowed. Without ``rules``, the 14 of the model."""
    return spark.createDataFrame([(i, *rule) for i, rule in enumerate(rules, 1)], RULES_SCHEMA)


def decisions(rules: DataFrame) -> DataFrame:
    """What ordered rules say of each pair of roles: source, target, rule_seq, allowed. The first rule of a pair decides, so a later one
    says nothing; a role may be ``ANY``. At most a row for each two roles, however many rules there are."""
    roles = F.array(*map(F.lit, fixed.COMPONENT_TYPES))
    opened = lambda c: F.explode(F.when(F.col(c) == ANY, roles).otherwise(F.array(c)))
    pairs = rules.withColumn("source", opened("source")).withColumn("target", opened("target"))
    first = F.min(F.struct("rule_seq", "allowed")).alias("r")
    return pairs.groupBy("source", "target").agg(first).select("source", "target", "r.*")


def component_summary(classes: DataFrame) -> DataFrame:
    """Files by role (files without a class too), with the role's place in reports."""
    place = F.create_map(*(F.lit(x) for i, name in enumerate(fixed.COMPONENT_TYPES) for x in (name, i)))
    counted = classes.groupBy("project_id", "component_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("ordinal", place[F.col("component_type")])


def layer_counts(nodes: DataFrame) -> DataFrame:
    """A row per project: nodes of each counted layer."""
    return nodes.groupBy("project_id").agg(*(F.count_if(F.col("component_type") == t).alias(t.lower()) for t in fixed.COUNTED_LAYERS))


def _decided(edges: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Decisions under the names of edges. A pair of roles has one, so a join with them repeats no edge. The table is sent to all
    executors: it has at most the square of the number of roles."""
    found = decisions(layer_rules(edges.sparkSession) if rules is None else rules).filter(F.col("source").isin(*fixed.COMPONENT_TYPES) & F.col("target").isin(*fixed.COMPONENT_TYPES))
    return F.broadcast(found.select(F.col("source").alias("src_type"), F.col("target").alias("dst_type"), "rule_seq", "allowed"))


def edge_verdicts(edges: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Edges between typed classes with the verdict of the first layer rule of their roles (rule_seq, allowed); pairs without a rule
    are allowed. ``rules`` is an ordered rule table as ``layer_rules`` gives it."""
    typed = edges.filter(F.col("src_type").isNotNull() & F.col("dst_type").isNotNull())
    return typed.join(_decided(edges, rules), ["src_type", "dst_type"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def denied(edges: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """All edges, with ``denied``: whether the first layer rule of their roles denies them, as ``violations`` has it."""
    told = edges.join(_decided(edges, rules).drop("rule_seq"), ["src_type", "dst_type"], "left")
    return told.withColumn("denied", ~F.coalesce("allowed", F.lit(True))).drop("allowed")


def violations(edges: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """A message for each edge that its first rule denies; two kinds of dependency between two classes make two. Since pairs without a
    rule are allowed, an inner join with the denials is enough."""
    message = E.violation_message(*(F.col(c) for c in ("src_type", "src", "dst_type", "dst")))
    denied = edges.join(_decided(edges, rules).filter(~F.col("allowed")), ["src_type", "dst_type"])
    return denied.select("project_id", "file_seq", "ref_seq", "src", "dst", "dependency_type", message.alias("message"))


def architecture_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per project: layer counts, number of dependencies, number of violations."""
    return targets_report(nodes, graph.by_target(denied(edges), n=F.count(F.lit(1)), denied=F.count_if("denied")))


def targets_report(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``architecture_report``, of edges counted by target: n, denied."""
    counts = targets.groupBy("project_id").agg(F.sum("n").alias("dependencies"), F.sum("denied").alias("violations"))
    return layer_counts(nodes).join(counts, "project_id", "left").fillna(0, ["dependencies", "violations"])
