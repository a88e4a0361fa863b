"""Two states of a code base: classes that came, went, moved, changed role or name, and violations that are new. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import analysis
from .graph import registry

CLASS = ("project_id", "class_name")


def _known(classes: DataFrame) -> DataFrame:
    return registry(classes.filter("class_name IS NOT NULL"))


def _surroundings(edges: DataFrame, only: DataFrame) -> DataFrame:
    """What each class of ``only`` is linked with: project_id, class_name, neighbour (direction, kind and name as one text)."""
    told = lambda way, name: F.concat_ws("|", F.lit(way), "dependency_type", name)
    out = edges.select("project_id", F.col("src").alias("class_name"), told("to", F.col("dst")).alias("neighbour"))
    into = edges.select("project_id", F.col("dst").alias("class_name"), told("from", F.coalesce("src", F.lit(""))).alias("neighbour"))
    return out.unionByName(into).join(only, list(CLASS), "left_semi").distinct()


def renamed(gone: DataFrame, came: DataFrame, edges_before: DataFrame, edges_after: DataFrame, percent: int = 50) -> DataFrame:
    """Pairs of a class that went and one that came (both project_id, class_name) that are each other's most similar: project_id,
    class_name, new_name, common, total. Similar is a Jaccard index of the surroundings of ``percent`` or more; of equal ones,
    the least name.

    Candidates are found by prefix filtering: with the neighbours of a class from the rarest to the commonest, a pair as similar
    as that shares one of the first n - ceil(n * percent / 100) + 1 of each, so common neighbours join nothing as long
    as a class has rarer ones; no pair is lost.
    """
    a, b = _surroundings(edges_before, gone), _surroundings(edges_after, came)
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    frequency = both.groupBy("project_id", "neighbour").agg(F.count(F.lit(1)).alias("often"))
    own = Window.partitionBy("project_id", "side", "class_name")
    ranked = both.join(frequency, ["project_id", "neighbour"]).withColumns({"n": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("often", "neighbour"))})
    prefix = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    side = lambda rows, s, name: rows.filter(F.col("side") == s).select("project_id", "neighbour", F.col("class_name").alias(name), F.col("n").alias(f"n_{name}"))
    fits = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    pairs = side(prefix, "a", "x").join(side(prefix, "b", "y"), ["project_id", "neighbour"]).filter(fits).select("project_id", "x", "y", "n_x", "n_y").distinct()
    whole = pairs.join(a.withColumnRenamed("class_name", "x"), ["project_id", "x"]).join(b.withColumnRenamed("class_name", "y"), ["project_id", "y", "neighbour"])
    shared = whole.groupBy("project_id", "x", "y", "n_x", "n_y").agg(F.count(F.lit(1)).alias("common"))
    scored = shared.withColumn("total", F.col("n_x") + F.col("n_y") - F.col("common")).filter(F.col("common") * 100 >= F.col("total") * percent)
    order = lambda me, other: F.row_number().over(Window.partitionBy("project_id", me).orderBy(F.desc(F.col("common") / F.col("total")), other))
    best = scored.withColumns({"of_x": order("x", "y"), "of_y": order("y", "x")}).filter("of_x = 1 AND of_y = 1")
    return best.select("project_id", F.col("x").alias("class_name"), F.col("y").alias("new_name"), "common", "total")


def changes(before: DataFrame, edges_before: DataFrame, after: DataFrame, edges_after: DataFrame, percent: int = 50) -> DataFrame:
    """What became of each class that isn't as it was: project_id, change, class_name, new_name, old_package, new_package, old_type,
    new_type. ``change`` is ADDED, REMOVED, RENAMED, MOVED (other package) or RETYPED (same package, other role). Classes are known by
    name within a project, of several with one name the last, as in the registry; files without a class are left out."""
    b = _known(before).select(*CLASS, F.col("package_name").alias("old_package"), F.col("component_type").alias("old_type"), F.lit(True).alias("was"))
    a = _known(after).select(*CLASS, F.col("package_name").alias("new_package"), F.col("component_type").alias("new_type"), F.lit(True).alias("is"))
    met = b.join(a, list(CLASS), "full")
    gone, came = met.filter("is IS NULL"), met.filter("was IS NULL")
    pairs = renamed(gone.select(*CLASS), came.select(*CLASS), edges_before, edges_after, percent)
    shown = ("project_id", "change", "class_name", "new_name", "old_package", "new_package", "old_type", "new_type")
    stays = met.filter("was AND is").withColumn("change", F.when(~F.col("old_package").eqNullSafe(F.col("new_package")), "MOVED").when(~F.col("old_type").eqNullSafe(F.col("new_type")), "RETYPED"))
    stays = stays.filter("change IS NOT NULL").withColumn("new_name", F.col("class_name"))
    new = came.select("project_id", F.col("class_name").alias("new_name"), "new_package", "new_type")
    old = gone.select(*CLASS, "old_package", "old_type").join(pairs.select(*CLASS, "new_name"), list(CLASS), "left")
    away = old.join(new, ["project_id", "new_name"], "left").withColumn("change", F.when(F.col("new_name").isNull(), "REMOVED").otherwise("RENAMED"))
    added = new.join(pairs.select("project_id", "new_name"), ["project_id", "new_name"], "left_anti")
    none = F.lit(None).cast("string")
    added = added.withColumns({"change": F.lit("ADDED"), "class_name": none, "old_package": none, "old_type": none})
    return stays.select(*shown).unionByName(away.select(*shown)).unionByName(added.select(*shown))


def new_violations(edges_before: DataFrame, edges_after: DataFrame, found: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Violations of layer rules that were none before: project_id, src, dst, dependency_type, message. ``found`` is what ``changes``
    gives: an edge of a renamed class is compared under its old name."""
    old_names = found.filter("change = 'RENAMED'").select("project_id", F.col("new_name").alias("now"), F.col("class_name").alias("then"))
    now = analysis.violations(edges_after, rules)
    for end in ("src", "dst"):
        now = now.join(old_names.select("project_id", F.col("now").alias(end), F.col("then").alias(f"old_{end}")), ["project_id", end], "left")
    then = analysis.violations(edges_before, rules).select("project_id", F.coalesce("src", F.lit("")).alias("s"), F.col("dst").alias("d"), F.col("dependency_type").alias("k")).distinct()
    keyed = now.withColumns({"s": F.coalesce("old_src", "src", F.lit("")), "d": F.coalesce("old_dst", "dst"), "k": F.col("dependency_type")})
    return keyed.join(then, ["project_id", "s", "d", "k"], "left_anti").select("project_id", "src", "dst", "dependency_type", "message")
