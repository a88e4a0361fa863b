"""Primary modules, cohesion, shared classes, comparison of states and more kinds of dependency, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratograph.operators import assignment, comparison, graph

NODES = "project_id string, class_name string, package_name string, component_type string, file_seq long, ref_seq long"
EDGES = "project_id string, src string, dst string, dependency_type string, file_seq long, ref_seq long, src_package string, src_type string, dst_package string, dst_type string"


def drawn(spark, seed, n=14, m=22):
    draw = random.Random(seed)
    names = [f"C{i:02}" for i in range(n)]
    roles = {c: "CONTROLLER" if i % 5 == 0 else "SERVICE" for i, c in enumerate(names)}
    links = sorted({(a, b, draw.choice(["FIELD", "CONSTRUCTOR", "METHOD_PARAMETER", "ELSE"])) for a, b in (draw.sample(names, 2) for _ in range(m))})
    nodes = spark.createDataFrame([("p", c, "x", roles[c], i, -1) for i, c in enumerate(names)], NODES)
    edges = spark.createDataFrame([("p", *e, i, 0, "x", roles[e[0]], "x", roles[e[1]]) for i, e in enumerate(links)], EDGES)
    return names, roles, links, nodes, edges


def nearest(names, roles, links):
    """Bellman and Ford by force."""
    cost = lambda k: assignment.STEP_COSTS.get(k, assignment.OTHER_COST)
    best = {c: (0, names.index(c), c) for c in names if roles[c] == "CONTROLLER"}
    for _ in range(3 * len(names)):
        for a, b, k in links:
            for x, y in ((a, b), (b, a)):
                if x in best:
                    d, i, s = best[x]
                    best[y] = min(best.get(y, (10**9,)), (d + cost(k), i, s))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_primary_modules_and_cohesion(spark, seed):
    names, roles, links, nodes, edges = drawn(spark, seed)
    want = nearest(names, roles, links)
    primary = assignment.primary_modules(nodes, edges)
    rows = primary.collect()
    assert {r["class_name"]: (r["module_name"], r["distance"]) for r in rows} == {c: (want[c][2], want[c][0]) if c in want else (None, None) for c in names}
    of = {c: want[c][2] for c in want}
    counts = {m: Counter() for m in of.values()}
    for a, b, _ in links:
        if of.get(a) is not None and of.get(a) == of.get(b):
            counts[of[a]]["internal"] += 1
        else:
            if a in of:
                counts[of[a]]["outgoing"] += 1
            if b in of:
                counts[of[b]]["incoming"] += 1
    for r in assignment.cohesion(primary, edges).collect():
        c = counts.pop(r["module_name"])
        every = sum(c.values())
        assert (r["internal"], r["outgoing"], r["incoming"]) == (c["internal"], c["outgoing"], c["incoming"])
        assert r["cohesion"] == (pytest.approx(c["internal"] / every) if every else None)
    assert not counts


def test_no_starts_and_no_edges(spark):
    _, _, _, nodes, edges = drawn(spark, 3)
    none = assignment.primary_modules(nodes, edges, role="FILTER").collect()
    assert len(none) == 14 and all(r["module_name"] is None for r in none)
    alone = assignment.primary_modules(nodes, edges.limit(0))
    assert {r["class_name"] for r in alone.filter("module_name = class_name AND distance = 0").collect()} == {"C00", "C05", "C10"}
    assert assignment.cohesion(alone, edges.limit(0)).filter("cohesion IS NULL AND classes = 1").count() == 3
    assert assignment.core(edges.limit(0), 2).count() == 0


@pytest.mark.parametrize("k", [2, 3])
def test_core_and_shared_classes(spark, k):
    names, roles, links, nodes, edges = drawn(spark, 4, m=30)
    near = {c: {b for a, b, _ in links if a == c} | {a for a, b, _ in links if b == c} for c in names}
    while any(len(v) < k for v in near.values()):
        drop = {c for c, v in near.items() if len(v) < k}
        near = {c: v - drop for c, v in near.items() if c not in drop}
    assert {r["class_name"]: r["neighbours"] for r in assignment.core(edges, k).collect()} == {c: len(v) for c, v in near.items()}
    used = Counter(b for a, b in {(a, b) for a, b, _ in links})
    shared = {c: n for c, n in used.items() if n >= 2 and c in near and roles[c] != "CONTROLLER"}
    found = assignment.shared_classes(nodes, edges, k, 2)
    assert {r["class_name"]: r["dependents"] for r in found.collect()} == shared
    rows = assignment.modules_without(nodes, edges, found).collect()
    for r in rows:
        for column, gone in (("classes_before", set()), ("classes_after", set(shared))):
            seen, todo = {r["module_name"]}, [r["module_name"]]
            while todo:
                c = todo.pop()
                for a, b, _ in links:
                    for x, y in ((a, b), (b, a)):
                        if x == c and y not in seen and y not in gone:
                            seen.add(y)
                            todo.append(y)
            assert r[column] == len(seen)
        assert r["shared"] == len({b for a, b, _ in links if a in seen and b in shared})
    assert len(rows) == sum(v == "CONTROLLER" for v in roles.values())


@pytest.mark.parametrize("percent", [30, 50, 80])
def test_renamed_pairs_lose_none(spark, percent):
    """Prefix filtering against all pairs."""
    draw = random.Random(percent)
    fixed = [f"S{i}" for i in range(8)]
    rows = {side: sorted({(f"{side}{i}", draw.choice(fixed), draw.choice(["F", "P"])) for i in range(9) for _ in range(draw.randrange(1, 6))}) for side in "xy"}
    frames = [spark.createDataFrame([("p", a, b, k, i, 0, "q", "SERVICE", "q", "SERVICE") for i, (a, b, k) in enumerate(rows[s])], EDGES) for s in "xy"]
    names = [spark.createDataFrame([("p", f"{s}{i}") for i in range(9)], "project_id string, class_name string") for s in "xy"]
    near = {s: {f"{s}{i}": {(b, k) for a, b, k in rows[s] if a == f"{s}{i}"} for i in range(9)} for s in "xy"}
    scored = [(len(v & w) / len(v | w), a, b) for a, v in near["x"].items() for b, w in near["y"].items() if v & w and 100 * len(v & w) >= percent * len(v | w)]
    best_x = {a: min((-s, b) for s, c, b in scored if c == a)[1] for _, a, _ in scored}
    best_y = {b: min((-s, a) for s, a, c in scored if c == b)[1] for _, _, b in scored}
    want = {(a, b) for a, b in best_x.items() if best_y[b] == a}
    assert {(r["class_name"], r["new_name"]) for r in comparison.renamed(names[0], names[1], *frames, percent).collect()} == want


def test_changes_and_new_violations(spark):
    schema = "project_id string, file_seq long, class_name string, package_name string, component_type string"
    before = spark.createDataFrame([("p", 1, "A", "x", "CONTROLLER"), ("p", 2, "B", "x", "SERVICE"), ("p", 3, "R", "x", "REPOSITORY"), ("p", 4, "Old", "x", "CONTROLLER"), ("p", 5, "Gone", "x", "DTO"), ("p", 6, None, "x", None)], schema)
    after = spark.createDataFrame([("p", 1, "A", "y", "CONTROLLER"), ("p", 2, "B", "x", "COMPONENT"), ("p", 3, "R", "x", "REPOSITORY"), ("p", 4, "New", "x", "CONTROLLER"), ("p", 7, "Added", "x", "DTO"), ("q", 1, "Z", None, None)], schema)
    edge = lambda a, b, i, ta="CONTROLLER": ("p", a, b, "FIELD", i, 0, "x", ta, "x", "REPOSITORY")
    e0 = spark.createDataFrame([edge("Old", "R", 4)], EDGES)
    e1 = spark.createDataFrame([edge("New", "R", 4), edge("A", "R", 1)], EDGES)
    found = comparison.changes(before, e0, after, e1)
    got = {(r["project_id"], r["change"], r["class_name"], r["new_name"]) for r in found.collect()}
    assert got == {("p", "MOVED", "A", "A"), ("p", "RETYPED", "B", "B"), ("p", "RENAMED", "Old", "New"), ("p", "REMOVED", "Gone", None), ("p", "ADDED", None, "Added"), ("q", "ADDED", None, "Z")}
    assert [(r["src"], r["dst"]) for r in comparison.new_violations(e0, e1, found).collect()] == [("A", "R")]
    assert comparison.changes(before, e0, before, e0).count() == 0
    assert comparison.changes(before.limit(0), e0.limit(0), after, e1).filter("change = 'ADDED'").count() == 6


def test_type_arguments_and_extractors(spark):
    texts = {"List<A>": ["A"], "Map<String, List<? extends com.x.B[]>>": ["String", "List", "com.x.B"], "int": [], "A<B<C<D>>, ?>": ["B", "C", "D"], "Set<? super E>": ["E"], "": [], "Broken<": []}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", graph.type_arguments(F.col("t")).alias("a")).collect()
    assert {r["t"]: r["a"] for r in rows} == texts
    schema = "project_id string, file_seq long, field_types array<string>, constructor_types array<string>, parameter_types array<string>, super_class string, interfaces array<string>"
    one = spark.createDataFrame([("p", 1, ["List<A>"], None, ["B"], "Base", ["I", "J"]), ("p", 2, [], [], [], None, [])], schema)
    kinds = [(r["ref_seq"], r["ref_kind"], r["raw_type"]) for r in graph.type_references(one, [("ONLY", "interfaces"), ("UP", F.array_compact(F.array("super_class")))]).orderBy("ref_seq").collect()]
    assert kinds == [(0, "ONLY", "I"), (1, "ONLY", "J"), (2, "UP", "Base")]
    full = [r["ref_kind"] for r in graph.type_references(one.filter("file_seq = 1").fillna({}).withColumn("constructor_types", F.array().cast("array<string>")), graph.more_extractors()).orderBy("ref_seq").collect()]
    assert full == ["FIELD", "METHOD_PARAMETER", "INHERITANCE", "IMPLEMENTATION", "IMPLEMENTATION", "GENERIC"]


def test_weights(spark):
    found = spark.createDataFrame([("p", "A", "B", "FIELD"), ("p", "A", "B", "INHERITANCE"), ("p", "A", "B", "FIELD"), ("p", "A", "A", "FIELD"), ("p", None, "B", "OTHER")], "project_id string, src string, dst string, ref_kind string")
    assert {(r["src"], r["dst"], tuple(r["kinds"]), r["refs"], r["weight"]) for r in graph.dependency_weights(found).collect()} == {("A", "B", ("FIELD", "INHERITANCE"), 3, 9), (None, "B", ("OTHER",), 1, 1)}
