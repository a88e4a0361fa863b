"""Strongly connected components, ordered walks, and ordered rules, against plain Python on random graphs."""

import random

import pytest

from stratograph.operators import analysis, graph

NODES = "project_id string, class_name string, file_seq long, ref_seq long, package_name string, component_type string"
EDGES = "project_id string, src string, dst string, dependency_type string, file_seq long, ref_seq long, src_package string, src_type string, dst_package string, dst_type string"


def made(rng, projects):
    """Nodes and edges of random projects: sparse, dense, with a hub, with parallel edges, without edges."""
    nodes, edges = [], []
    for p in range(projects):
        n, m = rng.choice([(1, 0), (4, 3), (8, 14), (12, 12), (15, 40), (20, 19)])
        names = [f"C{i:02}" for i in range(n)]
        nodes += [(f"p{p}", c, i, -1, "a.b", "CONTROLLER" if i % 4 == 1 else "SERVICE") for i, c in enumerate(names)]
        pairs = [(rng.choice(names), rng.choice(names)) for _ in range(m)] + ([(c, names[0]) for c in names] if p % 5 == 0 else [])
        kinds = {(a, b, k) for a, b in pairs for k in rng.sample(["FIELD", "CONSTRUCTOR"], rng.randint(1, 2)) if a != b}
        edges += [(f"p{p}", a, b, k, names.index(a), i, None, None, None, None) for i, (a, b, k) in enumerate(sorted(kinds))]
    return nodes, edges


@pytest.fixture(scope="module")
def tables(spark):
    nodes, edges = made(random.Random(4), 25)
    return nodes, edges, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def reached(near, start):
    seen, todo = set(), [start]
    while todo:
        for b in near.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def neighbours(edges, project, both=False):
    near = {}
    for e in sorted((e for e in edges if e[0] == project), key=lambda e: e[4:6]):
        near.setdefault(e[1], []).append(e[2])
        if both:
            near.setdefault(e[2], []).append(e[1])
    return near


def test_strong_components(tables):
    nodes, edges, _, e = tables
    want = set()
    for p in {n[0] for n in nodes}:
        near = neighbours(edges, p)
        ahead = {c: reached(near, c) for _, c, *_ in (n for n in nodes if n[0] == p)}
        want |= {(p, c, max(d for d in ahead[c] if c in ahead[d])) for c in ahead if c in ahead[c]}
    assert {tuple(r) for r in graph.strong_components(e).collect()} == want and len(want) > 50


def test_no_cycles(spark, tables):
    chain = [("p", f"C{i:03}", f"C{i + 1:03}", "FIELD", i, 0, None, None, None, None) for i in range(12)] + [("p", None, "C000", "FIELD", 99, 0, None, None, None, None)]
    e = spark.createDataFrame(chain, EDGES)
    assert graph.strong_components(e).count() == 0
    assert graph.cycles(tables[2].limit(0), e).count() == 0


def test_cycles_as_a_search_in_node_order_meets_them(tables):
    nodes, edges, n, e = tables
    want = []
    for p in sorted({x[0] for x in nodes}):
        near, seen, found = neighbours(edges, p), set(), []

        def visit(c, path, near=near, seen=seen, found=found):
            seen.add(c)
            for b in near.get(c, ()):
                if b in path:
                    found.append([*path[path.index(b) :], b])
                elif b not in seen:
                    visit(b, [*path, b])

        for _, c, *_ in (x for x in nodes if x[0] == p):
            if c not in seen:
                visit(c, [c])
        want += [(p, i, tuple(path)) for i, path in enumerate(found, 1)]
    assert sorted((r["project_id"], r["cycle_seq"], tuple(r["path"])) for r in graph.cycles(n, e).collect()) == sorted(want)


def test_walks_in_order(tables):
    nodes, edges, n, e = tables
    want = set()
    for p in {x[0] for x in nodes}:
        near = neighbours(edges, p, both=True)
        for k, start in enumerate([x[1] for x in nodes if x[0] == p and x[5] == "CONTROLLER"], 1):
            order = []

            def visit(c, order=order, near=near):
                order.append(c)
                for b in near.get(c, ()):
                    if b not in order:
                        visit(b)

            visit(start)
            want |= {(p, k, start, i, c) for i, c in enumerate(order, 1)}
    assert {tuple(r) for r in graph.traversal(n, e).collect()} == want


def test_the_first_rule_decides(spark):
    typed = [("p", "A", "B", k, i, 0, None, a, None, b) for i, (a, b, k) in enumerate([("SERVICE", "DTO", "FIELD"), ("CONTROLLER", "ENTITY", "FIELD"), ("CONTROLLER", "DTO", "FIELD"), ("ENTITY", "DTO", "FIELD"), (None, "DTO", "FIELD")])]
    e = spark.createDataFrame(typed, EDGES)
    rules = analysis.layer_rules(spark, [("SERVICE", "DTO", True), ("SERVICE", "DTO", False), ("CONTROLLER", "DTO", True), ("CONTROLLER", "*", False), ("*", "*", True)])
    got = {(r["src_type"], r["dst_type"]): (r["rule_seq"], r["allowed"]) for r in analysis.edge_verdicts(e, rules).collect()}
    assert got == {("SERVICE", "DTO"): (1, True), ("CONTROLLER", "ENTITY"): (4, False), ("CONTROLLER", "DTO"): (3, True), ("ENTITY", "DTO"): (5, True)}
    assert analysis.violations(e, rules).count() == 1 and analysis.violations(e, rules.limit(0)).count() == 0
