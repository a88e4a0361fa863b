"""The published sample project, and the semantic corner cases, on hand-written tables."""

import pytest
from pyspark.sql import functions as F

from stratograph.functions import expressions as E
from stratograph.functions import fixed
from stratograph.operators import analysis, graph, modules, render

CLASSES = "project_id string, file_seq long, class_name string, package_name string, component_type string"
REFS = "project_id string, file_seq long, ref_seq long, ref_kind string, raw_type string"

GOLDEN = """ApplicationConfig CONFIGURATION,SecurityConfig CONFIGURATION,ApiResponse DTO,AuthController CONTROLLER,UserController CONTROLLER,LoginRequest DTO,
SignupRequest DTO,UserRequest DTO,JwtAuthResponse DTO,UserResponse DTO,UserDto DTO,User ENTITY,BadRequestException EXCEPTION,GlobalExceptionHandler EXCEPTION_HANDLER,
ResourceNotFoundException EXCEPTION,UserRepository REPOSITORY,CustomUserDetailsService SERVICE,JwtAuthenticationFilter COMPONENT,JwtTokenProvider COMPONENT,
UserPrincipal UNKNOWN,UserService SERVICE,UserServiceImpl SERVICE,TemplateApplication APPLICATION,AppConstants UNKNOWN"""
GOLDEN_EDGES = """SecurityConfig F JwtAuthenticationFilter,AuthController F UserRepository,AuthController F UserService,AuthController F JwtTokenProvider,
AuthController P LoginRequest,AuthController P SignupRequest,UserController F UserService,UserController P UserRequest,UserController P UserDto,
GlobalExceptionHandler P ResourceNotFoundException,GlobalExceptionHandler P BadRequestException,CustomUserDetailsService F UserRepository,
JwtAuthenticationFilter F JwtTokenProvider,UserPrincipal P User,UserService P UserRequest,UserService P UserDto,UserServiceImpl F UserRepository,
UserServiceImpl P UserRequest,UserServiceImpl P UserDto,UserServiceImpl P User"""
KIND = {"F": "FIELD", "P": "METHOD_PARAMETER", "C": "CONSTRUCTOR"}


def project(spark, classes, refs, name="P"):
    """classes: (class, type[, package]) in file order; refs: (class index or name, kind, type) in order."""
    rows = [(name, i, c[0], c[2] if len(c) > 2 else "com.pmj.template.x", c[1]) for i, c in enumerate(classes)]
    place = {c[0]: i for i, c in reversed(list(enumerate(classes)))}
    refs = [(name, r[0] if isinstance(r[0], int) else place[r[0]], i, KIND[r[1]], r[2]) for i, r in enumerate(refs)]
    c, r = spark.createDataFrame(rows, CLASSES), spark.createDataFrame(refs, REFS)
    found = graph.resolved(c, r)
    return c, graph.nodes(c, found), graph.edges(found)


@pytest.fixture(scope="module")
def golden(spark):
    classes = [tuple(x.split()) for x in GOLDEN.replace("\n", "").split(",")]
    return project(spark, classes, [tuple(x.split()) for x in GOLDEN_EDGES.replace("\n", "").split(",")])


def test_golden_counts(golden):
    classes, nodes, edges = golden
    assert (nodes.count(), edges.count()) == (24, 20)
    row = analysis.architecture_report(nodes, edges).first()
    assert [row[t.lower()] for t in fixed.COUNTED_LAYERS] == [2, 3, 1, 1, 2, 2] and (row["dependencies"], row["violations"]) == (20, 1)
    summary = {r["component_type"]: r["n"] for r in analysis.component_summary(classes).collect()}
    assert summary == {"CONTROLLER": 2, "SERVICE": 3, "REPOSITORY": 1, "ENTITY": 1, "DTO": 7, "CONFIGURATION": 2, "APPLICATION": 1, "COMPONENT": 2, "EXCEPTION": 2, "EXCEPTION_HANDLER": 1, "UNKNOWN": 2}


def test_golden_violation_and_cycles(golden):
    _, nodes, edges = golden
    assert [r["message"] for r in analysis.violations(edges).collect()] == ["CONTROLLER 'AuthController' must not depend on REPOSITORY 'UserRepository'"]
    assert graph.cycles(nodes, edges).count() == 0


def test_golden_modules_in_order(golden):
    _, nodes, edges = golden
    found = modules.discover_ordered(nodes, edges)
    members = lambda m: [r["class_name"] for r in found.filter(F.col("module_name") == m).orderBy("member_seq").collect()]
    tail = ["JwtTokenProvider", "JwtAuthenticationFilter", "SecurityConfig", "LoginRequest", "SignupRequest"]
    assert members("AuthController") == ["AuthController", "UserRepository", "CustomUserDetailsService", "UserServiceImpl", "UserRequest", "UserController", "UserService", "UserDto", "User", "UserPrincipal", *tail]
    assert members("UserController") == ["UserController", "UserService", "AuthController", "UserRepository", "CustomUserDetailsService", "UserServiceImpl", "UserRequest", "UserDto", "User", "UserPrincipal", *tail]
    sets = modules.discover(nodes, edges)
    assert {(r["module_name"], r["class_name"]) for r in sets.collect()} == {(r["module_name"], r["class_name"]) for r in found.collect()}


def test_golden_layout_and_mappings(golden):
    _, nodes, edges = golden
    found = modules.discover_ordered(nodes, edges)
    layout = {r["folder_type"]: r["classes"] for r in modules.layout(found).filter("module_name = 'AuthController'").collect()}
    assert layout == {
        "CONTROLLER": ["AuthController", "UserController"], "REPOSITORY": ["UserRepository"], "SERVICE": ["CustomUserDetailsService", "UserServiceImpl", "UserService"],
        "DTO": ["UserRequest", "UserDto", "LoginRequest", "SignupRequest"], "ENTITY": ["User"], "COMMON": ["UserPrincipal"],
        "COMPONENT": ["JwtTokenProvider", "JwtAuthenticationFilter"], "CONFIGURATION": ["SecurityConfig"],
    }
    rows = {r["class_name"]: r for r in modules.mappings(found).filter("module_name = 'AuthController'").collect()}
    assert rows["UserServiceImpl"]["target_package"] == "com.pmj.template.x.authcontroller.service"
    assert rows["SecurityConfig"]["target_file"] == "src/main/java/com/pmj/template/x/authcontroller/config/SecurityConfig.java"


def test_golden_reports(golden):
    classes, nodes, edges = golden
    lines = render.graph_text(nodes, edges).first()["report"].split("\n")
    assert lines[1:4] == ["Nodes : 24", "Edges : 20", "SecurityConfig --(FIELD)--> JwtAuthenticationFilter"]
    assert render.plantuml(edges).first()["plantuml"].startswith("@startuml\n\nSecurityConfig --> JwtAuthenticationFilter\nAuthController --> UserRepository\n")
    assert render.summary_text(analysis.component_summary(classes)).first()["report"].split("\n")[0] == "CONTROLLER           : 2"
    assert "must not depend" in render.architecture_text(analysis.architecture_report(nodes, edges), analysis.violations(edges)).first()["report"]
    found = modules.discover_ordered(nodes, edges)
    assert render.modules_text(found).first()["report"].startswith("\n========== DISCOVERED MODULES ==========\nAuthController\n   - AuthController\n")
    plan = render.mapping_text(modules.mappings(found)).first()["report"].split("\n")
    assert plan[1:5] == ["========== TRANSFORMATION PLAN ==========", "-" * 40, "Class           : AuthController", "Module          : AuthController"]
    layout = render.layout_text(found).first()["report"].split("\n")
    assert layout[3:6] == ["Module : AuthController", "  CONTROLLER", "      - AuthController"]


def test_parallel_closing_edges_repeat_a_cycle(spark):
    _, nodes, edges = project(spark, [("Aa", "X"), ("Bb", "X"), ("Cc", "X")], [("Aa", "F", "Bb"), ("Bb", "F", "Cc"), ("Cc", "F", "Aa"), ("Cc", "P", "Aa")])
    found = graph.cycles(nodes, edges)
    assert [r["path"] for r in found.orderBy("cycle_seq").collect()] == [["Aa", "Bb", "Cc", "Aa"]] * 2
    assert render.cycles_text(found).first()["report"].split("\n")[3:8] == ["Cycle 1", "", "Aa", "   ↓", "Bb"]
    assert "No circular dependencies found." in render.cycles_text(found.limit(0), nodes).first()["report"]


def test_a_violation_for_each_kind(spark):
    _, _, edges = project(spark, [("Cc", "CONTROLLER"), ("Rr", "REPOSITORY")], [("Cc", "F", "Rr"), ("Cc", "P", "Rr")])
    assert [r["message"] for r in analysis.violations(edges).collect()] == ["CONTROLLER 'Cc' must not depend on REPOSITORY 'Rr'"] * 2


def test_files_without_class_are_one_node(spark):
    classes = [("XController", "CONTROLLER"), ("YController", "CONTROLLER"), (None, "UNKNOWN"), (None, "UNKNOWN")]
    _, nodes, edges = project(spark, classes, [(0, "F", "Xa"), (1, "F", "Ya"), (2, "F", "Xa"), (3, "F", "Ya")])
    found = modules.discover_ordered(nodes, edges)
    assert [r["class_name"] for r in found.filter("module_name = 'XController'").orderBy("member_seq").collect()] == ["XController", "Xa", None, "Ya", "YController"]
    assert {r["class_name"] for r in modules.discover(nodes, edges).filter("module_name = 'XController'").collect()} == {"XController", "Xa", None, "Ya", "YController"}
    assert {r["target_file"] for r in modules.mappings(found).filter("class_name IS NULL").collect()} == {"src/main/java/com/pmj/template/x/xcontroller/common/null.java", "src/main/java/com/pmj/template/x/ycontroller/common/null.java"}


def test_equal_names(spark):
    """Nodes keep the first file's role, targets resolve to the last one's."""
    _, nodes, edges = project(spark, [("User", "ENTITY", "a"), ("User", "DTO", "b"), ("C", "CONTROLLER", "c")], [(2, "F", "User"), (0, "F", "b.User")])
    assert nodes.filter("class_name = 'User'").first()["component_type"] == "ENTITY"
    assert [(r["dst"], r["dst_type"]) for r in edges.collect()] == [("User", "DTO")]
    assert analysis.violations(edges).count() == 0


def test_external_types_connect(spark):
    _, nodes, edges = project(spark, [("XController", "CONTROLLER"), ("YController", "CONTROLLER")], [(0, "F", "UUID"), (1, "F", "UUID")])
    assert {r["label"] for r in graph.components(edges, nodes).collect()} == {"UUID"}
    assert graph.outgoing(edges, "XController").count() == 1 and graph.incoming(edges, "UUID").count() == 2 and graph.node_named(nodes, "UUID").count() == 1


def test_long_chain_and_projects_apart(spark):
    n = 3000
    classes = [(f"K{i:05d}", "CONTROLLER" if i == 0 else "SERVICE") for i in range(n)]
    _, nodes, edges = project(spark, classes, [(i, "F", f"K{i + 1:05d}") for i in range(n - 1)])
    assert graph.traversal(nodes, edges).count() == n and graph.cycles(nodes, edges).count() == 0
    assert {r["label"] for r in graph.components(edges, nodes).collect()} == {"K00000"}
    _, _, other = project(spark, [("K00000", "X"), ("Z", "X")], [(1, "F", "K00000")], "Q")
    assert graph.components(edges.union(other)).select("project_id", "label").distinct().count() == 2


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_normalize_type(spark):
    vectors = {
        "User": "User", "java.util.List": "List", "List<User>": "User", "Map<String, User>": "User", "Collection<? extends User>": "User", "Optional<List<User>>": "List<User>",
        "List<Map<String, User>>": "User>", "Map<List<A>, B>": "B", "Map<A, List<B>>": "List<B>", "List<com.x.User>": "com.x.User", "ResponseEntity<?>": "?",
        "List<? super User>": "? super User", "Map<? extends A, B>": "A, B", "Class<? extends A<B>>": "A<B", "User[]": "User[]", "List<User[]>": "User[]", "List<User>[]": "User",
        "\t User\n": "User", "Map<List<A>, ? extends B>": None, None: "",
    }
    assert values(spark, E.normalize_type, list(vectors)) == list(vectors.values())


def test_ignored_types(spark):
    rows = ["int", "T", "User[]", "List", "  ", "", "UUID", "AB", "?", "Key", None]
    assert values(spark, E.is_ignored, rows) == [True] * 6 + [False] * 3 + [True] * 2
    assert len(fixed.IGNORED_TYPES) == 48


def test_naming_heuristic(spark):
    vectors = {"UserController": "user", "OrderServiceImpl": "order", "UserDTO": "user", "Service": "common", None: "common", "UserConfiguration": "useruration", "ConfigurationException": "uration", " ": "common"}
    assert values(spark, E.naming_heuristic, list(vectors)) == list(vectors.values())


def test_packages(spark):
    rows = spark.createDataFrame([("com.x", "UserController", "SERVICE"), ("", "UserController", "SERVICE"), ("com.x", " ", "CONFIGURATION"), ("", "M", None)], "b string, m string, f string")
    assert [r[0] for r in rows.select(E.target_package(F.col("b"), F.col("m"), F.col("f"))).collect()] == ["com.x.usercontroller.service", "usercontroller.service", "com.x.common.config", ".M"]
    for packages, base in ((["com.a.x", "com.a.y"], "com.a"), (["com.a"], "com.a"), (["com.ab.x", "com.a.y"], "com"), (["org.x", "com.x"], ""), ([" ", None], "")):
        rows = spark.createDataFrame([("P", p) for p in packages], "project_id string, package_name string")
        assert modules.base_package(rows).first()["base_package"] == base


def test_classification(spark):
    schema = "class_name string, is_interface boolean, annotations array<string>, super_class string, interfaces array<string>, package_name string"
    cases = [
        (("UserController", False, ["Service"], None, [], "x"), "SERVICE"), (("UserService", True, [], None, [], "x.service"), "SERVICE"), (("FooController", True, [], None, [], "x.y"), "UNKNOWN"),
        (("UserRepository", True, [], None, [], "x.y"), "REPOSITORY"), (("UserService", False, [], None, [], "x.y"), "UNKNOWN"), (("FooConfig", False, [], "RuntimeException", [], "x"), "EXCEPTION"),
        (("A", False, ["SpringBootApplication", "Configuration"], None, [], "x"), "CONFIGURATION"), ((None, False, [], None, [], "x.dto"), "UNKNOWN"), (("A", False, [], None, ["JpaRepository"], "x"), "REPOSITORY"),
        (("A", False, [], None, [], "x.DTO"), "DTO"), (("A", False, [], None, [], ""), "UNKNOWN"), (("A", False, ["ControllerAdvice"], None, [], "x"), "EXCEPTION_HANDLER"),
    ]
    df = spark.createDataFrame([(*row, want) for row, want in cases], schema + ", want string")
    assert [r for r in analysis.classify(df).filter("want <> component_type").collect()] == []
