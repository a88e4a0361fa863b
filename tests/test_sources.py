"""Archives and Java sources, down to mappings."""

import io
import os
import shutil
import zipfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from stratograph.operators import analysis, graph, modules, render
from stratograph.sources import archives, java
from stratograph.streaming.dropfolder import committed, watch

from .java_scanner import ParseError, declarations

CONTROLLER = """package com.shop.web;
import java.util.*;
/* class Fake { Hidden h; } */
@RestController @RequestMapping(value = "/x{", produces = {"a", "b"})
public class UserController<T extends Base> extends com.b.Parent<T> implements Named, Keyed<String> {
  private final UserService service, others[]; // class Other
  private Map<String, List<Role>> roles = new HashMap<String, List<Role>>() {{ put("}", null); }}, more;
  public UserController(@Autowired final UserService service, List<? extends Role> r, String... names) { this.service = service; }
  <R> R run(int a[], Map<A, B> q) throws IOException {
    Runnable x = new Runnable() { Inner f; public void run(Param p) { } };
    class Local { Deep d; }
    Function<A, B> g = (y, z) -> a < b ? c : d;
    return null;
  }
  enum Kind { ONE(1) { void q(Of q) { } }, TWO; Note note; }
  @interface Mark { String value() default "x"; }
  record Pair(int a, Part b) { Pair { } static Thing t = null; }
}"""


def test_declarations():
    found = declarations(CONTROLLER)
    assert (found["class_name"], found["package_name"], found["super_class"], found["is_interface"]) == ("UserController", "com.shop.web", "Parent", False)
    assert found["interfaces"] == ["Named", "Keyed"] and found["annotations"] == ["RestController", "RequestMapping"] and found["methods"] == ["run"]
    assert found["field_types"] == ["UserService", "UserService[]", "Map<String, List<Role>>", "Map<String, List<Role>>", "Inner", "Deep", "Note", "Thing"]
    assert found["constructor_types"] == ["UserService", "List<? extends Role>", "String"]
    assert found["parameter_types"] == ["int[]", "Map<A, B>", "Param", "Of"]


@pytest.mark.parametrize(
    ("text", "name"),
    [("package a; enum X { A; private User u; }", None), ("enum X { A; static class In { } }", "In"), ("record R(int a) { }", None), ("interface I extends A, b.C { void f(X x); }", "I"), ("", None), ("abstract sealed class S permits T { }", "S")],
)
def test_first_class(text, name):
    assert declarations(text)["class_name"] == name


def test_last_extended_type():
    assert declarations("interface I extends A, b.C<D> { }")["super_class"] == "C"


@pytest.mark.parametrize("text", ["class A {", "class A { int", "class A { void f(int) { } ", "class { }", "int x; }"])
def test_bad_files(text):
    with pytest.raises(ParseError):
        declarations(text)


def zipped(**files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, text in files.items():
            archive.writestr(name, text)
    return buffer.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("drop")
    main = "shop/src/main/java/com/shop/"
    (top / "shop.zip").write_bytes(
        zipped(
            **{
                "shop/pom.xml": "", "shop/a/pom.xml": "", main + "web/UserController.java": CONTROLLER, main + "service/UserService.java": "package com.shop.service; @Service class UserService { UserRepository r; }",
                main + "UserRepository.java": "package com.shop; interface UserRepository extends JpaRepository<User, Long> { }", main + "Broken.java": "class Broken {", "shop/src/test/java/T.java": "class T { Gone g; }",
                "../evil.java": "class Evil { }", main + "Kind.java": "package com.shop; enum Kind { A; User u; }",
            }
        )
    )
    (top / "bad.zip").write_bytes(b"no archive")
    (top / "empty.zip").write_bytes(zipped())
    (top / "notes.txt").write_bytes(b"x")
    (top / "bare.zip").write_bytes(zipped(**{"readme.txt": "x"}))
    (top / "nosource.zip").write_bytes(zipped(**{"pom.xml": "x"}))
    return str(top)


def test_archives_to_mappings(spark, folder):
    admitted = archives.admitted(archives.read_archives(spark, folder))
    assert {r["project_name"]: r["reject_reason"] for r in admitted.collect() if r["reject_reason"]} == {"notes.txt": "Only ZIP files are supported"}
    entries = archives.explode_entries(admitted)
    name = {r["project_id"]: r["project_name"] for r in admitted.collect()}
    problems = {(name[r["project_id"]], r["kind"], r["http_status"]) for r in archives.errors(admitted, entries).collect()}
    assert problems == {
        ("notes.txt", "InvalidZip", 400), ("bad.zip", "InvalidZip", 400), ("empty.zip", "InvalidZip", 400), ("shop.zip", "ProjectExtraction", 500),
        ("bare.zip", "InvalidProjectStructure", 400), ("bad.zip", "InvalidProjectStructure", 400), ("empty.zip", "InvalidProjectStructure", 400), ("nosource.zip", "SourceCodeNotFound", 400),
    }
    sources = archives.java_sources(entries.filter("error IS NULL"))
    assert [r["path"].rpartition("/")[2] for r in sources.orderBy("file_seq").collect()] == ["Broken.java", "Kind.java", "UserService.java", "UserRepository.java", "UserController.java"]
    extracted = java.extract(sources)
    assert extracted.filter("error IS NOT NULL").count() == 1 and java.parsed(extracted, whole_projects=True).count() == 0
    classes = analysis.classify(java.parsed(extracted))
    assert {r["class_name"]: r["component_type"] for r in classes.collect()} == {None: "UNKNOWN", "UserService": "SERVICE", "UserRepository": "REPOSITORY", "UserController": "CONTROLLER"}
    found = graph.resolved(classes, graph.type_references(classes))
    nodes, edges = graph.nodes(classes, found), graph.edges(found)
    members = {r["class_name"] for r in modules.discover(nodes, edges).collect()}
    assert {"UserController", "UserService", "UserRepository"} <= members
    assert modules.mappings(modules.discover(nodes, edges)).filter("class_name = 'UserService'").first()["target_package"] == "com.shop.usercontroller.service"
    response = render.upload_response(admitted.filter("reject_reason IS NULL").withColumnRenamed("length", "file_size")).first()["response"]
    assert '"status":"UPLOADED"' in response and '"success":true' in response


def test_drop_folder_writes_each_row_once(spark, folder, tmp_path, monkeypatch):
    """A batch that fails between its tables, is tried again, and leaves no doubles; a later batch adds its own rows."""
    drop, out, state = tmp_path / "drop", str(tmp_path / "out"), str(tmp_path / "state")
    drop.mkdir()
    shutil.copy(f"{folder}/shop.zip", drop / "shop.zip")
    good, calls = analysis.violations, []

    def failing(edges):
        calls.append(1)
        if len(calls) == 1:
            return edges.withColumn("broken", F.raise_error(F.lit("lost in the middle")))
        return good(edges)

    monkeypatch.setattr(analysis, "violations", failing)
    with pytest.raises(StreamingQueryException):
        watch(spark, str(drop), out, state).awaitTermination(120)
    assert os.path.exists(f"{out}/classes/batch=0") and not os.path.exists(f"{out}/_commits")
    watch(spark, str(drop), out, state).awaitTermination(120)
    once = {name: committed(spark, out, name).count() for name in ("classes", "nodes", "edges", "mappings", "errors")}
    assert once["classes"] == 4 and once["mappings"] > 0 and once["errors"] == 2
    classes = committed(spark, out, "classes")
    assert classes.select("project_id", "file_seq").distinct().count() == classes.count()
    shutil.copy(f"{folder}/bad.zip", drop / "bad.zip")
    watch(spark, str(drop), out, state).awaitTermination(120)
    assert {r["batch"] for r in committed(spark, out, "errors").collect()} == {0, 1}
    assert committed(spark, out, "classes").count() == 4
