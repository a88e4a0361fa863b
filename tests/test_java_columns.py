"""Declarations as columns against a plain scanner of one file at a time."""

import random

import pytest

from stratograph.sources import java

from .java_scanner import ParseError, declarations

TYPES = ["int", "String", "User", "a.b.C", "List<User>", "Map<String, List<Role>>", "Map<? extends A, ? super B>", "long[]", "List<int[]>[]", "@N User", "Map<String, @N(x = {1, 2}) U>", "Outer.Inner<X>.Deep"]
ODD = [
    "", ";", "package a.b;", "import a.b.*;\nimport static c.D.e;\nclass X { }", "// class Fake { }\n/* class F2 { */ enum E { A, B }", "@interface Mark { String value() default \"x\"; int[] n() default {1, 2}; Kind k(); }",
    "class A { String s = \"class B { C d; }\"; char c = '{'; String t = \"\"\"\n class D { \"E\" f; }\\\"\"\"\"; }", "class A<T extends B<C, D>> extends e.F<T> implements G<H>, i.J { <T> A(T t) { } <A, B> Map<A, B> A(int x) { return null; } }",
    "enum E implements I, J { ONE(new X() { Y y; }) { Z z; void m(W w) { } }, TWO { }, THREE; E() { } private V v; E(U u) { } }", "enum E { A { B b; } }", "record R<T>(int a, @N T b) implements S { R { check(a); } static Q q; R(int c) { this(c, null); } }",
    "class A { int a = b < c ? 1 : 2, d = e > f ? 3 : 4; Map<A, B> g = new HashMap<A, B>(), h; F<A, B> i = (x, y) -> x < y; int j[], k[][] = {{1}, {2}}; }",
    "class A { static { class L { M m; } } { N n = new N() { O o; }; } void f(final @P Q q, R... rs, S s[]) throws T { for (int i = 0; i < 3; i++) { switch (i) { case 1 -> { record V(int w) { X x() { return null; } } } default -> g(A.class); } } } }",
    "abstract sealed class A permits B, C { abstract void f(A this, B b); non-sealed class B extends A { } final class C extends A { C(D d) { super(d); } } }", "interface I extends A, b.C<D> { int X = 1; default void f(G g) { } static <T> T h(T t) { return t; } void k(L l); }",
    "class A { Object o = new B(new C() { D d; }, 1) { E e; void f(G g) { } }.h(), i; int class_, record = 1; void record(J j) { record.k(); } }", "@A(b = @C(d = {1, 2}), e = \"}\") @f.G public final class H { @I(\"x\") @J private K l; @M void n(@O(p = 1) final Q r) { } }",
    "class A {", "class A { void f( { } }", "class A } {", "int x;", "class A { int }", "class A { void f(int) { } }", "class { }", "class A { ) }", "import a.b", "class A { B c d e; }", "class A { foo; }",
]


def java_file(rng):
    """A file with nested declarations; each part is one that the language allows."""
    name = lambda: rng.choice(["Foo", "Bar", "Baz", "Qux"]) + str(rng.randint(0, 9))
    note = lambda: rng.choice(["", "", "@Service ", "@a.B(\"x{\") ", "@C(d = {1, 2}) "])
    modifier = lambda: rng.choice(["", "private ", "public static ", "final "])
    value = lambda: rng.choice(["", " = null", " = a < b ? 1 : 2", " = new HashMap<A, B>()", " = {1, 2}", " = x -> { y(); }", f" = new {name()}(1) {{ {rng.choice(TYPES)} in; }}", " = \"} , ;\""])
    parameters = lambda: ", ".join(rng.choice(["", "final ", "@N "]) + rng.choice(TYPES) + rng.choice([" p", " p", "... p", " p[]"]) for _ in range(rng.randint(0, 3)))

    def code(depth):
        local = f"class Local {{ {member(depth, 'Local')} }} " if depth and rng.random() < 0.3 else ""
        return "{ " + local + rng.choice(["", "int i = 0; ", "if (a < b) { c(); } ", "return new Thing<A>(x) { Field f; void run(Param p) { } }; ", "f(new Y() { Z z; }); ", "for (X x : xs) { } "]) + "}"

    def member(depth, own):
        kind = rng.choice([k for k in range(7) if own or k != 5])  # a body without a name has no constructor
        if kind < 3:
            return f"{note()}{modifier()}{rng.choice(TYPES)} " + ", ".join(f"v{k}{rng.choice(['', '', '[]'])}{value()}" for k in range(rng.randint(1, 3))) + ";"
        if kind < 5:
            return f"{note()}{modifier()}{rng.choice(['', '<T> ', '<T extends A<B, C>> '])}{rng.choice(['void', *TYPES])} m{rng.randint(0, 9)}({parameters()}) {rng.choice(['', 'throws X '])}{code(depth - 1)}"
        if kind == 5:
            return f"{modifier()}{own}({parameters()}) {code(depth - 1)}"
        return type_(depth - 1) if depth else code(0)

    def type_(depth):
        kind, own = rng.choice(["class", "class", "interface", "enum", "record"]), name()
        body = " ".join(member(depth, own) for _ in range(rng.randint(0, 4)))
        if kind == "enum":
            return f"{note()}enum {own} {{ A, B(1) {{ {member(0, '')} }}; {body} }}"
        if kind == "record":
            return f"{note()}record {own}({parameters()}) {{ {body} }}"
        generic, implements = rng.choice(["", "<T>", "<T extends A<B, C>>"]), rng.choice(["", " implements I, j.K<L>"]) if kind == "class" else ""
        return f"{note()}{modifier()}{kind} {own}{generic}{rng.choice(['', ' extends c.Base<X>'])}{implements} {{ {body} }}"

    head = rng.choice(["", "package com.shop.web;\n"]) + "".join(rng.choice(["import a.b.C;\n", "import static d.E.*;\n"]) for _ in range(rng.randint(0, 2)))
    return head + "\n".join(type_(2) for _ in range(rng.randint(1, 2)))


@pytest.fixture(scope="module")
def files():
    rng = random.Random(11)
    return ODD + [java_file(rng) for _ in range(250)]


@pytest.fixture(scope="module")
def found(spark, files):
    rows = [("p", i, f"f{i}", text) for i, text in enumerate(files)]
    return {r["file_seq"]: r.asDict(recursive=True) for r in java.extract(spark.createDataFrame(rows, "project_id string, file_seq long, path string, content string")).collect()}


def test_against_the_scanner(files, found):
    bad = 0
    for i, text in enumerate(files):
        try:
            want = declarations(text)
        except ParseError:
            assert found[i]["error"] and found[i]["class_name"] is None, text
            bad += 1
            continue
        if "f(int)" in text:
            assert found[i]["error"] == "no parameter type"  # the scanner takes the type for a name's
            continue
        if text == "import a.b":
            assert found[i]["error"] == "unexpected import"  # the scanner doesn't miss the semicolon
            continue
        got = {k: found[i][k] for k in want}
        assert got | {"fields": None} == want | {"fields": None}, text
        assert len(got["fields"]) == len(want["fields"])
    assert bad == 9


def test_texts_of_fields(files, found):
    at = next(i for i, t in enumerate(files) if "class A { int a = b < c" in t)
    assert found[at]["fields"][1:3] == ["Map<A, B> g = new HashMap<A, B>(), h;", "F<A, B> i = (x, y) -> x<y;"]
    at = next(i for i, t in enumerate(files) if t.startswith("@A(b = @C"))
    assert found[at]["fields"] == ['@I("x") @J private K l;']


def test_no_python_on_texts(spark):
    plan = java.extract(spark.range(3).selectExpr("'p' AS project_id", "id AS file_seq", "'f' AS path", "'class A { B b; }' AS content"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_no_files_and_no_content(spark):
    empty = spark.createDataFrame([], "project_id string, file_seq long, path string, content string")
    assert java.extract(empty).count() == 0
    row = java.extract(spark.createDataFrame([("p", 1, "f", None)], empty.schema)).first()
    assert row["class_name"] is None and row["error"] is None and row["package_name"] == "" and row["fields"] == []
