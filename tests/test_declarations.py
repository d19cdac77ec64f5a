"""The tree of declarations: nested, local and anonymous types, members by kind, and what is built on them."""

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import java
from gaugewright.functions.declarations import Source, names_of
from gaugewright.operators import conventions

NESTED = """package p;
import org.junit.jupiter.api.*;
/** class Fake { void no() { } } */
@DisplayName("outer") class OuterTest {
  private int x = 1, y = f(2, 3), z[] = {1, 2};
  static final Map<String, List<Integer>> table = new HashMap<String, List<Integer>>() {{ put("a", null); }};
  OuterTest() { super(); }
  static { run(); }
  @BeforeEach void setUp() { }
  @Nested class WhenEmpty {
    @Test void isEmpty() { assertTrue(s.isEmpty()); }
    @Nested @Tag("a") class Deeper { @ParameterizedTest void works(@Param int a, Map<String, Integer> m) throws E { assertEquals(17, f(a)); } }
    private Foo helper() { return new Foo() { @Override public int size() { return 0; } }; }
  }
  enum Kind { A, B(1) { int g() { return 1; } }, C; Kind() { } int g() { return 0; } }
  record Pair(int a, String b) { Pair { check(a); } int sum() { return a; } }
  interface Shape { double area(); default void draw() { class Local { void inner() { } } } }
  @interface Marked { String value() default ""; }
  @Test public void last() { Runnable r = () -> { go(); }; if (a) { b(); } }
}
class Second { void testTwo() { } }
"""


def test_methods_of_nested_types():
    rows = java.method_rows(NESTED)
    assert [(r["owner"], r["name"], r["is_test"], r["depth"], r["parameters"]) for r in rows] == [
        ("OuterTest", "setUp", False, 1, 0),
        ("OuterTest.WhenEmpty", "isEmpty", True, 2, 0),
        ("OuterTest.WhenEmpty.Deeper", "works", True, 3, 2),
        ("OuterTest.WhenEmpty", "helper", False, 2, 0),
        ("OuterTest.Kind", "g", False, 2, 0),
        ("OuterTest.Pair", "sum", False, 2, 0),
        ("OuterTest.Shape", "draw", False, 2, 0),
        ("OuterTest.Shape.Local", "inner", False, 3, 0),
        ("OuterTest", "last", True, 1, 0),
        ("Second", "testTwo", True, 1, 0),
    ]
    assert rows[2]["annotations"] == ["ParameterizedTest"] and rows[2]["body"].startswith("{ assertEquals(17")


def test_members_by_type():
    found = {}
    for node in Source(NESTED).root.walk():
        found.setdefault(node.owner, []).append(node.key())
    assert found[""] == ["type:OuterTest", "type:Second"]
    assert found["OuterTest"] == [
        "field:x", "field:y", "field:z", "field:table", "method:OuterTest/0", "block:5", "method:setUp/0", "type:WhenEmpty", "type:Kind", "type:Pair", "type:Shape", "type:Marked", "method:last/0",
    ]
    assert found["OuterTest.WhenEmpty"] == ["method:isEmpty/0", "type:Deeper", "method:helper/0"]
    assert found["OuterTest.Shape"] == ["method:area/0", "method:draw/0", "type:Local"]
    assert found["OuterTest.Kind"] == ["field:A", "field:B", "field:C", "method:Kind/0", "method:g/0"]
    assert found["OuterTest.Marked"] == ["method:value/0"]
    sources = dict(java.members(NESTED))
    assert sources["field:x"] == sources["field:y"] == "private int x = 1, y = f(2, 3), z[] = {1, 2};"
    assert sources["method:works/2"].startswith("@ParameterizedTest void works(")


@pytest.mark.parametrize("declaration, names", [("int x = 1, y = 2", ["x", "y"]), ("Map<A, List<B>> m", ["m"]), ("a.B<C[]> c[] = {d, e}, f", ["c", "f"]), ("@N(x = 1) int g = h(i, j)", ["g"]), ("", [])])
def test_names_of_fields(declaration, names):
    assert names_of(declaration) == names


def test_broken_sources():
    for code in ("class A { void f() {", "class A { int x", "}} class A { void g() { } }", "class A { void f( { } void h() { } }", "class", "class A extends B<C> { @", "enum E { A(", "record R(int a"):
        rows = java.method_rows(code)
        assert all(r["owner"] == "A" for r in rows), code
        java.members(code)
    deep = "class A { " * 500 + "void f() { }" + " }" * 500
    assert java.method_rows(deep)[0]["depth"] == 500


def test_smells_and_names_over_nested_types(spark):
    docs = spark.createDataFrame([(1, NESTED), (2, "class A { void x() { } }"), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in conventions.smell_totals(docs, ["doc_id"]).collect()}
    assert (got[1]["methods"], got[1]["magic_number_test"], got[1]["unknown_test"]) == (4, 1, 2)
    assert got[2]["methods"] == got[3]["methods"] == 0
    profile = conventions.profile(spark.createDataFrame([(NESTED, NESTED)], "candidate string, reference string")).first()
    assert profile["naming_style"] == pytest.approx((3 + 1 / 3) / 4) and profile["assertion_idiom"] == 1.0
    assert 0 < profile["fixture_reuse"] < 1


def test_constructions_and_calls(spark):
    code = "class A { void f() { new Foo<>(1); new a.b.Bar(make()); x.make(); if (a < b && c > (d)) { make(); } new int[3]; } }"
    calls = spark.range(1).select(F.explode(java.calls_column(F.lit(code), ".*")).alias("c")).select("c.*").collect()
    assert [(c["name"], c["constructs"], c["lead"] == ".") for c in calls if c["name"] not in ("f", "if")] == [("Foo", True, False), ("Bar", True, True), ("make", False, False), ("make", False, True), ("make", False, False)]
