"""Operators that the driver's tables cannot show: Java sources, conventions, logs, statistics against known values."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import java, ranges, scalars, text
from gaugewright.operators import classify, conventions, coverage, incremental, matching, ranking, selection, stages, statistics


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_mask_keeps_the_layout():
    code = 'a = "x // \\" y"; // c\n/* d\n e */ char q = \'"\'; String t = """z\n"q" """; b();'
    out = java.mask(code)
    assert len(out) == len(code) and out.count("\n") == code.count("\n")
    assert "".join(out.split()) == "a=;charq=;Stringt=;b();"


FILE = """package a.b;
import static org.junit.Assert.*;
import org.junit.Test;
class FooTest {
  private Foo make() { return new Foo(); }
  @Test public void shouldParseHTTP2_response() { Foo f = make(); assertEquals(3, f.x(1, 2)); assertTrue(f.a == f.b); }
  @Test
  public void testOther() throws Exception { try { new Foo().y(); fail("no"); } catch (Exception e) { } }
  void nothing(String s) { if (s == null) { run(() -> { }); } }
}"""


def test_methods_and_sites(spark):
    found = java.methods(FILE)
    assert [m[0] for m in found] == ["make", "shouldParseHTTP2_response", "testOther", "nothing"]
    assert [java.is_test(n, a) for n, a, _ in found] == [False, True, True, False]
    sites = lambda code: [tuple(x) for x in value(spark, java.sites_column(F.lit(code)))]
    assert sites(FILE) == [("junit", "junit:assert_equals:binary"), ("junit", "junit:assert_true:comparison"), ("junit", "junit:fail")]
    assert sites("import org.assertj.core.api.Assertions.assertThat;\nassertThat(v).isNotNull().isEqualTo(3);") == [("assertj", "assertj:isEqualTo")]
    assert sites("Truth.assertThat(v).isEqualTo(3);") == [("truth", "truth:isEqualTo")]
    assert sites('String u = "https://x"; fail("a");') == [("junit", "junit:fail")]
    assert sites("m.perform(x).andExpect(status().isOk());") == [("spring_mockmvc", "spring_mockmvc:status")]
    assert sites("import org.hamcrest.Matchers;\nassertThat(v, is(not(w))); assertThat(ok); other.fail(); a.andExpect;") == [("hamcrest", "hamcrest:is"), ("hamcrest", "hamcrest:assert_that")]
    assert sites("assertWithMessage(m).that(x).isTrue(); Assertions.assertAll(() -> assertTrue(a && b), () -> assertFalse(x.isOpen())); assertNull(a, b); assertEquals(f(1, 2), new int[] {1, 2}, g)") == [
        ("truth", "truth:isTrue"), ("junit", "junit:assert_all:arity_2"), ("junit", "junit:assert_true:compound"), ("junit", "junit:assert_false:predicate"), ("junit", "junit:assert_null:arity_2"), ("junit", "junit:assert_equals:extended"),
    ]
    assert value(spark, java.sites_column(F.lit(None).cast("string"))) is None and sites("assertTrue(") == [("junit", "junit:assert_true:condition")]
    smells = lambda body: value(spark, java.smells_column(F.lit(body)))
    assert smells(found[1][2]) == ["assertion_roulette", "magic_number_test"]
    assert smells(found[2][2]) == ["exception_handling"]
    assert smells("{ if (x) { assertEquals(a.toString(), b); assertEquals(a.toString(),\n b); } }") == ["assertion_roulette", "conditional_test_logic", "duplicate_assert", "sensitive_equality"]
    assert smells("{ run(); }") == ["unknown_test"] and smells("{ assertTrue(f(-1, 0L, 2)) }") == []
    assert java.zero_argument_methods(FILE) == ["shouldParseHTTP2_response", "testOther"]
    assert java.code_lines("a();\n// b\n/* c\n d */ e();\n")[:4] == [True, False, False, True]


def test_outline_of_odd_texts():
    assert java.methods("class A { A() { } int f(int a) throws E, F { } int[] g = {h(1)}; <T> List<T> i(@N T t) { return j(); } }") == [("f", [], "{ }"), ("i", [], "{ return j(); }")]
    assert java.methods("class A { @X int a; @Test void b() { c(); } class N { void inner() { } } @Y(z = {1, 2}) void d() { } }") == [("b", ["Test"], "{ c(); }"), ("inner", [], "{ }"), ("d", ["Y"], "{ }")]
    assert java.methods("class A { void open() { if (a) {") == [("open", [], "{ if (a) {")]
    for code in ("", "}}}", ")))", "((((", "class {", "@", "a.b.(", "f(])"):
        assert java.methods(code) == [] and java.members(code) == []
    (call,) = java.calls(java.outline("x = f(a, g(b, c), {d, e}, (h, i)).j(k);"), "f")
    assert (call["arguments"], call["terminal"], call["lead"]) == (["a", "g(b, c)", "{d, e}", "(h, i)"], "j", " ")


def test_longest_common():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (rng.choices("abc", k=rng.randint(0, 12)) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert java.longest_common(a, b) == table[-1][-1]


def profile(spark, candidate, reference):
    return conventions.profile(spark.createDataFrame([(candidate, reference)], "candidate string, reference string")).first()


def suite(*bodies, extra=""):
    return "class T {\n" + "\n".join(b if b.startswith("@") else f"@Test public void test{chr(65 + i)}x() {{ {b} }}" for i, b in enumerate(bodies)) + f"\n{extra}\n}}"


def test_conventions(spark):
    two = profile(spark, suite("m.andExpect(status().isOk());"), suite("m.andExpect(status().isOk());", "m.andExpect(content().x());"))
    assert two["assertion_conformance"] == 0.75
    half = profile(spark, suite("assertTrue(a == b);"), suite("assertEquals(a, b);"))
    assert half["assertion_conformance"] == 0.5
    mix = profile(spark, suite(*["assertEquals(a, b);"] * 1, *["assertTrue(a);"] * 3), suite(*["assertEquals(a, b);"] * 3, "assertTrue(a);"))
    assert (mix["assertion_family"], mix["assertion_idiom"]) == (1.0, 0.5)
    none = profile(spark, suite("x();"), suite("y();"))
    assert none["assertion_conformance"] is None
    helpers = profile(spark, suite("new Foo();"), suite("make();", extra="Foo make() { return new Foo(); }"))
    assert helpers["fixture_reuse"] == 0.0
    empty = profile(spark, "class A {}", suite("y();"))
    assert empty["naming_conformance"] == 0.0
    numbered = profile(spark, "class A { @Test public void test17() { } }", suite("y();"))
    assert numbered["naming_clarity"] == 0.0
    imports = profile(spark, "import a.B;\nimport c.*\nclass A {}", "import a.B;\nclass A {}")
    assert imports["import_conformance"] == 0.5
    shape = value(spark, text.name_shape(F.lit("shouldParseHTTP2_response")))
    assert (shape["prefix"], shape["separator"]) == ("should", "underscore")


def test_smell_totals(spark):
    rows = conventions.smell_totals(spark.createDataFrame([(1, FILE), (2, "class A {}")], "doc_id int, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert (rows[0]["methods"], rows[0]["smells"], rows[0]["density"], rows[0]["smelly_ratio"]) == (2, 3, 1.5, 1.0)
    assert rows[1]["methods"] == 0 and rows[1]["density"] is None


def test_logs(spark):
    known = {
        "": "no_javac_output", "x: error: cannot find symbol\npackage a.b does not exist": "missing_symbol_and_package", "cannot find symbol": "missing_symbol", "package A.b does not exist": "missing_package",
        "class file for a.B not found": "missing_class_file", "duplicate class: a": "duplicate_class", "x has private access in y": "access_error", "';' expected": "syntax_error", "odd": "other_compile_error",
    }
    rows = spark.createDataFrame(list(known.items()), "log string, want string").select("want", classify.compile_problem(F.col("log")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)
    assert value(spark, classify.run_failure(F.lit("java.lang.ClassNotFoundException: a.T"), F.lit("a.T"))) == "not_compiled"
    assert value(spark, classify.run_failure(F.lit("java.lang.ClassNotFoundException: a.U"), F.lit("a.T"))) == "missing_runtime_dependency"
    assert value(spark, classify.build_failure(F.lit("Release version 21 not supported"))) == "JDK_TOO_OLD"
    assert value(spark, classify.api_error(F.lit("No commit found for SHA: 1"))) == "no_commit_found"
    assert value(spark, classify.error_tail(F.lit("a\nERROR b\nc\nd failed"))) == "ERROR b\nd failed"
    assert tuple(value(spark, classify.runner_summary(F.lit("started=3 skipped=1 failed=0")))) == (3, 1, 0)
    logs = spark.createDataFrame([(1, "miss a.B\nmiss c.D\nmiss a.B")], "id int, text string")
    got = classify.entities(logs, ["id"], "text", {"miss": r"miss (\S+)"}).orderBy("position").collect()
    assert [(r["entity"], r["position"]) for r in got] == [("a.B", 0), ("c.D", 1)]
    assert value(spark, scalars.first_tagged(F.lit("x [TEST] a [/TEST] ```b```"), "TEST")) == "a"
    assert value(spark, scalars.first_tagged(F.lit("x ```java\nb\n```"), "TEST")) == "b"
    assert value(spark, scalars.first_tagged(F.lit("x"), "TEST")) is None


def test_greedy_filter_equals_the_loop(spark):
    rng = random.Random(9)
    for _ in range(3):
        base = {rng.randrange(40) for _ in range(8)}
        sets = [{rng.randrange(40) for _ in range(rng.randint(0, 8))} for _ in range(12)]
        held, kept = set(base), []
        for i, s in enumerate(sets):
            if s - held:
                kept.append(i)
                held |= s
        rows = spark.createDataFrame([(i, u) for i, s in enumerate(sets) for u in s], "seq int, unit int")
        got = coverage.incremental_filter(rows, spark.createDataFrame([(u,) for u in base], "unit int"), ["unit"], "seq").collect()
        assert sorted(r["candidate"] for r in got) == kept


def test_statistics(spark):
    for n, want in ((14, 1.22e-4), (25, 5.96e-8), (57, 1.39e-17)):
        assert statistics.exact_p([1.0] * n) == pytest.approx(2.0 ** (1 - n)) == pytest.approx(want, rel=0.01)
    d = [1, -2, 2, 3, -1, 4, 0]
    ranks = {1: 1.5, 2: 3.5, 3: 5, 4: 6}
    pattern = [ranks[abs(x)] for x in d if x]
    sums = [sum(r for r, s in zip(pattern, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=6)]
    low = min(sum(ranks[abs(x)] for x in d if x > 0), sum(ranks[abs(x)] for x in d if x < 0))
    assert statistics.exact_p(d) == pytest.approx(2 * sum(s <= low for s in sums) / len(sums))
    frame = spark.createDataFrame([("g", i, s) for i, s in enumerate((1, 1, 2, 3))] + [("g", i, s) for i, s in enumerate((1, 2, 2, 3))], "g string, item int, score int").withColumn("rater", F.lit("r"))
    units, scores = 4, (1, 1, 2, 3, 1, 2, 2, 3)
    f = {s: scores.count(s) for s in set(scores)}

    def distance(a, b):
        lo, hi = min(a, b), max(a, b)
        return (sum(v for k, v in f.items() if lo <= k <= hi) - (f[a] + f[b]) / 2) ** 2

    pairs = list(zip(scores[:units], scores[units:], strict=True))
    observed = sum(2 * distance(a, b) for a, b in pairs)
    expected = sum(distance(a, b) for a, b in itertools.permutations(scores, 2)) / (len(scores) - 1)
    got = statistics.alpha_ordinal(frame, ["g"], "item", "rater", "score").first()
    assert got["n_items"] == 4 and got["alpha"] == pytest.approx(1 - observed / expected)
    ci = statistics.bootstrap_ci(spark.range(400).selectExpr("'g' g", "id", "cast(id % 10 as double) v"), ["g"], "id", "v").first()
    assert ci["low"] < 4.5 < ci["high"] and ci["high"] - ci["low"] < 1
    flat = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.0, 3.0)], "g string, x double, y double")
    assert statistics.spearman(flat, ["g"], "x", "y").first()["rho"] is None


def test_scalars(spark):
    assert value(spark, scalars.percent_text(F.lit(12.50))) == "12.5" and value(spark, scalars.percent_text(F.lit(3.0))) == "3"
    assert value(spark, scalars.split_list(F.lit(" a;b|; c "))) == ["a", "b", "c"] and value(spark, scalars.split_list(F.lit("null"))) == []
    assert value(spark, scalars.ordering(["A", "B", "C"], [F.lit(2.0), F.lit(3.0), F.lit(2.0)])) == "B > A = C"
    versions = ["1.10", "1.9", "1.9-rc", "2"]
    rows = spark.createDataFrame([(v,) for v in versions], "v string").orderBy(scalars.version_key(F.col("v"))).collect()
    assert [r["v"] for r in rows][-1] == "2" and [r["v"] for r in rows].index("1.9") < [r["v"] for r in rows].index("1.10")
    assert value(spark, ranges.decode(F.lit("5-3;x;9;0"))) == [3, 4, 5, 9] and value(spark, ranges.encode(F.array(*map(F.lit, (3, 4, 5, 9))))) == "3-5;9"
    assert tuple(value(spark, ranges.bounds(F.lit("7-9;2")))) == (2, 9)
    assert value(spark, scalars.status_from_flags(F.lit(1), F.lit(1), F.lit(0))) == "timeout"
    assert value(spark, scalars.target_id(F.lit("a/b"), F.lit("c.D"))) == "a_b_c_D"
    assert value(spark, text.balanced(F.lit("a { b { } }"))) and not value(spark, text.balanced(F.lit("a } {")))
    assert value(spark, text.fqcn_of_path(F.lit("m/src/main/java/a/b/C.java"))) == "a.b.C"
    assert value(spark, F.lit("org/x-1").rlike(text.glob_to_regex("org/?-*")))
    assert value(spark, scalars.unbase64_text(F.lit("aGk="))) == "hi"
    assert value(spark, scalars.unbase64_text(F.lit("Y2Fm6SB4"))) == "caf x" and value(spark, scalars.unbase64_text(F.lit("?"))) is None
    assert value(spark, text.class_of(F.lit("class A {} class B {}"), F.lit("B"))) == "B"
    assert value(spark, text.strip_comments_keep_strings(F.lit('a "//x" // y'))) == 'a "//x" '


def test_selection_and_matching(spark):
    for path, want in (("a/src/test/java/X.java", "test"), ("a/src/main/X.java", "source"), ("a/X.java", None), ("core-tests/src/X.java", "test"), ("a/src/X.txt", None)):
        assert value(spark, selection.path_kind(F.lit(path))) == want
    arrays = [F.array(*map(F.lit, x)) for x in (("parse", "date"), ("parse", "time"))]
    calls = [F.array(F.lit("run")), F.array(F.lit("run"))]
    got = value(spark, matching.semantic_score(tuple(arrays), tuple(calls), tuple(calls), tuple(arrays)))
    assert got == pytest.approx(0.4 / 3 + 0.35 + 0.25 / 3 + 0.27)
    nothing = [F.array(F.lit("a")), F.array(F.lit("b"))]
    assert value(spark, matching.semantic_score(tuple(nothing), tuple(nothing), tuple(nothing), tuple(calls))) == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(9, 3)], "a int, b int")
    seeds = spark.createDataFrame([("x", 3), ("x", 3), ("y", 9), ("z", 77)], "target string, node int")
    assert sorted((r["target"], r["node"]) for r in matching.closure(edges, seeds).collect()) == [("x", 3), ("x", 4), ("x", 5), ("x", 6), ("y", 3), ("y", 4), ("y", 5), ("y", 6), ("y", 9), ("z", 77)]
    ring = spark.createDataFrame([(i, (i + 1) % 40) for i in range(40)], "a int, b int")
    assert matching.closure(ring, spark.createDataFrame([("r", 0), ("s", 7)], "target string, node int")).count() == 80


def test_incremental_states(spark):
    names = "variant target_verified has_row has_target_hit same_class_id same_universe test_status manual_lines combined_lines line_total combined_line_total manual_branches combined_branches branch_total combined_branch_total".split()
    base = dict(zip(names, ("auto", True, True, True, True, True, "passed", 5, 8, 10, 10, 1, 2, 4, 4), strict=True))
    cases = [
        ({}, "measured"), ({"variant": "manual"}, "baseline"), ({"target_verified": False}, "unavailable"), ({"has_row": False}, "unavailable"), ({"has_target_hit": False}, "measured_no_target_hit"),
        ({"same_class_id": False}, "measured_equivalent_target_lines"), ({"same_class_id": False, "same_universe": False}, "incompatible_target_cut"), ({"combined_lines": 4}, "unavailable"), ({"combined_line_total": 9}, "unavailable"),
    ]
    rows = spark.createDataFrame([{**base, **c} | {"want": w} for c, w in cases])
    for r in incremental.status(rows).collect():
        assert r["measurement_status"] == r["want"]
        if r["want"] == "measured":
            assert (r["incremental_lines"], r["incremental_line_percentage"], r["incremental_branches"], r["analysis_eligible"]) == (3, 30.0, 1, True)


def test_budget_and_upsert(spark):
    rows = spark.createDataFrame([("g", 1, 50), ("g", 2, 70), ("g", 3, 10)], "k string, p int, n int")
    assert [(r["p"], r["taken"]) for r in ranking.within_budget(rows, ["k"], ("p",), "n", 100).orderBy("p").collect()] == [(1, 50), (2, 50)]
    assert ranking.clamp_top_n(0) == 1 and ranking.clamp_top_n(500) == 100


def test_sources_text(spark):
    from gaugewright.operators import sources_text as st

    assert value(spark, st.is_test_source(F.lit("A.java"), F.lit("x @Test y"))) and not value(spark, st.is_test_source(F.lit("A.java"), F.lit("x")))
    code = "package a.b;\nclass Foo_ESTest { }"
    assert value(spark, st.matches_target(F.lit(code), F.lit("Foo_ESTest"), F.lit("a.b.Foo")))
    assert not value(spark, st.matches_target(F.lit(code), F.lit("Foo_ESTest"), F.lit("c.Foo")))
    for selector, want in (("a.Foo_ESTest#x", "a.Foo"), ("a.Foo_Sanitized_ESTest#x", "a.Foo"), ("Foo", "Foo"), (" ", None)):
        assert value(spark, st.target_of(F.lit(selector))) == want
    log = "FAILURE in a.T#one\nTest interrupted: a.T#two\n[DROP] a.T#three x fork-exit=1\n[DROP] a.T#four\nFAILURE in b.T#five"
    assert value(spark, st.failed_methods(F.lit(log), "a.T")) == ["one", "three", "two"]
    assert value(spark, st.usable_test_name(F.lit(" goodName "), F.lit("x"))) == "goodName"
    assert value(spark, st.usable_test_name(F.lit("bad;name"), F.lit("x"))) is None and value(spark, st.usable_test_name(F.lit("same_name"), F.lit("same_name"))) is None
    assert value(spark, st.plausible_body(F.lit("try { } catch (E e) { }"))) and not value(spark, st.plausible_body(F.lit("try { }")))
    found = value(spark, st.checked_methods(F.lit("@Test public void a() { x(); } @Test public void b() { if (c) { } @Test public void d() { }")))
    assert [(m["name"], m["valid"]) for m in found] == [("a", True), ("b", False), ("d", True)]
    assert value(spark, st.first_reason((F.lit(False), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(True), "c"))) == "c"
    flows = spark.createDataFrame([("r", "ci.yml", "run: mvn verify"), ("q", "x.txt", "pytest"), ("p", "test.yml", "")], "repo string, name string, content string")
    assert {r["repo"]: (r["test_in_name"], r["test_in_content"], r["runs_tests"]) for r in st.workflow_flags(flows, ["repo"]).collect()} == {"r": (False, True, True), "q": (False, False, False), "p": (True, False, True)}
    spans = spark.createDataFrame([("f", 1, 2), ("f", 5, 6), ("f", 9, 9)], "k string, start int, end int")
    flags = spark.createDataFrame([("f", i, i not in (3, 4)) for i in range(1, 11)], "k string, line int, is_code boolean")
    assert sorted(tuple(r) for r in st.merge_gaps(spans, flags, ["k"]).select("start", "end").collect()) == [(1, 6), (9, 9)]
    held = st.held_out(spark.range(20).selectExpr("'k' k", "id"), ["k"], "id", 5, 10)
    assert {r["n"] for r in held.where("held").groupBy("repeat").agg(F.count("*").alias("n")).collect()} == {5} and held.count() == 200
    uses = st.declares(F.lit("class A {\n  private Foo f = null;\n  @BeforeEach void x() {\n    a.b.Foo g = null;\n"))
    assert all(value(spark, c) for c in uses.values())


def test_members_and_quality(spark):
    from gaugewright.operators import sources_text as st

    code = "class A {\n int[] xs = {1, 2};\n @Foo(a = 1) private Map<String, B> m;\n static { run(); }\n void f(int a, B<C, D> b) { if (a > 1 && b != null) { } }\n enum K { X }\n class N { void g() { } }\n}"
    assert [k for k, _ in java.members(code)][:4] == ["field:xs", "field:m", "block:2", "method:f/2"]
    assert {"type:K", "type:N", "method:g/0"} <= {k for k, _ in java.members(code)}
    assert value(spark, java.complexity(F.lit("{ if (a && b) { } for (;;) { } }"))) == 4
    got = conventions.quality(spark.createDataFrame([(1, code), (2, "")], "doc_id int, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert (got[0]["functions"], got[0]["complexity"]) == (2, 4) and got[1]["mean_complexity"] is None
    logs = spark.createDataFrame([(1, "src/A.java:5: error: package x.y does not exist\n  symbol:   class Foo\nsrc/A.java:9: error: z\nsrc/A.java:5: error: w")], "id int, text string")
    errors = st.error_locations(logs, ["id"])
    assert {(r["file"], r["line"]) for r in errors.collect()} == {("src/A.java", 5), ("src/A.java", 9)}
    spans = spark.createDataFrame([(1, "src/A.java", "f", 3, 6), (1, "src/A.java", "g", 7, 8)], "id int, file string, name string, start int, end int")
    assert [r["name"] for r in st.methods_hit(spans, errors, ["id"]).collect()] == ["f"]
    assert [(r["symbol"], r["packages"]) for r in st.package_hints(logs, ["id"]).collect()] == [("Foo", ["x.y"])]


def test_bootstrap_of_ordinal_alpha(spark):
    rows = [("g", i, r, (i % 5) + (1 if (i * 7 + r * 3) % 11 < 3 else 0)) for i in range(80) for r in range(3)] + [("same", i, r, i % 4) for i in range(40) for r in range(2)]
    frame = spark.createDataFrame(rows, "g string, item int, rater int, score int")
    alpha = {r["g"]: r["alpha"] for r in statistics.alpha_ordinal(frame, ["g"], "item", "rater", "score").collect()}
    got = {r["g"]: (r["low"], r["high"]) for r in statistics.alpha_ordinal_ci(frame, ["g"], "item", "rater", "score", 100).collect()}
    assert got["same"] == (1.0, 1.0)
    low, high = got["g"]
    assert low < alpha["g"] < high and 0.005 < high - low < 0.3
    again = statistics.alpha_ordinal_ci(frame.repartition(3), ["g"], "item", "rater", "score", 100).where("g = 'g'").first()
    assert (again["low"], again["high"]) == pytest.approx((low, high))


def test_normal_tail(spark):
    import math

    zs = [0.0, 0.1, -0.5, 1.0, 1.96, -3.0, 4.2, 4.3, -6.0, 12.0, 30.0, None]
    got = spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").withColumn("p", statistics.normal_p(F.col("z"))).orderBy("i").collect()
    for r, z in zip(got, zs, strict=True):
        want = None if z is None else math.erfc(abs(z) / math.sqrt(2))
        assert r["p"] == want if z is None else abs(r["p"] - want) <= 1e-14 + 1e-9 * want


def test_quantiles_without_buffers(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 9), rng.random() * 5])) for _ in range(400)] + [("c", None), ("d", 2.5)]
    rows = [(k, None if v is None else float(v)) for k, v in rows]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in statistics.quartiles(frame, ["k"], "v").collect()}
    for k in ("a", "b", None, "d"):
        own = [v for g, v in rows if g == k and v is not None]
        for name, p in (("q1", 25), ("median", 50), ("q3", 75)):
            assert got[k][name] == pytest.approx(np.percentile(own, p))
        assert got[k]["n"] == len(own)
    assert (got["c"]["n"], got["c"]["median"]) == (0, None)
    assert statistics.signs(frame, ["k"], "v").where("k = 'd'").first()["median"] == 2.5


def test_quantiles_of_large_groups(spark):
    """Groups beyond ACCURACY: ties, skewed values, a constant group, and no keys at all."""
    import numpy as np

    rows = spark.range(30_000).selectExpr("case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' else null end k", "case when id % 3 = 0 then cast(id * id % 7919 as double) / 3 when id % 3 = 1 then 4.0 else exp(cast(id as double) / 3000) end v")
    data = [(r["k"], r["v"]) for r in rows.collect()]
    ps = {"low": 0.0, "q1": 0.25, "median": 0.5, "most": 0.999, "top": 1.0}
    got = {r["k"]: r for r in statistics.quantiles(rows, ["k"], "v", ps).collect()}
    for k in ("a", "b", None):
        own = [v for g, v in data if g == k]
        for name, p in ps.items():
            assert got[k][name] == pytest.approx(np.percentile(own, 100 * p), rel=1e-12), (k, name)
    (every,) = statistics.quantiles(rows, [], "v", ps).collect()
    assert every["median"] == pytest.approx(np.percentile([v for _, v in data], 50))


def test_wilcoxon_of_many_pairs(spark):
    rng = random.Random(6)
    d = [round(rng.gauss(0.02, 1), 2) for _ in range(1200)]
    got = statistics.wilcoxon_exact(spark.createDataFrame([("g", x) for x in d], "g string, d double"), ["g"], "d").first()
    z = statistics.wilcoxon_sums(spark.createDataFrame([("g", x) for x in d], "g string, d double"), ["g"], "d").withColumn("p", statistics.normal_p(F.col("z"))).first()
    assert got["n"] == sum(x != 0 for x in d) and abs(got["p"] - z["p"]) < 0.002


def test_similar_pairs_by_prefixes(spark):
    rng = random.Random(9)
    sets = [sorted({rng.choice("aaaabbbbccccdefghijklmnop") for _ in range(rng.randint(1, 9))}) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(sets)), "i int, a array<string>")
    for least in (0.01, 0.3, 0.5, 0.8, 1.0):
        got = {(r["x"], r["y"]): r["jaccard"] for r in matching.jaccard_pairs(frame.withColumnRenamed("i", "x"), frame.withColumnRenamed("i", "y"), "x", "y", "a", least).collect()}
        want = {}
        for i, j in itertools.product(range(60), repeat=2):
            both = len(set(sets[i]) & set(sets[j]))
            if both and both / len(set(sets[i]) | set(sets[j])) >= least:
                want[i, j] = both / len(set(sets[i]) | set(sets[j]))
        assert got == pytest.approx(want)


def test_long_line_specs(spark):
    lines = [x for x in range(1, 120_000) if x % 7 and x % 11]
    want, start = [], None
    for x in lines:
        if start is None or x != last + 1:
            if start is not None:
                want.append(f"{start}-{last}" if start != last else str(start))
            start = x
        last = x
    want.append(f"{start}-{last}" if start != last else str(start))
    rows = spark.createDataFrame([(lines[::-1] + lines[:9],), ([],)], "a array<int>")
    got = rows.select(ranges.encode(F.col("a")).alias("s")).collect()
    assert got[0]["s"] == ";".join(want) and got[1]["s"] == ""
    wide = F.lit("1-2000000000;5;1999999999-2000000001;x")
    assert value(spark, ranges.line_count(wide)) == 2_000_000_001
    assert [tuple(s) for s in value(spark, ranges.merged_spans(F.lit("9;0-2;4;3;7-8"), False))] == [(0, 4), (7, 9)]
    assert [tuple(s) for s in value(spark, ranges.merged_spans(F.lit("0;9;0-2")))] == [(1, 2), (9, 9)] and value(spark, ranges.merged_spans(F.lit(None))) == []
    rows = spark.createDataFrame([("t", "C", "1-2000000000", "5"), ("t", "C$A", "1999999999-2000000001", ""), ("u", "C", "", "x"), ("u", "D", "1", "")], "k string, class_name string, newly_covered_lines string, upgraded_to_full_lines string")
    assert [tuple(r) for r in stages.target_lines(rows, ["k"], F.lit("C")).collect()] == [("t", 2_000_000_001)]
    assert [tuple(r) for r in stages.target_percentage(rows, ["k"], F.lit("C"), F.lit(4_000_000_006)).collect()] == [("t", pytest.approx(100 * 2_000_000_003 / 4_000_000_006))]
    deltas = stages.method_deltas(spark.createDataFrame([("t",)], "k string"), rows, ["k"], F.lit("C"))
    assert deltas.first()["target_added_lines"] == 2_000_000_003
    with pytest.raises(Exception, match="more than"):
        value(spark, ranges.decode(wide))


def test_extremes_of_null_orders(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 3, 3), ("b", None, 4)], "k string, seq int, v int")
    assert {r["k"]: r["v"] for r in ranking.first_wins(rows, ["k"], "seq").collect()} == {"a": 3, "b": 4}
    assert {r["k"]: r["v"] for r in ranking.last_wins(rows, ["k"], "seq").collect()} == {"a": 2, "b": 4}


def test_alpha_of_many_ratings(spark):
    """Places are far from zero: sums of squares must not swallow the differences."""
    rows = spark.range(40_000).selectExpr("'g' g", "id div 2 item", "id % 2 rater", "cast((id div 2) % 3 + if(id % 20 = 1, 1, 0) as int) score")
    few = spark.range(400).selectExpr("'g' g", "id div 2 item", "id % 2 rater", "cast((id div 2) % 3 + if(id % 20 = 1, 1, 0) as int) score")
    many, some = (statistics.alpha_ordinal(r, ["g"], "item", "rater", "score").first()["alpha"] for r in (rows, few))
    assert 0.5 < some < 1 and abs(many - some) < 0.02


def test_registered_functions(spark):
    from gaugewright.functions import registered

    registered.register(spark)
    spark.createDataFrame([(1, FILE)], "id int, code string").createOrReplaceTempView("registered_sources")
    names = spark.sql("select id, m.name from registered_sources, lateral test_method_bodies(code) m").collect()
    assert [r["name"] for r in names] == ["shouldParseHTTP2_response", "testOther"]
    calls = spark.sql("select c.name, c.arguments from registered_sources, lateral assertion_sites(code) c").collect()
    assert [(r["name"], len(r["arguments"])) for r in calls] == [("assertEquals", 2), ("assertTrue", 1), ("fail", 0)]
    assert [r["line"] for r in spark.sql("select * from explode_ranges('9;3-5;4-6;x;0')").collect()] == [3, 4, 5, 6, 9]
    assert spark.sql("select java_mask('a // b') m, common_length(array('a', 'b'), array('b')) n").first()["n"] == 1


def test_scores_of_ngrams(spark):
    from gaugewright.operators import reports

    score = lambda a, b, **k: value(spark, reports.ngram_score(F.split(F.lit(a), " "), F.split(F.lit(b), " "), **k))
    assert score("a b c d e", "a b c d e") == pytest.approx(1.0) and score("x y", "a b") == 0
    assert 0 < score("a b c x", "a b c d") < 1
    assert score("if x", "if y", weights={"if": 5.0}, most=1) == pytest.approx(5 / 6) and score("if x", "if y", most=1) == pytest.approx(0.5)
    assert value(spark, reports.ngram_score(F.array().cast("array<string>"), F.array(F.lit("a")))) is None


def test_best_matches_with_copies(spark):
    rng = random.Random(4)
    sets = [sorted({rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 7))}) for _ in range(40)]
    sets += [sets[0]] * 5 + [sets[1], []]
    frame = spark.createDataFrame(list(enumerate(sets)), "x int, a array<string>").repartition(4)
    got = {r["x"]: (r["y"], r["jaccard"], r["margin"]) for r in matching.best_matches(frame, frame.withColumnRenamed("x", "y"), "x", "y", "a", 0.3, but_itself=True).collect()}
    for i, a in enumerate(sets):
        alike = sorted((-len(set(a) & set(b)) / len(set(a) | set(b)), j) for j, b in enumerate(sets) if i != j and a and len(set(a) & set(b)) >= 0.3 * len(set(a) | set(b)))
        if not alike:
            assert i not in got
            continue
        best, second = alike[0], alike[1] if len(alike) > 1 else (0, None)
        assert got[i] == (best[1], pytest.approx(-best[0]), pytest.approx(second[0] - best[0])), i
    with pytest.raises(ValueError):
        matching.jaccard_pairs(frame, frame.withColumnRenamed("x", "y"), "x", "y", "a", 0.0)


def test_semantic_matches(spark):
    """Bounds lose no match: every pair scored, as a plain loop has it."""
    rng = random.Random(11)
    some = lambda alphabet, n: sorted({rng.choice(alphabet) for _ in range(rng.randint(0, n))})

    def made(ids):
        for i in ids:
            calls = some(["aa", "ab", "ba", "bb", "ca", "cb"], 4)
            yield i, rng.choice(["p", "q"]), some("nmopqr", 3), calls, sorted({c[0] for c in calls}), some("abcdefgh", 6)

    kind = "id int, k string, name array<string>, calls array<string>, call_words array<string>, body array<string>"
    left, right = list(made(range(25))), list(made(range(100, 130)))
    frames = [spark.createDataFrame(rows, kind).withColumnRenamed("id", name) for rows, name in ((left, "x"), (right, "y"))]
    got = {r["x"]: r for r in matching.semantic_matches(*frames, "x", "y", ["k"]).collect()}
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0

    def score(a, b):
        share = [bool(set(a[i]) & set(b[i])) for i in (2, 3, 4)]
        if not any(share):
            return 0.0
        return min(1.0, 0.4 * like(a[2], b[2]) + 0.35 * max(like(a[3], b[3]), like(a[4], b[4])) + 0.25 * like(a[5], b[5]) + (0.27 if share[0] and share[1] else 0))

    for a in left:
        found = sorted((-score(a, b), b[0], b) for b in right if a[1] == b[1] and score(a, b) >= 0.35)
        if not found:
            assert a[0] not in got
            continue
        best, margin = -found[0][0], -found[0][0] + (found[1][0] if len(found) > 1 else 0)
        both = bool(set(a[2]) & set(found[0][2][2])) and bool(set(a[3]) & set(found[0][2][3]))
        r = got[a[0]]
        assert (r["y"], r["score"], r["margin"]) == (found[0][1], pytest.approx(best), pytest.approx(margin))
        assert r["accepted"] == (best >= 0.5 or (best >= 0.4 and margin >= 0.05 and both))
    unique = matching.one_to_one(spark.createDataFrame([(r["k"], r["x"], r["y"], r["score"]) for r in got.values()], "k string, x int, y int, score double"), ["k"], "x", "y", "score")
    assert unique.count() == len({(r["k"], r["y"]) for r in got.values()})


def test_semantic_matches_of_many_tiles(spark, monkeypatch):
    """Groups of several blocks, small groups and null keys; of each tile come two rights of a left, whatever scores enough."""
    for name, n in (("ROWS", 16), ("FEW", 1), ("STRIP", 5)):
        monkeypatch.setattr(matching, name, n)
    rng = random.Random(13)
    some = lambda alphabet, least, n: rng.sample(alphabet, rng.randint(least, n))
    kind = "id int, k string, name array<string>, calls array<string>, call_words array<string>, body array<string>"
    rows = [(i, rng.choice(["p"] * 12 + ["q", "r", None]), some("nmo", 1, 3), some("uvw", 0, 3), some("xy", 0, 2), some("abcdefgh", 0, 6)) for i in range(160)]
    frames = [spark.createDataFrame([r for r in rows if r[0] % 2 == side], kind).withColumnRenamed("id", name) for side, name in ((0, "x"), (1, "y"))]
    out = matching.semantic_matches(*frames, "x", "y", ["k"])
    got = {r["x"]: (r["k"], r["y"], pytest.approx(r["score"]), pytest.approx(r["margin"])) for r in out.collect()}
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0
    want = {}
    for a in rows[::2]:
        found = []
        for b in rows[1::2]:
            share = [bool(set(a[i]) & set(b[i])) for i in (2, 3, 4)]
            score = 0.4 * like(a[2], b[2]) + 0.35 * max(like(a[3], b[3]), like(a[4], b[4])) + 0.25 * like(a[5], b[5]) + (0.27 if share[0] and share[1] else 0)
            if a[1] and a[1] == b[1] and any(share) and score >= 0.35:
                found.append((-min(1.0, round(score, 12)), b[0]))
        if found:
            best, second = (sorted(found) + [(0, None)])[:2]
            want[a[0]] = (a[1], best[1], -best[0], second[0] - best[0])
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode(__x_" not in plan and "SortMergeJoin" not in plan


def test_pairs_of_many_blocks(spark, monkeypatch):
    """Blocks and strips of a few sets each: every pair once, whichever tile it lies in."""
    monkeypatch.setattr(matching, "SETS", 7)
    monkeypatch.setattr(matching, "STRIP", 3)
    rng = random.Random(12)
    sets = [sorted({rng.choice("aaaabbbbccccdefghijklmnop") for _ in range(rng.randint(1, 12))}) for _ in range(50)]
    x = spark.createDataFrame(list(enumerate(sets)), "__c int, __set array<string>")
    y = x.select("__c", "__set")
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = sorted((i, j, like(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if like(a, b) >= 0.3)
    for other in (x, y):
        assert sorted(map(tuple, matching.set_pairs(x, other, 0.3).collect())) == want


def test_strips_of_unlike_texts():
    """Sets that share too little with a whole strip are not compared with its sets; those that are share what they share."""
    import numpy as np
    import pyarrow as pa

    from gaugewright.functions import overlaps

    rng = random.Random(6)
    texts = [[rng.sample(range(k * 100, k * 100 + 60), 20) + [7000, 7001] for _ in range(30)] for k in (1, 2)]
    strips = lambda: [s for (s,) in overlaps._strips([pa.array(t, pa.list_(pa.int32())) for t in texts], 30)]
    of_a, of_b, shared = overlaps._near(*strips(), 0.15)
    assert not len(of_a) and not len(of_b) and not shared.size
    texts[1][4] = texts[0][3]
    a, b = strips()
    of_a, of_b, shared = overlaps._near(a, b, 0.15)
    assert b.rows[of_b].tolist() == [4] and 3 in a.rows[of_a]
    assert shared[:, 0].tolist() == [len(set(texts[0][i]) & set(texts[1][4])) for i in a.rows[of_a]] and shared.dtype == np.float32


def test_tiles_give_the_best_alone(spark, monkeypatch):
    """Sets alike by chance are quadratic in number: of each tile come three others of a set, the best of all among them."""
    monkeypatch.setattr(matching, "SETS", 40)
    monkeypatch.setattr(matching, "STRIP", 16)
    found, whole = [], matching.numbered_pairs
    monkeypatch.setattr(matching, "numbered_pairs", lambda *a: found.append(whole(*a)) or found[-1])
    rng = random.Random(5)
    sets = [sorted(rng.sample("abcdefgh", 5)) + [f"own{i}"] * (i % 2) for i in range(100)]
    frame = spark.createDataFrame(list(enumerate(sets)), "x int, a array<string>")
    got = {r["x"]: (r["y"], r["jaccard"], r["margin"]) for r in matching.best_matches(frame, frame.withColumnRenamed("x", "y"), "x", "y", "a", 0.2, but_itself=True).collect()}
    for i, a in enumerate(sets):
        best, second = sorted((-len(set(a) & set(b)) / len(set(a) | set(b)), j) for j, b in enumerate(sets) if i != j)[:2]
        assert got[i] == (best[1], pytest.approx(-best[0]), pytest.approx(second[0] - best[0]))
    kinds = len({tuple(a) for a in sets})
    (pairs,) = found
    assert max(r["count"] for r in pairs.groupBy("__x").count().collect()) <= 3 * -(-kinds // 40) and pairs.count() < kinds**2 / 4


def test_anchors_with_one_hash(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("a")).withColumn("h", F.hash("a").bitwiseAND(F.lit(0x7FFFFFFF)))
    same = [a for r in rows.groupBy("h").agg(F.collect_list("a").alias("v")).where("size(v) > 1").collect() for a in r["v"]]
    assert same
    sets = spark.createDataFrame([(1, [*same, "x"]), (2, same[:1])], "i int, __set array<string>")
    got = {r["i"]: r["__set"] for r in matching._numbered(sets)[0].collect()}
    assert len(set(got[1])) == len(same) + 1 and got[2][0] in got[1]


def test_bootstraps_deal_their_items(spark):
    """Items of one small file are dealt to all cores, and the weights are those of the digits as numbers."""
    import hashlib

    limits, term = [math.exp(-1)], math.exp(-1)
    for k in range(1, 12):
        term /= k
        limits.append(limits[-1] + term)
    got = spark.range(3000).select("id", statistics.digest(F.col("id"), F.lit(7)).alias("d")).withColumn("w", statistics.drawn(F.col("d"))).collect()
    assert all(r["w"] == sum(int(hashlib.md5(f"1:7:{r['id']}".encode()).hexdigest()[:8], 16) / (1 << 32) >= x for x in limits) for r in got)
    one = spark.range(400).selectExpr("'g' g", "id", "cast(id % 10 as double) v").coalesce(1)
    for out in (statistics.bootstrap_ci(one, ["g"], "id", "v"), statistics.alpha_ordinal_ci(one, ["g"], "id", "id", "v")):
        assert f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("groups", [10_000, 1])
def test_values_are_not_sent_to_all(spark, tmp_path, monkeypatch, groups):
    """Large groups of a small file: their bounds are sent to the tasks or joined by key, their values never."""
    monkeypatch.setattr(statistics, "EXACT", 50)
    monkeypatch.setattr(statistics, "GROUPS", groups)
    plans, bounded = [], statistics._bounded

    def seen(known, bounds, keys):
        out = bounded(known, bounds, keys)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(statistics, "_bounded", seen)
    spark.range(2000).selectExpr("if(id % 3 = 0, null, id % 3) k", "cast((id * 7) % 1999 as double) v").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    got = {r["k"]: r["m"] for r in statistics.quantiles(rows, ["k"], "v", {"m": 0.5}).collect()}
    want = rows.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()
    assert got == {r["k"]: r["m"] for r in want} and len(plans) >= 3
    joins = [next(line for line in p.splitlines() if "Join" in line) for p in plans]  # the outermost one
    assert all(("SortMergeJoin" in j) if groups == 1 else ("BroadcastHashJoin" in j and "BuildRight" in j) for j in joins)
