"""Java sources made of the driver's columns: lexing, methods, assertions, smells, conventions, names, logs of builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import java, scalars, text
from ..operators import classify, conventions, sources_text, stages
from .registry import query
from .surface_queries import next_names

_LIBS = ("org.assertj.core.api.Assertions", "org.hamcrest.Matchers", "com.google.common.truth.Truth")
_MORE = (
    "assertTrue(f.a == f.b);",
    "assertThat(v).isNotNull().isEqualTo(3);",
    "assertThat(v, is(not(w)));",
    "assertEquals(f.toString(), 7);",
    "if (f.ok()) { m.andExpect(status().isOk()); }",
)


def _pick(values, at):
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(at == i, v).otherwise(out)
    return out


def _sources(t):
    """A test source for each supplier; its imports and one statement go by the supplier's nation."""
    kind = F.col("s_nationkey")
    code = F.concat(
        F.lit("package p.n"), kind, F.lit(";\nimport org.junit.Test;\nimport "), _pick(_LIBS, kind % 3), F.lit(";\nclass S"), F.col("s_suppkey"),
        F.lit('Test {\n  // call "'), F.col("s_name"), F.lit('" here\n  private Foo make(int a) { return new Foo(a); }\n  @Test public void shouldAdd_'), F.col("s_suppkey"),
        F.lit("() { Foo f = make(0); assertEquals(1, f.x(1, 2)); "), _pick(_MORE, kind % 5),
        F.lit(' }\n  @Test\n  public void testOther() throws Exception { try { run(); fail("'), F.col("s_name"),
        F.lit('"); } catch (Exception e) { } }\n  void helper(String s) { if (s == null) { go(() -> { }); } }\n}'),
    )
    return t.supplier.select("s_suppkey", "s_nationkey", "s_name", code.alias("text"))


@query("""
select s_suppkey, 'a = ' || repeat(' ', length(s_name) + 7) || ';' || repeat(' ', 5) || chr(10) || 'b ' || repeat(' ', length(s_nationkey::varchar) + 6) || ' = ' || repeat(' ', 3) || ';' masked, 'true,true,false' code_lines from supplier""")
def java_mask(t):
    code = F.concat(F.lit('a = "x // '), "s_name", F.lit('"; // c\nb /* '), "s_nationkey", F.lit(" */ = '\"';"))
    lines = java.code_lines_column(F.concat(F.lit("x();\ny(); // "), "s_name", F.lit("\n/* "), "s_name", F.lit(" */")))
    return t.supplier.select("s_suppkey", java.mask_column(code).alias("masked"), F.array_join(F.transform(lines, lambda x: x.cast("string")), ",").alias("code_lines"))


@query("""
select s_suppkey, unnest([{'n': 'make', 'a': '', 't': false}, {'n': 'shouldAdd_' || s_suppkey, 'a': 'Test', 't': true}, {'n': 'testOther', 'a': 'Test', 't': true}, {'n': 'helper', 'a': '', 't': false}], recursive := true) from supplier""")
def java_methods(t):
    rows = _sources(t).select("s_suppkey", F.explode(java.methods_column(F.col("text"))).alias("m"))
    return rows.select("s_suppkey", F.col("m.name").alias("n"), F.array_join("m.annotations", ",").alias("a"), F.col("m.is_test").alias("t"))


@query("""
select s_suppkey, 'junit:assert_equals:binary' idiom, (case when s_nationkey % 5 = 3 then 2 else 1 end)::bigint n from supplier
union all select s_suppkey, 'junit:fail', 1 from supplier union all select s_suppkey, 'junit:assert_true:comparison', 1 from supplier where s_nationkey % 5 = 0
union all select s_suppkey, 'spring_mockmvc:status', 1 from supplier where s_nationkey % 5 = 4
union all select s_suppkey, case s_nationkey % 3 when 0 then 'assertj:isEqualTo' when 1 then 'hamcrest:assert_that' else 'truth:isEqualTo' end, 1 from supplier where s_nationkey % 5 = 1
union all select s_suppkey, case s_nationkey % 3 when 0 then 'assertj:assert_that' when 1 then 'hamcrest:is' else 'truth:assert_that' end, 1 from supplier where s_nationkey % 5 = 2""")
def java_assertion_sites(t):
    rows = _sources(t).select("s_suppkey", F.explode(java.sites_column(F.col("text"))).alias("s"))
    return rows.groupBy("s_suppkey", F.col("s.idiom").alias("idiom")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with s as (select s_suppkey, s_nationkey % 5 k from supplier)
select s_suppkey, 2::bigint methods, (case when k in (0, 1, 2, 3) then 1 else 0 end)::bigint assertion_roulette, 1::bigint exception_handling, (case when k = 4 then 1 else 0 end)::bigint conditional_test_logic,
  (case when k in (1, 3) then 1 else 0 end)::bigint magic_number_test, 0::bigint duplicate_assert, 0::bigint unknown_test, (case when k = 3 then 1 else 0 end)::bigint sensitive_equality,
  (1 + case k when 0 then 1 when 1 then 2 when 2 then 1 when 3 then 3 else 1 end)::bigint smells from s""")
def java_smells(t):
    out = conventions.smell_totals(_sources(t), ["s_suppkey"])
    return out.select("s_suppkey", "methods", *java.SMELLS, "smells")


@query("""
select s_suppkey, 10::int loc, 4::int functions, (5 + (case when s_nationkey % 5 = 4 then 1 else 0 end) + 1)::int complexity from supplier""")
def java_quality(t):
    """Lines of code without the comment line, functions, and their paths: a handler, a branch, at times another branch."""
    out = conventions.quality(_sources(t), ["s_suppkey"])
    return out.select("s_suppkey", F.col("loc").cast("int").alias("loc"), F.col("functions").cast("int").alias("functions"), F.col("complexity").cast("int").alias("complexity"))


@query("""
select s_suppkey, 0.5::double assertion_family, 1.0::double naming_style, 0.0::double fixture_reuse, 0.5::double import_conformance from supplier""")
def java_conventions(t):
    """A candidate with one JUnit and one AssertJ assertion, a helper's name it never calls, and one of two imports known."""
    reference = F.concat(F.lit("import a.B;\nclass R { void testOne() { assertEquals(1, x); } Foo help"), "s_suppkey", F.lit("() { return null; } }"))
    candidate = F.concat(F.lit("import a.B;\nimport org.assertj.core.C"), "s_suppkey", F.lit(";\nclass C { void testTwo() { assertEquals(1, y); assertThat(z).isNull(); other(new Foo()); } }"))
    out = conventions.profile(t.supplier.select("s_suppkey", candidate.alias("candidate"), reference.alias("reference")))
    return out.select("s_suppkey", "assertion_family", "naming_style", "fixture_reuse", "import_conformance")


@query("""
with p(first, prefix) as (values ('test', 'test'), ('should', 'should'), ('given', 'scenario'), ('when', 'scenario'), ('parse', 'bare'), ('scenario', 'bare'))
select p_partkey, first || 'Http2Response' || p_size || case when p_size > 25 then '_' || p_brand else '' end "name", prefix, case when p_size > 25 then 'underscore' else 'camel' end "separator",
  (2 + (case when prefix = 'bare' then 1 else 0 end) + case when p_size > 25 then 1 else 0 end)::int lexical, prefix || ':' || case when p_size > 25 then 'underscore' else 'camel' end style from part, p""")
def name_shapes(t):
    """Every first word: test, should, given and when are prefixes, others are words like any."""
    first = F.explode(F.array(*map(F.lit, ("test", "should", "given", "when", "parse", "scenario"))))
    rows = t.part.select("p_partkey", "p_size", "p_brand", first.alias("first"))
    name = F.concat("first", F.lit("Http2Response"), "p_size", F.when(F.col("p_size") > 25, F.concat(F.lit("_"), "p_brand")).otherwise(""))
    rows = rows.select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", "name", text.name_shape(F.col("name")).alias("s"), conventions.name_style(F.col("name")).alias("style")).select("p_partkey", "name", "s.*", "style")


@query("""
select s_suppkey, 'p.n' || s_nationkey package, 'S' || s_suppkey || 'Test' class, 4 junit, 'p.n' || s_nationkey || '.S' || s_suppkey target, 'a.b.S' || s_suppkey fqcn, 'Foo' || 'Bar' || s_suppkey camel,
  'o_r-' || s_suppkey dir, 'a_b-' || s_suppkey safe, s_name decoded, 'make,helper' helpers from supplier""")
def java_identities(t):
    rows = _sources(t)
    code, key = F.col("text"), F.col("s_suppkey")
    helpers = F.transform(F.filter(java.methods_column(code), lambda m: ~m["is_test"]), lambda m: m["name"])
    return rows.select(
        "s_suppkey",
        text.package_of(code).alias("package"),
        text.class_of(code, F.concat(F.lit("S"), key, F.lit("Test"))).alias("class"),
        text.junit_version(code).alias("junit"),
        sources_text.target_of(F.concat(F.lit("p.n"), "s_nationkey", F.lit(".S"), key, F.lit("_ESTest#test0"))).alias("target"),
        text.fqcn_of_path(F.concat(F.lit("x/src/main/java/a/b/S"), key, F.lit(".java"))).alias("fqcn"),
        text.kebab_to_camel(F.concat(F.lit("foo-bar"), key)).alias("camel"),
        scalars.repo_to_dir(F.concat(F.lit("o/r-"), key)).alias("dir"),
        scalars.safe_name(F.concat(F.lit("a :b-"), key)).alias("safe"),
        scalars.unbase64_text(F.base64(F.encode("s_name", "UTF-8"))).alias("decoded"),
        F.array_join(helpers, ",").alias("helpers"),
    )


@query("""
select s_suppkey, unnest([{'name': 'shouldA' || s_suppkey, 'valid': true}, {'name': 'testB', 'valid': s_nationkey > 5}], recursive := true) from supplier""")
def response_methods(t):
    """Test methods of a response: the second one's braces close only for some."""
    code = F.concat(F.lit("@Test public void shouldA"), "s_suppkey", F.lit("() { x(); } @Test public void testB() { if (c) { y(); }"), F.when(F.col("s_nationkey") > 5, " }").otherwise(""))
    rows = t.supplier.select("s_suppkey", F.explode(sources_text.checked_methods(code)).alias("m"))
    return rows.select("s_suppkey", F.col("m.name").alias("name"), F.col("m.valid").alias("valid"))


@query("""
with f(i, name, marks, t) as (values (0, 'FooTest.java', '', true), (1, 'FooIT.java', '', true), (2, 'Helper.java', 'class Helper { @Test void x() { } }', true), (3, 'Helper.java', 'class Helper { }', false), (4, 'latest.txt', '', false))
select n_nationkey, name, t is_test, name = 'FooTest.java' matches, false scaffolding from nation, f""")
def test_sources(t):
    """Test files by name or by what they hold, and those that belong to a target."""
    kinds = [("FooTest.java", ""), ("FooIT.java", ""), ("Helper.java", "class Helper { @Test void x() { } }"), ("Helper.java", "class Helper { }"), ("latest.txt", "")]
    files = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("code")) for n, c in kinds]))
    rows = t.nation.select("n_nationkey", files.alias("f")).select("n_nationkey", "f.*")
    stem = F.regexp_replace("name", r"\.\w+$", "")
    target = F.when(F.col("name") == "FooTest.java", "FooTest").otherwise("p.Other")
    matches = sources_text.matches_target(F.col("code"), stem, target) & (F.col("name") == "FooTest.java")
    return rows.select("n_nationkey", "name", sources_text.is_test_source(F.col("name"), F.col("code")).alias("is_test"), matches.alias("matches"), sources_text.contains_any(F.col("name"), ("_scaffolding",)).alias("scaffolding"))


def _logs(t):
    """A build's and a run's log for each customer."""
    status = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("FAILURE in a.B#m"), "c_nationkey", F.lit("\n[DROP] a.B#d"), "c_nationkey", F.lit(" x fork-exit=1\n"))).otherwise("ok\n")
    log = F.concat(
        F.lit("src/A.java:"), "c_nationkey", F.lit(": error: package x.y"), "c_nationkey", F.lit(" does not exist\n  symbol:   class Foo\nsrc/A.java:"), "c_nationkey", F.lit(": error: z\n"),
        status, F.lit("tests started="), "c_custkey", F.lit(" skipped=2 failed=1\nCaused by: java.lang.IllegalStateException: bad\n"),
    )
    return t.customer.select("c_custkey", "c_nationkey", "c_acctbal", log.alias("text"))


@query("""
select c_custkey, c_custkey::int started, 2 skipped, 1 failed, case when c_acctbal < 0 then 'd' || c_nationkey || ',m' || c_nationkey else '' end methods, 'Caused by: java.lang.IllegalStateException: bad' detail,
  not c_acctbal < 0 safe, 'src/A.java' file, c_nationkey::int line, 'x.y' || c_nationkey packages from customer""")
def log_facts(t):
    """Summary, failed methods, first telling line, error places and package hints of logs."""
    logs = _logs(t)
    log = F.col("text")
    one = logs.select(
        "c_custkey", classify.runner_summary(log).alias("s"), F.array_join(sources_text.failed_methods(log, "a.B"), ",").alias("methods"), classify.first_line(log, r"^Caused by").alias("detail"),
        classify.safe_assertion_failure(log, ["FAILURE in"], ["started="]).alias("safe"),
    ).select("c_custkey", "s.*", "methods", "detail", "safe")
    places, hints = sources_text.error_locations(logs, ["c_custkey"]), sources_text.package_hints(logs, ["c_custkey"])
    return one.join(places, "c_custkey").join(hints.select("c_custkey", F.array_join("packages", ",").alias("packages")), "c_custkey")


@query("""
select c_custkey, 'type' kind, 'java.lang.IllegalStateException' entity, 0 position from customer
union all select c_custkey, 'method', 'm' || c_nationkey, 0 from customer where c_acctbal < 0""")
def log_entities(t):
    return classify.entities(_logs(t), ["c_custkey"], "text", {"type": r"Caused by: ([\w.]+)", "method": r"FAILURE in [\w.]+#(\w+)"})


@query("""
select s_suppkey, 'f' "name" from supplier where s_nationkey between 3 and 6 union all select s_suppkey, 'g' from supplier where s_nationkey between 7 and 8""")
def methods_with_errors(t):
    spans = t.supplier.select("s_suppkey", F.explode(F.array(*[F.struct(F.lit("A.java").alias("file"), F.lit(n).alias("name"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in (("f", 3, 6), ("g", 7, 8))])).alias("m")).select("s_suppkey", "m.*")
    logs = t.supplier.select("s_suppkey", F.concat(F.lit("A.java:"), "s_nationkey", F.lit(": error: x")).alias("text"))
    return sources_text.methods_hit(spans, sources_text.error_locations(logs, ["s_suppkey"]), ["s_suppkey"]).select("s_suppkey", "name")


@query("""
select s_suppkey, 'import a.B;' || chr(10) || 'x' || s_nationkey || chr(10) || chr(10) || 'y' clean, s_nationkey > 3 whole, case when s_nationkey > 3 then 5 else 0 end score, s_nationkey > 3 life_cycle from supplier""")
def source_sanity(t):
    """Rewrites with repeated imports and blank lines collapsed; braces that close; dependency scores; mechanisms."""
    raw = F.concat(F.lit("import a.B;\nimport a.B;\nz"), "s_nationkey", F.lit("\n\n\n\ny"))
    body = F.when(F.col("s_nationkey") > 3, "@Before { { } }").otherwise("} {")
    tokens = F.when(F.col("s_nationkey") > 3, F.split(F.lit("org acme tool Foo"), " ")).otherwise(F.split(F.lit("org com"), " "))
    return t.supplier.select(
        "s_suppkey", stages.sanitize(raw, [(r"(?m)^z", "x")]).alias("clean"), text.balanced(body).alias("whole"),
        stages.dependency_score(tokens, F.split(F.lit("org acme"), " "), F.lit("Foo"), ["org", "com"]).alias("score"), sources_text.declares(body)["life_cycle"].alias("life_cycle"),
    )


@query("""
select s_suppkey, 'add the line ' || s_nationkey percent_of, case when s_nationkey = 3 then 'unchanged' when s_nationkey < 3 then 'too_short' end problem, 'FooBar' prompt, 'One said.' || chr(10) || 'Two said.' pool from supplier""")
def response_bits(t):
    name = F.when(F.col("s_nationkey") == 3, "original").when(F.col("s_nationkey") < 3, "abc").otherwise("goodName")
    return t.supplier.select(
        "s_suppkey",
        F.concat(F.lit("add the line "), scalars.percent_text(F.col("s_nationkey").cast("double"))).alias("percent_of"),
        classify.test_name_problem(name, F.lit("original")).alias("problem"),
        classify.class_name_of_prompt(F.lit("please improve FooBar now")).alias("prompt"),
        classify.quoted_pool(F.lit('1. "One said."\n2. "Two said."')).alias("pool"),
    )


@query("""
select doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), lambda w: length(w) > 1 and w not in ('the', 'of', 'de')))::int words from documents""")
def words_without_stops(t):
    return t.documents.select("doc_id", F.size(text.without_stop_words(F.col("text"), ["the", "of", "de"])).alias("words"))


@query("""
select doc_id, text like '%existing code unchanged%' or regexp_matches(lower(text), '(?m)^\\s*// \\.\\.\\. (?:keep|existing|rest)') incomplete from documents""")
def incomplete_merges(t):
    return t.documents.select("doc_id", classify.incomplete_merge(F.col("text")).alias("incomplete"))


@query("""
with w as (select p_partkey, string_split(p_name, ' ') a, lead(string_split(p_name, ' ')) over (order by p_partkey) b from part),
s as (select p_partkey, a, b, list_filter(range(1, len(a) + 1), lambda i: (m >> (i - 1)::int) & 1 = 1) pick from w, unnest(range(0, 8)) u(m) where b is not null and m < (1 << len(a))),
h as (select p_partkey, len(a) x, len(b) y, len(pick) n, ('|' || array_to_string(b, '||') || '|') like ('%' || array_to_string(list_transform(pick, lambda i: '|' || a[i] || '|'), '%') || '%') ok from s)
select p_partkey, round(max(case when ok then n else 0 end)::double / greatest(max(x), max(y)), 9) lcs_ratio from h group by 1""")
def lcs_ratio(t):
    """Names of parts against the next one's: all subsequences of their few words are tried in the SQL."""
    return conventions.similarity(next_names(t), "a", "b").select("p_partkey", F.round("lcs_ratio", 9).alias("lcs_ratio"))
