"""Reports and selections over the driver's tables: selected tests, summaries, sources and context, streams run to their end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import java, ranges, scalars, text
from ..operators import checks, matching, ordered, ranking, reports, sources_text, stages, statistics
from ..sources.folders import fresh_folder
from ..streaming import events as streams
from .registry import query, spread


def _candidates(t):
    return t.lineitem.select(
        "l_suppkey", F.concat(F.lit("m"), F.col("l_partkey") % 40).alias("test_method"), F.col("l_quantity").cast("int").alias("added_lines"), F.col("l_linenumber").alias("added_branches"),
        F.lit(0).alias("added_methods"), F.col("l_orderkey").cast("int").alias("added_instructions"), (F.col("l_returnflag") == "A").cast("int").alias("measured"), "l_returnflag",
    )


_SELECTED = """
with c as (select l_suppkey, 'm' || (l_partkey % 40) test_method, l_quantity::int added_lines, l_linenumber added_branches, l_orderkey added_instructions, (l_returnflag = 'A')::int measured from lineitem),
r as (select distinct l_suppkey, 'm' || (l_partkey % 40) test_method from lineitem where l_returnflag = 'R'),
b as (select c.*, row_number() over (partition by l_suppkey, test_method order by added_lines desc, added_branches desc, added_instructions desc, measured desc) i from c join r using (l_suppkey, test_method)),
s as (select *, row_number() over (partition by l_suppkey order by added_lines desc, added_branches desc, added_instructions desc, measured desc, test_method) "rank" from b where i = 1)
"""


def _selected(t):
    rows = _candidates(t)
    return reports.ranked_selection(reports.selected_tests(rows, ["l_suppkey"], rows.where("l_returnflag = 'R'")), ["l_suppkey"])


@query(_SELECTED + 'select l_suppkey, test_method, added_lines, added_branches, "rank"::int "rank" from s where "rank" <= 2')
def selected_tests(t):
    return _selected(t).select("l_suppkey", "test_method", "added_lines", "added_branches", "rank")


@query(_SELECTED + """, g as (select l_suppkey, count(*) n, list(test_method order by "rank") a from s where "rank" <= 2 group by 1)
select l_suppkey, case when n = 1 then 'Test Added' else 'Tests Added' end heading, case when n = 1 then 'test: add regression test for S' else 'test: add regression tests for S' end || l_suppkey title,
  array_to_string(list_transform(a, lambda m: '* Added ' || m), chr(10)) listing, case when n = 1 then 'I added a regression test' else 'I added two regression tests' end || ' for S' || l_suppkey || ' around ' || array_to_string(a, ' and ') || '.' summary from g""")
def selection_texts(t):
    rows = _selected(t).withColumn("component", F.concat(F.lit("S"), "l_suppkey"))
    return reports.selection_text(rows, ["l_suppkey"], "component")


@query("""
with a as (select o_custkey, list_sort(list(distinct 'T' || o_orderpriority)) q, count(*) n from orders where o_orderstatus <> 'P' group by 1), b as (select o_custkey, list(distinct 'T' || o_orderpriority) f, count(*) n from orders where o_orderstatus <> 'O' group by 1)
select o_custkey, case when c_acctbal is null then 'planned' when c_acctbal > 0 then 'compiled' else 'failed' end status, false selected, a.n requested_test_count, array_to_string(q, ';') requested_test_cases, coalesce(b.n, 0) final_source_count,
  coalesce(len(list_filter(f, lambda x: not list_contains(q, x))), 0)::int resolved_support_source_count, case when c_acctbal <= 0 then c_mktsegment end problem_category from a left join b using (o_custkey) left join customer on c_custkey = o_custkey""")
def compile_summary(t):
    source = F.concat(F.lit("T"), "o_orderpriority").alias("source")
    status = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).alias("compiled"), F.col("c_mktsegment").alias("problem"))
    return reports.compile_summary(t.orders.where("o_orderstatus <> 'P'").select("o_custkey", source), t.orders.where("o_orderstatus <> 'O'").select("o_custkey", source), status, ["o_custkey"])


@query("""
select c_custkey, 'passed' status, coalesce(a, 0) kept, coalesce(b, 0) all_rows from customer left join (select o_custkey, count(*) filter (o_orderstatus = 'F') a, count(*) filter (o_orderstatus = 'O') b from orders group by 1) on o_custkey = c_custkey""")
def stage_events(t):
    rows = t.customer.select("c_custkey", F.lit("passed").alias("status"))
    return reports.stage_event(rows, t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("kind")), ["c_custkey"], {"kept": "F", "all_rows": "O"})


@query("""
select p_partkey, v variant, p_size auto_pmd_violations, case when v = 'adopted' then p_size + 1 end candidate_pmd_violations, case when v = 'adopted' then 2 end cpd_duplicate_blocks, case when v = 'adopted' then p_size * 2 end cpd_duplicate_lines_total
from part, (values ('auto'), ('adopted')) x(v)""")
def compare_rows(t):
    measures = t.part.select("p_partkey", F.col("p_size").alias("auto_pmd_violations"), (F.col("p_size") + 1).alias("candidate_pmd_violations"), F.lit(2).alias("cpd_duplicate_blocks"), (F.col("p_size") * 2).alias("cpd_duplicate_lines_total"))
    return reports.compare_rows(measures, ["p_partkey"])


def _files(t):
    """Source files of each nation: a test, a helper and a main file for each of its suppliers, texts of growing length."""
    kinds = (("src/test/java/p/n", "Test"), ("src/test/java/p/n", "Helper"), ("src/main/java/p/n", ""), ("src/main/java/p/other", ""))
    file = F.explode(F.array(*[F.struct(F.concat(F.lit(root), F.col("s_nationkey") if root.endswith("n") else F.lit(""), F.lit("/S"), F.col("s_suppkey"), F.lit(end + ".java")).alias("path"), F.lit(i).alias("i")) for i, (root, end) in enumerate(kinds)]))
    rows = t.supplier.select(F.col("s_nationkey").alias("n"), "s_suppkey", file.alias("f"))
    return rows.select("n", "s_suppkey", "f.path", F.repeat(F.lit("x"), (F.col("s_suppkey") % 50 + 5).cast("int")).alias("text"), "f.i")


@query("""
select s_nationkey n, unnest(['src/test/java/p/n' || s_nationkey || '/S' || s_suppkey || 'Test.java', 'src/test/java/p/n' || s_nationkey || '/S' || s_suppkey || 'Helper.java']) path, unnest([true, false]) is_selected from supplier""")
def expanded_sources(t):
    files = _files(t)
    return reports.expanded_sources(files.where("i = 0"), files, ["n"])


@query("""
select 'p.C' || s_nationkey fqcn, min('b/S' || s_suppkey || '.java') path, min('a/S' || s_nationkey || '_ESTest_scaffolding.java') scaffolding, min(s_name) is not null has_contributing from supplier group by s_nationkey""")
def source_lookups(t):
    """The first source of a class, a generated test's scaffolding beside it, and a contributing file at any usual place."""
    files = t.supplier.select(F.concat(F.lit("p.C"), "s_nationkey").alias("fqcn"), F.concat(F.lit("b/S"), "s_suppkey", F.lit(".java")).alias("path"), "s_nationkey")
    pair = t.supplier.select(F.explode(F.array(*[F.concat(F.lit("a/S"), "s_nationkey", F.lit(e)) for e in ("_ESTest.java", "_ESTest_scaffolding.java")])).alias("path")).distinct()
    beside = reports.scaffolding_of(pair).select(F.concat(F.lit("p.C"), F.regexp_extract("path", r"S(\d+)_", 1)).alias("fqcn"), "scaffolding")
    places = files.select("fqcn", F.explode(F.array(F.lit("README.md"), F.lit("docs/contributing.md"))).alias("path"))
    return reports.first_source(files, "fqcn").join(beside, "fqcn").join(reports.has_contributing(places, "fqcn"), "fqcn")


@query("""
with f as (select s_nationkey n, path, length(repeat('x', (s_suppkey % 50 + 5)::int)) z, r from supplier, (values (0), (1), (2)) k(k),
  lateral (select case k when 0 then 'src/main/java/p/n' || s_nationkey || '/S' || s_suppkey || '.java' when 1 then 'src/test/java/p/n' || s_nationkey || '/S' || s_suppkey || 'Helper.java' else 'src/test/java/p/n' || s_nationkey || '/S' || s_suppkey || 'Test.java' end path, (k > 0)::int r)),
w as (select *, row_number() over (partition by n order by r, path) i, coalesce(sum(z) over (partition by n order by r, path rows between unbounded preceding and 1 preceding), 0) before from f)
select n, path, least(z, 100 - before)::int chars from w where i <= 4 and before < 100""")
def package_contexts(t):
    """Four files and a hundred characters at most: main sources first, the last text cut."""
    files = _files(t).withColumn("package", F.concat(F.lit("p.n"), "n"))
    return reports.package_context(files, ["n"], "package", 4, 100).select("n", "path", F.length("text").alias("chars"))


@query("""
select s_suppkey, 4 start, 30 "end", array_to_string(list_transform(range(4, 29), lambda i: 'a &lt; b &amp;&amp;     ' || i), chr(10)) shown, '1;40-41' others from supplier""")
def line_blocks(t):
    spans = t.supplier.select("s_suppkey", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((1, 1), (4, 20), (21, 30), (40, 41))])).alias("s")).select("s_suppkey", "s.*")
    lines = t.supplier.select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("pos")).withColumn("line", F.concat(F.lit("a < b &&\t "), F.col("pos")))
    return reports.line_blocks(spans, lines, ["s_suppkey"])


@query("""
with l as (select s_suppkey, i, case when i = 2 then '  // covers ' || s_nationkey else '  line' || case when i > 2 then i - 1 else i end end line from supplier, unnest(range(1, 5)) u(i))
select s_suppkey, i::int pos, line from l""")
def annotated_lines(t):
    """Earlier comments go, new ones come before their line at its indent."""
    w = Window.partitionBy("s_suppkey").orderBy("o")
    old = t.supplier.select("s_suppkey", F.posexplode(F.array(F.lit("  line1"), F.lit("  // covers 0 old"), F.lit("  line2"), F.lit("  line3"))).alias("o", "line"))
    lines = reports.without_comments(old.withColumn("pos", F.row_number().over(w)).drop("o"), ["s_suppkey"], "covers")
    notes = t.supplier.select("s_suppkey", F.lit(2).alias("pos"), F.concat(F.lit("// covers "), "s_nationkey").alias("comment"))
    return reports.with_comments(lines, notes, ["s_suppkey"])


@query("""
select s_suppkey, 'Foo' || s_nationkey symbol, 'a.b,c.d' packages, 'c.d' missing, 'x/' || s_nationkey || '.java' path from supplier where s_nationkey <> 4""")
def import_hints(t):
    """Packages of imported classes, which of them nobody declares, and the first source that would."""
    code = F.concat(F.lit("import a.b.Foo"), "s_nationkey", F.lit(";\nimport static c.d.Foo"), "s_nationkey", F.lit(".of;\nimport e.f.*;\n"))
    rows = t.supplier.select("s_suppkey", "s_nationkey", code.alias("text"))
    hints = reports.import_hints(rows, ["s_suppkey"])
    declared = t.nation.select(F.lit("a.b").alias("package"), F.concat(F.lit("Foo"), "n_nationkey").alias("symbol"))
    missing = reports.missing_imports(rows, declared, ["s_suppkey"])
    files = t.nation.select(F.lit("c.d").alias("package"), F.concat(F.lit("Foo"), "n_nationkey").alias("symbol"), F.explode(F.array(F.concat(F.lit("x/"), "n_nationkey", F.lit(".java")), F.concat(F.lit("y/"), "n_nationkey", F.lit(".java")))).alias("path"))
    found = reports.declaring_sources(missing, files, t.region.select(F.lit("x/4.java").alias("path")))
    return hints.join(missing.withColumnRenamed("package", "missing"), ["s_suppkey", "symbol"]).join(found.drop("package"), "symbol").select("s_suppkey", "symbol", F.array_join("packages", ",").alias("packages"), "missing", "path")


def next_names(t):
    """p_partkey, a, b: each part's name and the next one's, carried along buckets of keys."""
    rows = ordered.by_position(t.part.select("p_partkey", "p_name"), [], F.col("p_partkey"))
    seen = ordered.running(rows, [F.col("p_partkey")], {"before": ("last", F.struct("p_partkey", "p_name"))}, upto=-1)
    return seen.where("before is not null").select("before.p_partkey", F.col("before.p_name").alias("a"), F.col("p_name").alias("b"))


@query("""
with p as (select s_suppkey, s_nationkey % 5 k, s_nationkey % 2 = 0 flows from supplier)
select s_suppkey, round((1 + least(2 * k, 6) + least(k, 3) + case when k = 3 and not flows then 3 else 0 end) / 13.0, 9)::double syntax, case when flows then 0.5::double end flow from p""")
def code_scores(t):
    """Sources of no to four equal blocks against one of three; where values flow, half of the flows are there."""
    blocks = lambda n: F.repeat(F.lit("if (p) { y(p); } "), n)
    flows = F.col("s_nationkey") % 2 == 0
    code = lambda said, n: F.concat(F.lit("class C { void f(int p) { "), F.when(flows, said).otherwise(""), blocks(n), F.lit("} }"))
    found = reports.code_score(code("int z = 1; int y = z; ", (F.col("s_nationkey") % 5).cast("int")), code("int a = 1; int b = a; b += a; ", F.lit(3)))
    return spread(t.supplier.select("s_suppkey", "s_nationkey")).select("s_suppkey", found.alias("f")).select("s_suppkey", F.round("f.syntax", 9).alias("syntax"), "f.flow")


@query("""
with w as (select p_partkey, string_split(p_name, ' ') a, lead(string_split(p_name, ' ')) over (order by p_partkey) b from part), k as (select * from w where b is not null),
u as (select p_partkey, len(a) la, len(b) lb, sum(least(len(list_filter(a, lambda x: x = g)), len(list_filter(b, lambda x: x = g)))) h from (select *, unnest(list_distinct(a)) g from k) group by 1, 2, 3),
v as (select p_partkey, greatest(len(a) - 1, 0) t, (case when len(a) > 1 and len(b) > 1 and a[1] || ' ' || a[2] = b[1] || ' ' || b[2] then 1 else 0 end) h from k)
select p_partkey, round(case when u.h = 0 then 0 else exp((ln(u.h::double / la) + ln((v.h + 1.0) / (v.t + 1.0))) / 2 + least(0, 1 - lb::double / la)) end, 9) score from u join v using (p_partkey)""")
def ngram_scores(t):
    """Names of parts against the next one's by single words and pairs of words."""
    rows = next_names(t).select("p_partkey", F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    return rows.select("p_partkey", F.round(reports.ngram_score(F.col("a"), F.col("b"), most=2), 9).alias("score"))


@query("""
select o_orderkey, case when o_orderstatus = 'F' then 'failed' when o_orderpriority = '1-URGENT' then 'timeout' when o_orderpriority = '5-LOW' then 'skipped' else 'passed' end copied,
  case when o_orderpriority = '1-URGENT' then 'timeout' when o_orderstatus = 'F' then 'failed' when o_orderpriority = '5-LOW' then 'skipped' else 'passed' end run from orders""")
def status_orders(t):
    flags = (F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW")
    return t.orders.select("o_orderkey", scalars.status_from_flags(*flags, order="copied").alias("copied"), scalars.status_from_flags(*flags).alias("run"))


@query("""
select p_partkey, p_brand from part where p_size > 25 and p_retailprice > 900 and (p_brand like '%1_' or p_type = 'SMALL') and p_type <> 'PROMO' and not (p_partkey % 3 = 0 and p_size = 50)""")
def inventory_choice(t):
    """Rows with both counts, of a shell pattern, covered, and not of a problem's keys."""
    rows = t.part.withColumn("generated_count", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("none")).withColumn("manual_count", F.when(F.col("p_retailprice") > 900, 1).otherwise(0))
    kept = stages.named_like(stages.inventory(rows), "*1?", ("p_brand",)).unionByName(stages.named_like(stages.inventory(rows), "SMALL", ("p_type",))).distinct()
    counters = t.part.select("p_partkey", F.lit("auto").alias("variant"), F.when(F.col("p_type") != "PROMO", 1).otherwise(0).alias("line_covered"))
    summary = t.part.select("p_partkey", F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_size") == 50), "zero_kept_tests").otherwise("none").alias("problem_category"))
    kept = kept.join(stages.covered_keys(counters, ["p_partkey"]), "p_partkey", "left_semi").join(stages.problem_keys(summary, ["p_partkey"], ["zero_kept_tests"]), "p_partkey", "left_anti")
    return kept.select("p_partkey", "p_brand")


@query("""
select p_partkey, p_size <= 10 and p_type <> 'SMALL' as runs from part""")
def runnable_tests(t):
    annotations = F.when(F.col("p_type") == "SMALL", F.array(F.lit("Test"), F.lit("Parameters"))).otherwise(F.array(F.lit("Test")))
    return t.part.select("p_partkey", stages.runnable(annotations, F.when(F.col("p_size") > 10, 1).otherwise(0), F.lit(1), ["Parameters"]).alias("runs"))


@query("""
with a as (select distinct o_custkey, o_orderpriority p from orders where o_orderstatus = 'F'), m as (select distinct o_custkey, o_orderpriority p from orders where o_orderstatus = 'O'),
x as (select coalesce(a.o_custkey, m.o_custkey) k, a.p is not null ia, m.p is not null im from a full join m on a.o_custkey = m.o_custkey and a.p = m.p)
select k o_custkey, count(*) filter (ia and im) both_sides, count(*) filter (ia and not im) left_only, count(*) filter (im and not ia) right_only, (count(*) filter (ia and not im) = 0) subset from x group by 1""")
def set_relations(t):
    """Members in both of two sets of a key, in one alone, and whether the first is contained in the second."""
    keys = ["o_custkey", "o_orderpriority"]
    left, right = (t.orders.where(F.col("o_orderstatus") == s).select(*keys).distinct() for s in ("F", "O"))
    sides = checks.differing_sets(left, right, keys).select("o_custkey", "side").unionByName(left.join(right, keys, "left_semi").select("o_custkey", F.lit("both").alias("side")))
    n = lambda s: F.count_if(F.col("side") == s)
    return sides.groupBy("o_custkey").agg(n("both").alias("both_sides"), n("left").alias("left_only"), n("right").alias("right_only"), (n("left") == 0).alias("subset"))


@query("""
with a as (select l_suppkey, l_partkey, sum(l_quantity) s from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by s desc, l_partkey) i, lead(s) over (partition by l_suppkey order by s desc, l_partkey) nx from a),
b as (select l_suppkey, l_partkey, s, s - coalesce(nx, 0) margin from r where i = 1), u as (select *, row_number() over (partition by l_partkey order by s desc, l_suppkey) j from b)
select l_suppkey, l_partkey, s score, margin from u where j = 1""")
def best_unique(t):
    scored = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("score"))
    return ranking.unique_right(ranking.best_and_margin(scored, ["l_suppkey"], "l_partkey", "score"), ["l_suppkey"], "l_partkey", "score")


@query("""
with s as (select l_suppkey, list_distinct(list(l_linenumber + (l_partkey % 60)::int)) a from lineitem group by 1)
select l_suppkey, len(a)::bigint n, array_to_string(list_sort(a), ',') lines from s""")
def line_specs(t):
    """Specs of lines there and back, and their number from the spans alone."""
    lines = t.lineitem.groupBy("l_suppkey").agg(F.collect_set((F.col("l_linenumber") + F.col("l_partkey") % 60).cast("int")).alias("a"))
    spec = lines.select("l_suppkey", ranges.encode(F.col("a")).alias("spec"))
    return spec.select("l_suppkey", ranges.line_count(F.col("spec")).alias("n"), F.array_join(ranges.decode(F.col("spec")), ",").alias("lines"))


@query("""
with x as (select c_mktsegment variant, c_custkey, c_acctbal, o.n from customer join (select o_custkey, count(*) n from orders group by 1) o on o_custkey = c_custkey),
r as (select variant, rank() over (partition by variant order by c_acctbal) + (count(*) over (partition by variant, c_acctbal) - 1) / 2.0 a, rank() over (partition by variant order by n) + (count(*) over (partition by variant, n) - 1) / 2.0 b from x),
q as (select variant, count(*) n, round(corr(a, b), 6) rho from r group by 1)
select variant, n, rho, (select count(*) from x y where y.variant = q.variant and y.c_acctbal > 100 * y.n) wins from q""")
def ratings_against_metric(t):
    """A metric joined with ratings of the same targets: their rank correlation by variant and who wins."""
    metric = t.customer.select(F.col("c_mktsegment").alias("variant"), "c_custkey", "c_acctbal")
    rating = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("rating"))
    both = metric.join(rating, "c_custkey")
    wins = both.groupBy("variant").agg(F.count_if(F.col("c_acctbal") > 100 * F.col("rating")).alias("wins"))
    return statistics.spearman(both, ["variant"], "c_acctbal", "rating").join(wins, "variant").select("variant", "n", F.round("rho", 6).alias("rho"), "wins")


@query("""
select s_suppkey, unnest(['type:S', 'field:a', 'method:f/2', 'method:g/0']) "key" from supplier""")
def java_members(t):
    code = F.concat(F.lit("class S { int a = "), "s_nationkey", F.lit("; void f(int x, Map<K, V> y) { if (x > 1) { } } @Test void g() { } }"))
    rows = t.supplier.select("s_suppkey", F.explode(reports.member_keys(code)).alias("key"))
    return rows.unionByName(t.supplier.select("s_suppkey", F.lit("type:S").alias("key")))


@query("""
select s_suppkey, case when s_nationkey > 9 then 'field:b;method:f/0;method:h/0' else 'field:b;method:f/0' end merged, 'import a.A;' || chr(10) || 'import a.B;' || chr(10) || 'class X { }' restored, 2::bigint tests, 1::bigint ignored from supplier""")
def merged_members(t):
    """Members of two sources by key, the first one's where both have it; imports put back; tests and ignored ones."""
    one = t.supplier.select("s_suppkey", F.explode(F.array(F.lit("method:f/0"), F.lit("field:b"))).alias("key"), F.lit("x").alias("source"))
    two = t.supplier.select("s_suppkey", F.explode(F.when(F.col("s_nationkey") > 9, F.array(F.lit("method:f/0"), F.lit("method:h/0"))).otherwise(F.array(F.lit("method:f/0")))).alias("key"), F.lit("y").alias("source"))
    merged = reports.merged_members(one, two, ["s_suppkey"]).groupBy("s_suppkey").agg(F.array_join(F.array_sort(F.collect_list("key")), ";").alias("merged"))
    restored = reports.restored_imports(F.lit("import a.B;\nclass X { }"), F.lit("import a.A;\nimport a.B;\nclass X { int y; }"))
    code = F.lit("class X { @Test void a() { } @Test @Ignore void b() { } void c() { } }")
    counts = t.supplier.select("s_suppkey", restored.alias("restored"), F.explode(java.methods_column(code)).alias("m")).groupBy("s_suppkey", "restored").agg(
        F.count_if(F.array_contains("m.annotations", "Test")).alias("tests"), F.count_if(F.array_contains("m.annotations", "Ignore")).alias("ignored")
    )
    return merged.join(counts, "s_suppkey")


@query("""
select s_suppkey, case when s_nationkey < 5 then 'Improve S' || s_suppkey || ' of ' || s_name || '.' else 'Name S' || s_suppkey || '.' end prompt, s_nationkey // 5 batch from supplier""")
def filled_templates(t):
    """Texts of a template table with their values put in, by the type of each request."""
    templates = t._spark.createDataFrame([("improve", "Improve {cls} of {repo}."), ("name", "Name {cls}.")], "kind string, template string")
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") < 5, "improve").otherwise("name").alias("kind"), F.concat(F.lit("S"), "s_suppkey").alias("cls"), F.col("s_name").alias("repo"), F.expr("s_nationkey div 5").cast("int").alias("batch"))
    return reports.filled(rows, templates, ["cls", "repo"]).select("s_suppkey", F.col("text").alias("prompt"), "batch")


@query("""
with w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) a from conversations),
l as (select conv_id, turn, unnest(a) x from w), p as (select l.conv_id, l.turn t1, r.turn t2, r.conv_id c2, count(*) s from l join l r using (x) where (l.conv_id, l.turn) < (r.conv_id, r.turn) group by all)
select p.conv_id a_conv, t1 a_turn, c2 b_conv, t2 b_turn, round(s::double / (len(m.a) + len(n.a) - s), 9) jaccard from p join w m on m.conv_id = p.conv_id and m.turn = t1 join w n on n.conv_id = c2 and n.turn = t2 where s::double / (len(m.a) + len(n.a) - s) >= 0.15""")
def similar_turns(t):
    """All pairs of turns that share some of their words, each compared once."""
    rows = t.conversations.select(F.struct("conv_id", "turn").alias("__c"), F.array_distinct(text.words(F.col("text"))).alias("__set")).where("size(__set) > 0")
    pairs = matching.set_pairs(rows, rows, 0.15).select(F.col("__x").alias("left_id"), F.col("__y").alias("right_id"), "jaccard").where("left_id < right_id")
    return pairs.select(F.col("left_id.conv_id").alias("a_conv"), F.col("left_id.turn").alias("a_turn"), F.col("right_id.conv_id").alias("b_conv"), F.col("right_id.turn").alias("b_turn"), F.round("jaccard", 9).alias("jaccard"))


# Streams over the events, run to their end; their rows go to tables by key, which are compared with the batch SQL.


def _stream(t):
    return streams.read_events(t._spark, f"{t._dir}/events.parque[t]", t.events.schema)  # a pattern takes files and folders alike


@query("""
select time_bucket(interval 1 hour, ts) window_start, event_type, count(*) n from events group by all""")
def stream_windows(t):
    out = streams.windowed(_stream(t), "1 hour").select("window_start", "event_type", "n")
    return _table(t, out, ["window_start", "event_type"])


def _table(t, stream, keys):
    """The stream's rows in a table by key, updated batch by batch."""
    return streams.run_keyed(stream, fresh_folder(t._spark, "table"), keys, fresh_folder(t._spark, "stream"))


@query("select user_id, min(event_id) \"owner\" from events group by 1")
def stream_owners(t):
    return _table(t, streams.first_owners(_stream(t), "user_id", "event_id"), ["user_id"]).select("user_id", "owner")


@query("""
select user_id, count(*) seen, count(*) filter (event_type = 'purchase') decided, max(ts) last_ts from events group by 1""")
def stream_log_state(t):
    """What a log has said of each key so far, consumed piece by piece."""
    rows = _table(t, streams.consumed(_stream(t), "user_id", F.col("event_type") == "purchase", "60 days"), ["user_id"])
    return rows.select("user_id", "seen", "decided", "last_ts")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def resumed_targets(t):
    """Targets that an output table lacks."""
    from ..sources import sinks

    path = fresh_folder(t._spark, "done")
    sinks.write_upsert(t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("seq")), path, ["c_custkey"], "seq")
    return streams.pending(t.customer.select("c_custkey"), sinks.read_upserted(t._spark, path), ["c_custkey"])
