"""Repository facts, landed fields, reasons, names and bodies of responses, agreement bounds, checks of a whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import java, registered, scalars, text
from ..operators import checks, classify, conventions, incremental, ranking, selection, sources_text, stages, statistics
from .registry import query, spread


def _nested(t):
    """A source for each customer: types nested one to four deep, one to three tests in each, at times fields, a local class
    and an anonymous one."""
    depth, tests = F.col("c_custkey") % 4, F.col("c_nationkey") % 3 + 1

    def level(inner, i):
        each = F.transform(F.sequence(F.lit(1).cast("bigint"), tests.cast("bigint")), lambda j: F.concat(F.lit("@Test void t"), i.cast("string"), F.lit("_"), j.cast("string"), F.lit("() { check(\"}\"); } ")))
        fields = F.when(F.col("c_custkey") % 2 == 0, "int a = 1, b = f(2, 3); Map<String, Integer> m; ").otherwise("")
        return F.concat(F.lit("@Nested class L"), i.cast("string"), F.lit(" { "), fields, F.array_join(each, ""), inner, F.lit("} "))

    local = F.when(F.col("c_nationkey") % 5 == 0, "void h(int a, List<A, B> b) { class Z { void z() { } } new Object() { void no() { } }; } ").otherwise("")
    code = F.aggregate(F.sequence(depth.cast("bigint"), F.lit(0).cast("bigint")), local, level)
    return spread(t.customer.select("c_custkey", "c_nationkey")).select("c_custkey", "c_nationkey", code.alias("text"))


_NESTED = """
with c as (select c_custkey, c_custkey % 4 d, c_nationkey % 3 + 1 k, c_nationkey % 5 = 0 has from customer),
l as (select *, unnest(range(0, d + 1)) i from c),
p as (select *, 'L0' || array_to_string(list_transform(range(1, i + 1), lambda x: '.L' || x), '') "owner" from l),
m as (select c_custkey, "owner", 't' || i || '_' || j "name", true is_test, (i + 1)::int "depth", 0 parameters from (select *, unnest(range(1, k + 1)) j from p)
  union all select c_custkey, "owner", 'h', false, (i + 1)::int, 2 from p where has and i = d union all select c_custkey, "owner" || '.Z', 'z', false, (i + 2)::int, 0 from p where has and i = d)
"""


@query(_NESTED + "select * from m")
def java_nested(t):
    """Methods of nested and local types with the types that own them."""
    rows = _nested(t).select("c_custkey", F.explode(java.methods_column(F.col("text"))).alias("m"))
    return rows.select("c_custkey", "m.owner", "m.name", "m.is_test", "m.depth", "m.parameters")


@query(_NESTED + ", s as (select c_custkey, count(*) n from m where is_test group by 1) select c_custkey, n methods, n unknown_test, n smells from s")
def java_nested_smells(t):
    """Every nested test lacks an assertion."""
    return conventions.smell_totals(_nested(t), ["c_custkey"]).select("c_custkey", "methods", "unknown_test", "smells")


@query(_NESTED + "select c_custkey, 'method' kind, \"name\" from m union all select c_custkey, 'test', \"name\" from m where is_test")
def registered_functions(t):
    """The functions that are registered by name, from SQL: a column function and a table function."""
    registered.register(t._spark)
    docs = _nested(t)
    return t._spark.sql("""
        select c_custkey, 'method' kind, m.name from (select c_custkey, explode(java_methods(text)) m from {docs})
        union all select c_custkey, 'test', b.name from {docs} d, lateral test_method_bodies(d.text) b""", docs=docs)


@query("""
select p_partkey, 'import a.B' || p_size || ';' || chr(10) || 'import static x.Y;' || chr(10) || 'class A { String s = "http://' || p_brand || '/*"; ' || chr(10) || ' void f' || p_partkey || '() { } int g() { } void h(int a) { } }' stripped,
  'a.B' || p_size imports, 'f' || p_partkey without_arguments from part""")
def source_strings(t):
    """Comments go, strings with what looks like comments stay; imports without static ones; methods that take nothing."""
    key = F.col("p_partkey")
    code = F.concat(F.lit("import a.B"), "p_size", F.lit(";\nimport static x.Y;\nclass A { String s = \"http://"), "p_brand", F.lit("/*\"; // "), "p_name", F.lit("\n/* c */ void f"), key, F.lit("() { } int g() { } void h(int a) { } }"))
    run = java._udf(lambda c: ",".join(java.zero_argument_methods(c)), "string")
    return spread(t.part.select("p_partkey", "p_size", "p_brand", "p_name")).select("p_partkey", text.strip_comments_keep_strings(code).alias("stripped"), F.array_join(text.imports(code), ",").alias("imports"), run(code).alias("without_arguments"))


@query("""
select event_id, case when event_id % 3 = 0 then 0.0::double else round(value, 2)::double end number, case when event_id % 4 > 0 then strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') end moment,
  case when event_id % 2 = 0 then 90 else 5400 end::bigint "seconds", strftime(ts, '%Y%m%d-%H%M') || '-' || event_type run, event_id % 5 > 0 is_run, case when event_id % 3 = 0 then '' else event_type || '/' || user_id end items, sha256('a' || chr(10) || event_type) digest
from events""")
def landed_fields(t):
    """Numbers, moments, durations, run ids, lists and digests from texts as tools land them."""
    e = t.events.withColumn("second", F.date_trunc("second", "ts"))
    number = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.round("value", 2).cast("string"), F.lit(" ")))
    moment = F.when(F.col("event_id") % 4 > 0, F.date_format("second", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    start = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    end = F.when(F.col("event_id") % 2 == 0, start + F.expr("interval 90 seconds"))
    length = scalars.duration(start, end, start + F.expr("interval 90 minutes"))
    run = scalars.run_id(F.col("ts"), F.col("event_type"))
    items = F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.concat_ws(";", F.lit(" "), F.concat(F.lit(" "), "event_type"), F.col("user_id").cast("string")))
    return e.select(
        "event_id",
        scalars.float_or_zero(number).alias("number"),
        F.date_format(scalars.parse_timestamp(moment), "yyyy-MM-dd HH:mm:ss").alias("moment"),
        (F.unix_timestamp(start + length) - F.unix_timestamp(start)).alias("seconds"),
        run.alias("run"),
        scalars.is_run_id(F.when(F.col("event_id") % 5 > 0, run).otherwise(F.concat(F.lit("x"), run))).alias("is_run"),
        F.array_join(scalars.split_list(items), "/").alias("items"),
        scalars.digest_of_set(F.array(F.col("event_type"), F.lit("a"))).alias("digest"),
    )


@query("""
select o_custkey, max((o_orderpriority like '%HIGH%')::int) high, max((o_clerk_like)::int) clerk, bool_or(o_orderpriority = '1-URGENT') test_in_name, bool_or(o_orderpriority = '2-HIGH') test_in_content, bool_or(o_orderpriority in ('1-URGENT', '2-HIGH')) runs_tests
from (select *, o_orderstatus = 'F' o_clerk_like from orders) group by 1""")
def repository_flags(t):
    """Phrases and patterns in the paths of a repository's files, and whether its workflows run tests."""
    path = F.concat_ws("/", F.when(F.col("o_orderstatus") == "F", "docs").otherwise("src/docs"), F.col("o_orderpriority"))
    files = t.orders.select("o_custkey", path.alias("path"))
    used = selection.usage_flags(files, ["o_custkey"], "path", {"high": "high"}, {"clerk": "docs/"})
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    name = F.when(urgent, "run-Tests.txt").when(high, "build.YML").otherwise("notes.md")
    content = F.when(high, "steps:\n  - run: MVN Verify").when(urgent, None).otherwise("pytest")
    flags = sources_text.workflow_flags(t.orders.select("o_custkey", name.alias("name"), content.alias("content")), ["o_custkey"])
    return used.join(flags, "o_custkey")


@query("select s_suppkey, n_regionkey, n_name \"name\" from supplier join nation on n_nationkey = s_nationkey where n_nationkey % 3 <> 1")
def alias_join(t):
    """Names that another table knows by an alias, by their own name, or not at all."""
    known = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("org/"), F.lower("n_name"))).when(F.col("n_nationkey") % 3 == 2, F.col("n_name")).otherwise("gone")
    left = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", known.alias("name"))
    alias = t.nation.select(F.concat(F.lit("org/"), F.lower("n_name")).alias("alias"), F.col("n_name").alias("name"))
    return stages.by_alias(left, t.nation.select(F.col("n_name").alias("name"), "n_regionkey"), alias, "name").select("s_suppkey", "n_regionkey", "name")


@query("""
with d as (select doc_id, text a, replace(text, chr(10), ' ') b, len(string_split(text, chr(10))) n, length(text) c from documents where text is not null),
m as (select *, list_avg(list_transform(string_split(a, chr(10)), lambda x: length(x)::double)) ml, list_avg(list_transform(string_split(b, chr(10)), lambda x: length(x)::double)) mk from d)
select doc_id, round((abs(n - 1) / greatest(n, 1) + abs(ml - mk) / greatest(ml, mk, 1.0)) / 2, 6) distance, 0.0::double own from m""")
def style_distances(t):
    """Documents against themselves in one line: lines and their mean length differ."""
    docs = t.documents.where("text is not null")
    one = stages.style_profile(F.regexp_replace("text", "\n", " "))
    own = stages.style_profile(F.col("text"))
    two = lambda p: {k: p[k] for k in ("lines", "mean_line_length")}
    return docs.select("doc_id", F.round(stages.style_distance(two(own), two(one)), 6).alias("distance"), stages.style_distance(own, own).alias("own"))


@query("""
select c_custkey, (coalesce(f, 0) + coalesce(o, 0) + coalesce(p, 0))::bigint total from customer left join (select o_custkey, nullif(count(*) filter (o_orderstatus = 'F'), 0) f, nullif(count(*) filter (o_orderstatus = 'O'), 0) o, nullif(count(*) filter (o_orderstatus = 'P'), 0) p from orders group by 1) x on o_custkey = c_custkey""")
def counted_states(t):
    counts = t.orders.groupBy("o_custkey").agg(*[F.nullif(F.count_if(F.col("o_orderstatus") == s), F.lit(0)).alias(s) for s in "FOP"])
    rows = t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", stages.aggregate_counts(*[F.col(s) for s in "FOP"]).cast("long").alias("total"))


@query("""
with l as (select doc_id, i - 1 line, a[i] t from (select doc_id, a, unnest(range(1, len(a) + 1)) i from (select doc_id, string_split(text, chr(10)) a from documents where text is not null))),
f as (select doc_id, line, t, length(t) > 60 code, sum((length(t) > 60)::int) over (partition by doc_id order by line) c from l),
k as (select doc_id, line, c, lag(c) over (partition by doc_id order by line) - 0 pc, lag(line) over (partition by doc_id order by line) pl from f where line % 3 = 0),
g as (select k.doc_id, k.line, k.c, k.pl, k.pc, b.c bc from k left join f b on b.doc_id = k.doc_id and b.line = k.line - 1),
r as (select *, sum(case when pl is not null and pc = bc then 0 else 1 end) over (partition by doc_id order by line) run from g)
select doc_id, min(line) "start", max(line) "end" from r group by doc_id, run""")
def gap_merge(t):
    """Every third line of a document is a span; spans merge where all lines between are short."""
    lines = t.documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    lines = lines.select("doc_id", F.col("line").cast("long").alias("line"), (F.length("t") > 60).alias("is_code"))
    spans = lines.where("line % 3 = 0").select("doc_id", F.col("line").alias("start"), F.col("line").alias("end"))
    return sources_text.merge_gaps(spans, lines, ["doc_id"])


@query("""
with k as (select *, coalesce(list_position(['BUILDING', 'MACHINERY', 'FURNITURE'], c_mktsegment), 9) r from customer)
select c_nationkey, min_by(c_mktsegment, (r, c_mktsegment)) kind from k group by 1""")
def preferred_files(t):
    rows = t.customer.select("c_nationkey", F.col("c_mktsegment").alias("kind"))
    return stages.preferred(rows, ["c_nationkey"], ["BUILDING", "MACHINERY", "FURNITURE"], "kind")


@query("""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) a from documents), m as (select doc_id, a, list_filter(a, lambda x: regexp_matches(lower(x), 'er|the')) b from l)
select doc_id, md5(array_to_string(case when len(b) > 0 then b[greatest(len(b) - 14, 1):] else a[greatest(len(a) - 19, 1):] end, chr(10))) tail from m""")
def error_tails(t):
    """Last telling lines of documents, with common letters standing for the words of failures."""
    log = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)er|the", "$0\u0001error\u0001"), "(?i)failed", "$0")
    return t.documents.select("doc_id", F.md5(F.regexp_replace(classify.error_tail(log), "\u0001error\u0001", "")).alias("tail"))


@query("""
select c_custkey, case c_custkey % 5 when 0 then 'access_blocked' when 1 then 'not_found' when 2 then 'no_commit_found' when 3 then 'repeat' else 'error' end kind from customer""")
def api_errors(t):
    said = (F.lit("Repository access blocked"), F.lit("Not Found"), F.concat(F.lit("No commit found for SHA: "), "c_custkey"), F.concat(F.lit("rate limit of "), "c_custkey"))
    message = F.coalesce(*[F.when(F.col("c_custkey") % 5 == i, m) for i, m in enumerate(said)])
    return t.customer.select("c_custkey", classify.api_error(message).alias("kind"))


@query("""
with p as (select l_partkey, count(*) n, count(*) filter (l_returnflag = 'R') r, max(l_quantity) q from lineitem group by 1)
select l_partkey, case when r = 0 then 'no_baseline' when n < 25 then 'too_few' when q > 49 then 'already_covered' end skipped, case when q is null then 'exec_missing' when r > n / 2 then 'parse_failed' when n > 30 then 'target_not_found' else 'measured' end observed from p""")
def first_reasons(t):
    """Skip decisions and observation categories: the first rule that holds."""
    p = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.max("l_quantity").alias("q"))
    skipped = sources_text.first_reason((F.col("r") == 0, "no_baseline"), (F.col("n") < 25, "too_few"), (F.col("q") > 49, "already_covered"))
    observed = sources_text.first_reason((F.col("q").isNull(), "exec_missing"), (F.col("r") > F.col("n") / 2, "parse_failed"), (F.col("n") > 30, "target_not_found"), (F.lit(True), "measured"))
    return p.select("l_partkey", skipped.alias("skipped"), observed.alias("observed"))


@query("""
with v(variant) as (values ('manual'), ('auto'), ('auto-100'), ('improved'), ('adopted'), ('agentic')), c as (select c_nationkey, case when c_nationkey % 4 > 0 then count(*) filter (c_acctbal > 4000) + 90 end n from customer group by 1)
select c_nationkey, variant, case when variant = 'manual' then 'manual_baseline' when variant = 'auto-100' and n <= 100 then 'full_auto_suite_le_100' when variant = 'auto-100' and n > 100 then 'coverage_ranked_top_100' else 'variant_execution' end basis,
  case when variant = 'manual' then 'baseline' when variant = 'auto-100' and n <= 100 then 'verified_same_execution_as_auto' when variant = 'auto-100' and n > 100 then 'verified_100_method_subset_of_full_auto' when variant in ('improved', 'adopted', 'agentic') then 'unverified_historical_input_lineage' else 'full_auto_execution' end cohort from c, v""")
def incremental_basis(t):
    tests = t.customer.groupBy("c_nationkey").agg((F.count_if(F.col("c_acctbal") > 4000) + 90).alias("n"))
    known = tests.select("c_nationkey", F.when(F.col("c_nationkey") % 4 > 0, F.col("n")).alias("n"))
    rows = incremental.expand(known, known.select("c_nationkey").withColumn("variant", F.lit("auto")), ["c_nationkey"]).join(known, "c_nationkey")
    return rows.select("c_nationkey", "variant", incremental.basis(F.col("variant"), F.col("n")).alias("basis"), incremental.cohort(F.col("variant"), F.col("n")).alias("cohort"))


@query("""
with w as (select conv_id, turn, coalesce(text, '') x from conversations)
select conv_id, turn, case when not regexp_matches(substr(x, 1, 40), '[@\\[\\]{};:=,.]') and length(trim(substr(x, 1, 40), ' ')) between 5 and 50 then trim(substr(x, 1, 40), ' ') end "name", contains(x, 'try') = contains(x, 'catch') plausible from w""")
def usable_names(t):
    """The beginning of a turn as a test's name, and its text as a body."""
    rows = t.conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("x"))
    return rows.select("conv_id", "turn", sources_text.usable_test_name(F.substring("x", 1, 40), F.lit("original")).alias("name"), sources_text.plausible_body(F.col("x")).alias("plausible"))


@query("""
with recursive li(k, term, upto) as (select 0, exp(-1.0::double), exp(-1.0::double) union all select k + 1, term / (k + 1), upto + term / (k + 1) from li where k < 11),
c as (select user_id item, floor(value / 50)::double s, count(*)::double n from events group by 1, 2), m as (select *, sum(n) over (partition by item) m from c), k as (select * from m where m > 1),
d as (select item, rep, ('0x' || substr(md5('1:' || rep || ':' || item), 1, 8))::bigint / 4294967296.0::double u from (select distinct item from k), unnest(range(1, 101)) r(rep)),
w as (select item, rep, (select count(*) from li where upto <= u) w from d), x as (select k.*, rep, w from k join w using (item) where w > 0),
f as (select rep, s, sum(w * n) f from x group by 1, 2), p as (select rep, s, f, sum(f) over (partition by rep order by s rows unbounded preceding) - f / 2 pl from f),
o as (select rep, item, any_value(w) w, any_value(m) m, sum(n * pl) a, sum(n * pl * pl) b from x join p using (rep, s) group by 1, 2), ob as (select rep, sum(2 * w * (m * b - a * a) / (m - 1)) o from o group by 1),
e as (select rep, sum(f) n, sum(f * pl) a, sum(f * pl * pl) b from p group by 1), al as (select 1 - o / (2 * (n * b - a * a) / (n - 1)) alpha from ob join e using (rep))
select 'all' g, round(quantile_cont(alpha, 0.025), 6) low, round(quantile_cont(alpha, 0.975), 6) high from al""")
def alpha_interval(t):
    rows = t.events.select(F.lit("all").alias("g"), F.col("user_id").alias("item"), F.col("event_type").alias("rater"), F.floor(F.col("value") / 50).cast("double").alias("s"))
    out = statistics.alpha_ordinal_ci(rows, ["g"], "item", "rater", "s", 100)
    return out.select("g", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""
with r as (select s_nationkey, s_suppkey, s_acctbal, rep, row_number() over (partition by s_nationkey, rep order by md5('1:' || rep || ':' || s_suppkey), s_suppkey) k from supplier, unnest(range(1, 11)) x(rep)),
h as (select s_nationkey, rep, avg(s_acctbal) filter (k <= 3) held, avg(s_acctbal) filter (k > 3) kept from r group by 1, 2)
select s_nationkey, round(avg(held), 6) held, round(avg(kept), 6) kept from h group by 1""")
def held_out_baseline(t):
    """Three of a key's items held out, ten times over: means of both parts, averaged over the repeats."""
    rows = sources_text.held_out(t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], "s_suppkey", 3, 10)
    per = rows.groupBy("s_nationkey", "repeat").agg(F.avg(F.when(F.col("held"), F.col("s_acctbal"))).alias("held"), F.avg(F.when(~F.col("held"), F.col("s_acctbal"))).alias("kept"))
    return per.groupBy("s_nationkey").agg(F.round(F.avg("held"), 6).alias("held"), F.round(F.avg("kept"), 6).alias("kept"))


@query("""
with m as (select c_mktsegment, c_nationkey, count(*) filter (c_acctbal > 0)::double a, sum(c_acctbal) b from customer group by 1, 2),
x as (select min(a) la, max(a) ha, min(b) lb, max(b) hb from m)
select c_mktsegment, c_nationkey, round(case when ha > la then (a - la) / (ha - la) else 0 end, 9) a, round(case when hb > lb then (b - lb) / (hb - lb) else 0 end, 9) b from m, x""")
def scaled_columns(t):
    m = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).cast("double").alias("a"), F.sum("c_acctbal").alias("b"))
    low = m.agg(*[f(c).alias(f"{n}{c}") for c in "ab" for n, f in (("l", F.min), ("h", F.max))]).first()
    return m.select("c_mktsegment", "c_nationkey", *[F.round(scalars.minmax(F.col(c), F.lit(low[f"l{c}"]), F.lit(low[f"h{c}"])), 9).alias(c) for c in "ab"])


#: Paths, and whether they guide contributors, with scope and kind.
_GUIDES = (
    ("README.md", True, 0, 2), ("docs/Contributing.rst", True, 2, 1), (".github/copilot-instructions.md", True, 1, 5), ("build/readme.md", False, 0, 0), ("a/b/c/d/testing.txt", True, 2, 3),
    ("a/b/c/d/e/testing.txt", False, 0, 0), ("src/Readme.java", False, 0, 0), ("AGENTS.md", True, 0, 0), ("x/development", True, 2, 4), ("readme.old.md", True, 0, 2), ("notes/my-readme.md", False, 0, 0),
)


@query("""
with g(i, path, keep, scope, kind) as (values {}), f as (select c_nationkey, c_custkey, path, scope, kind, c_custkey % 40 + 1 size from customer join g on i = c_custkey % {} where keep),
r as (select *, sum(size) over w - size used, row_number() over w k from f window w as (partition by c_nationkey order by scope, kind, lower(path), c_custkey rows unbounded preceding))
select c_nationkey, c_custkey, path, least(size, 100 - used)::bigint taken from r where used < 100 and k <= 5""".format(", ".join(f"({i}, '{p}', {k}, {a}, {b})" for i, (p, k, a, b) in enumerate(_GUIDES)), len(_GUIDES)))
def guidance_files(t):
    """Files that guide contributors, the first ones of each key within limits of number and size."""
    path = F.array(*[F.lit(p) for p, *_ in _GUIDES])[(F.col("c_custkey") % len(_GUIDES)).cast("int")]
    files = t.customer.select("c_nationkey", "c_custkey", path.alias("path"), (F.col("c_custkey") % 40 + 1).alias("size"))
    ranked = files.where(selection.is_guidance(F.col("path"))).withColumn("o", selection.guidance_order(F.col("path")))
    return ranking.within_budget(ranked, ["c_nationkey"], ("o", "c_custkey"), "size", 100, 5).select("c_nationkey", "c_custkey", "path", F.col("taken").cast("long").alias("taken"))


_RUN = """
with g as (select l_suppkey target, l_partkey m, count(*) n, max(l_quantity) q, bool_or(l_returnflag = 'R') r, min(l_orderkey) o from lineitem where l_partkey % 40 = l_suppkey % 40 or l_partkey % 41 = 0 group by 1, 2),
x as (select *, row_number() over (partition by target order by m) p, count(*) over (partition by target) size from g)
"""


@query(_RUN + """
, t as (select target, any_value(size) size, count(*) filter (r) runnable, list(m order by m) filter (r and q > 30) positive, list(m order by m) filter (q > 30) large from x group by 1),
c as (select target, unnest([
  case when target % 11 = 0 then 'V-1 run passed' end, case when target % 13 = 0 then 'V-2 marked methods are new, in order' end, case when target % 7 = 0 then 'V-3 discovered are runnable' end,
  case when runnable + (target % 7 = 0)::int <> size then 'V-4 measured are discovered' end, case when len(list_filter(coalesce(large, []), lambda v: not list_contains(coalesce(positive, []), v))) > 0 then 'V-5 positive are runnable' end,
  case when len(coalesce(large, [])) > 0 and target % 5 = 0 then 'V-6 positive targets have a draft' end, case when target % 17 = 0 then 'V-7 one marker' end, case when target % 19 = 0 then 'V-8 a row for each stage' end,
  case when len(coalesce(large, [])) > 0 and target % 23 = 0 then 'V-9 selected within limits' end, case when len(coalesce(large, [])) > 0 and target % 23 = 0 then 'V-10 reduced are the first selectors' end,
  case when len(coalesce(large, [])) > 0 and target % 23 = 0 then 'V-11 annotated are the reduced, once' end, case when (target % 5 > 0)::int <> (len(coalesce(large, [])) > 0)::int then 'V-12 one draft a positive target' end,
  case when target % 29 = 0 then 'V-14 totals kept, increments not negative' end, case when target % 31 = 0 then 'V-15 merged names once' end]) k from t),
n as (select count(*) rows from t)
select k "check", case when k like 'V-6%' or k like 'V-12%' then 'warning' else 'error' end severity, target::varchar "key" from c where k is not null union all select 'V-13 rows and targets', 'error', '' from n where rows <> 1000000""")
def validation_report(t):
    """All checks of a run: suppliers as targets, parts as methods, with faults at given keys."""
    rows = t.lineitem.where("l_partkey % 40 = l_suppkey % 40 or l_partkey % 41 = 0")
    g = rows.groupBy(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("m")).agg(F.max("l_quantity").alias("q"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    at = lambda n: F.col("target") % n == 0
    large = F.col("q") > 30
    roles = [
        ("manual", F.lit(False)), ("merged", F.lit(True)), ("marked", ~at(13)), ("runnable", F.col("r")), ("measured", F.lit(True)), ("positive", large), ("reduced", large & ~at(23)), ("annotated", large),
    ]
    named = F.array_compact(F.array(*[F.when(test, role) for role, test in roles], F.when(at(31), "merged")))
    methods = g.select("target", F.col("m").cast("string").alias("method"), F.col("m").alias("pos"), F.explode(named).alias("role"))
    targets = g.groupBy("target").agg(F.count(F.lit(1)).alias("size"), F.count_if("r").alias("runnable")).select(
        "target",
        F.when(at(11), "failed").otherwise("passed").alias("status"),
        (F.col("runnable") + at(7).cast("int")).alias("discovered"),
        F.when(at(17), 2).otherwise(1).alias("markers"),
        F.when(at(5), 0).otherwise(1).alias("drafts"),
        F.when(at(19), F.array(F.lit("run"))).otherwise(F.array(*map(F.lit, checks.STAGES))).alias("stages"),
        F.lit(10).alias("total"),
        F.lit(10).alias("merged_total"),
        F.when(at(29), -1).otherwise(0).alias("increment"),
    )
    return checks.validation(targets, methods, 1_000_000, 1_000_000).select("check", "severity", "key")
