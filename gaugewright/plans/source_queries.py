"""Readers and writers over the driver's tables: each query writes files below the shared folder and reads them back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import selection, stages
from ..sources import readers, sinks
from ..sources.folders import fresh_folder
from .registry import query


def _text(t, line, name: str = "lines") -> str:
    """Writes one column of texts and gives the path."""
    path = fresh_folder(t._spark, name)
    sinks.write_text(line, line.columns[0], path)
    return path


@query("""
select s_suppkey, 'a, "' || s_name || '"' || chr(10) || 'b' "label", case when s_nationkey <> 3 then s_acctbal end balance, null::int absent from supplier""")
def csv_round_trip(t):
    """Quotes, commas, line breaks and nulls; the second half is appended with its columns in another order."""
    rows = t.supplier.select("s_suppkey", F.concat(F.lit('a, "'), "s_name", F.lit('"\nb')).alias("label"), F.when(F.col("s_nationkey") != 3, F.col("s_acctbal")).alias("balance"))
    path = fresh_folder(t._spark, "csv")
    some = F.col("s_nationkey") < 12
    sinks.write_csv(rows.join(t.supplier.where(some).select("s_suppkey"), "s_suppkey", "left_semi"), path)
    rest = rows.join(t.supplier.where(some).select("s_suppkey"), "s_suppkey", "left_anti")
    sinks.write_csv(rest.select("balance", "label", "s_suppkey"), path, fresh=False)
    return readers.require(readers.csv_rows(t._spark, path, "s_suppkey bigint, label string, balance double, absent int"), "label")


@query("""
select 'C' || o_custkey || '#m' || o_orderkey test_selector, case when o_orderstatus = 'F' then 0 else o_custkey end added_lines, (o_orderkey // 7)::int added_methods, 0 added_branches, 5 added_instructions,
  (case when o_orderstatus = 'F' then 1 else 0 end + 1)::int bad_fields from orders where o_orderstatus <> 'P'""")
def test_deltas_read(t):
    """A header, plain lines, bad numbers, and lines that are too short to count."""
    selector = F.concat(F.lit("C"), "o_custkey", F.lit("#m"), "o_orderkey")
    lines = F.when(F.col("o_orderstatus") == "P", F.concat_ws(",", selector, F.lit("1"))).otherwise(
        F.concat_ws(", ", selector, F.when(F.col("o_orderstatus") == "F", "none").otherwise(F.col("o_custkey").cast("string")), F.expr("o_orderkey div 7"), F.lit("x"), F.lit("5"))
    )
    header = t.region.limit(1).select(F.lit("test_selector,added_lines,added_methods,added_branches,added_instructions").alias("line"))
    out = readers.test_deltas(t._spark, _text(t, header.unionByName(t.orders.select(lines.alias("line")))))
    return out.withColumn("added_lines", F.col("added_lines").cast("long"))


@query("""
select 'p.C' || s_suppkey test_class, case when s_nationkey > 4 then 'm' || s_nationkey end test_method from supplier where s_nationkey <> 9""")
def selectors_read(t):
    name = F.concat(F.lit("  p.C"), "s_suppkey", F.when(F.col("s_nationkey") > 4, F.concat(F.lit("#m"), "s_nationkey")).otherwise(""))
    lines = t.supplier.select(F.when(F.col("s_nationkey") == 9, F.concat(F.lit("# "), name)).otherwise(name).alias("line"))
    return readers.selectors(t._spark, _text(t, lines.unionByName(t.region.select(F.lit("").alias("line")))))


@query("""
with m as (select c_mktsegment repo, c_nationkey fqcn, arg_max(case when c_custkey > 700 then 'FAIL: x' else 'lib/' || c_custkey || '.jar' end, c_custkey) path from customer group by 1, 2)
select repo, fqcn, path, path like 'FAIL%' problem from m""")
def artifact_map_last(t):
    path = F.when(F.col("c_custkey") > 700, "FAIL: x").otherwise(F.concat(F.lit("lib/"), "c_custkey", F.lit(".jar")))
    rows = t.customer.select(F.col("c_mktsegment").alias("repo"), F.col("c_nationkey").alias("fqcn"), path.alias("fatjar_path"), F.col("c_custkey").alias("line"))
    return readers.artifact_map(rows, ("line",)).withColumn("problem", selection.fatjar_problem(F.col("path")))


@query("""
select 'a.b.C' || (l_partkey % 50) fqcn, sum(l_linenumber)::bigint line_covered, sum(l_linenumber + l_quantity::int)::bigint line_total, count(*) branch_covered, (2 * count(*))::bigint branch_total from lineitem group by 1""")
def coverage_csv_totals(t):
    """Inner classes count to their outermost one."""
    inner = F.when(F.col("l_returnflag") == "R", "$In").when(F.col("l_returnflag") == "A", ".In.Other").otherwise("")
    rows = t.lineitem.select(
        F.lit("a.b").alias("PACKAGE"), F.concat(F.lit("C"), F.col("l_partkey") % 50, inner).alias("CLASS"), F.col("l_quantity").cast("int").alias("LINE_MISSED"),
        F.col("l_linenumber").alias("LINE_COVERED"), F.lit(1).alias("BRANCH_MISSED"), F.lit(1).alias("BRANCH_COVERED"),
    )
    path = fresh_folder(t._spark, "coverage")
    sinks.write_csv(rows, path)
    return readers.coverage_csv(t._spark, path)


def _reports(rows, name: str) -> str:
    """Writes each row's text as a report of its own and gives the folder."""
    path = fresh_folder(rows.sparkSession, name)
    rows.select(F.concat(F.lit("<report>"), rows.columns[0], F.lit("</report>")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _report(t) -> str:
    """Coverage reports of at most a hundred suppliers each: a package for a nation, a file for a supplier of it, two lines and a
    counter a file."""
    line = lambda nr, ci: F.concat(F.lit('<line nr="'), nr, F.lit('" mi="1" ci="'), ci, F.lit('" mb="0" cb="0"/>'))
    body = F.concat(line(F.col("s_suppkey"), F.col("s_nationkey")), line(F.col("s_suppkey") + 1, F.lit(0)), F.lit('<counter type="LINE" missed="1" covered="'), F.col("s_nationkey"), F.lit('"/>'))
    file = F.concat(F.lit('<sourcefile name="S'), "s_suppkey", F.lit('.java">'), body, F.lit("</sourcefile>"))
    packages = t.supplier.groupBy("s_nationkey", F.expr("s_suppkey div 100")).agg(F.array_join(F.collect_list(file), "").alias("files"))
    return _reports(packages.select(F.concat(F.lit('<package name="p/n'), "s_nationkey", F.lit('">'), "files", F.lit("</package>")).alias("line")), "xml")


@query("""
select 'p/n' || s_nationkey package, 'S' || s_suppkey || '.java' source_file, s_suppkey line, s_nationkey > 0 covered from supplier
union all select 'p/n' || s_nationkey, 'S' || s_suppkey || '.java', s_suppkey + 1, false from supplier""")
def coverage_xml_lines(t):
    return readers.coverage_xml_lines(t._spark, _report(t)).withColumn("line", F.col("line").cast("long"))


@query("select 'p/n' || s_nationkey package, 'S' || s_suppkey || '.java' source_file, s_nationkey::int line_covered, s_nationkey + 1 line_total, 0 branch_covered, 0 branch_total from supplier")
def coverage_xml_counters(t):
    return readers.coverage_xml_counters(t._spark, _report(t))


@query("""
select distinct substr(md5(c_nationkey::varchar), 1, 16) class_id from customer where c_nationkey < 9""")
def class_ids(t):
    name = F.when(F.col("c_nationkey") < 9, "a/b/Target").otherwise("a/b/TargetOther")
    lines = t.customer.select(F.concat_ws("   ", F.substring(F.md5(F.col("c_nationkey").cast("string")), 1, 16), "c_custkey", name).alias("line"))
    return readers.class_ids(t._spark, _text(t, lines), "a.b.Target")


@query("""
select 'rule' kind, p_brand "name", count(*) n from part group by 2
union all select 'duplication', 'blocks', count(*) from part union all select 'duplication', 'lines', sum(p_size)::bigint from part""")
def analysis_xml(t):
    of = lambda item: t.part.groupBy(F.expr("p_partkey div 100")).agg(F.array_join(F.collect_list(item), "").alias("line")).select("line")  # a hundred parts a report
    rules = of(F.concat(F.lit('<violation rule="'), "p_brand", F.lit('">said</violation>')))
    copies = of(F.concat(F.lit('<duplication lines="'), "p_size", F.lit('" tokens="60"></duplication>')))
    found = readers.rule_violations(t._spark, _reports(rules, "rules")).select(F.lit("rule").alias("kind"), F.col("rule").alias("name"), "n")
    twice = readers.duplicated_lines(t._spark, _reports(copies, "copies"))
    for kind in ("blocks", "lines"):
        found = found.unionByName(twice.select(F.lit("duplication").alias("kind"), F.lit(kind).alias("name"), F.col(kind).alias("n")))
    return found


@query("""
select n_name "name", 'Caf of ' || n_name || chr(10) text, n_name = (select min(n_name) from nation) is_first from nation""")
def source_files(t):
    """Whole files with a byte that is no UTF-8, and the first path of a wanted name among several.

    One task writes a folder for each nation, with a file of the same name in each."""
    root = fresh_folder(t._spark, "sources")
    content = F.unhex(F.concat(F.hex(F.lit("Caf")), F.lit("E9"), F.hex(F.concat(F.lit(" of "), "n_name")))).cast("string")
    t.nation.select("n_name", content.alias("value")).coalesce(1).write.partitionBy("n_name").text(root)
    files = readers.source_files(t._spark, root, "part-*.txt")
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    first = readers.files_by_name(t._spark, root, names).select("path", F.lit(True).alias("is_first"))
    kept = files.join(first, "path", "left")
    return kept.select(F.url_decode(F.regexp_extract("path", r"n_name=([^/]+)/", 1)).alias("name"), "text", F.coalesce("is_first", F.lit(False)).alias("is_first"))


@query("""
with l as (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) a from documents)
select doc_id, i - 1 pos, md5(a[i]) line from (select doc_id, a, unnest(range(1, len(a) + 1)) i from l)""")
def log_lines(t):
    return readers.log_lines(t.documents, ["doc_id"]).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("line"))


@query("""
select n_name || '.jar' archive, 'p/' || n_name || '.class' entry, 52 + n_regionkey major from nation union all select n_name || '.jar', 'notes.txt', null from nation""")
def archive_entries(t):
    """Archives made and written by the tasks, one a nation and a broken one for each region."""

    @F.pandas_udf("binary")
    def archive(name: pd.Series, major: pd.Series) -> pd.Series:
        def made(n, m):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr(f"p/{n}.class", b"\xca\xfe\xba\xbe\0\0" + int(m).to_bytes(2, "big") + b"rest")
                z.writestr("notes.txt", "text")
            return out.getvalue()

        return pd.Series([made(n, m) for n, m in zip(name, major, strict=True)])

    root = fresh_folder(t._spark, "archives")
    whole = t.nation.select(F.col("n_name").alias("archive"), archive("n_name", F.col("n_regionkey") + 52).cast("string").alias("value"))
    broken = t.region.select(F.concat(F.lit("broken "), "r_name").alias("archive"), F.lit("no archive").alias("value"))
    whole.unionByName(broken).write.partitionBy("archive").text(root)
    found = readers.archive_entries(t._spark, root, "part-*.txt")
    name = F.concat(F.url_decode(F.regexp_extract("path", r"archive=([^/]+)/", 1)), F.lit(".jar"))
    return found.select(name.alias("archive"), "entry", F.col("major").cast("int").alias("major"))


@query("select c_nationkey \"name\", 'src/test/C' || c_custkey || '.java' path, (c_custkey // 100) % 2 = 1 truncated, 'test' kind from customer where c_acctbal >= 0")
def tree_entries(t):
    """Landed JSON trees of files and folders."""
    entry = F.struct(F.when(F.col("c_acctbal") < 0, "tree").otherwise("blob").alias("type"), F.concat(F.lit("src/test/C"), "c_custkey", F.lit(".java")).alias("path"))
    trees = t.customer.groupBy(F.col("c_nationkey").alias("name"), F.expr("c_custkey div 100")).agg(F.collect_list(entry).alias("tree"), F.first(F.expr("c_custkey div 100")).alias("page"))
    trees = trees.select("name", F.to_json(F.struct((F.col("page") % 2 == 1).alias("truncated"), "tree")).alias("body"))
    return readers.tree_entries(trees, "name", "body").withColumn("kind", selection.path_kind(F.col("path")))


@query("""
select o_custkey, least(count(*), 12)::bigint commit_count, max(o_orderdate) last_commit, count(distinct o_orderpriority) authors from orders group by 1""")
def commit_facts(t):
    stats = selection.commit_stats(t.orders, ["o_custkey"], "o_orderdate", 12)
    authors = t.orders.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("authors"))
    return stats.join(authors, "o_custkey").withColumn("commit_count", F.col("commit_count").cast("long"))


@query("select event_id, user_id, coalesce(json_extract_string(props, '$.k'), '0') stars, 'none' license from events")
def landed_metadata(t):
    """Fields of landed JSON with defaults for what is missing."""
    return t.events.select("event_id", "user_id", scalars.json_path(F.col("props"), "$.k", "0").alias("stars"), scalars.json_path(F.col("props"), "$.license.name", "none").alias("license"))


@query("""
select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) k, case when event_id % 7 = 0 then 'none' else event_type end "name", case when event_id % 7 = 0 then false else event_id % 2 = 0 end is_even, case when event_id % 7 = 0 then 0 else 2 end::int tags
from events""")
def landed_variants(t):
    """Fields of nested JSON by path and type, some of it cut off."""
    whole = F.to_json(F.struct(F.struct(F.col("event_type").alias("name"), F.array(F.lit("a"), F.lit("b")).alias("tags")).alias("meta"), (F.col("event_id") % 2 == 0).alias("even")))
    body = F.when(F.col("event_id") % 7 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    facts = scalars.landed(body, {"name": ("$.meta.name", "string", "none"), "is_even": ("$.even", "boolean", False), "tags": ("$.meta.tags", "array<string>", None)})
    k = scalars.landed(F.col("props"), {"k": ("$.k", "long", -1)})
    rows = t.events.select("event_id", k["k"].alias("k"), facts.alias("f"))
    return rows.select("event_id", "k", "f.name", "f.is_even", F.coalesce(F.nullif(F.size("f.tags"), F.lit(-1)), F.lit(0)).alias("tags"))


@query("""
select c_custkey, c_acctbal > 0 positive, case when c_acctbal > 0 then 'a' else 'b' end kind, length(c_name) + (case when c_acctbal > 0 then 1 else 0 end)::bigint size from customer""")
def staged_columns(t):
    """Columns that are added one by one, the table written after each."""
    steps = {"positive": F.col("c_acctbal") > 0, "kind": F.when(F.col("positive"), "a").otherwise("b"), "size": (F.length("c_name") + F.col("positive").cast("int")).cast("long")}
    return sinks.staged(t.customer.select("c_custkey", "c_name", "c_acctbal"), steps, fresh_folder(t._spark, "staged")).select("c_custkey", *steps)


@query("""
select o_custkey, arg_max(o_totalprice, o_orderkey) price, min(case when o_orderstatus = 'F' then o_orderkey end) first_f, count(*) n from orders group by 1""")
def upsert_round_trip(t):
    """Three batches of rows upserted into one table: the last row of a customer holds, at the place of the first batch that
    had one."""
    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    path = fresh_folder(t._spark, "upserted")
    for status in ("F", "O", "P"):
        later = t.orders.where(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.max("o_orderkey").alias("seq"))
        upto = {"F": ["F"], "O": ["F", "O"], "P": ["F", "O", "P"]}[status]
        best = t.orders.where(F.col("o_orderstatus").isin(*upto)).groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("price"), F.max("o_orderkey").alias("seq"))
        sinks.write_upsert(best.join(later.select("o_custkey"), "o_custkey", "left_semi").select("o_custkey", "seq", "price"), path, ["o_custkey"], "seq", 8)
    kept = sinks.read_upserted(t._spark, path)
    facts = t.orders.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("first_f"), F.count(F.lit(1)).alias("n"))
    return kept.join(facts, "o_custkey").join(rows.select("o_custkey").distinct(), "o_custkey").select("o_custkey", "price", "first_f", "n")


@query("""
select o_orderstatus variant, count(*) n, 'summary.includes.csv' "name" from orders group by 1""")
def split_by_variant(t):
    path = fresh_folder(t._spark, "split")
    sinks.split_by(t.orders, "o_orderstatus", path)
    back = t._spark.read.parquet(path).groupBy(F.col("o_orderstatus").alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    return back.withColumn("name", F.lit(sinks.name_for("summary.csv", True)))


@query("""
select n_name, coalesce('jar/' || max(s_suppkey), 'FAIL') path, max(s_suppkey) is null problem from nation left join supplier on s_nationkey = n_nationkey and s_acctbal < 0 group by n_name, n_nationkey""")
def artifact_sentinel(t):
    built = t.supplier.where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.concat(F.lit("jar/"), F.max("s_suppkey")).alias("path"))
    return sinks.with_sentinel(t.nation, built, ["n_nationkey"], "path").select("n_name", "path", selection.fatjar_problem(F.col("path")).alias("problem"))


@query("""
select '* ' || r_name || ': ' || count(*) || ' nations' "value" from region join nation on n_regionkey = r_regionkey group by r_name""")
def text_report(t):
    rows = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    line = rows.select(F.concat(F.lit("* "), "r_name", F.lit(": "), "n", F.lit(" nations")).alias("line"))
    return t._spark.read.text(_text(t, line))


#: Build files: what they say, and the source and target version that holds.
_BUILDS = (
    ("<properties><java.version>1.8</java.version><junit.version>4.{}</junit.version></properties>", "1.8", "1.8"),
    ("<properties><maven.compiler.source>1.8</maven.compiler.source><maven.compiler.release>17</maven.compiler.release></properties>", "1.8", "17"),
    ("<properties><compiler.source>11</compiler.source></properties>", "11", "11"),
    ("sourceCompatibility = 1.8\njava { toolchain { languageVersion = JavaLanguageVersion.of(17) } }", "1.8", "17"),
    ("<properties><v>21</v><maven.compiler.target>${v}</maven.compiler.target></properties>", "21", "21"),
    ("<plugin><source>9</source><target>10</target></plugin>", "9", "10"),
    ("with:\n  java-version: '11'", "11", "11"),
    ("targetCompatibility = JavaVersion.VERSION_1_7", "1_7", "1_7"),
    ("nothing", None, None),
)


@query("""
with m(i, source, target, major) as (values {}) select n_nationkey, source, target, major java_version, case when i = 0 then '4.' || n_nationkey else '4.13' end "version" from nation join m on i = n_nationkey % {}""".format(
    ", ".join("({}, {}, {}, {})".format(i, *[repr(v) if v else "null" for v in (a, b)], (a.removeprefix("1.").removeprefix("1_") if a else "null")) for i, (_, a, b) in enumerate(_BUILDS)), len(_BUILDS)
))
def build_files(t):
    """Java versions of build files, source and target, and properties resolved from them."""
    which = F.col("n_nationkey") % len(_BUILDS)
    said = F.array(*[F.lit(text) for text, _, _ in _BUILDS])[which.cast("int")]
    rows = t.nation.withColumn("text", F.replace(said, F.lit("{}"), F.col("n_nationkey").cast("string")))
    value = F.when(which == 0, "${junit.version}").otherwise("4.13")
    return rows.select("n_nationkey", readers.java_versions(F.col("text"))["source"].alias("source"), readers.java_versions(F.col("text"))["target"].alias("target"), readers.java_version(F.col("text")).alias("java_version"), readers.resolve_properties(F.col("text"), value).alias("version"))


@query("""
select p_partkey, case when p_size > 40 then 'FAIL: build' when p_size > 30 then 'skipped: x' when p_size > 20 then '' else 'a/' || p_partkey || '.jar' end path, p_size > 20 problem,
  not (p_size <= 20 and p_type not in ('PROMO') and p_partkey % 7 <> 0) excluded from part""")
def artifact_choice(t):
    """Sentinels, and classifiers and runtime jars that do not count as artifacts."""
    path = F.when(F.col("p_size") > 40, "FAIL: build").when(F.col("p_size") > 30, "skipped: x").when(F.col("p_size") > 20, "").otherwise(F.concat(F.lit("a/"), "p_partkey", F.lit(".jar")))
    file = F.concat(path, F.when(F.col("p_partkey") % 7 == 0, "-sources.jar").when(F.col("p_type") == "PROMO", "junit-4.12.jar").otherwise(""))
    rows = t.part.select("p_partkey", path.alias("path"), file.alias("file"))
    return rows.select("p_partkey", "path", selection.fatjar_problem(F.col("path")).alias("problem"), (selection.fatjar_problem(F.col("path")) | selection.no_artifact(F.col("file"))).alias("excluded"))


@query("""
select c_nationkey, c_mktsegment variant, sum(c_custkey)::bigint line_covered, (sum(c_custkey) * 2)::bigint line_total, case when sum(c_custkey) > 0 then 50.0::double else 0 end line_percentage_coverage, 0.0::double branch_percentage_coverage from customer group by 1, 2""")
def coverage_rows_copied(t):
    rows = t.customer.groupBy("c_nationkey", F.col("c_mktsegment").alias("kind")).agg(F.sum("c_custkey").alias("line_covered"), (F.sum("c_custkey") * 2).alias("line_total"))
    rows = rows.withColumn("branch_covered", F.lit(0)).withColumn("branch_total", F.lit(0)).withColumn("line_percentage_coverage", F.lit(0.0)).withColumn("branch_percentage_coverage", F.lit(0.0))
    out = None
    for kind in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        own = stages.override_variant(rows.where(F.col("kind") == kind), kind)
        out = own if out is None else out.unionByName(own)
    return out.select("c_nationkey", "variant", "line_covered", "line_total", "line_percentage_coverage", "branch_percentage_coverage")
