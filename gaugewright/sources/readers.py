"""Readers of tool outputs and inventories as typed tables.

Text is parsed with explicit schemas; blank fields are null; bad numbers are 0 where the tools treat them so, and are
counted in ``bad_fields``.
"""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..functions.scalars import utf8_text

TEST_DELTAS = "test_selector string, added_lines int, added_methods int, added_branches int, added_instructions int"
LINE_DELTAS = "test_selector string, class_name string, newly_covered_lines string, upgraded_to_full_lines string"
CLASS_DELTAS = "class_name string, added_lines int, added_methods int, added_branches int, added_instructions int"


def csv_rows(spark: SparkSession, path: str, schema: str | None = None, missing_is_empty: bool = False, breaks_in_fields: bool = True) -> DataFrame:
    """Rows of CSV files with a header, quoted as in RFC 4180; all text unless a schema is given.

    With missing_is_empty a path that does not exist is an empty table of the schema.  A file whose fields may hold line
    breaks is read by one task; without breaks_in_fields large files are split over tasks.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", breaks_in_fields).option("mode", "PERMISSIVE")
    if schema is None:
        return reader.csv(path)
    fields = StructType.fromDDL(schema).fieldNames()
    try:
        raw = reader.csv(path)
    except AnalysisException as e:
        if missing_is_empty and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    types = StructType.fromDDL(schema)
    columns = [F.col(f"`{f}`") if f in raw.columns else F.lit(None) for f in fields]
    return raw.select(*[c.cast("string").try_cast(types[f].dataType).alias(f) for c, f in zip(columns, fields, strict=True)])


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def test_deltas(spark: SparkSession, path: str) -> DataFrame:
    """TEST_DELTAS and bad_fields: plain comma-split lines after a header; short rows are skipped, bad numbers are 0."""
    parts = F.split("value", ",")
    numbers = [F.trim(F.try_element_at(parts, F.lit(i))) for i in range(2, 6)]
    rows = spark.read.text(path).where((F.size(parts) >= 5) & ~F.col("value").startswith("test_selector"))
    typed = [n.try_cast("int") for n in numbers]
    bad = sum((F.when(t.isNull(), 1).otherwise(0) for t in typed), F.lit(0))
    names = ("added_lines", "added_methods", "added_branches", "added_instructions")
    return rows.select(F.trim(parts[0]).alias("test_selector"), *[F.coalesce(t, F.lit(0)).alias(n) for t, n in zip(typed, names, strict=True)], bad.alias("bad_fields"))


def selectors(spark: SparkSession, path: str) -> DataFrame:
    """test_class, test_method (null for a whole class): lines split at their last #; blanks and # comments are skipped."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("s")).where((F.col("s") != "") & ~F.col("s").startswith("#"))
    return rows.select(selector_parts(F.col("s")).alias("p")).select("p.*")


def selector_parts(selector: Column) -> Column:
    method = F.nullif(F.regexp_extract(selector, r"#([^#]*)$", 1), F.lit(""))
    return F.struct(F.regexp_replace(selector, r"#[^#]*$", "").alias("test_class"), method.alias("test_method"))


def artifact_map(rows: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """repo, fqcn, path: the last row of each key; either column name for the path will do.

    Rows are in the order of the columns ``order``.  Without them it is that of the files' names and, within a file that is
    read by one task, of its lines.
    """
    names = [c for c in ("fatjar_path", "fatjar") if c in rows.columns]
    path = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in names])
    at = [F.col(c) for c in order] or [F.input_file_name(), F.monotonically_increasing_id()]
    numbered = rows.withColumn("__seq", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(at)]))
    return numbered.groupBy("repo", "fqcn").agg(F.max_by(path, F.col("__seq")).alias("path"))


def coverage_csv(spark: SparkSession, path: str) -> DataFrame:
    """fqcn and summed line and branch counters of a coverage CSV report; inner classes count to their outermost one."""
    schema = "PACKAGE string, CLASS string, LINE_MISSED int, LINE_COVERED int, BRANCH_MISSED int, BRANCH_COVERED int"
    rows = csv_rows(spark, path, schema)
    name = F.concat_ws(".", F.nullif(F.col("PACKAGE"), F.lit("")), F.regexp_replace("CLASS", r"[.$].*", ""))
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return rows.groupBy(name.alias("fqcn")).agg(
        n("LINE_COVERED").alias("line_covered"), (n("LINE_COVERED") + n("LINE_MISSED")).alias("line_total"), n("BRANCH_COVERED").alias("branch_covered"), (n("BRANCH_COVERED") + n("BRANCH_MISSED")).alias("branch_total")
    )


_XML = "_name string, sourcefile array<struct<_name:string,line:array<struct<_nr:int,_mi:int,_ci:int,_mb:int,_cb:int>>,counter:array<struct<_type:string,_missed:int,_covered:int>>>>"


def coverage_xml_lines(spark: SparkSession, path: str) -> DataFrame:
    """package, source_file, line, covered of a coverage XML report."""
    rows = spark.read.format("xml").option("rowTag", "package").schema(_XML).load(path)
    files = rows.select(F.col("_name").alias("package"), F.explode("sourcefile").alias("f"))
    return files.select("package", F.col("f._name").alias("source_file"), F.explode("f.line").alias("l")).select("package", "source_file", F.col("l._nr").alias("line"), (F.col("l._ci") > 0).alias("covered"))


def coverage_xml_counters(spark: SparkSession, path: str) -> DataFrame:
    """package, source_file, line and branch counters (0 where a file has none)."""
    rows = spark.read.format("xml").option("rowTag", "package").schema(_XML).load(path)
    files = rows.select(F.col("_name").alias("package"), F.explode("sourcefile").alias("f"))

    def pick(kind: str, part: str) -> Column:
        return F.coalesce(F.try_element_at(F.transform(F.filter("f.counter", lambda c: c["_type"] == kind), lambda c: c[part]), F.lit(1)), F.lit(0))

    out = {"line_covered": pick("LINE", "_covered"), "line_total": pick("LINE", "_covered") + pick("LINE", "_missed"), "branch_covered": pick("BRANCH", "_covered"), "branch_total": pick("BRANCH", "_covered") + pick("BRANCH", "_missed")}
    return files.select("package", F.col("f._name").alias("source_file"), *[v.alias(k) for k, v in out.items()])


def class_ids(spark: SparkSession, path: str, fqcn: str) -> DataFrame:
    """class_id: ids (16 hexadecimal digits) of lines of a dump whose last word is the class."""
    parts = F.split(F.trim("value"), r"\s+")
    name = F.translate(F.element_at(parts, -1), "/", ".")
    return spark.read.text(path).where((name == fqcn) & F.element_at(parts, 1).rlike("^[0-9a-f]{16}$")).select(F.element_at(parts, 1).alias("class_id")).distinct()


def rule_violations(spark: SparkSession, path: str) -> DataFrame:
    """rule, n of a static-analysis XML report."""
    rows = spark.read.format("xml").option("rowTag", "violation").schema("_rule string, _VALUE string").load(path)
    return rows.groupBy(F.col("_rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def duplicated_lines(spark: SparkSession, path: str) -> DataFrame:
    """blocks, lines of a copy-detection XML report."""
    rows = spark.read.format("xml").option("rowTag", "duplication").schema("_lines int, _tokens int").load(path)
    return rows.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("_lines"), F.lit(0)).alias("lines"))


def source_files(spark: SparkSession, path: str, pattern: str = "*.java") -> DataFrame:
    """path, text: whole files; bytes that are no UTF-8 are dropped.  Spark's scan leaves empty files out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", utf8_text(F.col("content")).alias("text"))


def files_by_name(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """name, path: the first path, in order, of each wanted base name; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(names.select("name").distinct(), "name", "left_semi")
    return found.groupBy("name").agg(F.min("path").alias("path"))


def log_lines(logs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pos, line of each log."""
    return logs.select(*keys, F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))


def tree_entries(rows: DataFrame, name: str, body: str) -> DataFrame:
    """name, path, truncated of the files in landed JSON trees ``{"truncated", "tree": [{"type", "path"}]}``; what is no such
    tree has no files, and one that does not say whether it is cut is not."""
    landed = rows.select(name, F.try_parse_json(F.col(body)).alias("__v"))
    entries = F.try_variant_get("__v", "$.tree", "array<struct<type:string,path:string>>")
    cut = F.coalesce(F.try_variant_get("__v", "$.truncated", "boolean"), F.lit(False))
    return landed.select(name, cut.alias("truncated"), F.explode(entries).alias("e")).where("e.type = 'blob'").select(name, "e.path", "truncated")


def archive_entries(spark: SparkSession, path: str, pattern: str = "*.{jar,zip}") -> DataFrame:
    """path, entry, major: entries of zip archives; class files have the major version of their header, others null.

    An archive is read whole by one task, and entries are streamed from it; broken archives give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for entry in z.namelist():
                            major = None
                            if entry.endswith(".class"):
                                with z.open(entry) as f:
                                    head = f.read(8)
                                if head[:4] == b"\xca\xfe\xba\xbe" and len(head) == 8:
                                    major = int.from_bytes(head[6:8], "big")
                            rows.append((name, entry, major))
                except zipfile.BadZipFile:
                    continue
                yield pd.DataFrame(rows, columns=["path", "entry", "major"]).astype({"major": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, entry string, major int")


#: Names of properties and tags, and texts of other build tools, that say a Java version, in the order in which
#: they are asked.  ``{}`` stands for source or target.
VERSION_PROPERTIES = ("maven.compiler.{}", "compiler.{}", "java.version", "maven.compiler.release")
VERSION_TAGS = ("maven.compiler.{}", "compiler.{}", "{}", "java.version", "maven.compiler.release", "release")
VERSION_TEXTS = (r"{}Compatibility\s*=?\s*['\"]?(?:JavaVersion\.VERSION_)?([\d._]+)", r"JavaLanguageVersion\.of\((\d+)", r"java-version:\s*['\"]?([\d.]+)")


def java_versions(text: Column) -> Column:
    """struct<source, target>: the Java versions that a build file asks for, as written; null if it says nothing.

    Properties come first (with one reference resolved), then tags, then other tools' texts, each in its list's order; the
    one that is not said is as the other.
    """

    def asked(kind: str) -> Column:
        named = [resolve_properties(text, F.nullif(_property(text, p.format(kind)), F.lit(""))) for p in VERSION_PROPERTIES]
        tags = [F.regexp_extract(text, f"<{re.escape(t.format(kind))}>([\\d.]+)</{re.escape(t.format(kind))}>", 1) for t in VERSION_TAGS]
        texts = [F.regexp_extract(text, p.replace("{}", kind), 1) for p in VERSION_TEXTS]
        return F.coalesce(*named, *[F.nullif(found, F.lit("")) for found in (*tags, *texts)])

    source, target = asked("source"), asked("target")
    return F.struct(F.coalesce(source, target).alias("source"), F.coalesce(target, source).alias("target"))


def java_version(text: Column) -> Column:
    """Major source version, null if the file says none; 1.8 and 1_8 are 8."""
    return F.regexp_replace(F.translate(java_versions(text)["source"], "_", "."), r"^1\.", "").try_cast("double").cast("int")


#: The first block of properties, and one of them.
_BLOCK, _PROPERTY = r"(?s)<properties>(.*?)</properties>", r"<([^/>]+)>([^<]+)</\1>"


def _property(text: Column, name: str | Column) -> Column:
    """The last value of a property in the text's block of them, trimmed; null if there is none."""
    block = F.regexp_extract(text, _BLOCK, 1)
    names = F.transform(F.regexp_extract_all(block, F.lit(_PROPERTY), F.lit(1)), F.trim)
    values = F.regexp_extract_all(block, F.lit(_PROPERTY), F.lit(2))
    place = F.array_position(F.reverse(names), F.lit(name) if isinstance(name, str) else name)
    return F.when(place > 0, F.trim(F.try_element_at(F.reverse(values), place.cast("int"))))


def resolve_properties(text: Column, value: Column) -> Column:
    """value with one level of ``${name}`` replaced from the text's <properties>; itself if there is no such property."""
    name = F.regexp_extract(value, r"^\$\{([^}]+)\}$", 1)
    return F.coalesce(F.when(name != "", _property(text, name)), value)
