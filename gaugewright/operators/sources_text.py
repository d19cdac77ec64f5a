"""What source files, selectors, logs and workflow files say: predicates and extractions over their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..functions import java, text
from . import ordered, statistics

#: Marks of test sources, of merged texts, words of workflow files, signs that no test name may have.
TEST_MARKERS = (
    "@Test", "@ParameterizedTest", "@RepeatedTest", "@TestFactory", "@TestTemplate", "@RunWith(", "@ExtendWith(", " extends TestCase", "org.junit.Test", "org.junit.jupiter.api.Test",
)
WORKFLOW_WORDS = (" test", "tests", "unit test", "integration test", "mvn test", "mvn verify", "gradle test", "./gradlew test", "./gradlew check", "pytest", "npm test", "yarn test")
NAME_BANNED = r"[@\[\]{};:=,.]"
BODY_BANNED = ("@Test", "Given(", "When(", "Then(")
SUFFIX = r"_ESTest(_scaffolding)?$"


def contains_any(value: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | value.contains(p)
    return out


def is_test_source(name: Column, code: Column) -> Column:
    return text.test_file_name(name) | contains_any(F.coalesce(code, F.lit("")), TEST_MARKERS)


def matches_target(code: Column, stem: Column, target: Column) -> Column:
    """Whether a generated file belongs to a target class: its name without the suffix is the class's, and its package is
    the target's or it names the target in full.  Targets without a package match everything."""
    name = F.regexp_replace(text.class_of(code, stem), SUFFIX, "")
    package, simple = F.regexp_replace(target, r"\.[^.]*$", ""), F.regexp_extract(target, r"([^.]*)$", 1)
    same = (name == simple) & (text.package_of(code).isNull() | (text.package_of(code) == package) | F.contains(code, target))
    return F.when(~target.contains("."), True).otherwise(same)


def target_of(selector: Column) -> Column:
    """Target class of a generated test's selector; null for a blank one."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(selector, "#.*$", ""), r"(?<=[^.])_ESTest[^.]*$", ""), "_Sanitized$", "")
    return F.nullif(F.trim(name), F.lit(""))


def failed_methods(log: Column, test_class: str) -> Column:
    """Distinct methods of the class that a run's log reports as failed, interrupted or dropped by a fork's exit."""
    quoted = "".join(c if c.isalnum() else "\\" + c for c in test_class)
    one = r"([A-Za-z_][A-Za-z0-9_]*)\b"
    patterns = (rf"FAILURE in\s+{quoted}#{one}", rf"Test (?:failed|interrupted):\s+{quoted}#{one}", rf"\[DROP\]\s+{quoted}#{one}[^\n]*\bfork-exit=")
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(log, F.lit(p), F.lit(1)) for p in patterns])))


def choose_result(sanitized_status: Column, sanitized_found: Column, baseline_status: Column, baseline_found: Column) -> Column:
    """struct<side, reason>: which of two filter results holds."""
    pick = lambda side, reason: F.struct(F.lit(side).alias("side"), F.lit(reason).alias("reason"))
    return (
        F.when(sanitized_status == "passed", pick("sanitized", "prefer_sanitized"))
        .when(baseline_status == "passed", pick("baseline", "fallback_to_baseline"))
        .when(sanitized_found, pick("sanitized", "sanitized_failed_without_baseline_recovery"))
        .when(baseline_found, pick("baseline", "baseline_failed_last_fallback"))
        .otherwise(pick("sanitized", "missing_generated_variant"))
    )


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, null if none does (skip decisions, outcome categories)."""
    out = F.lit(None).cast("string")
    for test, name in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), name).otherwise(out)
    return out


def usable_test_name(name: Column, original: Column) -> Column:
    """The trimmed name, or null where it has a banned sign, has not 5 to 50 characters or is the original one."""
    kept = F.trim(name)
    return F.when(~name.rlike(NAME_BANNED) & F.length(kept).between(5, 50) & ~kept.eqNullSafe(original), kept)


def plausible_body(body: Column) -> Column:
    """try and catch come together and no banned word occurs."""
    return (body.contains("try") == body.contains("catch")) & ~contains_any(body, BODY_BANNED)


def checked_methods(code: Column) -> Column:
    """array<struct<name, code, pos, valid>> of a response's test methods: valid if their braces close."""
    kind = ArrayType(StructType([StructField("name", StringType()), StructField("code", StringType()), StructField("pos", IntegerType()), StructField("valid", BooleanType())]))

    def split(source: str) -> list[dict]:
        import re

        masked = java.mask(source)
        starts = [m.start() for m in re.finditer(r"@Test\b", masked, re.I)]
        out = []
        for pos, at in enumerate(starts):
            end = starts[pos + 1] if pos + 1 < len(starts) else len(masked)
            m = re.compile(r"public\s+void\s+(\w+)\s*\([^)]*\)[^{]*\{").search(masked, at, end)
            if not m:
                continue
            brace = m.end() - 1
            close = java.closing(masked, brace)
            whole = masked[brace : close + 1]
            valid = whole.count("{") == whole.count("}") and close < end
            out.append({"name": m[1], "code": source[at : (close + 1 if valid else end)].strip(), "pos": pos, "valid": valid})
        return out

    @F.pandas_udf(kind)
    def run(values):
        import pandas as pd

        return pd.Series([split(v or "") for v in values])

    return run(code)


def workflow_flags(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, test_in_name, test_in_content, runs_tests of workflow files (name, content); only YAML contents count."""
    name, content = F.lower("name"), F.lower(F.coalesce("content", F.lit("")))
    named = F.bool_or(name.contains("test"))
    said = F.bool_or(name.rlike(r"\.ya?ml$") & contains_any(content, WORKFLOW_WORDS))
    return files.groupBy(*keys).agg(named.alias("test_in_name"), said.alias("test_in_content"), (named | said).alias("runs_tests"))


def declares(code: Column) -> dict[str, Column]:
    """Mechanisms that a test file uses: instance fields, life-cycle methods, fully qualified local types."""
    return {
        "instance_field": code.rlike(r"(?m)^\s+(?:private|protected|public)\s+(?!static\b)(?:final\s+)?[\w.<>\[\], ]+\s+\w+\s*(?:=[^;]*)?;"),
        "life_cycle": code.rlike(r"@(?:Before|After)(?:Each|All|Class)?\b"),
        "qualified_local": code.rlike(r"(?m)^\s+(?:[a-z]\w*\.){2,}[A-Z]\w*(?:<[^;=]*>)?\s+\w+\s*="),
    }


def merge_gaps(spans: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: spans merged across gaps in which no line is code.

    spans: keys, start, end, coalesced before; flags: keys, line, is_code.  Code lines are counted up once, so a gap is
    free of code where the count is the same on both sides: two equality joins, no join of spans with lines between.
    """
    line = ordered.by_position(flags.select(*keys, "line", "is_code"), keys, F.col("line"))
    counted = ordered.running(line, [F.col("line")], {"__code": ("sum", F.col("is_code").cast("long"))})
    at = lambda c, n: counted.select(*keys, F.col("line").alias(c), F.col("__code").alias(n))
    rows = ordered.running(ordered.by_position(spans, keys, F.col("start")), [F.col("start")], {"__held": ("last", F.col("end"))}, upto=-1)
    rows = rows.withColumn("__last", F.col("start") - 1)
    rows = rows.join(at("__held", "__a"), [*keys, "__held"], "left").join(at("__last", "__b"), [*keys, "__last"], "left")
    head = F.when(F.col("__a") == F.col("__b"), F.lit(None)).otherwise(F.col("start"))
    runs = ordered.running(rows, [F.col("start")], {"__run": ("max", head)})
    return runs.groupBy(*keys, F.col("__run").alias("start")).agg(F.max("end").alias("end"))


def held_out(items: DataFrame, keys: list[str], item: str, k: int, repeats: int, seed: int = 1) -> DataFrame:
    """keys, item, repeat, held: for each repeat k items of a key by hash order are held out, the others not.

    A key's items are methods of one target, or targets of one repository."""
    from pyspark.sql import Window

    spread = items.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    w = Window.partitionBy(*keys, "repeat").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(item).cast("string"))), item)
    return spread.withColumn("held", F.row_number().over(w) <= k)


def described(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, n, mean, sd, q1, median, q3 of each metric column."""
    long = df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").where("value is not null")
    rows = long.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return statistics.joined(rows, statistics.quantiles(long, [*keys, "metric"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}), [*keys, "metric"])


def error_locations(logs: DataFrame, keys: list[str], log: str = "text") -> DataFrame:
    """keys, file, line: distinct places of errors in compiler logs."""
    pattern = r"(\S+\.java):(\d+): error"
    both = F.arrays_zip(F.regexp_extract_all(F.col(log), F.lit(pattern), F.lit(1)).alias("file"), F.regexp_extract_all(F.col(log), F.lit(pattern), F.lit(2)).alias("line"))
    rows = logs.select(*keys, F.explode(both).alias("e"))
    return rows.select(*keys, "e.file", F.col("e.line").cast("int").alias("line")).distinct()


def methods_hit(methods: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """methods(keys, file, name, start, end) that span an error line: spans are spread into lines for an equality join."""
    lines = methods.withColumn("line", F.explode(F.sequence("start", "end")))
    return lines.join(errors.select(*keys, "file", "line"), [*keys, "file", "line"], "left_semi").drop("line").distinct()


def package_hints(logs: DataFrame, keys: list[str], log: str = "text") -> DataFrame:
    """keys, symbol, packages: for each missing symbol the packages that its file imports such a name from or that the
    log reports as missing just before."""
    from pyspark.sql import Window

    lines = logs.select(*keys, F.posexplode(F.split(log, "\n")).alias("pos", "line"))
    package = F.nullif(F.regexp_extract("line", r"package\s+([\w.]+)\s+does not exist", 1), F.lit(""))
    symbol = F.nullif(F.regexp_extract("line", r"symbol:\s+(?:class|variable|interface)\s+(\w+)", 1), F.lit(""))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(*keys, "pos", F.last(package, ignorenulls=True).over(w).alias("package"), symbol.alias("symbol")).where("symbol is not null and package is not null")
    return rows.groupBy(*keys, "symbol").agg(F.array_sort(F.collect_set("package")).alias("packages"))
