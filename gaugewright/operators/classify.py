"""Ordered first-match classifiers of log texts, log entities, response parsing, and status decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (category, test) in order.  A test is a list of alternatives; an alternative is a list of texts that all
#: occur, or of patterns (``~`` in front).  Compile and build logs are matched in lower case.
COMPILE = (
    ("missing_symbol_and_package", [["cannot find symbol", r"~package\s+[a-z0-9_.$]+\s+does not exist"]]),
    ("missing_symbol", [["cannot find symbol"]]),
    ("missing_package", [[r"~package\s+[a-z0-9_.$]+\s+does not exist"]]),
    ("missing_class_file", [["class file for", "not found"]]),
    ("duplicate_class", [["duplicate class:"]]),
    ("incompatible_types", [["incompatible types:"]]),
    ("argument_mismatch", [["cannot be applied to given types"]]),
    ("access_error", [["has private access in"], ["has protected access in"], ["is not public in"]]),
    ("syntax_error", [["reached end of file while parsing"], ["';' expected"], ["<identifier> expected"], ["illegal start of expression"], ["not a statement"]]),
)
RUN = (
    ("coverage_agent_error", [["Error opening zip file"], ["agent library failed to init"]]),
    ("assertion_failure", [["AssertionError"], ["AssertionFailedError"], ["ComparisonFailure"]]),
    ("missing_runtime_dependency", [["NoClassDefFoundError"], ["ClassNotFoundException"], ["ServiceConfigurationError", "Provider", "not found"]]),
    ("linkage_error", [["NoSuchMethodError"], ["NoSuchFieldError"], ["IllegalAccessError"], ["IncompatibleClassChangeError"], ["AbstractMethodError"]]),
    ("initialization_error", [["ExceptionInInitializerError"]]),
    ("runtime_error", [["Exception:"], ["Error:"]]),
)
BUILD = (
    ("REACTOR_MISSING", [["could not find the selected project in the reactor"]]),
    ("PACKAGING_NOT_JAR", [["packaging pom"], ["is not a jar"]]),
    ("ASSEMBLY_NO_DESCRIPTORS", [["no assembly descriptors found"]]),
    ("ASSEMBLY_SKIPPED", [["skipassembly", "true"], ["skipassembly", "skipping"]]),
    ("NO_MAIN_ARTIFACT", [["the project has not been built yet"], ["no file assigned to build artifact"]]),
    ("JDK_TOO_OLD", [["release version", "not supported"]]),
    ("ENFORCER_JDK", [["requires at least jdk"], ["minimum java version"], ["maven-enforcer-plugin"]]),
    ("DEPS_RESOLUTION", [["could not resolve dependencies"], ["could not find artifact"]]),
)
GENERATOR = (
    ("unknown_class_in_projectcp", [["Unknown class:"]]),
    ("no_test_case_generated", [["failed to generate any test case"]]),
    ("evosuite_fatal_crash", [["Fatal crash on main EvoSuite process"]]),
    ("generated_test_compile_failure", [["Compilation failed on compilation units"]]),
    ("missing_class_or_dep", [["ClassNotFoundException"], ["NoClassDefFoundError"], ["should be in target project, but could not be found"], ["cannot find symbol"]]),
    ("oom", [["OutOfMemoryError"]]),
)
API = (
    ("access_blocked", [[r"~^Repository access blocked$"]]),
    ("not_found", [[r"~^Not Found$"]]),
    ("no_commit_found", [["No commit found for SHA"]]),
)


def first_match(text: Column, rules, other: Column | str, lower: bool = False) -> Column:
    """The category of the first rule that holds, else ``other``; null text counts as empty."""
    value = F.coalesce(text, F.lit(""))
    value = F.lower(value) if lower else value
    hit = lambda t: value.rlike(t[1:]) if t.startswith("~") else value.contains(t)
    out = None
    for category, alternatives in rules:
        test = F.lit(False)
        for parts in alternatives:
            every = F.lit(True)
            for p in parts:
                every = every & hit(p)
            test = test | every
        out = F.when(test, category) if out is None else out.when(test, category)
    return out.otherwise(other)


def compile_problem(log: Column) -> Column:
    return F.when(F.trim(F.coalesce(log, F.lit(""))) == "", "no_javac_output").otherwise(first_match(log, COMPILE, "other_compile_error", lower=True))


def run_failure(log: Column, selector: Column | None = None) -> Column:
    rest = first_match(log, RUN, "test_process_failed")
    if selector is None:
        return rest
    missing = F.locate("ClassNotFoundException: ", log) > 0
    named = F.regexp_extract(log, r"ClassNotFoundException:\s+([\w.$]+)", 1) == selector
    return F.when(missing & named, "not_compiled").otherwise(rest)


def build_failure(log: Column) -> Column:
    return first_match(log, BUILD, "UNKNOWN", lower=True)


def generator_failure(log: Column) -> Column:
    return first_match(log, GENERATOR, "other")


def api_error(message: Column) -> Column:
    return F.when(message.isNull(), "error").otherwise(first_match(message, API, "repeat"))


def error_tail(log: Column, most: int = 15, plain: int = 20) -> Column:
    """The last lines with "error" or "failed", else the last lines."""
    lines = F.split(log, "\n")
    bad = F.filter(lines, lambda x: F.lower(x).rlike("error|failed"))
    last = lambda a, n: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)
    return F.array_join(F.when(F.size(bad) > 0, last(bad, most)).otherwise(last(lines, plain)), "\n")


def first_line(log: Column, pattern: str) -> Column:
    """The first line that matches, trimmed; null if none does."""
    return F.trim(F.try_element_at(F.filter(F.split(log, "\n"), lambda x: x.rlike(pattern)), F.lit(1)))


def entities(logs: DataFrame, keys: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """keys, kind, entity, position: distinct first groups of each pattern with their first place in the text."""
    kinds = [_tagged(text, k, p) for k, p in patterns.items()]
    rows = logs.select(*keys, F.explode(F.concat(*kinds)).alias("e")).where("e.entity <> ''")
    return rows.groupBy(*keys, "e.kind", "e.entity").agg(F.min("e.position").alias("position"))


def _tagged(text: str, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("entity"), i.alias("position")))


def runner_summary(log: Column) -> Column:
    """struct<started, skipped, failed> of a runner's summary line; null parts where it has none."""
    number = lambda k: F.nullif(F.regexp_extract(log, rf"\b{k}=(\d+)", 1), F.lit("")).try_cast("int").alias(k)
    return F.struct(number("started"), number("skipped"), number("failed"))


def safe_assertion_failure(log: Column, veto: list[str], tokens: list[str]) -> Column:
    """No veto text and some assertion token."""
    value = F.coalesce(log, F.lit(""))
    bad, good = F.lit(False), F.lit(False)
    for v in veto:
        bad = bad | value.contains(v)
    for t in tokens:
        good = good | value.contains(t)
    return ~bad & good


def test_name_problem(name: Column, original: Column) -> Column:
    """null for a usable new test name, else what is wrong with it."""
    return (
        F.when(name.isNull() | (F.length(name) < 5), "too_short").when(F.length(name) > 50, "too_long").when(~name.rlike(r"^[A-Za-z_$][\w$]*$"), "bad_character").when(name == original, "unchanged")
    )


def quoted_pool(response: Column) -> Column:
    """Quoted sentences of a numbered list, a line each."""
    return F.array_join(F.regexp_extract_all(response, F.lit(r'(?m)(?:^\d+\.\s*)?"(.*?)"'), F.lit(1)), "\n")


def class_name_of_prompt(prompt: Column, default: str = "GeneratedClass") -> Column:
    named = F.nullif(F.regexp_extract(prompt, r"\bclass\s+([A-Z][\w$]*)", 1), F.lit(""))
    camel = F.nullif(F.regexp_extract(prompt, r"\b((?:[A-Z][a-z0-9]+){2,})\b", 1), F.lit(""))
    return F.coalesce(named, camel, F.lit(default))


def incomplete_merge(text: Column) -> Column:
    return F.lower(text).rlike(r"(?m)^\s*// \.\.\. (?:keep|existing|rest)") | F.lower(text).contains("existing code unchanged")
