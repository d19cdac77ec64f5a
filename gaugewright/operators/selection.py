"""Choosing projects and classes: path classification, test pairing, activity, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import test_names_of
from .ranking import top_k

#: Names of folders for tests.
TEST_FOLDERS = ("test", "tests", "integration-tests", "unit-tests")


def is_test_folder(part: Column) -> Column:
    return part.isin(*TEST_FOLDERS) | part.rlike(r"^tests?-|-tests?$|^src\.test|^src[-_]tests")


def path_kind(path: Column) -> Column:
    """test, source or null of a Java file's path: any test folder makes it a test, else a src folder a source."""
    parts = F.split(F.lower(path), "/")
    kind = F.when(F.exists(parts, is_test_folder), "test").when(F.array_contains(parts, "src"), "source")
    return F.when(path.endswith(".java"), kind)


def simple_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.\w+$", 1)


def tests_of_sources(sources: DataFrame, tests: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """sources with test_paths: paths of tests named after them.  Names are expanded to keys of an equality join."""
    wanted = sources.select(*keys, path, F.explode(test_names_of(simple_name(F.col(path)))).alias("__name"))
    found = tests.select(*keys, F.col(path).alias("__test"), simple_name(F.col(path)).alias("__name"))
    per = wanted.join(found, [*keys, "__name"]).groupBy(*keys, path).agg(F.array_sort(F.collect_set("__test")).alias("test_paths"))
    return sources.join(per, [*keys, path])


def active(rows: DataFrame, as_of: str, commits: str = "commit_count", last: str = "last_commit", least: int = 10, days: int = 730) -> DataFrame:
    """Rows with enough commits, the last one not older than ``days`` before as_of."""
    since = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return rows.where((F.col(commits) >= least) & F.col(last).isNotNull() & (F.col(last) >= since))


def select_classes(rows: DataFrame, project: list[str], as_of: str, per_project: int = 2) -> DataFrame:
    """The most active classes with tests of each project, by commits, then date, then path."""
    kept = active(rows.where(F.size("test_paths") > 0), as_of)
    return top_k(kept, project, ("-commit_count", "-last_commit", "path"), per_project)


def commit_stats(commits: DataFrame, keys: list[str], ts: str, most: int = 100) -> DataFrame:
    """keys, commit_count (``most`` at most, as the source reports no more), last_commit."""
    return commits.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("commit_count"), F.max(ts).alias("last_commit"))


def usage_flags(files: DataFrame, keys: list[str], path: str, phrases: dict[str, str], patterns: dict[str, str]) -> DataFrame:
    """keys and for each name whether a path holds the phrase (any case) or matches the pattern from its start."""
    flags = [F.max(F.lower(F.col(path)).contains(p.lower()).cast("int")).alias(n) for n, p in phrases.items()]
    flags += [F.max(F.col(path).rlike(f"^(?:{p})").cast("int")).alias(n) for n, p in patterns.items()]
    return files.groupBy(*keys).agg(*flags)


#: Ends of archive names that hold no classes to run, and runtime jars that a class path has of its own.
NO_CLASSES = r"(?i)(?:-(?:sources|javadoc|tests|test-sources|original))\.jar$"
RUNTIME = r"(?i)(?:^|[/-])?(?:junit|junit-jupiter|junit-platform|hamcrest)[-\w]*-\d[\w.]*\.jar$"


def no_artifact(path: Column) -> Column:
    """Whether a file is no artifact to test with: sources, documentation, or a test runtime's own jar."""
    return F.coalesce(path.rlike(NO_CLASSES) | path.rlike(RUNTIME), F.lit(False))


def fatjar_problem(value: Column) -> Column:
    """Whether an artifact path is a sentinel: empty, FAIL, FAIL:..., SKIP..."""
    return F.coalesce(F.trim(value).rlike(r"(?i)^(fail(:.*)?|skip.*)?$"), F.lit(True))


#: Names, beginnings and endings of files that guide contributors, in the order in which they are read, and
#: folders that are not looked into.
GUIDE_NAMES = ("agents.md", "claude.md", "copilot-instructions.md")
GUIDE_PREFIXES = ("contributing", "readme", "testing", "development")
GUIDE_SUFFIXES = ("", ".md", ".markdown", ".rst", ".txt", ".adoc")
PRUNED = (".agents", ".git", ".gradle", ".idea", "build", "dist", "node_modules", "target", "vendor")


def _base(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def is_guidance(path: Column, deepest: int = 4) -> Column:
    """Whether a relative path is that of a file that guides contributors: by its name, not below a pruned folder, and not
    deeper than ``deepest`` folders."""
    name, parts = _base(path), F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    suffix = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)  # a leading or last dot begins none
    named = name.isin(*GUIDE_NAMES) | (suffix.isin(*GUIDE_SUFFIXES) & name.rlike(f"^(?:{'|'.join(GUIDE_PREFIXES)})"))
    return named & ~F.arrays_overlap(folders, F.array(*map(F.lit, PRUNED))) & (F.size(folders) <= deepest)


def guidance_order(path: Column) -> Column:
    """struct<scope, kind, path> by which such files are taken: those at the root, then of .github, then others; by name."""
    name, parts = _base(path), F.split(F.lower(path), "/")
    scope = F.when(F.size(parts) == 1, 0).when(parts[0] == ".github", 1).otherwise(2)
    kinds = [F.when(name == GUIDE_NAMES[0], 0), *[F.when(name.startswith(p), i + 1) for i, p in enumerate(GUIDE_PREFIXES)], F.lit(len(GUIDE_PREFIXES) + 1)]
    return F.struct(scope.alias("scope"), F.coalesce(*kinds).alias("kind"), F.lower(path).alias("path"))
