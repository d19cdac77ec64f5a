"""Expectations across tables; each returns the violating rows, none if it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.folders import checkpointed


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct child keys without a parent."""
    return child.select(F.col(child_key).alias("key")).where("key is not null").join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti").distinct()


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def differing_sets(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side of rows in one set only."""
    tagged = left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    per = tagged.groupBy(*keys).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r")).where("__l <> __r")
    return per.select(*keys, F.when(F.col("__l") == 1, "left").otherwise("right").alias("side"))


def violations(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """keys, check of rows for which a check is false or null."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(failed).alias("check"))


def outside(df: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """keys, n of groups with fewer or more rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(~F.col("n").between(least, most))


def exact_rows(df: DataFrame, key: str, wanted: int) -> DataFrame:
    """rows, keys if these are not both ``wanted``, else nothing."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).where((F.col("rows") != wanted) | (F.col("keys") != wanted))


#: Roles of methods in a target's tables, and stages of which each target has one row.
ROLES = ("manual", "marked", "runnable", "measured", "positive", "reduced", "annotated", "merged")
STAGES = ("run", "compare", "reduce", "annotate")


def validation(targets: DataFrame, methods: DataFrame, wanted: int, top: int, seen: Observation | None = None) -> DataFrame:
    """check, severity, key, detail: what fails of the checks on a run's tables; nothing if all hold.

    targets: target, status, discovered, markers, drafts, stages (array), total, merged_total, increment; methods: target,
    method, role (of ROLES), pos.  Each table is read once: methods become lists by role of their target (a class's methods),
    targets are joined with them and checkpointed.  ``seen`` is told the rows and failed runs of targets as they are read.
    """
    if seen is not None:
        targets = targets.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") != "passed").alias("not_passed"))
    lists = methods.groupBy("target").agg(*[F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("pos", "method")))).alias(f"__{r}") for r in ROLES])
    rows = checkpointed(targets.join(lists, "target", "left"))
    none = F.array().cast("array<string>")
    name = {r: F.coalesce(F.col(f"__{r}")["method"], none) for r in ROLES}
    n = {r: F.size(name[r]) for r in ROLES}
    inside = lambda a, b: F.size(F.array_except(name[a], name[b])) == 0
    same = lambda a, b: F.array_sort(name[a]) == F.array_sort(name[b])
    once = lambda r: F.size(F.array_distinct(name[r])) == n[r]
    number = lambda c: F.col(c).cast("string")
    listed = lambda a: F.concat_ws(",", a)
    some = n["positive"] > 0
    each = {
        "V-1 run passed": ("error", F.col("status") == "passed", F.col("status")),
        "V-2 marked methods are new, in order": ("error", name["marked"] == F.array_except(name["merged"], name["manual"]), listed(name["marked"])),
        "V-3 discovered are runnable": ("error", F.col("discovered") == n["runnable"], number("discovered")),
        "V-4 measured are discovered": ("error", F.col("discovered") == n["measured"], number("discovered")),
        "V-5 positive are runnable": ("error", inside("positive", "runnable"), listed(F.array_except(name["positive"], name["runnable"]))),
        "V-6 positive targets have a draft": ("warning", ~some | (F.col("drafts") > 0), number("drafts")),
        "V-7 one marker": ("error", F.col("markers") == 1, number("markers")),
        "V-8 a row for each stage": ("error", F.size(F.array_except(F.array(*map(F.lit, STAGES)), F.coalesce("stages", none))) == 0, listed(F.coalesce("stages", none))),
        "V-9 selected within limits": ("error", ~some | n["reduced"].between(1, top), n["reduced"].cast("string")),
        "V-10 reduced are the first selectors": ("error", name["reduced"] == F.slice(name["positive"], 1, top), listed(name["reduced"])),
        "V-11 annotated are the reduced, once": ("error", same("annotated", "reduced") & once("annotated"), listed(name["annotated"])),
        "V-12 one draft a positive target": ("warning", F.col("drafts") == some.cast("int"), number("drafts")),
        "V-14 totals kept, increments not negative": ("error", (F.col("total") == F.col("merged_total")) & (F.col("increment") >= 0), F.concat_ws("/", number("total"), number("merged_total"), number("increment"))),
        "V-15 merged names once": ("error", once("merged"), listed(name["merged"])),
    }
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.coalesce(detail, F.lit("")).alias("detail"))) for check, (severity, ok, detail) in each.items()]
    found = rows.select(F.col("target").cast("string").alias("key"), F.explode(F.array_compact(F.array(*failed))).alias("f")).select("f.check", "f.severity", "key", "f.detail")
    whole = exact_rows(rows, "target", wanted).select(F.lit("V-13 rows and targets").alias("check"), F.lit("error").alias("severity"), F.lit("").alias("key"), F.concat_ws("/", "rows", "keys").alias("detail"))
    return found.unionByName(whole)
