"""Coverage units, deltas and the incremental filter as set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def units(counters: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    """keys, kind, ordinal: a unit for each ordinal 1..k of each counter column; no unit for a counter of 0 or null."""
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(F.col(c).cast("int"), F.lit(0)).alias("k")) for c, kind in kinds.items()])
    rows = counters.select(*keys, F.explode(each).alias("__u")).where("__u.k > 0")
    return rows.select(*keys, "__u.kind", F.explode(F.sequence(F.lit(1), F.col("__u.k"))).alias("ordinal"))


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def beyond(candidate: DataFrame, baseline: DataFrame, unit: list[str]) -> DataFrame:
    """Candidate rows whose unit the baseline lacks."""
    return candidate.join(baseline.select(*unit).distinct(), unit, "left_anti")


def owners(candidates: DataFrame, baseline: DataFrame, unit: list[str], order: str, target: tuple[str, ...] = ()) -> DataFrame:
    """target, unit, owner: the first candidate in ``order`` that holds each unit beyond the baseline.

    The sequential filter keeps a candidate when it adds a unit to what baseline and kept candidates before it hold.  A
    dropped candidate adds nothing, so what was held is the union of all before: a candidate is kept when it is the first
    owner of some unit.  One anti-join and one minimum a unit replace the loop.
    """
    keys = [*target, *unit]
    return beyond(candidates, baseline, keys).groupBy(*keys).agg(F.min(order).alias("owner"))


def incremental_filter(candidates: DataFrame, baseline: DataFrame, unit: list[str], order: str, target: tuple[str, ...] = ()) -> DataFrame:
    """target, candidate, added (units beyond the baseline), owned (units it is the first to add): kept candidates.

    Rows without a place in the order are left out, at once, so that both counts read one shuffle of the candidates.
    """
    keys = [*target, *unit]
    new = beyond(candidates.where(F.col(order).isNotNull()), baseline, keys).select(*keys, order).distinct()
    added = new.groupBy(*target, order).agg(F.count(F.lit(1)).alias("added"))
    owned = new.groupBy(*keys).agg(F.min(order).alias(order)).groupBy(*target, order).agg(F.count(F.lit(1)).alias("owned"))
    return added.join(owned, [*target, order]).withColumnRenamed(order, "candidate")


def class_deltas(candidate: DataFrame, baseline: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """keys and candidate minus baseline for each count (a missing baseline row is 0); all-zero rows go."""
    base = baseline.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in counts])
    joined = candidate.join(base, keys, "left")
    out = joined.select(*keys, *[(F.col(c) - F.coalesce(F.col(f"__b_{c}"), F.lit(0))).alias(c) for c in counts])
    changed = F.lit(False)
    for c in counts:
        changed = changed | (F.col(c) != 0)
    return out.where(changed)


def line_transitions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, newly (lines that were not covered and are), upgraded (partly before, fully after); status is 0, 1 or 2."""
    joined = after.join(before.select(*keys, "line", F.col("status").alias("__was")), [*keys, "line"], "left")
    was = F.coalesce(F.col("__was"), F.lit(0))
    newly, upgraded = (was == 0) & (F.col("status") > 0), (was == 1) & (F.col("status") == 2)
    return joined.where(newly | upgraded).groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(newly, F.col("line")))).alias("newly"), F.array_sort(F.collect_set(F.when(upgraded, F.col("line")))).alias("upgraded")
    )


def totals(deltas: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    return deltas.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def denominators(tables: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """The largest total of each key over all tables; tables may lack columns."""
    out = tables[0].select(*keys, *[c for c in columns if c in tables[0].columns])
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys, *[c for c in columns if c in t.columns]), allowMissingColumns=True)
    return out.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def pick_denominator(rows: DataFrame, keys: list[str], value: str, own: Column) -> DataFrame:
    """keys, value: the largest positive value of rows where ``own`` holds, else of the others, else 0."""
    mine = F.max(F.when(own & (F.col(value) > 0), F.col(value)))
    other = F.max(F.when(~own & (F.col(value) > 0), F.col(value)))
    return rows.groupBy(*keys).agg(F.coalesce(mine, other, F.lit(0)).alias(value))


def is_target_class(name: Column, target: Column) -> Column:
    """The class itself or one nested in it."""
    return (name == target) | name.startswith(F.concat(target, F.lit("$")))


def select_classes(classes: DataFrame, targets: DataFrame, package: str = "package", source_file: str = "source_file") -> DataFrame:
    """Classes of the same package and source file as a target."""
    places = classes.join(targets.select("class_name").distinct(), "class_name", "left_semi").select(package, source_file).distinct()
    return classes.join(places, [package, source_file], "left_semi")


def positive(*counts: Column) -> Column:
    """Whether any count is above 0; null counts as 0."""
    out = F.lit(False)
    for c in counts:
        out = out | (F.coalesce(c, F.lit(0)) > 0)
    return out


def class_level(manual: DataFrame, candidate: DataFrame, unit: list[str]) -> DataFrame:
    """n_manual, n_candidate, n_new: sizes of the unit sets and of candidate without manual."""
    m, c = manual.select(*unit).distinct(), candidate.select(*unit).distinct()
    tagged = m.select(*unit, F.lit(1).alias("__m"), F.lit(0).alias("__c")).unionByName(c.select(*unit, F.lit(0).alias("__m"), F.lit(1).alias("__c")))
    per = tagged.groupBy(*unit).agg(F.max("__m").alias("__m"), F.max("__c").alias("__c"))
    return per.agg(F.count_if(F.col("__m") == 1).alias("n_manual"), F.count_if(F.col("__c") == 1).alias("n_candidate"), F.count_if((F.col("__c") == 1) & (F.col("__m") == 0)).alias("n_new"))
