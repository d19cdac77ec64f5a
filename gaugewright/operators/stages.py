"""Operators over the tables of a run: inventories, stage summaries, deltas of tests and lines, runs and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges, scalars, text
from . import ordered, statistics
from .coverage import is_target_class, positive
from .ranking import best, first_wins, order_of, top_k


def inventory(rows: DataFrame) -> DataFrame:
    """Rows with generated and manual tests; numbers that are none count as 0."""
    n = lambda c: scalars.int_or_zero(F.col(c).cast("string"))
    return rows.where((n("generated_count") > 0) & (n("manual_count") > 0))


def named_like(rows: DataFrame, pattern: str, columns: tuple[str, ...] = ("repo", "fqcn")) -> DataFrame:
    """Rows of which some column matches the shell pattern."""
    regex = text.glob_to_regex(pattern)
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).rlike(regex)
    return rows.where(test)


def problem_keys(summary: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    return summary.where(F.col("problem_category").isin(*categories)).select(*keys).distinct()


def covered_keys(counters: DataFrame, keys: list[str], variant: str = "auto") -> DataFrame:
    return counters.where((F.col("variant") == variant) & (F.col("line_covered") > 0)).select(*keys).distinct()


def retry(rows: DataFrame, failures: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows whose key is in any table of failures."""
    every = failures[0].select(*keys)
    for f in failures[1:]:
        every = every.unionByName(f.select(*keys))
    return rows.join(every.distinct(), keys, "left_semi")


def target_lines(line_deltas: DataFrame, keys: list[str], target: Column) -> DataFrame:
    """keys, target_lines: distinct lines that are newly or fully covered in the target class or one nested in it; keys
    without such a line have no row."""
    rows = line_deltas.where(is_target_class(F.col("class_name"), target))
    spans = F.concat(ranges.merged_spans(F.col("newly_covered_lines"), False), ranges.merged_spans(F.col("upgraded_to_full_lines"), False))
    return _line_total(rows.select(*keys, F.inline(spans)), keys, keys, "target_lines")


def target_percentage(line_deltas: DataFrame, keys: list[str], target: Column, total: Column) -> DataFrame:
    """keys, percentage: distinct newly covered (class, line) of the target over its number of lines."""
    rows = line_deltas.where(is_target_class(F.col("class_name"), target)).withColumn("__total", total)
    spans = rows.select(*keys, "class_name", F.inline(ranges.merged_spans(F.col("newly_covered_lines"))))
    lines = _line_total(spans, keys, [*keys, "class_name"], "__n")
    per = lines.join(rows.groupBy(*keys).agg(F.max("__total").alias("__t")), keys)
    return per.select(*keys, scalars.percentage(F.col("__n"), F.col("__t")).alias("percentage"))


def _line_total(spans: DataFrame, keys: list[str], within: list[str], name: str) -> DataFrame:
    """Distinct lines of spans by ``within``, added up by keys: spans are merged and measured, lines are not written out."""
    return ordered.merged(spans, within, "start", "end").groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + 1).alias(name))


def method_deltas(test_deltas: DataFrame, line_deltas: DataFrame, keys: list[str], target: Column) -> DataFrame:
    """test_deltas of methods that have line deltas, with their entries (class, lines) and added lines of the target:
    the sum over entries, not distinct across classes."""
    n = ranges.line_count(F.col("newly_covered_lines"))
    per = line_deltas.withColumn("__n", F.when(is_target_class(F.col("class_name"), target), n).otherwise(0)).groupBy(*keys)
    entry = F.struct("class_name", F.col("newly_covered_lines").alias("lines"))
    found = per.agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.sum("__n").alias("target_added_lines"))  # the classes that one test touches
    return test_deltas.join(found, keys)


def with_target_lines(test_deltas: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """test_deltas with target_lines, 0 where a test has none."""
    return test_deltas.join(counts, keys, "left").withColumn("target_lines", F.coalesce("target_lines", F.lit(0)))


def without_failed(deltas: DataFrame, failed: DataFrame, keys: list[str], counts: list[str], keep: bool) -> DataFrame:
    """Failed tests go, or stay with counters of 0 if ``keep``."""
    if not keep:
        return deltas.join(failed.select(*keys).distinct(), keys, "left_anti")
    marked = deltas.join(failed.select(*keys).distinct().withColumn("__failed", F.lit(True)), keys, "left")
    return marked.withColumns({c: F.when(F.col("__failed"), 0).otherwise(F.col(c)) for c in counts}).drop("__failed")


def existing(selectors: DataFrame, methods: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Selectors whose method the sources still have, first occurrences, in their order."""
    return first_wins(selectors.join(methods.select(*keys).distinct(), keys, "left_semi"), keys, seq)


def runnable(annotations: Column, parameters: Column, depth: Column, unsupported: list[str]) -> Column:
    """A test without parameters at depth one and without unsupported annotations."""
    return (parameters == 0) & (depth == 1) & ~F.arrays_overlap(annotations, F.array(*[F.lit(u) for u in unsupported]))


def reduced(methods: DataFrame, keys: list[str], order: tuple | list, n: int) -> DataFrame:
    """The first n tests of each class and all its methods that are no tests; classes without a test left go."""
    tests = top_k(methods.where("is_test"), keys, order, n)
    helpers = methods.where("not is_test").join(tests.select(*keys).distinct(), keys, "left_semi")
    return tests.unionByName(helpers)


def shown_and_omitted(entries: DataFrame, keys: list[str], order: tuple | list, most: int = 2) -> DataFrame:
    """The first ``most`` entries of each key with the number of those that are left out."""
    w = Window.partitionBy(*keys)
    rows = entries.withColumn("__r", F.row_number().over(w.orderBy(*order_of(order)))).withColumn("__n", F.count(F.lit(1)).over(w))
    return rows.where(F.col("__r") <= most).withColumn("omitted", F.greatest(F.col("__n") - most, F.lit(0))).drop("__r", "__n")


def newest_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The newest verified run of each key, else the newest legacy one, else a fallback in its order.

    runs: keys, tier (0 verified, 1 legacy, 2 fallback), run_id, seq.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("tier", F.when(F.col("tier") < 2, F.col("run_id")).desc_nulls_last(), "seq"))
    return runs.withColumn("__r", rank).where("__r = 1").drop("__r")


def before_after(rows: DataFrame, keys: list[str], value: str, total: str) -> DataFrame:
    """keys, value and total before and after; a target that is absent before has 0 of the total after."""
    phase = lambda p, c: F.max(F.when(F.col("phase") == p, F.col(c)))
    wide = rows.groupBy(*keys).agg(phase("before", value).alias("v0"), phase("before", total).alias("t0"), phase("after", value).alias("v1"), phase("after", total).alias("t1"))
    v0, t0 = F.when(F.col("t0").isNull(), 0).otherwise(F.col("v0")), F.coalesce("t0", "t1")
    return wide.select(*keys, v0.alias("before"), t0.alias("before_total"), F.col("v1").alias("after"), F.col("t1").alias("after_total"))


def by_alias(left: DataFrame, right: DataFrame, alias: DataFrame, name: str) -> DataFrame:
    """left with ``name`` replaced by its alias, if it has one, joined with right on it."""
    named = left.join(alias.select(F.col("alias").alias(name), F.col("name").alias("__name")), name, "left")
    return named.withColumn(name, F.coalesce("__name", name)).drop("__name").join(right, name)


def same_list(left: DataFrame, right: DataFrame, keys: list[str], items: str) -> DataFrame:
    """Rows of equal keys whose arrays hold the same items in any order."""
    key = lambda t: t.withColumn("__items", F.array_join(F.array_sort(items), "\u0001"))
    return key(left).join(key(right).drop(items), [*keys, "__items"]).drop("__items")


def floor_of(rows: DataFrame, target: str, floor: str, value: str) -> DataFrame:
    """rows with floor_value: the value of the row that is named as floor."""
    other = rows.select(F.col(target).alias(floor), F.col(value).alias("floor_value"))
    return rows.join(other, floor, "left")


def override_variant(rows: DataFrame, variant: str) -> DataFrame:
    """Counter rows as another variant, percentages computed anew."""
    p = lambda k: scalars.percentage(F.col(f"{k}_covered"), F.col(f"{k}_total"))
    return rows.withColumn("variant", F.lit(variant)).withColumn("line_percentage_coverage", p("line")).withColumn("branch_percentage_coverage", p("branch"))


def every_variant(targets: DataFrame, rows: DataFrame, keys: list[str], variants: list[str], counts: list[str]) -> DataFrame:
    """A row for each target and variant: what there is, else zeros with the reason why."""
    every = targets.select(*keys).distinct().withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    out = every.join(rows.withColumn("__there", F.lit(True)), [*keys, "variant"], "left")
    reason = F.when(F.col("__there").isNull(), "no_row").when(~positive(*[F.col(c) for c in counts]), "no_match")
    return out.withColumn("reason", reason).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts}).drop("__there")


def reweighted(rows: DataFrame, keys: list[str], first: str, second: str, weights: list[float]) -> DataFrame:
    """keys, weight, median of (1 - w) first + w second for each weight; a part that is null leaves the other."""
    spread = rows.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    a, b, w = F.col(first), F.col(second), F.col("weight")
    score = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * (1 - w) + b * w)
    scored = spread.withColumn("__s", score)
    return statistics.joined(scored.select(*keys, "weight").distinct(), statistics.quantiles(scored, [*keys, "weight"], "__s", {"median": 0.5}), [*keys, "weight"])


def style_profile(code: Column) -> dict[str, Column]:
    """Counts and ratios of a source text that make up its style."""
    lines = F.split(code, "\n")
    filled = F.filter(lines, lambda x: F.trim(x) != "")
    n = F.nullif(F.size(filled), F.lit(0))
    names = F.regexp_extract_all(code, F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))
    return {
        "lines": F.size(lines).cast("double"),
        "mean_line_length": mean(F.transform(lines, lambda x: F.length(x).cast("double"))),
        "comment_ratio": F.size(F.filter(filled, lambda x: F.trim(x).rlike(r"^(//|/\*|\*)"))) / n,
        "blank_ratio": (F.size(lines) - F.size(filled)) / F.size(lines).cast("double"),
        "mean_name_length": mean(F.transform(names, lambda x: F.length(x).cast("double"))),
        "camel_ratio": F.size(F.filter(names, lambda x: x.rlike("^[a-z]+[A-Z]"))) / F.nullif(F.size(names), F.lit(0)),
        "snake_ratio": F.size(F.filter(names, lambda x: x.contains("_"))) / F.nullif(F.size(names), F.lit(0)),
        "mean_indent": mean(F.transform(filled, lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0)).cast("double"))),
    }


def style_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean of the parts' differences: of ratios as they are, of others over the larger one, 1 at least."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = []
    for k in a:
        d = F.abs(zero(a[k]) - zero(b[k]))
        parts.append(d if k.endswith("ratio") else d / F.greatest(zero(a[k]), zero(b[k]), F.lit(1.0)))
    return sum(parts, F.lit(0.0)) / len(parts)


def first_reviews(reviews: DataFrame, keys: list[str], order: tuple | list, keep: int = 20, tries: int = 100) -> DataFrame:
    """Of the first ``tries`` rows of each key those that are merged, ``keep`` at most (the report's own limits)."""
    seen = top_k(reviews, keys, order, tries).where("merged")
    return top_k(seen, keys, order, keep)


def winners(rows: DataFrame, keys: list[str], rank: str, version: str) -> DataFrame:
    """Of each artifact the one of the best repository rank, then of the largest natural version."""
    least = rows.groupBy(*keys).agg(F.min(rank).alias(rank))
    kept = rows.join(least, [*keys, rank])
    rest = [c for c in rows.columns if c not in keys]
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(scalars.version_key(F.col(version)), F.col(version))).alias("w")).select(*keys, "w.*").select(*rows.columns)


def dependency_score(tokens: Column, package_tokens: Column, class_token: Column, common: list[str]) -> Column:
    """2 for each token of the package, 1 for the class's; 0 without a token that is not a common one."""
    shared = F.array_intersect(tokens, package_tokens)
    special = F.size(F.array_except(shared, F.array(*[F.lit(c) for c in common]))) + F.array_contains(tokens, class_token).cast("int")
    return F.when(special > 0, 2 * F.size(shared) + F.array_contains(tokens, class_token).cast("int")).otherwise(0)


def sanitize(code: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression rewrites in order, then repeated import lines and runs of blank lines collapse."""
    out = code
    for pattern, by in rules:
        out = F.regexp_replace(out, pattern, by)
    lines = F.split(out, "\n")
    is_import = lambda x: x.rlike(r"^\s*import\s")
    kept = F.filter(lines, lambda x, i: ~is_import(x) | (F.array_position(lines, x) == i + 1))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")


def aggregate_counts(*parts: Column) -> Column:
    """Sum with nulls as 0."""
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))


def preferred(rows: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """Of each key the row whose kind comes first in a list of preferences."""
    rank = F.coalesce(*[F.when(F.col(kind) == k, i) for i, k in enumerate(order)], F.lit(len(order)))
    return best(rows, keys, rank, F.col(kind))
