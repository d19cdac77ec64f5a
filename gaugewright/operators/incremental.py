"""The verified report of what each variant adds to a target's baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percentage

#: Variants in the order of the report.
VARIANTS = ("manual", "auto", "auto-100", "improved", "adopted", "agentic")


def expand(targets: DataFrame, matrix: DataFrame, keys: list[str], variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """A row for each target and variant, with the matrix row's columns or nulls."""
    every = targets.select(*keys).distinct().withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    return every.join(matrix, [*keys, "variant"], "left")


def basis(variant: Column, auto_tests: Column) -> Column:
    small = auto_tests <= 100
    return (
        F.when(variant == "manual", "manual_baseline")
        .when((variant == "auto-100") & auto_tests.isNotNull(), F.when(small, "full_auto_suite_le_100").otherwise("coverage_ranked_top_100"))
        .otherwise("variant_execution")
    )


def cohort(variant: Column, auto_tests: Column) -> Column:
    return (
        F.when(variant == "manual", "baseline")
        .when((variant == "auto-100") & auto_tests.isNotNull(), F.when(auto_tests <= 100, "verified_same_execution_as_auto").otherwise("verified_100_method_subset_of_full_auto"))
        .when(variant.isin("improved", "adopted", "agentic"), "unverified_historical_input_lineage")
        .otherwise("full_auto_execution")
    )


def status(rows: DataFrame) -> DataFrame:
    """rows with measurement_status, problem_detail, increments and their percentages added.

    rows: variant, target_verified, has_row, has_target_hit, same_class_id, same_universe (booleans), test_status, and
    manual_lines, combined_lines, line_total, combined_line_total, manual_branches, combined_branches, branch_total,
    combined_branch_total (numbers).
    """
    c = F.col
    lower = (c("combined_lines") < c("manual_lines")) | (c("combined_branches") < c("manual_branches"))
    kept = (c("combined_line_total") == c("line_total")) & (c("combined_branch_total") == c("branch_total"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    state = (
        F.when(~yes(c("target_verified")), "unavailable")
        .when(c("variant") == "manual", "baseline")
        .when(~yes(c("has_row")), "unavailable")
        .when(~yes(c("has_target_hit")), "measured_no_target_hit")
        .when(~yes(c("same_class_id")), F.when(yes(c("same_universe")), "measured_equivalent_target_lines").otherwise("incompatible_target_cut"))
        .when(~yes(kept) | yes(lower), "unavailable")
        .otherwise("measured")
    )
    detail = (
        F.when(~yes(c("target_verified")), "target class could not be verified")
        .when(c("variant") == "manual", "")
        .when(~yes(c("has_row")), "no execution of this variant")
        .when(~yes(c("has_target_hit")), "the execution does not reach the target")
        .when(~yes(c("same_class_id")) & ~yes(c("same_universe")), "executable lines differ from the baseline's")
        .when(~yes(c("same_class_id")), "branches of different class ids cannot be merged")
        .when(~yes(kept), "the merged report changed the totals")
        .when(yes(lower), "merged counters are below the baseline's")
        .otherwise("")
    )
    out = rows.withColumn("measurement_status", state).withColumn("problem_detail", detail)
    counted = c("measurement_status").isin("measured", "measured_equivalent_target_lines")
    zero = c("measurement_status").isin("baseline", "measured_no_target_hit")
    line = F.when(counted, c("combined_lines") - c("manual_lines")).when(zero, 0)
    branch = F.when(c("measurement_status") == "measured", c("combined_branches") - c("manual_branches")).when(zero, 0)
    out = out.withColumn("incremental_lines", line).withColumn("incremental_branches", branch)
    return out.withColumns(
        {
            "incremental_line_percentage": F.when(c("incremental_lines").isNotNull(), percentage(c("incremental_lines"), c("line_total"))),
            "incremental_branch_percentage": F.when(c("incremental_branches").isNotNull(), percentage(c("incremental_branches"), c("branch_total"))),
            "analysis_eligible": (c("measurement_status") != "unavailable") & (c("measurement_status") != "incompatible_target_cut") & ((c("test_status") == "passed") | (c("variant") == "manual")),
        }
    )
