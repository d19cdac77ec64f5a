"""Ranking, top-k, first and last rows, upserts, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

#: Named orders of test deltas: columns, minus for falling.  They differ on purpose and are not to be merged.
ORDERS = {
    "filter": ("-added_lines", "-added_instructions", "-added_branches", "-added_methods"),
    "filter_legacy": ("added_lines", "-added_instructions", "added_branches", "-added_methods"),
    "reduce": ("-target_lines", "-added_lines", "-added_instructions", "-added_branches", "-added_methods"),
    "top100": ("-added_lines", "-added_methods", "-added_branches", "-added_instructions", "test_selector"),
    "pr": ("-added_lines", "-added_branches", "-added_methods", "-added_instructions", "-measured", "test_selector"),
}


def order_of(spec: tuple[str, ...] | list[str]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in spec]


def ranked(df: DataFrame, keys: list[str], order: tuple | list, name: str = "rank") -> DataFrame:
    """Adds 1, 2, ... in each group; ``order`` is one of ORDERS' forms and should be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_of(order))))


def top_k(df: DataFrame, keys: list[str], order: tuple | list, k: int) -> DataFrame:
    return ranked(df, keys, order, "__rank").where(F.col("__rank") <= k).drop("__rank")


def clamp_top_n(n: int, most: int = 100) -> int:
    return max(1, min(n, most))


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Each key's row with the least seq.  An aggregate, not a window: hot keys are reduced before the shuffle."""
    return _extreme(df, keys, F.min_by, F.col(seq))


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return _extreme(df, keys, F.max_by, F.col(seq))


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Each key's row with the least tuple ``order``."""
    return _extreme(df, keys, F.min_by, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))


def _extreme(df: DataFrame, keys: list[str], pick, order: Column) -> DataFrame:
    """Rows whose order is null come after all others; of a key that has no other one of them is taken."""
    known = order.isNotNull()
    order = F.struct(known if pick is F.max_by else ~known, order)  # the struct itself is never null
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of old replaced by those of new with the same key; of several new ones the last by seq holds, and a replaced
    row keeps its old place (the least seq of its key)."""
    both = old.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)))
    rest = [c for c in old.columns if c not in (*keys, seq)]
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__gen", seq)).alias("__row"), F.min_by(seq, F.struct("__gen", seq)).alias(seq))
    return out.select(*keys, seq, "__row.*").select(*old.columns)


def largest_span(df: DataFrame, keys: list[str]) -> DataFrame:
    """The longest span of each key, the first one of equal ones; one without a length only where there is no other."""
    length = F.col("start") - F.col("end")
    return best(df, keys, length.isNull(), length, F.col("start").isNull(), F.col("start"))


def best_and_margin(df: DataFrame, keys: list[str], item: str, score: str) -> DataFrame:
    """keys, item, score, margin: the best item by score (then item) and its lead over the runner-up (over 0 if alone).

    Two rows a key are enough, and the window's limit leaves no more of a task's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item).asc()))
    two = df.select(*keys, item, score, place.alias("__r")).where("__r <= 2")
    of = lambda c, r: F.max(F.when(F.col("__r") == r, F.col(c)))
    best = two.groupBy(*keys).agg(of(item, 1).alias(item), of(score, 1).alias(score), of(score, 2).alias("__next"))
    return best.select(*keys, item, score, (F.col(score) - F.coalesce(F.col("__next"), F.lit(0.0))).alias("margin"))


def unique_right(best: DataFrame, left: list[str], right: str, score: str) -> DataFrame:
    """Greedy one-to-one matching when each left has one candidate: a right goes to its best left."""
    w = Window.partitionBy(right).orderBy(F.col(score).desc(), *[F.col(c).asc() for c in left])
    return best.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def within_budget(df: DataFrame, keys: list[str], order: tuple | list, size: str, most: int, count: int | None = None) -> DataFrame:
    """Rows taken in order until a budget of sizes (and a count) is spent; ``taken`` is the part of the size that fits."""
    by = order_of(order)
    rows = ordered.running(ordered.by_range(df, keys, by), by, {"__before": ("sum", F.col(size)), "__n": ("sum", F.lit(1))}, upto=-1)
    before, n = F.coalesce("__before", F.lit(0)), F.coalesce("__n", F.lit(0))
    rows = rows.withColumn("taken", F.greatest(F.least(F.col(size), F.lit(most) - before), F.lit(0)))
    kept = F.col("taken") > 0
    if count is not None:
        kept = kept & (n < count)
    return rows.where(kept).drop("__before", "__n", "__key", "__bucket")


def depth(df: DataFrame, keys: list[str], pos: str, change: str, name: str = "depth") -> DataFrame:
    """Sum of ``change`` over the rows before each row; ``pos`` is an integer."""
    rows = ordered.running(ordered.by_position(df, keys, F.col(pos)), [F.col(pos)], {name: ("sum", F.col(change))}, upto=-1)
    return rows.withColumn(name, F.coalesce(name, F.lit(0))).drop("__key", "__bucket")


def after_marker(df: DataFrame, keys: list[str], pos: str, marker: Column) -> DataFrame:
    """Rows after the first one that is a marker; all rows of keys without one go."""
    first = df.where(marker).groupBy(F.struct(*keys).alias("__key")).agg(F.min(pos).alias("__first"))
    return df.withColumn("__key", F.struct(*keys)).join(first, "__key").where(F.col(pos) > F.col("__first")).select(*df.columns)
