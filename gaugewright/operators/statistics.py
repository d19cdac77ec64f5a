"""Descriptive, paired, rank and agreement statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import bound
from ..sources.folders import checkpointed
from . import ordered


#: Groups of up to EXACT values are aggregated whole; in larger ones bounds close in until no more lie between them.
EXACT = 100_000
#: Bounds of up to so many groups are sent to every task; those of more are joined by key.
GROUPS = 10_000
#: A sketch's ranks are off by a group's rows over ACCURACY at most; its quantiles are asked for at STEPS steps.
ACCURACY, STEPS = 2000, 400


def known_values(value: str) -> Column:
    """Null and NaN are no values."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys and a column for each name in ``at``: exact quantiles with linear interpolation of the values that are known; no
    row for groups without one.  Infinite values count as such; between minus and plus infinity lies NaN.

    Where no group has more than EXACT values it is one aggregate.  Else the values at a quantile's two places are selected:
    see at_ranks().
    """
    known = df.where(known_values(value)).select(*keys, F.col(value).cast("double").alias("__v"))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    largest = sizes.agg(F.max("__n")).first()[0] or 0
    places = list(at.values())
    if largest <= EXACT:
        found = known.groupBy(*keys).agg(F.percentile("__v", places).alias("__q"), F.count(F.lit(1)).alias("__n")).where("__n > 0")
        return found.select(*keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(at)])
    place = lambda p: (F.col("__n") - 1) * F.lit(p)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in places])))
    wanted = sizes.where("__n > 0").select(*keys, "__n", "__low", "__high", F.explode(ranks).alias("__rank"))
    found = at_ranks(known, wanted, keys, EXACT)
    by_rank = F.map_from_entries(F.collect_list(F.struct("__rank", "__v")))  # two for each quantile at most
    per = found.groupBy(*keys).agg(F.first("__n").alias("__n"), by_rank.alias("__at"))

    def between(p: float) -> Column:
        low, high, part = F.col("__at")[F.floor(place(p))], F.col("__at")[F.ceil(place(p))], place(p) - F.floor(place(p))
        return F.when(low == high, low).when((low == -math.inf) & (high < math.inf), low).otherwise(low + (high - low) * part)

    return per.select(*keys, *[between(p).alias(name) for name, p in at.items()])


def at_ranks(known: DataFrame, wanted: DataFrame, keys: list[str], most: int) -> DataFrame:
    """wanted (keys, __n, __rank) with __v: the value at a rank, from 0, among known(keys, __v); __low and __high are the
    group's least and largest value.

    Of each rank it is known how many values are up to a lower bound and how many lie strictly between it and an upper one.
    The rank is one of the bounds', or lies between; then a sketch of what lies between, of bounded size, gives closer
    bounds, whose rows are counted exactly.  Each step leaves a hundredth of the rows; once there are ``most`` or fewer, they
    are counted value by value.  Copies of a value are one value, and bounds are values, so a step always gets on.
    """
    wanted = checkpointed(wanted)
    state = _counted(known, wanted.withColumnRenamed("__n", "__all"), keys).withColumnRenamed("__all", "__n")
    while True:
        state = checkpointed(state)
        open_ = state.where((F.col("__rank") >= F.col("__upto")) & (F.col("__rank") < F.col("__upto") + F.col("__inside")) & (F.col("__inside") > most))
        if open_.limit(1).count() == 0:
            break
        between = _between(known, open_, keys)
        steps = [i / STEPS for i in range(STEPS + 1)]
        cuts = between.groupBy(*keys, "__rank").agg(F.percentile_approx("__v", steps, ACCURACY).alias("__cuts"))
        place = (F.col("__rank") - F.col("__upto")) * STEPS / F.col("__inside")
        index = lambda i: F.get("__cuts", i.cast("int"))  # null outside
        low, high = index(F.floor(place) - 1), index(F.ceil(place) + 2)
        closer = joined(open_, cuts, [*keys, "__rank"]).withColumns({"__l": F.coalesce(low, "__low"), "__h": F.coalesce(high, "__high")})
        closer = closer.select(*keys, "__n", "__rank", F.col("__l").alias("__low"), F.col("__h").alias("__high"))
        rest = joined(state, open_.select(*keys, "__rank", F.lit(True).alias("__open")), [*keys, "__rank"]).where("__open is null").drop("__open")
        state = rest.unionByName(_counted(known, closer.withColumnRenamed("__n", "__all"), keys).withColumnRenamed("__all", "__n"))
    inside = (F.col("__rank") >= F.col("__upto")) & (F.col("__rank") < F.col("__upto") + F.col("__inside"))
    values = _between(known, state.where(inside), keys).groupBy(*keys, "__rank", "__upto", "__v").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.col("__upto") + F.sum("__c").over(Window.partitionBy(*keys, "__rank").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))  # ``most`` rows at most
    hit = values.withColumn("__last", upto).where((F.col("__last") > F.col("__rank")) & (F.col("__last") - F.col("__c") <= F.col("__rank"))).select(*keys, "__rank", "__v")
    edge = F.when(F.col("__rank") < F.col("__upto"), F.col("__low")).otherwise(F.col("__high"))
    return joined(state, hit, [*keys, "__rank"]).select(*keys, "__n", "__rank", F.coalesce("__v", edge).alias("__v"))


def _bounded(known: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """known with __b, for groups that have bounds.  A small file's rows may be many, so Spark's guess of what is small enough
    to send is not asked: bounds are sent if their count is small, and values never."""
    few = bounds.limit(GROUPS + 1).count() <= GROUPS
    return joined(known if few else known.hint("merge"), F.broadcast(bounds) if few else bounds, keys).where("__b is not null")


def _between(known: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, __rank, __upto, __v: the values strictly between each rank's bounds."""
    bounds = state.groupBy(*keys).agg(F.collect_list(F.struct("__rank", "__upto", "__low", "__high")).alias("__b"))  # a few a group
    rows = _bounded(known, bounds, keys)
    each = rows.select(*keys, "__v", F.explode(F.filter("__b", lambda b: (F.col("__v") > b["__low"]) & (F.col("__v") < b["__high"]))).alias("__b"))
    return each.select(*keys, "__b.__rank", "__b.__upto", "__v")


def _counted(known: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """state with __upto and __inside: how many values are up to __low, and strictly between __low and __high."""
    bounds = state.groupBy(*keys).agg(F.collect_list(F.struct("__rank", "__low", "__high")).alias("__b"))
    rows = _bounded(known, bounds, keys)
    each = rows.select(*keys, "__v", F.explode(F.filter("__b", lambda b: F.col("__v") < b["__high"])).alias("__b"))
    counts = each.groupBy(*keys, F.col("__b.__rank").alias("__rank")).agg(F.count_if(F.col("__v") <= F.col("__b.__low")).alias("__upto"), F.count_if(F.col("__v") > F.col("__b.__low")).alias("__inside"))
    zero = F.lit(0).cast("long")
    every = F.col("__low") == F.col("__high")  # all of one value: none is below the upper bound
    found = joined(state.drop("__upto", "__inside"), counts, [*keys, "__rank"])
    return found.withColumns({"__upto": F.when(every, F.col("__all")).otherwise(F.coalesce("__upto", zero)), "__inside": F.coalesce("__inside", zero)})


def joined(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of more, which has a row for each group, by keys, null keys included."""
    if not keys:
        return rows.join(more, F.lit(True), "left")  # more is one row
    on = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in keys]
    return rows.alias("__l").join(more.alias("__r"), on, "left").select("__l.*", *[f"__r.{c}" for c in more.columns if c not in keys])


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, n_positive, total, q1, median, q3 with linear interpolation."""
    v = F.when(known_values(value), F.col(value))
    rows = df.groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(v > 0).alias("n_positive"), F.sum(v).alias("total"))
    return joined(rows, quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), keys)


def signs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, available, unavailable, positive, zero, negative, mean, median, least, most."""
    v = F.when(known_values(value), F.col(value))
    rows = df.groupBy(*keys).agg(
        F.count(v).alias("available"),
        F.count_if(v.isNull()).alias("unavailable"),
        F.count_if(v > 0).alias("positive"),
        F.count_if(v == 0).alias("zero"),
        F.count_if(v < 0).alias("negative"),
        F.avg(v).alias("mean"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
    )
    return joined(rows, quantiles(df, keys, value, {"median": 0.5}), keys)


def ratings(df: DataFrame, keys: list[str], score: str, levels: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """keys, n, median, mean and for each level its number n_L and share share_L."""
    s = F.when(known_values(score), F.col(score))
    counts = [F.count_if(s == x).alias(f"n_{x}") for x in levels]
    shares = [(F.count_if(s == x) / F.count(s)).alias(f"share_{x}") for x in levels]
    rows = df.groupBy(*keys).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), *counts, *shares)
    return joined(rows, quantiles(df, keys, score, {"median": 0.5}), keys)


def below(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """counts (a row for each group and value) with __below: the sum of ``n`` over the group's smaller values.

    Values are dealt by ranges, each adds up its own and what the ranges before it hold of the group.
    """
    rows = ordered.running(ordered.by_range(counts, keys, [F.col(value)]), [F.col(value)], {"__below": ("sum", F.col(n))}, upto=-1)
    return rows.withColumn("__below", F.coalesce("__below", F.lit(0))).drop("__key", "__bucket")


def midranks(df: DataFrame, keys: list[str], value: str, name: str = "midrank") -> DataFrame:
    """Average ranks from 1 within each group."""
    tied = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = below(tied, keys, value, "__n").withColumn(name, F.col("__below") + (F.col("__n") + 1) / 2.0)
    return df.join(placed.drop("__n", "__below"), [*keys, value])


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r, null where one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.covar_pop(a, b) / F.sqrt(F.var_pop(a) * F.var_pop(b)))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho: Pearson's r of midranks over rows with both values; null where one side is constant."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = midranks(midranks(rows, keys, x, "__x"), keys, y, "__y")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("__x"), F.col("__y")).alias("rho"))


def holm(df: DataFrame, family: list[str], p: str, tie: str, name: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within each family, 1 at most; ``tie`` orders equal ones."""
    w = Window.partitionBy(*family).orderBy(p, tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1))
    return df.withColumn("__step", step).withColumn(name, F.max("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def wilcoxon_sums(df: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """keys, n, w_plus, w_minus, w (the smaller), ties (sum of t^3 - t), z: the signed-rank statistic without zeros,
    midranks of sizes, and its normal score with the tie correction and no continuity correction."""
    rows = df.where(F.col(difference) != 0).withColumn("__size", F.abs(F.col(difference)))
    groups = rows.groupBy(*keys, "__size").agg(F.count(F.lit(1)).alias("__t"), F.count_if(F.col(difference) > 0).alias("__up"))
    placed = below(groups, keys, "__size", "__t").withColumn("__rank", F.col("__below") + (F.col("__t") + 1) / 2.0)
    t = F.col("__t").cast("double")
    sums = placed.groupBy(*keys).agg(
        F.sum("__t").alias("n"), F.sum(F.col("__rank") * F.col("__up")).alias("w_plus"), F.sum(F.col("__rank") * (F.col("__t") - F.col("__up"))).alias("w_minus"), F.sum(t * t * t - t).alias("ties")
    )
    n = F.col("n").cast("double")
    low = F.least("w_plus", "w_minus")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    return sums.select(*keys, "n", "w_plus", "w_minus", low.alias("w"), "ties", F.when(variance > 0, (low - n * (n + 1) / 4.0) / F.sqrt(variance)).alias("z"))


def exact_p(sizes: list[float]) -> float:
    """Two-sided exact p of the signed-rank statistic of differences: twice the share of sign patterns with a rank sum up
    to the smaller one, over doubled midranks so that they are whole numbers."""
    d = np.array([x for x in sizes if x], dtype=float)
    if not len(d):
        return 1.0
    _, inverse, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    doubled = (2 * (np.cumsum(counts) - counts) + counts + 1)[inverse]
    least = int(min(doubled[d > 0].sum(), doubled[d < 0].sum()))
    ways = np.zeros(int(doubled.sum()) + 1)
    ways[0] = 1.0
    for r in doubled:  # halving at each step keeps shares in place of counts
        moved = np.zeros_like(ways)
        moved[r:] = ways[: len(ways) - r]
        ways = (ways + moved) / 2
    return float(min(1.0, 2 * ways[: least + 1].sum()))


def wilcoxon_exact(df: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """keys, n, p, whatever the size of a group: the work grows with the cube of its pairs, which are those of a study."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys) + ", n long, p double"

    def run(pdf):
        import pandas as pd

        d = pdf[difference].dropna()
        d = d[d != 0]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": len(d), "p": exact_p(d.tolist())}])

    ordered = [f.name for f in df.schema if f.name in keys]
    return df.select(*ordered, difference).groupBy(*keys).applyInPandas(run, schema).select(*keys, "n", "p")


def normal_p(z: Column) -> Column:
    """Two-sided p of a normal score: the complementary error function of |z| / sqrt(2), by its series below 3 and by its
    continued fraction beyond; 1e-15 at most off."""

    def of(x: Column) -> Column:
        start = F.struct((2 * x / math.sqrt(math.pi)).alias("term"), (2 * x / math.sqrt(math.pi)).alias("sum"))

        def step(s: Column, k: Column) -> Column:
            term = s.term * 2 * x * x / (2 * k + 1)
            return F.struct(term.alias("term"), (s.sum + term).alias("sum"))

        near = 1 - F.exp(-x * x) * F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step, lambda s: s.sum)
        below = F.aggregate(F.sequence(F.lit(80), F.lit(1)), x, lambda f, k: x + k / 2 / f)
        return F.when(x < 3, near).otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * below))

    return F.when(z.isNotNull(), bound(F.abs(z.cast("double")) / math.sqrt(2), of))


def alpha_ordinal(df: DataFrame, keys: list[str], item: str, rater: str, score: str) -> DataFrame:
    """keys, n_items, alpha: Krippendorff's alpha with ordinal distance over items with two ratings at least.

    Ratings are counted per item and score first; pairs are pairs of score levels of an item, never pairs of raters.
    There is one key at least (a constant will do).
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, item, score).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    m = F.sum("__n").over(Window.partitionBy(*keys, item))
    counts = counts.withColumn("__m", m).where("__m > 1")
    levels = counts.groupBy(*keys, score).agg(F.sum("__n").alias("__f"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("__upto", F.sum("__f").over(w))  # the distance of two levels is what lies between their middles
    # Places are counted from the middle of all, where squares are smallest: the sums below are differences of squares.
    every = F.sum("__f").over(Window.partitionBy(*keys))
    levels = levels.withColumn("__place", F.col("__upto") - F.col("__f") / 2 - every / 2)
    place = F.col("__place")
    placed = counts.join(levels.select(*keys, score, "__f", "__place"), [*keys, score])
    # sum over pairs of squared distances = 2 (n sum of squares - square of sum), per item and over all
    per = placed.groupBy(*keys, item).agg(F.first("__m").alias("__m"), F.sum(F.col("__n") * F.col("__place")).alias("__s"), F.sum(F.col("__n") * F.col("__place") * F.col("__place")).alias("__q"))
    observed = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"), F.sum(2 * (F.col("__m") * F.col("__q") - F.col("__s") * F.col("__s")) / (F.col("__m") - 1)).alias("__o"))
    total = levels.select(*keys, "__f", place).groupBy(*keys).agg(F.sum("__f").alias("__n"), F.sum(F.col("__f") * F.col("__place")).alias("__s"), F.sum(F.col("__f") * F.col("__place") * F.col("__place")).alias("__q"))
    joined = observed.join(total, keys)
    expected = 2 * (F.col("__n") * F.col("__q") - F.col("__s") * F.col("__s")) / (F.col("__n") - 1)
    return joined.select(*keys, "n_items", F.when(expected > 0, 1 - F.col("__o") / expected).alias("alpha"))


def digest(item: Column, rep: Column, seed: int = 1) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), rep.cast("string"), item.cast("string")))


def drawn(digest: Column) -> Column:
    """A Poisson(1) weight from the first eight digits of a digest; digits of equal number compare as their numbers do, so the
    limits are digits as well."""
    upto, term, limits = 0.0, math.exp(-1), []
    for k in range(1, 13):
        upto += term
        term /= k
        limits.append(math.ceil(upto * (1 << 32)))
    weight = F.when(digest < f"{limits[0]:08x}", 0)
    for k, limit in enumerate(limits[1:], 1):
        if limit < 1 << 32:
            weight = weight.when(digest < f"{limit:08x}", k)
    return weight.otherwise(sum(x < 1 << 32 for x in limits))


def spread(df: DataFrame) -> DataFrame:
    """Rows that cost much each, dealt to all cores, however few bytes they have."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


#: So many numbers of a matrix are held at a time in a task.
HELD = 1 << 22


def _weighted_sums(kinds: list, replicates: int):
    """Batches of items (key columns, pairs of levels with values, weights) -> keys, levels, and replicate by replicate the sum
    of weighted values."""

    def run(batches):
        found: dict = {}
        for batch in batches:
            *keys, pairs, weights = batch.columns
            w = weights.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, replicates).astype(float)
            at = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy(zero_copy_only=False))
            a, b, v = (pairs.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            levels, level = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
            level = level.reshape(-1)
            rows: dict = {}
            for i, key in enumerate(zip(*(k.to_pylist() for k in keys), strict=True)):
                rows.setdefault(key, []).append(i)
            for key, own in rows.items():
                sums = found.setdefault(key, {})
                step = max(1, HELD // max(1, len(levels)))
                for start in range(0, len(own), step):
                    part = np.asarray(own[start : start + step])
                    place = np.full(batch.num_rows, -1)
                    place[part] = np.arange(len(part))
                    here = place[at] >= 0
                    matrix = np.zeros((len(levels), len(part)))
                    matrix[level[here], place[at][here]] = v[here]  # an item has a pair of levels once
                    for i in np.unique(level[here]):
                        pair = tuple(levels[i])
                        sums[pair] = sums.get(pair, 0) + matrix[i] @ w[part]
            if sum(map(len, found.values())) * replicates > HELD:
                yield batch_of(found)
                found = {}
        if found:
            yield batch_of(found)

    def batch_of(found: dict):
        rows = [(*key, *pair, sums) for key, by in found.items() for pair, sums in by.items()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([*kinds, pa.float64(), pa.float64(), pa.list_(pa.float64())])]
        return pa.RecordBatch.from_arrays(columns, names=[f"k{i}" for i in range(len(kinds))] + ["__a", "__b", "__top"])

    return run


def _replicate_sums(items: DataFrame, keys: list[str], replicates: int) -> DataFrame:
    """keys, __a, __b, __rep, __s: of items (keys, __p, __w) the sums of weighted pairs in each replicate."""
    fields = [items.schema[k] for k in keys]
    schema = StructType([*[StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)], *[StructField(n, DoubleType()) for n in ("__a", "__b")], StructField("__top", ArrayType(DoubleType()))])
    sums = items.mapInArrow(_weighted_sums([to_arrow_type(f.dataType) for f in fields], replicates), schema).toDF(*keys, "__a", "__b", "__top")
    each = sums.select(*keys, "__a", "__b", F.posexplode("__top").alias("__rep", "__s"))
    return each.groupBy(*keys, "__a", "__b", "__rep").agg(F.sum("__s").alias("__s"))


def bootstrap_ci(df: DataFrame, keys: list[str], item: str, value: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """keys, low, high: 2.5 and 97.5 percent bounds of the mean under a Poisson bootstrap of items.

    Rows are dealt to all cores, as a draw costs far more than its row's bytes.  Each goes with its weight into a task's sums
    once for each replicate; only those sums are shuffled, rows are not written.
    """
    rows = spread(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), F.col(item).alias("__item")))
    each = rows.select(*keys, "__v", "__item", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("__rep"))
    weighted = each.select(*keys, "__rep", "__v", drawn(digest(F.col("__item"), F.col("__rep"), seed)).alias("__w"))
    per = weighted.groupBy(*keys, "__rep").agg(F.sum(F.col("__w") * F.col("__v")).alias("__t"), F.sum("__w").alias("__n"))
    means = per.where("__n > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("__t") / F.col("__n"))).alias("__m"))  # one for each replicate

    def at(p: float) -> Column:
        place = (F.size("__m") - 1) * F.lit(p)
        low, high = (F.try_element_at("__m", (f(place) + 1).cast("int")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return means.select(*keys, at(0.025).alias("low"), at(0.975).alias("high"))


def alpha_ordinal_ci(df: DataFrame, keys: list[str], item: str, rater: str, score: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """keys, low, high: 2.5 and 97.5 percent bounds of alpha_ordinal() under a Poisson bootstrap of items.

    An item drawn w times counts as w items with the same ratings.  One pass, items dealt to all cores: an item has an array of
    its weights in all replicates and one of its pairs of score levels, and a task adds up, for each pair of levels, what the
    items' pairs of ratings weigh, and for each level its ratings.  Only those sums are shuffled, so no row is written for a replicate; the levels are those of a scale, few.
    Replicates whose alpha is null (no item, or one level only) are left out of the bounds.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, item, score).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    items = counts.groupBy(*keys, item).agg(F.array_sort(F.collect_list(F.struct(F.col(score).cast("double").alias("s"), F.col("__n").alias("n")))).alias("__l"), F.sum("__n").alias("__m")).where("__m > 1")
    pairs = F.flatten(F.transform("__l", lambda x: F.transform(F.filter("__l", lambda y: y["s"] >= x["s"]), lambda y: F.struct(x["s"].alias("a"), y["s"].alias("b"), F.when(x["s"] == y["s"], x["n"]).otherwise(2 * x["n"] * y["n"] / (F.col("__m") - 1)).alias("v")))))
    weights = F.transform(F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda rep: digest(F.col(item), rep, seed)), drawn)
    drawn_items = spread(items).select(*keys, pairs.alias("__p"), weights.alias("__w"))
    sums = _replicate_sums(drawn_items, keys, replicates)
    by = [*keys, "__rep"]
    levels = sums.where("__a = __b and __s > 0")
    upto = Window.partitionBy(*by).orderBy("__a").rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.select(*by, "__a", F.col("__s").alias("__f"), (F.sum("__s").over(upto) - F.col("__s") / 2).alias("__place"))
    scale = levels.groupBy(*by).agg(F.collect_list(F.struct("__a", "__f", "__place")).alias("__scale"))
    observed = sums.where("__a < __b").groupBy(*by).agg(F.collect_list(F.struct("__a", "__b", "__s")).alias("__o"))
    per = joined(scale, observed, by).withColumn("__o", F.coalesce("__o", F.array().cast("array<struct<__a:double,__b:double,__s:double>>")))
    place = lambda level: F.element_at(F.filter("__scale", lambda x: x["__a"] == level), 1)["__place"]
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    n = total(F.transform("__scale", lambda x: x["__f"]))
    seen = total(F.transform(F.filter("__o", lambda o: o["__s"] > 0), lambda o: o["__s"] * F.pow(place(o["__a"]) - place(o["__b"]), 2)))
    chance = total(F.transform("__scale", lambda x: total(F.transform("__scale", lambda y: x["__f"] * y["__f"] * F.pow(x["__place"] - y["__place"], 2))))) / (n - 1)
    alphas = per.select(*keys, F.when(chance > 0, 1 - seen / chance).alias("__alpha"))
    p = F.percentile("__alpha", F.array(F.lit(0.025), F.lit(0.975)))
    return alphas.groupBy(*keys).agg(p.alias("__p")).select(*keys, F.col("__p")[0].alias("low"), F.col("__p")[1].alias("high"))


def pair_summary(df: DataFrame, keys: list[str], left: str, right: str, target: str, tolerance: float = 0.1) -> DataFrame:
    """keys, identical, left_wins, ties, right_wins, p_superior and the largest gains with their targets."""
    d = F.col(right) - F.col(left)
    same = d == 0
    tie = ~same & (F.abs(d) <= F.greatest(left, right) * tolerance)
    return df.groupBy(*keys).agg(
        F.count_if(same).alias("identical"),
        F.count_if(~same & ~tie & (d < 0)).alias("left_wins"),
        F.count_if(tie).alias("ties"),
        F.count_if(~same & ~tie & (d > 0)).alias("right_wins"),
        F.avg(F.when(d > 0, 1.0).when(same, 0.5).otherwise(0.0)).alias("p_superior"),
        F.min_by(target, F.struct(d, target)).alias("least_target"),
        F.max_by(target, F.struct(d, target)).alias("most_target"),
    )


def histogram_overlap(a: DataFrame, b: DataFrame, keys: list[str], bin_: str) -> DataFrame:
    """keys, overlap: sum over bins of the smaller share; rows are keys, bin and n.  b may lack keys: then each of a's
    histograms is compared with b's one over the keys that it has."""

    def share(t: DataFrame) -> DataFrame:
        own = [k for k in keys if k in t.columns]
        return t.withColumn("__p", F.col("n") / F.sum("n").over(Window.partitionBy(*own)))

    x, y = share(a), share(b).select(*[k for k in keys if k in b.columns], bin_, F.col("__p").alias("__q"))
    shared = [k for k in keys if k in b.columns]
    both = x.join(y, [*shared, bin_], "left")
    return both.groupBy(*keys).agg(F.sum(F.least("__p", F.coalesce("__q", F.lit(0.0)))).alias("overlap"))


def minmax_score(df: DataFrame, weights: dict[str, float], scale: float = 1000.0) -> DataFrame:
    """Adds score: the weighted mean of columns scaled to 0..1 over the table, times scale."""
    low = df.agg(*[F.min(c).alias(f"__lo_{c}") for c in weights], *[F.max(c).alias(f"__hi_{c}") for c in weights]).first()
    total = sum(weights.values())
    score = F.lit(0.0)
    for c, w in weights.items():
        lo, hi = low[f"__lo_{c}"], low[f"__hi_{c}"]
        if lo is not None and hi > lo:
            score = score + (F.col(c) - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) * F.lit(float(w))
    return df.withColumn("score", score / F.lit(float(total)) * F.lit(scale))
