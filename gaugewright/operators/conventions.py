"""How a candidate test file keeps to the conventions of a reference file: assertions, names, fixtures, imports, smells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import java, scalars, text


def _histogram(items: Column) -> Column:
    """map item -> number, of an array."""
    distinct = F.array_distinct(items)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda d: F.size(F.filter(items, lambda x: x == d))))


def overlap(a: Column, b: Column) -> Column:
    """Sum over items of the smaller share; 0 if either array is empty."""
    x, y = _histogram(a), _histogram(b)
    share = lambda m, k, n: F.coalesce(F.try_element_at(m, k), F.lit(0)) / n
    total = F.aggregate(F.map_keys(x), F.lit(0.0), lambda s, k: s + F.least(share(x, k, F.size(a)), share(y, k, F.size(b))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), total).otherwise(0.0)


def assertion_conformance(candidate: Column, reference: Column) -> tuple[Column, Column]:
    """Overlap of assertion families and of idioms; null where the reference has none, 0 where the candidate has none."""
    part = lambda c, f: F.transform(c, lambda s: s[f])
    known = F.size(reference) > 0
    return tuple(F.when(known, overlap(part(candidate, f), part(reference, f))) for f in ("family", "idiom"))


def _content(name: Column) -> Column:
    parts = text.name_tokens(name)
    return F.when(text.name_prefix(parts) != "bare", F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)


def name_style(name: Column) -> Column:
    shape = text.name_shape(name)
    return F.concat_ws(":", shape["prefix"], shape["separator"])


def lexical(name: Column) -> Column:
    return F.filter(_content(name), lambda t: ~t.rlike(r"^\d+$"))


def name_clarity(name: Column, wanted: Column) -> Column:
    """Enough words, different words, and no mechanical phrase or number at the end: a third each, scaled by the first."""
    own = lexical(name)
    n = F.size(own)
    natural = F.when(name.rlike(java.MECHANICAL) | name.rlike(r"\d+$"), 0.25).otherwise(1.0)
    score = F.least(F.lit(1.0), n / wanted) * (1.0 + F.size(F.array_distinct(own)) / F.nullif(n, F.lit(0)) + natural) / 3.0
    return F.when(n > 0, score).otherwise(0.0)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0))


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, F.floor((n + 2) / 2).cast("int"))
    return (low + high) / 2.0


def naming_conformance(candidate: Column, reference: Column) -> tuple[Column, Column]:
    """(style, clarity) of arrays of test names; null where the reference has none, 0 where the candidate has none."""
    styles = _histogram(F.transform(reference, name_style))
    most = F.array_max(F.map_values(styles))
    wanted = F.greatest(F.lit(1.0), F.least(F.lit(3.0), _median(F.transform(reference, lambda n: F.size(lexical(n)).cast("double")))))
    style = _mean(F.transform(candidate, lambda n: F.coalesce(F.try_element_at(styles, name_style(n)), F.lit(0)) / most))
    clarity = _mean(F.transform(candidate, lambda n: name_clarity(n, wanted)))
    known, some = F.size(reference) > 0, F.size(candidate) > 0
    return tuple(F.when(known, F.when(some, v).otherwise(0.0)) for v in (style, clarity))


def fixture_reuse(calls: Column, helpers: Column) -> Column:
    """Calls of the reference's helpers over these and constructions; null without helpers, 0 without either.

    ``calls`` are a file's calls, as java.calls_column() has them: a construction follows ``new``, a helper's call no dot."""
    made = F.size(F.filter(calls, lambda c: c["constructs"]))
    reused = F.size(F.filter(calls, lambda c: (c["lead"] != ".") & ~c["constructs"] & F.array_contains(helpers, c["name"])))
    return F.when(F.size(helpers) > 0, F.coalesce(reused / F.nullif(reused + made, F.lit(0)), F.lit(0.0)))


def profile(pairs: DataFrame, candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """pairs with the conformance columns and their mean over what is available added; sources are parsed once each."""
    names = lambda m, test: F.transform(F.filter(m, lambda x: x["is_test"] == F.lit(test)), lambda x: x["name"])
    rows = pairs
    for side, column in (("c", candidate), ("r", reference)):
        rows = rows.withColumn(f"__{side}_methods", java.methods_column(F.col(column))).withColumn(f"__{side}_sites", java.sites_column(F.col(column)))
    rows = rows.withColumn("__calls", java.calls_column(F.col(candidate), ".*"))
    family, idiom = assertion_conformance(F.col("__c_sites"), F.col("__r_sites"))
    style, clarity = naming_conformance(names(F.col("__c_methods"), True), names(F.col("__r_methods"), True))
    used = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(java.IMPORT), F.lit(1)))
    rows = rows.withColumns(
        {
            "assertion_family": family,
            "assertion_idiom": idiom,
            "naming_style": style,
            "naming_clarity": clarity,
            "fixture_reuse": fixture_reuse(F.col("__calls"), F.array_distinct(names(F.col("__r_methods"), False))),
            "import_conformance": text.containment(used(candidate), used(reference)),
        }
    )
    rows = rows.withColumn("assertion_conformance", (F.col("assertion_family") + F.col("assertion_idiom")) / 2).withColumn("naming_conformance", (F.col("naming_style") + F.col("naming_clarity")) / 2)
    parts = [F.col(c) for c in ("assertion_conformance", "naming_conformance", "fixture_reuse", "import_conformance")]
    return rows.withColumn("conformance", scalars.mean_of_available(*parts)).drop("__c_methods", "__c_sites", "__r_methods", "__r_sites", "__calls")


def test_bodies(docs: DataFrame, keys: list[str], code: str = "text") -> DataFrame:
    """keys, name, body: the test methods of each file, bodies masked."""
    found = docs.select(*keys, F.explode(java.methods_column(F.col(code))).alias("m"))
    return found.where("m.is_test").select(*keys, "m.name", "m.body")


def smell_totals(docs: DataFrame, keys: list[str], code: str = "text") -> DataFrame:
    """keys, methods, a count for each smell, smells, density and smelly_ratio (null without methods)."""
    rows = test_bodies(docs, keys, code).withColumn("found", java.smells_column(F.col("body")))
    counts = [F.count_if(F.array_contains("found", s)).alias(s) for s in java.SMELLS]
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("methods"), *counts, F.sum(F.size("found")).alias("smells"), F.count_if(F.size("found") > 0).alias("__smelly"))
    every = docs.select(*keys).distinct().join(per, keys, "left").na.fill(0)
    n = F.nullif(F.col("methods"), F.lit(0))
    return every.withColumn("density", F.col("smells") / n).withColumn("smelly_ratio", F.col("__smelly") / n).drop("__smelly")


def similarity(pairs: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """pairs with token_jaccard, shingle_jaccard and lcs_ratio of two source columns added."""
    clean = lambda c: text.tokenize(text.normalize_literals(text.strip_comments(F.col(c))))
    rows = pairs.withColumn("__a", clean(a)).withColumn("__b", clean(b))
    most = F.greatest(F.size("__a"), F.size("__b"))
    return rows.withColumns(
        {
            "token_jaccard": text.jaccard(F.col("__a"), F.col("__b")),
            "shingle_jaccard": text.jaccard(text.shingles(F.col("__a"), k), text.shingles(F.col("__b"), k)),
            "lcs_ratio": F.when(most > 0, java.common_length(F.col("__a"), F.col("__b")) / F.nullif(most, F.lit(0))).otherwise(1.0),
        }
    ).drop("__a", "__b")


def quality(docs: DataFrame, keys: list[str], code: str = "text") -> DataFrame:
    """keys, loc (lines with code), functions, complexity (total and mean) and mean length of functions in lines.

    Complexity counts branching words; means are null without functions.
    """
    loc = F.size(F.filter(java.code_lines_column(F.col(code)), lambda x: x))
    rows = docs.select(*keys, loc.alias("loc"), java.methods_column(F.col(code)).alias("m"))
    paths = F.transform("m", lambda x: java.complexity(x["body"]))
    lengths = F.transform("m", lambda x: F.size(F.split(x["body"], "\n")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    n = F.nullif(F.size("m"), F.lit(0))
    return rows.select(*keys, "loc", F.size("m").alias("functions"), total(paths).alias("complexity"), (total(paths) / n).alias("mean_complexity"), (total(lengths) / n).alias("mean_length"))
