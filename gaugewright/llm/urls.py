"""URL filter: rules of hosts and paths, and gradient-boosted trees on lexical features for the URLs that no rule judges.

A rule (verdict, host, path) fits its host and the hosts below it where the URL's path begins with the rule's; of those that
fit the longest wins.  The trees are fitted on labelled URLs, here those that the rules judge: lengths of URL, host and
path, depth, labels of the host, shares of digits and hyphens, the longest run of digits, entropy, parameters, a fragment;
and statistics of suffixes (top domain, the last two and the last three labels, the whole host, the extension, and the
path's first folder): how many labelled URLs have the same one and how many of these are blocked, over all labelled URLs,
in BINS hashed bins each.  A labelled URL's own statistics leave its fold out, so no feature holds its label.

Trees are Spark's GBTClassifier on the LABELLED labelled rows with the least hash of URL (all if fewer); counts of
suffixes and scores cover all rows.  What the driver sees are the bins' counts, of a fixed number, and the sample.  Memory
is linear in a single URL.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees, as is an
empty one; user names and ports are part of the host, as written; equal URLs have equal results; with labels of one kind
alone all other URLs get that kind, and ``allow`` without any label; an empty table gives no rows; other columns stay in
judge() and are of no account.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released, ship

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labelled rows that the trees are fitted on, at most; trees and their depth; folds of labelled rows; bins of a suffix.
LABELLED, TREES, DEPTH, FOLDS, BINS = 10_000, 30, 5, 5, 1024
#: Labelled rows that a bin's share of blocked ones is drawn to the mean by.
PRIOR = 4.0
SUFFIXES = ("top", "two", "three", "host", "extension", "folder")
SHAPE = ("length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "digit_run", "entropy", "parameters", "fragment")
FEATURES = [*SHAPE, *(f"{s}_{x}" for s in SUFFIXES for x in ("blocked", "count"))]
_PARTS = re.compile(r"([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", re.S)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    letters = "".join(chr(c) for c in range(65, 91))
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), letters, letters.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does.  Of rules of one length the first by text."""
    each = F.array(*[F.struct(F.lit(-len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    fits = F.filter(each, lambda r: ((host_ == r["host"]) | F.endswith(host_, F.concat(F.lit("."), r["host"]))) & F.startswith(path_, r["path"]))
    best = F.array_min(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def shape(url: str) -> tuple[list[float], list[int]]:
    """SHAPE of a URL, and the bins of its SUFFIXES."""
    at = url.find("://")
    name, way, query, mark = _PARTS.match(url[at + 3 :] if at >= 0 else url).groups()
    name = name.lower()
    labels, folders = name.split("."), [x for x in way.split("/") if x]
    size = max(len(url), 1)
    counts = Counter(url).values()
    entropy = -sum(n / size * math.log2(n / size) for n in counts)
    digits = re.findall(r"[0-9]+", url)
    last = folders[-1] if folders else ""
    extension = last.rpartition(".")[2] if "." in last else "/" if way.endswith("/") else ""
    numbers = [len(url), len(name), len(way), len(folders), len(labels), sum(map(len, digits)) / size, url.count("-") / size, max(map(len, digits), default=0), entropy, len([x for x in (query or "?")[1:].split("&") if x]), mark is not None]
    texts = (labels[-1], ".".join(labels[-2:]), ".".join(labels[-3:]), name, extension, folders[0] if folders else "")
    return [float(x) for x in numbers], [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BINS for t in texts]


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(3)), F.lit(FOLDS)).cast("int")


def shapes(url: Column) -> Column:
    """struct<numbers, bins> of shape()."""

    @F.pandas_udf("numbers array<double>, bins array<int>")
    def of(urls: pd.Series) -> pd.DataFrame:
        found = [shape(u) for u in urls]
        return pd.DataFrame({"numbers": [n for n, _ in found], "bins": [b for _, b in found]})

    return of(F.coalesce(url.cast("string"), F.lit("")))


def counted(labelled: DataFrame) -> np.ndarray:
    """Labelled rows and blocked ones by suffix, bin and fold, from rows (bins, fold, blocked): an array of a fixed size."""
    each = labelled.select(F.posexplode("bins").alias("suffix", "bin"), "fold", "blocked")
    sums = each.groupBy("suffix", "bin", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("long")).alias("blocked"))
    out = np.zeros((len(SUFFIXES), BINS, FOLDS, 2))
    for r in sums.collect():  # no more rows than bins
        out[r["suffix"], r["bin"], r["fold"]] = r["n"], r["blocked"]
    return out


def statistics(bins: Column, fold_: Column, counts: np.ndarray) -> Column:
    """For each suffix the share of blocked labelled URLs and the logarithm of their number, but for those of ``fold``."""
    every = counts.sum(axis=2)
    without = np.stack([every - counts[:, :, f] for f in range(FOLDS)] + [every], axis=2)  # the last: no fold left out
    mean = without[0].sum(axis=0)  # each row is in one bin of a suffix
    mean = (mean[:, 1] + 0.5) / (mean[:, 0] + 1)
    blocked = (without[..., 1] + PRIOR * mean) / (without[..., 0] + PRIOR)
    table = np.stack([blocked, np.log1p(without[..., 0])], axis=-1)

    @F.pandas_udf("array<double>")
    def of(bins: pd.Series, fold: pd.Series) -> pd.Series:
        if not len(bins):
            return pd.Series([], dtype=object)
        at = np.stack(bins.to_numpy())
        return pd.Series(list(table[np.arange(len(SUFFIXES)), at, fold.to_numpy(int)[:, None]].reshape(len(at), -1)))

    return of(bins, fold_)


@dataclass
class Model:
    """Trees and the suffixes' counts; without trees ``constant`` is every URL's probability of being blocked."""

    counts: np.ndarray
    trees: GBTClassificationModel | None = None
    constant: float = 0.0

    def scored(self, found: DataFrame) -> DataFrame:
        """found (with ``bins``, ``numbers``) and ``score``, the probability that a URL is to be blocked."""
        if self.trees is None:
            return found.withColumn("score", F.lit(self.constant))
        vector = array_to_vector(F.concat("numbers", statistics(F.col("bins"), F.lit(FOLDS), self.counts)))
        scored = self.trees.transform(found.withColumn("features", vector))
        return scored.withColumn("score", F.round(vector_to_array("probability")[1], 9)).drop("features", "rawPrediction", "probability", "prediction")


def _least(rows: DataFrame, most: int, total: float) -> DataFrame:
    """The ``most`` distinct labelled URLs with the least hash; rows that cannot be among them are left out before any task
    sorts its own."""
    order = F.xxhash64("url", F.lit(11))
    share = (1.5 * most + 500) / max(total, 1)
    while True:
        near = rows.where(order <= int((min(share, 1.0) - 0.5) * 2**64 - 1)) if share < 1 else rows
        sample = near.distinct().orderBy(order, "url", "blocked").limit(most)
        if share >= 1 or sample.count() == most:
            return sample
        share *= 2


def fit(labelled: DataFrame, most: int = LABELLED, trees: int = TREES) -> Model:
    """The model from rows (url, blocked): statistics over all, trees on ``most`` rows at most."""
    spark = labelled.sparkSession
    ship(spark)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = labelled.where("blocked is not null").select(url.alias("url"), F.col("blocked").cast("boolean").alias("blocked"), fold(url).alias("fold"))
    shaped = lambda df: df.withColumn("shape", shapes(F.col("url"))).select("blocked", "fold", "shape.*")
    counts = counted(shaped(rows))
    total, blocked = counts[0].sum(axis=(0, 1))
    if blocked in (0, total):
        return Model(counts, constant=1.0 if blocked else 0.0)
    features = array_to_vector(F.concat("numbers", statistics(F.col("bins"), F.col("fold"), counts)))
    sample = shaped(_least(rows, most, total)).select(features.alias("features"), F.col("blocked").cast("double").alias("label"))
    kept = checkpointed(sample.coalesce(1))  # bounded by ``most``; one partition adds up in one order, so fits are alike
    if kept.select("label").distinct().count() < 2:
        return Model(counts, constant=float(blocked / total))
    booster = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=5, maxBins=64, subsamplingRate=1.0, seed=5, cacheNodeIds=False)
    model = Model(counts, booster.fit(kept))
    released(kept)
    return model


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and rule_verdict; pages' other columns are not touched."""
    url = F.col("url").cast("string")
    found = pages.withColumns({"host": host(url), "path": path(url)})
    best = rule(F.col("host"), F.col("path"), rules)
    return found.withColumn("__rule", best).withColumns({"rule": F.col("__rule.rule"), "rule_verdict": F.col("__rule.verdict")}).drop("__rule")


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score, url: the rule's verdict, else that of the trees."""
    ship(pages.sparkSession)
    found = parsed(pages.select("page_id", "url"), rules)
    found = found.withColumn("shape", shapes(F.col("url"))).select("*", "shape.numbers", "shape.bins")
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return model.scored(found).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "score", "url")


def labelled_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """url, blocked: the URLs that a rule judges."""
    return parsed(pages.select("url"), rules).where("rule is not null").select("url", (F.col("rule_verdict") == "block").alias("blocked"))
