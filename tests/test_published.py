"""Published study figures: line gains of three variants on 32 targets, and what was reported of them."""

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import scalars
from gaugewright.operators import statistics

#: Percent of lines gained by variants a, b and c, target by target.
A = (
    22.133459, 0.230947, 18.505338, 23.897059, 0.0, 0.497512, 17.495396, 14.723926, 14.678899, 22.5, 1.234568, 35.339806, 3.638814,
    4.729064, 76.185102, 13.068182, 34.531928, 5.454545, 8.32158, 13.468013, 55.555556, 0.404858, 54.328358, 11.111111, 23.439049, 2.597403,
    0.313152, 17.857143, 13.324176, 7.692308, 17.07989, 1.750973,
)
B = (
    21.992481, 0.230947, 16.370107, 17.095588, 0.0, 0.497512, 17.495396, 14.723926, 14.678899, 20.0, 1.234568, 1.941748, 0.269542, 0.591133,
    71.444695, 11.363636, 30.564166, 5.454545, 4.090268, 13.131313, 51.111111, 0.404858, 54.328358, 3.864734, 22.34886, 2.597403, 0.104384,
    17.857143, 11.263736, 8.791209, 1.37741, 1.750973,
)
C = (
    22.791353, 1.501155, 16.607355, 18.382353, 3.088803, 4.477612, 28.913444, 16.564417, 14.678899, 12.5, 1.851852, 9.514563, 1.078167,
    2.26601, 50.0, 6.534091, 28.518289, 0.909091, 4.93653, 34.006734, 50.222222, 1.966455, 60.0, 4.347826, 6.095144, 7.792208, 0.835073,
    30.0, 11.401099, 6.593407, 16.804408, 1.55642,
)


@pytest.fixture(scope="module")
def gains(spark):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(zip(A, B, C, strict=True), 1)], "target int, a double, b double, c double").withColumn("g", F.lit("all")).cache()


def test_quartiles(gains):
    long = gains.unpivot(["target"], ["a", "b", "c"], "variant", "gain")
    got = {r["variant"]: r for r in statistics.quartiles(long, ["variant"], "gain").collect()}
    for v, positive, median, q1, q3 in (("a", 31, 13.40, 3.38, 22.23), ("b", 31, 10.03, 1.34, 17.59), ("c", 32, 8.65, 2.88, 19.48)):
        r = got[v]
        assert (r["n"], r["n_positive"]) == (32, positive)
        assert (round(r["median"], 2), round(r["q1"], 2), round(r["q3"], 2)) == (median, q1, q3)


@pytest.mark.parametrize("left,right,identical,left_wins,ties,right_wins,superior", [("a", "b", 13, 13, 5, 1, 0.234375), ("a", "c", 1, 16, 4, 11, 0.421875), ("b", "c", 1, 7, 7, 17, 0.703125)])
def test_pairs(gains, left, right, identical, left_wins, ties, right_wins, superior):
    r = statistics.pair_summary(gains, ["g"], left, right, "target").first()
    assert (r["identical"], r["left_wins"], r["ties"], r["right_wins"], r["p_superior"]) == (identical, left_wins, ties, right_wins, superior)


def test_categories(gains):
    best = scalars.best_set(["a", "b", "c"], [F.col(x) for x in "abc"], 0.1)
    got = {r["best"]: r["count"] for r in gains.groupBy(best.alias("best")).count().collect()}
    assert got == {"a": 11, "b": 1, "c": 11, "a=b": 4, "a=c": 1, "a=b=c": 4}


def test_orderings(gains):
    shown = {r["target"]: r["o"] for r in gains.select("target", scalars.ordering(["a", "b", "c"], [F.col(x) for x in "abc"]).alias("o")).collect()}
    assert (shown[1], shown[2], shown[9], shown[30]) == ("c > a > b", "c > a = b", "a = b = c", "b > a > c")


def test_adjusted_p_values(spark, gains):
    pairs = gains.selectExpr("stack(3, 'ab', b - a, 'ac', c - a, 'bc', c - b) as (pair, d)")
    sums = statistics.wilcoxon_sums(pairs, ["pair"], "d").withColumn("p", statistics.normal_p(F.col("z")))
    got = {r["pair"]: r["p_holm"] for r in statistics.holm(sums.withColumn("family", F.lit(1)), ["family"], "p", "pair").collect()}
    assert got["ab"] == pytest.approx(0.0008776931532058008, rel=1e-6)
    assert got["ac"] == got["bc"] == pytest.approx(0.25276174711342064, rel=1e-6)
    raw = (0.001543879508972168, 3.5881996154785156e-05, 0.06391465663909912, 2.9802322387695312e-06, 0.002599477767944336, 0.006610751152038574)
    want = (0.006175518035888672, 0.00017940998077392578, 0.06391465663909912, 1.7881393432617188e-05, 0.007798433303833008, 0.013221502304077148)
    frame = spark.createDataFrame([(1, i, p) for i, p in enumerate(raw)], "family int, i int, p double")
    assert [r["p_holm"] for r in statistics.holm(frame, ["family"], "p", "i").orderBy("i").collect()] == pytest.approx(want)
