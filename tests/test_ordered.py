"""Runs, spans, running values, ranks and quantiles where one key holds all rows, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugewright.operators import ordered, ranking, statistics
from gaugewright.operators import sources_text as st


@pytest.mark.parametrize("width", [1, 4, 7, 1 << 16])
def test_islands(spark, width):
    rng = random.Random(width)
    rows = [("a", rng.randrange(-40, 200)) for _ in range(400)] + [(None, v) for v in (5, 5, 6, 9)] + [("a", None), ("b", None)]
    frame = spark.createDataFrame(rows, "k string, v int").repartition(4)
    got = sorted((str(r["k"]), r["start"], r["end"]) for r in ordered.islands(frame, ["k"], "v", width).collect())
    want = []
    for k in ("a", None):
        for v in sorted({v for g, v in rows if g == k and v is not None}):
            if want and want[-1][0] == str(k) and want[-1][2] == v - 1:
                want[-1][2] = v
            else:
                want.append([str(k), v, v])
    assert got == sorted(map(tuple, want))


@pytest.mark.parametrize("width, reach", [(1, 1), (5, 0), (5, 3), (1 << 16, 1)])
def test_merged_spans(spark, width, reach):
    rng = random.Random(width + reach)
    rows = [("a", s := rng.randrange(-30, 300), s + rng.choice([0, 1, 2, 60])) for _ in range(90)] + [(None, 3, 4), (None, 5, 5), ("b", None, 4)]
    frame = spark.createDataFrame(rows, "k string, s long, e long").repartition(4)
    got = sorted((str(r["k"]), r["start"], r["end"]) for r in ordered.merged(frame, ["k"], "s", "e", reach, width).collect())
    want = []
    for k in ("a", None):
        for s, e in sorted((s, e) for g, s, e in rows if g == k and s is not None):
            if want and want[-1][0] == str(k) and s <= want[-1][2] + reach:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([str(k), s, e])
    assert got == sorted(map(tuple, want))


@pytest.mark.parametrize("width", [1, 5, 1 << 16])
def test_merged_odd_spans(spark, width):
    """Spans that end before they start, copies, nulls: row by row, as an ordered window has them."""
    rng = random.Random(width)
    rows = [("a", s := rng.randrange(-30, 200), rng.choice([s - 9, s - 3, s - 1, s, s + 4, None])) for _ in range(120)] + [("a", 250, 245)] * 3 + [("a", 260, 280), ("a", None, None)]
    rows += [("n", None, None)] * 2 + [("n", 4, None)] * 2 + [(None, 3, 1), (None, 3, 9), ("m", None, 7), ("m", None, 7), ("m", None, None)]
    frame = spark.createDataFrame(rows, "k string, s long, e long").repartition(4)
    got = sorted((str(r["k"]), str(r["start"]), str(r["end"])) for r in ordered.merged(frame, ["k"], "s", "e", 1, width, unknown=True).collect())
    runs = []
    for k in ("a", None, "n", "m"):
        held, run = None, None
        for s, e in sorted(((s, e) for g, s, e in rows if g == k), key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)):
            if held is None or (s is not None and s > held + 1):
                runs.append(run := [str(k), s, e])
            run[1:] = [min((v for v in (run[1], s) if v is not None), default=None), max((v for v in (run[2], e) if v is not None), default=None)]
            held = max((v for v in (held, e) if v is not None), default=None)
    assert got == sorted((k, str(s), str(e)) for k, s, e in runs)


def test_largest_span_without_an_end(spark):
    spans = spark.createDataFrame([("a", 1, None), ("a", 5, 6), ("b", None, None), ("b", 2, None), ("c", 9, 9), ("c", 1, 1)], "k string, start long, end long")
    got = {r["k"]: (r["start"], r["end"]) for r in ranking.largest_span(spans, ["k"]).collect()}
    assert got == {"a": (5, 6), "b": (2, None), "c": (1, 1)}


@pytest.mark.parametrize("by", ["position", "range"])
def test_running_values(spark, by):
    rng = random.Random(3)
    rows = [(None if i % 9 == 0 else "a", i, rng.choice([None, rng.randrange(-9, 9)])) for i in range(200)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, p long, v long").repartition(3)
    dealt = ordered.by_position(frame, ["k"], F.col("p"), 16) if by == "position" else ordered.by_range(frame, ["k"], [F.col("p")])
    values = {"total": ("sum", F.col("v")), "most": ("max", F.col("v")), "last": ("last", F.col("v"))}
    for upto in (0, -1):
        w = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, upto)
        plain = frame.withColumns({"total": F.sum("v").over(w), "most": F.max("v").over(w), "last": F.last("v", ignorenulls=True).over(w)})
        got = ordered.running(dealt, [F.col("p")], values, upto).select("k", "p", "v", *values)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.select("k", "p", "v", *values).collect()))


def test_one_key_is_many_tasks(spark):
    """What is windowed over a single key is dealt by bucket as well."""
    frame = spark.range(300_000).select(F.lit("a").alias("k"), F.col("id").alias("p"), (F.col("id") % 3 - 1).alias("v"))
    got = ranking.depth(frame, ["k"], "p", "v")
    assert got.agg(F.min("depth"), F.max("depth")).first()[:] == (-1, 0)
    sizes = ordered.by_position(frame, ["k"], F.col("p")).groupBy("__key", "__bucket").count()
    assert sizes.agg(F.max("count")).first()[0] == ordered.WIDTH and sizes.count() == 5
    ranged = ordered.by_range(frame, ["k"], [F.col("p")])
    assert ranged.select("__bucket").distinct().count() > 1 or ranged.rdd.getNumPartitions() == 1


def test_markers_and_budgets(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 0), ("a", 4, 1), ("b", 1, 0), (None, 1, 1), (None, 2, 0)], "k string, p int, m int")
    got = ranking.after_marker(rows, ["k"], "p", F.col("m") == 1)
    assert sorted((str(r["k"]), r["p"]) for r in got.collect()) == [("None", 2), ("a", 3), ("a", 4)]
    assert got.columns == rows.columns
    sized = spark.createDataFrame([("a", i, 30) for i in range(6)] + [(None, 1, 500)], "k string, p int, n int")
    kept = ranking.within_budget(sized, ["k"], ("p",), "n", 100, 3)
    assert sorted((str(r["k"]), r["p"], r["taken"]) for r in kept.collect()) == [("None", 1, 100), ("a", 0, 30), ("a", 1, 30), ("a", 2, 30)]


def test_gaps_without_code(spark):
    rng = random.Random(8)
    code = {i: rng.random() < 0.2 for i in range(1, 400)}
    flags = spark.createDataFrame([("a", i, c) for i, c in code.items()], "k string, line int, is_code boolean").repartition(3)
    spans = [(i, i + 1) for i in range(2, 390, 5)]
    got = st.merge_gaps(spark.createDataFrame([("a", *s) for s in spans], "k string, start int, end int"), flags, ["k"])
    want = [list(spans[0])]
    for s, e in spans[1:]:
        if any(code[i] for i in range(want[-1][1] + 1, s)):
            want.append([s, e])
        else:
            want[-1][1] = e
    assert sorted((r["start"], r["end"]) for r in got.collect()) == [tuple(w) for w in want]


def test_ranks_of_one_group(spark):
    rng = random.Random(5)
    values = [float(rng.choice([rng.randrange(20), rng.random() * 20])) for _ in range(500)]
    frame = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v double").repartition(5)
    got = {r["i"]: r["midrank"] for r in statistics.midranks(frame, ["k"], "v").collect()}
    for i, v in enumerate(values):
        assert got[i] == sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2


CASES = {
    "spread": [math.exp(i / 40) for i in range(700)],
    "ties": [1.0] * 300 + [2.0] * 399 + [float(i) for i in range(5)],
    "a heavy value beside many": [float(i) for i in range(400)] + [500.0] * 5000,
    "infinities": [-math.inf] * 100 + [float(i) for i in range(300)] + [math.inf] * 200,
    "one value": [7.0] * 500,
    "two values": [1.0] * 250 + [math.inf] * 250,
}


@pytest.mark.parametrize("exact", [20, 100_000])
def test_quantiles(spark, monkeypatch, exact):
    """Selected within bounds that close in, and as one aggregate: NaN and null are no values."""
    monkeypatch.setattr(statistics, "EXACT", exact)
    rows = [(k, v) for k, vs in CASES.items() for v in vs] + [("ties", None), ("ties", math.nan), ("nothing", math.nan), ("nothing", None), (None, 4.0), (None, math.nan)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = {"least": 0.0, "a": 0.013, "q1": 0.25, "median": 0.5, "q3": 0.75, "b": 0.9999, "most": 1.0}
    got = {r["k"]: r for r in statistics.quantiles(frame, ["k"], "v", at).collect()}
    assert set(got) == {*CASES, None}
    for k, values in {**CASES, None: [4.0]}.items():
        values = sorted(values)
        for name, p in at.items():
            place = (len(values) - 1) * p
            low, high = values[math.floor(place)], values[math.ceil(place)]
            want = low if low == high else -math.inf if low == -math.inf and high < math.inf else low + (high - low) * (place - math.floor(place))
            assert got[k][name] == pytest.approx(want, rel=1e-12, nan_ok=True), (k, name)
    (whole,) = statistics.quantiles(frame.where("k = 'spread'"), [], "v", {"m": 0.5}).collect()
    assert whole["m"] == pytest.approx(np.median(CASES["spread"]))
    rest = {r["k"]: r for r in statistics.signs(frame, ["k"], "v").collect()}
    assert (rest["nothing"]["available"], rest["nothing"]["unavailable"], rest["nothing"]["median"]) == (0, 2, None)
    assert (rest["ties"]["available"], rest["ties"]["unavailable"]) == (704, 2)
    assert statistics.quartiles(frame, ["k"], "v").where("k = 'ties'").first()["n"] == 704


def test_a_task_ranks_so_many_rows(spark, tmp_path, monkeypatch):
    """rank_specs deals lines to tasks by their count, and ranks as its SQL does, null keys and hot targets included."""
    import duckdb

    from gaugewright.plans import coverage_queries
    from gaugewright.plans.registry import ORACLES, QUERIES

    rows = "select case when id % 50 = 0 then null when id % 2 = 0 then 1 else id % 37 end l_partkey, id % 11 l_suppkey, case when id % 13 = 0 then null else id % 17 end l_orderkey, cast(id % 7 as int) l_linenumber"
    rows += ", cast(id % 5 as double) l_quantity, id % 9 / 100 l_discount, case when id % 3 = 0 then 'R' else 'A' end l_returnflag, case when id % 4 = 0 then 'F' else 'O' end l_linestatus from range(3000)"
    spark.sql(rows).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(coverage_queries.ordered, "dealt", lambda df, keys, n, dealt=coverage_queries.ordered.dealt: dealt(df, keys, n, 100))
    got = QUERIES["rank_specs"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 30
    want = duckdb.sql(ORACLES["rank_specs"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_islands_come_from_tasks_of_so_many_rows(spark, monkeypatch):
    """Rows are dealt by their count, and a bucket's repeated values are one before it is sorted."""
    frame = spark.range(3000).selectExpr("if(id % 9 = 0, null, id % 3) k", "if(id % 100 < 50, 7, (id * 7) % 500) v").coalesce(1)
    asked = []

    def few(df, keys, n, dealt=ordered.dealt):
        out = dealt(df, keys, n, 100)
        asked.append((n, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(ordered, "dealt", few)
    got = sorted((str(r["k"]), r["start"], r["end"]) for r in ordered.islands(frame, ["k"], "v", 64).collect())
    want = []
    for k in ("0", "1", "2", "None"):
        values = sorted({r["v"] for r in frame.collect() if str(r["k"]) == k})
        heads = [v for v in values if v - 1 not in values]
        want += [(k, v, next(e for e in range(v, 600) if e + 1 not in values)) for v in heads]
    assert got == sorted(want) and asked == [(3000, 30)]


def test_a_task_counts_so_many_rows(spark, tmp_path, monkeypatch):
    """delta_totals deals lines by order and then by pair, and counts as its SQL does, null keys and hot pairs included."""
    import duckdb

    from gaugewright.plans import coverage_queries
    from gaugewright.plans.registry import ORACLES, QUERIES

    rows = "select case when id % 50 = 0 then null when id % 2 = 0 then 1 else id % 37 end l_partkey, case when id % 2 = 0 then 3 else id % 11 end l_suppkey, case when id % 13 = 0 then null else id % 400 end l_orderkey from range(3000)"
    spark.sql(rows).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    asked = []

    def few(df, keys, n, dealt=coverage_queries.ordered.dealt):
        out = dealt(df, keys, n, 100)
        asked.append((keys, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(coverage_queries.ordered, "dealt", few)
    got = QUERIES["delta_totals"](spark, str(tmp_path)).collect()
    want = duckdb.sql(ORACLES["delta_totals"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert asked == [(["l_suppkey", "l_partkey", "l_orderkey"], 30), (["l_suppkey", "l_partkey"], 30)]
