"""Functions for SQL: register(spark) makes the lexers and table functions known to a session by name.

Scalar: ``java_mask(code)``, ``java_methods(code)``, ``java_code_lines(code)``, ``common_length(a, b)``.
Table, to be used after LATERAL: ``assertion_sites(code)``, ``test_method_bodies(code)``, ``explode_ranges(spec)``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import java


@F.udtf(returnType="name string, lead string, qualifier string, arguments array<string>, terminal string")
class AssertionCalls:
    """A row for each call that may be an assertion; java.site() says what it asserts."""

    def eval(self, code: str):
        for c in java.calls(java.outline(code or ""), java.SITE_CALLS):
            yield c["name"], c["lead"], c["qualifier"], c["arguments"], c["terminal"]


@lru_cache(maxsize=256)
def _test_bodies(code: str) -> list[tuple]:
    """Of sources that come again those of late are kept."""
    return [m for m in java.methods(code) if java.is_test(m[0], m[1])]


@F.udtf(returnType="name string, annotations array<string>, body string", useArrow=True)
class TestMethodBodies:
    """A row for each test method with its masked body."""

    __test__ = False  # not for the test runner

    def eval(self, code: str):
        yield from _test_bodies(code or "")


@F.udtf(returnType="line int")
class ExplodeRanges:
    """A row for each different positive line of a spec such as ``3-5;9``, ascending; spans are merged, never held as lines."""

    def eval(self, spec: str):
        spans = []
        for token in (spec or "").split(";"):
            bounds = [b.strip() for b in token.split("-")]
            if 1 <= len(bounds) <= 2 and all(b.isdigit() for b in bounds):
                spans.append((min(map(int, bounds)), max(map(int, bounds))))
        upto = 0
        for start, end in sorted(spans):
            for line in range(max(start, upto + 1), end + 1):
                yield (line,)
            upto = max(upto, end)


def register(spark: SparkSession) -> None:
    spark.udf.register("java_mask", java._udf(java.mask, "string"))
    spark.udf.register("java_methods", java._udf(java.method_rows, java._METHOD_TYPE))
    spark.udf.register("java_code_lines", java._udf(java.code_lines, "array<boolean>"))

    @F.pandas_udf("int")
    def common_length(x, y):
        import pandas as pd

        return pd.Series([java.longest_common(list(p), list(q)) for p, q in zip(x, y, strict=True)])

    spark.udf.register("common_length", common_length)
    spark.udtf.register("assertion_sites", AssertionCalls)
    spark.udtf.register("test_method_bodies", TestMethodBodies)
    spark.udtf.register("explode_ranges", ExplodeRanges)
