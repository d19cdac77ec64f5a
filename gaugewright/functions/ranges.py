"""Line-range specs such as ``3-5;9``: column functions over the text form and over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Lines of one spec that decode() writes out at most.
MOST = 10_000_000


def parse_spans(spec: Column) -> Column:
    """array<struct<start, end>> of a spec in its order, first occurrences only; bounds may come reversed, tokens that
    are no range are skipped, null gives an empty array."""
    tokens = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ";"), lambda x: F.trim(x)), lambda t: t.rlike(r"^\d+(\s*-\s*\d+)?$"))

    def span(token: Column) -> Column:
        a = F.regexp_extract(token, r"^(\d+)", 1).try_cast("int")
        b = F.regexp_extract(token, r"(\d+)$", 1).try_cast("int")
        return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))

    return F.array_distinct(F.filter(F.transform(tokens, span), lambda s: s.start.isNotNull() & s.end.isNotNull()))


def merged_spans(spec: Column, positive: bool = True) -> Column:
    """Ascending array<struct<start, end>> of a spec's lines, no two of which touch; lines below 1 are dropped if
    ``positive``.  This form of a spec grows with its text, however many lines it names."""
    spans = F.transform(parse_spans(spec), lambda s: F.struct(s.start.cast("long").alias("start"), s.end.cast("long").alias("end")))
    if positive:
        spans = F.transform(F.filter(spans, lambda s: s.end > 0), lambda s: F.struct(F.greatest(s.start, F.lit(1).cast("long")).alias("start"), s.end.alias("end")))

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"))))
        return F.when((F.size(done) > 0) & (s.start <= F.try_element_at(done, F.lit(-1)).end + 1), longer).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), step)


def decode(spec: Column, positive: bool = True) -> Column:
    """Ascending distinct lines of a spec; lines below 1 are dropped if ``positive``.

    Lines are written out, so a spec of more than MOST is an error here: its spans say the same, see merged_spans().
    """

    def of(spans: Column) -> Column:
        total = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end - s.start + 1)
        lines = F.flatten(F.transform(spans, lambda s: F.sequence(s.start.cast("int"), s.end.cast("int"))))
        return F.when(total <= MOST, lines).otherwise(F.raise_error(F.lit(f"a line spec names more than {MOST} lines")).cast("array<int>"))

    return bound(merged_spans(spec, positive), of)


def span_token(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def encode(lines: Column) -> Column:
    """The spec of an array of lines: runs of consecutive lines as ``a-b``, joined by ``;``; empty gives ``""``.

    A run begins where a line's predecessor in order is not one less, and ends where its successor is not one more: two
    shifted copies of the sorted lines are compared, so the work is that of sorting them.
    """

    def of(ordered: Column) -> Column:
        gap = F.array(F.lit(None).cast("long"))
        whole = F.transform(ordered, lambda x: x.cast("long"))
        inner = F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0)))
        before, after = F.concat(gap, inner), F.concat(F.slice(whole, 2, F.size(whole)), gap)
        first = F.filter(F.zip_with(whole, before, lambda x, p: F.when(p.isNull() | (p < x - 1), x)), lambda x: x.isNotNull())
        last = F.filter(F.zip_with(whole, after, lambda x, p: F.when(p.isNull() | (p > x + 1), x)), lambda x: x.isNotNull())
        return F.when(F.size(whole) == 0, "").otherwise(F.array_join(F.zip_with(first, last, span_token), ";"))

    return bound(F.array_sort(F.array_distinct(lines)), of)


def line_count(spec: Column, positive: bool = True) -> Column:
    """How many different lines a spec names, from its spans alone: no line is written out."""
    return F.aggregate(merged_spans(spec, positive), F.lit(0).cast("long"), lambda n, s: n + s.end - s.start + 1)


def bounds(spec: Column) -> Column:
    """struct<first, last> line of a spec, null if it has none."""
    spans = parse_spans(spec)
    least = F.array_min(F.transform(spans, lambda s: s.start))
    most = F.array_max(F.transform(spans, lambda s: s.end))
    return F.when(F.size(spans) > 0, F.struct(least.alias("first"), most.alias("last")))
