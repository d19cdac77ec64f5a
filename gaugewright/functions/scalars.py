"""Small numeric, date, list and JSON functions with the reference's defaults spelled out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def percentage(covered: Column, total: Column) -> Column:
    """100 * covered / total, 0 where total is null or not positive."""
    return F.when(total > 0, F.lit(100.0) * covered / total).otherwise(F.lit(0.0))


def percent_text(value: Column) -> Column:
    """Two decimals without trailing zeros."""
    text = F.regexp_replace(F.format_string("%.2f", value.cast("double")), r"0+$", "")
    return F.regexp_replace(text, r"\.$", "")


def int_or_zero(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(0))


def float_or_zero(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def split_list(text: Column) -> Column:
    """Items of an ``a;b`` or ``a|b`` list, trimmed, without blanks; null and "null" are the empty list."""
    items = F.filter(F.transform(F.split(text, r"[;|]"), lambda x: F.trim(x)), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | (F.lower(F.trim(text)) == "null"), empty).otherwise(items)


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text to a timestamp, null if it is none."""
    return text.try_cast("timestamp")


#: Named orders in which flags make a status; they differ on purpose and are not to be merged.
STATUS_ORDERS = {"run": ("timeout", "failed", "skipped"), "copied": ("failed", "timeout", "skipped")}


def status_from_flags(timeout: Column, failed: Column, skipped: Column, order: str = "run") -> Column:
    """The first flag that is on in the named order, else passed; null flags (no row) give missing."""
    flags = {"timeout": timeout, "failed": failed, "skipped": skipped}
    out = F.when(timeout.isNull() & failed.isNull() & skipped.isNull(), "missing")
    for name in STATUS_ORDERS[order]:
        out = out.when(F.coalesce(flags[name].cast("int"), F.lit(0)) > 0, name)
    return out.otherwise("passed")


def target_id(repo: Column, fqcn: Column) -> Column:
    return F.concat_ws("_", F.translate(repo, "/", "_"), F.translate(fqcn, ".", "_"))


def repo_to_dir(repo: Column) -> Column:
    return F.translate(repo, "/", "_")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "_")


def run_id(ts: Column, label: Column) -> Column:
    return F.concat_ws("-", F.date_format(ts, "yyyyMMdd-HHmm"), label)


def is_run_id(text: Column) -> Column:
    return text.rlike(r"^\d{8}-\d{4}-[A-Za-z0-9._-]+$")


def duration(start: Column, end: Column, now: Column | None = None) -> Column:
    """end - start, or now - start while it is open."""
    return F.coalesce(end, F.current_timestamp() if now is None else now) - start


def landed(body: Column, fields: dict[str, tuple[str, str, object]]) -> Column:
    """struct of the named fields of a landed JSON text, each (path, type, what holds where it is missing, of another type, or
    the text no JSON): the text is parsed once, as a VARIANT, whatever its shape."""

    def of(v: Column) -> Column:
        return F.struct(*[F.coalesce(F.try_variant_get(v, path, kind), F.lit(default).cast(kind)).alias(n) for n, (path, kind, default) in fields.items()])

    return bound(F.try_parse_json(body), of)


def utf8_text(content: Column) -> Column:
    """The text of bytes as UTF-8; those that are none are dropped.

    Such bytes become U+FFFD, which goes; one that the text has itself is written another way meanwhile.
    """
    mark, own, kept = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2"
    text = content.cast("string")
    escaped = F.replace(F.replace(text, F.lit(mark), F.lit(own)), F.lit("\ufffd"), F.lit(kept))
    valid = F.replace(F.make_valid_utf8(escaped), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.replace(valid, F.lit(kept), F.lit("\ufffd")), F.lit(own), F.lit(mark)))


def unbase64_text(text: Column) -> Column:
    """Decoded base64 text without bytes that are no UTF-8; null if it is no base64."""
    return utf8_text(F.try_to_binary(text, F.lit("base64")))


def digest_of_set(items: Column) -> Column:
    """SHA-256 of an array of texts whatever its order."""
    return F.sha2(F.array_join(F.array_sort(items), "\n"), 256)


def mean_of_available(*values: Column) -> Column:
    """The mean of those values that are not null; null if none is."""
    kept = F.filter(F.array(*[v.cast("double") for v in values]), lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(kept) > 0, total / F.size(kept))


def weighted_mean(values: list[Column], weights: list[float]) -> Column:
    """Weights renormalised over the values that are not null; their plain mean if those weights sum to 0."""
    total = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    top = sum((F.coalesce(v * float(w), F.lit(0.0)) for v, w in zip(values, weights, strict=True)), F.lit(0.0))
    return F.when(total > 0, top / total).otherwise(mean_of_available(*values))


def version_key(text: Column) -> Column:
    """Natural order of versions: an array of structs that compares digit runs as numbers, above letter runs."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|[^\d.\-_+]+"), F.lit(0))
    return F.transform(
        parts,
        lambda p: F.struct(p.rlike(r"^\d+$").alias("is_number"), F.coalesce(F.when(p.rlike(r"^\d+$"), p.try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(~p.rlike(r"^\d+$"), F.lower(p)).otherwise("").alias("text")),
    )


def json_path(text: Column, path: str, default=None) -> Column:
    found = F.get_json_object(text, path)
    return found if default is None else F.coalesce(found, F.lit(default))


def first_tagged(text: Column, tag: str) -> Column:
    """What stands between [TAG] and [/TAG], else in the first fenced block, else null."""
    found = (F.regexp_extract(text, rf"(?s)\[{tag}\]\s*(.*?)\s*\[/{tag}\]", 1), F.regexp_extract(text, r"(?s)```(?:[a-zA-Z]*\n)?\s*(.*?)\s*```", 1))
    tagged, fenced = (F.nullif(f, F.lit("")) for f in found)
    return F.coalesce(tagged, fenced)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """value scaled to 0..1; 0 for a constant column."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def fit(value: Column, floor: Column, human: Column) -> Column:
    """Share of the way from floor to human; null where human is not above floor."""
    return F.when(human > floor, (value - floor) / (human - floor))


def gap_closed(increment: Column, standalone: Column) -> Column:
    """Percent of what a suite misses that an increment covers; null where it misses nothing."""
    return F.when(standalone < 100, F.lit(100.0) * increment / (F.lit(100.0) - standalone))


def tied(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    return F.abs(a - b) <= F.greatest(a, b) * tolerance


def ordering(names: list[str], values: list[Column]) -> Column:
    """``A > B = C``: names by falling value, equal values joined by ``=`` in the order given."""
    items = F.array(*[F.struct((-v).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(zip(names, values, strict=True))])
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("double").alias("last"))

    def add(s: Column, x: Column) -> Column:
        sign = F.when(s.last.isNull(), "").when(s.last == x.v, " = ").otherwise(" > ")
        return F.struct(F.concat(s.out, sign, x.n).alias("out"), x.v.cast("double").alias("last"))

    return F.aggregate(F.array_sort(items), start, add, lambda s: s.out)


def best_set(names: list[str], values: list[Column], tolerance: float) -> Column:
    """Names whose value is at least (1 - tolerance) of the largest, joined by ``=``."""
    top = F.greatest(*values)
    kept = [F.when(v >= top * (1 - tolerance), F.lit(n)) for n, v in zip(names, values, strict=True)]
    return F.array_join(F.filter(F.array(*kept), lambda x: x.isNotNull()), "=")
