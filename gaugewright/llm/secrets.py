"""Secret scans over an incremental blob ledger.

Every version of every file (path, text) is content-addressed: its blob is the SHA-256 of its text.  A ledger has a row
for each (blob, rule, rule_version) that was scanned, with the spans found.  A scan takes from the versions only the
blobs that lack some current pair, scans each once, whatever the number of paths, adds the ledger's new rows and joins
findings back to all paths.  A Ledger keeps its rows as Parquet in the cluster's shared folder, a folder for each batch of
versions, so later batches scan nothing again.  DataFrame functions only.

Places are running sums over a blob's pieces, in rows rather than in one array that grows: the work is linear in a text's
matches.

Spans are in code points, end exclusive, leftmost and non-overlapping for each rule; matches that fail a rule's least
length are dropped after matching, so what they covered stays covered.

Cases: null text counts as empty and has no spans; repeated rows and equal texts give equal findings for each row; an
empty table gives no rows; the input's other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed


@dataclass(frozen=True)
class Rule:
    """pattern must not match the empty string; ``group`` of a match must have ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    #: A looser test that every text with a finding passes; spares the others the search for places.
    sign: str


#: The patterns and lengths that are asked for, in the order of their kinds.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, "[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)

LEDGER = "blob string, rule string, rule_version int, spans array<struct<start:long,end:long>>"


PIECES = "array<struct<gap:int,length:int,fits:boolean>>"


def pieces(text: Column, rule: Rule) -> Column:
    """PIECES of a rule: for each match what lies between it and the one before, its length, and whether it is long enough.

    The text is split at the matches; lengths of gaps and matches, summed up in turn, are the places.
    """
    pattern = rule.pattern if rule.group or rule.least < 2 else rule.pattern[:-1] + "{%d,}" % (rule.least - _fixed(rule))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def fits(match: Column) -> Column:
        return F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least if rule.group else F.lit(True)

    lengths = F.transform(found, lambda m: F.struct(F.length(m).alias("length"), fits(m).alias("fits")))
    # Of the gaps, one more than matches, the last is dropped with the null that it is zipped with.
    pairs = F.zip_with(gaps, lengths, lambda g, m: F.when(m.isNotNull(), F.struct(g.alias("gap"), m.length.alias("length"), m.fits.alias("fits"))))
    found_any = F.filter(pairs, lambda x: x.isNotNull())
    return F.when(text.rlike(rule.sign), found_any).otherwise(F.array().cast(PIECES))


def _fixed(rule: Rule) -> int:
    """Characters before the pattern's last, repeated class: a run is greedy, so a least length can stand in the pattern."""
    return len(rule.pattern[: rule.pattern.rindex("[")])


def blobs(versions: DataFrame) -> DataFrame:
    """versions(path columns..., text) with the content address ``blob`` added."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """blob, text, todo (names of rules): each blob once that lacks a current (rule, version) pair.

    Copies are brought together first, task by task and then by address, so that a blob with very many paths meets the
    ledger as one row.
    """
    addressed = blobs(versions.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is not None:
        current = ledger.where(" or ".join(f"(rule = '{r.kind}' and rule_version = {r.version})" for r in rules))
        done = current.groupBy("blob").agg(F.collect_set("rule").alias("done"))  # as many as there are rules, at most
        addressed = addressed.join(done, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
        return addressed.where("size(todo) > 0").select("blob", "text", "todo")
    return addressed.withColumn("todo", every)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """New rows of the ledger, one for each unseen blob and rule pair, found or not.

    Blobs come dealt by their address, and every step below keeps to that: places cost no shuffle.
    """
    todo = unseen(versions, ledger, rules)
    done = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), F.when(F.array_contains("todo", r.kind), pieces(F.col("text"), r)).alias("pieces")) for r in rules])
    rows = todo.select("blob", F.inline(F.filter(done, lambda x: x["pieces"].isNotNull())))
    rows = rows.select("blob", "rule", "rule_version", F.posexplode_outer("pieces").alias("pos", "piece"))
    upto = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("piece.gap") + F.col("piece.length")).cast("long")).over(upto)
    placed = rows.withColumn("__end", end)
    span = F.when(F.col("piece.fits"), F.struct((F.col("__end") - F.col("piece.length")).alias("start"), F.col("__end").alias("end")))
    return placed.groupBy("blob", "rule", "rule_version").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # nulls are not collected


def findings(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """versions with ``blob`` and ``secrets``: array<struct<start, order, end, kind, covered>> sorted by start, then rule
    order; covered is how far the spans before reach (null for the first one).

    Only blobs with a finding are joined back; the others have none.  Their rows are checkpointed, so that the join has
    nothing but shuffles below it: then adaptive execution can split the paths of a blob that has very many.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = ledger.where("size(spans) > 0").where(" or ".join(f"(rule = '{r.kind}' and rule_version = {r.version})" for r in rules))
    each = current.select("blob", "rule", F.inline("spans")).withColumn("order", order[F.col("rule")])
    before = Window.partitionBy("blob").orderBy("start", "order", "end").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("covered", F.max("end").over(before))
    per = each.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "order", "end", F.col("rule").alias("kind"), "covered"))).alias("secrets"))
    none = F.array().cast("array<struct<start:long,order:int,end:long,kind:string,covered:long>>")
    return blobs(versions).join(checkpointed(per), "blob", "left").withColumn("secrets", F.coalesce("secrets", none))


class Ledger:
    """A ledger that lasts: Parquet below ``path``, a folder ``part-N`` for each batch that was scanned.

    A batch is written whole under another name and renamed then, so that a lost job leaves no half of it; a batch that is
    run again finds its pairs scanned and adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str, rules=RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        _, folder, files = self._files()
        if not files.exists(folder):
            return []
        return sorted(str(s.getPath().toString()) for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))

    def rows(self) -> DataFrame:
        parts = self.parts()
        return self.spark.read.schema(LEDGER).parquet(*parts) if parts else self.spark.createDataFrame([], LEDGER)

    def add(self, versions: DataFrame) -> None:
        """Scans what the ledger lacks of the versions and keeps it."""
        jvm, _, files = self._files()
        parts = self.parts()
        new = scan(versions, self.rows() if parts else None, self.rules)
        name = f"{self.path}/_new-{uuid.uuid4().hex}"
        new.write.parquet(name)
        if not files.rename(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.hadoop.fs.Path(f"{self.path}/part-{len(parts):06d}")):
            raise OSError(f"{name} cannot be renamed")


def listing(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """findings() with each stretch of text that spans cover replaced by ``mark``; blob and secrets go.

    Overlapping spans are one stretch.  Texts without findings stay as they are.  Pieces are cut from a form of the text
    with four bytes a code point, so that each cut costs its own length alone.
    """

    def cut(row: Column) -> Column:
        first = F.filter(row.secrets, lambda s: s.covered.isNull() | (s.start >= s.covered))  # where a stretch begins
        starts = F.concat(F.transform(first, lambda s: s.start), F.array(F.lit(None).cast("long")))
        last = F.array_max(F.transform(row.secrets, lambda s: s.end))
        ends = F.concat(F.transform(first, lambda s: F.coalesce(s.covered, F.lit(0).cast("long"))), F.array(last))
        width = lambda e, s: F.coalesce(s - e, F.octet_length(row.wide) / 4 - e).cast("int") * 4
        pieces = F.zip_with(ends, starts, lambda e, s: F.decode(F.substring(row.wide, (e * 4 + 1).cast("int"), width(e, s)), "UTF-32"))
        return F.array_join(pieces, mark)

    wide = F.struct(F.encode("text", "UTF-32").alias("wide"), "secrets")
    text = F.when(F.size("secrets") > 0, F.transform(F.array(wide), cut)[0]).otherwise(F.col("text"))
    return found.withColumn("text", text).drop("secrets", "blob")


def _found_sql(order: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    fits = f"length(regexp_extract(m[i], '{pattern}', {rule.group})) >= {rule.least}"
    place = "coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::bigint"
    return (
        f"select doc_id, {order} o, '{rule.kind}' kind, a, a + n e from (select doc_id, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda i: {fits}), lambda i: {{'a': {place}, 'n': length(m[i])}}), recursive := true) "
        f"from (select doc_id, regexp_extract_all(t, '{pattern}') m, regexp_split_to_array(t, '{pattern}') p from d))"
    )


#: DuckDB SQL for findings of all documents: the same patterns in the other engine, places from what lies between matches.
SQL = (
    "with d as (select doc_id, coalesce(text, '') t from documents), f as ("
    + " union all ".join(_found_sql(i, r) for i, r in enumerate(RULES))
    + """),
g as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
  string_agg(kind || ':' || a || ':' || e, ',' order by a, o) spans from f group by 1)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans, sha256(t) blob
from d left join g on g.doc_id = d.doc_id"""
)
