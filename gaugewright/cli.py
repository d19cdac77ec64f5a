"""Command line: ``python -m gaugewright COMMAND ...``; each command reads tables and writes one.

filter      units of candidates and baseline -> kept candidates
reduce      test and line deltas of a class -> its first N tests
compare     candidate and reference sources -> similarity, conformance and smells by file name
coverage    facts of variants -> the incremental report
query       a registered query over a folder of tables
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .operators import conventions, coverage, incremental, ranking, stages
from .sources import readers, sinks


def table(spark: SparkSession, path: str) -> DataFrame:
    return readers.csv_rows(spark, path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)


def write(df: DataFrame, path: str) -> None:
    if path.endswith(".csv"):
        sinks.write_csv(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def kept(spark: SparkSession, a) -> DataFrame:
    return coverage.incremental_filter(table(spark, a.candidates), table(spark, a.baseline), a.unit.split(","), a.order, tuple(filter(None, a.target.split(","))))


def reduced(spark: SparkSession, a) -> DataFrame:
    deltas = readers.test_deltas(spark, a.deltas)
    counts = stages.target_lines(readers.csv_rows(spark, a.lines, readers.LINE_DELTAS), ["test_selector"], F.lit(a.target))
    rows = stages.with_target_lines(deltas, counts, ["test_selector"]).withColumn("target", F.lit(a.target))
    order = [*ranking.ORDERS["reduce"], "test_selector"]
    return ranking.ranked(ranking.top_k(rows, ["target"], order, ranking.clamp_top_n(a.top)), ["target"], order).drop("bad_fields")


def compared(spark: SparkSession, a) -> DataFrame:
    named = lambda path, column: readers.source_files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("text").alias(column))
    pairs = named(a.candidate, "candidate").join(named(a.reference, "reference"), "file")
    rows = conventions.profile(conventions.similarity(pairs, "candidate", "reference"))
    smells = conventions.smell_totals(pairs.select("file", "candidate"), ["file"], "candidate").select("file", "methods", "smells", "density", "smelly_ratio")
    return rows.drop("candidate", "reference").join(smells, "file", "left")


def report(spark: SparkSession, a) -> DataFrame:
    return incremental.status(table(spark, a.facts))


def registered(spark: SparkSession, a) -> DataFrame:
    return catalog.QUERIES[a.name](spark, a.tables)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gaugewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(required=True)

    def add(name: str, run, /, **arguments):
        sub = commands.add_parser(name)
        for k, v in arguments.items():
            sub.add_argument(f"--{k}", **({"required": True} if v is None else {"default": v, "type": type(v)}))
        sub.add_argument("--out", required=True)
        sub.set_defaults(run=run)

    add("filter", kept, candidates=None, baseline=None, unit=None, order="test_order", target="")
    add("reduce", reduced, deltas=None, lines=None, target=None, top=100)
    add("compare", compared, candidate=None, reference=None)
    add("coverage", report, facts=None)
    add("query", registered, name=None, tables=None)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("gaugewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    write(a.run(spark, a), a.out)
