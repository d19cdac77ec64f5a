"""A corpus pipeline over ``documents``: judge, join near copies, redact secrets, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm import jaccard, mixing, packing, quality, secrets
from gaugewright.llm.common import read, removed, shared_folder
from gaugewright.llm.queries import tokenizer_path


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null text, language or source count as empty; rows of one doc_id are judged each by their own content, equal rows
    alike, and a score at the bar stays; without labels, or with those of one kind alone, all documents have one score; an
    empty table stays empty; a text is hashed whole, slice by slice; other columns, whatever their names, stay as they are.
    """
    return quality.filter_documents(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, one with the least doc_id; rows are told apart by doc_id and text.

    Null and empty texts, and those without words, are classes by their text; a null doc_id comes before all others; of rows
    equal in doc_id and text one stays, by a hash of its other columns; other columns stay as they are.
    """
    return jaccard.distinct(docs)


def held(docs: DataFrame, *names: str) -> DataFrame:
    """__row, the whole row, and the named columns: an operator's own column names cannot clash with those of docs, and a dot in
    a name is part of it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *names)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets' spans are replaced; n_chars follows.

    A null text stays null and keeps its n_chars; an empty one has no spans; overlapping spans are one stretch; equal texts
    are scanned once and redacted alike; an empty table stays empty; other columns stay as they are.
    """
    ledger = secrets.Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.add(docs.select("doc_id", "text"))
    clean = secrets.redact(secrets.findings(held(docs, "text"), ledger.rows()))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("__row.n_chars"))}
    return clean.select(*[new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to equal weights; copies keep their doc_id.

    A null source is a source of its own; repeated rows count each and are drawn alike, as a row's copies follow from a hash
    of its doc_id; a document may come several times or not at all, which is the mix; other columns stay.
    """
    return mixing.mix(held(docs, "doc_id", "source")).select("__row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, i.e. for each sequence of a power-of-two length.

    A null text is empty and has its end id alone; repeated rows are packed each; a very long text is cut into whole
    sequences and the powers of two of its rest; an empty table gives no rows; other columns are ignored.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", judged), ("near_copies", deduplicated), ("secrets", redacted), ("mixing", mixed), ("packing", packed)]

#: A fitted classifier, hashed words and token ids cannot be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written in the cluster's shared folder and read again.

    A stage's folder is removed when the next one's is whole; the last one's input stays, as the result reads it.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            removed(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
