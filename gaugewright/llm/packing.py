"""Sequence packing by power-of-two decomposition.

A document's token ids are cut into blocks of ``capacity`` (a power of two) and the rest into the powers of two of its
binary form, large ones first.  Each piece is a whole sequence of a power-of-two length: no sequence crosses documents
and none has padding.  Sequences are numbered bucket by bucket (equal lengths side by side, long ones first), so batches
of equal lengths are ranges of sequence_id.

Cases: null text counts as empty (its end id alone); repeated rows are packed once each and keep their own sequences;
an empty table gives no rows; other columns are ignored.  A text of any length is encoded whole, in memory linear in it, and
is cut into so many full blocks and a rest; pieces equal in length, doc_id, start and ids may swap their sequence numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, number_rows, ship, slices, text_or_empty
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECES_SCHEMA = SCHEMA + ", ids array<int>"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole blocks, then the binary form of the rest."""
    out = [(at, capacity) for at in range(0, n - capacity + 1, capacity)]
    at, rest = len(out) * capacity, n % capacity
    while rest:
        length = 1 << (rest.bit_length() - 1)
        out.append((at, length))
        at, rest = at + length, rest - length
    return out


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        encode = encoder(path)
        for batch in slices(batches):
            rows: list[tuple] = []
            ids_out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                for at, length in cuts(len(ids), capacity):
                    piece = ids[at : at + length]
                    rows.append((doc, at, length, zlib.crc32(piece.tobytes()), len(ids)))
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Every document's pieces, with their ids if asked for; not yet numbered."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), PIECES_SCHEMA if with_ids else SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece, i.e. for each sequence.

    Texts are encoded once; the small piece rows are checkpointed before they are dealt by range and numbered.
    """
    cut = checkpointed(pieces(docs, tokenizer_path, capacity, end_id))
    order = [F.col("length").desc(), F.col("doc_id").asc(), F.col("start").asc(), F.col("ids_crc32").asc()]
    return number_rows(cut, order, "sequence_id").withColumn("offset", F.lit(0).cast("long"))
