"""The pipeline against a plain Python version of its stages, and on odd tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gaugewright.llm import quality, tokens
from gaugewright.llm.queries import QUERIES, tokenizer_path

from .test_training_data import brute_classes, brute_spans

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans: list[list[int]] = []
    for s, _, e, _ in brute_spans(text):
        if spans and spans[-1][1] > s:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    out, at = "", 0
    for s, e in spans:
        out, at = out + text[at:s] + "[secret]", e
    return out + text[at:]


def copies(doc_id, rate):
    u = int(hashlib.md5(f"mix:{doc_id}".encode()).hexdigest()[:13], 16) / 16**13
    k, term = 0, math.exp(-rate)
    total = term
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_pipeline_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(map(tuple, docs.select("doc_id", "text", "lang", "source").collect()))
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    x = quality.unpacked(quality.packed(*([r[i] or "" for r in rows] for i in (1, 2, 3))))
    rows = [r for r, k in zip(rows, model.scores(x)[0] >= quality.KEEP, strict=True) if k]
    label, _ = brute_classes([r[1] for r in rows])
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    rows = [(d, redacted(t), s) for d, t, _, s in rows]
    n = Counter(s for _, _, s in rows)
    encode = tokens.encoder(tokenizer_path())
    want: Counter = Counter()
    for d, t, s in rows:
        ids = [*encode(t), 1]
        at = 0
        for length in [2048] * (len(ids) // 2048) + [1 << b for b in range(10, -1, -1) if len(ids) % 2048 >> b & 1]:
            want[d, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()), len(ids)] += copies(d, len(rows) / (len(n) * n[s]))
            at += length
    got = QUERIES["pipeline"](spark, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == +want
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))


@pytest.mark.parametrize("empty", (False, True))
def test_stages_on_odd_tables(spark, empty):
    rows = [(None, None, None, None, None), (1, "", "", "", 0), (2, "a b c d e f " * 5000, "en", "s", 1), (2, "a b c d e f " * 5000, "en", "s", 1), (3, "password=abcdefgh and words", None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.where("false") if empty else docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0) == empty
    if not empty:
        assert {r["text"] for r in corpus_pipeline.redacted(spark, docs, SF).where("doc_id = 3").collect()} == {"[secret] and words"}


def test_near_copies_go_by_row(spark):
    text = {name: " ".join(f"{name}{i}" for i in range(40)) for name in "abcde"}
    rows = [(1, text["a"], "x"), (2, text["b"], "x"), (2, text["a"], "x"), (2, text["a"] + " more", "x"), (3, text["c"], "x"), (3, text["c"], "y"), (3, text["c"], "y")]
    rows += [(None, text["d"], "x"), (None, text["d"], "x"), (None, text["d"] + " more", "x"), (4, text["d"], "x"), (None, text["e"], "x"), (3, None, "x"), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.deduplicated(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    kept = [(r["doc_id"], (r["text"] or "-")[0]) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (None, "e"), (3, "-")], key=str)


def test_columns_of_other_names_stay(spark):
    """Columns that the operators name themselves come out of each stage as they were."""
    extra = ("blob", "secrets", "rate", "copies", "copy", "shuffle_key", "key", "tid", "x", "y", "score", "keep", "dotted.name")
    rows = [(i, f"password=abcdefgh{i} and a text with more words, number {i}", "en", "s", 9, *[f"{c}{i}" for c in extra]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        for r in out.collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in extra)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
