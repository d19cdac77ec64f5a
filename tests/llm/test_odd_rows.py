"""Null and repeated doc_ids, nulls in every column, and columns whose names the operators use themselves."""

import pytest

from gaugewright.llm import fingerprints, html, jaccard, media, mixing, packing, quality, secrets, sharding, tokens
from gaugewright.llm.queries import tokenizer_path

ROWS = [(None, "y y y y y y", None, None), (None, "x", "s", "en"), (5, "z z z z z z z", None, "xx"), (5, "a", "s", None), (5, "a", "s", None), (7, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    extra = "bucket long, key string, sig string, n string, copies string, rate string, blob string, secrets string, todo string, `__bucket` int"
    rows = [(*r, 1, *["c"] * 8, 3) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, {extra}").repartition(3)


def test_each_row_has_its_result(spark, odd):
    n = len(ROWS)
    assert fingerprints.compare_neighbours(odd).count() == n
    assert fingerprints.fingerprints(odd).count() == n
    assert secrets.findings(odd.select("doc_id", "text"), secrets.scan(odd)).count() == n
    assert media.digests(media.store(odd)).count() == n
    assert sharding.shard(odd).select("row_number").distinct().count() == n
    assert packing.pack(odd, tokenizer_path()).select("sequence_id").distinct().count() == packing.pieces(odd, tokenizer_path(), with_ids=True).count()
    assert tokens.count_tokens(odd, tokenizer_path(), ["text"], "most").count() == n
    assert jaccard.join(odd).count() == n
    model = quality.fit(odd, spark.createDataFrame([(5, 1), (5, 0), (None, 1), (7, None)], "doc_id long, quality int"))
    assert quality.score(odd, model).count() == n
    mixed = mixing.mix(odd)
    assert mixed.select("text").subtract(odd.select("text")).count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, None, "<p>a, b.</p>"), (1, None, "<p>a, b.</p>")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html.extract(pages).collect()) == ["", "a, b.", "a, b."]


def test_neighbours_in_order(odd):
    got = fingerprints.compare_neighbours(odd).collect()
    lengths = sorted((r["doc_id"] is not None, r["doc_id"], r["n_chars"]) for r in got)
    assert [x[2] for x in lengths] == [1, 11, 1, 1, 13, 0]
    last = next(r for r in got if r["doc_id"] == 7)
    import hashlib

    assert last["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    z = next(r for r in got if r["doc_id"] == 5 and r["n_chars"] == 13)  # followed by the null text
    assert z["edited_sha256"] == hashlib.sha256(b"z z z z").hexdigest()


def test_classes_of_odd_rows(odd):
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_copies"]) for r in jaccard.join(odd).collect())
    assert got == [("5", "5", 1), ("5", "5", 2), ("5", "5", 2), ("7", "7", 1), ("None", "None", 1), ("None", "None", 1)]
