"""The registered queries over whole small tables: columns and types that are asked for, one row for each document."""

import pytest

from gaugewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WANTED = {
    "op1_syncmer_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_blob_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op4_iso_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5_feistel_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_power_of_two_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_tag_path_ratios": "page_id bigint, url string, text string, n_chars bigint",
    "op9_jaccard_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op10_co_training_quality": "doc_id bigint, score double, keep boolean",
    "op11_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12_boosted_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
}


@pytest.mark.parametrize("name", sorted(WANTED))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    for column in WANTED[name].split(", "):
        field, kind = column.split()
        assert types[field] == kind, column
    key = "page_id" if "page_id" in types else "doc_id"
    table = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    got = [r[0] for r in df.select(key).collect()]
    assert set(got) == {r[0] for r in table.select(key).collect()}
    assert name.startswith("op6") or len(got) == table.count()
