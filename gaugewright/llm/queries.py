"""The operators' queries, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html, jaccard, media, merkle, mixing, packing, quality, secrets, sharding, tokens, tries, urls
from .common import read, shared_folder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(read(spark, sf_dir, "documents"))


def op2_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions come in two batches, dealt by a hash; the second one scans only what the ledger of the first lacks."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    early = F.xxhash64("doc_id") < 0  # of null it is not null
    for batch in (early, ~early):
        ledger.add(docs.where(batch))
    found = secrets.findings(docs, ledger.rows())
    base = F.filter("secrets", lambda s: s["order"] < 3)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.listing(base), 256).alias("base_sha256"),
        secrets.listing(F.col("secrets")).alias("spans"),
        "blob",
    )


def op3_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), ["lang", "source", "text"])


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = media.digests(media.store(docs))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), "codec"),
        F.concat(F.lit("duration="), F.col("duration").cast("string")),
        F.concat(F.lit("samples="), F.col("n_samples").cast("string")),
        F.concat(F.lit("keyframes="), F.col("n_keyframes").cast("string")),
        F.concat(F.lit("ranges="), F.sha2(F.to_json(F.struct("keyframe_starts", "keyframe_ends")), 256)),
    )
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.crc32("tail").alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
        "codec", "duration", "n_samples", "n_keyframes", "keyframe_starts", "keyframe_ends",
    )


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op6_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "rate", "copies", "copy", "shuffle_key", F.md5("text").alias("text_md5"))


def op8_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op10_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality.with_labels(docs, read(spark, sf_dir, "labels"))
    return quality.score_vectors(found, quality.fit_vectors(found))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read(spark, sf_dir, "documents"))


def op12_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees learn from the URLs that rules judge and judge the others."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.fit(urls.labelled_by_rules(pages)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.nodes(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints,
        op2_blob_ledger,
        op3_offset_token_counts,
        op4_iso_media,
        op5_feistel_shards,
        op6_power_of_two_packing,
        op7_poisson_mix,
        op8_tag_path_ratios,
        op9_jaccard_join,
        op10_co_training_quality,
        op11_merkle_manifest,
        op12_boosted_url_filter,
        op13_prefix_trie,
        pipeline,
    )
}

ORACLES = {
    "op2_blob_ledger": secrets.SQL,
    "op7_poisson_mix": mixing.SQL,
    "op9_jaccard_join": jaccard.SQL,
    "op11_merkle_manifest": merkle.sql(),
    "op13_prefix_trie": tries.SQL,
}
