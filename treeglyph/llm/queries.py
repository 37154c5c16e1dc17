"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, licences, linededup, media, minhash, packing, quality, suffixes, warc
from .common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the same on every machine, as the package is installed there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_digests(table(spark, sf_dir, "documents"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join(F.transform("licences", lambda x: x["licence"]), " ").alias("licences"), F.size("licences").cast("long").alias("n_licences"), F.size("unmatched").cast("long").alias("n_unmatched"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), special_ids=True)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotation_digests(table(spark, sf_dir, "conversations"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.media_features(media.with_media(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup_digests(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when f.first_id <> p.page_id then 'revisit' else 'response' end as record_type,
  case when f.first_id <> p.page_id then f.first_id end as refers_to
from p left join f using (payload_digest)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_lines": op2_lines,
    "op3_licences": op3_licences,
    "op4_packing": op4_packing,
    "op5_chat": op5_chat,
    "op6_media": op6_media,
    "op7_quality": op7_quality,
    "op8_minhash": op8_minhash,
    "op9_suffixes": op9_suffixes,
    "op10_warc": op10_warc,
}
SQL: dict[str, str] = {"op2_lines": linededup.LINE_SQL, "op5_chat": chat.ROTATION_SQL, "op10_warc": OP10_SQL}
