"""The corpus operators as named queries, each over its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chunk_dedup, decontam, langid, near_dups, packing, periodic_runs, pii, quality, secret_scan,
               suffix_dedup, topk_search, warc, whitening)
from .common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents", "doc_id", "text"),
                                  read(spark, sf_dir, "benchmark", "item_id", "text"), short_items=True)


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.chunk_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def words_with_runs(doc_id: int | None, text: bytes) -> list[bytes]:
    """Words of a text; in a tenth of the documents (by the CRC-32 of the id) the
    words from one place on repeat a phrase.  A null id changes nothing."""
    words = text.split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read(spark, sf_dir, "documents", "doc_id", "text"), words_with_runs)


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_best_fit_packing, op3_pii, op4_quality_rules, op5_warc, op6_decontamination,
    op7_chunk_dedup, op8_language_id, op9_near_duplicates, op10_secret_scan,
    op11_embedding_whitening, op12_periodic_runs, op13_exact_topk)}
