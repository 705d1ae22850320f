"""Queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import resampling, sharding, vector_codes
from .bpe_stream import encode_decode_digest
from .common import fresh_path, staged, table
from .flac import digest_in_parts, flac_column
from .html_text import extract_main_text
from .jaccard import SQL as JACCARD_SQL
from .jaccard import jaccard_components
from .packing import pack_documents
from .quality import SQL as QUALITY_SQL
from .quality import quality_table
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files
from .toxicity import learn_lexicon, toxicity_scores
from .url_filter import tree_url_verdicts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 24


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return read_token_files(spark, path, with_ids=False)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_url_verdicts(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, learn_lexicon(docs, table(spark, sf_dir, "labels")))


def op5_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digest(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents"))


def op8_flac_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    # small row groups: the files of a part are read by as many tasks as there are cores
    return digest_in_parts(staged(flac_column(table(spark, sf_dir, "documents")), "media", **{"parquet.block.size": 4 << 20}))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    sha = F.lit(books.sha256() if books else None).cast("string")
    return vector_codes.with_label_error(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", sha.alias("codebooks_sha256"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_best_fit_packing, op3_url_filter, op4_toxicity, op5_bpe_stream, op6_html_text, op7_quality_rules, op8_flac_column, op9_jaccard_join, op10_token_counts, op11_rendezvous_shards, op12_vector_codes, op13_target_resampling, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": QUALITY_SQL.format(documents="documents"), "op9_jaccard_join": JACCARD_SQL.format(k=4, percent=85), "op11_rendezvous_shards": sharding.sql(SHARDS), "op12_vector_codes": vector_codes.sql(), "op13_target_resampling": resampling.sql()}
