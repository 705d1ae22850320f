"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard scores a record by a hash of (record key, shard number); the highest score holds it. A shard's score does not depend on
the other shards, so one more shard takes rows only into itself, a shard that goes gives up only its own rows, and a changed weight
moves rows only from or to its shard. Scores are w / -ln(u), u uniform from the hash, so a shard gets a share of the keys in
proportion to its weight.

All columns are Spark expressions. The numbering in a shard (slot) goes over the whole shard without one task that holds it: narrow
rows are dealt out by range of (shard, doc_id, size, crc, row), numbered in their part, and shifted by the rows in earlier parts.

Null ids share one key, null texts count as empty, rows with equal ids go to one shard (their key decides) but are split over tasks;
rows equal in all that is sorted by are numbered in any order. Empty tables give no rows. Only the named columns are read, so
further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, positions, staged


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """Number of the shard that holds `key`, an int; shards are numbered as `weights` are, those of weight 0 hold nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights: at least one above 0, none below")
    shards = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0))

    def score(s: Column) -> Column:
        digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), s["i"].cast("string"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((s["w"] / -F.log(u)).alias("score"), (-s["i"]).alias("less"))

    return (-F.array_max(F.transform(shards, score))["less"]).cast("int")


def assign_shards(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard) of documents (doc_id, text): shard under `weights` and under `grown`."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    other = rendezvous_shard(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")
    return rows.select("*", rendezvous_shard(F.col("doc_id"), weights).alias("shard"), other.alias("grown_shard"))


def shard_documents(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """assign_shards with `slot`, each shard's rows numbered gapless from 0 in order of doc_id (nulls first), size, crc."""
    rows = staged(assign_shards(docs, weights, grown), "assigned")
    keys = [F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    return positions(rows, "shard", keys, "slot")


def moved(docs: DataFrame, old: list[float], new: list[float]) -> DataFrame:
    """(from_shard, to_shard, n_rows, n_bytes) of documents that another set of weights moves."""
    rows = assign_shards(docs, old, new).where("shard != grown_shard")
    return rows.groupBy(F.col("shard").alias("from_shard"), F.col("grown_shard").alias("to_shard")).agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def write_shards(docs: DataFrame, path: str, weights: list[float], into: str = "shard") -> str:
    """Write whole documents, all their columns, as Parquet in one folder a shard; returns the name of the folder column: `into`,
    with underscores before it if documents have such a column."""
    into = free_name(into, docs.columns)
    spread = free_name("spread", [*docs.columns, into])
    rows = docs.withColumn(into, rendezvous_shard(F.col("doc_id"), weights)).withColumn(spread, F.xxhash64("doc_id", "text"))
    rows.repartitionByRange(into, spread).drop(spread).write.partitionBy(into).option("compression", "zstd").parquet(path)
    return into


def sql(shards: int) -> str:
    """shard_documents with `shards` equal shards and one more as SQL (for small tables: the crc is folded byte by byte)."""
    table = [0] * 256
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table[i] = c

    def best(n: int) -> str:
        u = "((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
        return f"CAST(-list_max(list_transform(range(0, {n}), lambda i: {{'score': 1.0::DOUBLE / -ln({u}), 'less': -i}})).less AS INTEGER)"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, octet_length(encode(t)) + 8 AS size, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, list_extract({table}, (xor(c, x) & 255) + 1))), 4294967295::BIGINT) AS text_crc32 FROM b),
s AS (SELECT *, {best(shards)} AS shard, {best(shards + 1)} AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM s
"""
