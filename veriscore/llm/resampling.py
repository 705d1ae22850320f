"""Importance resampling toward a target text set over hashed word n-grams, with CRC combination algebra.

A feature is a run of 1 to `n` words joined by one space; its bucket is the crc32 of its bytes modulo `buckets`. No such string is
made: a word's crc is taken once, and the crc of a run follows from that of the shorter run: appending b to a gives
crc(a + b) = M^len(b) crc(a) ^ crc(b), where M, a 32 x 32 matrix over GF(2), shifts a crc by one zero byte. Powers M^(2^k) are held as
four byte tables each, so a length is applied to all runs of a slice bit by bit.

Spark counts buckets of all documents and of all target texts (partial counts a task, at most `buckets` rows each), the driver makes
the `buckets` gains of them, a second pass sums gains by document, and the draw (Gumbel top-k by a hash of seed and id) is a
range-dealt ranking of narrow rows: no task holds all scores.

Words: after lower-casing A-Z, runs of digits, a-z and everything beyond ASCII. Null and empty texts have no features, weight 0, and
are never drawn with `least_words` above 0. Null ids hash as an empty id and rank behind others of their score. Repeated rows are
rows of their own. Empty tables give no rows, an empty target the gains of no counts. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, staged
from .segments import slices

_BYTES = np.arange(256)
LOWER = (_BYTES + np.where((_BYTES >= 65) & (_BYTES <= 90), 32, 0)).astype(np.uint8)
IN_WORD = (_BYTES >= 128) | ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122))
SPACE = zlib.crc32(b" ")


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


def by_table(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, held as four byte tables, times each crc."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@lru_cache(maxsize=40)
def shift_tables(k: int) -> np.ndarray:
    """Byte tables of M^(2^k): a crc shifted by 2^k zero bytes."""
    values = (_BYTES.astype(np.uint32)[None] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).astype(np.uint32)
    if k == 0:
        return crc_table()[values & 255] ^ values >> 8
    half = shift_tables(k - 1)
    return by_table(half, by_table(half, values))


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """M^length times crc, element by element."""
    crc = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        rows = np.flatnonzero(lengths >> k & 1)
        crc[rows] = by_table(shift_tables(k), crc[rows])
    return crc


def combined(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of the concatenations of strings with crc a and strings with crc b of the given lengths."""
    return shifted(a, lengths) ^ b


def word_crcs(texts: pa.Array, short: int = 48) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, crc32, length in bytes) of every word of an array of strings, in order; a word's bytes are read once.

    Words of up to `short` bytes are folded side by side, longer ones one by one.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = LOWER[data]
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True  # a word ends with its text
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | breaks))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | breaks))
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    crc, table = np.zeros(len(starts), np.uint32), crc_table()
    begin, sorted_lengths = starts[order], lengths[order]
    long = int(np.searchsorted(-sorted_lengths, -short, "left"))
    for i in order[:long]:
        crc[i] = zlib.crc32(data[starts[i] : ends[i]])
    begin, sorted_lengths, fold = begin[long:], sorted_lengths[long:], np.full(len(order) - long, 0xFFFFFFFF, np.uint32)
    for j in range(int(sorted_lengths.max(initial=0))):
        n = int(np.searchsorted(-sorted_lengths, -j, "left"))
        fold[:n] = table[(fold[:n] ^ data[begin[:n] + j]) & 255] ^ fold[:n] >> 8
    crc[order[long:]] = ~fold
    return np.searchsorted(offsets, starts, "right") - 1, crc, lengths


def features(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, crc32) of all runs of 1 word, of 2, … of n words."""
    row, crc, lengths = word_crcs(texts)
    run = crc
    yield row, run
    for k in range(1, n):
        run = combined(combined(run[:-1], np.uint32(SPACE), np.ones(max(0, len(run) - 1), np.int64)), crc[k:], lengths[k:])
        same = row[k:] == row[: len(run)]
        yield row[: len(run)][same], run[same]


def bucket_counts(rows: DataFrame, text: str, n: int, buckets: int) -> np.ndarray:
    """Features by bucket over all rows; the driver gets at most `buckets` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                for _, crc in features(batch.column(0).slice(a, b - a), n):
                    total += np.bincount(crc % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in rows.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the target's share over the source's), by bucket, each count one more."""
    of, to = int(source.sum()) + len(source), int(target.sum()) + len(target)
    return np.array([math.floor(scale * math.log(float((t + 1) * of) / float((s + 1) * to))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: str, scale: int = 1000) -> int:
    """A Gumbel draw from the first 32 bits of the key's sha256, times scale, rounded down."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, n: int, seed: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of documents (doc_id, text): weight sums the gains of a text's features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                count, weight, words = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for k, (row, crc) in enumerate(features(texts, n)):
                    found = np.bincount(row, minlength=b - a)
                    sums = np.concatenate([[0], np.cumsum(gain[crc % len(gain)])])
                    ends = np.cumsum(found)
                    count, weight = count + found, weight + sums[ends] - sums[ends - found]
                    words = found if k == 0 else words
                drawn = np.array([noise(f"{seed}:{'' if i is None else i}") for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in (count, words, weight, weight + drawn))], names=[c.split()[0] for c in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(weigh, SCORED)


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all documents (doc_id, text): rank, from 1, of the `percent` % with the highest
    scores among those of `least_words` words or more, ties to the smaller doc_id; null of the rest. target: rows with a `text`."""
    gain = gains(bucket_counts(docs, "text", n, buckets), bucket_counts(target, "text", n, buckets))
    rows = staged(scored(docs, gain, n, seed).withColumn("fit", F.col("n_words") >= least_words), "scored")
    quota = rows.where("fit").count() * percent // 100
    placed = positions(rows, "fit", [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features"], "place")
    rank = F.when(F.col("fit") & (F.col("place") < quota), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The drawn documents' own rows, all columns, in no order. Rows of an equal doc_id are drawn together."""
    ids = resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_drawn"]), "left_semi")


def sql(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    """resample over single words as SQL (for small tables; the crc of each distinct word is folded byte by byte)."""
    return rf"""
WITH w AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT row, unnest(ws) AS w FROM w),
v AS (SELECT w, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::BIGINT)) AS bytes FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
c AS (SELECT w, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, list_extract({crc_table().tolist()}, (xor(c, x) & 255) + 1))), 4294967295::BIGINT) % {buckets} AS bucket FROM v),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN c USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN c USING (w) GROUP BY bucket),
g AS (SELECT b.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM dw) + {buckets}) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bw) + {buckets}) AS DOUBLE))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM c) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
k AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN c USING (w) JOIN g USING (bucket) GROUP BY row),
h AS (SELECT w.doc_id, len(w.ws) AS n_features, coalesce(k.weight, 0) AS weight, ('0x' || substr(sha256('{seed}:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN k USING (row)),
r AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM r)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= {least_words} AND place <= (SELECT count(*) FROM r WHERE n_features >= {least_words}) * {percent} // 100 THEN place END AS rank FROM o
"""
