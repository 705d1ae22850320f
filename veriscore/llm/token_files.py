"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file set is a Parquet folder of self-contained blocks. A block holds whole documents in ascending doc_id order; its ids
are replaced by their rank in the block's own frequency table (most frequent first, ties by id), each rank takes 1 to 4
bytes, and two bits per rank in separate control bytes say how many. So every block can be read alone, on any executor.
Reading is table lookup in numpy: control byte -> four lengths -> byte positions -> ranks -> ids.

Shards are the range partitions by doc_id; within one, blocks follow each other. Start offsets of documents come from the
shards' totals (one row per shard). Null text is empty (only the end id), null doc_id sorts first, equal doc_ids keep
their own rows in text order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text
from .segments import encoder, slices

BLOCK = "shard int, block int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, ranked binary, control binary, data binary"
#: Lengths of the four values of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_PLACES = np.arange(4, dtype=np.uint8)


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ids by falling frequency as uint32, control bytes, data bytes)."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(len(counts), "<u4")
    rank[ranked] = np.arange(len(ranked), dtype="<u4")
    values = rank[ids] if len(ids) else np.zeros(0, "<u4")
    size = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size
    q = padded.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[_PLACES <= size[:, None]]
    return ranked.tobytes(), control.tobytes(), data.tobytes()


def unpack_ids(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids again, as uint32."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    values = np.zeros((n, 4), np.uint8)
    values[_PLACES < size[:, None]] = np.frombuffer(data, np.uint8)
    return np.frombuffer(ranked, "<u4")[values.view("<u4").ravel()]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_tokens: int = 1 << 19) -> None:
    """Encode documents (doc_id, text), end each with end_id, and write the blocks to path, in doc_id order over the shards."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, start
            ids, n = np.concatenate(held), np.concatenate(lengths)
            row = [shard, block, start, len(ids), pa.concat_arrays(doc_ids).to_pylist(), n, *pack_ids(ids)]
            block, start = block + 1, start + len(ids)
            for x in (doc_ids, lengths, held):
                x.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, offsets = encoder(tokenizer).encode(batch.column(1).slice(a, b - a))
                held.append(np.insert(ids, offsets[1:], end_id))
                lengths.append(np.diff(offsets) + 1)
                doc_ids.append(batch.column(0).slice(a, b - a))
                if sum(map(len, held)) >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    ordered = id_text(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, BLOCK).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids (array<int>) if asked for."""
    out = "doc_id long, shard int, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids(row["ranked"], row["control"], row["data"], row["n_tokens"]).astype("<u4", copy=False)
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(crc), row["shard"], np.int32)), pa.array(row["start"] + starts), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in out.split(", ")])

    blocks = spark.read.schema(BLOCK).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per range partition
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = blocks.mapInArrow(read, out).join(F.broadcast(before), "shard")
    return rows.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
