"""Best-fit packing by minimum bin slack.

Only lengths matter to packing, and a sequence of `capacity` tokens knows at most `capacity` of them. So Spark counts the
pieces by length, the search runs over that histogram (bounded by the capacity, whatever the corpus), and Spark deals the
pieces out to the places found:

* per bin, the longest length left is placed, then a subset-sum over a bitset of the lengths available finds the fullest
  combination; it is removed as many times as the counts allow at once, so there are a few combinations per length;
* pieces of a length are numbered without a single-task sort: counts per (length, salt), then a row number in each;
* the number of a piece tells its combination, repetition and place.

Texts over the capacity are cut into pieces, the first may be shorter. Null or empty text: one piece with the end id only.
Repeated rows and null ids are packed as any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, staged
from .segments import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most `capacity` ids of documents (doc_id, text), each text's ids followed by end_id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, offsets = encoder(tokenizer).encode(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                n = np.diff(offsets) + 1
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = n - capacity * (pieces - 1)
                length = np.where(piece == 0, first[row], capacity)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                ends = np.cumsum(length)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=[c.split()[0] for c in PIECES.split(", ")]
                )

    return id_text(docs).mapInArrow(cut, PIECES)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths (each at most as often as counted) with the largest sum within room: bitset subset-sum, longest first."""
    reach, steps, mask = 1, [], (1 << room + 1) - 1
    for n in lengths:
        if n > room:
            continue
        most, taken = min(counts[n], room // n), 1
        while most > 0:  # 1, 2, 4, ... copies at a time
            k = min(taken, most)
            grown = (reach | reach << k * n) & mask
            if grown != reach:
                steps.append((n, k, reach))
                reach = grown
            most, taken = most - k, taken * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            chosen += [n] * k
            total -= k * n
    return chosen


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many times, lengths in one bin), until the histogram is used up."""
    left = {n: c for n, c in histogram.items() if c}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        top = lengths[0]
        left[top] -= 1
        bin_ = [top, *fullest(lengths, left, capacity - top)]
        left[top] += 1
        need = {n: bin_.count(n) for n in set(bin_)}
        times = min(left[n] // k for n, k in need.items())
        out.append((times, bin_))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def salts_for(histogram: dict[int, int], rows: int = 1 << 16) -> int:
    """Parts of each length, so that one of the commonest length holds about `rows` pieces at any input size; 256 at least."""
    return max(256, -(-max(histogram.values(), default=0) // rows))


def best_fit_packing(pieces: DataFrame, capacity: int = 2048, spread: str | None = None) -> DataFrame:
    """pieces (…, length) with sequence_id and offset. `pieces` is read more than once: pass a written table.

    spread: a column, left out of the result, that differs among equal rows, so that many of them are numbered in several tasks.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    first_bin, slots = 0, {}
    for times, bin_ in combinations(histogram, capacity):
        offset = 0
        for n in bin_:
            slots.setdefault(n, []).append((times, first_bin, offset))
            offset += n
        first_bin += times
    # Per length: where each slot's pieces begin in the numbering, its first bin, its offset in the bin.
    places = {n: (np.cumsum([0, *(t for t, _, _ in s)])[:-1], np.array([b for _, b, _ in s]), np.array([o for _, _, o in s])) for n, s in slots.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n, rows in length.groupby(length).indices.items():
            begins, bins, offsets = places[n]
            k = number.to_numpy()[rows]
            slot = np.searchsorted(begins, k, "right") - 1
            sequence[rows], offset[rows] = bins[slot] + k - begins[slot], offsets[slot]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *([spread] if spread else [])), F.lit(salts_for(histogram))).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    numbered = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")))
    keyed = numbered.join(before, ["length", "_salt"])
    placed = keyed.withColumn("_at", place("length", F.col("_before") + F.col("_row") - 1))
    return placed.select(*(c for c in pieces.columns if c != spread), "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    pieces = token_pieces(docs, tokenizer, capacity, end_id).withColumn("_spread", F.spark_partition_id())
    return best_fit_packing(staged(pieces, "pieces"), capacity, "_spread")
