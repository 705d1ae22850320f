"""Vector code compression: one codebook for each part of the vectors, fitted by Yinyang Lloyd in integers.

A component x becomes floor(scale * x). Codebook entries are put into groups once; every part of a vector keeps its entry and one lower
bound a group for the distances to the group's other entries. When entries have moved, a bound less the largest move of its group
still holds, and only groups whose bound does not exceed the (exact) distance to the own entry are scanned. Distances are scanned in
floats; entries within rounding of the nearest are compared in integers, ties go to the lower index, so the codes are those of a
plain integer Lloyd.

Spark holds the vectors: each round reads the last round's written table of (vector, code, bounds), writes the next, and sums
components by (part, entry) with partial sums a task. The driver sees the codebooks only (entries x components, whatever the table's size).

Dropped, besides null vectors and those with a null or non-finite component: vectors of another length than that of the smallest kept
vec_id and lengths that the parts don't divide. |scale * x| must stay below 2^26, so that squared errors fit a long; else an
error names it. Equal vec_ids are vectors of their own (as first entries in the order of their components); null ids come last.
Fewer vectors than entries make smaller codebooks; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_split, staged

STATE = "vec_id long, label string, x binary, code binary, lower binary"
MOST = 1 << 26


def groups_of(book: np.ndarray, size: int = 10, rounds: int = 5) -> list[np.ndarray]:
    """Ascending entry numbers of each group: the entries clustered by a few rounds of plain k-means, about `size` a group."""
    centers = book[:: max(1, size)].astype(float)
    for _ in range(rounds):
        near = ((book[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.array([book[near == g].mean(0) if (near == g).any() else centers[g] for g in range(len(centers))])
    near = ((book[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
    return [np.flatnonzero(near == g) for g in range(len(centers)) if (near == g).any()]


def squares(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows to entries in floats, and each row's bound of their rounding error."""
    xf, bf = x.astype(float), book.astype(float)
    xx, bb = (xf * xf).sum(1), (bf * bf).sum(1)
    return xx[:, None] + bb[None] - 2 * (xf @ bf.T), (xx + bb.max(initial=0)) * 1e-13


def exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x - entries) ** 2).sum(1)


def nearest(x: np.ndarray, book: np.ndarray, d: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Index of the nearest entry by float distances d; those within slack of the least are compared in integers, ties to the lower."""
    near = d <= (d.min(1) + 2 * slack)[:, None]
    best = near.argmax(1)
    for r in np.array_split(rows := np.flatnonzero(near.sum(1) > 1), max(1, len(rows) // 4096)):
        if len(r):
            whole = ((x[r][:, None, :] - book[None]) ** 2).sum(2)
            best[r] = np.where(near[r], whole, np.iinfo(np.int64).max).argmin(1)
    return best


def bound(d2: np.ndarray, slack: np.ndarray | float = 0.0) -> np.ndarray:
    """Lower bounds of distances as 16-bit integers, rounded down and cut at 65,535: lower is still a bound."""
    return np.minimum(np.sqrt(np.maximum(d2 - slack, 0)) * (1 - 1e-12), 65535).astype(np.uint16)


def first_scan(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, lower bound by group) of each row, all entries scanned."""
    d, slack = squares(x, book)
    code = nearest(x, book, d, slack)
    d[np.arange(len(x)), code] = np.inf
    return code, np.stack([bound(d[:, g].min(1), slack) for g in groups], 1)


def bounded_scan(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], moved: np.ndarray, code: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The next (entry, bounds) from the last ones after entries moved by at most `moved`, and how many distances were taken."""
    drift = np.array([np.ceil(moved[g].max() + 1e-6) for g in groups]).astype(np.int64)
    lower = np.maximum(lower.astype(np.int64) - drift, 0)
    code, own = code.copy(), exact(x, book[code])
    started, taken = own.copy(), len(x)
    group = np.empty(len(book), np.int64)
    for k, g in enumerate(groups):
        group[g] = k
    old, old_group = code.copy(), group[code]
    for k, g in enumerate(groups):
        rows = np.flatnonzero(lower[:, k] ** 2 <= started)
        if not len(rows):
            continue
        taken += len(rows) * len(g)
        d, slack = squares(x[rows], book[g])
        d[old[rows][:, None] == g[None]] = np.inf  # the own entry is known
        some = np.isfinite(d.min(1))
        lower[rows, k] = bound(d.min(1), slack)
        rows, d, slack = rows[some], d[some], slack[some]
        if not len(rows):
            continue
        found = g[nearest(x[rows], book[g], d, slack)]
        far = exact(x[rows], book[found])
        better = (far < own[rows]) | ((far == own[rows]) & (found < code[rows]))
        code[rows[better]], own[rows[better]] = found[better], far[better]
    left = np.flatnonzero(code != old)  # the entry left behind is one of its group's others now
    lower[left, old_group[left]] = np.minimum(lower[left, old_group[left]], bound(started[left].astype(float)))
    return code, lower.astype(np.uint16), taken


class Codebooks:
    """entries: integers of shape (parts, entries, components); groups: of each part, fixed by the first entries."""

    def __init__(self, entries: np.ndarray, groups: list[list[np.ndarray]] | None = None, moved: np.ndarray | None = None):
        self.entries, self.moved = entries, moved
        self.groups = groups if groups is not None else [groups_of(b) for b in entries]

    def next(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries as floor(sum / count); those without parts stay."""
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        return Codebooks(new, self.groups, np.sqrt(((new - self.entries).astype(float) ** 2).sum(2)))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept_vectors(vectors: DataFrame, parts: int) -> DataFrame:
    """(vec_id, label, embedding) of usable vectors."""

    def sound(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & F.forall("embedding", sound))


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, width)
    if len(x) and np.abs(x).max() >= MOST:
        raise ValueError(f"a component times {scale} is {MOST} or more")
    return x.astype(np.int32)


def column_bytes(batch: pa.RecordBatch, name: str, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, width)


def packed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def scan_batch(batch: pa.RecordBatch, books: Codebooks, scale: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(components, codes, bounds by part) of a batch, from vectors or from the last round's state."""
    parts, _, width = books.entries.shape
    fresh = "embedding" in batch.schema.names
    x = integers(batch.column("embedding"), parts * width, scale) if fresh else column_bytes(batch, "x", "<i4", parts * width)
    codes, bounds = np.zeros((len(x), parts), np.int64), []
    if not fresh:
        before, lower = column_bytes(batch, "code", "u1", parts), column_bytes(batch, "lower", "<u2", sum(map(len, books.groups)))
    at = 0
    for p, (book, groups) in enumerate(zip(books.entries, books.groups)):
        part = x[:, p * width : (p + 1) * width].astype(np.int64)
        if fresh:
            codes[:, p], low = first_scan(part, book, groups)
        else:
            codes[:, p], low, _ = bounded_scan(part, book, groups, books.moved[p], before[:, p].astype(np.int64), lower[:, at : at + len(groups)])
        at += len(groups)
        bounds.append(low)
    return x, codes, bounds


def assigned(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """State of each vector under the codebooks: its integers, code and bounds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, codes, bounds = scan_batch(batch, books, scale)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), packed(x.astype("<i4")), packed(codes.astype("u1")), packed(np.concatenate(bounds, 1).astype("<u2"))], names=[c.split()[0] for c in STATE.split(", ")]
                )

    return rows.mapInArrow(scan, STATE)


def coded(rows: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """(vec_id, label, code, error) under the last codebooks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, codes, _ = scan_batch(batch, books, scale)
                chosen = books.entries[np.arange(len(books.entries))[None], codes].reshape(x.shape)
                error = ((x - chosen) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed(codes.astype("u1")), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(scan, "vec_id long, label string, code binary, error long")


def totals(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and counts by (part, entry) over all vectors: partial sums a task, added up by Spark."""
    parts, entries, width = shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = column_bytes(batch, "x", "<i4", parts * width).astype(np.int64).reshape(-1, width)
                key = (column_bytes(batch, "code", "u1", parts).astype(np.int64) + np.arange(parts) * entries).ravel()
                counts += np.bincount(key, minlength=len(counts))
                order = np.argsort(key, kind="stable")
                used, first = np.unique(key[order], return_index=True)
                sums[used] += np.add.reduceat(x[order], first, axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array(sums[used].ravel()), pa.array(np.repeat(counts[used], width))], names=["entry", "at", "total", "n"])

    rows = state.select("x", "code").mapInArrow(partial, "entry long, at long, total long, n long").groupBy("entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    for r in rows:
        sums[r["entry"], r["at"]], counts[r["entry"]] = r["total"], r["n"]
    return sums.reshape(shape), counts.reshape(parts, entries)


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of vectors (vec_id, label, embedding), code one byte a part, and the codebooks (None of no vectors).

    At most 256 entries; the first ones are the parts of the vectors with the smallest ids.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries: a code is one byte a part")
    kept = kept_vectors(vectors, parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
    seeds = [r["embedding"] for r in first.select("embedding").collect()]
    if not seeds:
        return kept.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    size = len(seeds[0])
    kept = kept.where(F.size("embedding") == size)
    if any(len(s) != size for s in seeds):
        seeds = [r["embedding"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()]
    start = integers(pa.array(seeds, pa.list_(pa.float64())), size, scale).astype(np.int64)
    books = Codebooks(start.reshape(len(seeds), parts, size // parts).transpose(1, 0, 2).copy())
    rows = kept
    for _ in range(rounds):
        rows = staged(assigned(rows, books, scale), "codes-round")
        books = books.next(*totals(rows, books.entries.shape))
    return staged(coded(rows, books, scale), "codes"), books


def with_label_error(codes: DataFrame, by: str = "label") -> DataFrame:
    """codes (a written table) with label_error: `error` summed over rows of an equal label, nulls together."""
    named = codes.withColumn("_none", F.col(by).isNull()).withColumn("_key", F.coalesce(by, F.lit("")))
    sums = named.groupBy("_none", "_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    return joined_split(named, staged(sums, "label-errors"), ["_none", "_key"], F.col("_n"), codes.count()).select(*codes.columns, "label_error")


def reconstruct(codes: DataFrame, books: Codebooks, scale: int = 256) -> DataFrame:
    """(vec_id, embedding) as the codebooks give it back: the middle of each integer's range."""
    middle: Callable[[np.ndarray], np.ndarray] = lambda whole: ((whole + 0.5) / scale).astype(np.float32)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.entries.shape
        for batch in batches:
            codes_ = column_bytes(batch, "code", "u1", parts).astype(np.int64)
            x = middle(books.entries[np.arange(parts)[None], codes_].reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, parts * width), pa.int32()), pa.array(x))], names=["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(back, "vec_id long, embedding array<float>")


def sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The codes by plain integer Lloyd as SQL (all distances; for small tables of vectors of one length)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT x.vec_id, x.row, x.label, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS dist FROM x JOIN b{r} b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL)")
        steps.append(f"a{r} AS (SELECT row, part, min_by(entry, dist * 1024 + entry) AS entry, min(dist) AS dist FROM d{r} GROUP BY ALL)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT a.part, a.entry, x.pos, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM a{r} a JOIN x ON x.row = a.row AND x.part = a.part GROUP BY ALL)")
            steps.append(f"b{r + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)")
    return f"""
WITH k AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
f AS (SELECT vec_id, row, label, len(embedding) // {parts} AS w, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS e FROM k),
x AS (SELECT vec_id, row, label, i // w AS part, i % w AS pos, CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT) AS v FROM f),
b0 AS (SELECT part, row AS entry, pos, v FROM x WHERE row < {entries}),
{", ".join(steps)},
c AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY row)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN k USING (row)
"""
