"""Shared helpers of the training-data operators: shared folder, staged tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a local session without one, whose executors are the driver, gets one beside its warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write df once as Parquet (with options of the writer) in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(schema).parquet(path)


#: A key with more than one in HOT of all rows is hot; there are fewer than HOT such keys.
HOT = 200


def joined_split(left: DataFrame, right: DataFrame, on: list[str], rows: Column, total: int) -> DataFrame:
    """Inner join on keys of which a few may hold a large share of left: right's hot keys are broadcast (fewer than HOT rows, by
    `rows`, the number of left's rows a key of right has), the rest is shuffled. right has one row per key; left is read twice."""
    hot = right.where(rows * HOT > total)
    cold = right.where(~(rows * HOT > total))
    return left.join(F.broadcast(hot), on).unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The columns doc_id, as long, and text, as string, whatever integer or text type documents have."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def by_bytes(texts: list[str], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts whose summed length stays near `most`, so a few long texts do not share a batch."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores before it as it takes to differ (in any case) from the names taken."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def positions(rows: DataFrame, group: str, order: list[Column | str], name: str) -> DataFrame:
    """rows with `name`, their place in their group (a column) in the given order, gapless from 0; equal rows in any order.

    rows is read more than once: pass a written table of few columns. They are dealt out by range and sorted there; no task holds a
    group, also of equal rows, and the parts' counts (at most partitions + groups rows) are all that is broadcast.
    """
    every = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [F.col(group), *order, "_row"]
    dealt = every.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id())
    dealt = staged(dealt, "dealt").withColumn("_part", F.shiftright("_at", 33))
    runs = dealt.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    runs = runs.select("_part", group, (before - F.col("_first")).alias("_shift"))
    return dealt.join(F.broadcast(runs), ["_part", group]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
