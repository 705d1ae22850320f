"""Sources and sinks of the evaluation suite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def labelled_pages(spark: SparkSession, path: str, candidates: dict[str, list[str]] | None = None) -> DataFrame:
    """Parquet pages with url, label (0/1) and html cut to 50,000 characters; column names are picked from candidates."""
    df = spark.read.parquet(path)
    names = {"url": ["url", "URL"], "label": ["label", "is_phish"], "html": ["html", "html_content", "content"]} | (candidates or {})
    pick = {k: next((c for c in v if c in df.columns), None) for k, v in names.items()}
    label = F.when(F.col(pick["label"]).cast("string").isin("1", "phish", "phishing", "True", "true"), 1).otherwise(0)
    return df.select(F.col(pick["url"]).alias("url"), label.alias("label"), F.substring(pick["html"], 1, 50_000).alias("html_excerpt"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the leading _meta row."""
    return spark.read.schema(f"{schema}, _meta boolean").json(path).where("_meta IS NULL").drop("_meta")


def feed_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header in any known variant: cells and names trimmed, broken bytes replaced, domain from the first filled column.

    Of each domain the first row in file order counts.
    """
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*(c.strip().lstrip("﻿") for c in df.columns))
    df = df.select(*(F.trim(F.regexp_replace(F.col(f"`{c}`").cast("string"), "\ufeff", "")).alias(c) for c in df.columns))
    known = [c for c in ("網域", "網址", "Domain", "domain") if c in df.columns]
    named = df.withColumn("domain", domain_of(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in known)))).where("domain IS NOT NULL")
    ordered = named.withColumn("_at", F.monotonically_increasing_id())
    columns = [c for c in named.columns if c != "domain"]
    return ordered.groupBy("domain").agg(*(F.min_by(c, "_at").alias(c) for c in columns)).select(*named.columns)


#: Most names of a list that becomes part of a plan; larger ones belong in a filter (plans.blocklist).
MOST_NAMES = 100_000


def lists_of(spark: SparkSession, folder: str, **defaults: list[str]) -> dict[str, list[str]]:
    """Small lists (brands, allow-lists, providers) from <folder>/<name>.json, {"domains": [...]}; the default where a file is missing.
    A list of more than MOST_NAMES names is an error."""
    from pyspark.errors import AnalysisException

    out = {}
    for name, default in defaults.items():
        try:
            names = spark.read.schema("domains array<string>").option("multiLine", True).json(f"{folder}/{name}.json").select(F.explode("domains").alias("d")).where("d IS NOT NULL")
        except AnalysisException:
            out[name] = list(default)
            continue
        rows = names.limit(MOST_NAMES + 1).collect()
        if len(rows) > MOST_NAMES:
            raise ValueError(f"{folder}/{name}.json has more than {MOST_NAMES} names")
        out[name] = [r.d.strip().lower() for r in rows]
    return out


def domain_of(c: Column) -> Column:
    """Host of a url or bare name: lower case, without www., null if it is no name."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c, F.lit(" ."))), r"^[a-z][a-z0-9+.-]*://([^/?#:]*).*$", "$1"), r"^www\.", "")
    return F.when(host.contains(".") & ~host.rlike(r"[\s/@?]"), host)


def ranked_names(spark: SparkSession, path: str, most: int) -> DataFrame:
    """The first `most` names of a rank,name CSV; an error if fewer than half are there."""
    df = spark.read.schema("rank int, domain string").csv(path).where("domain IS NOT NULL").select("rank", F.lower("domain").alias("domain")).orderBy("rank").limit(most)
    if df.count() * 2 < most:
        raise ValueError("the list is too short")
    return df


def articles(spark: SparkSession, path: str, per_category: int) -> DataFrame:
    """First rows per category of a nested article file; bodies without tags, at most 6,000 characters."""
    rows = spark.read.option("multiLine", True).json(path).select(F.posexplode("articles")).select("pos", "col.*")
    plain = F.trim(F.regexp_replace(F.regexp_replace("content", "<[^>]+>", " "), r"\s+", " "))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("category").orderBy("pos"))).where(F.col("_rn") <= per_category)
    return ranked.select("id", "category", "title", F.substring(plain, 1, 6000).alias("body"))


def write_scores(df: DataFrame, path: str) -> None:
    """CSV of scored pages (url, label, total, verdict, sig): signals with weight as id+weight, joined by |."""
    signals = F.array_join(F.transform(F.filter("sig", lambda e: e["weight"] > 0), lambda e: F.concat(e["id"], F.lit("+"), e["weight"].cast("string"))), "|")
    df.select("url", "label", F.col("total").alias("score"), "verdict", signals.alias("signals")).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str, **nested: DataFrame) -> None:
    """One JSON object: the columns of the one-row df, and each nested frame as an array of objects (metrics: a few rows each)."""
    out = df
    for name, rows in nested.items():
        out = out.crossJoin(rows.agg(F.collect_list(F.struct("*")).alias(name)))  # one row by one row
    out.coalesce(1).write.mode("overwrite").json(path)


def with_meta(rows: DataFrame, path: str, **meta: int) -> None:
    """JSON lines with a first _meta row in a file of its own."""
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit(True).alias("_meta"), *(F.lit(v).alias(k) for k, v in meta.items()))
    head.write.mode("overwrite").json(f"{path}/kind=meta")
    rows.write.mode("overwrite").json(f"{path}/kind=rows")


def latest_wins(*batches: DataFrame, key: str, order: str, most: int | None = None, deleted: str | None = None) -> DataFrame:
    """A small store: later rows replace earlier ones of the same key (compared in lower case), rows whose `deleted` column is true remove it.

    With `most`, the newest that many rows are kept.
    """
    rows = reduce(DataFrame.unionByName, batches)
    key_value = F.lower(key) if dict(rows.dtypes)[key] == "string" else F.col(key)
    last = rows.groupBy(key_value.alias("_key")).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    if dict(rows.dtypes)[key] == "string":
        last = last.withColumn(key, F.lower(key))
    if deleted:
        last = last.where(~F.coalesce(F.col(deleted), F.lit(False)))
    return last.orderBy(F.desc(order)).limit(most) if most else last


def swapped(current: DataFrame, fresh: DataFrame | None, fields: tuple[str, ...]) -> DataFrame:
    """The refreshed one-row table if it came and every field is there and filled, else the current one."""
    if fresh is None or any(f not in fresh.columns for f in fields):
        return current
    row = fresh.limit(2).collect()  # one row by contract
    return fresh if len(row) == 1 and all(row[0][f] is not None for f in fields) else current
