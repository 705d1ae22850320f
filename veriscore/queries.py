"""All queries of the page-risk library: run on Spark here, the same text is the oracle's."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import run as plan_of
from .functions.homograph import punycode_signals
from .functions.model_output import parse_model_output
from .operators import evaluation, scoring
from .operators.ordered import cached, ordered_fold, started
from .operators.parity import DETECTORS, emitted, oracle, parity
from .plans import corpus, dims
from .plans.blocklist import plan_row, short_list_row, spec_row
from .plans.corpus import SCHEME
from .plans.dialect import Duck, Spark
from .plans.dims import suffix_frame
from .plans.spec import WEIGHTS
from .sources.lookup import looked_up

TEXTS = scoring.QUERIES | evaluation.QUERIES
TABLES = ("pages", "documents", "labels", "events")


#: Bytes of a page's text that a task of the page rules gets, near enough; a page counts as a thousand more, for its url's rules.
SHARE = 8 << 20


def spread(rows: DataFrame, share: int | None = None, of: str = "html") -> DataFrame:
    """rows over all cores where a small input has fewer splits than there are cores; inputs of many files are read as they are.

    With share, no task keeps much more than so many bytes of the column `of`: a split of a few MB can hold thousands of pages where the
    file is well compressed, and a row group is never split. One scan of that column tells what the splits hold.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    least, even = cores, True
    if share:
        held = rows.select(F.spark_partition_id().alias("split"), (F.coalesce(F.octet_length(of), F.lit(0)).cast("long") + 1000).alias("n"))
        total, largest = held.groupBy("split").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.max("n")).first()
        least, even = max(cores, -(-(total or 0) // share)), (largest or 0) <= share
    return rows if even and rows.rdd.getNumPartitions() >= cores else rows.repartition(least)


#: Queries whose blocklist is the feed of the given pages instead of the short fixed list.
FEED = {name for name in TEXTS if name.endswith("_feed")} | {"q40_bloom_audit"}


def dialect(name: str, kind: type[Spark]) -> Spark:
    return kind(feed=evaluation.plain_hosts(kind())) if name in FEED else kind()


def _views(spark: SparkSession, sf_dir: str, text: str, feed: str) -> None:
    for t in TABLES:
        if re.search(rf"\b(FROM|JOIN) {t}\b", text) or feed and t == "pages":
            spread(spark.read.parquet(f"{sf_dir}/{t}.parquet"), SHARE if t == "pages" else None).createOrReplaceTempView(t)
    if "FROM suffixes)" in text:
        suffix_frame(spark).createOrReplaceTempView("suffixes")
    if "FROM bloom_spec)" in text:
        row = plan_row(spec_row(spark.sql(feed), "host")) if feed else short_list_row(spark, dims.BLOCKLIST)
        row.createOrReplaceTempView("bloom_spec")


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = dialect(name, Spark)
        text = TEXTS[name](d)
        _views(spark, sf_dir, text, d.feed)
        return plan_of(text, spark)

    run.__name__ = name
    return run


def q42_llm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies in seven shapes (plain, fenced, truncated, with text around, wrong types, out of range, no JSON), parsed and repaired.

    The replies are stand-ins made from each page's url and html length.
    """
    size = F.length("html")
    good = F.concat(F.lit('{"risk_score": '), F.pmod(size * 37, F.lit(101)).cast("string"), F.lit(', "verdict": "caution", "category": "login", "reasons": ["a", '), F.to_json(F.struct(F.col("url").alias("u"))).substr(F.lit(6), F.length("url") + 20), F.lit(', "need_visual": true}'))
    good = F.replace(good, F.lit('},'), F.lit('],'))
    shapes = {0: good, 1: F.concat(F.lit("```json\n"), good, F.lit("\n```")), 2: F.substring(good, 1, 90), 3: F.concat(F.lit("Sure: "), good, F.lit(" done")), 4: F.lit('{"risk_score": "high", "verdict": "caution"}'), 5: F.lit('{"risk_score": 300, "verdict": "caution", "category": ["x"]}')}
    reply = F.lit("no answer")
    for k, c in shapes.items():
        reply = F.when(size % 7 == k, c).otherwise(reply)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", reply.alias("reply"))
    return parse_model_output(pages, "reply").select("page_id", "parsed.*")


#: Made-up hosts that exercise the label rules; their ids are below zero.
PROBES = ("xn--pypal-4ve.com", "xn--mnchen-3ya.de", "xn--pple-43d.com", "аррӏе.com", "plain.example.com")


def q46_punycode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label signals of the host of every page's own url, and of PROBES as pages -1, -2, ..."""
    rest = F.regexp_extract("url", SCHEME + "([^/?#]*)", 2)
    host = F.lower(F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), ":[0-9]*$", ""))
    probes = spark.createDataFrame([(-i, h) for i, h in enumerate(PROBES, 1)], "page_id long, host string")
    return punycode_signals(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long"), host.alias("host")).unionByName(probes))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, us, props) of the events, us as the plans' texts have it."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(f"WITH {evaluation.events(Spark()).replace('event_type, value', 'event_type, value, props')} SELECT user_id, event_id, us, props FROM ev")


def q43_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day: calls, those started, and the last one started. A call while the user's last started one is under way is dropped."""
    rows = ordered_fold(event_rows(spark, sf_dir).drop("props"), "user_id", ["us", "event_id"], started(evaluation.IN_FLIGHT), "began", "boolean")
    last = F.max_by(F.when(F.col("began"), F.col("event_id")), F.when(F.col("began"), F.struct("us", "event_id")))
    return rows.groupBy("user_id", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.count("*").alias("calls"), F.count_if("began").alias("started"), last.alias("last_started"))


def q45_lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: lookups in a cache of 32 keys that drops the one used longest ago, hits, and keys held at the end. An event's props are its key."""
    rows = ordered_fold(event_rows(spark, sf_dir), "user_id", ["us", "event_id"], cached(evaluation.CACHE, "props"), "hit", "boolean")
    kinds = rows.groupBy("user_id", "props").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))
    return kinds.groupBy("user_id").agg(F.sum("n").alias("lookups"), F.sum("h").alias("hits"), F.least(F.lit(evaluation.CACHE).cast("long"), F.count("props")).alias("held"))


def stand_in(urls: list[str]) -> list[tuple[str, str]]:
    """Stand-in for the external service: threats by parts of a url, several matches a url."""
    return [(u, threat) for u in urls for part, threat in evaluation.EXTERNAL.items() if part in u]


def q34_external_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the threats of its url: distinct urls are looked up in groups, and joined back."""
    spread(spark.read.parquet(f"{sf_dir}/pages.parquet")).createOrReplaceTempView("pages")
    rows = spark.sql(f"WITH {corpus.corpus(Spark())} SELECT page_id, url FROM x")
    found = looked_up(rows, stand_in, per_second=1e6).select("url", "threats")
    return rows.join(found, "url", "left").select("page_id", "url", F.coalesce(F.array_join("threats", "|"), F.lit("")).alias("threats"))


def q59_signal_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared signal ids against those that each detector emits on the pages, with what is wrong about an id."""
    declared = spark.createDataFrame([(k, float(w)) for k, w in WEIGHTS.items()], "id string, weight double")
    sides = []
    for mode in DETECTORS:
        text = emitted(Spark(), mode)
        _views(spark, sf_dir, text, "")
        sides.append(plan_of(text, spark))
    return parity(declared, *sides)


#: Queries that are no SQL text, and the oracle's texts of those that SQL can tell on small tables.
OTHERS = {f.__name__: f for f in (q42_llm_json, q46_punycode, q34_external_join, q43_in_flight, q45_lru_hits, q59_signal_parity)}
ORACLES = {"q34_external_join": f"WITH {corpus.corpus(Duck())} SELECT page_id, url, {evaluation.threats(Duck())} AS threats FROM x", "q43_in_flight": evaluation.in_flight_oracle(), "q45_lru_hits": evaluation.cache_oracle(), "q59_signal_parity": oracle(Duck())}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in TEXTS} | OTHERS


def oracle_sql() -> dict[str, str]:
    """Oracle text by query, each built on its own: one that can't be built is left out."""
    out = dict(ORACLES)
    for name, f in TEXTS.items():
        try:
            out[name] = f(dialect(name, Duck))
        except Exception as e:  # noqa: BLE001 - the others must not be lost with it
            print(f"no oracle text for {name}: {e}")
    return out
