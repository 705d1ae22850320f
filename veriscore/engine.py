"""The cascade over a user's own pages, lists and blocklist."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .operators.scoring import QUERIES
from .plans import dims
from .plans.blocklist import SPEC, checked_rows, plan_row, short_list_row
from .plans.corpus import LISTS
from .plans.dialect import Spark
from .plans.dims import suffix_frame
from .sources.tables import lists_of

#: What `run` answers, by name: a query over (page_id, url, html).
ANSWERS = {"scores": "q21_cascade", "gates": "q12_gates", "url_scores": "q13_stage1", "evidence": "q24_top4_evidence", "features": "q14_dom_features", "prompts": "q41_prompt", "actions": "q23_anchor_submit"}


def lists_from(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The gates' lists from <folder>/user.json, popular.json, institutions.json; the fixed ones where a file is missing."""
    return lists_of(spark, folder, **{k: list(v) for k, v in LISTS.items()})


def run(text: str, spark: SparkSession) -> DataFrame:
    """The frame of a plan text whose marked levels are views of their own."""
    head, *rest = re.split(r"/\*step (\w+)\*/", text)
    for level, more in zip(rest[::2], rest[1::2]):
        spark.sql(f"{head} SELECT * FROM {level}").createOrReplaceTempView(f"level_{level}")
        head = f"WITH {level} AS (SELECT * FROM level_{level}){more}"
    return spark.sql(head)


def judge(pages: DataFrame, answer: str = "scores", lists: dict[str, list[str]] | None = None, blocklist: DataFrame | None = None) -> DataFrame:
    """ANSWERS[answer] for pages (page_id, url, html).

    lists: names for the gates (`user`, `popular`, `institutions`), the fixed ones where a kind is absent. blocklist: a table of filters
    as blocklist.spec_row makes them; of its sound rows the one of the highest version counts, and if there is none, the short fixed
    list. Null urls and html count as empty; repeated rows are judged each; further columns are not read.
    """
    spark = pages.sparkSession
    unknown = set(lists or {}) - set(LISTS)
    if unknown:
        raise ValueError(f"no such lists: {sorted(unknown)}")
    text = QUERIES[ANSWERS[answer]](Spark(lists=lists, shapes=False))
    pages.select("page_id", "url", "html").createOrReplaceTempView("pages")
    if "FROM suffixes)" in text:
        suffix_frame(spark).createOrReplaceTempView("suffixes")
    if "FROM bloom_spec)" in text:
        # The one row travels through the driver (at most MOST_BITS / 8 bytes): a micro-batch has a session, and views, of its own.
        sound = plan_row(checked_rows(blocklist).orderBy("version", ascending=False).limit(1)).collect() if blocklist is not None else []
        row = spark.createDataFrame(sound, SPEC) if sound else short_list_row(spark, dims.BLOCKLIST)
        row.createOrReplaceTempView("bloom_spec")
    return run(text, spark)
