"""The model stage: any function from pages to replies, called for grey-band pages only and merged so that it can only escalate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import DANGEROUS, SAFE
from .model_output import parse_model_output

Model = Callable[[DataFrame], DataFrame]


def fallback(*models: Model) -> Model:
    """The first model's reply where it has one, else the next one's; each takes pages and gives (page_id, reply)."""

    def run(pages: DataFrame) -> DataFrame:
        out = pages.select("page_id")
        for i, m in enumerate(models):
            out = out.join(m(pages).select("page_id", F.col("reply").alias(f"_r{i}")), "page_id", "left")
        return out.select("page_id", F.coalesce(*(f"_r{i}" for i in range(len(models)))).alias("reply"))

    return run


def retried(model: Model, again: Model) -> Model:
    """A model that is asked once more, by `again` (page_id, …, previous reply as `reply`), where its reply is not valid."""

    def run(pages: DataFrame) -> DataFrame:
        first = model(pages).select("page_id", "reply")
        parsed = parse_model_output(first, "reply").select("page_id", "reply", F.col("parsed").isNotNull().alias("_valid"))
        bad = pages.join(parsed.where("NOT _valid").select("page_id", "reply"), "page_id")
        return parsed.where("_valid").select("page_id", "reply").unionByName(again(bad).select("page_id", "reply"))

    return run


def routed(tier: str, local: Model, builtin: Model, retry: Model | None = None) -> Model:
    """Models by profile: pro asks the local one and falls back to the built-in one, lite and auto ask the built-in one alone."""
    models = [local, builtin] if tier == "pro" else [builtin]
    return fallback(*(retried(m, retry) if retry else m for m in models))


def http_model(ask: Callable[[str], str | None], prompt: str = "prompt") -> Model:
    """A model behind a function from prompt to reply (an HTTP client with its own time limit); a failed call has no reply."""

    def run(pages: DataFrame) -> DataFrame:
        def call(batches):
            for batch in batches:
                replies = []
                for text in batch[prompt]:
                    try:
                        replies.append(ask(text))
                    except Exception:  # noqa: BLE001 - no reply, whatever the reason
                        replies.append(None)
                yield batch[["page_id"]].assign(reply=replies)

        return pages.select("page_id", prompt).mapInPandas(call, "page_id long, reply string")

    return run


def with_model(pages: DataFrame, model: Model, force: bool = False) -> DataFrame:
    """pages (page_id, total, …) with llm_score, llm_verdict, final and marker.

    Only totals in the grey band are sent (all with force). A missing or invalid reply leaves the rules' score and marks
    llm.unavailable; a page that was not asked has an empty marker. A score of 0 is kept apart from none.
    """
    asked = pages if force else pages.where(F.col("total").between(SAFE, DANGEROUS - 1))
    replies = parse_model_output(model(asked).select("page_id", "reply"), "reply").select("page_id", F.col("parsed.risk_score").alias("llm_score"), F.col("parsed.verdict").alias("llm_verdict"), F.lit(True).alias("_asked"))
    joined = pages.join(replies, "page_id", "left")
    final = F.greatest("total", F.coalesce("llm_score", F.lit(0)))
    marker = F.when(F.col("_asked").isNull(), "").when(F.col("llm_score").isNull(), "llm.unavailable").otherwise("llm.score")
    return joined.withColumn("final", final).withColumn("marker", marker).drop("_asked")
