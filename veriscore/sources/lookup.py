"""Lookups of urls in an external service: distinct urls, in groups, at a bounded rate, one call a group."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A call: urls -> matches (url, threat), several or none a url; raises where the service fails.
Call = Callable[[list[str]], list[tuple[str, str]]]
OUT = "url string, threats array<string>, failed string"


def looked_up(rows: DataFrame, call: Call, group: int = 500, per_second: float = 2.0, tasks: int = 4, tries: int = 2) -> DataFrame:
    """(url, threats, failed) of the distinct urls of rows (url): their threats, each once and in order, or why their group's call failed.

    Urls go to `tasks` tasks, which share the rate of `per_second` calls; each calls for at most `group` urls at a time, and again, up to `tries`
    times, after a failure. A group that fails keeps null threats and its reason; others are not touched by it. Matches of urls that were
    not asked for are dropped. A lost task asks for its urls again: write the result before it is used twice.
    """
    pause = tasks / per_second

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        free = 0.0

        def answer(urls: list[str]) -> pd.DataFrame:
            nonlocal free
            reason = None
            for _ in range(tries):
                if (wait := free - time.monotonic()) > 0:
                    time.sleep(wait)
                free = time.monotonic() + pause
                try:
                    found: dict[str, set[str]] = {u: set() for u in urls}
                    for url, threat in call(urls):
                        if url in found:
                            found[url].add(threat)
                    return pd.DataFrame([(u, sorted(t), None) for u, t in found.items()], columns=["url", "threats", "failed"])
                except Exception as e:  # noqa: BLE001 - whatever the service does is told of its group
                    reason = f"{type(e).__name__}: {e}"[:300]
            return pd.DataFrame([(u, None, reason) for u in urls], columns=["url", "threats", "failed"])

        for frame in frames:
            held += frame["url"].tolist()
            while len(held) >= group:
                yield answer(held[:group])
                held = held[group:]
        if held:
            yield answer(held)

    distinct = rows.select("url").where(F.col("url").isNotNull()).distinct()
    return distinct.repartition(tasks, "url").mapInPandas(ask, OUT)
