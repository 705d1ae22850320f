"""The result cache of a tab as a keyed stateful stream: the last 32 urls, the one used longest ago goes first.

Looked-up urls (tab, ts, n, url) arrive in micro-batches, ordered by (ts, n) in each; every row comes out with `hit`, whether the url was in its
tab's cache, and is in it afterwards as the one used last. State per tab: at most `size` urls, dropped when the tab was idle for `keep`
of event time. Needs the RocksDB store (model_queue.STORE).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import cached

OUT = "tab int, ts timestamp, n long, url string, hit boolean"


class ResultCache(StatefulProcessor):
    def __init__(self, size: int, keep_ms: int):
        self.step, self.keep_ms = cached(size, "url"), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.urls = handle.getListState("urls", "url string")
        self.idle = handle.getValueState("idle", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "n"], kind="stable")
        held = [u for (u,) in self.urls.get()] if self.urls.exists() else []
        held, hit = self.step(held, frame)
        self.urls.put([(u,) for u in held])
        if self.idle.exists():
            self.handle.deleteTimer(int(self.idle.get()[0]))
        until = max(int(frame["ts"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.keep_ms
        self.idle.update((until,))
        self.handle.registerTimer(until)
        yield frame.assign(tab=key[0], hit=hit)[[c.split()[0] for c in OUT.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.urls.clear()
        self.idle.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in OUT.split(", ")]).astype({"tab": "int32", "ts": "datetime64[ns]", "n": "int64", "url": object, "hit": bool})

    def close(self) -> None:
        pass


def result_cache(lookups: DataFrame, size: int = 32, delay: str = "10 minutes", keep: str = "1 day") -> DataFrame:
    """The stream of (tab, ts, n, url, hit) of lookups (tab, ts, n, url); null urls are never looked up and do not come out."""
    rows = lookups.where("url IS NOT NULL").select(F.col("tab").cast("int"), "ts", F.col("n").cast("long"), "url").withWatermark("ts", delay)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return rows.groupBy("tab").transformWithStateInPandas(ResultCache(size, keep_ms), OUT, "Append", "EventTime")
