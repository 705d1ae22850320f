"""Per-tab event semantics as Structured Streaming: debounce, calls in flight, order of a batch of model requests, latest state, stale results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, gap: str = "350 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """One row per burst of a tab (tab, ts, url): the last event of each session window."""
    return events.withWatermark("ts", delay).groupBy("tab", F.session_window("ts", gap).alias("w")).agg(F.max_by("url", "ts").alias("url"), F.max("ts").alias("ts"), F.count("*").alias("events")).select("tab", "url", "ts", "events")


def latest_state(events: DataFrame) -> DataFrame:
    """Latest verdict per tab (tab, ts, kind, verdict) in update mode; a close event leaves null."""
    last = events.groupBy("tab").agg(F.max_by(F.struct("kind", "verdict", "ts"), "ts").alias("e"))
    return last.select("tab", F.when(F.col("e.kind") != "close", F.col("e.verdict")).alias("verdict"), F.col("e.ts").alias("ts"))


def block_before_load(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Main-frame requests (tab, frame, url) whose url is on a small static list of dangerous urls."""
    return requests.where("frame = 0").join(verdicts.where("verdict = 'dangerous' AND total >= 85").select("url"), "url", "left_semi")


def unseen(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First sight of each (tab, url) within the watermark: the result cache."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["tab", "url"])


def not_in_flight(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Calls (tab, ts, done, url) that start while no earlier call of the tab runs; those that overlap one are dropped.

    `done` is when a call ends. State is one time per tab, dropped after `delay` without calls.
    """

    idle_ms = int(pd.Timedelta(delay).total_seconds() * 1000)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames).sort_values("ts", kind="stable")
        busy = pd.Timestamp(state.get[0]) if state.exists else pd.Timestamp.min
        kept = []
        for row in rows.itertuples(index=False):
            if row.ts >= busy:
                kept.append(row)
                busy = row.done
        state.update((busy.to_pydatetime(),))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=rows.columns)

    schema = "tab int, ts timestamp, done timestamp, url string"
    return calls.select("tab", "ts", "done", "url").withWatermark("ts", delay).groupBy("tab").applyInPandasWithState(run, schema, "busy timestamp", "append", "EventTimeTimeout")


def queue_order(requests: DataFrame, active: int | None) -> DataFrame:
    """The model queue of one micro-batch (tab, seq, url): per tab only the newest request, the active tab first, then in order of arrival."""
    newest = requests.groupBy("tab").agg(F.max_by(F.struct("seq", "url"), "seq").alias("r"), F.min("seq").alias("_first")).select("tab", "r.seq", "r.url", "_first")
    return newest.orderBy(F.coalesce(F.col("tab") == F.lit(active), F.lit(False)).desc(), "_first").drop("_first")


def current_results(results: DataFrame, requests: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Results (tab, seq, …) that still count: those of the tab's newest request, unless the tab was cancelled at or after it (tab, seq)."""
    latest = requests.groupBy("tab").agg(F.max("seq").alias("_latest"))
    gone = cancelled.groupBy("tab").agg(F.max("seq").alias("_gone"))
    return results.join(latest, "tab").where("seq = _latest").join(gone, "tab", "left").where("_gone IS NULL OR _gone < seq").drop("_latest", "_gone")
