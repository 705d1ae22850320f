"""The model queue as a keyed stateful stream: one request of a client runs at a time, the active tab's first, stale results are dropped.

A client's events arrive as rows (client, ts, n, kind, tab, seq, url, reply), in a micro-batch ordered by (ts, n):

* enqueue: the tab's sequence number goes up, its waiting request is cancelled, the new one waits; if nothing runs, the first starts;
* activate: the tab (null: none) is the active one; its waiting request goes before the others;
* cancel: the tab's waiting request is cancelled and its sequence number goes up, so the running one's result will not count;
* done: the model's answer to request (tab, seq), null if it failed. Answers to requests that do not run any more are dropped; one that
  the tab has moved on from is cancelled; then the next waiting request starts.

A request that has no answer after `limit` of event time ends as an error by a timer, and the next one starts. Rows that come out:
(client, tab, seq, url, action, reply), action one of start, result, cancelled, error. A caller sends the started ones to the model and
feeds its answers back as done events.

State per client: the sequence number of each tab, at most one waiting request a tab, the running request, the active tab. A client
without events for `keep` of event time is forgotten by a second timer, unless a request of it runs or waits. Tables of state live in the RocksDB store of Spark, checkpointed to
the query's checkpoint folder; set spark.sql.streaming.stateStore.providerClass to STORE before the query starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "client string, tab int, seq long, url string, action string, reply string"


@dataclass
class Queue:
    """One client's queue. Requests are (tab, seq, url)."""

    seqs: dict[int, int] = field(default_factory=dict)
    waiting: list[tuple[int, int, str]] = field(default_factory=list)
    running: tuple[int, int, str] | None = None
    active: int | None = None
    #: Tabs whose sequence number changed.
    touched: set[int] = field(default_factory=set)

    def bump(self, tab: int) -> int:
        self.seqs[tab] = self.seqs.get(tab, 0) + 1
        self.touched.add(tab)
        return self.seqs[tab]

    def dropped(self, tab: int) -> list[tuple]:
        gone = [r for r in self.waiting if r[0] == tab]
        self.waiting = [r for r in self.waiting if r[0] != tab]
        return [(*r, "cancelled", None) for r in gone]

    def started(self) -> list[tuple]:
        """The next request starts, the active tab's before others, if nothing runs."""
        if self.running or not self.waiting:
            return []
        self.waiting.sort(key=lambda r: r[0] != self.active)
        self.running = self.waiting.pop(0)
        return [(*self.running, "start", None)]

    def event(self, kind: str, tab: int | None, seq: int | None, url: str | None, reply: str | None) -> list[tuple]:
        if kind == "activate":
            self.active = tab
            return []
        if kind == "cancel":
            out = self.dropped(tab)
            self.bump(tab)
            return out
        if kind == "enqueue":
            seq = self.bump(tab)
            out = self.dropped(tab)
            self.waiting.append((tab, seq, url or ""))
            return out + self.started()
        if kind == "done" and self.running and self.running[:2] == (tab, seq):
            return self.ended("error" if reply is None else "result", reply)
        return []

    def ended(self, action: str, reply: str | None) -> list[tuple]:
        """The running request ends; a result counts only if its tab has no later request."""
        tab, seq, url = self.running
        if action == "result" and self.seqs.get(tab, 0) > seq:
            action, reply = "cancelled", None
        self.running = None
        return [(tab, seq, url, action, reply), *self.started()]


class ModelQueue(StatefulProcessor):
    def __init__(self, limit_ms: int, keep_ms: int):
        self.limit_ms, self.keep_ms = limit_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seqs = handle.getMapState("seqs", "tab int", "seq long")
        self.waiting = handle.getListState("waiting", "tab int, seq long, url string")
        self.running = handle.getValueState("running", "tab int, seq long, url string, until long")
        self.active = handle.getValueState("active", "tab int")
        self.idle = handle.getValueState("idle", "until long")

    def loaded(self) -> tuple[Queue, int]:
        running = self.running.get() if self.running.exists() else None
        active = self.active.get()[0] if self.active.exists() else None
        waiting = [(int(t), int(s), u) for t, s, u in self.waiting.get()] if self.waiting.exists() else []
        seqs = {int(k[0]): int(v[0]) for k, v in self.seqs.iterator()}
        return Queue(seqs, waiting, (int(running[0]), int(running[1]), running[2]) if running else None, active), int(running[3]) if running else 0

    def stored(self, queue: Queue, before: tuple | None, until: int, now: int) -> None:
        """Write the queue back; a timer follows the running request."""
        for tab in queue.touched:
            self.seqs.updateValue((tab,), (queue.seqs[tab],))
        if queue.waiting:
            self.waiting.put(queue.waiting)
        else:
            self.waiting.clear()
        if queue.active is None:
            self.active.clear()
        else:
            self.active.update((queue.active,))
        if queue.running != before:
            if before and until:
                self.handle.deleteTimer(until)
            if queue.running:
                until = now + self.limit_ms
                self.running.update((*queue.running, until))
                self.handle.registerTimer(until)
            else:
                self.running.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        queue, until = self.loaded()
        before, out, now = queue.running, [], timerValues.getCurrentWatermarkInMs()
        for row in pd.concat(list(rows)).sort_values(["ts", "n"], kind="stable").itertuples(index=False):
            out += queue.event(row.kind, *(None if pd.isna(v) else f(v) for v, f in ((row.tab, int), (row.seq, int), (row.url, str), (row.reply, str))))
            now = max(now, int(row.ts.timestamp() * 1000))
        self.stored(queue, before, until, now)
        if self.idle.exists():
            self.handle.deleteTimer(int(self.idle.get()[0]))
        self.idle.update((now + self.keep_ms,))
        self.handle.registerTimer(now + self.keep_ms)
        yield frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        queue, until = self.loaded()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        if not queue.running and not queue.waiting and self.idle.exists() and expired == self.idle.get()[0]:
            for state in (self.seqs, self.active, self.idle):
                state.clear()
        if not queue.running or until != expired:
            yield frame(key[0], [])
            return
        before, out = queue.running, queue.ended("error", "no answer in time")
        self.stored(queue, before, 0, timerValues.getCurrentWatermarkInMs())  # the expired timer is gone by itself
        yield frame(key[0], out)

    def close(self) -> None:
        pass


def frame(client: str, rows: list[tuple]) -> pd.DataFrame:
    columns = [c.split()[0] for c in OUT.split(", ")]
    out = pd.DataFrame([(client, *r) for r in rows], columns=columns)
    return out.astype({"client": object, "tab": "int32", "seq": "int64", "url": object, "action": object, "reply": object})


def model_queue(events: DataFrame, limit: str = "60 seconds", delay: str = "10 seconds", keep: str = "1 day") -> DataFrame:
    """The stream of (client, tab, seq, url, action, reply) of a stream of events; rows later than `delay` do not count."""
    from pyspark.sql import functions as F

    rows = events.select(F.col("client").cast("string"), "ts", F.col("n").cast("long"), "kind", F.col("tab").cast("int"), F.col("seq").cast("long"), "url", "reply").withWatermark("ts", delay)
    limit_ms, keep_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (limit, keep))
    return rows.groupBy("client").transformWithStateInPandas(ModelQueue(limit_ms, keep_ms), OUT, "Append", "EventTime")
