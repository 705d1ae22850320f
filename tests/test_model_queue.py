"""The model queue over micro-batches, with a restart from the checkpoint, against a plain loop; and its timer."""

from datetime import datetime, timedelta

import pytest

from veriscore.streaming.model_queue import STORE, Queue, model_queue

T0 = datetime(2024, 1, 1)
SCHEMA = "client string, ts timestamp, n long, kind string, tab int, seq long, url string, reply string"


def ev(s, kind, tab=None, url=None, seq=None, reply=None, client="c"):
    return (client, T0 + timedelta(seconds=s), 0, kind, tab, seq, url, reply)


def numbered(batches):
    n = 0
    out = []
    for rows in batches:
        out.append([(*r[:2], n := n + 1, *r[3:]) for r in rows])
    return out


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    yield
    spark.conf.set(key, before)


class Run:
    """Micro-batches of one stream, one file each; every call is a start from the same checkpoint."""

    def __init__(self, spark, path, **how):
        self.spark, self.path, self.how, self.files, self.out, self.batches = spark, path, how, 0, [], []

    def __call__(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{self.path}/in/{self.files:03d}")
            self.files += 1
        src = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{self.path}/in")

        def take(df, i):
            self.batches.append(i)
            self.out.extend((i, tuple(r)) for r in df.collect())

        q = model_queue(src, **self.how).writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", f"{self.path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(240) or not q.isActive
        assert q.exception() is None
        return [r for _, r in self.out]


def plain(rows):
    queue, out = {}, []
    for c, _, _, kind, tab, seq, url, reply in rows:
        out += [(c, *r) for r in queue.setdefault(c, Queue()).event(kind, tab, seq, url, reply)]
    return out


def test_queue_over_micro_batches_and_a_restart(spark, tmp_path, store):
    batches = numbered([
        [ev(0, "enqueue", 2, "bg1"), ev(1, "enqueue", 3, "bg2"), ev(0, "enqueue", 1, "other", client="d")],
        [ev(2, "activate", 1), ev(3, "enqueue", 1, "fg"), ev(4, "done", 2, seq=1, reply="r-bg1")],
        [ev(5, "enqueue", 1, "fg again"), ev(6, "enqueue", 3, "bg2 newer"), ev(5, "done", 1, seq=1, reply=None, client="d")],
        [ev(7, "done", 1, seq=1, reply="stale"), ev(8, "done", 9, seq=9, reply="of no request")],
        [ev(9, "cancel", 1), ev(10, "done", 1, seq=2, reply="cancelled in flight")],
        [ev(11, "done", 3, seq=2, reply="r-bg2"), ev(12, "cancel", 5), ev(13, "enqueue", 5, "after cancel"), ev(14, "done", 5, seq=2, reply="r-5")],
    ])
    run = Run(spark, str(tmp_path), limit="1 hour")
    run(*batches[:3])
    got = run(*batches[3:])  # a new start: the queue comes back from the checkpoint
    assert len(set(run.batches)) >= 6
    assert sorted(got, key=str) == sorted(plain([r for b in batches for r in b]), key=str)
    own = [r[1:] for r in got if r[0] == "c"]
    starts = [r[2] for r in own if r[3] == "start"]
    assert starts == ["bg1", "fg", "fg again", "bg2 newer", "after cancel"]  # one at a time, the active tab first
    assert [(r[2], r[4]) for r in own if r[3] == "result"] == [("bg1", "r-bg1"), ("bg2 newer", "r-bg2"), ("after cancel", "r-5")]
    assert {r[2] for r in own if r[3] == "cancelled"} == {"bg2", "fg", "fg again"}
    assert [r[1:] for r in got if r[0] == "d"] == [(1, 1, "other", "start", None), (1, 1, "other", "error", None)]


def test_a_request_without_answer_ends_by_a_timer(spark, tmp_path, store):
    run = Run(spark, str(tmp_path), limit="30 seconds", delay="1 second")
    got = run(*numbered([[ev(0, "enqueue", 1, "hangs"), ev(1, "enqueue", 2, "next")], [ev(100, "enqueue", 1, "x", client="d")], [ev(101, "enqueue", 1, "y", client="d")], [ev(102, "done", 1, seq=1, reply="too late"), ev(103, "done", 2, seq=1, reply="fine")]]))
    assert [r[3:] for r in got if r[0] == "c"] == [("hangs", "start", None), ("hangs", "error", "no answer in time"), ("next", "start", None), ("next", "result", "fine")]


def test_the_queue_alone():
    q = Queue()
    assert q.event("done", 1, 1, None, "nothing runs") == [] == q.event("activate", None, None, None, None)
    assert q.event("cancel", 7, None, None, None) == [] and q.seqs == {7: 1}
    assert q.event("enqueue", 7, None, "a", None) == [(7, 2, "a", "start", None)]
    assert q.event("enqueue", 7, None, "b", None) == [] and q.event("enqueue", 8, None, "c", None) == []
    assert q.event("enqueue", 7, None, "d", None) == [(7, 3, "b", "cancelled", None)]
    assert q.event("done", 7, 2, None, "r") == [(7, 2, "a", "cancelled", None), (8, 1, "c", "start", None)]
    assert q.event("done", 8, 1, None, None) == [(8, 1, "c", "error", None), (7, 4, "d", "start", None)]


def test_an_idle_client_is_forgotten(spark, tmp_path, store):
    run = Run(spark, str(tmp_path), limit="30 seconds", delay="1 second", keep="1 minute")
    got = run(*numbered([[ev(0, "enqueue", 1, "a"), ev(1, "done", 1, seq=1, reply="r")], [ev(300, "cancel", 9, client="d")], [ev(301, "cancel", 9, client="d")], [ev(302, "enqueue", 1, "b")]]))
    assert [r[1:4] for r in got if r[0] == "c"] == [(1, 1, "a"), (1, 1, "a"), (1, 1, "b")]  # the sequence begins anew
