"""The result cache over micro-batches and a restart, against an ordered dict."""

import random
from datetime import datetime, timedelta

from test_model_queue import store  # noqa: F401
from test_ordered_folds import plain_cache

from veriscore.streaming.result_cache import result_cache

SCHEMA = "tab int, ts timestamp, n long, url string"
T0 = datetime(2024, 1, 1)


def run(spark, path, **how):
    out = []
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    q = result_cache(src, **how).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return out


def test_cache_over_micro_batches_and_a_restart(spark, tmp_path, store):  # noqa: F811
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 2]), T0 + timedelta(seconds=i // 3), i, f"u{int(rng.paretovariate(0.5)) % 80}") for i in range(500)]
    out = []
    for k in range(5):
        spark.createDataFrame(rows[100 * k : 100 * k + 100] + [(1, T0, 0, None)] * (k == 0), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if k in (2, 4):
            out += run(spark, tmp_path)
    got = {r.n: r.hit for r in out}
    assert len(out) == 500
    for tab in (1, 2):
        own = [r for r in rows if r[0] == tab]
        assert [got[r[2]] for r in own] == plain_cache([r[3] for r in own], 32)


def test_idle_tabs_are_forgotten(spark, tmp_path, store):  # noqa: F811
    for k, (tab, s) in enumerate([(1, 0), (1, 1), (2, 500), (2, 501), (1, 502)]):
        spark.createDataFrame([(tab, T0 + timedelta(seconds=s), k, "a")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    got = {r.n: r.hit for r in run(spark, tmp_path, delay="1 second", keep="1 minute")}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}
