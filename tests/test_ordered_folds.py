"""Folds in order over parts of a group, against plain loops: calls in flight and a bounded cache, in batch and as streams."""

import random
from collections import OrderedDict

import duckdb
import pytest

from veriscore.operators import evaluation, ordered
from veriscore.operators.ordered import cached, ordered_fold, started
from veriscore.queries import oracle_sql, queries

MINUTE = 60_000_000


def plain_started(rows, seconds):
    last, out = {}, {}
    for user, us, e in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if user not in last or us - last[user] >= seconds * 1_000_000:
            last[user] = us
            out[user, e] = True
        else:
            out[user, e] = False
    return out


def got(df):
    return {(r.user_id, r.event_id): r.began for r in df.collect()}


def test_in_flight_across_midnight(spark):
    day = 24 * 60 * MINUTE
    rows = [(1, day - 2 * MINUTE, 1), (1, day + 1 * MINUTE, 2), (1, day + 8 * MINUTE, 3), (2, day, 1), (None, day, 1), (None, day + 1, 2)]
    df = spark.createDataFrame(rows, "user_id long, us long, event_id long")
    for size in (1, 2, 100):
        assert got(ordered_fold(df, "user_id", ["us", "event_id"], started(600), "began", "boolean", rows_a_part=size)) == plain_started(rows, 600) == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): True, (None, 1): True, (None, 2): False}
    assert ordered_fold(df.where("false"), "user_id", ["us", "event_id"], started(600), "began", "boolean").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_in_flight_in_small_parts(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), rng.randrange(40 * 60) * 1_000_000, e) for e in range(600)]
    df = spark.createDataFrame(rows, "user_id long, us long, event_id long").repartition(7)
    assert got(ordered_fold(df, "user_id", ["us", "event_id"], started(97), "began", "boolean", rows_a_part=20)) == plain_started(rows, 97)


def test_a_user_of_a_million_events(spark):
    """One user, one event about every three seconds without a gap; parts of 2^16 rows."""
    df = spark.range(1_000_000).selectExpr("7L AS user_id", "id * 3000000L + pmod(xxhash64(id), 3000000L) AS us", "id AS event_id")
    out = ordered_fold(df, "user_id", ["us", "event_id"], started(600), "began", "boolean", rows_a_part=1 << 16).where("began").select("us").orderBy("us").toPandas()["us"].tolist()
    us = df.select("us").orderBy("us").toPandas()["us"].tolist()
    want, last = [], None
    for t in us:
        if last is None or t - last >= 600_000_000:
            want.append(last := t)
    assert out == want


def plain_cache(keys, size):
    held, out = OrderedDict(), []
    for k in keys:
        out.append(k in held)
        held[k] = None
        held.move_to_end(k)
        if len(held) > size:
            held.popitem(last=False)
    return out


def test_cache_in_small_parts(spark):
    rng = random.Random(4)
    rows = [(u, i, f"u{int(rng.paretovariate(0.6)) % 60}") for u in (1, 2) for i in range(700 if u == 1 else 30)] + [(1, 700, None), (1, 701, None)]
    df = spark.createDataFrame(rows, "user_id long, at long, url string").repartition(5)
    hits = {(r.user_id, r["at"]): r.hit for r in ordered_fold(df, "user_id", ["at"], cached(32), "hit", "boolean", rows_a_part=50).collect()}
    for u in (1, 2):
        own = [r for r in rows if r[0] == u]
        assert [hits[u, r[1]] for r in own] == plain_cache([r[2] for r in own], 32)
    assert any(hits.values()) and not all(hits.values())


@pytest.mark.parametrize("name", ["q43_in_flight", "q45_lru_hits"])
def test_queries_equal_their_sql(spark, name, monkeypatch):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    answer = con.execute(oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    want = sorted(answer.fetchall(), key=str)
    assert want == sorted(map(tuple, queries()[name](spark, sf).select(columns).collect()), key=str)
    assert evaluation.IN_FLIGHT == 600 and ordered
