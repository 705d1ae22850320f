"""External lookups in groups, and resamples of a confusion matrix against a resample of rows."""

import numpy as np

from veriscore.operators.evaluation import resamples
from veriscore.plans.dialect import Spark
from veriscore.sources.lookup import looked_up


def test_lookup_in_groups_with_one_that_fails(spark):
    urls = [f"http://h{i}.example/" for i in range(23)]
    rows = spark.createDataFrame([(u,) for u in [*urls, *urls[:5], None]], "url string")

    def call(group):
        if len(group) > 4:
            raise ValueError("too many")
        if "http://h7.example/" in group:
            raise OSError("no answer")
        return [(u, t) for u in group if u.endswith("3.example/") for t in ("B", "A", "B")] + [("http://not.asked/", "A")]

    found = {r.url: (r.threats, r.failed) for r in looked_up(rows, call, group=4, per_second=1e6, tasks=2, tries=2).collect()}
    assert set(found) == set(urls)
    failed = {u for u, (t, why) in found.items() if why}
    assert "http://h7.example/" in failed and len(failed) <= 4
    assert all(found[u] == (None, "OSError: no answer") for u in failed)
    assert all(found[u] == (["A", "B"] if u.endswith("3.example/") else [], None) for u in set(urls) - failed)
    assert looked_up(rows.where("false"), call).count() == 0


def test_lookup_calls_again_after_a_failure(spark, tmp_path):
    mark = str(tmp_path / "called")

    def call(group):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("first")
        return [(u, "A") for u in group]

    rows = spark.createDataFrame([("http://a/",)], "url string")
    assert [tuple(r) for r in looked_up(rows, call, per_second=1e6, tasks=1).collect()] == [("http://a/", ["A"], None)]


def drawn(spark, cells, replicates):
    names = ("tp", "fp", "fn", "tn")
    source = "SELECT " + ", ".join(f"CAST({n} AS BIGINT) AS {name}" for n, name in zip(cells, names, strict=True))
    text = f"WITH cells AS ({source}), {resamples(Spark(), 'cells', replicates)} SELECT tp, fp, fn, tn FROM b3"
    return np.array([tuple(r) for r in spark.sql(text).collect()])


def test_resamples_are_as_wide_as_those_of_rows(spark):
    cells, n = (2600, 400, 300, 6700), 4000
    own = drawn(spark, cells, n)
    assert len(own) == n and (own.sum(axis=1) == sum(cells)).all() and (own >= 0).all()
    rows = np.repeat(np.arange(4), cells)
    rng = np.random.default_rng(7)
    plain = np.array([np.bincount(rows[rng.integers(0, len(rows), len(rows))], minlength=4) for _ in range(n)])
    for rate in (lambda c: c[:, 0] / (c[:, 0] + c[:, 1]), lambda c: c[:, 0] / (c[:, 0] + c[:, 2]), lambda c: c[:, 1] / (c[:, 1] + c[:, 3])):
        (a, b), (x, y) = (np.quantile(rate(c), (0.025, 0.975)) for c in (own, plain))
        assert abs((b - a) / (y - x) - 1) < 0.08 and abs(rate(own).mean() - rate(plain).mean()) < 0.001


def test_resamples_of_few_rows(spark):
    assert (drawn(spark, (0, 0, 0, 0), 5) == 0).all()
    assert (drawn(spark, (0, 0, 0, 9), 5) == [0, 0, 0, 9]).all()
    own = drawn(spark, (3, 2, 1, 4), 2000)
    assert (own.sum(axis=1) == 10).all() and np.abs(own.mean(axis=0) - [3, 2, 1, 4]).max() < 0.15
