"""The parity audit of signal ids: each check by hand, and the library's own ids over the pages against the oracle."""

import duckdb

from veriscore.operators.parity import parity
from veriscore.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_every_check_by_hand(spark):
    declared = spark.createDataFrame([("a", 5.0), ("b", 0.0), ("gone", 3.0), ("minus", -1.0), ("half", 1.5), ("none", None), ("mark", 0.0), ("twice", 2.0), ("twice", -2.0), (None, 1.0)], "id string, weight double")
    page = spark.createDataFrame([("a", 7), ("a", 2), ("b", 1), ("minus", 1), ("half", 1), ("none", 1), ("extra", 4), ("twice", 1), (None, 9)], "id string, pages long")
    port = spark.createDataFrame([("a", 3), ("minus", 1), ("half", 1), ("none", 1), ("extra2", 4), ("free", 8), ("gone2", 0), ("twice", 1)], "id string, pages long")
    rows = parity(declared, page, port, ("mark", "free")).collect()
    found = {(r.id, r.finding) for r in rows}
    assert found == {
        ("a", ""), ("b", "page_only"), ("gone", "never_emitted"), ("minus", "bad_weight"), ("half", "bad_weight"), ("none", "bad_weight"), ("mark", ""), ("twice", "bad_weight"),
        ("extra", "undeclared_page"), ("extra", "page_only"), ("extra2", "undeclared_eval"), ("extra2", "eval_only"), ("free", ""), ("gone2", ""),
    }
    assert {r.finding for r in rows if r.failed} == {"undeclared_page", "undeclared_eval", "eval_only", "bad_weight"}
    assert {(r.page_pages, r.eval_pages, r.declared) for r in rows if r.id == "a"} == {(9, 3, True)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, pages long")
    assert parity(spark.createDataFrame([], "id string, weight double"), none, none).count() == 0
    assert [r.finding for r in parity(spark.createDataFrame([("a", 1.0)], "id string, weight double"), none, none, ()).collect()] == ["never_emitted"]


def test_own_ids_over_the_pages(spark):
    rows = queries()["q59_signal_parity"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(oracle_sql()["q59_signal_parity"])
    names = [c[0] for c in want.description]
    got = rows.collect()
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got))) == sorted(map(str, want.fetchall()))
    assert sorted(names) == sorted(rows.columns) and not any(r.failed for r in got) and any(r.page_pages for r in got)
