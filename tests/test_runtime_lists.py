"""Blocklists built, merged, stored and read at run time, and the gates' lists as inputs."""

import json

import pytest
from pyspark.sql import functions as F

from veriscore import engine
from veriscore.plans import blocklist as B
from veriscore.sources.tables import lists_of

PAGES = [(1, "https://fake-bank.click/login", "<p>x</p>"), (2, "https://paypa1-secure-login.tk/account", None), (3, "https://www.etax.gov.tw/", ""), (4, "http://www.refund-2025.com/a", "y"), (5, "https://mine.example/login", None), (5, "https://mine.example/login", None), (6, None, None), (7, "https://lib.example-uni.edu/", "z")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "e", "g") for p in PAGES], "page_id int, url string, html string, etld1 string, gate string")


@pytest.fixture(scope="module")
def feed(spark):
    return spark.createDataFrame([("Fake-Bank.click",), ("refund-2025.com",), ("etax.gov.tw",), ("",), (None,), ("fake-bank.click",)], "domain string")


def gates(df):
    return {r.page_id: r.gate for r in df.collect()}


def test_a_feed_in_the_gate(spark, pages, feed, tmp_path):
    """Names of the feed are stopped with their www., look-alikes are not, institutions go first; without it nothing is."""
    B.spec_row(feed).write.parquet(f"{tmp_path}/filters")
    stored = spark.read.parquet(f"{tmp_path}/filters")
    got = gates(engine.judge(pages, "gates", blocklist=stored))
    hit = "url.bloomfilter_blacklist_hit"
    assert got == {1: hit, 2: "", 3: "url.tw_institutional_tld", 4: hit, 5: "", 6: "url.parse_failed", 7: ""}
    assert hit not in gates(engine.judge(pages, "gates")).values()
    scores = {r.page_id: (r.total, r.verdict, r.signals) for r in engine.judge(pages, blocklist=stored).collect()}
    assert scores[1] == (95, "dangerous", hit + "+95") and scores[4][1] == "dangerous" and scores[2][1] != "dangerous"
    assert engine.judge(pages, blocklist=stored).count() == len(PAGES)
    assert engine.judge(pages.where("false"), blocklist=stored).count() == 0


def test_unsound_filters_do_not_count(spark, pages, feed):
    row = B.spec_row(feed)
    newer = B.spec_row(spark.createDataFrame([("mine.example",)], "domain string")).withColumn("version", F.lit(2))
    broken = [row.withColumn("version", F.lit(9)).withColumn(c, v) for c, v in (("hash_family", F.lit("other")), ("fnv_prime", F.lit(3).cast("long")), ("m_bits", F.col("m_bits") + 8), ("bits", F.lit(None).cast("binary")))]
    all_ = row.unionByName(newer)
    for b in broken:
        all_ = all_.unionByName(b)
    assert B.checked_rows(all_).count() == 2
    assert [i for i, g in gates(engine.judge(pages, "gates", blocklist=all_)).items() if "bloom" in g] == [5]
    assert "url.bloomfilter_blacklist_hit" not in gates(engine.judge(pages, "gates", blocklist=broken[0])).values()


def test_parts_of_feeds_merge(spark):
    names = spark.range(3000).select(F.concat(F.lit("site"), "id", F.lit(".example")).alias("domain"))
    bits, hashes = B.sizing(B.planned_names(3000))
    assert bits > B.BITMAP  # several bitmaps
    halves = [B.bitmap_parts(names.where(c), "domain", bits, hashes) for c in ("length(domain) < 14", "length(domain) >= 14")]
    merged, whole = (bytes(B.joined_bits(p, bits).first().bits) for p in (B.merged_parts(*halves), B.bitmap_parts(names, "domain", bits, hashes)))
    want = bytearray(bits // 8)
    for r in names.collect():
        for p in B.positions(r.domain, bits, hashes):
            want[p // 8] |= 128 >> p % 8
    assert merged == whole == bytes(want)
    row = B.spec_row(names).first()
    assert bytes(row.bits) == whole and (row.m_bits, row.k_hashes, row.n_inserted) == (bits, hashes, 3000)
    empty = B.spec_row(names.where("false")).first()
    assert (empty.m_bits, empty.n_inserted) == B.sizing(B.planned_names(0))[:1] + (0,) and not any(empty.bits)


def test_lists_as_inputs(spark, pages, tmp_path):
    (tmp_path / "user.json").write_text(json.dumps({"domains": [" Mine.example", None]}))
    (tmp_path / "institutions.json").write_text(json.dumps({"domains": ["example-uni.edu"]}))
    lists = engine.lists_from(spark, str(tmp_path))
    assert lists["user"] == ["mine.example"] and "google.com" in lists["popular"]
    got = gates(engine.judge(pages, "gates", lists=lists))
    assert got[5] == "url.user_allowlist_hit" and got[7] == "url.tw_allowlist_hit"
    assert gates(engine.judge(pages, "gates", lists={"user": []}))[5] == ""
    with pytest.raises(ValueError, match="no such lists"):
        engine.judge(pages, lists={"friends": []})


def test_a_list_too_long_is_an_error(spark, tmp_path, monkeypatch):
    from veriscore.sources import tables

    monkeypatch.setattr(tables, "MOST_NAMES", 2)
    (tmp_path / "popular.json").write_text(json.dumps({"domains": ["a.com", "b.com", "c.com"]}))
    with pytest.raises(ValueError, match="more than 2 names"):
        lists_of(spark, str(tmp_path), popular=[])
