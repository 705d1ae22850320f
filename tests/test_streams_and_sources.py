"""Structured Streaming semantics on small file streams, and sources on odd files."""

from datetime import datetime, timedelta

from veriscore.sources.tables import domain_of, feed_rows, json_rows, labelled_pages, latest_wins, with_meta
from veriscore.streaming.tabs import debounced, latest_state, unseen

T0 = datetime(2024, 1, 1)
SCHEMA = "tab int, ts timestamp, kind string, url string, verdict string"


def stream(spark, tmp_path, batches, make, mode):
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = make(src).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return out


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def test_debounce_keeps_the_last_of_a_burst(spark, tmp_path):
    rows = [(1, at(0), "nav", "a", None), (1, at(200), "nav", "b", None), (1, at(400), "nav", "c", None), (1, at(2000), "nav", "d", None)]
    out = stream(spark, tmp_path, [rows, [(9, at(60_000), "nav", "z", None)], [(9, at(120_000), "nav", "y", None)]], debounced, "append")
    assert {(r.tab, r.url, r.events) for r in out} >= {(1, "c", 3), (1, "d", 1)}


def test_latest_state_forgets_closed_tabs(spark, tmp_path):
    out = stream(spark, tmp_path, [[(1, at(0), "nav", "a", "safe"), (2, at(0), "nav", "b", "caution")], [(1, at(5), "close", None, None)]], latest_state, "update")
    state = {r.tab: r.verdict for r in sorted(out, key=lambda r: r.ts)}
    assert state == {1: None, 2: "caution"}


def test_unseen_drops_repeats(spark, tmp_path):
    out = stream(spark, tmp_path, [[(1, at(0), "nav", "a", None), (1, at(1), "nav", "a", None), (2, at(2), "nav", "a", None)]], unseen, "append")
    assert sorted((r.tab, r.url) for r in out) == [(1, "a"), (2, "a")]


def test_sources(spark, tmp_path):
    spark.createDataFrame([("u", "phish", "x" * 60_000), ("v", "0", "y")], "url string, label string, content string").write.parquet(f"{tmp_path}/p")
    assert sorted((r.url, r.label, len(r.html_excerpt)) for r in labelled_pages(spark, f"{tmp_path}/p").collect()) == [("u", 1, 50_000), ("v", 0, 1)]
    (tmp_path / "feed.csv").write_text("網域,Domain\n http://WWW.Bad.tk/x ,\n,www.bad.tk\n,no dot\n,b.example\n", encoding="utf-8-sig")
    assert sorted(r.domain for r in feed_rows(spark, f"{tmp_path}/feed.csv").collect()) == ["b.example", "bad.tk"]
    with_meta(spark.createDataFrame([("u", 1)], "url string, label int"), f"{tmp_path}/m", n=3)
    assert json_rows(spark, f"{tmp_path}/m", "url string, label int").select("url", "label").collect() == [("u", 1)]
    a, b = (spark.createDataFrame([(1, t)], "k int, ts int") for t in (1, 2))
    assert latest_wins(a, b, key="k", order="ts").collect() == [(1, 2)]
    from pyspark.sql import functions as F

    assert [r[0] for r in spark.createDataFrame([("1.2.3.4",), ("a b.c",), ("..x.y..",)], "d string").select(domain_of(F.col("d"))).collect()] == ["1.2.3.4", None, "x.y"]


def test_calls_in_flight_are_not_joined_by_others(spark, tmp_path):
    from veriscore.streaming.tabs import not_in_flight

    rows = [(1, at(0), at(500), "a"), (1, at(300), at(700), "b"), (1, at(500), at(900), "c"), (2, at(100), at(200), "d")]
    spark.createDataFrame(rows, "tab int, ts timestamp, done timestamp, url string").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    src = spark.readStream.schema("tab int, ts timestamp, done timestamp, url string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = []
    q = not_in_flight(src).writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.url for r in out) == ["a", "c", "d"]


def test_queue_and_stale_results(spark):
    from veriscore.streaming.tabs import block_before_load, current_results, queue_order

    requests = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (1, 3, "c"), (3, 4, "d")], "tab int, seq long, url string")
    assert [(r.tab, r.url) for r in queue_order(requests, 3).collect()] == [(3, "d"), (1, "c"), (2, "b")]
    assert [r.tab for r in queue_order(requests, None).collect()] == [1, 2, 3]
    results = spark.createDataFrame([(1, 1, 5), (1, 3, 6), (2, 2, 7), (3, 4, 8)], "tab int, seq long, score int")
    cancelled = spark.createDataFrame([(2, 2)], "tab int, seq long")
    assert sorted(r.score for r in current_results(results, requests, cancelled).collect()) == [6, 8]
    verdicts = spark.createDataFrame([("a", "dangerous", 90), ("b", "safe", 0)], "url string, verdict string, total int")
    assert [r.url for r in block_before_load(spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, "b")], "tab int, frame int, url string"), verdicts).collect()] == ["a"]


def test_one_row_tables_swap_when_whole(spark):
    from veriscore.sources.tables import swapped

    now, bad = spark.createDataFrame([(1, "x")], "version int, bits string"), spark.createDataFrame([(2, None)], "version int, bits string")
    assert swapped(now, bad, ("version", "bits")) is now and swapped(now, None, ("version",)) is now and swapped(bad, now, ("version", "bits")) is now


def test_sinks_and_lists(spark, tmp_path):
    from veriscore.sources.tables import articles, lists_of, ranked_names, write_scores, write_summary

    rows = spark.createDataFrame([("u", 1, 30, "caution", [("a", 25), ("b", 0), ("c", 5)])], "url string, label int, total int, verdict string, sig array<struct<id:string,weight:int>>")
    write_scores(rows, f"{tmp_path}/scores")
    assert spark.read.option("header", True).csv(f"{tmp_path}/scores").first().signals == "a+25|c+5"
    write_summary(spark.createDataFrame([(2,)], "rows int"), f"{tmp_path}/summary", sweep=spark.createDataFrame([(5, 0.5), (10, 0.4)], "threshold int, f1 double"))
    assert [s.threshold for s in spark.read.json(f"{tmp_path}/summary").first().sweep] == [5, 10]
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "popular.json").write_text('{"domains": ["A.com", "b.com"]}')
    assert lists_of(spark, str(tmp_path / "lists"), popular=[], trusted=["c.com"]) == {"popular": ["a.com", "b.com"], "trusted": ["c.com"]}
    (tmp_path / "ranked.csv").write_text("1,B.com\n2,a.com\n3,c.com\n")
    assert [r.domain for r in ranked_names(spark, f"{tmp_path}/ranked.csv", 2).collect()] == ["b.com", "a.com"]
    (tmp_path / "articles.json").write_text('{"articles": [{"id": 1, "category": "x", "title": "t", "content": "<p>a  b</p>"}, {"id": 2, "category": "x", "title": "u", "content": ""}, {"id": 3, "category": "y", "title": "v", "content": "c"}]}')
    assert sorted((r.id, r.body) for r in articles(spark, f"{tmp_path}/articles.json", 1).collect()) == [(1, "a b"), (3, "c")]
    kv = spark.createDataFrame([("A.com", 1, False), ("a.com", 2, False), ("b.com", 3, False), ("b.com", 4, True), ("c.com", 5, False)], "domain string, ts int, gone boolean")
    assert [r.domain for r in latest_wins(kv, key="domain", order="ts", most=2, deleted="gone").collect()] == ["c.com", "a.com"]


def test_models_by_profile_with_one_retry(spark):
    from pyspark.sql import functions as F

    from veriscore.functions.model_stage import http_model, routed

    pages = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "page_id long, prompt string")
    good = '{"risk_score": 9, "verdict": "safe"}'

    def ask(prompt):
        if prompt == "p1":
            raise TimeoutError
        return "broken" if prompt == "p2" else good

    local, builtin = http_model(ask), lambda p: p.select("page_id", F.lit(good.replace("9", "1")).alias("reply"))
    again = lambda p: p.select("page_id", F.when(p.reply.isNotNull(), good.replace("9", "5")).alias("reply"))
    asked = {r.page_id: r.reply for r in routed("pro", local, builtin, again)(pages).collect()}
    assert [asked[i][15:16] for i in (1, 2, 3)] == ["1", "5", "9"]
    assert {r.reply[15:16] for r in routed("lite", local, builtin)(pages).collect()} == {"1"}
