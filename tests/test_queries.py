"""Every page-risk query against its oracle text in DuckDB, and edge cases of the functions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from veriscore.functions.homograph import decode_label, label_signals
from veriscore.functions.model_output import validated
from veriscore.queries import ORACLES, SHARE, TEXTS, oracle_sql, queries, spread

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("pages", "documents", "labels", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(TEXTS | ORACLES))
def test_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    own = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    rel = duck.execute(oracle_sql()[name])
    columns = [x[0] for x in rel.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(df.columns)
    assert own == sorted(map(repr, (tuple(r[i] for i in order) for r in rel.fetchall())))
    assert own


def test_no_task_holds_more_pages_than_its_share(spark, tmp_path):
    """Well-compressed files of pages: few bytes in few splits, much text; small inputs still meet all cores."""
    html = "<p>word</p>" * 3000
    spark.range(2000).selectExpr("id AS page_id", "concat('https://example.org/', id) AS url", f"'{html}' AS html").repartition(8).write.parquet(f"{tmp_path}/pages.parquet")
    queries()["q27_sweep_coarse"](spark, str(tmp_path))
    held = spark.table("pages").groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in held) == 2000 and spark.table("pages").select("page_id").distinct().count() == 2000
    assert max(r.bytes for r in held) <= SHARE * 1.3 and sum(r.bytes for r in held) > 6 * SHARE
    few = spark.createDataFrame([(1, None), (2, "<p>")], "page_id long, html string").coalesce(1)
    assert spread(few, SHARE).rdd.getNumPartitions() == spread(few).rdd.getNumPartitions() == 4 and spread(few.limit(0), SHARE).count() == 0


def test_model_output():
    assert validated('x {"risk_score": 7, "verdict": "safe", "category": "a"} y')["risk_score"] == 7
    assert validated('{"risk_score": 7, "verdict": "safe", "category": "a", "reasons": ["b", "c')["reasons"] == ["b", "c"]
    assert validated('{"risk_score": 700, "verdict": "safe"}') is None and validated(None) is None and validated("") is None
    assert validated("```json\n{\"risk_score\": 1, \"verdict\": \"safe\"}\n```")["category"] == ["other"]


def test_homographs():
    assert decode_label("xn--mnchen-3ya") == "münchen" and decode_label("xn--\xff") == "xn--\xff"
    assert label_signals("xn--pple-43d.com") == ["url.punycode_label", "url.punycode_brand_lookalike"]
    assert label_signals("pаypal.com") == ["url.mixed_script_label"] and label_signals(None) == label_signals("") == []


def test_python_queries(spark):
    assert queries()["q42_llm_json"](spark, SF).where("risk_score IS NOT NULL").count() > 0
    assert queries()["q46_punycode"](spark, SF).count() > 0


def test_emitted_signals_are_declared():
    from veriscore.plans import corpus
    from veriscore.plans.dialect import Spark
    from veriscore.plans.spec import DOM_SIGNALS, URL_SIGNALS, WEIGHTS, weight

    before, after = corpus.url_rules(Spark())
    emitted = {r[0] for r in before + after + corpus.dom_rules(Spark())}
    labels, gates = {k for k in WEIGHTS if k in corpus.label_signals(Spark())}, {"url.bloomfilter_blacklist_hit"}
    assert emitted <= set(WEIGHTS) and len(URL_SIGNALS) + len(DOM_SIGNALS) == 29 + 21
    assert set(URL_SIGNALS) | set(DOM_SIGNALS) == (emitted - {"dom.oauth_idp_allowlisted"}) | labels | gates
    with pytest.raises(KeyError):
        weight("url.unknown")


def test_oracle_texts_need_no_jars(monkeypatch):
    import pyspark

    from veriscore.plans import dims

    monkeypatch.setattr(pyspark, "__file__", "/nowhere/pyspark/__init__.py")
    dims.public_suffixes.cache_clear()
    assert set(oracle_sql()) == set(TEXTS) | set(ORACLES)


def test_model_stage(spark):
    from pyspark.sql import functions as F

    from veriscore.functions.model_stage import fallback, with_model

    pages = spark.createDataFrame([(1, 10), (2, 30), (3, 60), (4, 90), (5, 40)], "page_id long, total int")
    good = F.concat(F.lit('{"risk_score": '), (F.col("page_id") * 20).cast("string"), F.lit(', "verdict": "caution"}'))
    first = lambda p: p.where("page_id = 3").select("page_id", F.lit("nonsense").alias("reply"))
    second = lambda p: p.where("page_id < 5").select("page_id", good.alias("reply"))
    rows = {r.page_id: (r.llm_score, r.final, r.marker) for r in with_model(pages, fallback(first, second)).collect()}
    assert rows == {1: (None, 10, ""), 2: (40, 40, "llm.score"), 3: (None, 60, "llm.unavailable"), 4: (None, 90, ""), 5: (None, 40, "llm.unavailable")}
    assert with_model(pages, second, force=True).where("llm_score IS NOT NULL").count() == 4


def test_event_times_do_not_depend_on_the_session_zone(spark):
    before, seen = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seen.append(sorted(map(tuple, queries()["q43_debounce"](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert seen[0] == seen[1] != []
