"""A source with most of all rows and four fifths of junk: the pipeline's quality stage keeps the rest of it only."""

import duckdb

from veriscore.llm.common import staged
from veriscore.llm.quality import SQL, judged, keep_good, quality_features, quality_table


def test_hot_host_of_junk(spark):
    text = " ".join(f"w{i}" for i in range(60))
    lines = "".join(f"w{i} x{i} y{i}\n" for i in range(20)) + "again\n" * 20
    junk = [" ".join(f"w{i} |" for i in range(60)), lines, "w" * 2500 + " " + text]
    for bad in junk:
        rows = [(i, text if i % 5 == 0 else bad, "hot") for i in range(300)] + [(1000 + i, text, f"h{i % 20}") for i in range(100)]
        kept = sorted(r.doc_id for r in keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
        assert kept == [i for i in range(300) if i % 5 == 0] + list(range(1000, 1100))


def test_hosts_decide_on_near_failures(spark):
    """A text that comes near a soft rule goes on hosts of a worse record than the corpus, and stays on others; without hosts there is no such host."""
    text = " ".join(f"word{i}" for i in range(60))
    near, bad = text + " " + "# " * 4, " ".join(f"word{i} |" for i in range(60))
    rows = [(i, near, "worse", 1, "x") for i in range(10)] + [(100 + i, bad, "worse", 1, "x") for i in range(30)] + [(200 + i, text, "worse", 1, "x") for i in range(60)]
    rows += [(1000 + i, near if i == 0 else text, f"h{i % 10}", 1, "x") for i in range(1000)] + [(9000, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _kept int, _host string")
    kept = {r.doc_id for r in quality_table(df).where("kept").collect()}
    assert kept == {200 + i for i in range(60)} | {1000 + i for i in range(1000)}
    assert {r.doc_id for r in keep_good(df).collect()} == kept
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toPandas())
    assert {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({SQL.format(documents='documents')})").fetchall() if k} == kept
    one = spark.createDataFrame([(1, near, "a"), (2, text, "a")], "doc_id long, text string, source string")
    assert quality_table(one).where("kept").count() == 2


def test_given_documents_fail_outright_or_not_at_all(spark):
    """No given document comes near a soft rule without failing a rule, so there no clean one is lost to its host's record."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = judged(staged(quality_features(docs.select("doc_id", "text", "source")).drop("text"), "q"))
    outright = "(_base_failed OR _fail_symbols OR _fail_lines OR _fail_length)"
    assert rows.where(f"NOT {outright} AND (_near_symbols OR _near_lines OR _near_length)").count() == 0
    assert rows.where(f"_kept = {outright}").count() == 0
