"""Label signals come from the hosts of the pages themselves."""

from veriscore.queries import queries


def test_hosts_of_all_pages(spark, tmp_path):
    urls = ["https://user@XN--PPLE-43D.com:8443/login?x=/", "https://a.xn--mnchen-3ya.xn--pple-43d.com/", "https://plain.example.com/xn--pple-43d.com", "not a url", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.host, r.id, r.weight) for r in queries()["q46_punycode"](spark, str(tmp_path)).where("page_id >= 0").collect())
    label, brand = ("url.punycode_label", 8), ("url.punycode_brand_lookalike", 35)
    assert got == sorted([(0, "xn--pple-43d.com", *s) for s in (label, brand)] + [(1, "a.xn--mnchen-3ya.xn--pple-43d.com", *s) for s in (label, label, brand)])
