"""The whole template tree of the URL filter: small pure branches and branches below the third segment."""

from veriscore.llm.url_filter import tree_url_verdicts


def words(n):
    return ["w" + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(n)]


def test_tree_goes_to_the_end_of_paths(spark):
    rules = (("big.net/m", "allow"), ("big.net/promo/k", "block"), ("big.net/a/b/c/bad/k", "block"), ("big.net/a/b/c/good/k", "allow"))
    w = words(1200)
    urls = [f"http://big.net/m{x}/y" for x in w] + [f"http://big.net/promo/k{x}" for x in w[:40]]
    urls += [f"http://big.net/a/b/c/{side}/k{x}" for side in ("bad", "good") for x in w[:40]]
    asked = {"http://big.net/promo/other": "block", "http://big.net/a/b/c/bad/other": "block", "http://big.net/a/b/c/good/other": "allow", "http://big.net/rest/other": "allow"}
    asked["http://big.net/" + "p/" * 5000] = "allow"
    rows = spark.createDataFrame(list(enumerate([*urls, *asked])), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in tree_url_verdicts(rows, rules=rules).collect()}
    assert [got[len(urls) + i] for i in range(len(asked))] == [(None, v) for v in asked.values()]
    assert len(got) == len(rows.collect())


def test_tree_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://x.com/fr/#/de/"), (4, "http://x.com/fr/#/de/"), (5, "http://x.com/de")], "page_id long, url string")
    assert sorted((r.page_id, r.host, r.verdict) for r in tree_url_verdicts(rows).collect()) == [(1, "", "allow"), (2, "", "allow"), (3, "", "allow"), (4, "x.com", "allow"), (4, "x.com", "allow"), (5, "x.com", "allow")]
    assert tree_url_verdicts(rows.limit(0)).count() == 0
