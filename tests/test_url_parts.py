"""Urls as a browser and as the offline evaluation read them: expected parts written out by hand."""

import random

from veriscore import engine
from veriscore.plans import corpus as C
from veriscore.plans.dialect import Spark
from veriscore.plans.dims import suffix_frame

D = Spark(shapes=False)
# url -> host, port, path, href; None: no valid url
PAGE = {
    "HTTP://EXAMPLE.com": ("example.com", "", "/", "http://example.com/"),
    "https://example.com:443/a/../b/./c": ("example.com", "", "/b/c", "https://example.com/b/c"),
    "https://example.com:0444/%2e%2E/x/..?q=/../": ("example.com", "444", "/", "https://example.com:444/?q=/../"),
    "https://example.com/a/b/../../../c/.": ("example.com", "", "/c/", "https://example.com/c/"),
    "https://example.com/a..b/.c/...": ("example.com", "", "/a..b/.c/...", "https://example.com/a..b/.c/..."),
    "http://0x7f.1/": ("127.0.0.1", "", "/", "http://127.0.0.1/"),
    "http://2130706433/": ("127.0.0.1", "", "/", "http://127.0.0.1/"),
    "http://017700000001:8080/x": ("127.0.0.1", "8080", "/x", "http://127.0.0.1:8080/x"),
    "http://192.168.257/": ("192.168.1.1", "", "/", "http://192.168.1.1/"), "http://192.168.65793/": None,
    "http://1.2.3.4./": ("1.2.3.4", "", "/", "http://1.2.3.4/"),
    "http://%31.2.3.0x10/": ("1.2.3.16", "", "/", "http://1.2.3.16/"),
    "http://256.1.1.1/": None, "http://1.2.3.4.5/": None, "http://1.2.3.09/": None, "http://4294967296/": None, "http://foo.0x/": None, "http://99999999999999999999999/": None,
    "http://1e3.com/": ("1e3.com", "", "/", "http://1e3.com/"),
    "http://ex%61mple.com/": ("example.com", "", "/", "http://example.com/"),
    "http://ex%zzmple.com/": None, "http://a%2fb.com/": None,
    "http://Ｇｏ。com/": ("go.com", "", "/", "http://go.com/"),
    "https://Bücher.example/": ("xn--bcher-kva.example", "", "/", "https://xn--bcher-kva.example/"),
    "https://pаypal.com/": ("xn--pypal-4ve.com", "", "/", "https://xn--pypal-4ve.com/"),
    "https://ex\u200bam\u00adple.com/": ("example.com", "", "/", "https://example.com/"),
    "https://a\u202eb.com/": None,
    "http:\\\\example.com\\a\\b?x=\\y": ("example.com", "", "/a/b", "http://example.com/a/b?x=\\y"),
    " \t https://a.com/x\ny \x00": ("a.com", "", "/xy", "https://a.com/xy"),
    "https:/a.com": ("a.com", "", "/", "https://a.com/"), "https:a.com/b": ("a.com", "", "/b", "https://a.com/b"), "https:////a.com/b": ("a.com", "", "/b", "https://a.com/b"),
    "https://a b.com/": None, "https://a.com:99999/": None, "https://a.com:x/": None, "https:///": None, "https://?x": None, "https://a:b:80/": None, "not a url": None, "": None, None: None, "/path": None,
    "https://u:p@a.com/": ("a.com", "", "/", "https://u:p@a.com/"), "https://:@a.com/": ("a.com", "", "/", "https://a.com/"), "https://x@y@a.com:/": ("a.com", "", "/", "https://x@y@a.com/"),
    "https://a.com/ü x<>|^`": ("a.com", "", "/%C3%BC%20x%3C%3E|%5E%60", "https://a.com/%C3%BC%20x%3C%3E|%5E%60"),
    "https://a.com/%zz%41😀": ("a.com", "", "/%zz%41%F0%9F%98%80", "https://a.com/%zz%41%F0%9F%98%80"),
    "http://[2001:DB8::1]:80/": ("[2001:db8::1]", "", "/", "http://[2001:db8::1]/"), "http://[2001:db8::g]/": None,
    "mailto:x@y.z": ("", "", "/", "mailto:x@y.z"), "javascript:alert(1)//a.com": ("", "", "/", "javascript:alert(1)//a.com"),
}
EVAL = {
    "HTTP://User@EX.com:80/a;b/c;d?e": ("ex.com", "80", "/a;b/c", "HTTP://User@EX.com:80/a;b/c;d?e"),
    "http://[2001:db8::1]/x": ("2001:db8::1", "", "/x", "http://[2001:db8::1]/x"),
    "http://0x7f.1/../b": ("0x7f.1", "", "/../b", "http://0x7f.1/../b"),
    "https://a.com:": ("a.com", "", "/", "https://a.com:"), "https://a.com:0/": ("a.com", "", "/", "https://a.com:0/"),
    "https://Bücher.example/ü": ("bücher.example", "", "/ü", "https://Bücher.example/ü"),
    "http://a.com:x/": None, "http://a.com:70000/": None, "https://": None, "https:///x": None, "mailto:x@y.z": None, "": None, None: None,
}


def parts(spark, urls, mode):
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").createOrReplaceTempView("pages")
    suffix_frame(spark).createOrReplaceTempView("suffixes")
    rows = engine.run(f"WITH {C.urls(D, mode=mode)} SELECT page_id, host, port, path, href, valid, is_ip, scheme FROM u", spark).collect()
    return {urls[r.page_id]: r for r in rows}


def test_page_urls(spark):
    got = parts(spark, list(PAGE), "page")
    for url, want in PAGE.items():
        r = got[url]
        assert ((r.host, r.port, r.path, r.href) if r.valid else None) == want, (url, r)
    assert {u for u, r in got.items() if r.is_ip and r.valid} == {u for u, w in PAGE.items() if w and (w[0][:1] == "[" or w[0].replace(".", "").isdigit())}


def test_eval_urls(spark):
    got = parts(spark, list(EVAL), "eval")
    for url, want in EVAL.items():
        r = got[url]
        assert ((r.host, r.port, r.path, r.href) if r.valid else None) == want, (url, r)
    assert not got["http://[2001:db8::1]/x"].is_ip  # its brackets are gone


def test_gates_of_other_schemes(spark):
    pages = spark.createDataFrame([(1, "mailto:x@y.z", ""), (2, "nothing", ""), (3, "http://0x7f.1:8080/", ""), (4, "https://a.com:99999/", "")], "page_id long, url string, html string")
    gates = {r.page_id: r.gate for r in engine.judge(pages, "gates").collect()}
    assert gates == {1: "non_http", 2: "url.parse_failed", 3: "", 4: "url.parse_failed"}
    assert "url.ip_as_host+30" in {r.page_id: r.signals for r in engine.judge(pages).collect()}[3]


def test_punycode_both_ways(spark):
    rng = random.Random(1)
    labels = ["münchen", "例え", "ü", "üüü", "a-ü-b", "ليهمابتكلموشعربي؟", "他们为什么不说中文", "😀x😀", "ü-"] + ["".join(rng.choice("abcäöüßжщ例😀-0") for _ in range(rng.randint(1, 20))) + "ж" for _ in range(100)]
    rows = spark.createDataFrame([(x,) for x in labels], "l string").selectExpr("l", f"{D.to_punycode('l')} AS p").selectExpr("l", "p", f"{D.punycode('p')} AS back").collect()
    assert all(r.p == "xn--" + r.l.encode("punycode").decode() and r.back == r.l for r in rows)
