"""Expected results written out by hand: urls, page features, label findings, the filter, explanations."""

import pytest
from pyspark.sql import functions as F

from veriscore.functions.homograph import decode_label
from veriscore.plans import blocklist as B
from veriscore.plans import corpus as C
from veriscore.plans import dims
from veriscore.plans.dialect import Spark
from veriscore.queries import queries
from veriscore.operators import scoring

D = Spark()
FORM = '<form action="{}"><input type="password" name="p"><input name="otp"><input name="cardnumber"><input name="idno"></form>'
TW = "<p>中華郵政 請輸入賬號 短信 激活</p>"
# url -> signals that must fire, signals that must not, least score
URL_CASES = [
    ("https://login.microsoftonline.com.attacker.tk/oauth2/v2.0/authorize", {"url.reverse_proxy_fqdn", "url.phishlet_endpoint", "url.tld_high_risk"}, set(), 75),
    ("https://login-microsoftonline-com.evil.xyz/login", {"url.reverse_proxy_hyphen_fqdn"}, {"url.reverse_proxy_fqdn"}, 40),
    ("https://login.microsoftonline.com/common/oauth2/v2.0/authorize", set(), {"url.phishlet_endpoint", "url.reverse_proxy_fqdn", "url.reverse_proxy_hyphen_fqdn"}, 0),
    ("https://login-help.example.org/", set(), {"url.reverse_proxy_fqdn", "url.reverse_proxy_hyphen_fqdn"}, 0),
    ("https://random-host.zip/login_data?id=1", {"url.phishlet_endpoint"}, set(), 55),
    ("https://tenant.okta.com/.well-known/openid-configuration", set(), {"url.phishlet_endpoint"}, 0),
    ("https://example.com/login%E2%80%8B", {"url.zero_width_in_url"}, set(), 21),
    ("https://example.tk/file‮exe.pdf", {"url.bidi_override_in_url"}, set(), 53),
    ("https://example.com/login", set(), {"url.zero_width_in_url", "url.bidi_override_in_url"}, 0),
    ("https://etax.gov.tw.refund-2026.click/login", {"url.gov_tw_substring_abuse"}, {"url.tw_institutional_tld"}, 40),
    ("https://www.google.com/search?q=phishing", {"url.allowlist_hit"}, set(), 0),
    ("https://cool.ntu.edu.tw/courses/57494", {"url.tw_institutional_tld"}, set(), 0),
    ("https://www.cathaybk.com.tw/personal/login", {"url.tw_allowlist_hit"}, set(), 0),
    ("https://cathaybk-login.tw-secure.com/personal", set(), {"url.tw_allowlist_hit"}, 0),
    ("https://www.bad-parcel.shop/track", {"url.bloomfilter_blacklist_hit"}, set(), 95),
    ("https://paypa1-secure-login.tk/account", set(), {"url.bloomfilter_blacklist_hit"}, 25),
    ("https://paypa1.com/", {"url.typosquat_brand"}, set(), 25),
    ("https://paypal.net/", set(), {"url.typosquat_brand"}, 0),
    ("https://icash.evil.tk/", {"url.subdomain_brand_abuse"}, set(), 60),
    ("https://kerrytj.evil.tk/", set(), {"url.subdomain_brand_abuse"}, 25),
    ("https://xn--pple-43d.com/", {"url.punycode_label", "url.punycode_brand_lookalike"}, set(), 43),
    ("https://a.xn--mnchen-3ya.xn--mnchen-3ya.de/", {"url.punycode_label"}, {"url.punycode_brand_lookalike"}, 16),
    ("https://pаypal.com/", {"url.punycode_label", "url.punycode_brand_lookalike"}, {"url.mixed_script_label"}, 43),
    ("http://192.168.1.50:8080/p", {"url.ip_as_host", "url.nonstandard_port"}, set(), 38),
    ("http://[2001:db8::1]/x", {"url.ip_as_host"}, set(), 30),
    ("not a url", {"url.parse_failed"}, set(), 0),
    ("ftp://files.example.com/1", set(), {"url.parse_failed"}, 0),
    ("https://x.example.edu/", {"url.user_allowlist_hit"}, set(), 0),
]
# html -> signals that must fire, signals that must not (page https://shop.evil.tk/)
PAGE_CASES = [
    (FORM.format("//drop.other.com/x"), {"dom.password_cross_etld1_post", "dom.otp_cross_etld1_post", "dom.card_cross_etld1_post", "dom.tw_national_id_cross_etld1_post", "dom.tw_pii_combo", "dom.card_and_password"}, {"dom.oauth_idp_allowlisted"}),
    (FORM.format("/own"), {"dom.tw_pii_combo"}, {"dom.password_cross_etld1_post"}),
    ("<FORM ACTION='https://accounts.google.com/x'><INPUT TYPE=password></FORM>", {"dom.oauth_idp_allowlisted"}, {"dom.password_cross_etld1_post"}),
    ("<form>" + "<input type=password>" + "".join(f"<input placeholder='word {i}'>" for i in range(12)) + "</form>", {"dom.seed_phrase_grid"}, set()),
    ('<link rel="icon" href="https://www.microsoft.com/favicon.ico"><link rel=icon href="/own.ico">', {"dom.favicon_brand_cdn_mismatch"}, set()),
    ('<link rel="icon" href="/own.ico"><link rel="icon" href="https://www.microsoft.com/favicon.ico">', set(), {"dom.favicon_brand_cdn_mismatch", "dom.favicon_brand_canonical_mismatch"}),
    ('<link rel="apple-touch-icon" href="//www.netflix.com/i.png">', {"dom.favicon_brand_cdn_mismatch"}, set()),
    ('<link rel="shortcut icon" href="//wellsfargo.com/i.png">', {"dom.favicon_brand_canonical_mismatch"}, {"dom.favicon_brand_cdn_mismatch"}),
    ('<div class="cf-turnstile"></div>', set(), set()),
    ('<form action="/s"></form><div class="box cf-turnstile"></div>', {"dom.cloaking_verify_wall"}, {"dom.cloaking_verify_wall_strong"}),
    ('<div data-sitekey="k" class="h-captcha"></div>', {"dom.cloaking_verify_wall_strong"}, {"dom.cloaking_verify_wall"}),
    ('<div class="cf-turnstile"></div>' + "word " * 100, set(), {"dom.cloaking_verify_wall", "dom.cloaking_verify_wall_strong"}),
    (TW, {"dom.cross_strait_terms_strong"}, set()),
    ("<p>軟件 默認</p>", set(), {"dom.cross_strait_terms", "dom.cross_strait_terms_strong"}),
    ("<iframe style='visibility: hidden'></iframe><iframe width=1 height=0></iframe><iframe width=300></iframe>", {"dom.hidden_iframes"}, set()),
    ('<body onkeydown="event.preventDefault()">', {"dom.anti_debug"}, set()),
    ('<script src="a.js">e.keyCode == 123</script>', set(), {"dom.anti_debug"}),
    ("<script>if (window.outerHeight - window.innerHeight > 160) {}</script>", {"dom.anti_debug"}, set()),
    ("".join(f'<script src="//c{i}.s{i}.com/a.js"></script>' for i in range(6)), {"dom.many_foreign_scripts"}, set()),
    ("".join(f'<script src="//c{i}.s1.com/a.js"></script>' for i in range(9)), set(), {"dom.many_foreign_scripts"}),
    ("<title>Pay​Pal</title>", {"dom.zero_width_in_text"}, set()),
    ("<input pattern='[A-Z][0-9]{9}'><input name=cvv><input autocomplete='one-time-code'>", {"dom.tw_pii_combo"}, set()),
]


def judged(spark, tmp_path, rows, name="q21_cascade"):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    return {r.page_id: r for r in queries()[name](spark, str(tmp_path)).where("page_id >= 0").collect()}


def ids(row):
    return {s.split("+")[0] for s in row.signals.split("|") if s}


def test_url_cases(spark, tmp_path):
    got = judged(spark, tmp_path, [(i, u, "") for i, (u, *_) in enumerate(URL_CASES)])
    for i, (url, must, never, least) in enumerate(URL_CASES):
        assert must <= ids(got[i]) and not never & ids(got[i]) and got[i].s1 >= least, (url, got[i])
    assert got[21].signals.count("url.punycode_label") == 2


def test_page_cases(spark, tmp_path):
    got = judged(spark, tmp_path, [(i, "https://shop.evil.tk/", h) for i, (h, *_) in enumerate(PAGE_CASES)])
    for i, (html, must, never) in enumerate(PAGE_CASES):
        assert must <= ids(got[i]) and not never & ids(got[i]), (html[:80], got[i])
    text = judged(spark, tmp_path, [(0, "https://a.b.com/", " \n" * 1500 + "end"), (1, None, None), (2, "https://a.b.com/", "<p>x</p>" * 20000)], "q14_dom_features")
    assert text[0].body_len == 3 and text[1].body_len == 0 and text[2].body_len > 2000


def test_only_so_many_elements_of_a_kind_count(spark, tmp_path):
    rows = [(i, "https://a.b.com/", "<iframe width=1 height=1>" * n + "<input>" * (n - 1) + "<input type=password>") for i, n in enumerate((C.MOST_NODES, C.MOST_NODES + 1))]
    got = judged(spark, tmp_path, rows, "q14_dom_features")
    assert [(got[i].hidden_iframes, got[i].has_pw) for i in (0, 1)] == [(C.MOST_NODES, True), (C.MOST_NODES, False)]


# Pages built like the offline evaluation's fixtures: url, html, url score, page score, total, verdict.
EVAL_CASES = [
    ("https://post-parcel.tk/x", FORM.replace('<input name="otp">', "").format("https://c.evil.com/p") + TW, 25, 142, 100, "dangerous"),
    ("https://www.gov-tw.support/x", '<form action="//c.evil.com/p"><input type="password"><input name="otp"><input name="idno"></form><p>國稅局 賬號</p>', 55, 115, 100, "dangerous"),
    ("https://linepay-bind.tk/", FORM.replace('<input type="password" name="p">', "").format("/x"), 25, 35, 60, "suspicious"),
    ("https://bill.top/", FORM.replace('<input type="password" name="p">', "").format("/x"), 12, 35, 47, "caution"),
    ("https://refund.tk/", FORM.format("/x"), 25, 47, 72, "suspicious"),
]


def test_eval_dialect(spark, tmp_path):
    got = judged(spark, tmp_path, [(i, u, h) for i, (u, h, *_) in enumerate(EVAL_CASES)], "q55_eval_dialect")
    assert [(got[i].s1, got[i].s2, got[i].total, got[i].verdict) for i in range(len(EVAL_CASES))] == [c[2:] for c in EVAL_CASES]


def test_explanations(spark, tmp_path):
    rows = [(0, "https://paypa1.com/", ""), (1, "https://plain.example.org/", "")]
    got = judged(spark, tmp_path, rows, "q54_reasons")
    assert got[0].reasons == '"paypa1" is 1 edits from the brand "paypal"' and got[0].shown == dims.SIGNAL_TEXT["url.typosquat_brand"] and got[1].reasons == ""
    prompts = judged(spark, tmp_path, rows, "q41_prompt")
    assert prompts[0].v1.startswith("URL: https://paypa1.com/\neTLD+1: paypa1.com\nPage title: (none)\n") and "- url.typosquat_brand (+25): " in prompts[0].v1 and prompts[0].v3.endswith("(空)") and set(prompts) == {0}


SITES = {
    "a.b.co.uk": "b.co.uk", "co.uk": None, "x.ck": None, "a.x.ck": "a.x.ck", "b.a.x.ck": "a.x.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "city.kawasaki.jp": "city.kawasaki.jp", "b.kawasaki.jp": None,
    "c.a.b.kawasaki.jp": "a.b.kawasaki.jp", "example.com": "example.com", "com": None, "1.2.3.4": None, "foo.unknowntld": "foo.unknowntld", "": None, "a.gov.tw": "a.gov.tw",
}


def test_sites(spark):
    dims.suffix_frame(spark).createOrReplaceTempView("suffixes")
    hosts = spark.createDataFrame([(h,) for h in SITES], "host string")
    hosts.createOrReplaceTempView("hosts")
    assert {r.host: r.s for r in spark.sql(f"SELECT host, {C.site(D, 'host', D.suffixes_of('host'))} AS s FROM hosts").collect()} == SITES


def test_punycode_fold_equals_the_codec(spark):
    labels = ["xn--pple-43d", "xn--mnchen-3ya", "xn--fiqs8s", "xn--80ak6aa92e", "xn--ls8h", "xn--a", "xn---", "xn--", "xn--99999999999", "xn--pypal-4ve", "xn--n3h", "xn--eckwd4c7c5976acvb2w6i", "plain"]
    got = spark.createDataFrame([(x,) for x in labels], "l string").select("l", F.expr(f"CASE WHEN l LIKE 'xn--%' THEN {D.punycode('l')} ELSE l END").alias("p")).collect()
    for r in got:
        assert r.p == decode_label(r.l) or r.l in ("xn--a", "xn---", "xn--", "xn--99999999999"), r


def test_filter(spark):
    assert B.fnv(b"abc", B.SEED_A) == 440920331 and B.fnv(b"abc", B.SEED_B) == 2309958252
    assert B.sizing(30) == (432, 10) and B.sizing(578_010) == (8_310_392, 10) and B.sizing(1) == (16, 12)
    names = ["fake-cathaybk.click", "esunbank-verify.top", "Ntbsa-Refund-2025.com", "名.example"]
    feed = spark.createDataFrame([(n,) for n in names], "domain string")
    spec = B.build(feed)
    assert spec.words() == B.words_of([n.lower() for n in names]) and spec.n_inserted == 4 and spec.empirical_fpr < 0.05
    probes = spark.createDataFrame([("www.FAKE-cathaybk.click", True), ("ntbsa-refund-2025.com", True), ("other.example", False), ("", False), (None, False)], "domain string, want boolean")
    assert all(r.hit == r.want for r in B.probed(probes, spec).collect())
    empty = B.build(feed.limit(0))
    assert not B.probed(probes, empty).where("hit").count()
    for broken in ({"hash_family": "x"}, {"fnv_prime": 3}, {"bits_b64": "AAAA"}):
        with pytest.raises(ValueError):
            B.BloomSpec(**(spec.__dict__ | broken)).checked()


def test_one_scan_and_no_join_of_pages(spark, sf):
    plan = queries()["q21_cascade"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("AS verdict#") == 1
    assert not any(line.strip(" :+-").startswith(("Join", "Aggregate", "Window")) for line in plan.splitlines())
