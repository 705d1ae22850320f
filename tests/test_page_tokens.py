"""Features come from a page's tokens: what stands in comments, scripts, quotes and text areas is no element. Expected values by hand."""

from veriscore import engine

SEED = "".join(f"<input placeholder='word {i}'>" for i in range(8))
# html -> features that differ from those of an empty page
CASES = [
    ("<!-- <input type=password> --><p>a", {"body_len": 1}),
    ("<!-- never closed <input type=password><title>t</title>", {}),
    ("<script>document.write('<input type=\"password\"><iframe width=0 height=0>')</script>", {}),
    ("<script>never closed <input type=password>", {}),
    ("<style>a:after{content:'<input type=password>'}</style>b", {"body_len": 1}),
    ("<textarea><input type=password></textarea>", {}),
    ("<title>a <input type=password> b</title>", {"title": "a <input type=password> b"}),
    ("<!-- <title>no</title> --><TITLE lang='x'>y\n z</TITLE><title>later</title>", {"title": "y z"}),
    ('<input placeholder="a > b" type="password">', {"has_pw": True}),
    ("<input placeholder=' type=password '>", {}),
    ("<input data-type=password>", {}),
    ("<INPUT\nTYPE = 'PassWord'/>", {"has_pw": True}),
    ("<input type=text type=password>", {}),
    ("<inputs type=password>", {}),
    ('<div title="<input type=password>">c</div>', {"body_len": 1}),
    ('<p title="open><input type=password>', {"has_pw": True}),  # quotes that do not pair up end with the tag
    ("<iframe srcdoc='a>b' style='display: none'></iframe>", {"hidden_iframes": 1}),
    ("<form action='//a.evil.com/x'><form action='//b.evil.com/y'><input type=password></form>", {"has_pw": True, "n_actions": 2, "cross_site": "evil.com", "sensitive_form": True}),
    ("<form action=/a></form><input type=password>", {"has_pw": True, "n_actions": 1}),
    ("<form action=/a><input type=password>", {"has_pw": True, "n_actions": 1, "sensitive_form": True}),
    ("<form><input type=password>" + SEED + "</form>", {"has_pw": True, "n_actions": 1, "sensitive_form": True, "seed_grid": True}),
    ("<form><input type=password></form><form>" + SEED + "</form>", {"has_pw": True, "n_actions": 1, "sensitive_form": True}),
    ("<form><!-- <input type=password> -->" + SEED + "</form>", {"n_actions": 1}),
    ("<form>x<script>'</form>'</script><input type=password></form>", {"has_pw": True, "n_actions": 1, "sensitive_form": True, "body_len": 1}),
    ("<script src='//cdn.other.com/a.js' data-x='b>c'>e.keyCode == 123</script>", {"n_foreign": 1}),
    ("<script data-src='no'>if (window.outerHeight - window.innerHeight > 160) {}</script>", {"anti_debug": True}),
    ("<link rel=icon href='//www.netflix.com/i.png'><!-- <link rel=icon href='//a.org/i'> -->", {"icon_site": "netflix.com"}),
    ("<div data-sitekey=k class='x h-captcha'></div>", {"hcaptcha": True}),
    ("<div title='cf-turnstile'></div>", {}),
    ("e<input type=password", {"body_len": 1}),  # a tag that never ends is none
    ("<a " + " ".join(f"data-a{i}='v>{i}'" for i in range(200)) + ">d</a><input type=password>", {"has_pw": True, "body_len": 1}),
]
EMPTY = {"title": "", "body_len": 0, "has_pw": False, "has_otp": False, "has_card": False, "has_id": False, "seed_grid": False, "sensitive_form": False, "hidden_iframes": 0, "tiny_elements": 0, "anti_debug": False, "turnstile": False, "hcaptcha": False, "n_actions": 0, "cross_site": "", "n_idp": 0, "n_foreign": 0, "icon_site": "example.org"}


def test_tokens(spark):
    pages = spark.createDataFrame([(i, "https://shop.example.org/", h) for i, (h, _) in enumerate(CASES)], "page_id long, url string, html string")
    got = {r.page_id: r.asDict() for r in engine.judge(pages, "features").collect()}
    for i, (html, want) in enumerate(CASES):
        assert {k: v for k, v in got[i].items() if k in EMPTY and v != EMPTY[k]} == want, html[:90]


def test_a_long_broken_page_ends(spark):
    """No pattern goes deep or runs long on a page of half a million opened tags and quotes."""
    pages = spark.createDataFrame([(1, "https://a.org/", "<a href='" * 200_000), (2, "https://a.org/", '<input name="x" ' * 100_000), (3, "https://a.org/", "<" * 500_000), (4, "https://a.org/", "<a \"'>" * 100_000)], "page_id long, url string, html string")
    assert {r.page_id: r.has_pw for r in engine.judge(pages, "features").collect()} == dict.fromkeys((1, 2, 3, 4), False)
