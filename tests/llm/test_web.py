"""URL filter against a plain version, HTML extraction on pages with known text."""

import html
import re
from collections import defaultdict
from itertools import zip_longest

from pyspark.sql import functions as F

from veriscore.llm.html_text import extract_main_text, main_text
from veriscore.llm.registry import op3_url_filter, op6_html_text
from veriscore.llm.url_filter import RULES, tree_url_verdicts


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path, rules=RULES):
    best = ""
    for rule, _ in rules:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and len(rule) > len(best):
            best = rule
    return best or None


def branches(nodes):
    """Branches of one host's nodes (segs, labelled, blocked), as lists of nodes: the method in plain Python."""
    work, out = [(nodes, 0)], []
    while work:
        own, depth = work.pop()
        n, bad = sum(x[1] for x in own), sum(x[2] for x in own)
        rests = [x[0][depth:] for x in own if len(x[0]) > depth]
        if bad in (0, n) or not rests:
            out.append(own)
            continue
        lo, hi = min(rests), max(rests)
        step = next((i for i, (x, y) in enumerate(zip_longest(lo, hi)) if x != y), len(lo))
        kids = defaultdict(list)
        for x in own:
            kids[x[0][depth] if len(x[0]) > depth else ""].append(x)
        sides = defaultdict(list)
        for kid in kids.values():
            cn, cb, side = sum(x[1] for x in kid), sum(x[2] for x in kid), 0
            if 0 < cn < n:
                p = bad / n
                gap, error = cb / cn - (bad - cb) / (n - cn), (p * (1 - p) * (1 / cn + 1 / (n - cn))) ** 0.5
                side = (gap > 1.96 * error) - (gap < -1.96 * error)
            sides[side] += kid
        if set(sides) == {0}:
            work.append((own, depth + max(1, step)))
        else:
            work += [(part, depth) for part in sides.values()]
    return out


def brute(urls, labels=None, rules=RULES, reject=0.8, weight=5.0):
    rows, nodes = [], defaultdict(lambda: [0, 0])
    for u in urls:
        host, path = split(u)
        rule = ruled(host, path, rules)
        segs = tuple(re.sub(r"^[0-9]+", "{n}", p) if re.fullmatch(r"[0-9]+(\.[A-Za-z]{1,5})?", p) else "{h}" if re.fullmatch("[0-9a-fA-F]{8,}", p) else p for p in path.split("/") if p)
        given = dict(rules).get(rule)
        label = (labels or {}).get(u, {"block": 1, "allow": 0}.get(given))
        rows.append((host, path, rule, given, segs))
        nodes[host, segs][0] += label is not None
        nodes[host, segs][1] += label or 0
    total, blocked = (sum(n[i] for n in nodes.values()) for i in (0, 1))
    prior, hosts, bad = blocked / total if total else 0.0, defaultdict(list), {}
    for (host, segs), (n, b) in nodes.items():
        hosts[host].append((segs, n, b))
    templates = defaultdict(lambda: [0, 0])
    for (_, segs), (n, b) in nodes.items():
        templates[segs][0] += n
        templates[segs][1] += b
    elsewhere = {}
    for branch in branches([(segs, n, b) for segs, (n, b) in templates.items()]):
        elsewhere |= {x[0]: (sum(x[2] for x in branch) + weight * prior) / (sum(x[1] for x in branch) + weight) for x in branch}
    for host, own in hosts.items():
        for branch in branches(own):
            for segs, _, _ in branch:
                share = (sum(x[2] for x in own) + weight * elsewhere[segs]) / (sum(x[1] for x in own) + weight)
                bad[host, segs] = (sum(x[2] for x in branch) + weight * share) / (sum(x[1] for x in branch) + weight) >= reject
    return [(h, p, r, g or ("block" if bad[h, s] else "allow")) for h, p, r, g, s in rows]


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG", "http://EXAMPLE.org/es/x", "https://a.example.org/en/1x?q=/en/2", "http://x.com/fr/#/de/", "http://xcom/fr/", "http://com/de/", "http://a.net?x", "http://a.net/" + "p/" * 5000] * 2


def test_filter_matches_plain_version(spark, sf):
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    urls += [f"http://shop.net/p{i}/{i}" for i in range(60)] + [f"http://shop.net/item/{i}.html" for i in range(60)] + ODD
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))
    got = {r.page_id: tuple(r[1:]) for r in tree_url_verdicts(rows).collect()}
    assert [got[i] for i in range(len(urls))] == brute(urls)
    assert op3_url_filter(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert tree_url_verdicts(rows.limit(0)).count() == 0


def test_templates_decide_on_the_given_pages(spark, sf):
    """Without the tree (all urls outside the rules allowed) the query's rows are others; its own are the plain version's.

    Under the rules every labelled /es/ path is bad, /de/ is bad on some hosts and good on others, /fr/ and most of /en/ are good."""
    got = {r.page_id: r for r in op3_url_filter(spark, "/root/testdata/sf0.1").collect()}
    urls = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    assert [tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) for i, _ in urls] == brute([u for _, u in urls])
    unruled = {i: r for i, r in got.items() if r.rule is None}
    blocked = [r for r in unruled.values() if r.verdict == "block"]
    assert blocked and {r.path.split("/")[1] for r in blocked} == {"es"} and len(blocked) < len(unruled)


def test_labels_decide_inside_a_host(spark):
    """On one host without rules: labelled branches are told apart, small ones alike are judged together, and unseen names share their verdict.

    A host without labels is judged by what its templates are elsewhere."""
    name = lambda i: "w" + "".join("abcdefghij"[int(c)] for c in str(i))
    labels = {f"http://mixed.net/forum/{name(i)}/x": 1 for i in range(40)} | {f"http://mixed.net/docs/{name(i)}": 0 for i in range(60)}
    labels |= {f"http://mixed.net/{kind}/{name(i)}": 1 for kind in ("spam", "junk", "rubbish") for i in range(4)}
    unseen = {"http://mixed.net/forum/never/x": "block", "http://mixed.net/forum/other/y/z": "block", "http://mixed.net/docs/never": "allow", "http://mixed.net/spam/never": "block", "http://mixed.net/junk/never": "block", "http://free.net/forum/never": "block", "http://free.net/docs/never": "allow"}
    urls = [*labels, *unseen, None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    marks = spark.createDataFrame([*labels.items(), ("http://mixed.net/docs/" + name(1), 0), ("http://elsewhere.net/", 1)], "url string, bad int")
    got = {r.page_id: tuple(r[1:]) for r in tree_url_verdicts(pages, labels=marks).collect()}
    assert [got[len(labels) + i][3] for i in range(len(unseen))] == list(unseen.values())
    assert [got[i] for i in range(len(urls))] == brute(urls, labels)
    alone = {u: v for u, v in labels.items() if "/docs/" in u or "/junk/" in u}
    few = [*alone, "http://mixed.net/junk/never"]
    pages = spark.createDataFrame(list(enumerate(few)), "page_id long, url string")
    got = {r.page_id: tuple(r[1:]) for r in tree_url_verdicts(pages, labels=marks.where("url LIKE '%/docs/%' OR url LIKE '%/junk/%'")).collect()}
    assert [got[i] for i in range(len(few))] == brute(few, alone) and got[len(few) - 1][3] == "allow"  # four labels alone are too few


def test_scoring_alone_finds_the_articles(spark, sf):
    """Pages without the article element give the same text."""
    from veriscore.llm.html_text import extract_main_text

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    assert bare.where("html LIKE '%<article%'").count() == 0
    assert {r.page_id: r.text for r in extract_main_text(bare).collect()} == {r.page_id: r.text for r in extract_main_text(pages).collect()}


def test_articles_come_out_whole(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op6_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.sub(r"<!--.*?-->", "", re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1], flags=re.S)
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1|div)[^>]*>", article))
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_parts_that_are_no_article():
    page = """<html><head><title>t</title><style>x</style></head><body><header><a href=/>Home, sweet, home</a></header><div id="cookie-notice"><p>We use cookies, many of them, really.</p></div>
    <div class=wrap><div class="content"><h1>Head &amp; line</h1><p>First, with <a href=x>a link</a>, and more.<p>Second &lt;one&gt;, unclosed <b>bold</div><div class="sidebar"><p>Aside, aside, aside.</p></div>
    <div class="comments"><p>Nice, nice, nice, nice, nice, nice.</p></div></div><form><p>Type, here</p></form><script>if (a < b) "<p>no</p>"</script><footer>(c)</footer>"""
    assert main_text(page) == "Head & line First, with a link, and more. Second <one>, unclosed bold"
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<nav><p>x, y</p></nav>") == ""
    assert main_text("plain\n  words &copy; <i") == "plain words ©"
    assert main_text("<p>a" * 3000 + "<b>" * 3000).count("a") == 3000


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>x", "e"), (1, "u", "<p>x", "e"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_main_text(rows).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert extract_main_text(rows.limit(0)).count() == 0
