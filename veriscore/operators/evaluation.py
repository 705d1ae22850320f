"""Evaluation queries: confusion matrices, sweeps, bootstrap, per-signal precision, drift, what-if, sampling, Bloom filter, sessions."""

from __future__ import annotations

from ..plans import corpus as C
from ..plans import dims
from ..plans.blocklist import sized
from ..plans.dialect import Duck
from .scoring import cascade, llm

CELLS = "count(CASE WHEN y = 1 AND p THEN 1 END) AS tp, count(CASE WHEN y = 0 AND p THEN 1 END) AS fp, count(CASE WHEN y = 1 AND NOT p THEN 1 END) AS fn, count(CASE WHEN y = 0 AND NOT p THEN 1 END) AS tn"


def ratio(a: str, b: str, digits: int = 6) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0), {digits})"


def rates(source: str, keep: str = "") -> str:
    """precision, recall, f1, fpr, accuracy of rows with tp, fp, fn, tn; 0 where undefined."""
    return f"SELECT {keep}tp, fp, fn, tn, {ratio('tp', 'tp + fp')} AS precision_, {ratio('tp', 'tp + fn')} AS recall_, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {ratio('fp', 'fp + tn')} AS fpr, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM ({source})"


def variants(d):
    """Rates rounded to even at three digits, precision also as null where undefined."""
    inner = f"SELECT {CELLS} FROM (SELECT label AS y, total >= 50 AS p FROM t)"
    p, r = "(CAST(tp AS DOUBLE) / nullif(tp + fp, 0))", "(CAST(tp AS DOUBLE) / nullif(tp + fn, 0))"
    return f" SELECT tp, fp, fn, tn, {d.even(p, 3)} AS precision_or_null, {d.even(f'coalesce({p}, 0.0)', 3)} AS precision_, {d.even(f'coalesce({r}, 0.0)', 3)} AS recall_, {d.even(f'coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0)', 3)} AS f1 FROM ({inner})"


#: Thresholds of the two sweeps.
FINE, COARSE = tuple(range(5, 100, 5)), (5, 15, 25, 50, 85)


def sweep(thresholds):
    """Rates at each threshold: scores are first counted per value and label, so what meets the thresholds is small at any input size."""

    def select(d):
        th = d.unnest(d.array(*map(str, thresholds)), "cells", "label, total, n", "threshold")
        side = lambda name, y, op: f"CAST(sum(CASE WHEN label = {y} AND total {op} threshold THEN n ELSE 0 END) AS BIGINT) AS {name}"
        cells = ", ".join(side(*a) for a in (("tp", 1, ">="), ("fp", 0, ">="), ("fn", 1, "<"), ("tn", 0, "<")))
        return f", cells AS (SELECT label, total, count(*) AS n FROM t GROUP BY label, total), e AS (SELECT CAST(threshold AS BIGINT) AS threshold, {cells} FROM ({th}) GROUP BY threshold) {rates('SELECT * FROM e', 'threshold, ')}"

    return cascade(select)


#: From this variance on a binomial draw is a rounded normal one; below, the inverse of its distribution, whose mean is then under 50.
NORMAL_FROM = 25


def binomial(d, n: str, p: str, uniform: str, normal: str) -> str:
    """A draw of Binomial(n, p), from a number in (0, 1) or a standard normal one."""
    w = f"least({p}, 1 - {p})"
    step = f"CASE WHEN s.c <= {uniform} THEN {d.struct(c='s.c + s.f', f=f'greatest(s.f * ({n} - s.x) / (s.x + 1) * {w} / (1 - {w}), 0.0)', x='s.x + 1')} ELSE s END"
    zero = d.struct(c="CAST(0 AS DOUBLE)", f=f"pow(1 - {w}, {n})", x="CAST(0 AS DOUBLE)")
    found = f"({d.fold(d.map(d.seq('0', '200'), 'i', zero), zero, 's', 'v', step)}).x - 1"
    rounded = f"floor({n} * {w} + sqrt({n} * {w} * (1 - {w})) * {normal} + 0.5)"
    small = f"greatest(0.0, least(CAST({n} AS DOUBLE), CASE WHEN {n} * {w} * (1 - {w}) < {NORMAL_FROM} THEN {found} ELSE {rounded} END))"
    return f"CAST(CASE WHEN {n} = 0 OR {p} <= 0 THEN 0 WHEN {p} >= 1 THEN {n} WHEN {p} > 0.5 THEN {n} - {small} ELSE {small} END AS BIGINT)"


def resamples(d, source: str, replicates: int) -> str:
    """b3(r, tp, fp, fn, tn): resamples, with replacement, of the pages counted in the one row of source (tp, fp, fn, tn).

    A confusion matrix of a resample depends on the four counts alone, so each is one multinomial draw, made as three binomial ones, each
    of what the ones before left. Uniform numbers are 32 bits of a hash of replicate and place; normal ones are made of two of them.
    """
    uniform = lambda j: f"((CAST({d.hash32(f"concat('{j}:', r)")} AS DOUBLE) + 0.5) / 4294967296.0)"
    normal = lambda j: f"sqrt(-2 * ln(u{j})) * cos(2 * pi() * v{j})"
    reps = d.unnest(d.seq("1", str(replicates)), source, "tp AS tp0, fp AS fp0, fn AS fn0, tn AS tn0", "r")
    share = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"
    return (
        f"b0 AS (SELECT *, tp0 + fp0 + fn0 + tn0 AS n, {', '.join(f'{uniform(f'u{j}')} AS u{j}, {uniform(f'v{j}')} AS v{j}' for j in (1, 2, 3))} FROM ({reps}) b00), "
        f"b1a AS (SELECT *, {share('tp0', 'n')} AS p1, {share('fp0', 'n - tp0')} AS p2, {share('fn0', 'fn0 + tn0')} AS p3 FROM b0), "
        f"b1 AS (SELECT *, {binomial(d, 'n', 'p1', 'u1', normal(1))} AS tp FROM b1a), b2a AS (SELECT *, n - tp AS n2 FROM b1), b2 AS (SELECT *, {binomial(d, 'n2', 'p2', 'u2', normal(2))} AS fp FROM b2a), "
        f"b3a AS (SELECT *, n2 - fp AS n3 FROM b2), b3b AS (SELECT *, {binomial(d, 'n3', 'p3', 'u3', normal(3))} AS fn FROM b3a), b3 AS (SELECT r, tp, fp, fn, n3 - fn AS tn FROM b3b)"
    )


def intervals(d, replicates: int) -> str:
    """95 % intervals of the rates of b3, values at the nearest rank."""
    lo, hi = (round(q * (replicates - 1)) + 1 for q in (0.025, 0.975))
    order = ", ".join(f"row_number() OVER (ORDER BY {m}) AS k_{m}" for m in ("precision_", "recall_", "f1", "fpr"))
    ranked = ", ".join(f"max(CASE WHEN k_{m} = {k} THEN {m} END) AS {m}_{n}" for m in ("precision_", "recall_", "f1", "fpr") for n, k in (("lo", lo), ("hi", hi)))
    return f"m AS ({rates('SELECT * FROM b3', 'r, ')}), o AS (SELECT {order}, precision_, recall_, f1, fpr FROM m) SELECT {ranked} FROM o"


def bootstrap(replicates: int = 1000):
    """95 % intervals at threshold 50 from `replicates` resamples of the rows. Pages are counted once; replicates meet the counts only."""
    return cascade(lambda d: f", cells AS (SELECT {CELLS} FROM (SELECT label AS y, total >= 50 AS p FROM t)), {resamples(d, 'cells', replicates)}, {intervals(d, replicates)}")


def per_signal(distinct: bool):
    """Pages per signal by label: every emission with weight, or distinct signals of a page with hit rates."""

    def select(d):
        ids = d.distinct(d.map("sig", "e", "e.id")) if distinct else d.map(d.filter("sig", "e", "e.weight > 0"), "e", "e.id")
        counts = "count(*) AS fires, count(CASE WHEN label = 1 THEN 1 END) AS on_bad, count(CASE WHEN label = 0 THEN 1 END) AS on_good"
        long = d.unnest(ids, "t", "label", "id")
        share = d.even("CAST(on_bad AS DOUBLE) / fires", 3)
        if not distinct:
            return f" SELECT id, fires, on_bad, on_good, {share} AS precision_ FROM (SELECT id, {counts} FROM ({long}) GROUP BY id)"
        # A name of no signal in every row counts the pages of each label in the same pass.
        rows = d.unnest(d.concat(d.array("''"), ids), "t", "label", "id")
        rate = lambda a: d.even(f"coalesce(CAST({a} AS DOUBLE) / nullif(max(CASE WHEN id = '' THEN {a} END) OVER (), 0), 0.0)", 3)
        counted = f"SELECT id, fires, on_bad, on_good, {share} AS precision_, {rate('on_bad')} AS rate_bad, {rate('on_good')} AS rate_good FROM (SELECT id, {counts} FROM ({rows}) GROUP BY id)"
        return f" SELECT id, fires, on_bad, on_good, precision_, rate_bad, rate_good, CAST(row_number() OVER (ORDER BY precision_ DESC, fires DESC, id) AS BIGINT) AS place FROM (SELECT * FROM ({counted}) WHERE id <> '')"

    return cascade(select)


VERDICTS = ("safe", "caution", "suspicious", "dangerous", "unknown")


def histogram(d):
    """Pages and bad pages of each of the five verdicts, those with none included: counted in one row, which then becomes five."""
    counts = ", ".join(f"count(CASE WHEN verdict = '{v}' THEN 1 END) AS n{i}, count(CASE WHEN verdict = '{v}' AND label = 1 THEN 1 END) AS b{i}" for i, v in enumerate(VERDICTS))
    rows = d.array(*(d.struct(v=f"'{v}'", n=f"n{i}", b=f"b{i}") for i, v in enumerate(VERDICTS)))
    return f", tallies AS (SELECT {counts} FROM t) SELECT e.v AS verdict, e.n AS n, e.b AS bad FROM ({d.unnest(rows, 'tallies', 'n0', 'e')})"


def confusion(score: str, prefix: str) -> str:
    return ", ".join(f"count(CASE WHEN label = {y} AND {score} {op} 50 THEN 1 END) AS {prefix}_{n}" for n, y, op in (("tp", 1, ">="), ("fp", 0, ">="), ("fn", 1, "<"), ("tn", 0, "<")))


def side_by_side(force: bool):
    """Rules against rules with model, per gating mode, and where harmless pages are misjudged."""
    extra = "count(llm_score) AS llm_called, count(CASE WHEN label = 0 AND llm_score >= 50 THEN 1 END) AS llm_fp_alone, count(CASE WHEN label = 0 AND llm_score IS NOT NULL AND final >= 50 THEN 1 END) AS cascade_fp, count(CASE WHEN final > total THEN 1 END) AS escalated, count(CASE WHEN label = 0 AND llm_score IS NOT NULL THEN 1 END) AS benign_called"

    def select(d):
        inner = f"SELECT {confusion('total', 'rules')}, {confusion('final', 'final')}, {extra} FROM m"
        more = ", ".join(f"round({ratio(f'final_{a}', f'final_{a} + final_{b}')} - {ratio(f'rules_{a}', f'rules_{a} + rules_{b}')}, 6) AS {n}_delta" for n, a, b in (("recall", "tp", "fn"), ("precision", "tp", "fp"), ("fpr", "fp", "tn")))
        return f" SELECT *, {more} FROM ({inner})"

    return cascade(select, lambda d: llm(d, force))


#: Features of the reduced set that two runs are compared by.
DRIFT = ("has_pw", "body_len", "n_actions", "hidden_iframes", "n_foreign", "title", "turnstile")


def twins(d) -> str:
    """p: per url, features of the last of its pages with a title as they are (st), and of the last of its pages with an advert or a form after
    a simulated rendering (rn); null where there is none. Both feature sets are columns of the page's own row: one scan, one aggregate."""
    last = lambda name, c: f"max_by(CASE WHEN {c} THEN {name} END, CASE WHEN {c} THEN page_id END)"
    rendered = f"replace(html, {d.lit('<div class="ad">')}, {d.lit(C.RENDERED)})"
    kept = "page_id, url, scheme, host, href, etld1" + (", psl" if d.name == "duckdb" else "")
    features = d.struct(**{c: c for c in (*DRIFT, "has_card")})
    return (
        f"WITH {C.urls(d)}, us AS (SELECT {kept}, html, html AS page FROM u), {C.dom(d, 'us', p='s_')}, "
        f"ur AS (SELECT {kept}, page AS html, instr(page, '<title>') > 0 AS as_is, instr(page, '<form') > 0 OR instr(page, 'class=\"ad\"') > 0 AS shown, {features} AS st0 FROM s_f), {C.dom(d, 'ur', html=rendered, p='r_')}, "
        f"p AS (SELECT url, {last('st0', 'as_is')} AS st, {last(features, 'shown')} AS rn FROM r_f GROUP BY url)"
    )


def drift(d):
    both = "st IS NOT NULL AND rn IS NOT NULL"
    count = lambda c, name: f"count(CASE WHEN {c} THEN 1 END) AS {name}"
    counts = [count(both, "joined"), *(count(f"{both} AND st.{c} <> rn.{c}", c) for c in DRIFT), count(f"{both} AND NOT st.has_pw AND rn.has_pw", "password_by_script"), count(f"{both} AND st.n_actions = 0 AND rn.n_actions > 0", "form_by_script"), count(f"{both} AND rn.turnstile AND NOT st.turnstile", "wall_only_rendered"), count("st IS NOT NULL AND rn IS NULL", "only_static"), count("st IS NULL AND rn IS NOT NULL", "only_rendered")]
    return f"{twins(d)} SELECT {', '.join(counts)} FROM p"


def left_join_proxy(d):
    """Pages as they are, with what their rendered twin has, if there is one."""
    rows = d.filter(d.array(d.struct(url="url", has_pw="st.has_pw", rendered_actions="coalesce(CAST(rn.n_actions AS BIGINT), -1)", rendered="rn IS NOT NULL")), "row", "st IS NOT NULL")
    return f"{twins(d)} SELECT e.url AS url, e.has_pw AS has_pw, e.rendered_actions AS rendered_actions, e.rendered AS rendered FROM ({d.unnest(rows, 'p', 'url AS u0', 'e')})"


def union_dedup(d):
    """Names of all urls and hosts, each once, with the first page that has it: both names of a row from one scan."""
    names = d.filter(d.array(normalised(d, "url"), normalised(d, "host")), "nm", "nm IS NOT NULL")
    return f"WITH {C.urls(d)} SELECT domain, min(page_id) AS first_seen, count(*) AS copies FROM ({d.unnest(names, 'u', 'page_id', 'domain')}) GROUP BY domain"


def what_if(d):
    """The scores if sites were allowed afterwards."""
    allow = C.listed(d, "etld1", [*dims.INSTITUTIONS, "evil-1.tk", "gov-tw.com", "paypa1.com"])
    return f", w AS (SELECT label, final, coalesce({allow}, false) AS allowed, CASE WHEN coalesce({allow}, false) THEN 0 ELSE final END AS after FROM m) SELECT {confusion('final', 'before')}, {confusion('after', 'after')}, count(CASE WHEN allowed THEN 1 END) AS short_circuited FROM w"


def pairs(d):
    """Control and adversarial page of a url: whether the second fooled the rules, by either reading of a downgrade."""
    best = lambda part, c: f"max(CASE WHEN part = '{part}' THEN {c} END)"
    rank = "CASE {} WHEN 'safe' THEN 0 WHEN 'caution' THEN 1 WHEN 'suspicious' THEN 2 ELSE 3 END"
    inner = f"SELECT url, {best('control', 'total')} AS control_score, {best('adversarial', 'total')} AS adversarial_score, {best('control', rank.format('verdict'))} AS c, {best('adversarial', rank.format('verdict'))} AS a FROM t GROUP BY url"
    return f" SELECT url, control_score, adversarial_score, adversarial_score < 50 AND control_score - adversarial_score >= 30 AS fooled, adversarial_score < control_score AS score_dropped, a < c AS verdict_dropped, greatest(control_score, adversarial_score) = control_score AS max_held FROM ({inner}) WHERE control_score IS NOT NULL"


#: A service's hits on urls; a stand-in for an external blocklist lookup: url part -> threat.
EXTERNAL = {"evil": "SOCIAL_ENGINEERING", ".tk/": "MALWARE", "acct-": "SOCIAL_ENGINEERING"}


def threats(d) -> str:
    """Threats of the stand-in service for a url, each once, in order, as one text."""
    found = d.distinct(d.map(d.filter(d.entries(EXTERNAL), "kv", "instr(url, kv.key) > 0"), "kv", "kv.value"))
    return d.join(d.sort(found), "|")


def external_rollup(d):
    """Confusion of the external service per part of the corpus and for all of it."""
    return f"WITH {C.corpus(d)}, parts AS (SELECT part, label AS y, {threats(d)} <> '' AS p FROM x) SELECT coalesce(part, 'combined') AS part, {CELLS} FROM parts GROUP BY GROUPING SETS ((part), ())"


def tier_summary(d):
    """Pages caught at 50 and at 85 and emissions per signal, in the evaluation dialect with all signals summed: a row's names, counted in one pass."""
    some = lambda c, name: f"CASE WHEN {c} THEN {d.array(f"'{name}'")} ELSE {d.slice(d.array("''"), '0')} END"
    names = d.concat(d.array("'pages'"), some("total >= 50", "caught_50"), some("total >= 85", "caught_85"), d.map("sig", "e", "e.id"))
    return f"WITH {C.cascade(d, 'eval')} SELECT name, count(*) AS n FROM ({d.unnest(names, 't', 'page_id', 'name')}) GROUP BY name"


#: The feed of the blocklist queries: hosts of the table's own pages that are served without encryption.
def plain_hosts(d) -> str:
    return f"SELECT lower({d.ex('url', '^[Hh][Tt][Tt][Pp]://([^/?#:@]+)')}) AS host FROM pages"


def bloom_bytes(d) -> str:
    """(byte_no, byte_value) of the filter's bytes that have a bit set, after `sized`."""
    value = "CASE pos % 8 WHEN 0 THEN 128 WHEN 1 THEN 64 WHEN 2 THEN 32 WHEN 3 THEN 16 WHEN 4 THEN 8 WHEN 5 THEN 4 WHEN 6 THEN 2 ELSE 1 END"
    return f"SELECT CAST({d.div('pos', '8')} AS BIGINT) AS byte_no, CAST(sum({value}) AS BIGINT) AS byte_value FROM (SELECT DISTINCT pos FROM ({d.unnest('places', 'placed', 'host', 'pos')})) GROUP BY {d.div('pos', '8')}"


def bloom_build(d):
    return f"WITH {sized(d, plain_hosts(d))} {bloom_bytes(d)}"


def bloom_base64(d):
    """The stored form: size, hashes, number of names and all bytes, base64."""
    all_ = d.unnest(d.seq("0", d.div("m", "8") + " - 1"), "sz", "m", "no")
    octet = "lpad(hex(coalesce(byte_value, 0)), 2, '0')" if d.name == "spark" else "printf('%02X', CAST(coalesce(byte_value, 0) AS INTEGER))"
    text = "array_join(transform(array_sort(collect_list(struct(no, o))), e -> e.o), '')" if d.name == "spark" else "string_agg(o, '' ORDER BY no)"
    b64 = f"replace(base64(unhex({text})), '\\r\\n', '')" if d.name == "spark" else f"to_base64(from_hex({text}))"
    return f"WITH {sized(d, plain_hosts(d))}, b AS ({bloom_bytes(d)}), n AS ({all_}), o AS (SELECT n.no AS no, {octet} AS o FROM n LEFT JOIN b ON n.no = b.byte_no) SELECT (SELECT m FROM sz) AS m_bits, (SELECT k FROM sz) AS k_hashes, (SELECT n FROM sz) AS n_inserted, {b64} AS bits_b64 FROM o"


def bloom_probe(d):
    """Every distinct host against the filter, its bits tested in the row."""
    return f"WITH {C.urls(d)}, q AS (SELECT DISTINCT host, CAST(NULL AS {d.text}) AS etld1 FROM ({C.kept(d, 'u', "host <> ''", host='host')}) u1) SELECT host, {C.bloom_hit(d)} AS hit FROM {d.bloomed('q')} q0"


def bloom_audit(d):
    """Names of the feed that its filter misses (none may be), and made-up names that it hits."""
    made = d.unnest(d.seq("1", "1000"), "(SELECT 1 AS one)", "one", "n")
    own = plain_hosts(d)
    q = f"SELECT DISTINCT host, CAST(NULL AS {d.text}) AS etld1, 1 AS own FROM ({own}) f0 WHERE host <> '' UNION ALL SELECT concat('probe-', (n * 2654435761) % 4294967296, '.invalid') AS host, CAST(NULL AS {d.text}) AS etld1, 0 AS own FROM ({made})"
    return f"WITH q AS ({q}), hit AS (SELECT own, {C.bloom_hit(d)} AS hit FROM {d.bloomed('q')} q0) SELECT count(CASE WHEN own = 1 THEN 1 END) AS names, count(CASE WHEN own = 1 AND NOT hit THEN 1 END) AS missed, count(CASE WHEN own = 0 THEN 1 END) AS probes, count(CASE WHEN own = 0 AND hit THEN 1 END) AS false_hits FROM hit"


MIX = "((page_id * 2654435761 % 4294967296 + 4294967296) % 4294967296)"
# Top-level names and brands with a bucket of their own.
BUCKET_TLDS = "tk ml ga cf gq top xyz click zip mov quest".split()
BUCKET_BRANDS = "paypal microsoft apple google amazon".split()


def buckets(d) -> str:
    """Coarse bucket of a url by its host."""
    return f"CASE WHEN host = '' THEN '(unparseable)' WHEN {d.rx('host', '^[0-9.]*[0-9][0-9.]*$')} THEN 'ip-host' WHEN {C.listed(d, "split_part(host, '.', -1)", BUCKET_TLDS)} THEN concat('susp-tld-', split_part(host, '.', -1)) WHEN {d.rx('host', '|'.join(BUCKET_BRANDS))} THEN 'brand-in-host' ELSE 'other' END"


def stratified(wanted: int = 100, harmless: int = 50):
    """A golden set: of the bad pages max(1, wanted / buckets) of each url bucket, at most `wanted` in all, and `harmless` of the others.

    Order is an integer hash. The first `wanted` of each bucket are taken before the buckets are counted, a bound that is known to the plan:
    partitions hand on that many rows a bucket, and the rest goes on with a few hundred rows, from one scan.
    """

    def text(d):
        rows = f"SELECT page_id, label, {MIX} AS mix, CASE WHEN label = 1 THEN {buckets(d)} ELSE 'harmless' END AS bucket FROM u"
        first = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY mix, page_id) AS rn FROM ({rows}) q0) q1 WHERE rn <= {wanted}"
        each = f"CASE WHEN label = 1 THEN greatest(1, {d.div(str(wanted), 'nullif(sum(CASE WHEN label = 1 AND rn = 1 THEN 1 ELSE 0 END) OVER (), 0)')}) ELSE {harmless} END"
        return (
            f"WITH {C.urls(d, mode='eval')}, r AS ({first}), q AS (SELECT *, {each} AS each_ FROM r) SELECT page_id, label, bucket FROM (SELECT page_id, label, bucket, row_number() OVER (PARTITION BY label ORDER BY mix, page_id) AS place FROM q WHERE rn <= each_) q2 WHERE place <= {wanted}"
        )

    return text


def balanced(each: int = 20):
    """The same number of pages of each label, in an order by an integer hash."""
    return lambda d: (f"WITH {C.corpus(d)} SELECT page_id, label FROM (SELECT page_id, label, row_number() OVER (PARTITION BY label ORDER BY mix, page_id) AS rn FROM (SELECT page_id, label, {MIX} AS mix FROM x)) WHERE rn <= {each}")


def misjudged(most: int = 100):
    """The newest misjudged pages, at most `most`."""

    def select(d):
        wrong = C.kept(d, "t", "(label = 1) <> (total >= 50)", page_id="page_id", url="url", verdict="verdict", expected="CASE WHEN label = 1 THEN 'dangerous' ELSE 'safe' END", total="total")
        return f" SELECT * FROM ({wrong}) ORDER BY page_id DESC LIMIT {most}"

    return cascade(select)


def normalised(d, raw: str) -> str:
    """Host of a url or bare name: trimmed, outer dots, scheme and www. gone, lower case; null if it is no name."""
    bare = d.rep(d.rep(f"lower({d.trim(f'trim({raw})', '.')})", r"^[a-z][a-z0-9+.-]*://([^/?#:]*).*$", r"\1" if d.name == "duckdb" else "$1"), r"^www\.", "")
    return f"CASE WHEN instr({bare}, '.') > 0 AND NOT {d.rx(bare, r'[\s/@?]')} THEN {bare} END"


def events(d) -> str:
    since = "(CAST(ts AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ '1970-01-01 00:00:00')"  # the clock as written, whatever the session's zone
    us = "epoch_us(ts)" if d.name == "duckdb" else f"(extract(DAY FROM {since}) * 86400000000L + extract(HOUR FROM {since}) * 3600000000L + extract(MINUTE FROM {since}) * 60000000L + CAST(extract(SECOND FROM {since}) * 1000000 AS BIGINT))"
    return f"ev AS (SELECT event_id, user_id, event_type, value, {us} AS us FROM events)"


ISLANDS = "SELECT user_id, event_id, event_type, us, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 600000000 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)"


IN_FLIGHT, CACHE = 600, 32


def in_flight_oracle(seconds: int = IN_FLIGHT) -> str:
    """q43_in_flight as a fold over each user's whole list (for small tables)."""
    d = Duck()
    state = f"list_reduce(list_prepend({{'us': {-seconds * 1000000}::BIGINT, 'e': 0::BIGINT, 'l': []::BIGINT[]}}, list_sort(list({{'us': us, 'e': event_id, 'l': []::BIGINT[]}}))), lambda s, v: CASE WHEN v.us - s.us >= {seconds * 1000000} THEN {{'us': v.us, 'e': v.e, 'l': list_append(s.l, v.e)}} ELSE s END)"
    return f"WITH {events(d)}, g AS (SELECT user_id, {state} AS st FROM ev GROUP BY user_id), began AS (SELECT user_id, unnest(st.l) AS event_id FROM g) SELECT ev.user_id, CAST(floor(us / 86400000000) AS BIGINT) AS day, count(*) AS calls, count(began.event_id) AS started, max_by(began.event_id, {{'us': us, 'e': ev.event_id}}) FILTER (began.event_id IS NOT NULL) AS last_started FROM ev LEFT JOIN began ON began.user_id = ev.user_id AND began.event_id = ev.event_id GROUP BY ALL"


def cache_oracle(size: int = CACHE) -> str:
    """q45_lru_hits by reuse distance: a hit if fewer than `size` other keys came since the key's last use (for small tables)."""
    return (
        f"WITH {events(Duck())}, r AS (SELECT ev.user_id, props AS k, row_number() OVER (PARTITION BY ev.user_id ORDER BY us, ev.event_id) AS n FROM ev JOIN events e ON e.event_id = ev.event_id AND e.user_id = ev.user_id), "
        f"p AS (SELECT *, lag(n) OVER (PARTITION BY user_id, k ORDER BY n) AS before FROM r), h AS (SELECT p.user_id, p.n, p.before IS NOT NULL AND (SELECT count(DISTINCT q.k) FROM r q WHERE q.user_id = p.user_id AND q.n > p.before AND q.n < p.n) < {size} AS hit FROM p) "
        f"SELECT user_id, count(*) AS lookups, count(*) FILTER (hit) AS hits, least({size}, (SELECT count(DISTINCT k) FROM r WHERE r.user_id = h.user_id)) AS held FROM h GROUP BY user_id"
    )


def by_scheme(d) -> str:
    """Hosts with whether any of their urls is plain http, and any https: both sides of a set operation in one aggregate of one scan."""
    return f", by_scheme AS (SELECT host, max(CASE WHEN scheme = 'http' THEN 1 ELSE 0 END) = 1 AS plain, max(CASE WHEN scheme = 'https' THEN 1 ELSE 0 END) = 1 AS secure FROM u GROUP BY host)"


QUERIES = {
    "q25_confusion": cascade(" " + rates(f"SELECT {CELLS} FROM (SELECT label AS y, total >= 50 AS p FROM t)")),
    "q25_confusion_documents": lambda d: rates(f"SELECT {CELLS} FROM (SELECT toxic AS y, quality = 0 AS p FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"),
    "q25_confusion_verdict": cascade(" " + rates(f"SELECT {CELLS} FROM (SELECT label AS y, verdict IN ('suspicious', 'dangerous') AS p FROM t)")),
    "q26_confusion_variants": cascade(variants),
    "q27_sweep": sweep(FINE),
    "q27_sweep_coarse": sweep(COARSE),
    "q28_bootstrap": bootstrap(),
    "q29_per_signal": per_signal(False),
    "q30_signal_precision": per_signal(True),
    "q31_verdict_hist": cascade(histogram),
    "q32_side_by_side": side_by_side(False),
    "q32_force_model": side_by_side(True),
    "q33_drift": drift,
    "q34_left_join_proxy": left_join_proxy,
    "q35_whatif_allowlist": cascade(what_if, llm),
    "q36_pairs": cascade(pairs),
    "q37_stratified": stratified(),
    "q38_union_dedup": union_dedup,
    "q38_set_difference": lambda d: f"WITH {C.urls(d)}{by_scheme(d)} SELECT host FROM by_scheme WHERE plain AND NOT secure",
    "q38_set_intersect": lambda d: f"WITH {C.urls(d)}{by_scheme(d)} SELECT host FROM by_scheme WHERE plain AND secure",
    "q39_bloom_build": bloom_build,
    "q39_bloom_base64": bloom_base64,
    "q40_bloom_probe": bloom_probe,
    "q40_bloom_probe_feed": bloom_probe,
    "q40_bloom_audit": bloom_audit,
    "q43_debounce": lambda d: f"WITH {events(d)}, i AS ({ISLANDS}), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS burst FROM i) SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS events, max(us) AS run_at, max(event_id) AS last_event FROM s GROUP BY user_id, burst",
    "q44_latest_verdict": lambda d: f"WITH {events(d)}, l AS (SELECT user_id, max_by({d.struct(event_id='event_id', event_type='event_type')}, {d.struct(us='us', e='event_id')}) AS e FROM ev GROUP BY user_id) SELECT user_id, e.event_id AS event_id, e.event_type AS event_type FROM l WHERE e.event_type <> 'error'",
    "q44_sequence_check": lambda d: f"WITH {events(d)} SELECT user_id, max_by(event_id, {d.struct(us='us', e='event_id')}) AS event_id, count(*) AS seq FROM ev GROUP BY user_id",
    "q45_lru": lambda d: f"WITH {events(d)}, k AS (SELECT user_id, value, max(us) AS used, max(event_id) AS e FROM ev GROUP BY user_id, value) SELECT user_id, e AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY used DESC, e DESC) AS rn FROM k) WHERE rn <= 32",
    "q47_subset_rollup": cascade(f" SELECT coalesce(part, 'combined') AS part, {CELLS} FROM (SELECT part, label AS y, total >= 50 AS p FROM t) GROUP BY GROUPING SETS ((part), ())"),
    "q47_external_rollup": external_rollup,
    "q48_misjudgment_top": misjudged(),
    "q50_normalised_domains": lambda d: f"WITH {C.corpus(d)} SELECT DISTINCT {normalised(d, 'url')} AS domain FROM x",
    "q51_balanced_sample": balanced(),
    "q52_submit_histogram": cascade(" SELECT verdict, gate, count(*) AS n FROM t GROUP BY verdict, gate"),
    "q58_tier_summary": tier_summary,
}
