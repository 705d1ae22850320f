"""Queries over page rules, gates, scores and explanations. Each is SQL text for both engines: name -> function of a dialect."""

from __future__ import annotations

from ..plans import corpus as C
from ..plans import dims


def picked(rules, *ids):
    return [r for r in rules if r[0].split(".", 1)[1].startswith(ids)]


def exploded(d, array: str, source: str) -> str:
    return f"SELECT page_id, e.id AS id, e.weight AS weight, e.detail AS detail FROM ({d.unnest(array, source, 'page_id', 'e')})"


def url_signals(*ids):
    """Long rows of the url signals whose names start with one of ids."""

    def text(d):
        before, after = C.url_rules(d)
        return f"WITH {C.urls(d)}, {C.facts(d)} {exploded(d, C.fired(d, 'stage1', picked(before + after, *ids)), 'v')}"

    return text


def dom_signals(*ids):
    return lambda d: f"WITH {C.features(d)} {exploded(d, C.fired(d, 'stage2', picked(C.dom_rules(d), *ids)), 'h')}"


def cascade(select, more=lambda d: ""):
    return lambda d: f"WITH {C.cascade(d)}{more(d)} {select if isinstance(select, str) else select(d)}"


#: Stand-in for the model's score of a grey-band page: a pure function of what the model would see.
LLM = "CASE WHEN total BETWEEN 15 AND 84 THEN (body_len * 37 + length(url) + total) % 101 END"


def llm(d, force: bool = False):
    """m: t with the model's score and the merged result; the model can only raise a score. force asks for every page that no gate stopped."""
    score = LLM.replace("total BETWEEN 15 AND 84", "NOT short") if force else LLM
    return f", m0 AS (SELECT *, {score} AS llm_score FROM t), m AS (SELECT *, CAST(greatest(total, coalesce(llm_score, 0)) AS BIGINT) AS final FROM m0)"


def texts(d, array: str, item: str, sep: str) -> str:
    return d.join(d.map(array, "e", item), sep)


#: Lines of the three prompts (title, signals, text, and what stands for nothing), most signals, most characters.
PROMPTS = {
    "v1": ("Page title: ", "Rule-layer signals already detected:", "Visible page text (truncated):", "(none)", "(empty)", 12, 1500),
    "v2": ("Page title: ", "Rule-layer signals already detected:", "Visible page text (truncated, 繁中 / 簡中 / 英文 mixed):", "(none)", "(empty)", 14, 1500),
    "v3": ("頁面標題: ", "規則層已觸發的訊號:", "頁面可見文字 (可能含繁中/簡中/英文混合):", "(無)", "(空)", 8, 1200),
}
#: Lines of the second try.
RETRY = ("Your previous reply was not valid JSON matching the schema.", "Previous reply:", "", "Output ONLY the JSON object now — no surrounding text, no markdown fences. category MUST be a JSON array of strings.")


def prompt_text(d, version: str) -> str:
    title, signals, text, none, empty, most, chars = PROMPTS[version]
    lines = texts(d, d.slice("sig", str(most)), "concat('- ', e.id, ' (+', e.weight, ')', CASE WHEN e.detail <> '' THEN concat(': ', e.detail) ELSE '' END)", "\n")
    nl = d.lit("\n")
    return f"concat('URL: ', url, {nl}, 'eTLD+1: ', coalesce(etld1, '(unknown)'), {nl}, {d.lit(title)}, CASE WHEN title = '' THEN {d.lit(none)} ELSE title END, {nl}, {d.lit(signals)}, {nl}, CASE WHEN {d.size('sig')} = 0 THEN {d.lit(none)} ELSE {lines} END, {nl}, {d.lit(text)}, {nl}, CASE WHEN text = '' THEN {d.lit(empty)} ELSE substring(text, 1, {chars}) END)"


def retry_text(d, reply: str) -> str:
    head, prev, blank, tail = (d.lit(x) for x in RETRY)
    nl = d.lit("\n")
    return f"concat({head}, {nl}, {prev}, {nl}, substring({reply}, 1, 600), {nl}, {blank}, {nl}, {tail})"


def reasons(d):
    """Every signal's plain text, its detail, or its id."""
    known = f"{d.map_of(dims.SIGNAL_TEXT)}[e.id]"
    detail = "CASE WHEN e.detail <> '' THEN e.detail ELSE e.id END"
    return f"SELECT page_id, verdict, total, {texts(d, 'sig', detail, '; ')} AS reasons, {texts(d, 'sig', f'coalesce({known}, {detail})', '; ')} AS shown FROM t"


def with_model_signals(d):
    """Signals with those of the model: one per reason of its reply, and its score, or a mark that there was none. The reply is a stand-in."""
    sig = lambda key, weight, detail: C.signal(d, "stage3", key, weight, detail)
    given = d.concat(d.map(d.filter(d.words(["asks for credentials", "names a brand"]), "r", "has_pw OR r <> 'asks for credentials'"), "r", sig("concat('llm.', CASE WHEN has_pw THEN 'credential' ELSE 'other' END)", "0", "r")), d.array(sig("'llm.score'", "llm_score", "concat('score ', llm_score)")))
    missing = d.array(sig("'llm.unavailable'", "0", "'no reply'"))
    all_ = f"CASE WHEN llm_score IS NULL THEN sig WHEN llm_score % 7 = 0 THEN {d.concat('sig', missing)} ELSE {d.concat('sig', given)} END"
    return f"SELECT page_id, {texts(d, 'all_', "concat(e.stage, ' ', e.id, '+', e.weight)", '|')} AS signals, {d.size('all_')} AS n FROM (SELECT page_id, {all_} AS all_ FROM m)"


def top_evidence(d):
    shown = d.filter("sig", "e", "e.weight > 0 OR e.id LIKE 'dom.%' OR e.id LIKE 'url.%'")
    ranked = d.sort(d.mapi("shown", "e", "i", d.struct(w="-e.weight", o="CAST(i AS BIGINT)", id="e.id", detail="e.detail")))
    return f"SELECT page_id, e.id AS id, -e.w AS weight, e.detail AS detail, remaining FROM ({d.unnest(d.slice('ranked', '4'), f'(SELECT page_id, CAST(n - least(n, 4) AS BIGINT) AS remaining, ranked FROM (SELECT page_id, {d.size("shown")} AS n, {ranked} AS ranked FROM (SELECT page_id, {shown} AS shown FROM t) s1) s2)', 'page_id, remaining', 'e')})"


def stage_groups(d):
    of = lambda s: d.filter("sig", "e", f"e.stage = '{s}'")
    rows = d.array(*(d.struct(stage=f"'{s}'", n=f"CAST({d.size(of(s))} AS BIGINT)", ids=texts(d, of(s), "e.id", "|")) for s in ("stage1", "stage2")))
    return f"SELECT page_id, e.stage AS stage, e.n AS n, e.ids AS ids FROM ({d.unnest(d.filter(rows, 'g', 'g.n > 0'), 't', 'page_id', 'e')})"


def toolbar(d):
    case = lambda i: "CASE state " + " ".join(f"WHEN '{k}' THEN {d.lit(v[i])}" for k, v in dims.TOOLBAR.items()) + " END"
    state = "CASE WHEN gate = 'url.parse_failed' THEN 'error' WHEN NOT short AND total BETWEEN 15 AND 84 AND llm_score IS NULL THEN 'analyzing' ELSE verdict END"
    return f"SELECT state, {case(0)} AS badge, {case(1)} AS colour, count(*) AS pages FROM (SELECT {state} AS state FROM m) GROUP BY state"


def scaffold(d):
    """Minimal html that has a page's features, and the features found in it again."""
    part = lambda c, h: f"CASE WHEN {c} THEN {d.lit(h)} ELSE '' END"
    html = (
        f"concat('<title>', title, '</title><form action=\"', CASE WHEN cross_site IS NULL THEN '' ELSE concat('https://', cross_site, '/') END, '\">', {part('has_pw', '<input type="password">')}, {part('has_otp', '<input name="otp">')}, {part('has_card', '<input name="cvv">')}, "
        f"{part('has_id', '<input name="idno">')}, '</form>', {part('turnstile', '<div class="cf-turnstile"></div>')}, {part('hcaptcha', '<div class="h-captcha"></div>')}, CASE WHEN icon_site IS NULL THEN '' ELSE concat('<link rel=\"icon\" href=\"https://', icon_site, '/i.ico\">') END, '<p>', text, '</p>')"
    )
    return html


def rebuilt(d):
    psl = ", psl" if d.name == "duckdb" else ""
    again = C.dom(d, "s0", p="k_")
    return f"WITH {C.features(d)}, s0 AS (SELECT page_id, scheme, host, href, etld1{psl}, {scaffold(d)} AS html FROM h), {again} SELECT page_id, has_pw, has_otp, has_card, has_id, turnstile, hcaptcha, title, coalesce(icon_site, '') AS icon_site, {texts(d, 'cross_sites', 'e', '|')} AS cross_sites FROM k_f"


def plain_text(d):
    """Text for a model: html without tags, white space collapsed, 2,500 characters."""
    return f"WITH {C.corpus(d)} SELECT page_id, substring(trim({d.rep(d.rep(d.rep('html', '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' '), '<[^>]+>', ' '), r'\s+', ' ')}), 1, 2500) AS text FROM x"


SIGNALS_TEXT = "concat(e.id, '+', e.weight)"
QUERIES = {
    "q01_url_parse": lambda d: f"WITH {C.urls(d)} SELECT page_id, url, scheme, host, port, path, is_ip, valid FROM u",
    "q02_etld1": lambda d: f"WITH {C.urls(d)} SELECT page_id, host, coalesce(etld1, '') AS etld1, label_part AS domain_label, subdomain FROM u",
    "q03_url_struct_signals": url_signals("ip_as", "userinfo", "nonstandard", "long", "many_", "high_entropy", "double"),
    "q04_tld_risk": url_signals("tld_"),
    "q05_typosquat": url_signals("typosquat"),
    "q06_subdomain_brand": url_signals("subdomain_brand"),
    "q07_path_brand": url_signals("path_brand"),
    "q08_gov_spoof": url_signals("gov_tw"),
    "q09_reverse_proxy": url_signals("reverse_proxy"),
    "q10_phishlet": url_signals("phishlet"),
    "q11_unicode_url": url_signals("zero_width", "bidi", "tag_char"),
    "q12_gates": lambda d: f"WITH {C.urls(d)} SELECT page_id, {C.gate(d)} AS gate FROM {d.with_bloom('u')} u0",
    "q13_stage1": lambda d: f"WITH {C.stage1(d)} SELECT page_id, gate, s1, gate <> '' OR s1 >= 85 AS short, {C.verdict('s1')} AS stage1_verdict FROM g1",
    "q14_dom_features": lambda d: f"WITH {C.features(d)} SELECT page_id, title, body_len, has_pw, has_otp, has_card, has_id, seed_grid, sensitive_form, hidden_iframes, tiny_elements, anti_debug, turnstile, hcaptcha, n_actions, coalesce(cross_site, '') AS cross_site, n_idp, n_foreign, coalesce(icon_site, '') AS icon_site FROM h",
    "q15_stage2_forms": dom_signals("oauth", "password", "otp", "card", "tw_", "seed"),
    "q16_stage2_structure": dom_signals("hidden", "tiny", "many_foreign", "anti_debug"),
    "q17_cross_strait": dom_signals("cross_strait"),
    "q18_cloaking": dom_signals("cloaking"),
    "q19_favicon": dom_signals("favicon"),
    "q20_unicode_text": dom_signals("zero_width", "bidi", "tag_char"),
    "q21_cascade": cascade(lambda d: f"SELECT page_id, url, gate, s1, s2, total, verdict, {texts(d, 'sig', SIGNALS_TEXT, '|')} AS signals FROM t"),
    "q22_llm_merge": cascade("SELECT page_id, total, CAST(coalesce(llm_score, -1) AS BIGINT) AS llm_score, final, " + C.verdict("final") + " AS final_verdict, CASE WHEN total NOT BETWEEN 15 AND 84 THEN '' WHEN llm_score IS NULL THEN 'llm.unavailable' ELSE 'llm.score' END AS llm_marker FROM m", llm),
    "q22_llm_signals": cascade(with_model_signals, llm),
    "q23_anchor_submit": cascade("SELECT page_id, anchored, sensitive_form, CASE WHEN verdict = 'dangerous' AND anchored THEN 'block' WHEN verdict IN ('dangerous', 'suspicious') THEN 'confirm' ELSE 'none' END AS action, scheme IN ('http', 'https') AND (gate = 'url.bloomfilter_blacklist_hit' OR s1 >= 85) AS block_before_load FROM (SELECT *, s1 + s2 >= 75 AS anchored FROM t)"),
    "q24_top4_evidence": cascade(top_evidence),
    "q49_stage_group": cascade(stage_groups),
    "q41_prompt": cascade(lambda d: C.kept(d, "t", "NOT short AND total BETWEEN 15 AND 84", page_id="page_id", v1=prompt_text(d, "v1"), v2=prompt_text(d, "v2"), v3=prompt_text(d, "v3"), retry=retry_text(d, "title"))),
    "q53_toolbar_state": cascade(toolbar, llm),
    "q54_reasons": cascade(reasons),
    "q55_eval_dialect": lambda d: f"WITH {C.cascade(d, 'eval')} SELECT page_id, gate, s1, s2, total, verdict, {texts(d, 'sig', SIGNALS_TEXT, '|')} AS signals FROM t",
    "q56_scaffold": rebuilt,
    "q57_plain_text": plain_text,
}
#: The gates, scores and cascade with a filter of run time, built from the hosts of a given table.
QUERIES |= {f"{name}_feed": QUERIES[name] for name in ("q12_gates", "q13_stage1", "q21_cascade")}
