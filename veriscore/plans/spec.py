"""Declared signals with weights, caps and score bands (fixed values that results depend on)."""

# Signal id -> weight.
URL_SIGNALS = {
    "url.ip_as_host": 30, "url.userinfo_at": 25, "url.nonstandard_port": 8, "url.long": 6, "url.many_hyphens": 4, "url.many_subdomains": 7, "url.high_entropy_path": 10, "url.double_encoded": 12,
    "url.punycode_label": 8, "url.punycode_brand_lookalike": 35, "url.mixed_script_label": 20,
    "url.typosquat_brand": 25, "url.subdomain_brand_abuse": 35, "url.path_brand_abuse": 5,
    "url.tld_high_risk": 25, "url.tld_medium_risk": 12, "url.tld_low_risk": 5,
    "url.gov_tw_substring_abuse": 40, "url.gov_tw_pseudo_tld": 35, "url.gov_tw_hyphen_variant": 30,
    "url.reverse_proxy_fqdn": 45, "url.reverse_proxy_hyphen_fqdn": 40, "url.phishlet_endpoint": 30,
    "url.zero_width_in_host": 35, "url.zero_width_in_url": 21, "url.bidi_override_in_host": 40, "url.bidi_override_in_url": 28, "url.tag_char_in_url": 35,
    "url.bloomfilter_blacklist_hit": 95,
}
DOM_SIGNALS = {
    "dom.password_no_tls": 25, "dom.password_cross_etld1_post": 35, "dom.otp_cross_etld1_post": 25, "dom.card_cross_etld1_post": 30, "dom.card_and_password": 12,
    "dom.tw_pii_combo": 35, "dom.tw_national_id_cross_etld1_post": 30, "dom.hidden_iframes": 6, "dom.tiny_interactive": 4, "dom.many_foreign_scripts": 8, "dom.anti_debug": 5, "dom.seed_phrase_grid": 45,
    "dom.cross_strait_terms": 25, "dom.cross_strait_terms_strong": 35, "dom.cloaking_verify_wall": 18, "dom.cloaking_verify_wall_strong": 30,
    "dom.favicon_brand_cdn_mismatch": 35, "dom.favicon_brand_canonical_mismatch": 35, "dom.zero_width_in_text": 12, "dom.bidi_override_in_text": 25, "dom.tag_char_in_text": 25,
}
MARKERS = ("url.parse_failed", "url.allowlist_hit", "url.tw_institutional_tld", "url.tw_allowlist_hit", "url.user_allowlist_hit", "dom.oauth_idp_allowlisted", "llm.score", "llm.unavailable")
WEIGHTS = URL_SIGNALS | DOM_SIGNALS | dict.fromkeys(MARKERS, 0)
HIDDEN_IFRAMES_CAP, TINY_CAP = 20, 16
DANGEROUS, SUSPICIOUS, SAFE = 85, 50, 15
ANCHOR = 75


def weight(signal: str) -> int:
    """Weight of a declared signal; unknown ids are an error when the plan is built."""
    return WEIGHTS[signal]
