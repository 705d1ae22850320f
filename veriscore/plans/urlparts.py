"""Parts of a url as columns, in two ways: as a browser normalises it (mode page), and as the offline evaluation splits it (mode eval).

Page: outer blanks, tabs and line ends go; backslashes are slashes; any number of slashes follows a web scheme; the host is percent-decoded,
lower-cased, its wide forms resolved, its invisible characters dropped, its labels beyond ASCII turned into punycode; numbers of any base
and length that end a host are an IPv4 address; a default port goes; dot segments are resolved; the path is percent-encoded. A url that a
browser rejects is not valid: no scheme, an empty web host, characters no host has, a port or an address out of range. Urls of
other schemes are valid whatever follows.

Eval: the text as it is after outer blanks; brackets of an address are dropped, as are parameters of the last segment; valid are urls with
scheme and host whose port is a number up to 65,535.

Each part is a level of its own; the folds run only on urls that need them.
"""

from __future__ import annotations

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
ANY_SCHEME = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):"
#: Schemes whose urls have a host, an authority after any slashes, and a hierarchy of segments.
WEB = "('http', 'https', 'ftp', 'ws', 'wss')"
#: Invisible characters that a browser drops from a host, dots of other scripts, and characters that no host may hold.
DROPPED = "[­​⁠﻿᠋-᠍]"
DOTS = "。．｡"
NO_HOST = "[‎‏‪-‮⁦-⁩\U000e0000-\U000e007f]"
NO_HOST_ASCII = r"[\x00-\x20#/:<>?@\\^|%\x7F\[\]\x22`{}]"
#: What a path holds only percent-encoded.
ENCODED = r"[\x00-\x20\x22<>^`{}\x7F]|[^\x00-\x7F]"
BEYOND_ASCII = r"[^\x00-\x7F]"
NUMERIC_END = r"(^|\.)([0-9]+|0[xX][0-9a-fA-F]*)\.?$"


def number(d, digits: str, base: int) -> str:
    """Value of lower-case digits, cut at a number beyond all addresses."""
    values = d.map(d.filter(d.split(digits, ""), "ch", "ch <> ''"), "ch", "CAST(instr('0123456789abcdef', ch) - 1 AS BIGINT)")
    return d.fold(values, "CAST(0 AS BIGINT)", "acc", "v", f"least(acc * {base} + v, 99999999999)")


def address_numbers(d, host: str) -> str:
    """The numbers of a host that ends in one, each in its own base; null where one is none."""
    one = f"CASE WHEN {d.rx('l', '^0[xX][0-9a-fA-F]*$')} THEN {number(d, 'lower(substring(l, 3))', 16)} WHEN {d.rx('l', '^0[0-7]+$')} THEN {number(d, 'l', 8)} WHEN {d.rx('l', '^(0|[1-9][0-9]*)$')} THEN {number(d, 'l', 10)} END"
    return d.map(d.split(d.rep(host, r"\.$", ""), "."), "l", one)


def dotted(d) -> str:
    """The address of `numbers` in the usual form; null if they are none."""
    n, last = d.size("numbers"), d.last("numbers")
    room = f"CASE {n} WHEN 1 THEN 4294967296 WHEN 2 THEN 16777216 WHEN 3 THEN 65536 ELSE 256 END"
    head = d.fold(d.slice("numbers", f"CAST({n} - 1 AS INT)"), "CAST(0 AS BIGINT)", "acc", "v", "acc * 256 + v")
    small = f"{n} <= 4 AND NOT {d.any('numbers', 'v', 'v IS NULL')} AND NOT {d.any(d.slice('numbers', f'CAST({n} - 1 AS INT)'), 'v', 'v > 255')} AND {last} < {room}"
    value = f"({head} * {room} + {last})"
    octets = ", '.', ".join(f"CAST({d.div(value, str(256**k))} % 256 AS {d.text})" for k in (3, 2, 1, 0))
    return f"CASE WHEN {small} THEN concat({octets}) END"


def without_dots(d, path: str) -> str:
    """A path with its dot segments resolved."""
    double, single = "('..', '.%2e', '%2e.', '%2e%2e')", "('.', '%2e')"
    name = "lower(v[{}])".format(0 if d.name == "spark" else 1)
    segments = d.map(d.split(f"substring({path}, 2)", "/"), "sg", d.array("sg"))
    kept = d.fold(segments, d.slice(d.array("''"), "0"), "acc", "v", f"CASE WHEN {name} IN {double} THEN {d.slice('acc', f'CAST(greatest({d.size("acc")} - 1, 0) AS INT)')} WHEN {name} IN {single} THEN acc ELSE {d.concat('acc', 'v')} END")
    ends = d.rx(path, r"(?i)/(\.|%2e){1,2}$")
    return f"concat({d.rep(f'concat({d.lit("/")}, {d.join(kept, "/")})', '^/$', '')}, CASE WHEN {ends} THEN '/' ELSE '' END)"


def encoded(d, path: str) -> str:
    """A path with what it may not hold percent-encoded."""
    octets = d.rep(f"hex({d.utf8('ch')})", "(..)", "%" + d.ref(1))
    return d.join(d.map(d.all(path, "(?s)."), "ch", f"CASE WHEN {d.rx('ch', ENCODED)} THEN {octets} ELSE ch END"), "")


def page_levels(d, source: str) -> str:
    """c: scheme, auth, host, port, path, href and usable, from url."""
    web = f"scheme IN {WEB}"
    body = d.rep(f"replace({d.ex('clean0', '(?s)^[^:]*:([^?#]*)')}, {d.lit(chr(92))}, '/')", "^/+", "")
    tail = d.ex("clean0", r"(?s)^[^?#]*([?#].*)$")
    mapped = f"translate({d.rep(d.look(d.decoded('host0')), DROPPED, '')}, '{DOTS}', '...')"
    coded = d.join(d.map(d.split("host1", "."), "l", f"CASE WHEN {d.rx('l', BEYOND_ASCII)} THEN {d.to_punycode('l')} ELSE l END"), ".")
    number_of = f"CAST(CASE WHEN length(rawport) BETWEEN 1 AND 9 THEN rawport ELSE '0' END AS BIGINT)"
    default = "scheme IN ('http', 'ws') AND portno = 80 OR scheme IN ('https', 'wss') AND portno = 443 OR scheme = 'ftp' AND portno = 21"
    sound = f"CASE WHEN host2 LIKE '[%' THEN {d.rx('host2', r'^\[[0-9a-f:.]+\]$')} ELSE NOT {d.rx('host2', NO_HOST_ASCII)} AND NOT {d.rx('host1', NO_HOST)} END"
    return (
        f"a0 AS (SELECT *, {d.rep(d.rep('url', r'^[\x00-\x20]+|[\x00-\x20]+$', ''), r'[\t\n\r]', '')} AS clean0 FROM {source}), "
        f"a1 AS (SELECT *, lower({d.ex('clean0', ANY_SCHEME)}) AS scheme FROM a0), "
        f"a2 AS (SELECT *, CASE WHEN {web} THEN concat(scheme, '://', {body}, {tail}) ELSE clean0 END AS clean FROM a1), "
        f"a3 AS (SELECT *, {d.ex('clean', SCHEME + '([^/?#]*)', 2)} AS authority, {d.ex('clean', SCHEME + '[^/?#]*([^?#]*)', 2)} AS rawpath, {d.ex('clean', r'(?s)^[^?#]*([?#].*)$')} AS tail FROM a2), "
        f"a4 AS (SELECT *, {d.rep('authority', '(?s)^.*@', '')} AS hp FROM a3), "
        f"a5 AS (SELECT *, {d.rep('hp', ':[0-9]*$', '')} AS host0, {d.ex('hp', ':([0-9]+)$')} AS rawport, CASE WHEN instr(authority, '@') > 0 THEN substring(authority, 1, length(authority) - length(hp)) ELSE '' END AS userinfo0 FROM a4), "
        f"a6 AS (SELECT *, CASE WHEN host0 LIKE '[%' OR NOT {web} THEN lower(host0) ELSE {mapped} END AS host1, {number_of} AS portno, CASE WHEN userinfo0 IN ('@', ':@') THEN '' ELSE userinfo0 END AS userinfo FROM a5), "
        f"a7 AS (SELECT *, CASE WHEN {web} AND {d.rx('host1', BEYOND_ASCII)} THEN {coded} ELSE host1 END AS host2, {web} AND {d.rx('host1', NUMERIC_END)} AS numeric FROM a6), "
        f"a8 AS (SELECT *, CASE WHEN numeric THEN {address_numbers(d, 'host2')} END AS numbers FROM a7), "
        f"a9 AS (SELECT *, CASE WHEN numeric THEN coalesce({dotted(d)}, '') ELSE host2 END AS host, CASE WHEN {default} THEN '' WHEN rawport = '' THEN '' ELSE CAST(portno AS {d.text}) END AS port, "
        f"CASE WHEN NOT {web} THEN rawpath WHEN {d.rx('rawpath', r'(?i)/(\.|%2e){1,2}(/|$)')} THEN {without_dots(d, 'rawpath')} ELSE rawpath END AS path0 FROM a8), "
        f"a10 AS (SELECT *, CASE WHEN path0 = '' THEN '/' WHEN {web} AND {d.rx('path0', ENCODED)} THEN {encoded(d, 'path0')} ELSE path0 END AS path, "
        f"scheme <> '' AND (NOT {web} OR host <> '' AND {sound} AND length(rawport) <= 9 AND portno <= 65535) AS usable FROM a9), "
        f"c AS (SELECT *, CASE WHEN {web} THEN concat(userinfo, host) ELSE authority END AS auth, CASE WHEN {web} AND usable THEN concat(scheme, '://', userinfo, host, CASE WHEN port = '' THEN '' ELSE concat(':', port) END, path, tail) ELSE clean END AS href FROM a10)"
    )


def eval_levels(d, source: str) -> str:
    """c as the offline evaluation splits urls."""
    host = f"lower(CASE WHEN hp LIKE '[%' THEN {d.ex('hp', r'^\[([^\]]*)')} ELSE {d.ex('hp', '^([^:]*)')} END)"
    portno = "CAST(CASE WHEN length(rawport) BETWEEN 1 AND 9 THEN rawport ELSE '0' END AS BIGINT)"
    return (
        f"a0 AS (SELECT *, {d.rep(d.rep('url', r'^[\x00-\x20]+', ''), r'[\t\n\r]', '')} AS clean FROM {source}), "
        f"a1 AS (SELECT *, lower({d.ex('clean', ANY_SCHEME)}) AS scheme, {d.ex('clean', SCHEME + '([^/?#]*)', 2)} AS auth, {d.ex('clean', SCHEME + '[^/?#]*([^?#]*)', 2)} AS rawpath FROM a0), "
        f"a2 AS (SELECT *, {d.rep('auth', '(?s)^.*@', '')} AS hp FROM a1), "
        f"a3 AS (SELECT *, {host} AS host, {d.ex('hp', r'^(?:\[[^\]]*\]|[^:\[]*):(.*)$')} AS porttext, {d.ex('hp', r'^(?:\[[^\]]*\]|[^:\[]*):([0-9]+)$')} AS rawport FROM a2), "
        f"a4 AS (SELECT *, {portno} AS portno, {d.rep('rawpath', ';[^/]*$', '')} AS path0 FROM a3), "
        f"c AS (SELECT *, CASE WHEN portno = 0 THEN '' ELSE CAST(portno AS {d.text}) END AS port, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path, url AS href, scheme <> '' AND host <> '' AND porttext = rawport AND length(rawport) <= 9 AND portno <= 65535 AS usable FROM a4)"
    )
