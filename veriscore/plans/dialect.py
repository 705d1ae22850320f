"""SQL text for two engines: Spark runs the plans, DuckDB re-runs them as an oracle. Only spelling differs."""

from __future__ import annotations

from . import dims

PLAIN, ALIKE = "аеорсхуαορνιı", "aeopcxyaopvii"  # look-alikes (lower case) and the letters they pass for
WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "abcdefghijklmnopqrstuvwxyz0123456789-")


class Spark:
    name, text, anti = "spark", "STRING", "LEFT ANTI JOIN"
    #: The rest of a tag whose quotes pair up, or of the page; possessive, so that no tag is matched by recursion, and of at most 256 quoted
    #: values, so that quotes that never pair up cost no time beyond that for each tag.
    TAG = r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+){0,256}+(?:>|\z)"

    def __init__(self, lists: dict[str, list[str]] | None = None, feed: str = "", shapes: bool = True):
        """lists: names for the gates by kind, in place of the fixed ones. feed: a query of (host) that the blocklist's filter is made of.
        shapes: whether plans see the shaped pages beside the table's own."""
        self.lists, self.feed, self.shapes = lists or {}, feed, shapes

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    def rx(self, x: str, p: str) -> str:
        return f"regexp_like({x}, {self.lit(p)})"

    def ex(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def rep(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)})"

    def all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, 0)"

    def words(self, items) -> str:
        """Array of fixed words, one literal."""
        return f"split({self.lit('|'.join(items))}, '\\\\|')"

    def map_of(self, pairs: dict[str, str]) -> str:
        """Fixed map, one literal."""
        return f"str_to_map({self.lit('|'.join(f'{k}={v}' for k, v in pairs.items()))}, '\\\\|', '=')"

    def entries(self, pairs: dict[str, str]) -> str:
        """Fixed array of (key, value), in order."""
        return f"map_entries({self.map_of(pairs)})"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(sep if sep.isalnum() or not sep else chr(92) + sep)})"

    def filter(self, a: str, v: str, c: str) -> str:
        return f"filter({a}, {v} -> {c})"

    def map(self, a: str, v: str, c: str) -> str:
        return f"transform({a}, {v} -> {c})"

    def mapi(self, a: str, v: str, i: str, c: str) -> str:
        """Map with an index; only for sorting, so its start is free."""
        return f"transform({a}, ({v}, {i}) -> {c})"

    def first(self, a: str) -> str:
        return f"get({a}, 0)"

    def last(self, a: str) -> str:
        return f"get({a}, size({a}) - 1)"

    def ref(self, n: int) -> str:
        """Group of a pattern in its replacement."""
        return f"${n}"

    def utf8(self, x: str) -> str:
        return f"encode({x}, 'UTF-8')"

    def hash32(self, x: str) -> str:
        """A number below 2^32 from a text."""
        return f"CAST(conv(substring(md5({x}), 1, 8), 16, 10) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"size({a})"

    def slice(self, a: str, n: str) -> str:
        return f"slice({a}, 1, {n})"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def flatten(self, a: str) -> str:
        return f"flatten({a})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def any(self, a: str, v: str, c: str) -> str:
        return f"exists({a}, {v} -> {c})"

    def every(self, a: str, v: str, c: str) -> str:
        return f"forall({a}, {v} -> {c})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def seq(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def even(self, x: str, n: int) -> str:
        return f"bround({x}, {n})"

    def concat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def unnest(self, a: str, source: str, keep: str, name: str) -> str:
        return f"SELECT {keep}, {name} FROM {source} LATERAL VIEW explode({a}) t AS {name}"

    def xor(self, a: str, b: str) -> str:
        return f"({a} ^ {b})"

    def fold(self, a: str, init: str, acc: str, v: str, c: str) -> str:
        return f"aggregate({a}, {init}, ({acc}, {v}) -> {c})"

    def codes(self, x: str) -> str:
        """Code points of an ASCII string, as an array of BIGINT."""
        return f"transform(split({x}, ''), q -> CAST(ascii(q) AS BIGINT))"

    def trim(self, x: str, chars: str) -> str:
        return f"trim(BOTH {self.lit(chars)} FROM {x})"

    def tail(self, x: str, n: int) -> str:
        """The last n labels of a host."""
        return f"substring_index({x}, '.', -{n})"

    def decoded(self, x: str) -> str:
        """Percent-decoded text, the text itself where an escape is malformed."""
        return f"CASE WHEN instr({x}, '%') > 0 THEN coalesce(try_url_decode(replace({x}, '+', '%2B')), {x}) ELSE {x} END"

    def bit(self, words: str, pos: str) -> str:
        """Bit of the filter's bytes, first bit highest."""
        return f"(shiftright(CAST(conv(hex(substring({words}.bits, CAST({pos} div 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(7 - {pos} % 8 AS INT)) & 1)"

    def whole(self, source: str) -> str:
        """source as one input: without the one-row generator, the optimizer would copy all later levels into each branch of a union."""
        return f"SELECT page_id, url, html, label, part FROM {source} LATERAL VIEW explode(array(0)) t AS once"

    def tables(self, source: str) -> str:
        """source with the suffix rules (psl) and the filter's words (bloom) as columns, for the engine that can read them no other way."""
        return source

    def with_suffixes(self, source: str) -> str:
        """source with the suffix rules as a scalar column; read once by the next level, the optimizer moves it to where it is read."""
        return f"(SELECT *, (SELECT rules FROM suffixes) AS psl FROM {source})"

    def bloomed(self, source: str) -> str:
        """with_bloom for a source that does not come from `urls`."""
        return self.with_bloom(source)

    def with_bloom(self, source: str) -> str:
        return f"(SELECT *, (SELECT spec FROM bloom_spec) AS bloom FROM {source})"

    def suffixes_of(self, host: str) -> str:
        """Suffix rules of a host's top-level name."""
        return f"element_at((SELECT rules FROM suffixes), split_part({host}, '.', -1))"

    def punycode(self, x: str) -> str:
        """Unicode form of an xn-- label, the label itself if it is malformed: RFC 3492 as a fold over the coded part."""
        big = lambda v: f"CAST({v} AS BIGINT)"
        digit = "CASE WHEN ch BETWEEN 'a' AND 'z' THEN ascii(ch) - 97 WHEN ch BETWEEN '0' AND '9' THEN ascii(ch) - 22 ELSE 36 END"
        fields = ("n", "i", "o", "w", "k", "b", "out", "ok")
        state = lambda *v: "named_struct(" + ", ".join(f"'{f}', {e}" for f, e in zip(fields, v)) + ")"
        t = "CASE WHEN s.k <= s.b THEN 1 WHEN s.k >= s.b + 26 THEN 26 ELSE s.k - s.b END"
        # One step in three projections: digit and threshold, then the sum, then either the next place or the next character.
        size = big("size(z.out) + 1")
        delta = f"aggregate(array(CASE WHEN z.o = 0 THEN (z.i - z.o) div 700 ELSE (z.i - z.o) div 2 END), {big(0)}, (q, v) -> v + v div {size})"
        bias = f"aggregate(sequence(1, 8), named_struct('d', {delta}, 'k', {big(0)}), (q, v) -> CASE WHEN q.d > 455 THEN named_struct('d', q.d div 35, 'k', q.k + 36) ELSE q END, q -> q.k + 36 * q.d div (q.d + 38))"
        done = state(f"z.n + z.i div {size}", f"z.i % {size} + 1", f"z.i % {size} + 1", big(1), big(36), bias, f"concat(slice(z.out, 1, CAST(z.i % {size} AS INT)), array(z.n + z.i div {size}), slice(z.out, CAST(z.i % {size} + 1 AS INT), size(z.out) + 1))", "z.ok")
        more = state("z.n", "z.i", "z.o", "z.w * (36 - z.t)", "z.k + 36", "z.b", "z.out", "z.ok")
        first = f"named_struct('d', {big(digit)}, 't', {big(t)}, 's', s)"
        second = "transform(array(" + first + "), y -> named_struct('n', y.s.n, 'i', y.s.i + y.d * y.s.w, 'o', y.s.o, 'w', y.s.w, 'k', y.s.k, 'b', y.s.b, 'out', y.s.out, 'ok', y.s.ok AND y.d < 36, 'd', y.d, 't', y.t))"
        step = f"CASE WHEN s.ok AND s.i < 1000000000000 THEN get(transform({second}, z -> CASE WHEN z.d < z.t THEN {done} ELSE {more} END), 0) ELSE s END"
        rest = f"substring({x}, 5)"
        basic = f"CASE WHEN instr(substring({rest}, 2), '-') > 0 THEN regexp_extract({rest}, '^(.+)-[^-]*$', 1) ELSE '' END"
        coded = f"CASE WHEN instr(substring({rest}, 2), '-') > 0 THEN regexp_extract({rest}, '-([^-]*)$', 1) ELSE {rest} END"
        start = state(big(128), big(0), big(0), big(1), big(36), big(72), f"transform(filter(split({basic}, ''), q -> q <> ''), q -> CAST(ascii(q) AS BIGINT))", "true")
        text = "decode(unhex(array_join(transform(s.out, q -> lpad(hex(q), 8, '0')), '')), 'UTF-32')"
        return f"aggregate(filter(split({coded}, ''), q -> q <> ''), {start}, (s, ch) -> {step}, s -> CASE WHEN s.ok AND s.k = 36 AND NOT exists(s.out, q -> q > 1114111 OR q BETWEEN 55296 AND 57343) THEN {text} ELSE {x} END)"

    def to_punycode(self, x: str) -> str:
        """xn-- form of a label beyond ASCII: RFC 3492. Its other characters, by code point and place, are what the fold goes over: each is
        inserted among those before it, so a step needs only how many of them stand left of it."""
        big = lambda v: f"CAST({v} AS BIGINT)"
        point = "CAST(conv(hex(encode(q, 'UTF-32')), 16, 10) AS BIGINT)"
        chars = f"transform(regexp_extract_all({x}, '(?s).', 0), (q, i) -> named_struct('c', {point}, 'i', {big('i')}))"
        state = lambda n, i, h, b, out: f"named_struct('n', {n}, 'i', {i}, 'h', {h}, 'b', {b}, 'out', {out})"
        digit = "substring('abcdefghijklmnopqrstuvwxyz0123456789', CAST({} + 1 AS INT), 1)"
        t = "least(greatest(k * 36 - s.b, 1), 26)"
        # The delta's digits, lowest first; w.done once the last is out.
        spelled = (
            "aggregate(sequence(1, 8), named_struct('q', y.delta, 'out', '', 'done', false), (w, k) -> CASE WHEN w.done THEN w "
            f"WHEN w.q < {t} THEN named_struct('q', {big(0)}, 'out', concat(w.out, {digit.format('w.q')}), 'done', true) "
            f"ELSE named_struct('q', {big(f'(w.q - {t}) div (36 - {t})')}, 'out', concat(w.out, {digit.format(f'({t} + (w.q - {t}) % (36 - {t}))')}), 'done', false) END, w -> w.out)"
        )
        first = f"(CASE WHEN s.h = y.basic THEN y.delta div 700 ELSE y.delta div 2 END)"
        grown = f"({first} + {first} div (s.h + 1))"
        bias = f"aggregate(sequence(1, 8), named_struct('d', {big(grown)}, 'k', {big(0)}), (q, v) -> CASE WHEN q.d > 455 THEN named_struct('d', q.d div 35, 'k', q.k + 36) ELSE q END, q -> {big('q.k + 36 * q.d div (q.d + 38)')})"
        left = "size(filter(y0.all, e -> e.i < v.i AND (e.c < v.c OR e.c = v.c)))"
        delta = "(v.c - s.n) * (s.h + 1) + x0 - s.i"
        inner = f"transform(array(named_struct('delta', {big(delta)}, 'basic', {big('y0.basic')}, 'at', {big('x0')})), y -> {state('v.c', 'y.at + 1', 's.h + 1', bias, f'concat(s.out, {spelled})')})"
        step = f"get(get(transform(array({big(left)}), x0 -> {inner}), 0), 0)"
        basic = "filter(y0.all, e -> e.c < 128)"
        start = state(big(128), big(0), big("y0.basic"), big(72), "''")
        others = "array_sort(filter(y0.all, e -> e.c >= 128))"
        head = f"CASE WHEN y0.basic > 0 THEN concat(array_join(transform({basic}, e -> chr(e.c)), ''), '-') ELSE '' END"
        whole = f"concat('xn--', {head}, aggregate({others}, {start}, (s, v) -> {step}, s -> s.out))"
        held = f"named_struct('all', ch, 'basic', {big('size(filter(ch, e -> e.c < 128))')})"
        return f"get(transform(transform(array({chars}), ch -> {held}), y0 -> {whole}), 0)"

    def look(self, x: str) -> str:
        """A label in plain letters: lower case, wide forms and ligatures resolved."""
        return f"replace(replace(translate(lower({x}), {self.lit(WIDE)}, 'abcdefghijklmnopqrstuvwxyz0123456789-'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"

    def folded(self, x: str) -> str:
        return f"translate({x}, {self.lit(PLAIN)}, {self.lit(ALIKE)})"


#: Labels of the shaped pages in Unicode, for the engine without a decoder.
DECODED = {"xn--pple-43d": "аpple", "xn--pypal-4ve": "pаypal", "xn--mnchen-3ya": "münchen"}


class Duck(Spark):
    name, text, anti = "duckdb", "VARCHAR", "ANTI JOIN"
    TAG = r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*){0,256}(?:>|\z)"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def rx(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.lit(p)})"

    def rep(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)}, 'g')"

    def all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)})"

    def words(self, items) -> str:
        return f"string_split({self.lit('|'.join(items))}, '|')"

    def map_of(self, pairs: dict[str, str]) -> str:
        return f"map_from_entries({self.entries(pairs)})"

    def entries(self, pairs: dict[str, str]) -> str:
        return f"list_transform(string_split({self.lit('|'.join(f'{k}={v}' for k, v in pairs.items()))}, '|'), lambda pq: {{'key': split_part(pq, '=', 1), 'value': split_part(pq, '=', 2)}})"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep)})"

    def filter(self, a: str, v: str, c: str) -> str:
        return f"list_filter({a}, lambda {v}: {c})"

    def map(self, a: str, v: str, c: str) -> str:
        return f"list_transform({a}, lambda {v}: {c})"

    def mapi(self, a: str, v: str, i: str, c: str) -> str:
        return f"list_transform({a}, lambda {v}, {i}: {c})"

    def first(self, a: str) -> str:
        return f"({a})[1]"

    def last(self, a: str) -> str:
        return f"({a})[len({a})]"

    def ref(self, n: int) -> str:
        return f"\\{n}"

    def utf8(self, x: str) -> str:
        return f"encode({x})"

    def hash32(self, x: str) -> str:
        return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"len({a})"

    def slice(self, a: str, n: str) -> str:
        return f"list_slice({a}, 1, {n})"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def any(self, a: str, v: str, c: str) -> str:
        return f"(len(list_filter({a}, lambda {v}: {c})) > 0)"

    def every(self, a: str, v: str, c: str) -> str:
        return f"(len(list_filter({a}, lambda {v}: NOT ({c}))) = 0)"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def seq(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def even(self, x: str, n: int) -> str:
        return f"round_even({x}, {n})"

    def concat(self, *arrays: str) -> str:
        out = arrays[0]
        for a in arrays[1:]:
            out = f"list_concat({out}, {a})"
        return out

    def unnest(self, a: str, source: str, keep: str, name: str) -> str:
        return f"SELECT {keep}, unnest({a}) AS {name} FROM {source}"

    def xor(self, a: str, b: str) -> str:
        return f"xor({a}, {b})"

    def fold(self, a: str, init: str, acc: str, v: str, c: str) -> str:
        return f"list_reduce(list_prepend({init}, {a}), lambda {acc}, {v}: {c})"

    def codes(self, x: str) -> str:
        return f"list_transform(string_split({x}, ''), lambda q: CAST(ascii(q) AS BIGINT))"

    def trim(self, x: str, chars: str) -> str:
        return f"trim({x}, {self.lit(chars)})"

    def tail(self, x: str, n: int) -> str:
        return f"array_to_string(list_reverse(list_slice(list_reverse(string_split({x}, '.')), 1, {n})), '.')"

    def decoded(self, x: str) -> str:
        return f"CASE WHEN instr({x}, '%') > 0 THEN url_decode({x}) ELSE {x} END"

    def bit(self, words: str, pos: str) -> str:
        return f"(({words}.words[CAST({pos} // 32 AS INTEGER) + 1] >> (31 - {pos} % 32)) & 1)"

    def with_suffixes(self, source: str) -> str:
        return source

    def with_bloom(self, source: str) -> str:
        return source

    def suffixes_of(self, host: str) -> str:
        return f"psl[split_part({host}, '.', -1)]"

    def whole(self, source: str) -> str:
        return f"SELECT * FROM {source}"

    def bloomed(self, source: str) -> str:
        return self.tables(source)

    def tables(self, source: str) -> str:
        from .blocklist import filter_words, planned_names, sizing, words_of

        bits, hashes = sizing(planned_names(len(dims.BLOCKLIST)))
        fixed = f"SELECT {{'words': [{', '.join(map(str, words_of(dims.BLOCKLIST)))}], 'm': {bits}, 'k': {hashes}}} AS bloom"
        bloom = f"SELECT {{'words': words, 'm': m, 'k': k}} AS bloom FROM ({filter_words(self, self.feed)})" if self.feed else fixed
        return f"(SELECT * FROM {source} CROSS JOIN (SELECT {self.map_of(dims.suffix_rules())} AS psl) CROSS JOIN ({bloom}))"

    def to_punycode(self, x: str) -> str:
        return f"CASE {x} " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in DECODED.items()) + f" ELSE {x} END"

    def punycode(self, x: str) -> str:
        return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DECODED.items()) + f" ELSE {x} END"
