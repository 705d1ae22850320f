"""Punycode and look-alike checks of host labels; the decoder has no Spark builtin, so one Arrow function does it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans import dims
from ..plans.spec import weight

# Look-alikes and the letters they pass for.
CONFUSABLES = str.maketrans(
    dict(zip("аеорсхуАВЕКМНОРСТХαορνιı", "aeopcxyABEKMHOPCTXaopvii")) | {"ﬁ": "fi", "ﬂ": "fl"}
)
# Code point ranges of scripts.
SCRIPTS = {"latin": ((0x41, 0x5A), (0x61, 0x7A)), "cyrillic": ((0x400, 0x4FF),), "greek": ((0x370, 0x3FF),), "han": ((0x4E00, 0x9FFF),), "kana": ((0x3040, 0x309F), (0x30A0, 0x30FF)), "hangul": ((0xAC00, 0xD7A3),)}
LABELS = frozenset(b.split(".")[0] for b in dims.BRANDS)


def script_of(c: str) -> str:
    return next((name for name, ranges in SCRIPTS.items() if any(a <= ord(c) <= b for a, b in ranges)), "other")


def decode_label(label: str) -> str:
    """Unicode form of an xn-- label, the label itself if it is malformed."""
    if not label.startswith("xn--"):
        return label
    try:
        return label[4:].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError, IndexError):
        return label


def mixed_script(label: str) -> bool:
    """Latin with Cyrillic or Greek, or the latter two, in one label that is not plain ASCII."""
    found = {script_of(c) for c in label}
    return not label.isascii() and ("latin" in found and bool(found & {"cyrillic", "greek"}) or {"cyrillic", "greek"} <= found)


def looks_like_brand(label: str) -> bool:
    plain = unicodedata.normalize("NFKC", label.lower())
    folded = plain.translate(CONFUSABLES).lower()
    return folded in LABELS and plain not in LABELS


def label_signals(host: str | None) -> list[str]:
    out = []
    for label in (host or "").split("."):
        shown = decode_label(label)
        if label.startswith("xn--"):
            out.append("url.punycode_label")
            if looks_like_brand(shown):
                out.append("url.punycode_brand_lookalike")
        if mixed_script(label):
            out.append("url.mixed_script_label")
    return out


def punycode_signals(hosts: DataFrame) -> DataFrame:
    """(page_id, host, id, weight), one row per signal of (page_id, host)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, h, s, weight(s)) for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in label_signals(h)]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "host", "id", "weight"])

    return hosts.select("page_id", "host").mapInArrow(run, "page_id long, host string, id string, weight long")
