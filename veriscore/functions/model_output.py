"""Model replies: find the first balanced JSON object, repair cut-off ones, validate with defaults."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "risk_score int, verdict string, category array<string>, reasons array<string>, need_visual boolean"
VERDICTS = ("safe", "caution", "suspicious", "dangerous")


def first_object(text: str) -> tuple[str, list[str]] | None:
    """(text from the first brace to its end or the end of text, containers still open)."""
    start = text.find("{")
    if start < 0:
        return None
    open_, quoted, escaped = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
            if not open_:
                return text[start : i + 1], []
    return text[start:] + ('"' if quoted else ""), open_


def load(text: str) -> dict | None:
    found = first_object(text)
    if not found:
        return None
    body, open_ = found
    while body:
        try:
            value = json.loads(body + "".join(reversed(open_)))
            return value if isinstance(value, dict) else None
        except ValueError:
            cut = body.rfind(",")
            if not open_ or cut < 0:
                return None
            found = first_object(body[:cut])
            body, open_ = found if found else ("", [])
    return None


def validated(text: str | None) -> dict | None:
    value = load(text or "")
    if value is None:
        return None
    score, verdict, category, reasons = (value.get(k) for k in ("risk_score", "verdict", "category", "reasons"))
    category = [category] if isinstance(category, str) else category if category is not None else ["other"]
    if not isinstance(score, int) or isinstance(score, bool) or not 0 <= score <= 100 or verdict not in VERDICTS:
        return None
    if not isinstance(category, list) or not 1 <= len(category) <= 4 or not all(isinstance(c, str) and len(c) <= 40 for c in category):
        return None
    reasons = [r[:220] for r in reasons if isinstance(r, str)][:8] if isinstance(reasons, list) else []
    return {"risk_score": score, "verdict": verdict, "category": category, "reasons": reasons or [f"model verdict {verdict}"], "need_visual": value.get("need_visual") is True}


def parse_model_output(df: DataFrame, column: str) -> DataFrame:
    """df with `parsed`: the validated reply, null where nothing valid is found."""

    @F.pandas_udf("string")
    def parse(replies: pd.Series) -> pd.Series:
        return replies.map(lambda t: json.dumps(v) if (v := validated(t)) else None)

    return df.withColumn("parsed", F.from_json(parse(F.col(column)), SCHEMA))
