"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document gets its word counts, base rules and soft rules (symbols for words, repeated lines, word length). A soft rule has two
degrees: a document fails it outright, or comes near failing. Per host (the `source` column) and soft rule, failures of either degree
are added up, and the rate is shrunk towards all hosts' rates by a beta prior fitted to them (moments). A host whose shrunk rate
lies above the prior's mean is strict for the rule. Documents that fail the base rules or a soft rule outright go on any host; those
that come near one go on the hosts that are strict for it, where the host's record speaks against them. A host whose shrunk rate of
any outright failure reaches nine tenths is blocked whole. The table and the pipeline's stage judge alike.

Null text has no words and fails the base rules; null source is a host of its own; repeated rows count each. Windows of
three words are compared by a 64-bit hash. The prior is six numbers, read to the driver; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_split, staged

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Soft rules: symbols for words, repeated lines, word length.
SOFT = ("symbols", "lines", "length")
#: Shrunk rate of outright failures at which a host is blocked, and how far above the prior's mean a strict host's rate lies.
BLOCKED, ABOVE = 0.9, 1e-9


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def quality_features(docs: DataFrame) -> DataFrame:
    """docs (text, …) with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _base_failed, _fail_<rule> and _near_<rule>."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, SPACE)) > 0)
    first = docs.select(
        "*",
        words.alias("_words"),
        lines.alias("_lines"),
        F.length(_without(text, SPACE)).cast("long").alias("_word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("_n_symbols"),
    )
    w, n = F.col("_words"), F.size("_words")
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<long>"))
    second = first.select("*", n.cast("long").alias("_n_words"), F.size("_lines").alias("_n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"), grams.alias("_grams")).drop("_words", "_lines")
    g = F.col("_grams")
    third = second.withColumn("_sorted", F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:long,i:int>>"))).drop("_grams")
    s = F.col("_sorted")
    again = F.filter(s, lambda e, j: (F.get(s, j - 1)["g"] == e["g"]) | (F.get(s, j + 1)["g"] == e["g"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    fourth = third.withColumn("_n_repeat_words", covered.cast("long")).drop("_sorted")
    return fourth.select(
        "*",
        ((F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))).alias("_base_failed"),
        (10 * F.col("_n_symbols") > F.col("_n_words")).alias("_fail_symbols"),
        ((F.col("_n_dup_lines") >= 3) & (4 * F.col("_n_dup_lines") > F.col("_n_lines"))).alias("_fail_lines"),
        ((F.col("_word_chars") < 2 * F.col("_n_words")) | (F.col("_word_chars") > 20 * F.col("_n_words"))).alias("_fail_length"),
        (20 * F.col("_n_symbols") > F.col("_n_words")).alias("_near_symbols"),
        ((F.col("_n_dup_lines") >= 3) & (8 * F.col("_n_dup_lines") > F.col("_n_lines"))).alias("_near_lines"),
        ((2 * F.col("_word_chars") < 5 * F.col("_n_words")) | (F.col("_word_chars") > 7 * F.col("_n_words"))).alias("_near_length"),
    ).drop("_n_lines")


def host_verdicts(features: DataFrame) -> DataFrame:
    """(_host, _blocked, _strict_<rule>) from shrunk failure rates per host."""
    failed = {"any": F.col("_base_failed") | F.col("_fail_symbols") | F.col("_fail_lines") | F.col("_fail_length")} | {r: F.col(f"_near_{r}") for r in SOFT}
    hosts = features.groupBy(F.coalesce("source", F.lit("")).alias("_host")).agg(F.count("*").alias("n"), *(F.count_if(c).alias(r) for r, c in failed.items()))
    mean = {r: F.sum(r) / F.sum("n") for r in failed}
    means = hosts.agg(*(m.alias(r) for r, m in mean.items())).first()
    spread = hosts.agg(*(F.try_divide(F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.lit(means[r] or 0.0), 2)), F.sum("n")).alias(r) for r in failed)).first()

    def shrunk(r: str) -> Column:
        m, v = means[r] or 0.0, spread[r] or 0.0
        strength = min(1000.0, max(2.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        return (F.col(r) + m * strength) / (F.col("n") + strength)

    return hosts.select("_host", (shrunk("any") >= BLOCKED).alias("_blocked"), *((shrunk(r) > (means[r] or 0.0) + ABOVE).alias(f"_strict_{r}") for r in SOFT), F.col("n").alias("_rows"))


def judged(features: DataFrame) -> DataFrame:
    """features with _kept. `features` is read more than once: pass a written table."""
    hosts = staged(host_verdicts(features), "hosts")
    joined = joined_split(features.withColumn("_host", F.coalesce("source", F.lit(""))), hosts, ["_host"], F.col("_rows"), features.count())
    soft = F.lit(False)
    for r in SOFT:
        soft = soft | F.col(f"_fail_{r}") | F.col(f"_near_{r}") & F.col(f"_strict_{r}")
    return joined.withColumn("_kept", ~F.col("_base_failed") & ~F.col("_blocked") & ~soft)


def quality_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of documents (doc_id, text, source)."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    features = staged(quality_features(docs.select("doc_id", "text", "source")).drop("text"), "quality")
    return judged(features).select("doc_id", *(F.col(f"_{c}").alias(c) for c in own), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that are kept, all columns as they are: they travel in one struct, so their names meet no others."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text", "source")
    kept = judged(staged(quality_features(own).drop("text"), "quality")).where("_kept")
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


#: The same result as SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM {documents}),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
t AS (SELECT rid, i, word, lead(word, 1) OVER p AS w1, lead(word, 2) OVER p AS w2 FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, w1, w2) > 1 AS again FROM t),
c AS (SELECT rid, count(*) AS n_words, count(*) FILTER (again OR a1 OR a2) AS n_repeat_words
      FROM (SELECT rid, again, coalesce(lag(again, 1) OVER p, false) AS a1, coalesce(lag(again, 2) OVER p, false) AS a2 FROM r WINDOW p AS (PARTITION BY rid ORDER BY i)) GROUP BY rid),
f AS (SELECT d.rid, doc_id, host, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
      len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_distinct_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN c USING (rid)),
g AS (SELECT *, n_lines - n_distinct_lines AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      10 * n_symbols > n_words AS f1, n_lines - n_distinct_lines >= 3 AND 4 * (n_lines - n_distinct_lines) > n_lines AS f2,
      word_chars < 2 * n_words OR word_chars > 20 * n_words AS f3, 20 * n_symbols > n_words AS g1, n_lines - n_distinct_lines >= 3 AND 8 * (n_lines - n_distinct_lines) > n_lines AS g2,
      2 * word_chars < 5 * n_words OR word_chars > 7 * n_words AS g3 FROM f),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR f1 OR f2 OR f3) AS x0, count(*) FILTER (g1) AS x1, count(*) FILTER (g2) AS x2, count(*) FILTER (g3) AS x3 FROM g GROUP BY host),
m AS (SELECT sum(x0) / sum(n) AS m0, sum(x1) / sum(n) AS m1, sum(x2) / sum(n) AS m2, sum(x3) / sum(n) AS m3 FROM h),
v AS (SELECT sum(n * pow(x0 / n - m0, 2)) / sum(n) AS v0, sum(n * pow(x1 / n - m1, 2)) / sum(n) AS v1, sum(n * pow(x2 / n - m2, 2)) / sum(n) AS v2, sum(n * pow(x3 / n - m3, 2)) / sum(n) AS v3 FROM h, m),
s AS (SELECT m.*, CASE WHEN v0 > 0 THEN least(1000.0, greatest(2.0, m0 * (1 - m0) / v0 - 1)) ELSE 1000.0 END AS s0, CASE WHEN v1 > 0 THEN least(1000.0, greatest(2.0, m1 * (1 - m1) / v1 - 1)) ELSE 1000.0 END AS s1,
      CASE WHEN v2 > 0 THEN least(1000.0, greatest(2.0, m2 * (1 - m2) / v2 - 1)) ELSE 1000.0 END AS s2, CASE WHEN v3 > 0 THEN least(1000.0, greatest(2.0, m3 * (1 - m3) / v3 - 1)) ELSE 1000.0 END AS s3 FROM m, v),
b AS (SELECT host, (x0 + m0 * s0) / (n + s0) >= 0.9 AS blocked, ((x1 + m1 * s1) / (n + s1)) > m1 + 1e-9 AS t1, ((x2 + m2 * s2) / (n + s2)) > m2 + 1e-9 AS t2, ((x3 + m3 * s3) / (n + s3)) > m3 + 1e-9 AS t3 FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT blocked AND NOT (f1 OR f2 OR f3) AND NOT (g1 AND t1) AND NOT (g2 AND t2) AND NOT (g3 AND t3) AS kept
FROM g JOIN b USING (host)
"""
