"""Parity of declared and emitted signal ids: what each detector emits over the pages, against the declared table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import corpus as C
from ..plans.spec import MARKERS, WEIGHTS

#: The two detectors: the browser's own rules and their port for offline evaluation. Ids of EXEMPT are markers, emitted by either at will.
DETECTORS = ("page", "eval")
EXEMPT = MARKERS
#: Findings by name; those of HARD make the audit fail.
HARD = ("undeclared_page", "undeclared_eval", "eval_only", "bad_weight")
SOFT = ("never_emitted", "page_only")


def emitted(d, mode: str) -> str:
    """id, pages: how many pages each signal is on, by the detector of this mode."""
    ids = d.unnest(d.distinct(d.map("sig", "e", "e.id")), "t", "page_id", "id")
    return f"WITH {C.cascade(d, mode)} SELECT id, count(*) AS pages FROM ({ids}) GROUP BY id"


def parity(declared: DataFrame, page: DataFrame, evaluation: DataFrame, exempt: tuple[str, ...] = EXEMPT) -> DataFrame:
    """(id, declared, weight, page_pages, eval_pages, finding, failed): one row a finding of an id, or one with finding '' where there is none.

    declared (id, weight: double) and what each detector emitted (id, pages); an id may stand in several rows, null ids are ignored.
    The checks: emitted but not declared, by either detector; declared and emitted by none; emitted by one detector alone; a declared
    weight that is null, negative or no whole number. Exempt ids are checked for their weight only. Only grouped ids are joined, no pages.
    """
    w = F.col("weight")
    unsound = F.coalesce(~((w >= 0) & (w == F.floor(w)) & (w < float("inf"))), F.lit(True))
    spec = declared.where("id IS NOT NULL").groupBy("id").agg(F.max("weight").alias("weight"), F.bool_or(unsound).alias("_bad"), F.lit(True).alias("_spec"))
    sides = [side.where("id IS NOT NULL").groupBy("id").agg(F.sum("pages").alias(f"{name}_pages")) for name, side in zip(DETECTORS, (page, evaluation))]
    rows = spec.join(sides[0], "id", "full_outer").join(sides[1], "id", "full_outer")
    known, on_page, on_eval = F.col("_spec").isNotNull(), F.coalesce("page_pages", F.lit(0)) > 0, F.coalesce("eval_pages", F.lit(0)) > 0
    free = F.col("id").isin(*exempt) if exempt else F.lit(False)
    checks = {
        "undeclared_page": ~known & on_page & ~free,
        "undeclared_eval": ~known & on_eval & ~free,
        "never_emitted": known & ~on_page & ~on_eval & ~free,
        "page_only": on_page & ~on_eval & ~free,
        "eval_only": on_eval & ~on_page & ~free,
        "bad_weight": known & F.col("_bad"),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))
    finding = F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))).alias("finding")
    out = rows.select("id", known.alias("declared"), "weight", F.coalesce("page_pages", F.lit(0)).alias("page_pages"), F.coalesce("eval_pages", F.lit(0)).alias("eval_pages"), finding)
    return out.withColumn("failed", F.col("finding").isin(*HARD))


def oracle(d) -> str:
    """The audit as text for the oracle, which has nested WITH."""
    spec = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in WEIGHTS.items())
    free = f"id IN ({', '.join(repr(k) for k in EXEMPT)})"
    rows = (
        f"SELECT id, known IS NOT NULL AS declared, weight, CAST(coalesce(p, 0) AS BIGINT) AS page_pages, CAST(coalesce(e, 0) AS BIGINT) AS eval_pages "
        f"FROM (SELECT id, weight, true AS known FROM (VALUES {spec}) v(id, weight)) FULL JOIN (SELECT id, pages AS p FROM ({emitted(d, 'page')})) USING (id) FULL JOIN (SELECT id, pages AS e FROM ({emitted(d, 'eval')})) USING (id)"
    )
    tests = {
        "undeclared_page": f"NOT declared AND page_pages > 0 AND NOT {free}",
        "undeclared_eval": f"NOT declared AND eval_pages > 0 AND NOT {free}",
        "never_emitted": f"declared AND page_pages = 0 AND eval_pages = 0 AND NOT {free}",
        "page_only": f"page_pages > 0 AND eval_pages = 0 AND NOT {free}",
        "eval_only": f"eval_pages > 0 AND page_pages = 0 AND NOT {free}",
        "bad_weight": "declared AND NOT (weight >= 0 AND weight = floor(weight))",
    }
    some = " UNION ALL ".join(f"SELECT *, '{k}' AS finding FROM r WHERE {c}" for k, c in tests.items())
    hard = ", ".join(f"'{k}'" for k in HARD)
    return f"WITH r AS ({rows}), f AS ({some}), a AS (SELECT * FROM f UNION ALL SELECT *, '' FROM r WHERE id NOT IN (SELECT id FROM f)) SELECT *, finding IN ({hard}) AS failed FROM a"
