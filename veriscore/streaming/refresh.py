"""A side table that is fetched anew every period while a stream runs: versioned, checked, with its last good copy in a shared folder.

The folder holds copies/version=<n>, one Parquet copy a version taken, and log, a row for each attempt (tried_at, version, outcome,
reason). An attempt that fails, brings rows that are not sound, or a version not above the current one, leaves the current copy and is
logged with its reason; the next attempt comes a period later. A copy counts once its log row stands, so a start that broke off while
writing one falls back to the version before. After a restart the last good copy is there at once, and the period goes on from
the last attempt. The table changes between micro-batches only.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "tried_at double, version long, outcome string, reason string"
log = logging.getLogger(__name__)


class RefreshedTable:
    """load: fetches the table, a `version` (an integer, one for all rows) among its columns. sound: those of its rows that may be used;
    a version is taken if there is a row and all are sound. period, first: seconds between attempts, and before the first without a log."""

    def __init__(self, spark: SparkSession, folder: str, load: Callable[[], DataFrame], sound: Callable[[DataFrame], DataFrame], period: float = 86_400, first: float = 30, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.load, self.sound = spark, folder.rstrip("/"), load, sound
        self.period, self.clock = period, clock
        last = self.attempts().agg(F.max("tried_at").alias("t"), F.max(F.when(F.col("outcome") == "taken", F.col("version"))).alias("v")).first()
        self.version: int | None = last.v
        self.due = last.t + period if last.t is not None else clock() + first
        self.held: DataFrame | None = self.copy(last.v) if last.v is not None else None

    def attempts(self) -> DataFrame:
        """The log; small, a row a period."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def copy(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/copies/version={version}").withColumn("version", F.lit(version).cast("long"))

    def refresh(self) -> str:
        """Try now, whatever the period; the outcome: taken, late, unsound or failed."""
        tried, version, reason = self.clock(), None, ""
        try:
            fresh = self.load().persist()
            try:
                versions = [r[0] for r in fresh.select(F.col("version").cast("long")).distinct().limit(2).collect()]
                version = versions[0] if len(versions) == 1 else None
                n, good = fresh.count(), self.sound(fresh).count()
                if version is None:
                    outcome, reason = "unsound", f"{'no' if not versions else 'several'} versions"
                elif good != n or n == 0:
                    outcome, reason = "unsound", f"{n - good} of {n} rows"
                elif self.version is not None and version <= self.version:
                    outcome, reason = "late", f"version {self.version} is held"
                else:
                    fresh.drop("version").write.mode("overwrite").parquet(f"{self.folder}/copies/version={version}")
                    outcome = "taken"
            finally:
                fresh.unpersist()
        except Exception as e:  # noqa: BLE001 - whatever a fetch ends in, the stream goes on with what it has
            outcome, reason = "failed", f"{type(e).__name__}: {str(e)[:500]}"
        self.spark.createDataFrame([(tried, version, outcome, reason)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        if outcome == "taken":
            self.version, self.held = version, self.copy(version)
        else:
            log.warning("refresh of %s: %s, %s", self.folder, outcome, reason)
        self.due = tried + self.period
        return outcome

    def current(self) -> DataFrame | None:
        """The table as it holds now, fetched before if an attempt is due; None while no version was ever taken."""
        if self.clock() >= self.due:
            self.refresh()
        return self.held


def judged_by(stream: DataFrame, table: RefreshedTable, judge: Callable[[DataFrame, DataFrame | None], DataFrame], sink: Callable[[DataFrame, int], None], every: str = "200 milliseconds"):
    """Writer of a stream each of whose micro-batches is judged by the table as it is when the batch begins.

    Results of a batch are written at once; sink gets the batch's number, by which it can tell a batch that is run again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sink(judge(rows, table.current()), number)

    return stream.writeStream.foreachBatch(batch).trigger(processingTime=every)
