"""Folds over a group's rows in order, exact at any size of a group: no task holds a group, and no list of one is made.

Rows are dealt out by range of (group, order) and written once, so a group lies in consecutive parts. A part can be folded alone but for
the state its first group brings along. All parts are first folded as if nothing came before them; then a part is folded again only if
the state that the part before leaves differs from the one it was folded with, until none does. The first k parts are right after k
rounds at the latest; as states forget what lies far back (a call that has ended, a name pushed out of a cache), two or three rounds
do in practice. The driver holds one state a part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: step(state, rows of one group in order) -> (next state, a column of results); states go through JSON.
Step = Callable[[Any, pd.DataFrame], tuple[Any, np.ndarray]]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(rows: DataFrame, group: str, order: list[str], rows_a_part: int) -> DataFrame:
    """A written table of rows with `_part`: parts are ranges of (group, order), of about rows_a_part rows."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // rows_a_part))
    path = shared_folder(spark, "dealt")
    keys = [group, *order]
    rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def runs(frame: pd.DataFrame, group: str) -> list[pd.DataFrame]:
    """Consecutive rows of one group each; a null group is one too."""
    key = frame[group]
    same = (key == key.shift()) | (key.isna() & key.shift().isna())
    starts = np.flatnonzero(~same.to_numpy() | (np.arange(len(frame)) == 0))
    return [frame.iloc[a:b] for a, b in zip(starts, [*starts[1:], len(frame)])]


def ordered_fold(rows: DataFrame, group: str, order: list[str], step: Step, name: str, kind: str, start: Any = None, rows_a_part: int = 1 << 18) -> DataFrame:
    """rows with a column `name` (of SQL type `kind`): what `step` says of each row, given the state left by the group's rows before it.

    order must set the rows of a group apart where the step tells them apart. Null groups are one group; an empty table gives no rows.
    """
    table = dealt(rows, group, order, rows_a_part)
    keys = [group, *order]

    def exits(entries: dict[int, str]) -> dict[int, tuple[str, str, str]]:
        """(first group, last group, state left) of the parts named, each entered with a state."""

        def leave(frame: pd.DataFrame) -> pd.DataFrame:
            part = int(frame["_part"].iloc[0])
            all_ = runs(frame.sort_values(keys, kind="stable", na_position="first"), group)
            state = json.loads(entries[part]) if len(all_) == 1 else start
            label = lambda f: json.dumps(str(f[group].iloc[0]) if pd.notna(f[group].iloc[0]) else None)
            return pd.DataFrame([(part, label(all_[0]), label(all_[-1]), json.dumps(step(state, all_[-1])[0]))], columns=["part", "first", "last", "state"])

        some = table.where(F.col("_part").isin(list(entries)))
        return {r.part: (r.first, r.last, r.state) for r in some.groupBy("_part").applyInPandas(leave, "part int, first string, last string, state string").toDF("part", "first", "last", "state").toLocalIterator()}

    fresh = json.dumps(start)
    numbers = sorted(r[0] for r in table.select("_part").distinct().collect())
    entries = dict.fromkeys(numbers, fresh)
    left, changed = {}, dict(entries)
    while changed:
        left |= exits(changed)
        changed = {}
        for before, part in zip(numbers, numbers[1:]):
            entry = left[before][2] if left[before][1] == left[part][0] else fresh
            if entry != entries[part]:
                entries[part] = entry
                if left[part][0] == left[part][1]:  # the state goes on through a part of one group only
                    changed[part] = entry

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name != "_part") + f", `{name}` {kind}"
    columns = [c for c in table.columns if c != "_part"]

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["_part"].iloc[0])
        frame = frame.sort_values(keys, kind="stable", na_position="first")
        out, state = [], json.loads(entries[part])
        for rows_ in runs(frame, group):
            out.append(step(state, rows_)[1])
            state = start
        return frame[columns].assign(**{name: np.concatenate(out)})

    return table.groupBy("_part").applyInPandas(told, schema)


def started(seconds: int, at: str = "us") -> Step:
    """Whether a call starts: not while the call started last is still under way, `seconds` after its time `at` (microseconds)."""
    window = seconds * 1_000_000

    def step(state: int | None, rows: pd.DataFrame) -> tuple[int | None, np.ndarray]:
        us = rows[at].to_numpy()
        out, i = np.zeros(len(us), bool), 0
        if state is not None:
            i = int(np.searchsorted(us, state + window))
        while i < len(us):
            out[i], state = True, int(us[i])
            i = max(i + 1, int(np.searchsorted(us, state + window)))
        return state, out

    return step


def cached(size: int = 32, key: str = "url") -> Step:
    """Whether a key is in a cache of `size` keys that drops the one used longest ago."""

    def step(state: list[str] | None, rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
        held = dict.fromkeys(state or [])
        out = np.zeros(len(rows), bool)
        for i, k in enumerate(rows[key].tolist()):
            if k in held:
                del held[k]
                out[i] = True
            held[k] = None
            if len(held) > size:
                del held[next(iter(held))]
        return list(held), out

    return step
