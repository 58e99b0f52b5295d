"""A table as a base and the deltas after it, under one small state file a commit.

A state names the folders in use and, for every stream that writes, its last batch. A commit is a new state file, which no two
writers can both make; folders that no kept state names are dropped. Deltas are merged by levels, `width` of one level into one
of the next, so their number grows with the logarithm of the batches, and each row is written once a level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablebridge.operators.merge import upsert
from tablebridge.sources.shared import drop, listed, read_state, write_state

#: Deltas of one level that are merged into one of the next, and states that are kept for readers.
WIDTH, STATES = 16, 3


def newest(rows: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """One row a key, nulls counting as equal: the greatest order_by (null last), of equal ones the latest commit (_at), then the row that hashes highest."""
    rest = [c for c in rows.columns if c not in (*keys, order_by, "_at")]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order_by), F.desc("_at"), F.xxhash64(*rest).desc() if rest else F.lit(0)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self) -> list[str]:
        return [n for n, _, _ in listed(self.spark, f"{self.path}/state") if n.endswith(".json")]

    def state(self) -> dict | None:
        names = self._names()
        return read_state(self.spark, f"{self.path}/state/{names[-1]}") if names else None

    def _commit(self, state: dict) -> dict:
        state = state | {"version": state.get("version", -1) + 1}
        write_state(self.spark, f"{self.path}/state/{state['version']:012d}.json", state)
        names = self._names()
        for old in names[:-STATES]:
            drop(self.spark, f"{self.path}/state/{old}")
        used: set[str] = set()
        for name in names[-STATES:]:
            kept = read_state(self.spark, f"{self.path}/state/{name}")
            used |= {kept["base"], *(d["name"] for d in kept["deltas"])}
        for name, full, _ in listed(self.spark, f"{self.path}/data"):
            if name not in used:
                drop(self.spark, full)
        return state

    def _written(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        return name

    def create(self, start: DataFrame, keys: list[str], order_by: str) -> None:
        """The first base, unless there is a table already."""
        if self.state() is None:
            self._commit({"base": self._written(start), "columns": start.columns, "keys": keys, "order_by": order_by, "deltas": [], "batches": {}, "commits": 0})

    def add(self, rows: DataFrame, writer: str, batch: int, width: int = WIDTH) -> bool:
        """A writer's batch as a delta; False, and nothing changes, if it was committed before."""
        state = self.state()
        if state["batches"].get(writer, -1) >= batch:
            return False
        at = state["commits"]
        name = self._written(newest(rows.withColumn("_at", F.lit(at).cast("long")), state["keys"], state["order_by"]))
        state = self._commit(state | {"deltas": [*state["deltas"], {"name": name, "level": 0}], "batches": state["batches"] | {writer: batch}, "commits": at + 1})
        level = 0
        while len(same := [d for d in state["deltas"] if d["level"] == level]) >= width:
            merged = self._written(newest(self._read([d["name"] for d in same]), state["keys"], state["order_by"]))
            state = self._commit(state | {"deltas": [d for d in state["deltas"] if d not in same] + [{"name": merged, "level": level + 1}]})
            level += 1
        return True

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/data/{n}" for n in names))

    def read(self) -> DataFrame:
        """The newest row of every key, in the columns of the first base. It stays readable until some later commits."""
        state = self.state()
        rows = self._merged(state)
        return rows.select(*state["columns"])

    def _merged(self, state: dict) -> DataFrame:
        keys, order = state["keys"], state["order_by"]
        base = self._read([state["base"]])
        if not state["deltas"]:
            return base
        rows = newest(self._read([d["name"] for d in state["deltas"]]), keys, order).drop("_at")
        if order in base.columns:
            # a late version does not take the place of a newer one in the base
            newer = base.select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.col(order).alias("_b_order"))
            same = [F.col(k) == F.col(f"_b_{k}") for k in keys]
            rows = rows.join(newer, [*same, (F.col("_b_order") > F.col(order)) | (F.col(order).isNull() & F.col("_b_order").isNotNull())], "left_anti")
        else:
            base = base.withColumn(order, F.lit(None).cast(rows.schema[order].dataType))
        return upsert(base, rows, keys)

    def compact(self) -> None:
        """All deltas become part of a new base; writers go on from their last batches."""
        state = self.state()
        if state["deltas"]:
            self._commit(state | {"base": self._written(self._merged(state)), "deltas": []})
