"""One call for many tables: load, then check, each table on its own; a ledger lets a run that was cut off go on."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablebridge.operators import merge
from tablebridge.operators.integrity import check_constraints
from tablebridge.sources.scan import missing_tables, select_tables
from tablebridge.sources.shared import exists, write_state

MODES = ("delta", "truncate", "recreate", "append")
#: Seconds to wait for the counts of a write that has ended.
WAIT = 10.0
TOLD = "table_name string, status string, rows long, violations long, error string"


class TablesFailed(RuntimeError):
    """Some tables of a run failed; `told` has what sync_tables() would have returned."""

    told: DataFrame


class Ledger:
    """The progress of runs, as small files in a shared folder: one for each change of a table's state, none is ever rewritten."""

    KIND = "migration_id string, table_name string, status string, rows_transferred long, error string, at long"

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path.rstrip("/"), run_id

    def put(self, table_name: str, status: str, rows: int | None = None, error: str | None = None) -> None:
        at = time.time_ns()
        state = {"migration_id": self.run_id, "table_name": table_name, "status": status, "rows_transferred": rows, "error": error, "at": at}
        write_state(self.spark, f"{self.path}/{at:020d}-{uuid.uuid4().hex}.json", state)

    def progress(self) -> DataFrame:
        """migration_id, table_name, status, rows_transferred, error, started_at of the last state of each table in each run."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], "migration_id string, table_name string, status string, rows_transferred long, error string, started_at timestamp")
        rows = self.spark.read.schema(self.KIND).option("pathGlobFilter", "*.json").json(self.path)
        last = F.max_by(F.struct("status", "rows_transferred", "error"), "at").alias("l")
        by = rows.groupBy("migration_id", "table_name").agg(last, F.timestamp_micros((F.min("at") / 1000).cast("long")).alias("started_at"))
        return by.select("migration_id", "table_name", "l.status", "l.rows_transferred", "l.error", "started_at")

    def done(self, names: list[str]) -> dict[str, int]:
        """Of the named tables those that are completed in this run, with their rows."""
        found = self.progress().where((F.col("migration_id") == self.run_id) & (F.col("status") == "completed") & F.col("table_name").isin(names))
        return {r["table_name"]: r["rows_transferred"] or 0 for r in found.collect()}


def sync_table(source: DataFrame, target: DataFrame | None, mode: str, keys: list[str]) -> DataFrame:
    """The target's rows after a load in the mode."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if target is None or mode == "recreate":
        return merge.recreate_reload(source)
    if mode == "truncate":
        return merge.truncate_reload(source, target.schema)
    return merge.append_unkeyed(target, source) if mode == "append" or not keys else merge.upsert(target, source, keys)


def _counted(df: DataFrame, row_checks: list[dict]) -> tuple[DataFrame, Callable[[], tuple[int, int] | None]]:
    """df that counts its rows, and those that break a row's own check, while it is written; and the two numbers after that, or None if no write came."""
    seen = Observation(uuid.uuid4().hex)
    broken = [F.count_if(~F.coalesce(F.expr(c["sql"]), F.lit(True))) if c["kind"] == "check" else sum((F.count_if(F.col(x).isNull()) for x in c["columns"]), F.lit(0)) for c in row_checks]
    watched = df.observe(seen, F.count("*").alias("rows"), sum(broken, F.lit(0)).alias("broken"))

    def told() -> tuple[int, int] | None:
        got: dict = {}
        waiting = threading.Thread(target=lambda: got.update(seen.get), daemon=True)
        waiting.start()
        waiting.join(WAIT)
        return (got["rows"], got["broken"]) if got else None

    return watched, told


def _requested(spark: SparkSession, tables: list[dict], names: list[str] | None) -> list[dict]:
    """The tables that were asked for; an error, before anything is done, if a name has none."""
    if names is None:
        return tables
    have = spark.createDataFrame([(t["name"],) for t in tables], "table_name string")
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    if gone := sorted(r["name"] for r in missing_tables(have, asked).collect()):
        raise ValueError("no such tables: " + ", ".join(gone))
    chosen = {r["table_name"] for r in select_tables(have, asked).collect()}
    return [t for t in tables if t["name"] in chosen]


def sync_tables(
    spark: SparkSession,
    tables: list[dict],
    write: Callable[[str, DataFrame], None],
    mode: str = "delta",
    constraints: list[dict] | None = None,
    workers: int = 4,
    data_only: bool = False,
    schema_only: bool = False,
    read: Callable[[str], DataFrame] | None = None,
    strict: bool = True,
    ledger: Ledger | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """table_name, status, rows, violations, error per table of tables (name, source, target, keys); write stores a table's new rows in one action.

    With names only those tables are done; a name without a table is an error before anything is written. With a ledger each
    table's state is put down as it changes, and tables that the run has completed before are left alone, whatever the mode.
    Tables load in parallel as independent jobs; when all have ended, TablesFailed is raised if one of them failed, unless strict is off.
    schema_only writes empty tables, data_only skips the checks; truncate skips them too. Rows, nulls and check expressions are
    counted while the rows are written; only keys and references are looked up in the stored table, which read gives back (else it is computed again).
    """
    tables = _requested(spark, tables, names)
    done = ledger.done([t["name"] for t in tables]) if ledger else {}

    def note(*state) -> None:
        if ledger:
            ledger.put(*state)

    def one(t: dict) -> tuple:
        name = t["name"]
        if name in done:
            return name, "completed", done[name], 0, None
        try:
            note(name, "in_progress")
            new = sync_table(t["source"], t.get("target"), mode, t.get("keys", []))
            own = [c for c in constraints or [] if c["table"] == name] if not (data_only or schema_only or mode == "truncate") else []
            row_checks = [c for c in own if c["kind"] in ("check", "not_null")]
            watched, told = _counted(new.limit(0) if schema_only else new, row_checks)
            write(name, watched)
            seen = (0, 0) if schema_only else told()
            if read:
                new = read(name)
            left = own if seen is None else [c for c in own if c not in row_checks]
            rows, bad = (new.count(), 0) if seen is None else seen
            if left:
                others = {x["name"]: x["source"] for x in tables if x["name"] != name}
                bad += sum(r["violations"] for r in check_constraints({name: new} | others, left).collect())
            note(name, "completed", rows)
            return name, "completed", rows, bad, None
        except Exception as e:  # one table's failure must not stop the others
            note(name, "failed", None, str(e)[:500])
            return name, "failed", 0, 0, str(e)[:500]

    with ThreadPoolExecutor(workers) as pool:
        rows = list(pool.map(one, tables))
    told = spark.createDataFrame(rows, TOLD)
    if strict and (failed := [f"{r[0]} ({r[4]})" for r in rows if r[1] == "failed"]):
        error = TablesFailed("tables failed: " + ", ".join(failed))
        error.told = told
        raise error
    return told
