"""Runs over many tables: failures, resumes by the ledger, requested names, counts taken while writing."""

import pytest

from tablebridge.operators import sync


@pytest.fixture
def store(spark, tmp_path):
    """Writes tables, remembers the order, and fails for those named in broken."""

    class Store:
        loads, broken, reads = [], set(), []

        def write(self, name, df):
            self.loads.append(name)
            if name in self.broken:
                raise OSError("no space")
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")

        def read(self, name):
            self.reads.append(name)
            return spark.read.parquet(f"{tmp_path}/{name}")

    s = Store()
    s.loads, s.broken, s.reads = [], set(), []
    return s


def told(df):
    return {r["table_name"]: (r["status"], r["rows"], r["violations"]) for r in df.collect()}


def tables(spark, *names, n=3):
    return [{"name": name, "source": spark.range(n).selectExpr("id", "if(id = 1, null, id) AS v"), "keys": ["id"]} for name in names]


def test_one_failing_table_does_not_stop_the_others_but_the_run_fails(spark, store):
    three = tables(spark, "a", "b", "c")
    store.broken = {"b"}
    with pytest.raises(sync.TablesFailed, match="b .*no space") as e:
        sync.sync_tables(spark, three, store.write)
    assert told(e.value.told) == {"a": ("completed", 3, 0), "b": ("failed", 0, 0), "c": ("completed", 3, 0)}
    assert sorted(store.loads) == ["a", "b", "c"]
    assert told(sync.sync_tables(spark, three, store.write, strict=False))["b"] == ("failed", 0, 0)


@pytest.mark.parametrize("mode", ["truncate", "delta", "recreate"])
def test_a_run_goes_on_with_what_is_not_done(spark, store, tmp_path, mode):
    three, ledger = tables(spark, "a", "b", "c"), sync.Ledger(spark, f"file://{tmp_path}/ledger", "run-1")
    store.broken = {"c"}
    with pytest.raises(sync.TablesFailed):
        sync.sync_tables(spark, three, store.write, mode, ledger=ledger)
    states = {r["table_name"]: (r["status"], r["error"]) for r in ledger.progress().collect()}
    assert states == {"a": ("completed", None), "b": ("completed", None), "c": ("failed", "no space")}
    store.broken, store.loads = set(), []
    again = sync.sync_tables(spark, three, store.write, mode, ledger=sync.Ledger(spark, f"file://{tmp_path}/ledger", "run-1"))
    assert store.loads == ["c"] and told(again) == dict.fromkeys("abc", ("completed", 3, 0))
    # another run does all of them, a finished one none
    store.loads = []
    sync.sync_tables(spark, three, store.write, mode, ledger=sync.Ledger(spark, f"file://{tmp_path}/ledger", "run-2"))
    assert sorted(store.loads) == ["a", "b", "c"]
    sync.sync_tables(spark, three, store.write, mode, ledger=ledger)
    assert len(store.loads) == 3 and ledger.progress().count() == 6


def test_missing_names_fail_before_anything_is_written(spark, store):
    three = tables(spark, "a", "b", "c")
    with pytest.raises(ValueError, match="no such tables: x, y"):
        sync.sync_tables(spark, three, store.write, names=["a", "y", "x"])
    assert store.loads == []
    sync.sync_tables(spark, three, store.write, names=[" dbo.A ", "c"])
    assert sorted(store.loads) == ["a", "c"]


CHECKS = [
    {"table": "a", "name": "small", "kind": "check", "sql": "id < 7"},
    {"table": "a", "name": "filled", "kind": "not_null", "columns": ["id", "v"]},
]


def test_rows_and_row_checks_are_counted_while_writing(spark, store):
    one = tables(spark, "a", n=10)
    assert told(sync.sync_tables(spark, one, store.write, constraints=CHECKS)) == {"a": ("completed", 10, 4)}
    # nothing is read but for keys
    seen = []

    class Watched:
        def count(self):
            seen.append("count")

    assert told(sync.sync_tables(spark, one, store.write, constraints=CHECKS, read=lambda n: Watched())) == {"a": ("completed", 10, 4)} and seen == []
    keyed = [*CHECKS, {"table": "a", "name": "one", "kind": "unique", "columns": ["v"]}]
    assert told(sync.sync_tables(spark, one, store.write, constraints=keyed, read=store.read)) == {"a": ("completed", 10, 4)} and store.reads == ["a"]


def test_without_an_action_rows_are_counted_afterwards(spark, monkeypatch):
    monkeypatch.setattr(sync, "WAIT", 0.5)
    kept = {}
    got = sync.sync_tables(spark, tables(spark, "a", n=10), kept.__setitem__, constraints=CHECKS)
    assert told(got) == {"a": ("completed", 10, 4)} and set(kept) == {"a"}


def test_schema_only_writes_no_rows(spark, store):
    assert told(sync.sync_tables(spark, tables(spark, "a"), store.write, schema_only=True)) == {"a": ("completed", 0, 0)}
    assert store.read("a").columns == ["id", "v"] and store.read("a").count() == 0
