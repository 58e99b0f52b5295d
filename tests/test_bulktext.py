"""Bulk text as a sink with a commit: round trips, and writes that fail."""

import datetime
import decimal
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablebridge.sources import bulktext

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("id", T.IntegerType()), ("amount", T.DecimalType(10, 2)), ("notes", T.StringType()), ("raw", T.BinaryType()), ("flag", T.BooleanType()), ("at", T.TimestampType()))])
AT = datetime.datetime(2024, 1, 2, 3, 4, 5, 600)
ROWS = [
    (1, decimal.Decimal("454.30"), "tab\there\nnewline\\backslash", b"\x00\x01\xff\x10\x7f", True, AT),
    (2, None, None, None, None, None),
    (3, decimal.Decimal("-0.01"), "", b"", False, AT.replace(microsecond=0)),
    (4, None, "\\N", b"\\\t\n\\", None, None),
    (5, None, "ends in \\", b"\n", None, None),
    (6, None, "\\\n\t\\\\\n", b"\\N", None, None),
]


def there(path):
    """Files that a reader sees; a task that is killed late may leave a hidden folder."""
    return sorted(n for n in os.listdir(path) if not n.startswith("_")) if os.path.isdir(path) else []


def test_special_values_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    bulktext.write_bulk_text(df, f"file://{tmp_path}/out")
    got = bulktext.read_bulk_text(spark, f"file://{tmp_path}/out", SCHEMA).orderBy("id").collect()
    assert [(*r[:3], None if r[3] is None else bytes(r[3]), *r[4:]) for r in got] == ROWS
    assert all(n.endswith(".txt") for n in there(tmp_path / "out"))


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_lines_are_found_in_pieces_of_any_size(size):
    import io

    text = b"a\\\nb\n\\\\\nc\n\nlast"
    assert list(bulktext._lines(io.BytesIO(text), size)) == [b"a\\\nb", b"\\\\", b"c", b"", b"last"]


def test_one_file_a_task_and_modes(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(100).repartition(4)
    bulktext.write_bulk_text(df, path)
    first = there(path)
    assert len(first) == 4
    bulktext.write_bulk_text(df, path)
    assert len(there(path)) == 8 and set(first) < set(there(path))
    bulktext.write_bulk_text(df.where("id < 10"), path, "overwrite")
    assert not set(first) & set(there(path)) and bulktext.read_bulk_text(spark, path, df.schema).count() == 10


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    broken = spark.range(100).repartition(4).withColumn("v", F.when(F.col("id") == 50, F.raise_error(F.lit("bad row"))).otherwise(F.lit("x")))
    with pytest.raises(Exception, match="bad row"):
        bulktext.write_bulk_text(broken, path)
    assert there(path) == []
    good = spark.range(3).withColumn("v", F.lit("x"))
    bulktext.write_bulk_text(good, path)
    before = there(path)
    with pytest.raises(Exception, match="bad row"):
        bulktext.write_bulk_text(broken, path, "overwrite")
    assert there(path) == before and bulktext.read_bulk_text(spark, path, good.schema).count() == 3


def test_nothing_to_write_or_read(spark, tmp_path):
    none = spark.range(0)
    bulktext.write_bulk_text(none, f"{tmp_path}/out")
    assert bulktext.read_bulk_text(spark, f"{tmp_path}/out", none.schema).count() == 0


def test_a_line_of_another_shape_is_an_error(spark, tmp_path):
    bulktext.write_bulk_text(spark.range(3), f"{tmp_path}/out")
    with pytest.raises(Exception, match="1 values for 2 columns"):
        bulktext.read_bulk_text(spark, f"{tmp_path}/out", T.StructType.fromDDL("id long, more string")).collect()
