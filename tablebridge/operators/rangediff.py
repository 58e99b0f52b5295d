"""Row differences by digests of key ranges: only ranges whose digests differ are joined row by row.

Every row has a place on a line of whole numbers: its key, where that is one integer, date or timestamp, else a hash of its
keys. The line is cut into equal ranges; of each the two sides give their number of rows and two sums of row digests, in any
order. Ranges that differ are cut again, until few rows are left in them; only these are compared as rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablebridge.operators.integrity import diff_rows

#: Parts that a range is cut into, rows that are compared without another cut, differing ranges beyond which cutting ends.
FAN, LEAF_ROWS, MOST_RANGES = 1024, 100_000, 4096
#: Ends of the line for hashed keys.
_HASHES = (0, (1 << 63) - 1)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Cut:
    """Ranges [low + part * width, low + (part + 1) * width) that differ, or the whole line; part -1 holds rows without a place. `rows` counts both sides."""

    hashed: bool
    low: int
    width: int
    parts: list[int] | None
    rows: int = 0

    def part(self) -> Column:
        # widths are powers of two
        return F.coalesce(F.shiftright(F.col("_place") - F.lit(self.low).cast("long"), self.width.bit_length() - 1), F.lit(-1).cast("long"))

    def rows_of(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """df with _place, in the differing ranges; where the place is the key itself, files outside them are not read."""
        placed = df.withColumn("_place", _place(df, keys, self.hashed))
        if self.parts is None:
            return placed
        inside = [p for p in self.parts if p >= 0]
        if not self.hashed and isinstance(df.schema[keys[0]].dataType, _WHOLE) and inside == self.parts:
            key = F.col(keys[0])
            placed = placed.where((key >= self.low + inside[0] * self.width) & (key <= min(self.low + (inside[-1] + 1) * self.width - 1, _HASHES[1])))
        return placed.where(self.part().isin(self.parts))


def _place(df: DataFrame, keys: list[str], hashed: bool) -> Column:
    key, kind = F.col(keys[0]), df.schema[keys[0]].dataType
    if hashed:
        return F.shiftrightunsigned(F.xxhash64(*keys), 1)
    return F.unix_date(key).cast("long") if isinstance(kind, T.DateType) else F.unix_micros(key) if isinstance(kind, T.TimestampType) else key.cast("long")


def _line(source: DataFrame, target: DataFrame, keys: list[str]) -> tuple[bool, int, int]:
    """Whether keys are hashed, and the least and the greatest place on either side."""
    kinds = [df.schema[keys[0]].dataType for df in (source, target)]
    alike = all(isinstance(k, _WHOLE) for k in kinds) or (kinds[0] == kinds[1] and isinstance(kinds[0], (T.DateType, T.TimestampType)))
    if len(keys) > 1 or not alike:
        return True, *_HASHES
    ends = [x for df in (source, target) for x in df.select(_place(df, keys, False).alias("p")).agg(F.min("p"), F.max("p")).first() if x is not None]
    low, high = min(ends, default=0), max(ends, default=0)
    return (True, *_HASHES) if high - low >= _HASHES[1] else (False, low, high)


def range_digests(df: DataFrame, keys: list[str], columns: list[str], within: Cut, part: Column) -> DataFrame:
    """part, rows, a, b of the ranges inside `within`: two sums of 64-bit row digests, so rows may come in any order and as often as they do."""
    # a null leaves a hash as it is, so which values are null belongs to the row
    content = [*keys, *columns, *(F.col(c).isNull() for c in (*keys, *columns))]
    digests = [F.xxhash64(F.lit(seed), *content).cast("decimal(20,0)").alias(name) for seed, name in ((1, "a"), (2, "b"))]
    return within.rows_of(df, keys).select(part.alias("part"), *digests).groupBy("part").agg(F.count("*").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def differing(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], fan: int = FAN, leaf_rows: int = LEAF_ROWS, most: int = MOST_RANGES) -> Cut:
    """The smallest ranges found to differ; no parts where the tables are equal. At most `most` ranges reach the driver."""
    hashed, low, high = _line(source, target, keys)
    width = 1
    while width * fan < high - low + 1:
        width *= 2
    found = Cut(hashed, low, width, None)
    while True:
        finer = Cut(hashed, low, width, None)
        s, t = (range_digests(df, keys, columns, found, finer.part()).select("part", *(F.col(c).alias(f"{side}_{c}") for c in ("rows", "a", "b"))) for df, side in ((source, "s"), (target, "t")))
        same = F.col("s_rows").eqNullSafe(F.col("t_rows")) & F.col("s_a").eqNullSafe(F.col("t_a")) & F.col("s_b").eqNullSafe(F.col("t_b"))
        zero = F.lit(0).cast("long")
        odd = s.join(t, "part", "full").where(~same).select("part", (F.coalesce("s_rows", zero) + F.coalesce("t_rows", zero)).alias("n")).limit(most + 1).collect()
        if len(odd) > most:
            return found  # too many to name: the ranges around them, or the whole line
        found = Cut(hashed, low, width, sorted(r["part"] for r in odd), sum(r["n"] for r in odd))
        if found.rows <= leaf_rows or width == 1 or len(odd) > most // 2:
            return found
        width = max(1, width // fan)


def diff_ranges(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], **options: int) -> DataFrame:
    """The rows of diff_rows(), found by joining only ranges of keys that differ; equal tables are not joined at all.

    A range counts as equal if its rows and both sums of 64-bit digests are: a difference goes unseen with a chance of about 2^-128.
    Each cut reads keys and columns once on either side, of whole-number keys only in the differing ranges.
    """
    found = differing(source, target, keys, columns, **options)
    if found.parts == []:
        return diff_rows(source.limit(0), target.limit(0), keys, columns)
    return diff_rows(found.rows_of(source, keys).drop("_place"), found.rows_of(target, keys).drop("_place"), keys, columns)
