"""Reading tables whole, by key range, by position, by key cursor, and as batches or samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablebridge.sources.shared import stored

#: Rows of a batch where none or a non-positive size is given.
BATCH_SIZE = 1000
#: Rows of a task where work on a row is heavy.
TASK_ROWS = 50_000
# Key types that can be split by range.
INTEGER_TYPES = "int int2 int4 int8 integer bigint smallint tinyint mediumint serial bigserial smallserial".split()


def scan_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, key: str, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """df (of about `rows` rows) dealt by a key into tasks of about `each` rows, for heavy work on rows: as many as there are cores at least, however few bytes there are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / each)), key)


def scan_pk_range(df: DataFrame, pk: str, low, high, inclusive: bool = True, limit: int | None = None) -> DataFrame:
    """Rows with low <= pk <= high (or < high), by pk; the range reaches the source's own filter."""
    upper = F.col(pk) <= high if inclusive else F.col(pk) < high
    rows = df.where((F.col(pk) >= low) & upper)
    return rows if limit is None else rows.orderBy(pk).limit(limit)


def pk_bounds(df: DataFrame, pk: str) -> DataFrame:
    """lo, hi, n in one row; nulls and 0 for an empty table."""
    return df.agg(F.min(pk).cast("long").alias("lo"), F.max(pk).cast("long").alias("hi"), F.count("*").alias("n"))


def _width(n: int) -> Column:
    return F.ceil((F.col("hi") - F.col("lo") + 1) / n).cast("long")


def pk_segments(df: DataFrame, pk: str, n: int) -> DataFrame:
    """seg_id, seg_from, seg_to, rows: closed ranges of equal width, fewer than n where the key span is short, none for an empty table."""
    ranges = pk_bounds(df, pk).where("lo IS NOT NULL").withColumn("w", _width(n))
    ranges = ranges.select("lo", "hi", "w", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("seg_id")).where(F.col("lo") + F.col("seg_id") * F.col("w") <= F.col("hi"))
    start = F.col("lo") + F.col("seg_id") * F.col("w")
    ranges = ranges.select("seg_id", start.alias("seg_from"), F.least(start + F.col("w") - 1, "hi").alias("seg_to"))
    counts = assign_pk_segment(df, pk, n).groupBy("seg_id").agg(F.count("*").alias("rows"))
    return ranges.join(counts, "seg_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def assign_pk_segment(df: DataFrame, pk: str, n: int) -> DataFrame:
    """df with the seg_id of each row; the bounds are one broadcast row."""
    bounds = pk_bounds(df, pk).select("lo", "hi", _width(n).alias("w"))
    return df.crossJoin(F.broadcast(bounds)).withColumn("seg_id", F.floor((F.col(pk) - F.col("lo")) / F.col("w")).cast("int")).drop("lo", "hi", "w")


def with_position(df: DataFrame, order_by: list[str], parts: int | None = None) -> DataFrame:
    """df with `position`, the row's place from 0 in the order, without a window over all rows in one task.

    Rows are dealt into a fixed number of ranges (spark.sql.shuffle.partitions unless given), sorted, and written to the
    shared folder with their range and their place in it, so that both are settled before anything is counted. The
    ranges' counts, one number each, give every range its offset. Ties are placed in any order, but in one for all uses.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by).withColumn("_at", at)
    part = F.shiftright("_at", 33).cast("int")
    placed = stored(dealt.withColumns({"_part": part, "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).cast("long").alias("_offset"))
    # one row a range, so at most n rows are broadcast
    return placed.join(F.broadcast(offsets), "_part").withColumn("position", F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset")


def offset_segments(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """df with position and seg_id: segment i owns the positions [i * s, (i + 1) * s), s = ceil(rows / n)."""
    placed = with_position(df, order_by)
    size = max(1, math.ceil(placed.count() / n))
    return placed.withColumn("seg_id", F.floor(F.col("position") / size).cast("int"))


def is_integer_type(text: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(text)), r"^([^( ]*)", 1).isin(INTEGER_TYPES)


def choose_split(columns: DataFrame, workers: int, force_offset: bool = False) -> DataFrame:
    """table_name, mode (sequential, pk_range or offset), pk_col, from columns (table_name, column_name, type, is_pk)."""
    keys = columns.groupBy("table_name").agg(
        F.count_if("is_pk").alias("keys"),
        F.max(F.when(F.col("is_pk"), F.col("column_name"))).alias("pk"),
        F.coalesce(F.bool_and(F.when(F.col("is_pk"), is_integer_type(F.col("type")))), F.lit(False)).alias("whole"),
    )
    single = (F.col("keys") == 1) & F.col("whole") & F.lit(not force_offset)
    mode = F.when(F.lit(workers <= 1), "sequential").when(single, "pk_range").otherwise("offset")
    return keys.select("table_name", mode.alias("mode"), F.when(mode == "pk_range", F.col("pk")).alias("pk_col"))


def keyset_page(df: DataFrame, key: str, last=None, limit: int = BATCH_SIZE) -> DataFrame:
    """The next `limit` rows in key order after `last`."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(limit)


def encode_key(key: Column) -> Column:
    return key.cast("string")


def decode_key(token: Column, kind: Column) -> Column:
    """(as_long, as_object_id, as_text): a number for integer plans, an object id for 24 hex digits, else text."""
    whole = kind.isin("integer", "bigint")
    number = F.when(whole, token.try_cast("long"))
    oid = number.isNull() & token.rlike("^[0-9a-f]{24}$")
    return F.struct(number.alias("as_long"), F.when(oid, token).alias("as_object_id"), F.when(number.isNull() & ~oid, token).alias("as_text"))


def batch_manifest(df: DataFrame, key: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    """batch_id (from 1), rows_in_batch, first_key, last_key, rows_cum: what a keyed scan in batches records."""
    size = batch_size if batch_size > 0 else BATCH_SIZE
    placed = with_position(df.select(key), [key]).withColumn("batch_id", (F.floor(F.col("position") / size) + 1).cast("long"))
    batches = placed.groupBy("batch_id").agg(F.count("*").alias("rows_in_batch"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    # all batches but the last are full, so the running count needs no window over all batches
    return batches.withColumn("rows_cum", (F.col("batch_id") - 1) * size + F.col("rows_in_batch"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def estimated_counts(spark: SparkSession, paths: dict[str, str], exact: bool = False) -> DataFrame:
    """table_name, rows of Parquet tables from the row counts in their file footers, no column being read; with exact by row_counts(), and where that fails from the footers after all."""
    if exact:
        try:
            return spark.createDataFrame(row_counts({n: spark.read.parquet(p) for n, p in paths.items()}).collect(), "table_name string, rows long")  # a row a table
        except Exception:
            return estimated_counts(spark, paths)
    footers = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in footers}
    for k, v in footers.items():
        spark.conf.set(k, v)
    try:
        rows = [(n, spark.read.parquet(p).agg(F.count("*")).first()[0] or 0) for n, p in paths.items()]  # empty files give none
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.createDataFrame(rows, "table_name string, rows long")


def sample_size(counts: DataFrame, percent: float = 1.0, threshold: int = 100_000, small: int = 2_000, most: int = 50_000) -> DataFrame:
    """counts (…, rows) with sample_n: all at 100 percent, `small` below the threshold, else the percentage between 1 and `most`; non-positive options take the defaults."""
    percent, threshold, small, most = (x if x > 0 else d for x, d in ((percent, 1.0), (threshold, 100_000), (small, 2_000), (most, 50_000)))
    share = F.least(F.greatest(F.floor(F.col("rows") * percent / 100), F.lit(1)), F.lit(most))
    return counts.withColumn("sample_n", F.when(F.lit(percent >= 100), F.col("rows")).when(F.col("rows") < threshold, F.lit(small)).otherwise(share).cast("long"))


def sample_documents(df: DataFrame, key: str, n: int, seed: int = 42, spare: int = 1000) -> DataFrame:
    """n rows without replacement, those whose keys hash lowest: the same ones on each run; all where there are no more.

    Rows are counted by the leading bits of their hash, a scan of the key alone; the bucket that the n-th row falls into is
    counted by further bits until about `spare` rows are left in it. Rows below it are taken by their hash where they lie, and
    only those of the bucket are sorted: no task holds the sample.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    low, high, left = -(1 << 63), (1 << 63) - 1, n  # the bucket's ends, and how many of its rows belong to the sample
    bits = 64
    while bits > 0:
        bits = max(0, bits - 12)
        inside = hashed.where(F.col("_h").between(low, high)).groupBy(F.shiftright("_h", bits).alias("b")).agg(F.count("*").alias("n"))
        for bucket, rows in sorted(map(tuple, inside.collect())):  # at most 4096
            if rows >= left:
                low, high = bucket << bits, (bucket << bits) + (1 << bits) - 1
                break
            left -= rows
        else:
            return df  # no more rows than asked for
        if rows <= max(spare, left):
            break
    below = hashed.where(F.col("_h") < low)
    return below.union(hashed.where(F.col("_h").between(low, high)).orderBy("_h", key).limit(left)).drop("_h")


def filter_collections(listing: DataFrame) -> DataFrame:
    """Without system.*, *.files, *.chunks, views and time series."""
    name = F.col("name")
    return listing.where(~name.startswith("system.") & ~name.endswith(".files") & ~name.endswith(".chunks") & ~F.col("kind").isin("view", "timeseries"))


def _bare(name: Column) -> Column:
    return F.substring_index(F.lower(F.trim(name)), ".", -1)


def select_tables(tables: DataFrame, requested: DataFrame) -> DataFrame:
    """tables (table_name) that requested (name) names, whatever the case; schema.table matches by its last part or whole."""
    wanted = requested.select(F.explode(F.array_distinct(F.array(F.lower(F.trim("name")), _bare(F.col("name"))))).alias("_w")).distinct()
    return tables.join(wanted, F.lower("table_name") == F.col("_w"), "left_semi")


def missing_tables(tables: DataFrame, requested: DataFrame) -> DataFrame:
    """requested names that no table matches."""
    have = tables.select(F.lower("table_name").alias("_h")).distinct()
    # one equi-join after the other, as an OR of both would compare every pair
    left = requested.join(have, F.lower(F.trim("name")) == F.col("_h"), "left_anti")
    return left.join(have, _bare(F.col("name")) == F.col("_h"), "left_anti")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """table_name of the base tables of a catalog database, by name."""
    tables = spark.sql(f"SHOW TABLES IN {database}" if database else "SHOW TABLES")
    return tables.where("NOT isTemporary").select(F.col("tableName").alias("table_name")).orderBy("table_name")


def human_size(size: Column) -> Column:
    out = F.format_string("%d B", size)
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**i, F.format_string(f"%.1f {unit}", size / float(1024**i))).otherwise(out)
    return out


def table_inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table_name, files, size_bytes, size_human; file contents are not read."""
    out = None
    for name, path in paths.items():
        one = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select(F.lit(name).alias("table_name"), "length")
        out = one if out is None else out.union(one)
    sizes = out.groupBy("table_name").agg(F.count("*").alias("files"), F.sum("length").alias("size_bytes"))
    return sizes.withColumn("size_human", human_size(F.col("size_bytes")))


def database_inventory(inventory: DataFrame, database: str = "default") -> DataFrame:
    """database, tables, files, size_bytes, size_human: the sums over table_inventory() in one row."""
    zero = F.lit(0).cast("long")
    sums = inventory.agg(F.count("*").alias("tables"), F.coalesce(F.sum("files"), zero).alias("files"), F.coalesce(F.sum("size_bytes"), zero).alias("size_bytes"))
    return sums.select(F.lit(database).alias("database"), "*", human_size(F.col("size_bytes")).alias("size_human"))


def read_jdbc(spark: SparkSession, url: str, table: str, pk: str | None = None, n: int = 8, properties: dict | None = None) -> DataFrame:
    """A JDBC table, split into n key ranges where pk names an integer key: the ranges run as predicates in the database."""
    props = properties or {}
    whole = spark.read.jdbc(url, table, properties=props)
    if pk is None or not isinstance(whole.schema[pk].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return whole
    low, high, rows = pk_bounds(whole, pk).first()
    if not rows:
        return whole
    return spark.read.jdbc(url, table, column=pk, lowerBound=low, upperBound=high + 1, numPartitions=n, properties=props)
