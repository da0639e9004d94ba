"""Load modes over external catalog tables stored as parquet.

Every mode has two halves. ``prepare`` writes the new content to a folder of its own, which
changes nothing that a reader sees, and returns the ``Change`` that will publish it: statements
that set locations, and files to move into the table. ``publish`` carries a change out; doing so
twice, or again after a death half way, has the effect of doing it once. ``sinks.journal`` keeps
the changes of a run until all are published. One writer per table is assumed.

The keyed modes use the new rows more than once, so these are first written to the shared
folder: they are computed once, cannot differ between the uses, and their size is known
when the join with the table is planned. ``staged`` says that the caller has done so and,
where there is a key, that every key has one row.

A table may be created with key buckets: a last partition column that is a hash of the key. Any load by
that key, or by more columns, then reads and rewrites only the buckets that its rows fall into.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.aggregates import monthly_rollup
from millrace.operators.windows import deduplicate
from millrace.session import materialize
from millrace.sinks import constraints


# The column and the table property of key buckets.
BUCKET = "key_bucket"
BUCKETS = "millrace.buckets"


@dataclass(frozen=True)
class KeyBuckets:
    """``count`` partitions by a hash of ``key``. Choose as many as give buckets of one to a few files:
    a bucket is what the smallest load rewrites."""

    key: tuple[str, ...]
    count: int

    def of(self) -> Column:
        """The bucket of a row whose key columns have the table's types."""
        return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in self.key]), F.lit(self.count)).cast("int")


def key_buckets(spark: SparkSession, table: str) -> KeyBuckets | None:
    kept = constraints.kept_property(spark, table, BUCKETS)
    return KeyBuckets(tuple(kept["key"]), kept["count"]) if kept else None


def create_table(
    spark: SparkSession,
    name: str,
    schema: T.StructType | str,
    location: str,
    partition_by: Sequence[str] = (),
    buckets: KeyBuckets | None = None,
) -> None:
    """``CREATE TABLE IF NOT EXISTS`` at a fixed location. Partition columns come last. Of a column list, NOT NULL,
    DEFAULT and VARCHAR lengths are kept for the loads (``constraints``). With ``buckets`` the table
    gets a column ``key_bucket``, which loads fill."""
    columns, rules = constraints.parse(schema) if isinstance(schema, str) else (
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), {}
    )
    kept = None
    if buckets:
        if buckets.count < 1 or not buckets.key:
            raise ValueError("key buckets need a key and a positive count")
        columns, partition_by = f"{columns}, `{BUCKET}` INT", [*partition_by, BUCKET]
        kept = {BUCKETS: {"key": list(buckets.key), "count": buckets.count}}
    parts = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {parts} LOCATION '{location}' "
        + constraints.properties(rules, kept)
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast to the target's columns; a missing column becomes NULL."""
    return constraints.conform(df, schema)


def _conformed(df: DataFrame, table: str) -> DataFrame:
    """``df`` as rows of ``table``, by its constraints."""
    spark = df.sparkSession
    out = constraints.conform(df, spark.table(table).schema, constraints.declared(spark, table))
    buckets = key_buckets(spark, table)
    return out.withColumn(BUCKET, buckets.of()) if buckets else out


def _decided_by(spark: SparkSession, table: str, partitions: Sequence[str], key: Sequence[str]) -> bool:
    """Whether rows with an equal key are in the same partition."""
    buckets = key_buckets(spark, table)
    known = {*key, BUCKET} if buckets and set(buckets.key) <= set(key) else set(key)
    return bool(partitions) and set(partitions) <= known


@dataclass(frozen=True)
class Change:
    """What publishes a prepared load: files to move from folder to folder, then statements.
    Without a table, the rows of a plain folder (``prepare_files``)."""

    table: str | None
    moves: tuple[tuple[str, str], ...] = ()
    statements: tuple[str, ...] = ()


def publish(spark: SparkSession, change: Change) -> None:
    """Carry ``change`` out, or the rest of it."""
    for source, target in change.moves:
        _move_files(spark, source, target)
    for statement in change.statements:
        spark.sql(statement)
    if change.table:
        spark.catalog.refreshTable(change.table)


def prepare_files(df: DataFrame, path: str) -> Change:
    """Rows to add to a plain parquet folder."""
    folder = f"{path.rstrip('/')}.versions/{uuid.uuid4().hex}"
    _write(df, folder)
    return Change(None, ((folder, path),))


def append(df: DataFrame, table: str, max_files: int | None = None) -> None:
    """Add rows."""
    publish(df.sparkSession, prepare_append(df, table, max_files))


def prepare_append(df: DataFrame, table: str, max_files: int | None = None) -> Change:
    spark = df.sparkSession
    out = _conformed(df, table)
    partitions = _partition_columns(spark, table)
    folder = _new_folder(spark, table)
    _write(out.coalesce(max_files) if max_files else out, folder, partitions)
    if not partitions:
        return Change(table, ((folder, _location(spark, table)),))
    # A partition's folder gets the files; partitions without one are added where they were written.
    written = _touched(spark.read.schema(out.schema).parquet(folder), partitions)
    known = _listed_partitions(spark, table)
    moves = [
        (_below(spark, folder, partitions, v), _location(spark, table, _spec(partitions, v)))
        for v in written if v in known
    ]
    added = _switch(spark, table, folder, partitions, [v for v in written if v not in known])
    return Change(table, tuple(moves), added)


def replace(df: DataFrame, table: str) -> None:
    """Put ``df`` in the place of the whole content."""
    publish(df.sparkSession, prepare_replace(df, table))


def prepare_replace(df: DataFrame, table: str) -> Change:
    spark = df.sparkSession
    out = _conformed(df, table)
    partitions = _partition_columns(spark, table)
    folder = _new_folder(spark, table)
    _write(out, folder, partitions)
    if not partitions:
        return Change(table, (), (f"ALTER TABLE {table} SET LOCATION '{folder}'",))
    fresh = _touched(spark.read.schema(out.schema).parquet(folder), partitions)
    gone = sorted(_listed_partitions(spark, table) - set(fresh), key=str)
    statements = list(_switch(spark, table, folder, partitions, fresh))
    if gone:
        specs = ", ".join(f"PARTITION ({_spec(partitions, v)})" for v in gone)
        statements.append(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    return Change(table, (), tuple(statements))


def insert_ignore(
    df: DataFrame,
    table: str,
    key: Sequence[str],
    order_by: Sequence[str] | None = None,
    staged: bool = False,
) -> None:
    """Add the rows whose key the table lacks; of equal new keys the first by order wins."""
    publish(df.sparkSession, prepare_insert_ignore(df, table, key, order_by, staged))


def prepare_insert_ignore(
    df: DataFrame,
    table: str,
    key: Sequence[str],
    order_by: Sequence[str] | None = None,
    staged: bool = False,
) -> Change:
    """When the table is partitioned by key columns or key buckets, only partitions that ``df`` touches are read."""
    spark = df.sparkSession
    existing = spark.table(table)
    new = _conformed(df, table)
    if not staged:
        firsts = deduplicate(new, key, list(order_by or key), keep="first")
        new = materialize(firsts, "insert")
    partitions = _partition_columns(spark, table)
    if _decided_by(spark, table, partitions, key):
        existing = existing.where(_partition_filter(existing.schema, partitions, _touched(new, partitions)))
    # The keys that meet, before the rows that do not: a small load is broadcast to the
    # scan of the table, which then needs no shuffle.
    keys = existing.select(*key)
    taken = keys.join(new.select(*key), _same_key(keys, new, key), "left_semi")
    return prepare_append(new.join(taken, _same_key(new, taken, key), "left_anti"), table)


def upsert(
    df: DataFrame,
    table: str,
    key: Sequence[str],
    order_by: Sequence[str] | None = None,
    staged: bool = False,
) -> None:
    """Replace the rows with the same key, add the others; of equal new keys the last wins.

    When the table is partitioned by key columns or key buckets, only the partitions that ``df``
    touches are read and rewritten; else the whole table is.
    """
    publish(df.sparkSession, prepare_upsert(df, table, key, order_by, staged))


def prepare_upsert(
    df: DataFrame,
    table: str,
    key: Sequence[str],
    order_by: Sequence[str] | None = None,
    staged: bool = False,
) -> Change:
    spark = df.sparkSession
    existing = spark.table(table)
    new = _conformed(df, table)
    if not staged:
        lasts = deduplicate(new, key, list(order_by or key), keep="last")
        new = materialize(lasts, "upsert")
    partitions = _partition_columns(spark, table)
    local = _decided_by(spark, table, partitions, key)
    if local:
        touched = _touched(new, partitions)
        if not touched:
            return Change(table)
        base = existing.where(_partition_filter(existing.schema, partitions, touched))
    else:
        base = existing
    merged = base.join(new.select(*key), _same_key(base, new, key), "left_anti").unionByName(new)
    if not local:
        return prepare_replace(merged, table)
    folder = _new_folder(spark, table)
    _write(merged, folder, partitions)
    return Change(table, (), _switch(spark, table, folder, partitions, touched))


def monthly_merge(
    df: DataFrame,
    table: str,
    group_by: Sequence[str],
    first_column: str = "customer_identifier_type",
    modified_column: str = "last_modified",
    staged: bool = False,
) -> None:
    """Roll the new rows up with the existing rows of their months and replace those months.

    The table is partitioned by (year, month); other months are neither read nor written.
    A modification time, if the table has one, becomes that of the newest rows merged in.
    """
    publish(
        df.sparkSession,
        prepare_monthly_merge(df, table, group_by, first_column, modified_column, staged),
    )


def prepare_monthly_merge(
    df: DataFrame,
    table: str,
    group_by: Sequence[str],
    first_column: str = "customer_identifier_type",
    modified_column: str = "last_modified",
    staged: bool = False,
) -> Change:
    spark = df.sparkSession
    existing = spark.table(table)
    new = df if staged else materialize(df, "merge")
    months = _touched(new, ["year", "month"])
    if not months:
        return Change(table)
    predicate = _partition_filter(existing.schema, ["year", "month"], months)
    latest = [modified_column] if modified_column in existing.columns else []
    merged = monthly_rollup(existing, new, group_by, first_column, predicate, latest)
    folder = _new_folder(spark, table)
    _write(conform(merged, existing.schema), folder, ["year", "month"])
    return Change(table, (), _switch(spark, table, folder, ["year", "month"], months))


def _location(spark: SparkSession, table: str, spec: str | None = None) -> str:
    part = f" PARTITION ({spec})" if spec else ""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}{part}").where("col_name = 'Location'").collect()
    # Of a partition the first location is its own, the second the table's.
    return rows[0]["data_type"].rstrip("/")


def _new_folder(spark: SparkSession, table: str) -> str:
    """A fresh folder beside the table's first location."""
    return f"{_location(spark, table).split('.versions/')[0]}.versions/{uuid.uuid4().hex}"


def _move_files(spark: SparkSession, source: str, target: str) -> None:
    """Rename the written files of ``source`` into ``target``. Their names are unique, so a move
    that was cut off goes on where it stopped."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    there = make(target)
    system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(make(source)):
        return
    system.mkdirs(there)
    for status in system.listStatus(make(source)):
        name = status.getPath().getName()
        if name.startswith("part-") and not system.rename(status.getPath(), make(there, name)):
            raise OSError(f"cannot move {name} to {target}")


def _partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


# The folder name Spark gives to a partition without a value, a fixed value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _listed_partitions(spark: SparkSession, table: str) -> set[tuple[str | None, ...]]:
    plain = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    rows = spark.sql(f"SHOW PARTITIONS {table}").collect()
    texts = [[plain(p.split("=", 1)[1]) for p in r[0].split("/")] for r in rows]
    return {tuple(None if v in (NO_VALUE, "null") else v for v in text) for text in texts}


def _spec(partitions: Sequence[str], values: Sequence) -> str:
    def quoted(value: str | None) -> str:
        return "null" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return ", ".join(f"`{c}`={quoted(v)}" for c, v in zip(partitions, values))


def _below(spark: SparkSession, folder: str, partitions: Sequence[str], values: Sequence) -> str:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    names = [NO_VALUE if v is None else escape(v) for v in values]
    return folder + "".join(f"/{c}={v}" for c, v in zip(partitions, names))


def _write(df: DataFrame, folder: str, partitions: Sequence[str] = ()) -> None:
    if BUCKET in partitions:  # a few tasks a bucket, not every task a file in each
        df = df.hint("rebalance", *[F.col(f"`{c}`") for c in partitions])
    writer = df.write
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(folder)


def _switch(
    spark: SparkSession,
    table: str,
    folder: str,
    partitions: Sequence[str],
    written: Sequence[tuple],
) -> tuple[str, ...]:
    """Statements that point the partitions written to ``folder`` there; metadata only.

    All new partitions are added in one statement, with their location; one that exists is only
    pointed elsewhere, so that it is at no time empty or gone.
    """
    known = _listed_partitions(spark, table)
    places = {v: f"PARTITION ({_spec(partitions, v)})" for v in written}
    paths = {v: _below(spark, folder, partitions, v).replace("\\", "\\\\").replace("'", "\\'") for v in written}
    new = [f"{places[v]} LOCATION '{paths[v]}'" for v in written if v not in known]
    statements = [f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(new)}"] if new else []
    statements += [f"ALTER TABLE {table} {places[v]} SET LOCATION '{paths[v]}'" for v in written if v in known]
    return tuple(statements)


def _touched(df: DataFrame, partitions: Sequence[str]) -> list[tuple[str | None, ...]]:
    """The partition values of ``df`` as text: one entry per partition, never rows."""
    rows = df.select(*[F.col(c).cast("string") for c in partitions]).distinct().collect()
    return sorted((tuple(row) for row in rows), key=str)


def _partition_filter(
    schema: T.StructType, partitions: Sequence[str], touched: Sequence[tuple]
) -> Column:
    """A literal predicate on the partition columns, pruned at planning time."""
    if len(partitions) == 1 and touched and all(v is not None for (v,) in touched):
        kind = schema[partitions[0]].dataType
        return F.col(partitions[0]).isin([F.lit(v).cast(kind) for (v,) in touched])
    parts = []
    for values in touched:
        one = [F.col(n).eqNullSafe(F.lit(v).cast(schema[n].dataType)) for n, v in zip(partitions, values)]
        parts.append(_balanced(one, lambda a, b: a & b))
    return _balanced(parts, lambda a, b: a | b) if parts else F.lit(False)


def _balanced(parts: list[Column], joined) -> Column:
    """A tree of logarithmic depth: many partitions don't nest as many levels."""
    while len(parts) > 1:
        parts = [joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _same_key(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    """Null-safe equality: a row with a NULL in its key meets itself when it is loaded again."""
    condition = left[key[0]].eqNullSafe(right[key[0]])
    for c in key[1:]:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition
