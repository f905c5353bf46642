"""Silver and Gold tables on Parquet."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.upsert import TableSpec, directories, refuse_bad_keys, upsert
from tidemark.session import RELEASED, settings
from tidemark.sources import files


def silver_path(root: str, vendor: str, dataset: str) -> str:
    return f"{root}/vendor={vendor}/dataset={dataset}"


def appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that is only appended to, in files or folders of files; one never written is empty."""
    if not files.names(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def write_silver(df: DataFrame, root: str, vendor: str, dataset: str, run_id: str, sort) -> str:
    """Write one run's rows below ``run_id=…/dt=…``, sorted inside each file.

    A run owns its folder, so running it again replaces its own rows and no others.
    """
    path = f"{silver_path(root, vendor, dataset)}/run_id={run_id}"
    # Rebalancing lets Spark size the files at run time, splitting a large day and merging small ones.
    files = df.hint("rebalance", "dt").sortWithinPartitions("dt", *sort)
    with settings(df.sparkSession, RELEASED):
        files.write.mode("overwrite").partitionBy("dt").parquet(path)
    return path


def write_silver_by_key(
    df: DataFrame, root: str, vendor: str, dataset: str, run_id: str, sort, key: tuple[str, ...], tasks: int
) -> str:
    """``write_silver`` for rows that were shuffled by their ``key`` last and are loaded by it next: they are
    written where they lie, in ``tasks`` buckets, so neither this write nor the load shuffles them again.

    Returns the catalog's name of the run as a bucketed table, to be given to ``forget``. The files lie
    where ``write_silver`` puts them, and are read by their path as any others.
    """
    spark, path = df.sparkSession, f"{silver_path(root, vendor, dataset)}/run_id={run_id}"
    table = f"{_database(spark, root)}.run_{hashlib.md5(path.encode()).hexdigest()}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"drop table if exists {table}")
    spark.sql(
        f"""create table {table} ({columns}) using parquet
        options ('partitionOverwriteMode' = 'static', 'compression' = 'zstd')
        partitioned by (dt) clustered by ({", ".join(key)}) sorted by ({", ".join(sort)}) into {tasks} buckets
        location {_quoted(path)}"""
    )
    # As many partitions as buckets, so each bucket is one task's.
    with settings(spark, {**RELEASED, "spark.sql.shuffle.partitions": tasks}):
        df.write.mode("overwrite").insertInto(table)
    return table


def forget(spark: SparkSession, table: str) -> None:
    """Take a run that was written by key out of the catalog; its files stay."""
    spark.sql(f"drop table if exists {table}")


def read_silver(
    spark: SparkSession,
    root: str,
    vendor: str,
    dataset: str,
    schema: T.StructType,
    run_id: str | None = None,
) -> DataFrame:
    """Lazy scan of Silver rows, of one run or of all; ``dt`` and ``run_id`` come from the path."""
    base = silver_path(root, vendor, dataset)
    full = T.StructType(list(schema.fields))
    for name in ("bronze_run_id", "run_id", "dt"):
        full = full.add(name, "string")
    path = f"{base}/run_id={run_id}" if run_id else base
    return spark.read.schema(full).option("basePath", base).parquet(path)


def table_path(root: str, spec: TableSpec) -> str:
    return f"{root}/{spec.name}"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def database_name(root: str) -> str:
    return f"tidemark_{hashlib.md5(root.encode()).hexdigest()[:16]}"


def _database(spark: SparkSession, root: str) -> str:
    """The catalog's database of the tables below ``root``, which is created if it is missing."""
    spark.sql(f"create database if not exists {database_name(root)} location {_quoted(root)}")
    return database_name(root)


def attach(spark: SparkSession, root: str, spec: TableSpec) -> str:
    """The catalog's name of a Gold table, which is created there if it is missing.

    The table is Parquet below ``root``, partitioned by the layout, bucketed and sorted by the key. A
    catalog that outlives the session keeps it; one that doesn't finds the partitions in the folder
    again, and must then be given the spec that the table was begun with.
    """
    table = f"{database_name(root)}.{spec.name}"
    if spark.catalog.tableExists(table):
        return table
    _database(spark, root)
    name, expression = spec.layout
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.schema)
    options = {"partitionOverwriteMode": "dynamic"}
    options |= {f"parquet.bloom.filter.enabled#{c}": "true" for c in spec.sought}
    # As large as a file's values ask for, not a megabyte each.
    options |= {"parquet.bloom.filter.adaptive.enabled": "true"}
    key, path = ", ".join(spec.key), table_path(root, spec)
    spark.sql(
        f"""create table if not exists {table} ({columns}, `{name}` int) using parquet
        options ({", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in options.items())})
        partitioned by (`{name}`) clustered by ({key}) sorted by ({key}) into {spec.files} buckets
        location {_quoted(path)} tblproperties ('layout' = {_quoted(expression)})"""
    )
    if files.names(spark, path):
        spark.sql(f"alter table {table} recover partitions")
    return table


def begun(spark: SparkSession, root: str, spec: TableSpec) -> TableSpec:
    """``spec`` with the layout its table was begun with, its number of directories above all."""
    return _as_begun(spark, attach(spark, root, spec), spec)


def directory(spec: TableSpec) -> Column:
    """The directory a row belongs to, by its key."""
    return F.expr(spec.layout[1]).cast("int")


def _as_begun(spark: SparkSession, table: str, spec: TableSpec) -> TableSpec:
    found = spark.sql(f"show tblproperties {table} ('layout')").first()
    return replace(spec, layout=(spec.layout[0], found["value"]))


def read_table(spark: SparkSession, root: str, spec: TableSpec) -> DataFrame:
    """A Gold table, with its layout column last. A table never written is empty."""
    name = attach(spark, root, spec)
    table = spark.table(name)
    if spec.layout[0] != "bucket":
        return table
    # True of every row. Said aloud, it lets a filter on the key leave all other directories unread.
    return table.where(F.col("bucket") == directory(_as_begun(spark, name, spec)))


def load(
    spark: SparkSession,
    root: str,
    batch: DataFrame,
    spec: TableSpec,
    now: Column,
    unique: DataFrame | None = None,
) -> int:
    """Upsert ``batch`` into a Gold table and return the number of batch rows.

    A key that is repeated or has a null is refused. ``unique`` names a frame with the same key
    columns whose keys are known to be unique, which saves that check. Only the directories the
    batch touches are read and written anew.

    The stored side is bucketed by the key, so it meets the batch without a shuffle of its own, and
    the merged rows are written where they were joined. They replace the directories by an insert
    that overwrites the partitions it has rows for: a load that fails leaves the table as it was, and
    one that is repeated gives what one load would have. A table has one loader at a time.
    """
    spec = begun(spark, root, spec)
    # One row per directory: months, years, or a fixed number of them.
    keys = directories(batch, spec) if unique is None else directories(unique, spec, unique=True)
    found = keys.collect()
    refuse_bad_keys(spec.key, sum(r.repeated for r in found), sum(r.null_keys for r in found))
    count = sum(r.row_count for r in found)
    replace_touched(spark, root, batch, spec, now, [r.directory for r in found], count)
    return count


TASK_ROWS = 1_000_000  # rows that one task of a load joins, sorts and writes
FILE_ROWS = 20_000  # rows that a file of Silver written by key holds at least, on average


def tasks_by_key(spark: SparkSession, root: str, spec: TableSpec, rows: int, days: int) -> int | None:
    """In how many tasks a batch of at most ``rows`` rows of so many ``days`` is to be cleaned, written to
    Silver and loaded where its rows lie by the key. None for a batch that a task could hold, and where the
    days would make too many files."""
    if rows <= TASK_ROWS:
        return None
    table = attach(spark, root, spec)
    held = spark.table(table).count()  # from the footers
    tasks = _tasks(spark, table, held + rows) or _buckets(spark, table)
    return tasks if rows >= FILE_ROWS * tasks * max(days, 1) else None


def replace_touched(
    spark: SparkSession, root: str, batch: DataFrame, spec: TableSpec, now: Column, touched: list[int], count: int,
    dealt: int | None = None,
) -> None:
    """Upsert ``batch``, whose ``count`` rows have unique keys and lie in the directories ``touched``; and by
    the key in so many tasks, if they were ``dealt``."""
    if touched:
        table = attach(spark, root, spec)
        stored = spark.table(table)
        held = stored.where(F.col(spec.layout[0]).isin(touched)).count()  # from the footers
        tasks = dealt or _tasks(spark, table, held + count)
        if dealt and dealt == _buckets(spark, table):
            tasks = None  # both sides lie by the table's own buckets
        merged = merge(stored, batch, spec, now, touched, tasks, bool(dealt))
        # A join with nothing stored would be dropped at run time, and the buckets it is written by with it.
        kept = {"spark.sql.adaptive.enabled": "false"} if dealt else {}
        with settings(spark, {**RELEASED, **kept}):
            merged.withColumn(spec.layout[0], directory(spec)).write.mode("overwrite").insertInto(table)


def _buckets(spark: SparkSession, table: str) -> int:
    described = spark.sql(f"describe table extended {table}").collect()  # a filter of it would be a job
    return next(int(r["data_type"]) for r in described if r["col_name"] == "Num Buckets")


def _tasks(spark: SparkSession, table: str, rows: int) -> int | None:
    """The number of tasks for a load of more rows than a task for each of the table's buckets should
    hold, or None. It is a multiple of the buckets, so each task still writes rows of one bucket only."""
    buckets = _buckets(spark, table)
    shares = -(-rows // (TASK_ROWS * buckets))
    return shares * buckets if shares > 1 else None


def merge(
    table: DataFrame, batch: DataFrame, spec: TableSpec, now: Column, touched: list[int], tasks: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """The rows of the touched directories after the load. With ``tasks`` both sides are dealt to so
    many by the key, where the table's own buckets would be too large for a task each; the batch is not
    if it was ``dealt`` so before."""
    name = spec.layout[0]
    stored = table.where(F.col(name).isin(touched)).drop(name)
    if tasks:
        stored = stored.repartition(tasks, *spec.key)
        batch = batch if dealt else batch.repartition(tasks, *spec.key)
    return upsert(stored, batch, spec, now)
