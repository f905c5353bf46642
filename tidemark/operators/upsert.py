"""Keyed upserts as a DataFrame operator: target and batch in, new target out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark import schemas


class KeyViolation(ValueError):
    """A batch holds a key twice, or a null in a key column."""


@dataclass(frozen=True)
class TableSpec:
    """What an upsert into one table does.

    ``updated`` columns take the batch value on conflict, null if the batch lacks the column.
    ``updated_if_given`` columns do so only if the batch has them. ``defaults`` fill new rows; on
    conflict such a column keeps its stored value. ``touched`` is set to the load time.
    ``layout`` names the directory column and its expression; a key's rows never move between
    directories, since the expression uses key columns only. A directory's rows lie in ``files`` files,
    by a hash of the key and sorted by it; that is also the number of tasks that load a batch.
    ``sought`` columns have Bloom filters, for reads that look for one value.
    """

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    updated: tuple[str, ...]
    touched: str
    layout: tuple[str, str]
    updated_if_given: tuple[str, ...] = ()
    defaults: tuple[tuple[str, str], ...] = ()
    sort: tuple[str, ...] = ()
    files: int = 8
    sought: tuple[str, ...] = ()

    def with_buckets(self, count: int, files: int | None = None) -> TableSpec:
        """For a table yet to be begun: laid out by ``count`` directories of the first name in its key."""
        key = "ticker" if "ticker" in self.key else self.key[0]
        return replace(self, layout=("bucket", f"pmod(xxhash64({key}), {count})"), files=files or self.files)


BUCKETS = 16  # directories of a table laid out by key, unless begun with another number

PRICES = TableSpec(
    name="prices_1d",
    schema=schemas.GOLD_PRICES,
    key=("symbol", "ts"),
    updated=(
        *("open", "high", "low", "close", "volume"),
        *("dividends", "stock_split", "close_returns", "run_id"),
    ),
    touched="ingested_at",
    # A day's batch rewrites its month alone.
    layout=("month", "100 * year(ts) + month(ts)"),
    defaults=(("source", "yahoo"),),
    sought=("symbol",),
)
MACRO = TableSpec(
    name="macro_series",
    schema=schemas.GOLD_MACRO,
    key=("series", "ts"),
    updated=("value",),
    updated_if_given=("run_id",),
    touched="ingested_at",
    layout=("year", "year(ts)"),
    defaults=(("source", "fred"),),
)
FACTS = TableSpec(
    name="fundamentals",
    schema=schemas.GOLD_FACTS,
    key=("ticker", "concept", "unit", "period_end", "fp", "form"),
    updated=("fy", "period_start", "val", "accn", "filed"),
    updated_if_given=("run_id",),
    touched="ingested_at",
    # A fetch holds a company's whole history, so rows lie by company.
    layout=("bucket", f"pmod(xxhash64(ticker), {BUCKETS})"),
    defaults=(("source", "sec_edgar"),),
    sort=("ticker", "concept", "period_end"),
    sought=("ticker",),
)
FIGI = TableSpec(
    name="instrument_figi",
    schema=schemas.GOLD_FIGI,
    key=("ticker", "figi"),
    updated=(
        *("composite_figi", "share_class_figi", "security_type"),
        *("market_sector", "exch_code", "name"),
    ),
    updated_if_given=("run_id",),
    touched="ingested_at",
    layout=("bucket", f"pmod(xxhash64(ticker), {BUCKETS})"),
    defaults=(("source", "openfigi"),),
    files=4,
    sought=("ticker",),
)
WATERMARKS = TableSpec(
    name="ingestion_watermarks",
    schema=schemas.WATERMARKS,
    key=("source", "dataset", "ticker"),
    updated=("last_ts", "last_run_id"),
    touched="updated_at",
    layout=("bucket", "pmod(xxhash64(ticker), 4)"),
    files=2,
)


def upsert(target: DataFrame, batch: DataFrame, spec: TableSpec, now: Column) -> DataFrame:
    """``target`` after loading ``batch``; ``now`` is the load time.

    One full outer join on the whole key. Keys are unique on both sides, so no key value can be
    hot, and a long series is spread over all tasks by its dates.
    """
    given = set(batch.columns)
    fresh = batch.select(
        *(F.col(c).alias(f"k_{c}") for c in spec.key),
        *(F.col(f.name).cast(f.dataType).alias(f"b_{f.name}") for f in spec.schema if f.name in given),
        F.lit(True).alias("b_given"),
    )
    held = target.select(*spec.schema.names, F.lit(True).alias("t_given"))
    on = [F.col(c) == F.col(f"k_{c}") for c in spec.key]
    joined = held.join(fresh, on, "full_outer")
    loaded, stored = F.col("b_given").isNotNull(), F.col("t_given").isNotNull()
    defaults = dict(spec.defaults)

    def value(field: T.StructField) -> Column:
        name = field.name
        old = F.col(name)
        new = F.col(f"b_{name}") if name in given else F.lit(None).cast(field.dataType)
        if name in spec.key:
            return F.coalesce(F.col(f"k_{name}"), old)
        if name == spec.touched:
            return F.when(loaded, now.cast(field.dataType)).otherwise(old)
        if name in spec.updated or (name in spec.updated_if_given and name in given):
            return F.when(loaded, new).otherwise(old)
        # An explicit value in a new row wins over the default; a stored row keeps its own.
        absent = F.lit(defaults.get(name)).cast(field.dataType)
        inserted = F.coalesce(new, absent) if name in defaults else new
        return F.when(stored, old).otherwise(inserted)

    return joined.select(*(value(f).alias(f.name) for f in spec.schema))


def upsert_watermarks(
    target: DataFrame, batch: DataFrame, now: Column, *, monotonic: bool = False
) -> DataFrame:
    """High-water marks after a batch. As stored values are replaced without comparison, a mark
    can move back; ``monotonic`` keeps the later of the two, with the run that delivered it (of equal
    days, the batch's)."""
    if monotonic:
        stored = F.struct("last_ts", F.lit(0).alias("new"), F.col("last_run_id").alias("run"))
        held = target.select(*WATERMARKS.key, stored.alias("_held"))
        given = F.struct("last_ts", F.lit(1).alias("new"), F.col("last_run_id").alias("run"))
        later = F.greatest(given, "_held")
        batch = (
            batch.join(held, list(WATERMARKS.key), "left")
            .withColumn("_later", later)
            .withColumns({"last_ts": F.col("_later.last_ts"), "last_run_id": F.col("_later.run")})
            .drop("_held", "_later")
        )
    return upsert(target, batch, WATERMARKS, now)


def directories(batch: DataFrame, spec: TableSpec, *, unique: bool = False) -> DataFrame:
    """Per layout directory: the batch's rows, rows that repeat a key, and rows with a null in it.

    With keys known to be ``unique`` this is a plain count, without a shuffle of the keys.
    """
    has_null = F.lit(False)
    for c in spec.key:
        has_null = has_null | F.col(c).isNull()
    n = F.col("n")
    if unique:
        per_key = batch.select(*spec.key, F.lit(1).alias("n"))
    else:
        per_key = batch.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(F.expr(spec.layout[1]).cast("int").alias("directory")).agg(
        F.sum(n).alias("row_count"),
        F.sum(n - 1).alias("repeated"),
        F.sum(F.when(has_null, n).otherwise(0)).alias("null_keys"),
    )


def refuse_bad_keys(key: tuple[str, ...], repeated: int, null_keys: int) -> None:
    if repeated or null_keys:
        raise KeyViolation(
            f"key {key}: {repeated} rows repeat a key, {null_keys} have a null in it"
        )
