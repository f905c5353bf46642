"""The instrument registry and the checks against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import schemas
from tidemark.operators.dedup import keep_first
from tidemark.operators.numbering import number_rows
from tidemark.operators.upsert import TableSpec

INSTRUMENTS = TableSpec(
    name="universal_instruments",
    schema=schemas.INSTRUMENTS,
    key=("ticker",),
    updated=("id", "name", "exchange", "currency", "timezone", "is_active", "is_scheduled"),
    touched="updated_at",
    layout=("bucket", "pmod(xxhash64(ticker), 4)"),
    files=2,
)


def new_instruments(registry: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """Registry rows to add for candidates that are not registered yet.

    Candidates carry ``ticker``, a whole number ``position`` and, where known, the other columns.
    A registered ticker is left as it is; of a ticker proposed twice the first counts. Ids go on
    from the highest one in the order of ``position``.
    """
    given = set(candidates.columns)

    def field(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in given else default

    ticker = F.upper("ticker")
    named = F.nullif(F.col("name"), F.lit("")) if "name" in given else F.lit(None)
    exchange = F.col("exchange") if "exchange" in given else F.lit(None)
    filled = candidates.select(
        "position",
        ticker.alias("ticker"),
        F.coalesce(named, ticker).alias("name"),
        exchange.cast("string").alias("exchange"),
        field("currency", F.lit("USD")).alias("currency"),
        field("timezone", F.lit("America/New_York")).alias("timezone"),
        field("is_active", F.lit(True)).alias("is_active"),
        field("is_scheduled", F.lit(True)).alias("is_scheduled"),
    )
    first = keep_first(filled, ["ticker"], ["position"])
    unknown = first.join(registry.select("ticker"), "ticker", "left_anti")
    highest = registry.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = number_rows(unknown, "position", "_n", ties=["ticker"])
    return numbered.select(
        (highest + F.col("_n") + 1).cast("int").alias("id"),
        *(c for c in schemas.INSTRUMENTS.names if c not in ("id", "created_at", "updated_at")),
        now.cast("timestamp").alias("created_at"),
        now.cast("timestamp").alias("updated_at"),
    )


def get_or_create(registry: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """The registry with the unknown candidates added."""
    known = registry.select(*schemas.INSTRUMENTS.names)
    return known.unionByName(new_instruments(registry, candidates, now))


def set_scheduled(registry: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The registry after setting flags from (ticker, is_scheduled), one row per ticker.

    Nothing else changes; tickers the registry does not know are ignored here.
    """
    wanted = changes.select(
        F.upper("ticker").alias("_t"), F.col("is_scheduled").alias("_wanted")
    )
    changed = F.col("_wanted").isNotNull() & (F.col("_wanted") != F.col("is_scheduled"))
    joined = registry.join(wanted, F.col("ticker") == F.col("_t"), "left")
    return joined.withColumns(
        {
            "updated_at": F.when(changed, now.cast("timestamp")).otherwise(F.col("updated_at")),
            "is_scheduled": F.coalesce("_wanted", "is_scheduled"),
        }
    ).select(*schemas.INSTRUMENTS.names)


def instrument(registry: DataFrame, ticker: str) -> DataFrame:
    """The row of one ticker, or none."""
    return registry.where(F.col("ticker") == F.lit(ticker.upper()))


def instruments(
    registry: DataFrame, *, is_active: bool | None = None, is_scheduled: bool | None = None
) -> DataFrame:
    """Instruments by ticker, filtered by the flags that are given."""
    if is_active is not None:
        registry = registry.where(F.col("is_active") == is_active)
    if is_scheduled is not None:
        registry = registry.where(F.col("is_scheduled") == is_scheduled)
    return registry.orderBy("ticker")


def scheduled_universe(registry: DataFrame) -> DataFrame:
    return registry.where("is_active and is_scheduled").select("ticker")


def registered(rows: DataFrame, registry: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows whose ticker is registered."""
    return rows.join(_tickers(registry, key), key, "left_semi")


def unregistered(rows: DataFrame, registry: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows whose ticker is not registered: 404 for a read, a reject for a foreign key."""
    return rows.join(_tickers(registry, key), key, "left_anti")


def _tickers(registry: DataFrame, key: str) -> DataFrame:
    return registry.select(F.col("ticker").alias(key))


def missing_symbols(requested: DataFrame, rows: DataFrame) -> DataFrame:
    """Requested symbols the vendor returned no row for.

    Rows are reduced to one per symbol before they meet the request.
    """
    seen = rows.select("symbol").distinct()
    return requested.select("symbol").join(seen, "symbol", "left_anti").withColumn(
        "error", F.lit("no_rows_returned")
    )
