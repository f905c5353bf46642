"""Read queries on the Gold tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.registry import instrument, registered
from tidemark.schemas import DEFAULT_LIMIT, MAX_LIMIT

# The columns each read returns.
PRICE_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume", "close_returns")
FACT_COLUMNS = ("ticker", "concept", "unit", "period_end", "fy", "fp", "form", "val")
INSTRUMENT_COLUMNS = (
    *("id", "ticker", "name", "exchange", "currency", "timezone", "is_active", "is_scheduled"),
)
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
FACT_ORDER = ("concept", "unit", "fp", "form")


class NotRegistered(LookupError):
    """The ticker of a read is not in the registry."""


def require_registered(registry: DataFrame, ticker: str) -> None:
    if instrument(registry, ticker).isEmpty():
        raise NotRegistered(f"{ticker!r} is not registered")


def _checked(limit: int) -> int:
    if limit > MAX_LIMIT:
        raise ValueError(f"limit must be at most {MAX_LIMIT}")
    return limit


def between(
    rows: DataFrame, start: date | str | None, end: date | str | None, time: str = "ts"
) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an absent bound is open."""
    if start is not None:
        rows = rows.where(F.col(time) >= F.lit(str(start)).cast("date"))
    if end is not None:
        rows = rows.where(F.col(time) <= F.lit(str(end)).cast("date"))
    return rows


def prices(
    table: DataFrame,
    registry: DataFrame,
    ticker: str,
    *,
    start: date | str | None = None,
    end: date | str | None = None,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """The oldest ``limit`` price rows of a ticker in a day range; no row if not registered."""
    rows = between(table.where(F.col("symbol") == F.lit(ticker.upper())), start, end)
    known = registered(rows, instrument(registry, ticker), "symbol")
    return known.orderBy("ts").limit(_checked(limit)).select(*PRICE_COLUMNS)


def fundamentals(
    table: DataFrame,
    registry: DataFrame,
    ticker: str,
    *,
    concept: str | None = None,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """The latest ``limit`` facts of a ticker; rows of one period are ordered by the rest of the
    key."""
    rows = table.where(F.col("ticker") == F.lit(ticker.upper()))
    if concept is not None:
        rows = rows.where(F.col("concept") == F.lit(concept))
    known = registered(rows, instrument(registry, ticker))
    order = (F.desc("period_end"), *FACT_ORDER)
    return known.orderBy(*order).limit(_checked(limit)).select(*FACT_COLUMNS)


def figi_candidates(table: DataFrame, ticker: str) -> DataFrame:
    """Every identifier on file for a ticker."""
    return table.where(F.col("ticker") == F.lit(ticker.upper()))


def top_per_key(
    rows: DataFrame,
    key: str,
    order: Sequence[Column | str],
    limit: int = DEFAULT_LIMIT,
    salts: int = 32,
) -> DataFrame:
    """The first ``limit`` rows of every key, for all keys in one job.

    The salt is the input partition, so that a map task has one part of a key and not a piece of all:
    each key is first cut down in ``salts`` parts, of the rows of some map tasks each, and what is
    left of them as a whole. Spark also cuts each part down ahead of the shuffle, to ``limit`` rows of a
    key and map task, up to a limit that the session sets (``GROUP_LIMIT``); it is raised to this one.
    """
    spark = rows.sparkSession
    if 0 <= int(spark.conf.get(GROUP_LIMIT)) < limit:
        spark.conf.set(GROUP_LIMIT, limit)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    part = Window.partitionBy(key, "_salt").orderBy(*by)
    cut = salted.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= limit)
    whole = Window.partitionBy(key).orderBy(*by)
    return (
        cut.drop("_salt", "_rank")
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def prices_per_symbol(
    table: DataFrame, registry: DataFrame, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """The price read for all registered symbols at once."""
    known = registered(table.select(*PRICE_COLUMNS), registry, "symbol")
    return top_per_key(known, "symbol", ["ts"], _checked(limit))


def fundamentals_per_ticker(
    table: DataFrame, registry: DataFrame, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """The fundamentals read for all registered tickers at once."""
    order = [F.desc("period_end"), *FACT_ORDER]
    return top_per_key(registered(table.select(*FACT_COLUMNS), registry), "ticker", order, _checked(limit))
