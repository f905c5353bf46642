"""Ingestion high-water marks and the start days they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.schemas import DEFAULT_BACKFILL_START

# Fixed values: (source, dataset) of the marks each vendor's job keeps.
PRICES_MARK = ("yahoo", "prices_1d")
MACRO_MARK = ("fred", "macro")
FACTS_MARK = ("sec_edgar", "fundamentals")


def marks_of(watermarks: DataFrame, mark: tuple[str, str] = PRICES_MARK) -> DataFrame:
    source, dataset = mark
    return watermarks.where((F.col("source") == source) & (F.col("dataset") == dataset)).select(
        "ticker", "last_ts"
    )


def last_ts(watermarks: DataFrame, ticker: str, mark: tuple[str, str] = PRICES_MARK) -> DataFrame:
    """The mark of one ticker: one row or none."""
    return marks_of(watermarks, mark).where(F.col("ticker") == F.lit(ticker)).select("last_ts")


def start_per_key(
    requested: DataFrame,
    watermarks: DataFrame,
    mark: tuple[str, str],
    *,
    explicit: Column | None = None,
    run_date: Column | None = None,
) -> DataFrame:
    """(ticker, start) for every requested ticker.

    An explicit start wins. Otherwise prices go on the day after the mark, macro series and
    fundamentals on the mark itself. A key without a mark starts at the default first day, for
    fundamentals on the run day.
    """
    wanted = requested.select("ticker").distinct()
    held = wanted.join(marks_of(watermarks, mark), "ticker", "left")
    resume = F.date_add("last_ts", 1) if mark == PRICES_MARK else F.col("last_ts")
    unseen = F.to_date(F.lit(DEFAULT_BACKFILL_START))
    if mark == FACTS_MARK:
        unseen = run_date if run_date is not None else F.current_date()
    choices = [resume, unseen]
    if explicit is not None:
        choices.insert(0, explicit.cast("date"))
    return held.select("ticker", F.coalesce(*choices).alias("start"))


def batch_start(starts: DataFrame) -> DataFrame:
    """One row: the earliest start of the batch, the default first day if it is empty."""
    default = F.to_date(F.lit(DEFAULT_BACKFILL_START))
    return starts.agg(F.coalesce(F.min("start"), default).alias("start"))


def advance(batch: DataFrame, key: str, time: str, mark: tuple[str, str]) -> DataFrame:
    """New marks after a batch: per key the last time, with the run that delivered it."""
    source, dataset = mark
    return batch.groupBy(F.col(key).alias("ticker")).agg(
        F.lit(source).alias("source"),
        F.lit(dataset).alias("dataset"),
        F.max(F.struct(F.col(time).alias("t"), F.col("bronze_run_id").alias("r"))).alias("m"),
    ).select("source", "dataset", "ticker", F.col("m.t").alias("last_ts"), F.col("m.r").alias("last_run_id"))
