"""What a run works on: symbol lists, overrides, series codes and date windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import clean_code, first_non_blank
from tidemark.operators.registry import scheduled_universe
from tidemark.schemas import MACRO_SERIES


def clean_symbols(requests: DataFrame, column: str = "symbol", case: str = "upper") -> DataFrame:
    """Codes trimmed and folded, blanks left out, repeats kept."""
    return requests.withColumn(column, clean_code(column, case)).where(F.col(column).isNotNull())


def require_any(requests: DataFrame) -> DataFrame:
    if requests.isEmpty():
        raise ValueError("at least one symbol is needed")
    return requests


def listed_codes(column: Column, case: str = "upper") -> Column:
    """The codes of a comma list as an array, in order, without blanks; empty for null."""
    codes = F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda c: clean_code(c, case))
    return F.array_compact(codes)


def joined_codes(codes: Column) -> Column:
    """Codes as the comma list a fetch is asked for, cleaned like those of a request."""
    return F.array_join(F.array_compact(F.transform(codes, lambda c: clean_code(c))), ",")


def selected_series(override: Column) -> Column:
    """The macro series of a run: the override list in lower case, else all that are known, sorted."""
    named = listed_codes(override, "lower")
    every = F.array(*[F.lit(code) for code in sorted(MACRO_SERIES)])
    return F.when(F.size(named) > 0, named).otherwise(every)


def selected_tickers(registry: DataFrame, override: str | None, limit: int = 0) -> DataFrame:
    """Tickers of a run: the override list if it names any, else the scheduled universe.

    A positive ``limit`` keeps the first ones, of the registry in ticker order.
    """
    spark = registry.sparkSession
    chosen = spark.range(1).select(
        F.posexplode(listed_codes(F.lit(override))).alias("position", "ticker")
    )
    if override and any(part.strip() for part in override.split(",")):
        first = chosen.where(F.col("position") < limit) if limit > 0 else chosen
        return first.select("ticker")
    universe = scheduled_universe(registry)
    return universe.orderBy("ticker").limit(limit) if limit > 0 else universe


def date_window(start: Column, end: Column, run_day: Column) -> tuple[Column, Column]:
    """Start defaults to the run day, end to the start; blanks count as absent."""
    first = first_non_blank(F.trim(start), run_day)
    return first, first_non_blank(F.trim(end), first)
