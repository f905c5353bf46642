"""Flat rows to Silver frames: types, fills, one row per key.

Global order is not part of a DataFrame here; the Silver writer sorts inside its files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.columns import lenient_date, strict_date
from tidemark.operators.dedup import keep_last

PRICES_KEY = ("symbol", "ts")
MACRO_KEY = ("series", "ts")
FACTS_KEY = ("ticker", "concept", "unit", "period_end", "fp", "form")
FIGI_KEY = ("ticker", "figi")


def clean_prices(rows: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """A malformed day raises; a fractional volume loses its fraction, NaN raises."""
    typed = rows.withColumns(
        {
            "symbol": F.col("symbol").cast("string"),
            "ts": strict_date("ts"),
            "volume": F.col("volume").cast("bigint"),
        }
    )
    return keep_last(typed, PRICES_KEY, order).drop("ord")


def clean_macro(rows: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    typed = rows.withColumns({"series": F.col("series").cast("string"), "ts": strict_date("ts")})
    return keep_last(typed, MACRO_KEY, order).drop("ord")


def clean_facts(rows: DataFrame, order: Sequence[str] = ("filed", "ord")) -> DataFrame:
    """The latest filed observation per key; an unknown filing day loses to any known one.

    Where a batch holds several fetches of one ticker, pass ``ENVELOPE_FIRST`` as the order: the
    later fetch wins, and filing days decide inside a fetch. That is what loading the fetches one
    after the other gives.
    """
    typed = rows.withColumns(
        {
            "period_start": lenient_date("period_start"),
            "period_end": strict_date("period_end"),
            "filed": lenient_date("filed"),
            "fp": F.coalesce("fp", F.lit("UNK")),
            "form": F.coalesce("form", F.lit("UNK")),
        }
    )
    if tuple(order) != ENVELOPE_FIRST:
        return keep_last(typed, FACTS_KEY, order).drop("ord")
    # The envelope goes ahead of the filing day: of ``ord`` the place within it is left, and the run need not
    # travel a second time.
    typed = typed.withColumns({"_env": F.col("ord._env"), "ord": F.col("ord").dropFields("_env")})
    kept = keep_last(typed.drop("bronze_run_id"), FACTS_KEY, order)
    return kept.withColumn("bronze_run_id", F.col("_env.run")).select(*rows.drop("ord").columns)


ENVELOPE_FIRST = ("_env", "filed", "ord")


def clean_figi(rows: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    return keep_last(rows, FIGI_KEY, order).drop("ord")
