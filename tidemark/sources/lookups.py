"""Reference lookups: ticker to filer number, series code to series id, identifier responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.columns import zero_padded_cik
from tidemark.operators.dedup import keep_last
from tidemark.schemas import MACRO_SERIES

CIK_ENTRIES = "map<string, struct<cik_str: string, ticker: string, title: string>>"


def cik_table(documents: DataFrame, text: str = "value") -> DataFrame:
    """(ticker, cik) from JSON texts ``{n: {cik_str, ticker, title}}``.

    Tickers in upper case, numbers padded to ten digits. Of a ticker listed twice the last entry
    counts; where there are several documents, that of the last ``position``.
    """
    at = F.col("position") if "position" in documents.columns else F.lit(0)
    entries = documents.select(
        at.alias("d"), F.posexplode(F.from_json(text, CIK_ENTRIES)).alias("p", "n", "e")
    )
    rows = entries.where("e.ticker is not null").select(
        F.upper("e.ticker").alias("ticker"), zero_padded_cik("e.cik_str").alias("cik"), "d", "p"
    )
    return keep_last(rows, ["ticker"], ["d", "p"]).select("ticker", "cik")


def series_table(spark: SparkSession) -> DataFrame:
    """(series, series_id): a fixed list of eleven."""
    return spark.createDataFrame(sorted(MACRO_SERIES.items()), "series string, series_id string")


def with_series_id(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their vendor id, and those naming an unknown series."""
    known = F.broadcast(series_table(requests.sparkSession))  # fixed size
    wanted = requests.withColumn("series", F.lower("series"))
    return wanted.join(known, "series"), wanted.join(known, "series", "left_anti")


def with_cik(requests: DataFrame, ciks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their filer number, and those without one."""
    wanted = requests.withColumn("ticker", F.upper("ticker"))
    return wanted.join(ciks, "ticker"), wanted.join(ciks, "ticker", "left_anti")


def first_result(results: Column) -> Column:
    """The first entry of a response list, null for an empty or absent list."""
    return F.get(results, F.lit(0))


def split_responses(responses: DataFrame, results: str = "results") -> tuple[DataFrame, DataFrame]:
    """Unwrap one-job identifier responses: rows with ``payload``, and rejects with ``error``."""
    unwrapped = responses.withColumn("payload", first_result(F.col(results)))
    failed = F.col("payload.error").isNotNull()
    good = unwrapped.where(~F.coalesce(failed, F.lit(False)))
    bad = unwrapped.where(failed).withColumn("error", F.col("payload.error"))
    return good.drop(results), bad.drop(results, "payload")
