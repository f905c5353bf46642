"""Planning a historical load in symbol batches and date windows, and checking its coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.numbering import number_rows


def symbol_batches(requests: DataFrame, batch_size: int, position: str = "position") -> DataFrame:
    """Add ``batch_no``: batches of at most ``batch_size`` symbols, in request order."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    numbered = number_rows(requests, position, "_n", ties=["symbol"])
    return numbered.withColumn("batch_no", F.floor(F.col("_n") / F.lit(batch_size))).drop("_n")


def date_windows(start: Column, end: Column, years: int) -> Column:
    """Array of (window_start, window_end): consecutive inclusive windows of at most ``years``
    calendar years; each starts the day after the one before ends.

    The window of February 29 ends on February 28 where the later year has no leap day. A start
    after its end raises.
    """
    if years < 1:
        raise ValueError("years must be at least 1")
    months = 12 * years
    steps = F.floor((F.year(end) - F.year(start)) / F.lit(years)) + 1

    def extend(starts: Column, _: Column) -> Column:
        following = F.date_add(F.add_months(F.element_at(starts, -1), months), 1)
        return F.array_append(starts, following)

    starts = F.aggregate(F.sequence(F.lit(1), steps.cast("int")), F.array(start), extend)
    windows = F.transform(
        F.filter(starts, lambda s: s <= end),
        lambda s: F.struct(
            s.alias("window_start"), F.least(F.add_months(s, months), end).alias("window_end")
        ),
    )
    late = F.raise_error(F.lit("start must not be after end"))
    return F.when(start <= end, windows).otherwise(late.cast("array<struct<window_start:date,window_end:date>>"))


def backfill_plan(
    requests: DataFrame, batch_size: int = 5, years: int = 1, position: str = "position"
) -> DataFrame:
    """One row per (symbol, window) for requests (symbol, position, start, end).

    Windows are unfolded from each request row, so batches and windows meet without a join.
    """
    batched = symbol_batches(requests, batch_size, position)
    windows = date_windows(F.col("start"), F.col("end"), years)
    return batched.select("batch_no", "symbol", F.explode(windows).alias("w")).select(
        "batch_no", "symbol", "w.*"
    )


def window_of(windows: Column, time: Column) -> Column:
    """The window a time falls into, or null. Windows never overlap."""
    inside = F.filter(
        windows, lambda w: (time >= w["window_start"]) & (time <= w["window_end"])
    )
    return F.get(inside, F.lit(0))


def backfill_coverage(
    requests: DataFrame,
    rows: DataFrame,
    batch_size: int = 5,
    years: int = 1,
    position: str = "position",
) -> DataFrame:
    """Rows found per chunk of the plan, zero for empty chunks.

    Rows are counted per (symbol, ts) before they meet their request, and each looks up its one
    window in the request's short array, so rows and windows are never paired.
    """
    chunk = ("batch_no", "window_start", "window_end")
    plan = backfill_plan(requests, batch_size, years, position)
    chunks = plan.groupBy(*chunk).agg(F.count(F.lit(1)).alias("symbols"))

    windows = symbol_batches(requests, batch_size, position).select(
        "symbol", "batch_no", date_windows(F.col("start"), F.col("end"), years).alias("windows")
    )
    days = rows.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("n"))
    found = (
        days.join(windows, "symbol")
        .select("batch_no", window_of(F.col("windows"), F.col("ts")).alias("w"), "n")
        .where("w is not null")
        .groupBy("batch_no", "w.window_start", "w.window_end")
        .agg(F.sum("n").alias("n"))
    )
    return chunks.join(found, list(chunk), "left").select(
        *chunk, "symbols", F.coalesce("n", F.lit(0)).alias("rows")
    )
