"""Per-key simple returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.functions.columns import simple_return


def with_previous(
    df: DataFrame,
    column: str,
    out: str,
    group_by: str = "symbol",
    order_by: str = "ts",
    period: str | None = None,
) -> DataFrame:
    """Add ``out``: the value of ``column`` one row earlier in the same group.

    Days: one window over the group, which holds a row a day and so a few thousand rows; the input is
    read once. Timestamps: the window runs over (group, day), or another ``period``, so a group with
    a third of all rows is spread over its periods. Only the first row of a period looks outside: it
    takes the closing value of the group's period before, from a table of one row per (group,
    period) that is aggregated before it is shuffled. That reads the input twice. Which form is taken
    follows from the type of ``order_by`` alone, or from ``period`` where one is given.
    """
    if period is None:
        if isinstance(df.schema[order_by].dataType, T.DateType):
            whole = Window.partitionBy(group_by).orderBy(order_by)
            return df.select("*", F.lag(column).over(whole).alias(out))
        period = "day"
    split = df.withColumn("_span", F.date_trunc(period, order_by).cast("timestamp_ntz"))

    closing = split.groupBy(group_by, "_span").agg(F.max_by(column, order_by).alias("_close"))
    by_span = Window.partitionBy(group_by).orderBy("_span")
    carried = closing.select(
        F.col(group_by).alias("_g"),
        F.col("_span").alias("_s"),
        F.lag("_close").over(by_span).alias("_carry"),
    )

    inside = Window.partitionBy(group_by, "_span").orderBy(order_by)
    located = split.select(
        "*",
        (F.row_number().over(inside) == 1).alias("_opens"),
        F.lag(column).over(inside).alias("_prev"),
    )
    same_span = F.col(group_by).eqNullSafe(F.col("_g")) & F.col("_span").eqNullSafe(F.col("_s"))
    return located.join(carried, same_span, "left").select(
        *df.columns, F.when(F.col("_opens"), F.col("_carry")).otherwise(F.col("_prev")).alias(out)
    )


def add_return(
    df: DataFrame,
    column: str,
    group_by: str = "symbol",
    order_by: str = "ts",
    period: str | None = None,
) -> DataFrame:
    """Add ``{column}_returns``: value over previous value in the group, minus one.

    The first row of a group is null, gaps in time are not filled, and groups never mix. ``period``
    is the time unit a group is split by, see ``with_previous``.
    """
    located = with_previous(df, column, "_prior", group_by, order_by, period)
    returns = simple_return(F.col(column), F.col("_prior"))
    return located.withColumn(f"{column}_returns", returns).drop("_prior")


def add_return_with_history(
    batch: DataFrame,
    stored: DataFrame,
    column: str = "close",
    group_by: str = "symbol",
    order_by: str = "ts",
) -> DataFrame:
    """Returns of the batch rows, where the row before a batch row may be a stored one.

    Stored rows that the batch replaces do not count. Of the stored rows before the batch's first
    time, each map task sends only the latest per key; those after its last time are not read.
    """
    first, final = (batch.agg(f(order_by)).scalar() for f in (F.min, F.max))
    known = stored.select(group_by, order_by, column)
    time = F.col(order_by)
    latest_before = (
        known.where(time < first)
        .groupBy(group_by)
        .agg(F.max_by(column, order_by).alias(column), F.max(order_by).alias(order_by))
    )
    between = known.where((time >= first) & (time <= final)).join(
        batch.select(group_by, order_by), [group_by, order_by], "left_anti"
    )
    context = latest_before.unionByName(between).join(
        batch.select(group_by).distinct(), group_by, "left_semi"
    )
    both = batch.withColumn("_batch", F.lit(True)).unionByName(
        context.withColumn("_batch", F.lit(False)), allowMissingColumns=True
    )
    return add_return(both, column, group_by, order_by).where("_batch").drop("_batch")


def returns_around(batch: DataFrame, stored: DataFrame, first, final) -> DataFrame:
    """The batch rows with ``close_returns``, and the stored rows whose return a batch row changes.

    A batch row follows the row before it in its symbol, stored or in the batch. The stored row that
    comes to follow a batch row is returned whole, with its return anew; so days may be loaded in any
    order, and the table ends up as if they had come in theirs. Stored rows that the batch replaces do
    not count. ``first`` and ``final`` are the batch's first and last day. Of the stored rows before
    them only each symbol's latest goes on, of those behind them only the earliest.
    """
    time = F.col("ts")
    whole = F.struct(*stored.columns)
    symbols = batch.select("symbol").distinct()
    known = stored.join(symbols, "symbol", "left_semi")

    before, behind = known.where(time < F.lit(first)), known.where(time > F.lit(final))
    between = known.where(time.between(F.lit(first), F.lit(final))).join(
        batch.select("symbol", "ts"), ["symbol", "ts"], "left_anti"
    )
    # Nothing before the batch follows a batch row, so of those rows the value is enough.
    latest = before.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
    earliest = behind.groupBy("symbol").agg(F.min_by(whole, time).alias("_row")).select("_row.*")
    context = between.unionByName(earliest).unionByName(latest, allowMissingColumns=True)
    both = batch.withColumn("_batch", F.lit(True)).unionByName(
        context.withColumn("_batch", F.lit(False)), allowMissingColumns=True
    )
    located = with_previous(with_previous(both, "close", "_prior"), "_batch", "_follows")
    touched = located.where(F.col("_batch") | F.col("_follows"))
    return touched.withColumn("close_returns", simple_return(F.col("close"), F.col("_prior"))).drop(
        "_batch", "_prior", "_follows"
    )
