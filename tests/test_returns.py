import math
from datetime import date, datetime

import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators.returns import add_return, add_return_with_history

SCHEMA = "symbol string, ts date, close double"


def frame(spark, *rows):
    return spark.createDataFrame([(s, date(2026, m, d), c) for s, m, d, c in rows], SCHEMA)


def answers(df, column="close_returns"):
    return [r[column] for r in df.orderBy("symbol", "ts").collect()]


def test_groups_do_not_mix(spark):
    df = frame(spark, ("AAPL", 1, 1, 100.0), ("AAPL", 1, 2, 110.0), ("MSFT", 1, 1, 50.0), ("MSFT", 1, 2, 45.0))
    a, b, c, d = answers(add_return(df, "close"))
    assert a is None and c is None
    assert b == pytest.approx(0.10, abs=1e-9) and d == pytest.approx(-0.10, abs=1e-9)


def test_gaps_nulls_and_zeros(spark):
    df = frame(
        spark, ("A", 1, 1, 1.0), ("A", 3, 1, 2.0), ("A", 4, 1, None), ("A", 5, 1, 4.0),
        ("A", 6, 1, 0.0), ("A", 7, 1, 0.0), ("A", 8, 1, 5.0),
    )
    first, gap, null, after_null, to_zero, zero_zero, from_zero = answers(add_return(df, "close"))
    assert first is None and gap == 1.0 and null is None and after_null is None and to_zero == -1.0
    assert math.isnan(zero_zero) and from_zero == math.inf


def test_null_at_the_end_of_a_period_is_the_previous_value(spark):
    df = spark.createDataFrame(
        [("A", date(2025, 12, 30), 1.0), ("A", date(2025, 12, 31), None), ("A", date(2026, 1, 1), 3.0)],
        SCHEMA,
    )
    assert answers(add_return(df, "close")) == [None, None, None]


def test_no_columns_are_left_behind(spark):
    df = frame(spark, ("A", 1, 1, 1.0))
    assert add_return(df, "close").columns == ["symbol", "ts", "close", "close_returns"]


@pytest.mark.parametrize("period", [None, "year", "month", "hour"])
def test_equals_a_window_over_the_whole_group(spark, period):
    """One group holds a third of the rows; groups, periods and times may be missing days."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("symbol"),
        F.col("id"),
        F.timestamp_micros(F.col("id") * 13_000_000_000 + F.pmod(F.hash("id"), F.lit(7)) * 40_000_000_000).alias("ts"),
        F.when(F.col("id") % 11 != 0, F.round(F.rand(5) * 3)).alias("close"),
    ).dropDuplicates(["symbol", "ts"]).cache()
    plain = Window.partitionBy("symbol").orderBy("ts")
    want = {r.id: r.p for r in df.withColumn("p", F.lag("close").over(plain)).collect()}
    from tidemark.operators.returns import with_previous

    got = {r.id: r.p for r in with_previous(df, "close", "p", period=period).collect()}
    assert got == want
    df.unpersist()


def test_no_task_gets_a_whole_hot_group(spark):
    """The window shuffles by group and period, so a hot group is spread."""
    df = spark.range(100).select(F.lit("hot").alias("symbol"), F.timestamp_seconds(F.col("id") * 7200).alias("ts"),
                                 F.col("id").cast("double").alias("close"))
    plan = add_return(df, "close")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("_span" in line for line in windows)


def test_timestamps_and_other_groups(spark):
    df = spark.createDataFrame(
        [("x", datetime(2026, 1, 1, h), float(v)) for h, v in ((0, 1), (23, 2))]
        + [("x", datetime(2026, 1, 2, 0), 5.0), (None, datetime(2026, 1, 1), 7.0), (None, datetime(2026, 1, 3), 14.0)],
        "venue string, at timestamp, price double",
    )
    found = add_return(df, "price", group_by="venue", order_by="at")
    assert [r.price_returns for r in found.orderBy("venue", "at").collect()] == [None, 1.0, None, 1.0, 1.5]


def test_history(spark):
    stored = frame(spark, ("A", 1, 1, 1.0), ("A", 1, 2, 2.0), ("A", 1, 5, 99.0), ("B", 1, 1, 7.0), ("A", 2, 1, 5.0))
    batch = frame(spark, ("A", 1, 4, 4.0), ("A", 1, 5, 8.0), ("A", 1, 20, 16.0), ("C", 1, 5, 1.0))
    found = add_return_with_history(batch, stored)
    assert answers(found) == [1.0, 1.0, 1.0, None]
    assert found.count() == 4 and set(found.columns) == {*batch.columns, "close_returns"}


def test_history_uses_stored_rows_between_batch_rows(spark):
    stored = frame(spark, ("A", 1, 3, 10.0))
    batch = frame(spark, ("A", 1, 1, 5.0), ("A", 1, 5, 20.0))
    assert answers(add_return_with_history(batch, stored)) == [None, 1.0]


def test_history_without_stored_rows_equals_the_batch(spark):
    batch = frame(spark, ("A", 1, 1, 5.0), ("A", 1, 5, 20.0))
    assert answers(add_return_with_history(batch, batch.where("false"))) == [None, 3.0]


def test_daily_returns_read_their_input_once(spark, tmp_path):
    frame(spark, ("A", 1, 1, 5.0)).write.parquet(str(tmp_path / "bars"))
    plan = add_return(spark.read.parquet(str(tmp_path / "bars")), "close")._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
