from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import backfill as B
from tidemark.operators import serve

D = date


@pytest.fixture
def registry(spark):
    at = datetime(2026, 1, 1)
    return spark.createDataFrame(
        [(1, "AAPL", "Apple", None, "USD", "America/New_York", True, True, at, at)], schemas.INSTRUMENTS
    )


@pytest.fixture
def prices(spark):
    return spark.createDataFrame(
        [("AAPL", D(2026, 1, d), 1.0, 1.0, 1.0, float(d), 10, None) for d in range(1, 11)]
        + [("NOPE", D(2026, 1, 1), 1.0, 1.0, 1.0, 1.0, 10, None)],
        "symbol string, ts date, open double, high double, low double, close double, volume bigint, close_returns double",
    )


def test_prices_oldest_first_within_bounds(prices, registry):
    found = serve.prices(prices, registry, "aapl", start="2026-01-03", end=D(2026, 1, 8), limit=3)
    assert [r.ts.day for r in found.collect()] == [3, 4, 5]
    assert found.columns == list(serve.PRICE_COLUMNS)
    assert [r.ts.day for r in serve.prices(prices, registry, "AAPL", end="2026-01-02").collect()] == [1, 2]
    assert serve.prices(prices, registry, "AAPL").count() == 10
    assert serve.prices(prices, registry, "AAPL", limit=0).count() == 0


def test_unregistered_tickers_are_refused(prices, registry):
    assert serve.prices(prices, registry, "NOPE").count() == 0
    with pytest.raises(serve.NotRegistered):
        serve.require_registered(registry, "NOPE")
    serve.require_registered(registry, "aapl")


def test_limit_has_a_ceiling(prices, registry):
    serve.prices(prices, registry, "AAPL", limit=5000)
    with pytest.raises(ValueError):
        serve.prices(prices, registry, "AAPL", limit=5001)


def test_facts_latest_first(spark, registry):
    table = spark.createDataFrame(
        [("AAPL", c, "USD", D(2025, m, 1), 2025, fp, "10-Q", float(m)) for c in ("a:X", "a:Y") for m in (3, 6, 9)
         for fp in ("Q1", "Q2")] + [("NOPE", "a:X", "USD", D(2025, 1, 1), 2025, "Q1", "10-Q", 1.0)],
        "ticker string, concept string, unit string, period_end date, fy bigint, fp string, form string, val double",
    )
    found = serve.fundamentals(table, registry, "aapl", concept="a:Y", limit=3).collect()
    assert [(r.concept, r.period_end.month, r.fp) for r in found] == [("a:Y", 9, "Q1"), ("a:Y", 9, "Q2"), ("a:Y", 6, "Q1")]
    assert serve.fundamentals(table, registry, "AAPL").count() == 12
    assert serve.fundamentals(table, registry, "NOPE").count() == 0
    top = serve.fundamentals_per_ticker(table, registry, 2).collect()
    assert {(r.concept, r.period_end.month, r.fp) for r in top} == {("a:X", 9, "Q1"), ("a:X", 9, "Q2")}


def test_top_per_key_with_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), F.hash("id").alias("o")
    ).cache()
    want = {}
    for r in sorted(df.collect()):
        want.setdefault(r.k, []).append(r.o)
    for limit in (1, 5, 100):
        got = {}
        for r in serve.top_per_key(df, "k", ["o"], limit).collect():
            got.setdefault(r.k, []).append(r.o)
        assert {k: sorted(v) for k, v in got.items()} == {k: v[:limit] for k, v in want.items()}
    df.unpersist()


def test_single_reads_are_pushed_down_and_cut_early(spark, prices, registry, tmp_path):
    path = str(tmp_path / "p")
    prices.withColumn("year", F.year("ts")).write.partitionBy("year").parquet(path)
    found = serve.prices(spark.read.parquet(path), registry, "aapl", start="2026-01-03")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(symbol,AAPL)" in plan and "GreaterThanOrEqual(ts,2026-01-03)" in plan


# -- backfill --


def requests(spark, *symbols, start="2015-01-01", end="2017-06-01"):
    return spark.createDataFrame(
        [(s, i, D.fromisoformat(start), D.fromisoformat(end)) for i, s in enumerate(symbols)],
        "symbol string, position bigint, start date, end date",
    )


def batches(df):
    found = {}
    for r in df.orderBy("position").collect():
        found.setdefault(r.batch_no, []).append(r.symbol)
    return list(found.values())


def test_symbol_batches(spark):
    asked = requests(spark, *"ABCDE")
    assert batches(B.symbol_batches(asked, 2)) == [["A", "B"], ["C", "D"], ["E"]]
    assert batches(B.symbol_batches(asked, 10)) == [["A", "B", "C", "D", "E"]]
    with pytest.raises(ValueError):
        B.symbol_batches(asked, 0)


def windows(spark, start, end, years=1):
    df = requests(spark, "A", start=start, end=end)
    found = df.select(F.explode(B.date_windows(F.col("start"), F.col("end"), years)).alias("w")).collect()
    return [(r.w.window_start.isoformat(), r.w.window_end.isoformat()) for r in found]


def by_hand(start, end, years):
    """The windows, day arithmetic written out."""
    from datetime import timedelta

    found, at, end = [], D.fromisoformat(start), D.fromisoformat(end)
    while at <= end:
        leap_start = (at.month, at.day) == (2, 29)
        year = at.year + years
        leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        last = min(D(year, at.month, 28 if leap_start and not leap else at.day), end)
        found.append((at.isoformat(), last.isoformat()))
        at = last + timedelta(days=1)
    return found


def test_date_windows(spark):
    assert windows(spark, "2015-01-01", "2017-06-01") == [
        ("2015-01-01", "2016-01-01"), ("2016-01-02", "2017-01-02"), ("2017-01-03", "2017-06-01")
    ]
    assert windows(spark, "2026-01-01", "2026-02-01") == [("2026-01-01", "2026-02-01")]
    assert windows(spark, "2026-01-01", "2026-01-01") == [("2026-01-01", "2026-01-01")]


@pytest.mark.parametrize("years", [1, 2, 3, 4])
@pytest.mark.parametrize(
    "start, end",
    [("2020-02-29", "2031-03-01"), ("2019-02-28", "2029-02-28"), ("2000-12-31", "2011-12-30"),
     ("2015-06-15", "2020-06-15"), ("2015-06-15", "2020-06-14"), ("2019-03-01", "2024-02-29")],
)
def test_date_windows_by_hand(spark, start, end, years):
    assert windows(spark, start, end, years) == by_hand(start, end, years)


def test_window_errors(spark):
    with pytest.raises(PySparkException, match="start must not be after end"):
        windows(spark, "2026-02-01", "2026-01-01")
    with pytest.raises(ValueError):
        windows(spark, "2026-01-01", "2026-02-01", 0)


def test_coverage(spark, rows):
    asked = requests(spark, "A", "B", "C", start="2024-01-01", end="2025-06-01")
    have = spark.createDataFrame(
        [("A", D(2024, 1, 1)), ("A", D(2024, 1, 1)), ("B", D(2025, 1, 1)), ("B", D(2025, 1, 2)),
         ("C", D(2025, 6, 1)), ("C", D(2025, 6, 2)), ("Z", D(2024, 5, 5))],
        "symbol string, ts date",
    )
    found = B.backfill_coverage(asked, have, batch_size=2, years=1)
    first, second = (D(2024, 1, 1), D(2025, 1, 1)), (D(2025, 1, 2), D(2025, 6, 1))
    assert rows(found, "batch_no", "window_start") == [
        (0, *first, 2, 3), (0, *second, 2, 1), (1, *first, 1, 0), (1, *second, 1, 1)
    ]
    plan = B.backfill_plan(asked, 2, 1)
    assert plan.count() == 6 and plan.columns == ["batch_no", "symbol", "window_start", "window_end"]


def test_a_limit_above_sparks_own_is_cut_down_ahead_of_the_shuffle(spark):
    from tidemark.operators import serve

    rows_ = spark.range(0, 40_000, 1, 4).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    top = serve.top_per_key(rows_, "k", ["v"], 2000)
    found = top.collect()
    assert len(found) == 6000 and all(r.v < 6000 for r in found)
    # Each map task cuts its part down to 2000 rows of a key before it shuffles.
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "2000, Partial" in plan and plan.index("2000, Final") < plan.index("2000, Partial")
