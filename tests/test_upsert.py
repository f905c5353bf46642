from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import upsert as U
from tidemark.operators.registry import INSTRUMENTS
from tidemark.sources import tables


def load_time():
    return F.lit("2026-02-01 12:00:00").cast("timestamp")

OLD = datetime(2026, 1, 1)
SILVER = "symbol string, ts date, open double, high double, low double, close double, volume bigint, close_returns double"


def price(symbol, day, close, ret=None):
    return (symbol, date(2026, 1, day), close, close, close, close, 10, ret)


@pytest.fixture
def stored(spark):
    base = [
        ("A", date(2026, 1, 1), 1.0, 1.0, 1.0, 1.0, 1, 0.5, 2.0, 0.1, "manual", "old", OLD),
        ("A", date(2026, 1, 2), 2.0, 2.0, 2.0, 2.0, 2, 0.5, 2.0, 0.2, "manual", "old", OLD),
    ]
    return spark.createDataFrame(base, schemas.GOLD_PRICES)


def test_prices_insert_update_and_keep(spark, stored, rows):
    batch = spark.createDataFrame([price("A", 2, 9.0, 0.9), price("B", 1, 5.0)], SILVER)
    found = U.upsert(stored, batch, U.PRICES, load_time())
    assert found.columns == schemas.GOLD_PRICES.names
    now = datetime(2026, 2, 1, 12)
    assert rows(found, "symbol", "ts") == [
        ("A", date(2026, 1, 1), 1.0, 1.0, 1.0, 1.0, 1, 0.5, 2.0, 0.1, "manual", "old", OLD),
        # Absent columns become null on conflict, the source stays.
        ("A", date(2026, 1, 2), 9.0, 9.0, 9.0, 9.0, 10, None, None, 0.9, "manual", None, now),
        ("B", date(2026, 1, 1), 5.0, 5.0, 5.0, 5.0, 10, None, None, None, "yahoo", None, now),
    ]


def test_twice_is_once(spark, stored, rows):
    batch = spark.createDataFrame([price("A", 2, 9.0), price("B", 1, 5.0)], SILVER)
    once = U.upsert(stored, batch, U.PRICES, load_time())
    twice = U.upsert(once, batch, U.PRICES, load_time())
    assert rows(once, "symbol", "ts") == rows(twice, "symbol", "ts")


def test_run_id_changes_only_if_given(spark, rows):
    stored = spark.createDataFrame(
        [("cpi", date(2026, 1, 1), 1.0, "fred", "old", OLD)], schemas.GOLD_MACRO
    )
    plain = spark.createDataFrame([("cpi", date(2026, 1, 1), 2.0)], schemas.SILVER_MACRO)
    assert rows(U.upsert(stored, plain, U.MACRO, load_time()).select("value", "run_id")) == [(2.0, "old")]
    given = plain.withColumn("run_id", F.lit("new"))
    assert rows(U.upsert(stored, given, U.MACRO, load_time()).select("value", "run_id")) == [(2.0, "new")]


def test_empty_batch_and_empty_target(spark, stored, rows):
    empty = spark.createDataFrame([], SILVER)
    assert rows(U.upsert(stored, empty, U.PRICES, load_time()), "ts") == rows(stored, "ts")
    batch = spark.createDataFrame([price("B", 1, 5.0)], SILVER)
    assert U.upsert(stored.where("false"), batch, U.PRICES, load_time()).count() == 1


def test_facts_take_the_last_ingested(spark, rows):
    key = ("A", "c", "USD", date(2026, 1, 1), "FY", "10-K")
    stored = spark.createDataFrame(
        [(*key, 2025, None, 1.0, "new", date(2026, 5, 1), "sec_edgar", None, OLD)], schemas.GOLD_FACTS
    )
    names = ["ticker", "concept", "unit", "period_end", "fp", "form"]
    batch = stored.select(*names, "fy", "period_start", F.lit(2.0).alias("val"), F.lit("old").alias("accn"),
                          F.lit("2026-01-01").cast("date").alias("filed"))
    assert rows(U.upsert(stored, batch, U.FACTS, load_time()).select("val", "accn")) == [(2.0, "old")]


def test_marks_move_back_unless_monotonic(spark, rows):
    stored = spark.createDataFrame(
        [("yahoo", "prices_1d", "A", date(2026, 1, 9), "r9", OLD)], schemas.WATERMARKS
    )
    batch = spark.createDataFrame(
        [("yahoo", "prices_1d", "A", date(2026, 1, 5), "r5")],
        "source string, dataset string, ticker string, last_ts date, last_run_id string",
    )
    plain = U.upsert_watermarks(stored, batch, load_time()).select("last_ts", "last_run_id")
    assert rows(plain) == [(date(2026, 1, 5), "r5")]
    kept = U.upsert_watermarks(stored, batch, load_time(), monotonic=True).select("last_ts", "last_run_id")
    assert rows(kept) == [(date(2026, 1, 9), "r9")]


def test_bad_keys_are_refused(spark, tmp_path):
    repeated = spark.createDataFrame([price("A", 1, 1.0), price("A", 1, 2.0)], SILVER)
    blank = spark.createDataFrame([price(None, 1, 1.0)], SILVER)
    for batch in (repeated, blank):
        with pytest.raises(U.KeyViolation):
            tables.load(spark, str(tmp_path), batch, U.PRICES, load_time())
    with pytest.raises(U.KeyViolation):
        tables.load(spark, str(tmp_path), blank, U.PRICES, load_time(), unique=blank)
    assert tables.read_table(spark, str(tmp_path), U.PRICES).count() == 0


def test_load_replaces_only_touched_directories(spark, tmp_path, rows):
    root = str(tmp_path)

    def at(year, close):
        return ("A", date(year, 1, 1), close, close, close, close, 1, None)

    first = spark.createDataFrame([at(2024, 1.0), at(2025, 2.0)], SILVER)
    assert tables.load(spark, root, first, U.PRICES, load_time()) == 2
    untouched = sorted((tmp_path / "prices_1d" / "month=202401").iterdir())
    second = spark.createDataFrame([at(2025, 3.0), at(2026, 4.0)], SILVER)
    assert tables.load(spark, root, second, U.PRICES, load_time()) == 2
    assert sorted((tmp_path / "prices_1d" / "month=202401").iterdir()) == untouched
    table = tables.read_table(spark, root, U.PRICES)
    assert rows(table.select("ts", "close", "month"), "ts") == [
        (date(2024, 1, 1), 1.0, 202401), (date(2025, 1, 1), 3.0, 202501), (date(2026, 1, 1), 4.0, 202601)
    ]
    assert tables.load(spark, root, second.where("false"), U.PRICES, load_time()) == 0


def test_a_failed_load_leaves_the_table(spark, tmp_path):
    root = str(tmp_path)
    batch = spark.createDataFrame([price("A", 1, 1.0)], SILVER)
    tables.load(spark, root, batch, U.PRICES, load_time())
    broken = batch.withColumn("close", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        tables.load(spark, root, broken, U.PRICES, load_time(), unique=batch)
    assert tables.read_table(spark, root, U.PRICES).select("close").first().close == 1.0


def files_of(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_another_session_finds_the_table_in_its_folder(spark, tmp_path, rows):
    root = str(tmp_path)
    first = spark.createDataFrame([price("A", day, float(day)) for day in range(1, 21)], SILVER)
    tables.load(spark, root, first, U.PRICES, load_time())
    spark.sql(f"drop table {tables.attach(spark, root, U.PRICES)}")  # its files stay
    second = spark.createDataFrame([price("A", 5, 50.0)], SILVER)
    tables.load(spark, root, second, U.PRICES, load_time())
    assert rows(tables.read_table(spark, root, U.PRICES).agg(F.count("*"), F.sum("close"))) == [(20, 255.0)]


@pytest.mark.parametrize("spec", [U.PRICES, U.MACRO, U.FACTS, U.FIGI, U.WATERMARKS, INSTRUMENTS])
def test_a_load_does_not_shuffle_the_stored_side(spark, tmp_path, spec):
    """Above the scan of the table there is no exchange; the batch has one."""
    table = spark.table(tables.attach(spark, str(tmp_path), spec))
    day = F.date_add(F.lit(date(2026, 1, 1)), F.col("id").cast("int"))
    kinds = {f.name: f.dataType for f in spec.schema}
    batch = spark.range(10).select(
        *[day.alias(c) if kinds[c].typeName() == "date" else F.col("id").cast(kinds[c]).alias(c) for c in spec.key]
    )
    plan = tables.merge(table, batch, spec, load_time(), [1, 2])._jdf.queryExecution().executedPlan().toString()
    stored = plan[: plan.index("FileScan parquet")]
    assert "Exchange" not in stored.split("FullOuter")[1]
    assert f"{spec.files})" in plan[plan.index("Exchange hashpartitioning") :].split("ENSURE")[0]
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_tasks_of_a_load_grow_with_its_rows(spark, tmp_path, rows, monkeypatch):
    """Four files of 25 rows would be a task each; tasks of ten rows are asked for, stored rows among them."""
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    root, spec = str(tmp_path), U.FIGI.with_buckets(1)
    written = lambda: {f.split("/")[1] for f in files_of(tmp_path / spec.name)}
    for first, tasks in ((0, 12), (50, 16)):
        batch = spark.range(first, first + 100).selectExpr("concat('S', id) as ticker", "concat('F', id) as figi")
        tables.load(spark, root, batch.withColumn("name", F.lit(str(first))), spec, load_time())
        assert 8 < len(written()) <= tasks + 4
    found = tables.read_table(spark, root, spec).groupBy("name").count()
    assert rows(found, "name") == [("0", 50), ("50", 100)]
    seventh = tables.read_table(spark, root, spec).where("ticker = 'S7'")
    assert rows(seventh.select("figi", "name")) == [("F7", "0")]


def test_a_read_of_one_symbol_opens_no_file_that_lacks_it(spark, tmp_path):
    root, spec = str(tmp_path), U.PRICES
    days = spark.range(31).select(F.date_add(F.lit(date(2026, 1, 1)), F.col("id").cast("int")).alias("ts"))
    names = spark.range(400).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("symbol"))
    batch = names.join(days).withColumn("close", F.lit(1.0))
    tables.load(spark, root, batch, spec, load_time())
    for value, kept in (("S7", 31), ("S7x", 0), ("S39999", 0)):
        found = tables.read_table(spark, root, spec).where(F.col("symbol") == value).select("symbol", "ts")
        assert len(found.collect()) == kept
        plan = found._jdf.queryExecution().executedPlan()
        assert f"EqualTo(symbol,{value})" in plan.toString()
        scan = plan.collectLeaves().head()
        read = scan.metrics().get("numOutputRows").get().value()
        # S7x lies between the names of every file, so only the Bloom filters tell that it is in none.
        assert (read > 0) == (kept > 0)


def test_one_company_rewrites_its_bucket_alone(spark, tmp_path):
    root, spec = str(tmp_path), U.FACTS.with_buckets(8)
    names = ("ticker", "concept", "unit", "period_end", "fp", "form", "val")

    def facts(ticker):
        days = spark.range(1000).select(F.date_add(F.lit(date(2000, 1, 1)), F.col("id").cast("int") * 7).alias("d"))
        return days.select(
            F.lit(ticker), F.lit("t:c"), F.lit("USD"), "d", F.lit("FY"), F.lit("10-K"), F.lit(1.0)
        ).toDF(*names)

    for ticker in "ABCD":
        tables.load(spark, root, facts(ticker), spec, load_time())
    before = files_of(tmp_path / "fundamentals")
    # A spec with another number of buckets goes on with the table's own.
    tables.load(spark, root, facts("A"), U.FACTS, load_time())
    after = files_of(tmp_path / "fundamentals")
    assert len({f.split("/")[0] for f in after - before}) == 1
    assert {f.split("/")[0] for f in before - after} == {f.split("/")[0] for f in after - before}
    assert tables.read_table(spark, root, U.FACTS).count() == 4000


def test_a_read_by_key_opens_one_bucket(spark, tmp_path, rows):
    from tidemark.operators import serve

    root = str(tmp_path)
    batch = spark.createDataFrame([(t, f"F{t}") for t in "ABCDEFGH"], "ticker string, figi string")
    tables.load(spark, root, batch, U.FIGI, load_time())
    found = serve.figi_candidates(tables.read_table(spark, root, U.FIGI), "c")
    assert rows(found.select("ticker", "figi")) == [("C", "FC")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    value = spark.range(1).select(F.expr("pmod(xxhash64('C'), 16)")).first()[0]
    assert f"= {value})" in plan[plan.index("PartitionFilters") :].split("]")[0]


@pytest.mark.parametrize("spec", [U.PRICES, U.MACRO, U.FACTS, U.FIGI, U.WATERMARKS, INSTRUMENTS])
def test_specs_are_whole(spec):
    kept = {name for name, _ in spec.defaults} | set(spec.key) | {spec.touched}
    known = kept | set(spec.updated) | set(spec.updated_if_given)
    assert set(spec.schema.names) - known <= {"created_at"}
    assert known <= set(spec.schema.names)


def test_silver_run_again_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame(
        [("cpi", date(2026, 1, 1), 1.0, "r", "2026-01-01")],
        "series string, ts date, value double, bronze_run_id string, dt string",
    )
    for _ in range(2):
        tables.write_silver(df, str(tmp_path), "fred", "macro", "run1", ("series", "ts"))
    tables.write_silver(df, str(tmp_path), "fred", "macro", "run2", ("series", "ts"))
    silver = tables.read_silver(spark, str(tmp_path), "fred", "macro", schemas.SILVER_MACRO)
    assert sorted(r.run_id for r in silver.collect()) == ["run1", "run2"]
    one = tables.read_silver(spark, str(tmp_path), "fred", "macro", schemas.SILVER_MACRO, "run2")
    assert one.select("run_id", "dt").first() == ("run2", "2026-01-01")
