"""High-water marks, ledger, registry and selection."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import ledger as L
from tidemark.operators import numbering, registry as R, selection as S, watermark as K
from tidemark.sources import tables


def load_time():
    return F.lit("2026-02-01 12:00:00").cast("timestamp")

D = date


@pytest.fixture
def marks(spark):
    at = datetime(2026, 1, 1)
    return spark.createDataFrame(
        [
            ("yahoo", "prices_1d", "A", D(2026, 1, 5), "r", at),
            ("fred", "macro", "cpi", D(2026, 1, 6), "r", at),
            ("sec_edgar", "fundamentals", "A", D(2026, 1, 7), "r", at),
        ],
        schemas.WATERMARKS,
    )


def tickers(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "ticker string")


def test_last_ts(marks, rows):
    assert rows(K.last_ts(marks, "A")) == [(D(2026, 1, 5),)]
    assert rows(K.last_ts(marks, "A", K.FACTS_MARK)) == [(D(2026, 1, 7),)]
    assert rows(K.last_ts(marks, "Z")) == []


def test_starts(spark, marks, rows):
    run_day = F.lit("2026-02-01").cast("date")
    prices = K.start_per_key(tickers(spark, "A", "Z", "Z"), marks, K.PRICES_MARK)
    assert rows(prices, "ticker") == [("A", D(2026, 1, 6)), ("Z", D(2015, 1, 1))]
    macro = K.start_per_key(tickers(spark, "cpi", "gdp"), marks, K.MACRO_MARK)
    assert rows(macro, "ticker") == [("cpi", D(2026, 1, 6)), ("gdp", D(2015, 1, 1))]
    facts = K.start_per_key(tickers(spark, "A", "Z"), marks, K.FACTS_MARK, run_date=run_day)
    assert rows(facts, "ticker") == [("A", D(2026, 1, 7)), ("Z", D(2026, 2, 1))]
    given = K.start_per_key(tickers(spark, "A"), marks, K.PRICES_MARK, explicit=F.lit("2020-02-02"))
    assert rows(given) == [("A", D(2020, 2, 2))]


def test_batch_start(spark, marks, rows):
    starts = K.start_per_key(tickers(spark, "A"), marks, K.PRICES_MARK)
    assert rows(K.batch_start(starts)) == [(D(2026, 1, 6),)]
    assert rows(K.batch_start(starts.where("false"))) == [(D(2015, 1, 1),)]


def test_advance(spark, rows):
    batch = spark.createDataFrame(
        [("A", D(2026, 1, 1), "r2"), ("A", D(2026, 1, 3), "r1"), ("B", D(2026, 1, 2), "r1")],
        "symbol string, ts date, bronze_run_id string",
    )
    assert rows(K.advance(batch, "symbol", "ts", K.PRICES_MARK), "ticker") == [
        ("yahoo", "prices_1d", "A", D(2026, 1, 3), "r1"),
        ("yahoo", "prices_1d", "B", D(2026, 1, 2), "r1"),
    ]


# -- ledger --


def test_ledger(spark, tmp_path):
    ledger = L.RunLedger(spark, str(tmp_path / "runs"))
    assert ledger.state().count() == 0
    a, b = ledger.start("prices_1d", "2026-02-01"), ledger.start("macro", "2026-02-01")
    assert a != b and len(a) == 32
    state = {r.run_id: r for r in ledger.state().collect()}
    assert state[a].status == "running" and state[a].finished_at is None
    assert state[a].run_date == D(2026, 2, 1) and state[a].items_total == 0
    ledger.finish(a, status="success", items_total=5, items_success=5)
    ledger.finish(b, status="failed", items_total=3, items_failed=3, notes="boom" * 200)
    state = {r.run_id: r for r in ledger.state().collect()}
    assert (state[a].status, state[a].items_total, state[a].items_success) == ("success", 5, 5)
    assert state[a].dataset == "prices_1d" and state[a].finished_at >= state[a].started_at
    assert state[b].status == "failed" and len(state[b].notes) == 800
    with pytest.raises(ValueError, match="never started"):
        ledger.finish("nope", status="success")
    assert L.unknown_runs(ledger.events()).count() == 0


def test_the_ledger_folds_its_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "TAIL_FILES", 6)
    path = str(tmp_path / "runs")
    plain, folded = [], L.RunLedger(spark, path)
    for n in range(9):
        at = F.lit(f"2026-02-01 00:00:{n:02d}").cast("timestamp")
        run = folded.start("macro", "2026-02-01", at, run_id=f"r{n}")
        if n != 4:
            folded.finish(run, status="failed" if n == 5 else "success", items_total=n, at=at)
        assert len(folded.tail()) <= 6 + 1
        plain.append((f"r{n}", "running" if n == 4 else "failed" if n == 5 else "success", 0 if n == 4 else n))
    state = folded.state().orderBy("run_id")
    assert [(r.run_id, r.status, r.items_total) for r in state.collect()] == plain
    # A run that is started and finished again, across a fold.
    folded.start("macro", "2026-02-01", F.lit("2026-02-02 00:00:00").cast("timestamp"), run_id="r5")
    folded.finish("r5", status="success", items_total=50, at=F.lit("2026-02-02 00:00:01").cast("timestamp"))
    folded.fold()
    assert folded.tail() == [] and folded.loaded("r5") and not folded.loaded("r4") and not folded.loaded("r99")
    again = {r.run_id: r for r in folded.state().collect()}
    assert len(again) == 9 and (again["r5"].status, again["r5"].items_total) == ("success", 50)
    assert again["r5"].started_at == datetime(2026, 2, 1, 0, 0, 5)
    folded.fold()
    assert folded.state().count() == 9


# -- numbering --


@pytest.mark.parametrize("position", ["id * 2 - 301", "id * 1000000007", "xxhash64(id)", "id div 100", "7"])
def test_numbers_are_consecutive_for_any_positions(spark, position):
    df = spark.range(0, 500, numPartitions=3).where("id % 3 <> 1").select("id", F.expr(position).alias("p"))
    found = numbering.number_rows(df, "p", "n", ties=["id"]).orderBy("p", "id").collect()
    assert [r.n for r in found] == list(range(len(found)))
    assert numbering.number_rows(df.where("false"), "p", "n").count() == 0


# -- registry --


@pytest.fixture
def known(spark):
    at = datetime(2026, 1, 1)
    return spark.createDataFrame(
        [
            (3, "AAPL", "Apple", "NMS", "USD", "America/New_York", True, True, at, at),
            (7, "MSFT", "Microsoft", None, "USD", "America/New_York", True, False, at, at),
            (8, "OLD", "Old", None, "USD", "America/New_York", False, True, at, at),
        ],
        schemas.INSTRUMENTS,
    )


def test_create_only_unknown_tickers(spark, known, rows):
    candidates = spark.createDataFrame(
        [("aapl", 0, "Other", None), ("new", 1, "", "LSE"), ("NEW", 2, "Later", None), ("b", 5, None, None)],
        "ticker string, position bigint, name string, exchange string",
    )
    grown = R.get_or_create(known, candidates, load_time())
    assert rows(grown.drop("created_at", "updated_at"), "id") == [
        (3, "AAPL", "Apple", "NMS", "USD", "America/New_York", True, True),
        (7, "MSFT", "Microsoft", None, "USD", "America/New_York", True, False),
        (8, "OLD", "Old", None, "USD", "America/New_York", False, True),
        (9, "NEW", "NEW", "LSE", "USD", "America/New_York", True, True),
        (10, "B", "B", None, "USD", "America/New_York", True, True),
    ]
    again = R.get_or_create(grown, candidates, load_time())
    assert again.count() == 5
    first = R.new_instruments(known.where("false"), candidates.select("ticker", "position"), load_time())
    assert sorted(r.id for r in first.collect()) == [1, 2, 3]


def test_registry_loads_as_a_table(spark, known, tmp_path, rows):
    candidates = spark.createDataFrame([("new", 1), ("b", 2)], "ticker string, position bigint")
    for _ in range(2):
        held = tables.read_table(spark, str(tmp_path), R.INSTRUMENTS)
        fresh = R.new_instruments(held, candidates, load_time())
        tables.load(spark, str(tmp_path), fresh, R.INSTRUMENTS, load_time())
    held = tables.read_table(spark, str(tmp_path), R.INSTRUMENTS)
    assert rows(held.select("id", "ticker"), "id") == [(1, "NEW"), (2, "B")]
    assert held.where("created_at is null").count() == 0


def test_set_scheduled(spark, known, rows):
    changes = spark.createDataFrame(
        [("msft", True), ("AAPL", True), ("none", False)], "ticker string, is_scheduled boolean"
    )
    found = R.set_scheduled(known, changes, load_time())
    old, now = datetime(2026, 1, 1), datetime(2026, 2, 1, 12)
    assert rows(found.select("ticker", "is_scheduled", "updated_at"), "ticker") == [
        ("AAPL", True, old), ("MSFT", True, now), ("OLD", True, old)
    ]
    assert rows(R.unregistered(changes.select(F.upper("ticker").alias("ticker")), known)) == [("NONE",)]


def test_lists(known, rows):
    assert rows(R.scheduled_universe(known)) == [("AAPL",)]
    assert [r.ticker for r in R.instruments(known).collect()] == ["AAPL", "MSFT", "OLD"]
    assert [r.ticker for r in R.instruments(known, is_active=True).collect()] == ["AAPL", "MSFT"]
    assert [r.ticker for r in R.instruments(known, is_scheduled=False).collect()] == ["MSFT"]
    assert R.instrument(known, "msft").count() == 1 and R.instrument(known, "x").count() == 0


def test_missing_symbols(spark, rows):
    asked = spark.createDataFrame([("A",), ("B",)], "symbol string")
    assert rows(R.missing_symbols(asked, asked.where("symbol = 'A'"))) == [("B", "no_rows_returned")]


# -- selection --


def test_clean_symbols(spark, rows):
    asked = spark.createDataFrame([(" aapl ",), ("",), ("  ",), (None,), ("AAPL",)], "symbol string")
    assert rows(S.clean_symbols(asked)) == [("AAPL",), ("AAPL",)]
    with pytest.raises(ValueError):
        S.require_any(S.clean_symbols(asked.where("trim(symbol) = ''")))


def test_selected_tickers(known, rows):
    assert rows(S.selected_tickers(known, " msft,, x ,aapl")) == [("MSFT",), ("X",), ("AAPL",)]
    assert rows(S.selected_tickers(known, "msft,x", 1)) == [("MSFT",)]
    for none in (None, "", " , "):
        assert rows(S.selected_tickers(known, none)) == [("AAPL",)]
    busy = known.withColumn("is_scheduled", F.lit(True))
    assert rows(S.selected_tickers(busy, None, 1)) == [("AAPL",)]


def test_date_window(spark, rows):
    df = spark.createDataFrame(
        [("", "", "r"), (None, None, "r"), (" s ", " ", "r"), ("s", "e", "r")], "a string, b string, r string"
    )
    first, last = S.date_window(F.col("a"), F.col("b"), F.col("r"))
    found = [tuple(r) for r in df.select(first, last).collect()]
    assert found == [("r", "r"), ("r", "r"), ("s", "s"), ("s", "e")]
