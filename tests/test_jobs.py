import re
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import registry, upsert
from tidemark.operators.quality import DataQualityError
from tidemark.operators.returns import add_return_with_history
from tidemark.plans import jobs, landing
from tidemark.plans.jobs import (
    Lake, Moment, run_backfill, run_figi, run_fundamentals, run_macro, run_prices, run_register,
)
from tidemark.sources import files, tables
from tidemark.streaming.incremental import load_new_files
from tidemark.sources import bronze

D = date


def moment():
    return Moment.at("2026-02-01 16:05:00")


@pytest.fixture
def lake(tmp_path):
    return Lake(str(tmp_path / "lake"))


def prices(symbols, *rows, errors=(), at="2026-01-31T00:00:00+00:00"):
    return {
        "meta": {"run_id": "r", "fetched_at": at, "params": {"symbols": ",".join(symbols), "start": "2026-01-01"}},
        "payload": {
            "start": "2026-01-01",
            "rows": [
                {"ts": f"2026-01-{d:02d}", "symbol": s, "open": c, "high": c, "low": c, "close": c, "volume": 1}
                for s, d, c in rows
            ],
            "errors": [{"symbol": s, "error": "no_rows_returned"} for s in errors],
        },
    }


def gold(spark, lake, spec, *columns):
    return tables.read_table(spark, lake.gold, spec).select(*columns)


def runs(spark, lake):
    state = lake.ledger(spark).state().orderBy("started_at", "dataset")
    return [(r.dataset, r.status, r.items_total, r.items_success, r.items_failed) for r in state.collect()]


def test_prices_over_two_days(spark, lake, envelopes, rows):
    first = envelopes(schemas.PRICES_PAYLOAD, prices(["A", "B"], ("A", 5, 1.0), ("A", 6, 2.0), errors=["B"]))
    assert run_prices(spark, lake, first, moment()) == 2
    second = envelopes(schemas.PRICES_PAYLOAD, prices(["A"], ("A", 7, 3.0)))
    for _ in range(2):
        assert run_prices(spark, lake, second, moment()) == 1
    assert rows(gold(spark, lake, upsert.PRICES, "symbol", "ts", "close", "close_returns", "source"), "ts") == [
        ("A", D(2026, 1, 5), 1.0, None, "yahoo"),
        ("A", D(2026, 1, 6), 2.0, 1.0, "yahoo"),
        ("A", D(2026, 1, 7), 3.0, 0.5, "yahoo"),
    ]
    assert rows(gold(spark, lake, upsert.WATERMARKS, "source", "dataset", "ticker", "last_ts", "last_run_id")) == [
        ("yahoo", "prices_1d", "A", D(2026, 1, 7), "r")
    ]
    assert sorted(runs(spark, lake)) == [
        ("prices_1d", "partial", 2, 1, 1), ("prices_1d", "success", 1, 1, 0), ("prices_1d", "success", 1, 1, 0)
    ]
    notes = [r.notes for r in lake.ledger(spark).state().where("status = 'partial'").collect()]
    assert notes == ["1 of 2 items failed; the rejects of this run name them"]
    assert [(r.kind, r.key) for r in lake.rejects(spark).collect()] == [("no_rows", "B")]


def test_batch_scope_leaves_the_first_return_null(spark, lake, envelopes, rows):
    for day, close in ((5, 1.0), (6, 2.0)):
        e = envelopes(schemas.PRICES_PAYLOAD, prices(["A"], ("A", day, close)))
        run_prices(spark, lake, e, moment(), scope="batch")
    assert rows(gold(spark, lake, upsert.PRICES, "close_returns")) == [(None,), (None,)]
    with pytest.raises(ValueError):
        run_prices(spark, lake, e, moment(), scope="other")


def test_requested_symbols_without_rows_fail(spark, lake, envelopes):
    e = envelopes(schemas.PRICES_PAYLOAD, prices([], ("A", 5, 1.0)))
    asked = spark.createDataFrame([("a",), (" B ",), ("",)], "symbol string")
    run_prices(spark, lake, e, moment(), requested=asked)
    assert runs(spark, lake) == [("prices_1d", "partial", 2, 1, 1)]


def test_no_rows_is_a_success(spark, lake, envelopes):
    e = envelopes(schemas.PRICES_PAYLOAD, prices(["A"], errors=["A"]))
    assert run_prices(spark, lake, e, moment()) == 0
    assert runs(spark, lake) == [("prices_1d", "success", 1, 0, 1)]
    assert gold(spark, lake, upsert.PRICES, "ts").count() == 0


def test_the_gate_stops_a_batch(spark, lake, envelopes):
    good = envelopes(schemas.PRICES_PAYLOAD, prices(["A"], ("A", 5, 1.0)))
    run_prices(spark, lake, good, moment())
    bad = envelopes(schemas.PRICES_PAYLOAD, prices(["A"], ("A", 5, -1.0)))
    with pytest.raises(DataQualityError):
        run_prices(spark, lake, bad, moment())
    assert [r.close for r in gold(spark, lake, upsert.PRICES, "close").collect()] == [1.0]
    assert sorted(runs(spark, lake)) == [("prices_1d", "failed", 1, 0, 1), ("prices_1d", "success", 1, 1, 0)]


def keyed(payload, start=None, **partitions):
    return {"meta": {"run_id": "r", "partitions": partitions, "params": {"start": start}}, "payload": payload}


def test_macro(spark, lake, envelopes, rows):
    observations = [{"date": "2026-01-01", "value": "1.5"}, {"date": "2026-01-02", "value": "."}]
    e = envelopes(
        schemas.MACRO_PAYLOAD, keyed({"observations": observations}, "2026-01-01", series="usd/cad"),
        keyed({"observations": []}, series="cpi"), keyed({"observations": observations}),
    )
    assert run_macro(spark, lake, e, moment()) == 1
    assert rows(gold(spark, lake, upsert.MACRO, "series", "ts", "value", "source", "run_id")) == [
        ("usd/cad", D(2026, 1, 1), 1.5, "fred", None)
    ]
    assert rows(gold(spark, lake, upsert.WATERMARKS, "source", "dataset", "ticker", "last_ts")) == [
        ("fred", "macro", "usd/cad", D(2026, 1, 1))
    ]
    assert runs(spark, lake) == [("macro", "partial", 3, 2, 1)]
    nothing = envelopes(schemas.MACRO_PAYLOAD, keyed({"observations": []}, series="cpi"))
    assert run_macro(spark, lake, nothing, moment()) == 0


def test_fundamentals(spark, lake, envelopes, rows):
    def body(val, filed):
        entry = {"end": "2025-12-31", "val": val, "fp": "FY", "form": "10-K", "filed": filed}
        return {"facts": {"t": {"c": {"units": {"USD": [entry]}}}}}

    e = envelopes(schemas.FACTS_PAYLOAD, keyed(body(1, "2026-01-01"), symbol="A"))
    assert run_fundamentals(spark, lake, e, moment()) == 1
    e = envelopes(schemas.FACTS_PAYLOAD, keyed(body(2, "2025-01-01"), symbol="A"))
    assert run_fundamentals(spark, lake, e, moment()) == 1
    assert rows(gold(spark, lake, upsert.FACTS, "ticker", "concept", "val", "source")) == [("A", "t:c", 2.0, "sec_edgar")]
    assert rows(gold(spark, lake, upsert.WATERMARKS, "ticker", "last_ts")) == [("A", D(2025, 12, 31))]


def test_figi_needs_registered_tickers(spark, lake, envelopes, rows):
    candidates = spark.createDataFrame([("A", 1)], "ticker string, position bigint")
    known = tables.read_table(spark, lake.gold, registry.INSTRUMENTS)
    now = moment().now
    tables.load(spark, lake.gold, registry.new_instruments(known, candidates, now), registry.INSTRUMENTS, now)
    e = envelopes(
        schemas.FIGI_PAYLOAD, keyed({"data": [{"figi": "F1"}, {"figi": "F2"}]}, symbol="A"),
        keyed({"data": [{"figi": "F3"}]}, symbol="B"),
    )
    assert run_figi(spark, lake, e, moment()) == 2
    assert rows(gold(spark, lake, upsert.FIGI, "ticker", "figi"), "figi") == [("A", "F1"), ("A", "F2")]
    assert runs(spark, lake) == [("figi_mapping", "partial", 2, 1, 1)]
    assert gold(spark, lake, upsert.WATERMARKS, "ticker").count() == 0


INFO = {"exchange": "NMS", "quoteType": "EQUITY", "timezone": "America/New_York", "currency": "USD"}


def test_register(spark, lake, envelopes, rows):
    info = envelopes(
        schemas.INFO_PAYLOAD, keyed({**INFO, "shortName": "Apple"}, symbol="a"), keyed({}, symbol="zzz"),
        keyed(INFO, symbol="b"),
    )
    history = envelopes(
        schemas.PRICES_PAYLOAD, prices(["A", "B", "C"], ("A", 5, 1.0), ("A", 6, 2.0), ("C", 5, 1.0))
    )
    done = run_register(
        spark, lake, info, moment(), is_scheduled=False, prices=history, backfill_start="2026-01-06"
    )
    assert rows(done.instruments.drop("id"), "ticker") == [
        ("A", "Apple", "NMS", "USD", "America/New_York", True, False),
        ("B", "B", "NMS", "USD", "America/New_York", True, False),
    ]
    assert sorted(r.id for r in done.instruments.collect()) == [1, 2]
    assert [(r.ticker, r.reason) for r in done.rejects.collect()] == [("ZZZ", "unknown ticker")]
    assert done.backfill_rows == 1
    assert rows(gold(spark, lake, upsert.PRICES, "symbol", "ts")) == [("A", D(2026, 1, 6))]
    again = run_register(spark, lake, info, moment(), is_scheduled=True)
    assert {r.is_scheduled for r in again.instruments.collect()} == {False}
    assert ("register_ticker", "partial", 3, 2, 1) in runs(spark, lake)


def test_backfill_judges_every_chunk_by_itself(spark, lake, envelopes, rows):
    e = envelopes(
        schemas.PRICES_PAYLOAD,
        prices(["A", "B", "C"], ("A", 5, 1.0), ("A", 20, 2.0), ("B", 5, -1.0), ("B", 20, 3.0), ("C", 20, 4.0)),
    )
    asked = spark.createDataFrame(
        [(s, i, D(2025, 1, 10), D(2026, 1, 31)) for i, s in enumerate(["a ", "B", "C", "a"])],
        "symbol string, position bigint, start date, end date",
    )
    assert run_backfill(spark, lake, e, asked, moment(), batch_size=1).rows == 4
    assert rows(gold(spark, lake, upsert.PRICES, "symbol", "ts"), "symbol", "ts") == [
        ("A", D(2026, 1, 5)), ("A", D(2026, 1, 20)), ("B", D(2026, 1, 20)), ("C", D(2026, 1, 20))
    ]
    state = lake.ledger(spark).state()
    found = sorted((r.status, r.items_total, r.items_failed, r.notes or "") for r in state.collect())
    assert found == [
        ("failed", 1, 1, "gate: negative_price"),
        ("success", 1, 0, ""), ("success", 1, 0, ""), ("success", 1, 0, ""), ("success", 1, 0, ""),
        ("success", 1, 1, "no rows after cleaning"),
    ]
    with pytest.raises(ValueError):
        run_backfill(spark, lake, e, asked.where("false"), moment())


def rejected(spark, lake):
    return sorted((r.kind, r.key or "", r.detail or "") for r in lake.rejects(spark).collect())


def test_a_truncated_envelope_is_listed_and_the_others_are_loaded(spark, lake, tmp_path, rows):
    import json

    whole = json.dumps(prices(["A"], ("A", 5, 1.0)))
    cut = json.dumps(prices(["B"], ("B", 5, 1.0)))[:60]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "one.json").write_text(whole + "\n" + cut + "\n")
    read = bronze.read_envelopes(spark, str(tmp_path / "e"), schemas.PRICES_PAYLOAD)
    assert run_prices(spark, lake, read, moment()) == 1
    assert runs(spark, lake) == [("prices_1d", "partial", 2, 1, 1)]
    assert rejected(spark, lake) == [("unreadable", "", cut)]
    (tmp_path / "e" / "one.json").write_text(cut + "\n")
    read = bronze.read_envelopes(spark, str(tmp_path / "e"), schemas.PRICES_PAYLOAD)
    with pytest.raises(ValueError, match="could be read"):
        run_prices(spark, lake, read, moment())
    assert ("prices_1d", "failed", 1, 0, 1) in runs(spark, lake)


def test_values_that_do_not_cast_cost_their_symbol_alone(spark, lake, envelopes, rows):
    quoted = prices(["A", "B", "C"], ("A", 5, "1.5"), ("B", 5, 2.0), ("B", 6, "n/a"), ("C", 5, 1.0), ("D", 5, 1.0))
    quoted["payload"]["rows"][3]["ts"] = "2026-13-05"
    e = envelopes(schemas.PRICES_PAYLOAD, quoted)
    assert run_prices(spark, lake, e, moment()) == 2
    assert rows(gold(spark, lake, upsert.PRICES, "symbol", "close"), "symbol") == [("A", 1.5), ("D", 1.0)]
    assert [(k, key) for k, key, _ in rejected(spark, lake)] == [("bad_value", "B"), ("bad_value", "C")]
    assert "close n/a" in rejected(spark, lake)[0][2] and "ts 2026-13-05" in rejected(spark, lake)[1][2]
    assert runs(spark, lake) == [("prices_1d", "partial", 3, 1, 2)]


def test_a_request_of_blanks_is_refused(spark, lake, envelopes):
    e = envelopes(schemas.PRICES_PAYLOAD, prices([], ("A", 5, 1.0)))
    with pytest.raises(ValueError):
        run_prices(spark, lake, e, moment(), requested=spark.createDataFrame([("  ",)], "symbol string"))
    assert gold(spark, lake, upsert.PRICES, "ts").count() == 0


def test_all_failures_are_named(spark, lake, envelopes):
    names = [f"S{i:03d}" for i in range(80)]
    e = envelopes(schemas.PRICES_PAYLOAD, prices(["A", *names], ("A", 5, 1.0), errors=names))
    run_prices(spark, lake, e, moment())
    assert sorted(r.key for r in lake.rejects(spark).collect()) == names


def test_macro_rejects(spark, lake, envelopes, rows):
    good = [{"date": "2026-01-01", "value": "1.5"}]
    e = envelopes(
        schemas.MACRO_PAYLOAD, keyed({"observations": good}, series="cpi"),
        keyed({"observations": good}, series="no_such_series"),
        keyed({"observations": [{"date": "2026-13-05", "value": "1"}, *good]}, series="gdp"),
        keyed({"observations": good}),
    )
    assert run_macro(spark, lake, e, moment()) == 1
    assert rows(gold(spark, lake, upsert.MACRO, "series")) == [("cpi",)]
    assert [(k, key) for k, key, _ in rejected(spark, lake)] == [
        ("bad_value", "gdp"), ("missing_key", ""), ("unknown_key", "no_such_series")
    ]
    assert runs(spark, lake) == [("macro", "partial", 4, 1, 3)]


def test_facts_rejects(spark, lake, envelopes, rows):
    def body(**other):
        entry = {"end": "2025-12-31", "val": 1, "fy": 2025, "fp": "FY", "form": "10-K", "filed": "2026-01-01"}
        return {"facts": {"t": {"c": {"units": {"USD": [{**entry, **other}]}}}}}

    e = envelopes(
        schemas.FACTS_PAYLOAD, keyed(body(fy=2023.0), symbol="A"), keyed(body(val="much"), symbol="B"),
        keyed(body(end="2025-12-99"), symbol="C"), keyed(body(fy="soon"), symbol="D"),
    )
    assert run_fundamentals(spark, lake, e, moment()) == 1
    assert rows(gold(spark, lake, upsert.FACTS, "ticker", "fy")) == [("A", 2023)]
    assert [(k, key, d) for k, key, d in rejected(spark, lake)] == [
        ("bad_value", "B", "val much"), ("bad_value", "C", "end 2025-12-99"), ("bad_value", "D", "fy soon")
    ]


def test_a_backfill_that_breaks_leaves_every_chunk_failed(spark, lake, envelopes, monkeypatch):
    from tidemark.plans import jobs

    e = envelopes(schemas.PRICES_PAYLOAD, prices(["A", "B"], ("A", 5, 1.0), ("B", 5, 1.0)))
    asked = spark.createDataFrame(
        [(s, i, D(2026, 1, 1), D(2026, 1, 31)) for i, s in enumerate("AB")],
        "symbol string, position bigint, start date, end date",
    )

    def lost(*_):
        raise RuntimeError("the load breaks")

    monkeypatch.setattr(jobs, "_load_prices", lost)
    with pytest.raises(RuntimeError):
        run_backfill(spark, lake, e, asked, moment(), batch_size=1)
    state = lake.ledger(spark).state().collect()
    assert [(r.status, r.items_failed, r.notes) for r in state] == [("failed", 1, "the load breaks")] * 2


def test_a_backfill_goes_on_without_a_faulty_symbol(spark, lake, envelopes, rows):
    faulty = prices(["A", "B"], ("A", 5, 1.0), ("B", 5, 1.0))
    faulty["payload"]["rows"][1]["ts"] = "2026-99-05"
    asked = spark.createDataFrame(
        [(s, i, D(2026, 1, 1), D(2026, 1, 31)) for i, s in enumerate("AB")],
        "symbol string, position bigint, start date, end date",
    )
    done = run_backfill(spark, lake, envelopes(schemas.PRICES_PAYLOAD, faulty), asked, moment(), batch_size=1)
    assert rows(done.chunks.select("batch_no", "status", "items_failed", "rows"), "batch_no") == [
        (0, "success", 0, 1), (1, "success", 1, 0)
    ]
    assert [key for _, key, _ in rejected(spark, lake)] == ["B"]
    assert files.names(spark, f"{lake.root}/work") == []


def test_stream_loads_every_file_once(spark, lake, rows):
    def land(day, close):
        bars = spark.createDataFrame(
            [("A", D(2026, 1, day), close, close, close, close, 1)],
            "symbol string, ts date, open double, high double, low double, close double, volume bigint",
        )
        bronze.land_envelopes(landing.prices(bars, f"2026-02-{day:02d} 00:00:00"), lake.bronze)

    def load():
        query = load_new_files(
            spark, lake, bronze.landed_path(lake.bronze, "yahoo", "history"), schemas.PRICES_PAYLOAD,
            run_prices, moment(), f"{lake.root}/progress",
        )
        query.awaitTermination()

    land(1, 1.0)
    load()
    load()
    assert len(runs(spark, lake)) == 1
    land(2, 3.0)
    load()
    assert len(runs(spark, lake)) == 2
    assert rows(gold(spark, lake, upsert.PRICES, "ts", "close_returns"), "ts") == [
        (D(2026, 1, 1), None), (D(2026, 1, 2), 2.0)
    ]


def test_history_looks_back_as_far_as_needed(spark, lake, rows):
    from tidemark.plans import jobs

    schema = "symbol string, ts date, close double"
    stored = [("OLD", D(2001, 5, 5), 1.0), ("OLD", D(2002, 5, 5), 2.0), ("NEAR", D(2025, 12, 1), 5.0),
              ("NEAR", D(2003, 1, 1), 9.0), ("OTHER", D(2002, 1, 1), 9.0)]
    tables.load(spark, lake.gold, spark.createDataFrame(stored, schema), upsert.PRICES, moment().now)
    batch = spark.createDataFrame([(s, D(2026, 1, 5), 10.0) for s in ("OLD", "NEAR", "NEW")], schema)
    near = jobs.stored_near(tables.read_table(spark, lake.gold, upsert.PRICES), batch)
    assert {r.symbol for r in near.collect()} == {"OLD", "NEAR"}
    found = add_return_with_history(batch, near).select("symbol", "close_returns")
    assert rows(found, "symbol") == [("NEAR", 1.0), ("NEW", None), ("OLD", 4.0)]


def test_a_batch_delivered_again_leaves_one_run(spark, lake, envelopes, rows):
    from tidemark.streaming.incremental import load_batch

    good = [{"date": "2026-01-01", "value": "1.5"}]
    e = envelopes(schemas.MACRO_PAYLOAD, keyed({"observations": good}, series="cpi"), keyed({"observations": good}))
    assert load_batch(lake, e, 0, run_macro, moment(), "/progress") is True
    assert load_batch(lake, e, 0, run_macro, moment(), "/progress") is False
    assert len(runs(spark, lake)) == 1 and len(rejected(spark, lake)) == 1
    assert load_batch(lake, e, 1, run_macro, moment(), "/progress") is True
    assert load_batch(lake, e, 0, run_macro, moment(), "/another") is True
    assert len(runs(spark, lake)) == 3


def test_a_batch_whose_run_broke_off_is_run_again_under_its_name(spark, lake, envelopes, monkeypatch):
    from tidemark.plans import jobs
    from tidemark.streaming.incremental import load_batch

    good = [{"date": "2026-01-01", "value": "1.5"}]
    e = envelopes(schemas.MACRO_PAYLOAD, keyed({"observations": good}, series="cpi"), keyed({"observations": good}))

    def lost(*_, **__):
        raise RuntimeError("the load breaks")

    with monkeypatch.context() as broken:
        broken.setattr(jobs, "replace_touched", lost)
        with pytest.raises(RuntimeError):
            load_batch(lake, e, 0, run_macro, moment(), "/progress")
    assert [s for _, s, *_ in runs(spark, lake)] == ["failed"]
    later = Moment.at("2026-02-01 17:00:00")
    assert load_batch(lake, e, 0, run_macro, later, "/progress") is True
    assert [s for _, s, *_ in runs(spark, lake)] == ["partial"]
    assert len(rejected(spark, lake)) == 1
    silver = tables.read_silver(spark, lake.silver, "fred", "macro", schemas.SILVER_MACRO)
    assert silver.count() == 1


def test_a_backfill_goes_on_where_it_was_left(spark, lake, envelopes, rows, monkeypatch):
    from tidemark.plans import jobs

    names = "ABCD"
    e = envelopes(schemas.PRICES_PAYLOAD, prices(list(names), *[(s, 5, 1.0 + i) for i, s in enumerate(names)]))
    asked = spark.createDataFrame(
        [(s, i, D(2026, 1, 1), D(2026, 1, 31)) for i, s in enumerate(names)],
        "symbol string, position bigint, start date, end date",
    )
    plain, loads = jobs._load_prices, []

    def second_breaks(*args):
        loads.append(sorted(r.symbol for r in args[2].select("symbol").collect()))
        if len(loads) == 2:
            raise RuntimeError("the load breaks")
        return plain(*args)

    monkeypatch.setattr(jobs, "_load_prices", second_breaks)
    with pytest.raises(RuntimeError):
        run_backfill(spark, lake, e, asked, moment(), batch_size=1, waves=4)
    assert loads == [["A"], ["B"]]
    again = run_backfill(spark, lake, e, asked, Moment.at("2026-02-02 16:05:00"), batch_size=1, waves=4)
    assert loads[2:] == [["B"], ["C"], ["D"]] and again.rows == 3
    assert rows(again.chunks.select("batch_no", "status", "rows"), "batch_no") == [
        (i, "success", 1) for i in range(4)
    ]
    assert rows(gold(spark, lake, upsert.PRICES, "symbol", "close"), "symbol") == [
        (s, 1.0 + i) for i, s in enumerate(names)
    ]
    # Nothing is open any more, so nothing is read.
    unread = e.withColumn("payload", F.raise_error(F.lit("read")).cast(e.schema["payload"].dataType))
    third = run_backfill(spark, lake, unread, asked, moment(), batch_size=1, waves=4)
    assert third.rows == 0 and third.chunks.count() == 4 and len(loads) == 5
    # Another request is another plan.
    other = run_backfill(spark, lake, e, asked.where("symbol <> 'D'"), moment(), batch_size=1)
    assert other.rows == 3


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0), (2, 0, 1)])
def test_days_may_come_in_any_order(spark, lake, envelopes, rows, order):
    days = [[("A", 5, 1.0), ("B", 5, 8.0), ("A", 6, 2.0)], [("A", 9, 8.0)], [("A", 12, 4.0), ("B", 14, 2.0), ("C", 13, 1.0)]]
    for i in order:
        e = envelopes(schemas.PRICES_PAYLOAD, prices(sorted({s for s, *_ in days[i]}), *days[i]))
        run_prices(spark, lake, e, moment())
    assert rows(gold(spark, lake, upsert.PRICES, "symbol", "ts", "close_returns"), "symbol", "ts") == [
        ("A", D(2026, 1, 5), None), ("A", D(2026, 1, 6), 1.0), ("A", D(2026, 1, 9), 3.0), ("A", D(2026, 1, 12), -0.5),
        ("B", D(2026, 1, 5), None), ("B", D(2026, 1, 14), -0.75), ("C", D(2026, 1, 13), None),
    ]


def test_a_repaired_row_keeps_its_other_columns(spark, lake, envelopes, rows):
    schema = "symbol string, ts date, close double, dividends double, run_id string, source string"
    stored = spark.createDataFrame([("A", D(2026, 1, 9), 4.0, 0.5, "old", "manual")], schema)
    tables.load(spark, lake.gold, stored, upsert.PRICES, moment().now)
    run_prices(spark, lake, envelopes(schemas.PRICES_PAYLOAD, prices(["A"], ("A", 5, 2.0))), moment())
    found = gold(spark, lake, upsert.PRICES, "ts", "close", "dividends", "run_id", "source", "close_returns")
    assert rows(found, "ts") == [
        (D(2026, 1, 5), 2.0, None, None, "yahoo", None), (D(2026, 1, 9), 4.0, 0.5, "old", "manual", 1.0)
    ]


def test_counts_are_observed_and_not_scanned_for(spark, lake, envelopes):
    """Jobs that a load of prices starts, listed by the call that started them."""
    e = envelopes(schemas.PRICES_PAYLOAD, prices(["A", "B"], ("A", 5, 1.0), ("B", 6, 2.0)))
    run_prices(spark, lake, e, moment())
    group = "observed-prices"
    spark.sparkContext.setJobGroup(group, "a second load")
    try:
        run_prices(spark, lake, e, moment())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 30
    assert files.names(spark, f"{lake.root}/work") == []


def many_facts(n):
    """Facts of some tickers, from two fetches that differ in their values, with a malformed day among them."""
    for fetch in (1, 2):
        for i in range(n):
            end = "2026-13-01" if i == 3 else f"2025-{i % 12 + 1:02d}-28"
            entry = {"end": end, "val": i * fetch, "fy": 2025, "fp": f"Q{i}", "filed": "2026-01-02", "accn": f"a{i}"}
            yield {
                "meta": {
                    "run_id": f"r{fetch}", "fetched_at": f"2026-01-0{fetch}T00:00:00+00:00",
                    "partitions": {"symbol": f"S{i % 7}"}, "params": {"start": f"202{fetch}-01-01"},
                },
                "payload": {"facts": {"g": {"N": {"units": {"USD": [entry]}}}}},
            }


def test_a_large_batch_is_shuffled_once_by_its_key(spark, lake, envelopes, rows, monkeypatch, tmp_path):
    """Silver is written where the keys were cleaned, and loaded without a shuffle; rows are those of a small
    batch, loaded twice and on top of stored ones."""
    e = envelopes(schemas.FACTS_PAYLOAD, *many_facts(40))
    small = Lake(str(tmp_path / "small"))
    assert run_fundamentals(spark, small, e, moment()) == 34
    plans, merge = [], tables.merge

    def merged(*args):
        found = merge(*args)
        plans.append((args[-2], found._jdf.queryExecution().executedPlan().toString()))
        return found

    monkeypatch.setattr(tables, "merge", merged)
    monkeypatch.setattr(tables, "FILE_ROWS", 1)
    wanted = ("ticker", "period_end", "fp", "val", "accn", "filed")
    for task_rows, tasks, exchanges in ((10, None, 0), (4, 32, 1)):
        monkeypatch.setattr(tables, "TASK_ROWS", task_rows)
        plans.clear()
        assert run_fundamentals(spark, lake, e, moment(), run_id=f"run{task_rows}") == 34
        # The stored side alone is dealt out, and only beyond a task for each of the table's buckets.
        assert plans[0][0] == tasks and plans[0][1].count("Exchange") == exchanges
        assert rows(gold(spark, lake, upsert.FACTS, *wanted), "fp") == rows(gold(spark, small, upsert.FACTS, *wanted), "fp")
        silver = [
            tables.read_silver(spark, x.silver, "sec_edgar", "fundamentals", schemas.SILVER_FACTS, r)
            for x, r in ((lake, f"run{task_rows}"), (small, None))
        ]
        found, same = (rows(x.drop("run_id"), "fp") for x in silver)
        assert found == same and {(r[-2], str(r[-1])) for r in found} == {("r2", "2022-01-01")}
    # Into an empty table too, each task writes rows of one bucket.
    fresh = Lake(str(tmp_path / "fresh"))
    assert run_fundamentals(spark, fresh, e, moment()) == 34
    written = {tuple(re.findall(r"part-(\d+)-.*_(\d+)\.c", p.name)[0]) for p in Path(fresh.gold).rglob("fundamentals/*/part-*")}
    assert len(written) == len({task for task, _ in written}) > 8
    assert rows(gold(spark, fresh, upsert.FACTS, *wanted), "fp") == rows(gold(spark, small, upsert.FACTS, *wanted), "fp")
    marks = ("ticker", "last_ts", "last_run_id")
    assert rows(gold(spark, lake, upsert.WATERMARKS, *marks), "ticker") == rows(gold(spark, small, upsert.WATERMARKS, *marks), "ticker")
    assert not spark.catalog.listTables(tables.database_name(lake.silver))
    assert files.names(spark, f"{lake.root}/work") == []


def test_a_large_batch_refused_whole_leaves_nothing(spark, lake, envelopes, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 1)
    monkeypatch.setattr(tables, "FILE_ROWS", 0)
    entry = [{"end": "2026-13-01", "val": 1}, {"end": "2026-01-01", "val": 2}]
    e = envelopes(schemas.FACTS_PAYLOAD, keyed({"facts": {"g": {"N": {"units": {"USD": entry}}}}}, symbol="A"))
    assert run_fundamentals(spark, lake, e, moment()) == 0
    assert runs(spark, lake) == [("fundamentals", "partial", 1, 0, 1)]


def test_shuffle_files_go_with_the_write_that_made_them(spark, tmp_path):
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    left = lambda: {p.name.split("_")[1] for f in folders for p in Path(f).rglob("shuffle_*")}
    dealt = spark.range(100).repartition(3, "id")
    at, none = F.lit("2026-01-01").cast("timestamp"), F.create_map().cast("map<string,string>")
    dated = dealt.select(F.col("id").cast("string").alias("series"), F.to_date(at).alias("ts"), F.lit(1.0).alias("value"))
    landed = landing._landing(dealt, "v", "d", 1, at, payload=F.struct("id"), partitions=none)
    root, spec = str(tmp_path), tables.begun(spark, str(tmp_path / "gold"), upsert.MACRO)
    writes = {
        "kept": lambda: jobs._kept(dealt, f"{root}/kept"),
        "silver": lambda: tables.write_silver(dated.withColumn("dt", F.lit("d")), root, "v", "d", "r", ("ts",)),
        "bronze": lambda: bronze.land_envelopes(landed, f"{root}/bronze", dealt=True),
        "gold": lambda: tables.replace_touched(spark, f"{root}/gold", dated, spec, moment().now, [2026], 100),
    }
    for name, write in writes.items():
        before = left()
        write()
        assert not left() - before, name
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
