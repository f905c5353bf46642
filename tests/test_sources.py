import gzip
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import columns as fx
from tidemark.operators import normalize
from tidemark.plans import landing as landed_rows
from tidemark.sources import bronze, lookups
from tidemark.sources.panel import panel_to_rows


def put(folder, name, document, pretty=False):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    text = document if isinstance(document, str) else json.dumps(document, indent=2 if pretty else None)
    data = text.encode()
    path.write_bytes(gzip.compress(data) if name.endswith("gz") else data)


def macro(series, *values):
    observations = [{"date": f"2025-01-{i + 1:02d}", "value": v} for i, v in enumerate(values)]
    return {"meta": {"partitions": {"series": series}, "run_id": "in-meta"}, "payload": {"observations": observations}}


def test_files_of_any_depth_are_read(spark, tmp_path, rows):
    put(tmp_path, "series=usd/cad/run_id=20260101000000Z.json.gz", macro("usd/cad", "1.4"))
    put(tmp_path, "series=cpi/run_id=20260102000000Z.json", macro("cpi", "3.1", "."))
    put(tmp_path, "series=cpi/odd.json", "{broken")
    e = bronze.read_envelopes(spark, str(tmp_path), schemas.MACRO_PAYLOAD)
    assert e.columns == ["meta", "payload", "_corrupt", "file_path"]
    found = normalize.normalize_macro(normalize.split_keyed(e, "series")[0])
    assert rows(found.select("series", "value", "bronze_run_id"), "series") == [
        ("cpi", 3.1, "20260102000000Z"), ("usd/cad", 1.4, "20260101000000Z")
    ]
    _, bad = normalize.split_keyed(e, "series")
    assert [(r._corrupt, r.reason) for r in bad.collect()] == [("{broken", "not a JSON envelope")]


def test_pretty_printed_files(spark, tmp_path):
    put(tmp_path, "a.json.gz", macro("cpi", "1", "2"), pretty=True)
    put(tmp_path, "b.json.gz", macro("gdp", "1"), pretty=True)
    e = bronze.read_envelopes(spark, str(tmp_path), schemas.MACRO_PAYLOAD, multi_line=True)
    assert normalize.normalize_macro(e).count() == 3


def test_bare_nan_and_whole_numbers(spark, tmp_path, rows):
    put(
        tmp_path, "a.json",
        '{"meta": {}, "payload": {"rows": [{"ts": "2026-01-01", "symbol": "A", "close": NaN, "volume": 1000.0}]}}',
    )
    e = bronze.read_envelopes(spark, str(tmp_path), schemas.PRICES_PAYLOAD)
    ((close, volume),) = rows(normalize.normalize_prices(e).select("close", "volume"))
    assert close != close and volume == 1000.0


def landing(spark, *rows):
    schema = """vendor string, dataset string, dt date, partitions map<string,string>, params map<string,string>,
                schema_version int, fetched_at timestamp, payload string"""
    return spark.createDataFrame(list(rows), schema)


AT = datetime(2026, 2, 1, 16, 5, 9)


def test_envelopes_are_built_landed_and_located(spark, tmp_path, rows):
    listed, recorded = json.dumps([1, 2, 3]), json.dumps({"records": [1, 2]})
    priced = json.dumps({"rows": [1, 2], "errors": []})
    parts = {"symbol": "  AAPL ", "none": None, "blank": "  "}
    landed = landing(
        spark,
        (" Yahoo ", "History", date(2026, 2, 1), parts, {"a": "1"}, 2, AT, listed),
        ("yahoo", "history", date(2026, 2, 2), {"symbol": "MSFT"}, None, 1, AT, recorded),
        ("yahoo", "history", None, None, None, 1, AT, priced),
        ("yahoo", "history", None, None, None, 1, AT, "[]"),
        ("yahoo", "history", None, None, None, 1, AT, None),
    )
    bronze.land_envelopes(landed, str(tmp_path))
    assert all(f.suffix == ".gz" for f in tmp_path.rglob("part-*"))
    e = bronze.read_envelopes(spark, bronze.landed_path(str(tmp_path), " Yahoo", "HISTORY "), "string")
    meta = e.select("meta.*", "payload")
    first = meta.where("dt = '2026-02-01'").first()
    assert (first.source, first.dataset, first.schema_version) == (" Yahoo ", "History", 2)
    assert (first.run_id, first.fetched_at) == ("20260201160509Z", "2026-02-01T16:05:09.000000+00:00")
    assert (first.partitions, first.params, first.record_count) == ({"symbol": "AAPL"}, {"a": "1"}, 3)
    assert json.loads(first.payload) == [1, 2, 3]
    counts = sorted(r.record_count for r in meta.collect())
    assert counts == [0, 1, 1, 2, 3]
    assert meta.where("partitions is null or params is null").count() == 0

    def located(**where):
        return [r.symbol for r in bronze.locate(e, **where).select(F.col("meta.partitions")["symbol"].alias("symbol")).collect()]

    assert located(run_id="20260201160509Z", dt="2026-02-01") == ["AAPL"]
    assert located(run_id="20260201160509Z", symbol="msft") == ["MSFT"]
    assert located(run_id="other", symbol="msft") == []
    with pytest.raises(ValueError):
        bronze.locate(e, "20260201160509Z")


def test_a_day_filter_leaves_other_files_unread(spark, tmp_path):
    for day in range(1, 6):
        put(tmp_path, f"dt=2026-01-0{day}/run_id=r.json", macro("cpi", "1"))
    e = bronze.read_envelopes(spark, str(tmp_path), schemas.MACRO_PAYLOAD)
    one = bronze.locate(e, None, dt="2026-01-03")
    assert one.count() == 1
    files = []

    def visit(node):
        metric = node.metrics().get("numFiles")
        if metric.isDefined():
            files.append(metric.get().value())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    one.collect()
    visit(one._jdf.queryExecution().executedPlan())
    assert files == [1]


def test_cik_table(spark, rows):
    text = json.dumps({
        "0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple"},
        "1": {"cik_str": "12345678901", "ticker": "LONG", "title": "x"},
        "2": {"cik_str": 7, "ticker": "AAPL", "title": "again"},
    })
    table = lookups.cik_table(spark.createDataFrame([(text,)], "value string"))
    assert rows(table, "ticker") == [("AAPL", "0000000007"), ("LONG", "12345678901")]
    found, missing = lookups.with_cik(spark.createDataFrame([("aapl",), ("x",)], "ticker string"), table)
    assert rows(found) == [("AAPL", "0000000007")] and rows(missing) == [("X",)]


def test_series_table(spark, rows):
    assert lookups.series_table(spark).count() == 11
    asked = spark.createDataFrame([("CPI",), ("usd/cad",), ("nope",)], "series string")
    found, unknown = lookups.with_series_id(asked)
    assert rows(found, "series") == [("cpi", "CPIAUCSL"), ("usd/cad", "DEXCAUS")]
    assert rows(unknown) == [("nope",)]


def test_identifier_responses(spark, rows):
    schema = "symbol string, results array<struct<error: string, data: array<struct<figi: string>>>>"
    responses = spark.createDataFrame(
        [("A", [(None, [("F1",)]), ("late", None)]), ("B", [("bad", None)]), ("C", []), ("D", None)], schema
    )
    good, bad = lookups.split_responses(responses)
    assert [(r.symbol, r.payload and r.payload.data[0].figi) for r in good.orderBy("symbol").collect()] == [
        ("A", "F1"), ("C", None), ("D", None)
    ]
    assert rows(bad) == [("B", "bad")]


PANEL = "Date date, `A|Open` double, `A|High` double, `A|Low` double, `A|Close` double, `A|Volume` double, `B|Close` double"


def test_panel(spark, rows):
    day = date(2026, 1, 1)
    panel = spark.createDataFrame(
        [(day, 1.0, 2.0, 0.5, 1.5, 10.0, 7.0), (date(2026, 1, 2), None, None, None, None, None, 8.0),
         (None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], PANEL
    )
    found = panel_to_rows(panel, ["A", "B", "C"])
    assert found.columns == ["ts", "open", "high", "low", "close", "volume", "symbol"]
    assert rows(found, "symbol", "ts") == [
        (day, 1.0, 2.0, 0.5, 1.5, 10.0, "A"),
        (day, None, None, None, 7.0, None, "B"),
        (date(2026, 1, 2), None, None, None, 8.0, None, "B"),
    ]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert panel_to_rows(panel, ["C"]).count() == 0


def test_flat_panel(spark, rows):
    panel = spark.createDataFrame(
        [(date(2026, 1, 1), 1.0, 2.0), (date(2026, 1, 2), None, None)], "Date date, Open double, Close double"
    )
    assert rows(panel_to_rows(panel, ["A", "B"])) == [(date(2026, 1, 1), 1.0, None, None, 2.0, None, "A")]


def test_column_helpers(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    lit = F.lit
    assert value(fx.run_id_of(lit("file:/b/dt=x/run_id=20260101000000Z.json.gz"))) == "20260101000000Z"
    assert value(fx.run_id_of(lit("file:/b/part-0.json.gz"))) is None
    assert [value(c) for c in fx.bucket_and_key(lit("s3://bucket/a/b.json"))] == ["bucket", "a/b.json"]
    assert [value(c) for c in fx.bucket_and_key(lit("file:/a"))] == [None, None]
    assert value(fx.path_safe(lit("usd/cad"))) == "usd-cad"
    assert value(fx.exclusive_end(lit("2026-02-28").cast("date"))) == date(2026, 3, 1)
    numbers = {"nan": True, "inf": float("inf"), "-1.5": -1.5, "1e3": 1000.0, "1.0d": None, "2f": None, "": None,
               ".": None, "x": None, "Infinity": float("inf"), "-inf": float("-inf")}
    for text, want in numbers.items():
        got = value(fx.parse_number(lit(text)))
        assert (got != got) if want is True else got == want, text
    assert [value(fx.run_status(lit(r), lit(f))) for r, f in ((0, 3), (5, 0), (5, 1))] == ["success", "success", "partial"]


def test_a_symbol_opens_only_the_files_that_hold_it(spark, tmp_path, rows):
    from datetime import date

    from tidemark.plans import landing

    root, index = str(tmp_path / "bronze"), str(tmp_path / "index")
    path = bronze.landed_path(root, "yahoo", "history")

    def land(symbol, day):
        schema = "symbol string, ts date, open double, high double, low double, close double, volume bigint"
        bars = spark.createDataFrame([(symbol, date(2026, 1, day), 1.0, 1.0, 1.0, 1.0, 1)], schema)
        bronze.land_envelopes(landing.prices(bars, f"2026-02-{day:02d} 00:00:00"), root)
        return bronze.refresh_index(spark, path, schemas.PRICES_PAYLOAD, index)

    assert [land(s, d) for s, d in (("A", 1), ("B", 2), ("A", 3))] == [1, 1, 1]
    assert bronze.refresh_index(spark, path, schemas.PRICES_PAYLOAD, index) == 0
    found = bronze.read_symbol(spark, index, schemas.PRICES_PAYLOAD, "a")
    assert rows(found.select("meta.dt"), "dt") == [("2026-02-01",), ("2026-02-03",)]
    opened = {f.split("/dt=")[1][:10] for f in found.inputFiles()}
    assert opened == {"2026-02-01", "2026-02-03"}
    assert bronze.read_symbol(spark, index, schemas.PRICES_PAYLOAD, "Z").count() == 0


def test_a_price_file_holds_few_envelopes(spark, tmp_path):
    """Files are read by one task each, so large envelopes are landed fewer to a file."""
    days = spark.range(40).select(
        F.concat(F.lit("U"), F.col("id").cast("string")).alias("symbol"), F.lit("2024-01-03").cast("date").alias("ts"),
        *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")), F.lit(1).cast("bigint").alias("volume"),
    )
    bronze.land_envelopes(landed_rows.prices(days, "2024-02-01 16:05:00"), str(tmp_path), 10)
    assert len(list(tmp_path.rglob("*.gz"))) >= 4
    path = bronze.landed_path(str(tmp_path), "yahoo", "history")
    assert bronze.read_envelopes(spark, path, schemas.PRICES_PAYLOAD).count() == 40


def test_rows_dealt_out_are_not_shuffled_as_text(spark, tmp_path):
    """Facts were dealt out as narrow rows; their envelopes lie in a file a task, each of them once."""
    seven = spark.range(0, 70, 1, 7).selectExpr("id", "concat('S', id) ticker", "timestamp '2024-02-01 00:00:00' at")
    payload = F.struct(F.struct(F.col("id").alias("records")).alias("facts"))
    rows = landed_rows._landing(seven, "v", "d", 1, F.col("at"), payload=payload)
    bronze.land_envelopes(rows, str(tmp_path), dealt=True)
    read = spark.read.option("recursiveFileLookup", True).text(str(tmp_path))
    assert read.select("_metadata.file_path").distinct().count() == 7 and read.distinct().count() == read.count() == 70


def test_record_count_of_any_payload(spark, rows):
    texts = ['{"a":1}', '[1,2]', ' [1]', '{"records":[1,2,3]}', '{"\\u0072ecords":[1,2]}', '{"a":"records"}', '{"a":"x\\\\y"}', "null", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = F.coalesce(F.json_array_length("t"), F.json_array_length(F.get_json_object("t", "$.records")), F.lit(1))
    assert rows(df.select("i", bronze.record_count("t").alias("n")), "i") == rows(df.select("i", parsed.alias("n")), "i")
