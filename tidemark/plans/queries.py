"""Every operator as a query over the supplied tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark import schemas
from tidemark.functions import columns as fx
from tidemark.operators import (
    backfill,
    clean,
    dedup,
    ledger,
    normalize,
    quality,
    registry,
    returns,
    selection,
    serve,
    upsert,
    watermark,
)
from tidemark.plans import derive, jobs, landing
from tidemark.session import work_folder
from tidemark.sources import bronze, lookups, panel, tables
from tidemark.streaming.incremental import load_batch, load_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2024-02-01 16:05:00"
OLD = "2024-01-20 16:05:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def now() -> Column:
    return derive.literal_time(NOW)


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def with_text_time(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: derive.as_text(c) for c in names})


def parsed(rows: DataFrame, payload: str) -> DataFrame:
    return bronze.parse_envelopes(bronze.build_envelopes(rows), payload)


# -- returns ------------------------------------------------------------------------------------


@query
def bars_returns(spark, sf):
    return returns.add_return(derive.bars(spark, sf), "close")


@query
def bars_returns_zero_prev(spark, sf):
    zeroed = F.when(F.col("volume") == 1, F.lit(0.0)).otherwise(F.col("close"))
    bars = derive.bars(spark, sf).select("symbol", "ts", zeroed.alias("close"))
    return returns.add_return(bars, "close")


@query
def returns_by_event_type(spark, sf):
    """Five groups hold all rows: each is split by day."""
    events = derive.read(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    added = returns.add_return(events, "value", group_by="event_type")
    return added.select("event_id", "event_type", "value_returns")


@query
def returns_batch_scope(spark, sf):
    """All bars as two batches: the first row of a symbol in each has no return."""
    bars = derive.bars(spark, sf)
    early = F.col("ts") < day("2024-01-15")
    first, second = (returns.add_return(bars.where(c), "close") for c in (early, ~early))
    return first.unionByName(second)


@query
def returns_history_scope(spark, sf):
    bars = derive.bars(spark, sf)
    batch = bars.where(F.col("ts") >= day("2024-01-15"))
    stored = bars.where(F.col("ts") < day("2024-01-20")).withColumn("close", F.col("close") * 2)
    return returns.add_return_with_history(batch, stored)


# -- keep-last, normalisers, cleaners -----------------------------------------------------------


@query
def dedup_keep_last(spark, sf):
    rows = derive.macro(spark, sf).select("series", F.to_date("date").alias("ts"), "value", "position")
    return dedup.keep_last(rows, ["series", "ts"], ["position"])


@query
def facts_latest_filed(spark, sf):
    rows = derive.facts(spark, sf)
    rows = rows.withColumn("concept", F.concat_ws(":", "taxonomy", "name")).drop("taxonomy", "name")
    rows = rows.withColumns(
        {c: F.col(c).cast("string") for c in ("period_start", "period_end", "filed")}
    )
    # Some filing days are unknown: those lose to any known one.
    rows = rows.withColumn("filed", F.when(F.col("fp").isNotNull(), F.col("filed")))
    return clean.clean_facts(rows).select(*schemas.SILVER_FACTS.names)


@query
def prices_normalize(spark, sf):
    envelopes = parsed(landing.prices(derive.bars(spark, sf), NOW), schemas.PRICES_PAYLOAD)
    rows = clean.clean_prices(normalize.normalize_prices(envelopes))
    return rows.select(*schemas.SILVER_PRICES.names, "bronze_run_id")


@query
def failed_symbols(spark, sf):
    envelopes = parsed(landing.prices(derive.bars(spark, sf), NOW), schemas.PRICES_PAYLOAD)
    return normalize.failed_symbols(envelopes)


@query
def macro_normalize(spark, sf):
    envelopes = parsed(landing.macro(derive.macro(spark, sf)), schemas.MACRO_PAYLOAD)
    rows = clean.clean_macro(normalize.normalize_macro(envelopes))
    return rows.select(*schemas.SILVER_MACRO.names)


@query
def facts_flatten(spark, sf):
    envelopes = parsed(landing.facts(derive.facts(spark, sf, derive.FACT_ROW)), schemas.FACTS_PAYLOAD)
    rows = clean.clean_facts(normalize.normalize_facts(envelopes))
    return rows.select(*schemas.SILVER_FACTS.names)


@query
def facts_flatten_company(spark, sf):
    """Envelopes of several taxonomies, concepts, units and observations each, read as VARIANT."""
    lines = bronze.build_envelopes(landing.company(derive.facts(spark, sf, ("ticker", "month"))))
    rows = clean.clean_facts(normalize.typed_facts(normalize.variant_facts(lines)))
    return rows.select(*schemas.SILVER_FACTS.names, "extra")


@query
def facts_flatten_company_typed(spark, sf):
    """The same envelopes by the payload's schema, which knows no further fields."""
    envelopes = parsed(landing.company(derive.facts(spark, sf, ("ticker", "month"))), schemas.FACTS_PAYLOAD)
    rows = clean.clean_facts(normalize.normalize_facts(envelopes))
    return rows.select(*schemas.SILVER_FACTS.names)


@query
def facts_unknown_fields(spark, sf):
    lines = bronze.build_envelopes(landing.company(derive.facts(spark, sf, ("ticker", "month"))))
    return normalize.unknown_fact_fields(lines)


@query
def empty_batches(spark, sf):
    """What each vendor's cleaned rows are when nothing came: no rows, and their columns and types."""
    made = {
        "prices": clean.clean_prices(normalize.normalize_prices(
            parsed(landing.prices(derive.bars(spark, sf).where("volume < 0"), NOW), schemas.PRICES_PAYLOAD))),
        "macro": clean.clean_macro(normalize.normalize_macro(
            parsed(landing.macro(derive.macro(spark, sf).where("position < 0")), schemas.MACRO_PAYLOAD))),
        "facts": clean.clean_facts(normalize.normalize_facts(
            parsed(landing.facts(derive.facts(spark, sf, derive.FACT_ROW).where("val < 0")), schemas.FACTS_PAYLOAD))),
        "figi": clean.clean_figi(normalize.normalize_figi(
            parsed(landing.figi(derive.figi(spark, sf, derive.FIGI_ROW).where("position < 0")), schemas.FIGI_PAYLOAD))),
    }
    silver = {
        "prices": schemas.SILVER_PRICES, "macro": schemas.SILVER_MACRO,
        "facts": schemas.SILVER_FACTS, "figi": schemas.SILVER_FIGI,
    }
    found = None
    for vendor, rows in made.items():
        kinds = dict(rows.dtypes)
        columns = F.array(*(
            F.struct(F.lit(vendor).alias("vendor"), F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"))
            for c in silver[vendor].names
        ))
        counted = rows.agg(F.count(F.lit(1)).alias("n")).select("n", F.inline(columns))
        found = counted if found is None else found.unionByName(counted)
    return found


@query
def figi_flatten(spark, sf):
    envelopes = parsed(landing.figi(derive.figi(spark, sf, derive.FIGI_ROW)), schemas.FIGI_PAYLOAD)
    rows = clean.clean_figi(normalize.normalize_figi(envelopes))
    return rows.select(*schemas.SILVER_FIGI.names)


@query
def info_normalize(spark, sf):
    good, _ = normalize.normalize_info(parsed(landing.info(spark, sf), schemas.INFO_PAYLOAD))
    return good.select("ticker", "name", "exchange", "quote_type", "timezone", "currency")


@query
def info_rejects(spark, sf):
    _, bad = normalize.normalize_info(parsed(landing.info(spark, sf), schemas.INFO_PAYLOAD))
    return bad.select("ticker", "reason")


@query
def envelope_rejects(spark, sf):
    """Urgent orders come without series, low ones with an empty one."""
    rows = derive.macro(spark, sf)
    series = F.when(F.col("series") == "5-low", F.lit("")).when(
        F.col("series") != "1-urgent", F.col("series")
    )
    landed = landing.macro(rows.withColumn("series", series))
    _, bad = normalize.split_keyed(parsed(landed, schemas.MACRO_PAYLOAD), "series")
    return bad.select(F.col("meta.run_id").alias("run_id"), "reason")


# -- sources and sinks --------------------------------------------------------------------------


@query
def envelope_meta(spark, sf):
    """Meta of envelopes with list, record and other payloads, and untidy codes."""
    c = derive.read(spark, sf, "customer")
    segment = F.col("c_mktsegment")
    some = F.array_repeat(F.col("c_name"), F.col("c_nationkey"))
    payload = (
        F.when(segment == "MACHINERY", F.to_json(some))
        .when(segment == "BUILDING", F.to_json(F.struct(some.alias("records"))))
        .otherwise(F.to_json(F.struct(some.alias("rows"))))
    )
    number = F.col("c_custkey").cast("string")
    landed = c.select(
        F.concat(F.lit(" V"), segment).alias("vendor"),
        F.concat(F.lit("Data "), F.lit(" ")).alias("dataset"),
        F.date_add(day("2024-01-01"), F.col("c_nationkey")).alias("dt"),
        F.create_map(
            F.lit("symbol"), F.concat(F.lit("  "), "c_name", F.lit(" ")),
            F.lit("blank"), F.lit("   "),
            F.lit("none"), F.lit(None).cast("string"),
        ).alias("partitions"),
        F.create_map(F.lit("number"), number).alias("params"),
        F.lit(1).alias("schema_version"),
        F.timestamp_seconds(F.lit(landing.EPOCH) + F.col("c_custkey")).alias("fetched_at"),
        payload.alias("payload"),
    )
    built = bronze.build_envelopes(landed)
    meta = F.from_json(F.get_json_object("value", "$.meta"), " ".join(schemas.META.split()))
    return built.withColumn("m", meta).select(
        "vendor",
        "dataset",
        "dt",
        "run_id",
        F.col("m.source").alias("source"),
        F.col("m.record_count").alias("record_count"),
        F.size("m.partitions").alias("n_partitions"),
        F.col("m.partitions")["symbol"].alias("symbol"),
        F.col("m.params")["number"].alias("number"),
    )


@query
def bronze_round_trip(spark, sf):
    """Land the envelopes of two days as gzip files, read them back, keep one day and a run."""
    root = work_folder(spark, "bronze")
    bars = derive.bars(spark, sf)
    for at in (OLD, NOW):
        bronze.land_envelopes(landing.prices(bars, at), root, landing.PRICE_FILE)
    path = bronze.landed_path(root, "yahoo", "history")
    envelopes = bronze.read_envelopes(spark, path, schemas.PRICES_PAYLOAD)
    found = bronze.locate(envelopes, "20240201160500Z", dt="2024-02-01")
    return found.select(
        F.col("meta.params")["symbols"].alias("symbols"),
        F.col("meta.dt").alias("dt"),
        F.size("payload.rows").alias("n_rows"),
        F.col("payload.start").alias("start"),
        F.col("payload.end").alias("end"),
    )


@query
def silver_round_trip(spark, sf):
    root = work_folder(spark, "silver")
    bars = derive.bars(spark, sf).withColumns(
        {"bronze_run_id": F.lit("r"), "dt": F.date_format("ts", "yyyy-MM-01")}
    )
    tables.write_silver(bars, root, "yahoo", "prices_1d", "run1", clean.PRICES_KEY)
    silver = tables.read_silver(spark, root, "yahoo", "prices_1d", schemas.SILVER_PRICES)
    return silver.select(*schemas.SILVER_PRICES.names, "run_id", "dt")


@query
def bronze_by_symbol(spark, sf):
    """One symbol's envelopes of two days, from the files that the index names."""
    root = work_folder(spark, "indexed")
    bars = derive.bars(spark, sf)
    path, index = bronze.landed_path(root, "yahoo", "history"), f"{root}/index"
    for at in (OLD, NOW):
        bronze.land_envelopes(landing.prices(bars, at), root, landing.PRICE_FILE)
        bronze.refresh_index(spark, path, schemas.PRICES_PAYLOAD, index)
    found = bronze.read_symbol(spark, index, schemas.PRICES_PAYLOAD, " u7")
    return found.select(
        F.col("meta.params")["symbols"].alias("symbols"),
        F.col("meta.dt").alias("dt"),
        F.size("payload.rows").alias("n_rows"),
    )


@query
def silver_order(spark, sf):
    """Rows of the Silver files, and those that lie before a smaller key in theirs."""
    root = work_folder(spark, "silver")
    bars = derive.bars(spark, sf).withColumns(
        {"bronze_run_id": F.lit("r"), "dt": F.date_format("ts", "yyyy-MM-01")}
    )
    tables.write_silver(bars, root, "yahoo", "prices_1d", "run1", clean.PRICES_KEY)
    silver = tables.read_silver(spark, root, "yahoo", "prices_1d", schemas.SILVER_PRICES)
    key = F.struct(*clean.PRICES_KEY)
    return disordered(silver.select("run_id", "dt", key.alias("key"), "_metadata.file_name", "_metadata.row_index"),
                      ["run_id", "dt", "file_name"])


ORDER_BLOCK = 100_000  # neighbouring rows of a file that one task compares


def disordered(placed: DataFrame, file: list[str]) -> DataFrame:
    """(n_rows, disordered): rows by their key and row_index in a file, and those before a smaller key.

    A file is compared in blocks of rows, and the last key of a block with the first of the next.
    """
    block = file + ["block"]
    rows = placed.withColumn("block", F.floor(F.col("row_index") / ORDER_BLOCK))
    before = F.lag("key").over(Window.partitionBy(*block).orderBy("row_index"))
    blocks = rows.withColumn("before", before).groupBy(*block).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("before") > F.col("key")).alias("within"),
        F.min_by("key", "row_index").alias("first"),
        F.max_by("key", "row_index").alias("last"),
    )
    last = F.lag("last").over(Window.partitionBy(*file).orderBy("block"))
    edge = F.when(last > F.col("first"), 1).otherwise(0)
    none = F.lit(0).cast("bigint")
    return blocks.withColumn("edge", edge).agg(
        F.coalesce(F.sum("n"), none).alias("n_rows"),
        F.coalesce(F.sum(F.col("within") + F.col("edge")), none).alias("disordered"),
    )


@query
def wide_panel_long(spark, sf):
    """Bars per event type, spread into one column per (type, field), and back to rows."""
    events = derive.read(spark, sf, "events")
    # The event types of the supplied table.
    types = ["click", "signup", "view", "error", "purchase"]
    when = F.struct("ts", "event_id")
    bars = events.groupBy(F.to_date("ts").alias("Date"), "event_type").agg(
        F.min_by("value", when).alias("Open"),
        F.max("value").alias("High"),
        F.min("value").alias("Low"),
        F.max_by("value", when).alias("Close"),
        F.count(F.lit(1)).cast("double").alias("Volume"),
    )
    bars = bars.where((F.col("event_type") != "view") | (F.dayofmonth("Date") % 3 != 0))
    wide = bars.groupBy("Date").pivot("event_type", types).agg(
        *(F.first(f).alias(f) for f in panel.FIELDS)
    )
    wide = wide.withColumnsRenamed({f"{t}_{f}": f"{t}|{f}" for t in types for f in panel.FIELDS})
    return panel.panel_to_rows(wide, [*types, "absent"])


@query
def cik_lookup(spark, sf):
    supplier = derive.read(spark, sf, "supplier")
    number = F.col("s_suppkey")

    def entry(cik: Column, ticker: Column) -> Column:
        fields = [cik.cast("string").alias("cik_str"), ticker.alias("ticker"), F.col("s_name").alias("title")]
        return F.struct(*fields)

    lower = F.format_string("s%d", "s_suppkey")
    entries = F.create_map(F.lit("0"), entry(number, lower), F.lit("1"), entry(number + 320193, F.upper(lower)))
    text = F.when(F.col("s_acctbal") >= 0, F.to_json(entries)).otherwise(
        F.to_json(F.map_filter(entries, lambda k, _: k == "0"))
    )
    ciks = lookups.cik_table(supplier.select(text.alias("value"), number.alias("position")))
    asked = derive.read(spark, sf, "customer").select(
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("ticker"), "c_custkey"
    )
    found, missing = lookups.with_cik(asked, ciks)
    return found.unionByName(missing, allowMissingColumns=True).select("c_custkey", "ticker", "cik")


@query
def series_lookup(spark, sf):
    found, unknown = lookups.with_series_id(_series_requests(spark, sf))
    both = found.unionByName(unknown, allowMissingColumns=True)
    return both.select("position", "series", "series_id")


def _series_requests(spark, sf) -> DataFrame:
    series = F.col("series")
    code = (
        F.when(series == "1-urgent", "CPI")
        .when(series == "2-high", "usd/cad")
        .when(series == "3-medium", "Interest_Rate_10Y")
        .otherwise(series)
    )
    return derive.macro(spark, sf).select("position", code.alias("series"))


@query
def figi_unwrap(spark, sf):
    supplier = derive.read(spark, sf, "supplier")
    entry = "struct<error: string, data: array<struct<figi: string>>>"
    owed = F.col("s_acctbal") < 0
    result = F.struct(
        F.when(owed, F.lit("No identifier found.")).alias("error"),
        F.array(F.struct(F.col("s_name").alias("figi"))).alias("data"),
    ).cast(entry)
    empty = F.array().cast(f"array<{entry}>")
    results = F.when(F.col("s_nationkey") == 0, empty).otherwise(F.array(result, result))
    responses = supplier.select("s_suppkey", results.alias("results"))
    good, bad = lookups.split_responses(responses)
    accepted = good.select(
        "s_suppkey", F.get("payload.data", F.lit(0))["figi"].alias("figi"), F.lit(None).cast("string").alias("error")
    )
    return accepted.unionByName(bad.select("s_suppkey", F.lit(None).cast("string").alias("figi"), "error"))


# -- quality gate -------------------------------------------------------------------------------


def _flawed_bars(spark, sf) -> DataFrame:
    """Busy days are doubled; by their number of events, others lose the close, get a negative low
    or a high below the low."""
    n = F.col("volume")
    bars = derive.bars(spark, sf)
    flawed = bars.select(
        "symbol",
        "ts",
        "open",
        F.when(n == 4, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(n == 2, -F.col("low")).otherwise(F.col("low")).alias("low"),
        F.when(n != 3, F.col("close")).alias("close"),
        F.when(n == 1, -n).otherwise(n).alias("volume"),
    )
    return flawed.unionByName(flawed.where(n >= 5))


def _reported(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "*",
        quality.verdict().alias("broken"),
        F.array_join(quality.warning_texts(), "; ").alias("warnings"),
    )


@query
def quality_report(spark, sf):
    return _reported(quality.quality_metrics(_flawed_bars(spark, sf)))


@query
def quality_report_by_symbol(spark, sf):
    return _reported(quality.quality_metrics(_flawed_bars(spark, sf), by=["symbol"]))


@query
def quality_refusals(spark, sf):
    """Why the gate refuses each of some batches: without rows, without columns, flawed, and a sound one."""
    bars = derive.bars(spark, sf)
    batches = {
        "no rows": bars.where("volume < 0"),
        "no rows and no columns": bars.where("volume < 0").select("symbol"),
        "no close and no volume": bars.drop("close", "volume"),
        "flawed": _flawed_bars(spark, sf).dropDuplicates(["symbol", "ts"]).withColumn("close", F.abs("close")),
        "sound": bars,
    }
    said = [(name, quality.refusal(batch, max_null_close_ratio=1.0)) for name, batch in batches.items()]
    return spark.createDataFrame(said, "batch string, refusal string")


# -- upserts ------------------------------------------------------------------------------------


@query
def upsert_prices(spark, sf):
    bars = returns.add_return(derive.bars(spark, sf), "close")
    stored = bars.where(F.col("ts") < day("2024-01-20")).withColumns(
        {
            "dividends": F.lit(0.5),
            "stock_split": F.lit(2.0),
            "source": F.lit("manual"),
            "run_id": F.lit("old"),
            "ingested_at": derive.literal_time(OLD),
        }
    )
    late = derive.bars(spark, sf).where(F.col("ts") >= day("2024-01-15"))
    batch = returns.add_return(late, "close").withColumn("open", F.col("open") + 1)
    return with_text_time(upsert.upsert(stored, batch, upsert.PRICES, now()), "ingested_at")


@query
def upsert_macro(spark, sf):
    rows = dedup_keep_last(spark, sf).withColumn("value", fx.parse_number("value"))
    rows = rows.select("series", "ts", "value")
    stored = rows.where(F.col("ts") < day("1999-01-01")).withColumns(
        {
            "source": F.lit("manual"),
            "run_id": F.lit("old"),
            "ingested_at": derive.literal_time(OLD),
        }
    )
    batch = rows.where(F.col("ts") >= day("1998-01-01")).withColumns(
        {"value": F.col("value") + 1, "run_id": F.lit("new")}
    )
    return with_text_time(upsert.upsert(stored, batch, upsert.MACRO, now()), "ingested_at")


@query
def upsert_facts(spark, sf):
    rows = facts_latest_filed(spark, sf)
    stored = rows.where(F.col("period_end") < day("1999-01-01")).withColumns(
        {
            "source": F.lit("manual"),
            "run_id": F.lit("old"),
            "ingested_at": derive.literal_time(OLD),
        }
    )
    batch = rows.where(F.col("period_end") >= day("1998-01-01")).withColumns(
        {"val": F.col("val") + 1, "filed": F.date_sub("filed", 1000)}
    )
    return with_text_time(upsert.upsert(stored, batch, upsert.FACTS, now()), "ingested_at")


@query
def upsert_figi(spark, sf):
    rows = dedup.keep_last(derive.figi(spark, sf), clean.FIGI_KEY, ["position"])
    stored = rows.where(F.col("share_class_figi") != "ECONOMY").withColumns(
        {"source": F.lit("manual"), "run_id": F.lit("old"), "ingested_at": derive.literal_time(OLD)}
    )
    batch = rows.where(F.col("share_class_figi") <= "PROMO").withColumn("name", F.upper("name"))
    batch = batch.select(*schemas.SILVER_FIGI.names)
    return with_text_time(upsert.upsert(stored, batch, upsert.FIGI, now()), "ingested_at")


def _marks(bars: DataFrame, run: str = "r") -> DataFrame:
    """Marks after a load of ``bars``; a bar's run is named by its day of the month."""
    named = bars.withColumn("bronze_run_id", F.date_format("ts", f"'{run}'dd"))
    return watermark.advance(named, "symbol", "ts", watermark.PRICES_MARK)


def _stored_marks(spark, sf) -> DataFrame:
    return _marks(derive.bars(spark, sf)).withColumn("updated_at", derive.literal_time(OLD))


def _late_marks(spark, sf) -> DataFrame:
    """A later batch that brings the even days of the month once more."""
    return _marks(derive.bars(spark, sf).where(F.dayofmonth("ts") % 2 == 0), "b")


@query
def watermark_advance(spark, sf):
    return _marks(derive.bars(spark, sf))


@query
def upsert_watermark(spark, sf):
    """A late batch moves marks back."""
    moved = upsert.upsert_watermarks(_stored_marks(spark, sf), _late_marks(spark, sf), now())
    return with_text_time(moved, "updated_at")


@query
def upsert_watermark_monotonic(spark, sf):
    """The later day stays, with the run that brought it."""
    stored, late = _stored_marks(spark, sf), _late_marks(spark, sf)
    return with_text_time(upsert.upsert_watermarks(stored, late, now(), monotonic=True), "updated_at")


# -- starts -------------------------------------------------------------------------------------


def _symbol_requests(spark, sf) -> DataFrame:
    """Every customer number as a bar symbol, so some symbols are never ingested."""
    number = F.col("c_custkey").cast("string")
    return derive.read(spark, sf, "customer").select(
        F.concat(F.lit("U"), number).alias("symbol"), F.col("c_custkey").alias("position")
    )


@query
def resolve_start_prices(spark, sf):
    wanted = _symbol_requests(spark, sf).withColumnRenamed("symbol", "ticker")
    return watermark.start_per_key(wanted, _stored_marks(spark, sf), watermark.PRICES_MARK)


@query
def resolve_batch_start(spark, sf):
    """Earliest start over the symbols that have bars."""
    wanted = derive.bars(spark, sf).select(F.col("symbol").alias("ticker"))
    marks = _marks(derive.bars(spark, sf))
    starts = watermark.start_per_key(wanted, marks, watermark.PRICES_MARK)
    return watermark.batch_start(starts)


@query
def resolve_start_macro(spark, sf):
    rows = derive.macro(spark, sf).select(
        "series", F.to_date("date").alias("ts"), F.lit("r").alias("bronze_run_id")
    )
    marks = watermark.advance(rows.where(F.col("series") != "5-low"), "series", "ts", watermark.MACRO_MARK)
    wanted = rows.select(F.col("series").alias("ticker"))
    return watermark.start_per_key(wanted, marks, watermark.MACRO_MARK)


@query
def resolve_start_facts(spark, sf):
    rows = derive.facts(spark, sf).select("ticker", "period_end", F.lit("r").alias("bronze_run_id"))
    known = rows.join(derive.supplier_registry(spark, sf), "ticker", "left_semi")
    marks = watermark.advance(known, "ticker", "period_end", watermark.FACTS_MARK)
    return watermark.start_per_key(
        rows.select("ticker"), marks, watermark.FACTS_MARK, run_date=day("2024-02-01")
    )


# -- ledger -------------------------------------------------------------------------------------


def _order_events(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every order is a run: fulfilled ones succeeded, open ones ended in part, pending ones run."""
    orders = derive.read(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    runs = orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.lower("o_orderpriority").alias("dataset"),
        F.to_date("o_orderdate").alias("run_date"),
        F.col("o_orderstatus").alias("letter"),
        F.floor("o_totalprice").cast("int").alias("items_total"),
        at.alias("begun"),
    )
    outcomes = runs.select(
        "run_id",
        "letter",
        F.when(F.col("letter") == "F", "success").otherwise("partial").alias("status"),
        "items_total",
        (F.col("items_total") - 7).alias("items_success"),
        F.lit(7).alias("items_failed"),
        F.repeat(F.lit("note "), 120).alias("notes"),
        (F.col("begun") + F.expr("interval 1 hour")).alias("ended"),
    )
    return runs, outcomes


@query
def run_ledger_state(spark, sf):
    runs, outcomes = _order_events(spark, sf)
    started = ledger.start_events(runs, F.col("begun"))
    finished = ledger.finish_events(outcomes.where("letter <> 'P'"), F.col("ended"))
    return with_text_time(ledger.run_state(started.unionByName(finished)), "started_at", "finished_at")


@query
def run_ledger_unknown(spark, sf):
    runs, outcomes = _order_events(spark, sf)
    started = ledger.start_events(runs.where("letter <> 'P'"), F.col("begun"))
    finished = ledger.finish_events(outcomes.where("letter <> 'O'"), F.col("ended"))
    return ledger.unknown_runs(started.unionByName(finished))


@query
def run_ids(spark, sf):
    """A fresh run id for every order."""
    ids = derive.read(spark, sf, "orders").select(fx.random_run_id().alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("ids"),
        F.count_if(F.col("id").rlike("^[0-9a-f]{32}$")).alias("hexadecimal"),
    )


@query
def run_status(spark, sf):
    """Per nation: customers asked for, customers with orders, and the status that gives."""
    customer = derive.read(spark, sf, "customer")
    orders = derive.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    joined = customer.join(orders, "c_custkey", "left")
    counts = joined.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("items_total"),
        F.count_if(F.col("rows").isNull()).alias("items_failed"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"),
    )
    return counts.select(
        "c_nationkey",
        "items_total",
        (F.col("items_total") - F.col("items_failed")).alias("items_success"),
        "items_failed",
        fx.run_status(F.col("rows"), F.col("items_failed")).alias("status"),
    )


# -- registry -----------------------------------------------------------------------------------


@query
def registry_create(spark, sf):
    """Active customers are registered; all are proposed, twice, the second time by another name."""
    known = derive.registry(spark, sf).where("is_active").withColumn("is_scheduled", F.lit(False))
    proposed = derive.instruments(spark, sf).withColumn("name", F.lower("name"))
    again = proposed.withColumns(
        {"position": F.col("position") + 1_000_000_000, "name": F.lit("again"), "ticker": F.lower("ticker")}
    )
    grown = registry.get_or_create(known, proposed.unionByName(again), now())
    return with_text_time(grown, "created_at", "updated_at")


@query
def registry_set_scheduled(spark, sf):
    known = derive.registry(spark, sf)
    changes = derive.read(spark, sf, "customer").select(
        F.lower("c_name").alias("ticker"), (F.col("c_acctbal") > 5000).alias("is_scheduled")
    )
    changes = changes.join(
        derive.read(spark, sf, "orders").select(
            F.format_string("customer#%09d", "o_custkey").alias("ticker")
        ),
        "ticker",
        "left_semi",
    )
    return with_text_time(registry.set_scheduled(known, changes, now()), "created_at", "updated_at")


@query
def scheduled_universe(spark, sf):
    return registry.scheduled_universe(derive.registry(spark, sf))


@query
def instruments_list(spark, sf):
    found = registry.instruments(derive.registry(spark, sf), is_active=True, is_scheduled=False)
    return found.select(*serve.INSTRUMENT_COLUMNS)


@query
def instrument_lookup(spark, sf):
    found = registry.instrument(derive.registry(spark, sf), "customer#000000007")
    return found.select(*serve.INSTRUMENT_COLUMNS)


# -- serving ------------------------------------------------------------------------------------


@query
def prices_serve(spark, sf):
    table, known = bars_returns(spark, sf), derive.symbol_registry(spark, sf)
    return serve.prices(table, known, "u7", start="2024-01-05", end="2024-01-25")


@query
def prices_serve_topk_per_symbol(spark, sf):
    return serve.prices_per_symbol(bars_returns(spark, sf), derive.symbol_registry(spark, sf), 10)


@query
def prices_unregistered(spark, sf):
    return registry.unregistered(derive.bars(spark, sf), derive.symbol_registry(spark, sf), "symbol")


@query
def facts_serve(spark, sf):
    table, known = facts_latest_filed(spark, sf), derive.supplier_registry(spark, sf)
    return serve.fundamentals(table, known, "s7", concept="A:F")


@query
def facts_serve_topk_per_ticker(spark, sf):
    table, known = facts_latest_filed(spark, sf), derive.supplier_registry(spark, sf)
    return serve.fundamentals_per_ticker(table, known, 25)


@query
def events_topk_per_type(spark, sf):
    """Five keys hold all rows, and the limit is above what Spark cuts down to by itself."""
    events = derive.read(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    top = serve.top_per_key(events, "event_type", ["ts", "event_id"], 2000)
    return top.select("event_id", "event_type", "value")


def _stored(spark, rows, spec, name) -> DataFrame:
    """Rows loaded into a Gold table of their own, read back."""
    lake = _lake(spark, name)
    tables.load(spark, lake.gold, rows, spec, now(), unique=rows)
    return tables.read_table(spark, lake.gold, spec)


@query
def prices_serve_stored(spark, sf):
    """The read from the loaded table: months in range, and row groups that may hold the symbol."""
    table = _stored(spark, bars_returns(spark, sf), upsert.PRICES, "serve-prices")
    return serve.prices(table, derive.symbol_registry(spark, sf), "u7", start="2024-01-05", end="2024-01-25")


@query
def facts_serve_stored(spark, sf):
    table = _stored(spark, facts_latest_filed(spark, sf), upsert.FACTS, "serve-facts")
    return serve.fundamentals(table, derive.supplier_registry(spark, sf), "s7", concept="A:F")


@query
def figi_serve(spark, sf):
    return serve.figi_candidates(figi_flatten(spark, sf), "s7")


@query
def figi_serve_stored(spark, sf):
    """The read from the loaded table: one directory of it is opened."""
    rows = dedup.keep_last(derive.figi(spark, sf), clean.FIGI_KEY, ["position"])
    table = _stored(spark, rows.select(*schemas.SILVER_FIGI.names), upsert.FIGI, "serve-figi")
    return serve.figi_candidates(table, "s7").select(*schemas.SILVER_FIGI.names)


@query
def figi_registered(spark, sf):
    return registry.registered(figi_flatten(spark, sf), derive.supplier_registry(spark, sf))


@query
def figi_unregistered(spark, sf):
    return registry.unregistered(figi_flatten(spark, sf), derive.supplier_registry(spark, sf))


@query
def missing_symbols(spark, sf):
    return registry.missing_symbols(_symbol_requests(spark, sf), derive.bars(spark, sf))


# -- selection ----------------------------------------------------------------------------------


@query
def symbol_list(spark, sf):
    blank = F.col("c_mktsegment") == "FURNITURE"
    untidy = F.when(blank, F.lit("   ")).otherwise(F.concat(F.lit("  "), F.lower("c_name"), F.lit(" ")))
    asked = derive.read(spark, sf, "customer").select("c_custkey", untidy.alias("symbol"))
    return selection.clean_symbols(asked)


@query
def code_lists(spark, sf):
    listed = F.concat(F.lit(" "), "c_name", F.lit(",, "), "c_mktsegment", F.lit(" ,"))
    codes = F.posexplode(selection.listed_codes(listed, "lower")).alias("position", "code")
    return derive.read(spark, sf, "customer").select("c_custkey", codes)


@query
def selected_series(spark, sf):
    """An override names series for most customers; blanks fall back to all that are known."""
    segment = F.col("c_mktsegment")
    override = F.when(segment == "FURNITURE", F.lit(" , ")).when(
        segment != "BUILDING", F.concat(F.lit(" "), segment, F.lit(",,GDP "))
    )
    codes = F.posexplode(selection.selected_series(override)).alias("position", "code")
    return derive.read(spark, sf, "customer").select("c_custkey", codes)


@query
def joined_symbols(spark, sf):
    blank = F.when(F.col("c_acctbal") < 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    codes = F.array(F.lower("c_name"), blank, F.lit(None), F.lit(" x "))
    return derive.read(spark, sf, "customer").select(
        "c_custkey", selection.joined_codes(codes).alias("symbols")
    )


@query
def path_parts(spark, sf):
    """Uris and codes with slashes, taken apart and made safe for paths."""
    kept = F.when(F.col("p_size") % 2 == 0, F.lit("s3://")).otherwise(F.lit("file://"))
    uri = F.concat(kept, "p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name")
    bucket, key = fx.bucket_and_key(uri)
    return derive.read(spark, sf, "part").select(
        "p_partkey",
        bucket.alias("bucket"),
        key.alias("key"),
        fx.path_safe(F.concat_ws("/", "p_brand", "p_type")).alias("code"),
    )


@query
def selected_tickers(spark, sf):
    """No override: the first 25 of the scheduled universe."""
    return selection.selected_tickers(derive.registry(spark, sf), "  , ", 25)


@query
def date_window(spark, sf):
    status = F.col("o_orderstatus")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    start = F.when(status == "F", F.concat(F.lit(" "), text)).when(status == "O", F.lit("  "))
    end = F.when(status == "P", F.lit("2002-01-01"))
    first, last = selection.date_window(start, end, F.lit("2001-12-31"))
    chosen = derive.read(spark, sf, "orders").select(
        "o_orderkey", first.cast("date").alias("start"), last.cast("date").alias("end")
    )
    return chosen.withColumn("end_excl", fx.exclusive_end("end"))


# -- backfill -----------------------------------------------------------------------------------


@query
def backfill_symbol_batches(spark, sf):
    return backfill.symbol_batches(_symbol_requests(spark, sf), 5)


@query
def backfill_windows(spark, sf):
    """Windows of one and two years from every day on which something was ordered."""
    orders = derive.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("start")).distinct()
    end = day("2003-03-15")
    by_size = [
        orders.select("start", F.lit(n).alias("years"), F.explode(backfill.date_windows(F.col("start"), end, n)).alias("w"))
        for n in (1, 2)
    ]
    return by_size[0].unionByName(by_size[1]).select("start", "years", "w.*")


@query
def backfill_coverage(spark, sf):
    requests = _symbol_requests(spark, sf).withColumns(
        {"start": day("1996-02-29"), "end": day("2001-12-31")}
    )
    rows = derive.read(spark, sf, "orders").select(
        F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.to_date("o_orderdate").alias("ts"),
    )
    return backfill.backfill_coverage(requests, rows, batch_size=5, years=1)


# -- jobs ---------------------------------------------------------------------------------------


def _lake(spark, name: str) -> jobs.Lake:
    return jobs.Lake(work_folder(spark, name))


def _landed(spark, lake, rows, vendor, dataset, payload) -> DataFrame:
    # A price envelope holds a symbol's month; fewer of them make a file, which one task reads.
    records = landing.PRICE_FILE if dataset == "history" else bronze.FILE_RECORDS
    # Facts and identifiers name no day, and their narrow rows were dealt out.
    bronze.land_envelopes(rows, lake.bronze, records, dealt=dataset in ("companyfacts", "mapping"))
    return bronze.read_envelopes(spark, bronze.landed_path(lake.bronze, vendor, dataset), payload)


def _fetches(spark, sf) -> list[tuple[str, DataFrame]]:
    """Two fetches that overlap by three days."""
    bars = derive.bars(spark, sf)
    return [
        (OLD, serve.between(bars, None, "2024-01-17")),
        (NOW, serve.between(bars, "2024-01-15", None)),
    ]


def _loaded_prices(spark, fetches, scope: str = "history") -> jobs.Lake:
    """The fetches, loaded one after the other."""
    lake = _lake(spark, "prices")
    for at, fetched in fetches:
        landed = _landed(
            spark, lake, landing.prices(fetched, at), "yahoo", "history", schemas.PRICES_PAYLOAD
        )
        moment = jobs.Moment.at(at)
        jobs.run_prices(spark, lake, bronze.locate(landed, None, dt=at[:10]), moment, scope=scope)
    return lake


def _gold(spark, lake, spec) -> DataFrame:
    table = tables.read_table(spark, lake.gold, spec).select(*spec.schema.names)
    return with_text_time(table, spec.touched)


@query
def job_prices(spark, sf):
    return _gold(spark, _loaded_prices(spark, _fetches(spark, sf)), upsert.PRICES)


@query
def job_prices_late(spark, sf):
    """The later fetch is loaded first: stored rows that follow the late ones get their return anew."""
    fetches = [(at, rows) for at, (_, rows) in zip((OLD, NOW), reversed(_fetches(spark, sf)))]
    return _gold(spark, _loaded_prices(spark, fetches), upsert.PRICES).drop("ingested_at")


@query
def job_prices_batch_scope(spark, sf):
    return _gold(spark, _loaded_prices(spark, _fetches(spark, sf), "batch"), upsert.PRICES)


@query
def job_prices_marks(spark, sf):
    lake = _loaded_prices(spark, [(NOW, derive.bars(spark, sf))])
    return _gold(spark, lake, upsert.WATERMARKS)


@query
def job_prices_ledger(spark, sf):
    lake = _loaded_prices(spark, [(NOW, derive.bars(spark, sf))])
    state = lake.ledger(spark).state()
    return with_text_time(state.drop("run_id", "notes"), "started_at", "finished_at")


def _faulty_prices(spark, sf) -> jobs.Lake:
    lake = _lake(spark, "faulty")
    rows = landing.faulty_prices(derive.bars(spark, sf), NOW)
    landed = _landed(spark, lake, rows, "yahoo", "history", schemas.PRICES_PAYLOAD)
    jobs.run_prices(spark, lake, landed, jobs.Moment.at(NOW))
    return lake


@query
def job_prices_faulty(spark, sf):
    """Faulty envelopes among all others: the rest is loaded, quoted numbers too."""
    return _gold(spark, _faulty_prices(spark, sf), upsert.PRICES)


@query
def job_prices_rejects(spark, sf):
    """What the faulty envelopes leave in the rejects, by name."""
    rejects = _faulty_prices(spark, sf).rejects(spark)
    return rejects.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


def _macro_landing(spark, sf) -> DataFrame:
    """Three known series, one unknown, and one known whose days are malformed."""
    series = F.col("series")
    code = (
        F.when(series == "1-urgent", "cpi")
        .when(series == "2-high", "usd/cad")
        .when(series == "3-medium", "interest_rate_10y")
        .when(series == "5-low", "usd/jpy")
        .otherwise(series)
    )
    date = F.when(series == "5-low", F.concat(F.left("date", F.lit(5)), F.lit("13-05"))).otherwise(F.col("date"))
    return landing.macro(derive.macro(spark, sf).withColumns({"series": code, "date": date}))


def _macro_loaded(spark, sf) -> jobs.Lake:
    lake = _lake(spark, "macro")
    landed = _landed(spark, lake, _macro_landing(spark, sf), "fred", "macros", schemas.MACRO_PAYLOAD)
    jobs.run_macro(spark, lake, landed, jobs.Moment.at(NOW))
    return lake


@query
def job_macro(spark, sf):
    return _gold(spark, _macro_loaded(spark, sf), upsert.MACRO)


@query
def job_macro_rejects(spark, sf):
    rejects = _macro_loaded(spark, sf).rejects(spark)
    return rejects.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


@query
def job_fundamentals(spark, sf):
    lake = _lake(spark, "facts")
    rows = landing.facts(derive.facts(spark, sf, derive.FACT_ROW))
    landed = _landed(spark, lake, rows, "sec_edgar", "companyfacts", schemas.FACTS_PAYLOAD)
    jobs.run_fundamentals(spark, lake, landed, jobs.Moment.at(NOW))
    return _gold(spark, lake, upsert.FACTS)


def _register_suppliers(spark, sf, lake) -> None:
    """Only suppliers with no debt are registered."""
    candidates = derive.read(spark, sf, "supplier").where("s_acctbal >= 0").select(
        F.format_string("S%d", "s_suppkey").alias("ticker"), F.col("s_suppkey").alias("position")
    )
    known = tables.read_table(spark, lake.gold, registry.INSTRUMENTS)
    fresh = registry.new_instruments(known, candidates, now())
    tables.load(spark, lake.gold, fresh, registry.INSTRUMENTS, now())


@query
def job_figi(spark, sf):
    """Only suppliers whose ticker was registered first are mapped."""
    lake = _lake(spark, "figi")
    _register_suppliers(spark, sf, lake)
    rows = landing.figi(derive.figi(spark, sf, derive.FIGI_ROW))
    landed = _landed(spark, lake, rows, "openfigi", "mapping", schemas.FIGI_PAYLOAD)
    jobs.run_figi(spark, lake, landed, jobs.Moment.at(NOW))
    return _gold(spark, lake, upsert.FIGI)


def _price_landing(spark, sf, lake) -> DataFrame:
    rows = landing.prices(derive.bars(spark, sf), NOW)
    return _landed(spark, lake, rows, "yahoo", "history", schemas.PRICES_PAYLOAD)


@query
def job_register(spark, sf):
    """Register the tickers with complete info, then load their prices."""
    lake = _lake(spark, "register")
    info = _landed(spark, lake, landing.info(spark, sf), "yahoo", "info", schemas.INFO_PAYLOAD)
    done = jobs.run_register(
        spark, lake, info, jobs.Moment.at(NOW), prices=_price_landing(spark, sf, lake), backfill_start="2024-01-03"
    )
    loaded = tables.read_table(spark, lake.gold, upsert.PRICES).groupBy(
        F.col("symbol").alias("ticker")
    ).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"))
    return done.instruments.drop("id").join(loaded, "ticker", "left")


@query
def job_backfill(spark, sf):
    """Every chunk of five symbols and a window, among them some with faulty symbols and some that the
    gate stops."""
    lake = _lake(spark, "backfill")
    requests = _symbol_requests(spark, sf).withColumns(
        {"start": day("2023-01-10"), "end": day("2024-01-31")}
    )
    rows = landing.faulty_prices(derive.bars(spark, sf), NOW, negative=True)
    landed = _landed(spark, lake, rows, "yahoo", "history", schemas.PRICES_PAYLOAD)
    done = jobs.run_backfill(spark, lake, landed, requests, jobs.Moment.at(NOW))
    return done.chunks.drop("run_id", "notes")


@query
def job_backfill_resumed(spark, sf):
    """A backfill that ends after two of four waves, and its repetition: what was loaded in the first
    run is left alone, what the gate stopped is tried again."""
    lake = _lake(spark, "resumed")
    requests = _symbol_requests(spark, sf).withColumns(
        {"start": day("2023-01-10"), "end": day("2024-01-31")}
    )
    rows = landing.faulty_prices(derive.bars(spark, sf), NOW, negative=True)
    landed = _landed(spark, lake, rows, "yahoo", "history", schemas.PRICES_PAYLOAD)
    first = jobs.run_backfill(spark, lake, landed, requests, jobs.Moment.at(OLD), waves=4, at_most=2)
    second = jobs.run_backfill(spark, lake, landed, requests, jobs.Moment.at(NOW), waves=4)
    chunk = ["batch_no", "window_start"]
    closed = first.chunks.where("status <> 'failed'").select(*chunk, F.lit(True).alias("_closed"))
    runs = lake.ledger(spark).state().select("run_id", "finished_at")
    return (
        second.chunks.join(closed, chunk, "left")
        .join(runs, "run_id")
        .select(
            *(c for c in second.chunks.columns if c not in ("run_id", "notes")),
            F.when(F.col("_closed"), 1).otherwise(2).alias("run"),
            derive.as_text("finished_at"),
        )
    )


def _streamed(spark, lake, rows, vendor, dataset, payload, job, spec) -> DataFrame:
    """Rows landed and delivered by a file stream, and its first batch delivered once more; with the
    number of runs that makes."""
    landed = _landed(spark, lake, rows, vendor, dataset, payload)
    path, progress, moment = bronze.landed_path(lake.bronze, vendor, dataset), f"{lake.root}/progress", jobs.Moment.at(NOW)
    load_new_files(spark, lake, path, payload, job, moment, progress).awaitTermination()
    load_batch(lake, landed, 0, job, moment, progress)
    runs = lake.ledger(spark).state().count()
    return _gold(spark, lake, spec).withColumn("runs", F.lit(runs))


@query
def stream_macro(spark, sf):
    lake = _lake(spark, "stream-macro")
    return _streamed(
        spark, lake, _macro_landing(spark, sf), "fred", "macros", schemas.MACRO_PAYLOAD, jobs.run_macro, upsert.MACRO
    )


@query
def stream_facts(spark, sf):
    lake = _lake(spark, "stream-facts")
    return _streamed(
        spark, lake, landing.facts(derive.facts(spark, sf, derive.FACT_ROW)), "sec_edgar", "companyfacts", schemas.FACTS_PAYLOAD,
        jobs.run_fundamentals, upsert.FACTS,
    )


@query
def stream_figi(spark, sf):
    lake = _lake(spark, "stream-figi")
    _register_suppliers(spark, sf, lake)
    return _streamed(
        spark, lake, landing.figi(derive.figi(spark, sf, derive.FIGI_ROW)), "openfigi", "mapping", schemas.FIGI_PAYLOAD,
        jobs.run_figi, upsert.FIGI,
    )


@query
def stream_prices(spark, sf):
    """The two fetches delivered by a file stream: one run each, and none when nothing is new."""
    lake = _lake(spark, "stream")
    path = bronze.landed_path(lake.bronze, "yahoo", "history")
    for at, fetched in [*_fetches(spark, sf), (NOW, None)]:
        if fetched is not None:
            bronze.land_envelopes(landing.prices(fetched, at), lake.bronze, landing.PRICE_FILE)
        load_new_files(
            spark, lake, path, schemas.PRICES_PAYLOAD, jobs.run_prices, jobs.Moment.at(at),
            f"{lake.root}/progress",
        ).awaitTermination()
    return _gold(spark, lake, upsert.PRICES)
