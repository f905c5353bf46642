"""The batch jobs: landed envelopes to Silver, through the gate, to Gold, with marks and ledger.

Each job takes the envelopes of all keys at once. The stages meet in written tables: envelopes are
parsed once, Silver is written once and read back for the features, the load and the marks, and nothing
depends on a cached partition surviving. The counts a job decides by, the gate's among them, are
observed in those writes, so none of them costs a scan of its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tidemark import schemas
from tidemark.functions.columns import cut_text, run_status
from tidemark.operators import clean, normalize, upsert, watermark
from tidemark.operators.backfill import date_windows, symbol_batches, window_of
from tidemark.operators.dedup import keep_first, keep_last
from tidemark.operators.ledger import RunLedger, finish_events, start_events
from tidemark.operators.quality import MAX_NULL_CLOSE_RATIO, gate_counts, passed, quality_metrics, verdict
from tidemark.operators.registry import (
    INSTRUMENTS,
    missing_symbols,
    new_instruments,
    registered,
    unregistered,
)
from tidemark.operators.returns import add_return, returns_around
from tidemark.operators.selection import clean_symbols, require_any
from tidemark.operators.serve import INSTRUMENT_COLUMNS
from tidemark.plans import vendors
from tidemark.session import RELEASED, settings
from tidemark.sources import files
from tidemark.sources.bronze import CORRUPT, envelope_run_id
from tidemark.sources.tables import (
    appended,
    begun,
    directory,
    forget,
    load,
    read_silver,
    read_table,
    replace_touched,
    tasks_by_key,
    write_silver,
    write_silver_by_key,
)

CHUNKED_PRICES = T.StructType(
    [
        *schemas.SILVER_PRICES.fields,
        T.StructField("batch_no", T.LongType()),
        T.StructField("window_start", T.DateType()),
    ]
)

CHUNKS = schemas.ddl(
    """plan_id string, run_id string, batch_no bigint, window_start date, status string,
       items_total int, items_success int, items_failed int, rows bigint, notes string, at timestamp"""
)


@dataclass(frozen=True)
class Lake:
    """Folders of one installation."""

    root: str

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze"

    @property
    def silver(self) -> str:
        return f"{self.root}/silver"

    @property
    def gold(self) -> str:
        return f"{self.root}/gold"

    def ledger(self, spark: SparkSession) -> RunLedger:
        return RunLedger(spark, f"{self.gold}/ingestion_runs")

    @property
    def rejects_path(self) -> str:
        return f"{self.gold}/ingestion_rejects"

    @property
    def chunks_path(self) -> str:
        return f"{self.gold}/backfill_chunks"

    def rejects(self, spark: SparkSession) -> DataFrame:
        """What runs could not load, by name: run_id, dataset, kind, key, detail, bronze_run_id."""
        return appended(spark, self.rejects_path, schemas.REJECTS)

    def work(self, name: str) -> str:
        """A fresh folder for what one run writes for itself; the run removes it."""
        return f"{self.root}/work/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Moment:
    """When a run happens: its day, and the time written into audit columns."""

    run_date: str
    now: Column

    @staticmethod
    def at(timestamp: str) -> "Moment":
        return Moment(timestamp[:10], F.lit(timestamp).cast("timestamp"))


def run_prices(
    spark: SparkSession,
    lake: Lake,
    envelopes: DataFrame,
    moment: Moment,
    *,
    requested: DataFrame | None = None,
    scope: str = "history",
    max_null_close_ratio: float = MAX_NULL_CLOSE_RATIO,
    run_id: str | None = None,
) -> int:
    """Load daily prices. Returns the number of batch rows.

    ``scope`` says what the first row of a symbol in the batch is compared with: "history" takes
    the stored row before it, and stored rows that now follow a batch row get their return anew;
    "batch" leaves its return null and stored rows alone. ``requested`` names the symbols that
    were asked for; those without rows count as failed. Without it the envelopes say what was.
    A run that is repeated under the same ``run_id`` replaces what the one before left.

    The envelopes are read once. One that cannot be read, a symbol with a price that is no number or
    a malformed day, and a symbol without rows are listed in the rejects and count as failed; the
    other symbols are loaded. If no envelope can be read, the run fails.
    """
    if scope not in ("history", "batch"):
        raise ValueError(f"unknown scope {scope!r}")
    ledger = lake.ledger(spark)
    run_id = ledger.start("prices_1d", moment.run_date, moment.now, run_id)
    work, total = lake.work("prices"), 0
    try:
        if requested is not None:
            requested = require_any(clean_symbols(requested.select("symbol")))
        items, seen = _counted(
            normalize.price_items(envelopes), f"{work}/items", lost=F.count_if(F.col("kind") == "unreadable")
        )
        silver, gate, _ = _to_silver(
            spark, lake, clean.clean_prices(_good_rows(items)), moment, "yahoo", "prices_1d",
            schemas.SILVER_PRICES, clean.PRICES_KEY, run_id, **gate_counts(), **_days(),
        )
        known, counts = _counted(
            _symbols(items, requested, silver), f"{work}/symbols",
            total=F.count(F.lit(1)), failed=F.count_if("failed"),
        )
        lost = seen["lost"]
        total, failed = counts["total"] + lost, counts["failed"] + lost
        if failed:
            _reject(lake, run_id, "prices_1d", _price_rejects(items, known), "items")
        if lost and not counts["total"]:
            raise ValueError(f"none of {lost} envelopes could be read")
        if not gate["row_count"]:
            note = "no rows after cleaning" + (f"; {_listed(failed, total)}" if failed else "")
            _finish(ledger, run_id, moment, "partial" if lost else "success", total, failed, note)
            return 0
        passed(gate, max_null_close_ratio)
        _load_prices(spark, lake, silver, moment, scope, gate["first"], gate["final"])
        note = _listed(failed, total) if failed else None
        _finish(ledger, run_id, moment, "partial" if failed else "success", total, failed, note)
        return gate["row_count"]
    except Exception as e:
        _finish(ledger, run_id, moment, "failed", total, total, cut_text(str(e)))
        raise
    finally:
        files.remove(spark, work)


def _days() -> dict[str, Column]:
    return {"first": F.min("ts"), "final": F.max("ts")}


def _load_prices(
    spark: SparkSession, lake: Lake, silver: DataFrame, moment: Moment, scope: str, first, final
) -> None:
    """Load gated rows, whose days lie between ``first`` and ``final``, with their returns."""
    batch = silver.select(*schemas.SILVER_PRICES.names)
    if scope == "history":
        table = read_table(spark, lake.gold, upsert.PRICES)
        stored = stored_near(table, batch, first)
        work = lake.work("returns")
        try:
            # The rows that follow the batch are among the stored ones that the load replaces.
            spec = begun(spark, lake.gold, upsert.PRICES)
            priced, seen = _counted(
                returns_around(batch, stored, first, final), f"{work}/priced",
                touched=F.collect_set(directory(spec)), n_rows=F.count(F.lit(1)),
            )
            replace_touched(spark, lake.gold, priced, spec, moment.now, seen["touched"], seen["n_rows"])
        finally:
            files.remove(spark, work)
    else:
        load(spark, lake.gold, add_return(batch, "close"), upsert.PRICES, moment.now, unique=batch)
    _advance(spark, lake, silver, "symbol", "ts", watermark.PRICES_MARK, moment)


def stored_near(table: DataFrame, batch: DataFrame, first=None) -> DataFrame:
    """The stored prices that can hold the row before a batch row, and all from its ``first`` day on,
    without reading all months.

    Nearly every symbol has a row in the batch's first month or the one before. Older months are
    read only for the symbols that have none there. Where those are few Spark broadcasts them by its
    own size check; their names never pass through the driver.
    """
    if first is None:
        first = batch.agg(F.min("ts")).first()[0]
    since = 100 * first.year + first.month - (89 if first.month == 1 else 1)
    recent = table.where(F.col("month") >= since)
    older = table.where(F.col("month") < since)
    if older.isEmpty():
        return recent
    found = recent.where(F.col("ts") < F.lit(first)).select("symbol").distinct()
    open_symbols = batch.select("symbol").distinct().join(found, "symbol", "left_anti")
    return recent.unionByName(older.join(open_symbols, "symbol", "left_semi"))


def run_macro(
    spark: SparkSession, lake: Lake, envelopes: DataFrame, moment: Moment, *, run_id: str | None = None
) -> int:
    """Load macro observations of all series in the batch. There is no gate."""
    return run_vendor(spark, lake, envelopes, moment, vendors.MACRO, run_id=run_id)


def run_fundamentals(
    spark: SparkSession, lake: Lake, envelopes: DataFrame, moment: Moment, *, run_id: str | None = None
) -> int:
    """Load reported facts of all tickers in the batch. There is no gate."""
    return run_vendor(spark, lake, envelopes, moment, vendors.FACTS, run_id=run_id)


def run_figi(
    spark: SparkSession, lake: Lake, envelopes: DataFrame, moment: Moment, *, run_id: str | None = None
) -> int:
    """Load identifier candidates of registered tickers; other tickers count as failed. There is no
    high-water mark."""
    return run_vendor(spark, lake, envelopes, moment, vendors.FIGI, run_id=run_id)


def run_vendor(
    spark: SparkSession,
    lake: Lake,
    envelopes: DataFrame,
    moment: Moment,
    vendor: vendors.Vendor,
    *,
    run_id: str | None = None,
) -> int:
    """Load one vendor's envelopes as its description says. Returns the number of batch rows.

    Envelopes that cannot be read or lack their key, keys the vendor does not know, keys with a value
    that does not cast or a malformed day, and keys that are not registered are listed in the rejects
    and count as failed; the others are loaded. If no envelope can be read, the run fails. The text of
    the envelopes is parsed once, into the flat rows that the keys are taken from too.

    A batch too large for a task is shuffled once, by the key: cleaned, written to Silver and loaded in the
    tasks that makes. The flat rows are removed once Silver is written.
    """
    ledger = lake.ledger(spark)
    run_id = ledger.start(vendor.run_name, moment.run_date, moment.now, run_id)
    work, total, table = lake.work(vendor.run_name), 0, None
    try:
        rows = vendor.normalize(envelopes.withColumns(_state(envelopes, vendor)), whole=True)
        wrong = vendor.wrong(rows) if vendor.wrong else F.lit(None).cast("string")
        keyless, unreadable = F.col("key").isNull(), F.col("kind") == "unreadable"
        # What other columns say is not written: the key is the vendor's own, the run its envelope's.
        lean = rows.withColumn("wrong", F.when(F.col("good"), wrong)).drop("bronze_run_id")
        watched, observation = _observed(
            lean, metrics := dict(
                keyless=F.count_if(keyless),
                lost=F.count_if(unreadable),
                wrong=F.count_if(F.col("wrong").isNotNull()),
                good=F.count_if("good"),
                days=F.approx_count_distinct("dt"),
            ),
        )
        items = _kept(watched.drop("key"), f"{work}/items").withColumns(
            {"key": F.col(vendor.key), "bronze_run_id": F.col("ord._env.run")}
        )
        seen = _seen(observation, items, metrics)
        faulty = F.col("kind").isNotNull()
        counted = (
            items.where(~keyless).select("key", "kind").distinct()
            .agg(F.count(F.lit(1)).alias("keys"), F.count_if(faulty).alias("unknown")).first()
        )
        total = counted["keys"] + seen["keyless"]
        failed = seen["keyless"] + counted["unknown"]
        if failed:
            refused = items.where(faulty).groupBy("kind", "key", "detail")
            _reject(
                lake, run_id, vendor.run_name,
                refused.agg(F.max("bronze_run_id").alias("bronze_run_id")), "envelopes",
            )
        if seen["lost"] and seen["lost"] == total:
            raise ValueError(f"none of {total} envelopes could be read")
        rows = items.where("good").drop("wrong", "good", "alone", *normalize.STATE)
        if seen["wrong"]:
            judged = items.where("wrong is not null")
            keys, refused = _counted(
                judged.select(vendor.key).distinct(), f"{work}/refused", keys=F.count(F.lit(1))
            )
            rows = rows.join(keys, vendor.key, "left_anti")
            failed += refused["keys"]
            _reject(
                lake, run_id, vendor.run_name,
                judged.select(F.lit("bad_value").alias("kind"), F.col(vendor.key).alias("key"),
                              F.col("wrong").alias("detail"), "bronze_run_id"),
                "values",
            )
        sort, spec = vendor.table.sort or vendor.table.key, begun(spark, lake.gold, vendor.table)
        tasks = tasks_by_key(spark, lake.gold, spec, seen["good"], seen["days"])
        with settings(spark, _narrow_reads(spark, f"{work}/items", seen["good"])):
            silver, written, table = _to_silver(
                spark, lake, vendor.clean(rows), moment, vendor.source, vendor.silver_name, vendor.silver, sort,
                run_id, spec.key, tasks, n_rows=F.count(F.lit(1)), touched=F.collect_set(directory(spec)),
            )
        files.remove(spark, f"{work}/items")
        note = _listed(failed, total) if failed else None
        if not written["n_rows"]:
            note = "no rows returned" + (f"; {note}" if note else "")
            _finish(ledger, run_id, moment, "partial" if failed else "success", total, failed, note)
            return 0
        batch = (spark.table(table) if table else silver).select(*vendor.silver.names)
        if vendor.needs_registration:
            known = read_table(spark, lake.gold, INSTRUMENTS)
            none = F.lit(None).cast("string")
            strangers, refused = _counted(
                unregistered(batch.select("ticker").distinct(), known).select(
                    F.lit("unregistered").alias("kind"), F.col("ticker").alias("key"),
                    none.alias("detail"), none.alias("bronze_run_id"),
                ),
                f"{work}/strangers", keys=F.count(F.lit(1)),
            )
            if refused["keys"]:
                failed += refused["keys"]
                _reject(lake, run_id, vendor.run_name, strangers, "strangers")
                note = _listed(failed, total)
            batch = registered(batch, known)
            count = load(spark, lake.gold, batch, spec, moment.now, unique=batch)
        else:
            # Cleaned rows are one of a key, so what was observed of them is all a load has to know.
            count = written["n_rows"]
            replace_touched(spark, lake.gold, batch, spec, moment.now, written["touched"], count, tasks)
        if vendor.mark:
            _advance(spark, lake, silver, vendor.key, vendor.time, vendor.mark, moment)
        _finish(ledger, run_id, moment, "partial" if failed else "success", total, failed, note)
        return count
    except Exception as e:
        _finish(ledger, run_id, moment, "failed", total, total, cut_text(str(e)))
        raise
    finally:
        files.remove(spark, work)
        if table:
            forget(spark, table)


def _state(envelopes: DataFrame, vendor: vendors.Vendor) -> dict[str, Column]:
    """What is known of an envelope as it is: how it fails (null where all is well), its key, and detail."""
    key = normalize.partition_key(vendor.partition)
    path = F.col("file_path") if "file_path" in envelopes.columns else F.lit("")
    text = F.col(CORRUPT) if CORRUPT in envelopes.columns else F.lit(None).cast("string")
    lost = F.col("meta").isNull()
    unknown = vendor.unknown(key) if vendor.unknown else F.lit(None).cast("string")
    kind = (
        F.when(lost, F.lit("unreadable"))
        .when(key.isNull(), F.lit("missing_key"))
        .when(unknown.isNotNull(), F.lit("unknown_key"))
    )
    detail = F.when(lost, F.coalesce(text, path)).when(key.isNull(), path).otherwise(unknown)
    return {"kind": kind, "key": key, "detail": detail}


@dataclass(frozen=True)
class Registration:
    """What registering did: the candidates' registry rows, the rejects, and price rows loaded."""

    instruments: DataFrame
    rejects: DataFrame
    backfill_rows: int


def run_register(
    spark: SparkSession,
    lake: Lake,
    info: DataFrame,
    moment: Moment,
    *,
    is_scheduled: bool = True,
    prices: DataFrame | None = None,
    backfill_start: str = schemas.DEFAULT_BACKFILL_START,
    backfill_end: str | None = None,
) -> Registration:
    """Register the tickers that info envelopes vouch for, then load their price envelopes.

    A ticker that is registered already is left as it is, its flags too.
    """
    ledger = lake.ledger(spark)
    run_id = ledger.start("register_ticker", moment.run_date, moment.now)
    total, work = 0, lake.work("info")
    try:
        # Judged once; the written table serves the counts, the registry and the backfill.
        judged, counts = _counted(
            normalize.judge_info(info), f"{work}/judged", refused=F.count_if(F.col("reason").isNotNull())
        )
        rejects = judged.where("reason is not null").select("ticker", "reason", "bronze_run_id")
        first = keep_first(judged.where("reason is null").drop("reason"), ["ticker"], ["ord"])
        # Ids may follow any order that repeats.
        candidates, seen = _counted(
            first.withColumns({"position": F.xxhash64("ticker"), "is_scheduled": F.lit(is_scheduled)}),
            f"{work}/candidates", accepted=F.count(F.lit(1)),
        )
        accepted, refused = seen["accepted"], counts["refused"]
        total = accepted + refused
        known = read_table(spark, lake.gold, INSTRUMENTS)
        fresh = new_instruments(known, candidates, moment.now)
        load(spark, lake.gold, fresh, INSTRUMENTS, moment.now)

        rows = 0
        if prices is not None and accepted:
            requests = candidates.select(
                F.col("ticker").alias("symbol"),
                "position",
                F.lit(backfill_start).cast("date").alias("start"),
                F.lit(backfill_end or moment.run_date).cast("date").alias("end"),
            )
            rows = run_backfill(spark, lake, prices, requests, moment).rows
        status = "success" if not refused else "partial" if accepted else "failed"
        note = _listed(refused, total) if refused else None
        if refused:
            _reject(
                lake, run_id, "register_ticker",
                rejects.select(F.lit("bad_info").alias("kind"), F.col("ticker").alias("key"),
                               F.col("reason").alias("detail"), "bronze_run_id"),
                "info",
            )
        _finish(ledger, run_id, moment, status, total, refused, note)
        # Of this run's candidates, fresh or known before, the registry's rows; the rejects by its id.
        named = f"{lake.silver}/registered/{run_id}"
        candidates.select("ticker").write.mode("overwrite").parquet(named)
        stored = registered(read_table(spark, lake.gold, INSTRUMENTS), spark.read.parquet(named))
        listed = lake.rejects(spark).where(F.col("run_id") == run_id)
        listed = listed.select(F.col("key").alias("ticker"), F.col("detail").alias("reason"), "bronze_run_id")
        return Registration(stored.select(*INSTRUMENT_COLUMNS), listed, rows)
    except Exception as e:
        _finish(ledger, run_id, moment, "failed", total, total, cut_text(str(e)))
        raise
    finally:
        files.remove(spark, work)


@dataclass(frozen=True)
class Backfill:
    """Rows loaded now, and one row per chunk that was tried, in this run or an earlier one of the plan:
    its batch, window, last status, counts, rows and note."""

    rows: int
    chunks: DataFrame


def run_backfill(
    spark: SparkSession,
    lake: Lake,
    envelopes: DataFrame,
    requests: DataFrame,
    moment: Moment,
    *,
    batch_size: int = 5,
    years: int = 1,
    scope: str = "history",
    max_null_close_ratio: float = MAX_NULL_CLOSE_RATIO,
    waves: int = 1,
    at_most: int | None = None,
) -> Backfill:
    """Load the history asked for by (symbol, position, start, end).

    Symbols go in batches and days in windows. Every (batch, window) chunk is started in the ledger
    before anything is read, passes or fails the gate by itself, and is finished whatever happens;
    all chunks of a wave are judged and loaded in one job. A symbol with a value that does not cast or a
    malformed day is rejected and missing from its chunks, the others go on.

    The plan's id follows from the request, so the same request goes on where it was left: chunks that
    were loaded are left alone, failed ones and those never started are open. ``waves`` deals the
    batches, in their order, to loads one after the other, each finished in the ledger before the next
    begins; ``at_most`` ends the run after so many of them. Nothing is read if no chunk is open, and
    rows of closed chunks go no further than the parsing.
    """
    ledger = lake.ledger(spark)
    chunk, work = ["batch_no", "window_start"], lake.work("backfill")
    asked = keep_first(clean_symbols(requests), ["symbol"], ["position"])
    require_any(asked)
    windows = date_windows(F.col("start"), F.col("end"), years)
    request = F.xxhash64("symbol", "batch_no", "start", "end").cast("decimal(38,0)")
    batched, counts = _counted(
        symbol_batches(asked, batch_size).select("symbol", "batch_no", "start", "end", windows.alias("windows")),
        f"{work}/batches", symbols=F.count(F.lit(1)), request=F.sum(request), last=F.max("batch_no"),
    )
    plan_id = uuid.uuid5(
        uuid.NAMESPACE_OID, f"{counts['symbols']} {counts['request']} {batch_size} {years}"
    ).hex
    batched, loaded = batched.drop("start", "end"), 0
    size = -(-(counts["last"] + 1) // waves)
    try:
        done = _tried(spark, lake, plan_id).where("status <> 'failed'")
        planned, open_ = _counted(
            _planned(batched, plan_id, moment).join(done.select(*chunk), chunk, "left_anti"),
            f"{work}/planned", chunks=F.count(F.lit(1)),
        )
        numbers = planned.select(F.floor(F.col("batch_no") / size).alias("wave")).distinct()
        found = sorted(r.wave for r in numbers.collect()) if open_["chunks"] else []  # waves at most
        items = None
        for wave in found[:at_most]:
            of_wave = F.floor(F.col("batch_no") / size) == wave
            now_planned = planned.where(of_wave)
            ledger.append(start_events(now_planned, moment.now))
            try:
                if items is None:
                    items, seen = _counted(
                        normalize.price_items(envelopes), f"{work}/items",
                        faulty=F.count_if(F.col("kind").isin("bad_value", "unreadable")),
                    )
                    if seen["faulty"]:
                        faulty = items.where("kind in ('bad_value', 'unreadable')").select(
                            "kind", F.col("symbol").alias("key"), "detail", "bronze_run_id"
                        )
                        _reject(lake, plan_id, "prices_1d", faulty, "items")
                loaded += _load_wave(
                    spark, lake, items, batched.where(of_wave), now_planned, moment, f"{plan_id}-{wave}",
                    scope, max_null_close_ratio, f"{work}/{wave}", ledger,
                )
            except Exception as e:
                broken = now_planned.select(
                    "*",
                    F.lit("failed").alias("status"),
                    F.lit(0).alias("items_success"),
                    F.col("items_total").alias("items_failed"),
                    F.lit(0).cast("bigint").alias("rows"),
                    F.lit(cut_text(str(e))).alias("notes"),
                )
                _finish_chunks(lake, ledger, broken, plan_id, moment)
                raise
    finally:
        files.remove(spark, work)
    return Backfill(loaded, _tried(spark, lake, plan_id).drop("plan_id", "at"))


def _tried(spark: SparkSession, lake: Lake, plan_id: str) -> DataFrame:
    """The last state of each chunk of a plan that was ever finished; one that was loaded stays so."""
    chunks = appended(spark, lake.chunks_path, CHUNKS).where(F.col("plan_id") == plan_id)
    ranked = chunks.withColumn("_loaded", F.col("status") != "failed")
    return keep_last(ranked, ["batch_no", "window_start"], ["_loaded", "at"]).drop("_loaded")


def _load_wave(
    spark, lake, items, batched, planned, moment, silver_id, scope, ratio, work, ledger
) -> int:
    """Judge and load the open chunks of one wave, and finish them. Returns the number of rows."""
    chunk = ["batch_no", "window_start"]
    chunked = (
        clean.clean_prices(_good_rows(items))
        .join(batched, "symbol")
        .withColumn("window_start", window_of(F.col("windows"), F.col("ts"))["window_start"])
        .where("window_start is not null")
        .drop("windows")
        .join(planned.select(*chunk), chunk, "left_semi")
    )
    # Silver keeps the chunk of each row, so requests and rows are joined once.
    silver, days, _ = _to_silver(
        spark, lake, chunked, moment, "yahoo", "prices_1d", CHUNKED_PRICES, clean.PRICES_KEY, silver_id, **_days()
    )
    broken = F.col("status") == "failed"
    outcomes, counts = _counted(
        _chunk_outcomes(planned, silver, ratio), f"{work}/outcomes",
        failed=F.count_if(broken), rows=F.coalesce(F.sum(F.when(~broken, F.col("rows"))), F.lit(0)),
    )
    if counts["rows"]:
        good = silver
        if counts["failed"]:
            good = silver.join(outcomes.where(broken).select(*chunk), chunk, "left_anti")
            days = good.agg(*(c.alias(n) for n, c in _days().items())).first()
        _load_prices(spark, lake, good, moment, scope, days["first"], days["final"])
    plan_id = silver_id.partition("-")[0]
    _finish_chunks(lake, ledger, outcomes, plan_id, moment)
    return counts["rows"]


def _finish_chunks(lake: Lake, ledger: RunLedger, outcomes: DataFrame, plan_id: str, moment: Moment) -> None:
    detailed = outcomes.withColumns({"plan_id": F.lit(plan_id), "at": moment.now})
    detailed.select(*(F.col(f.name).cast(f.dataType) for f in CHUNKS)).write.mode("append").parquet(
        lake.chunks_path
    )
    ledger.append(finish_events(outcomes, moment.now))


def _planned(batched: DataFrame, plan_id: str, moment: Moment) -> DataFrame:
    """One row per chunk of the plan, as it is started."""
    chunk = ["batch_no", "window_start"]
    plan = batched.select("batch_no", F.explode("windows.window_start").alias("window_start"))
    return plan.groupBy(*chunk).agg(F.count(F.lit(1)).cast("int").alias("items_total")).select(
        *chunk,
        F.md5(F.concat_ws("|", F.lit(plan_id), *chunk)).alias("run_id"),
        F.lit("prices_1d").alias("dataset"),
        F.lit(moment.run_date).alias("run_date"),
        "items_total",
    )


def _chunk_outcomes(planned: DataFrame, chunked: DataFrame, ratio: float) -> DataFrame:
    """One row per chunk of the plan: its symbols, those without rows, its status and its rows."""
    chunk = ["batch_no", "window_start"]
    metrics = quality_metrics(chunked, by=chunk).withColumn("broken", verdict(ratio))
    seen = chunked.groupBy(*chunk, "symbol").agg(F.lit(1).alias("one"))
    delivered = seen.groupBy(*chunk).agg(F.count("one").alias("delivered"))
    joined = planned.join(metrics, chunk, "left").join(delivered, chunk, "left")
    empty, broken = F.col("row_count").isNull(), F.col("broken").isNotNull()
    absent = F.col("items_total") - F.coalesce("delivered", F.lit(0))
    found = F.coalesce("row_count", F.lit(0))
    status = F.when(broken, F.lit("failed")).otherwise(run_status(found, absent))
    failed = F.when(broken, F.col("items_total")).otherwise(absent)
    return joined.select(
        *planned.columns,
        status.alias("status"),
        (F.col("items_total") - failed).cast("int").alias("items_success"),
        failed.cast("int").alias("items_failed"),
        F.when(broken, F.lit(0)).otherwise(found).cast("bigint").alias("rows"),
        F.coalesce(
            F.concat(F.lit("gate: "), F.col("broken")),
            F.when(empty, F.lit("no rows after cleaning")),
            F.when(absent > 0, F.concat(absent.cast("string"), F.lit(" symbols without rows"))),
        ).alias("notes"),
    )


def _good_rows(items: DataFrame) -> DataFrame:
    """The price rows of symbols without a faulty one."""
    faulty = items.where("kind = 'bad_value'").select("symbol").distinct()
    rows = items.where("kind = 'row'").drop("kind", "detail")
    return rows.join(faulty, "symbol", "left_anti")


def _symbols(items: DataFrame, requested: DataFrame | None, silver: DataFrame) -> DataFrame:
    """(symbol, failed, reason): every symbol that was asked for or named, and what it lacks."""
    none = F.lit(None).cast("string")
    named = items.where("symbol is not null and kind <> 'row'")
    said = named.where("kind = 'bad_value'") if requested is not None else named
    found = said.select(
        "symbol",
        (F.col("kind") != "asked").alias("failed"),
        F.when(F.col("kind") != "asked", F.col("kind")).alias("reason"),
        F.col("bronze_run_id").alias("run"),
    )
    if requested is not None:
        wanted = requested.select("symbol")
        found = found.unionByName(
            wanted.select("symbol", F.lit(False).alias("failed"), none.alias("reason"), none.alias("run"))
        ).unionByName(
            missing_symbols(wanted, silver).select(
                "symbol", F.lit(True).alias("failed"), F.lit("no_rows").alias("reason"), none.alias("run")
            )
        )
    return found.groupBy("symbol").agg(
        F.max("failed").alias("failed"), F.min("reason").alias("reason"), F.max("run").alias("bronze_run_id")
    )


def _price_rejects(items: DataFrame, known: DataFrame) -> DataFrame:
    """Every faulty row and unreadable envelope, and the symbols that had no rows."""
    faulty = items.where("kind in ('bad_value', 'unreadable')").select(
        "kind", F.col("symbol").alias("key"), "detail", "bronze_run_id"
    )
    silent = known.where("failed and reason = 'no_rows'").select(
        F.col("reason").alias("kind"), F.col("symbol").alias("key"),
        F.lit(None).cast("string").alias("detail"), "bronze_run_id",
    )
    return faulty.unionByName(silent)


def _reject(lake: Lake, run_id: str, dataset: str, rejects: DataFrame, step: str) -> None:
    """Add to the table of rejects, from the executors. A run's steps have folders of their own, so
    repeating the run replaces its rejects."""
    rows = rejects.select(
        F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset"), "kind", "key", "detail", "bronze_run_id"
    )
    rows.write.mode("overwrite").parquet(f"{lake.rejects_path}/{run_id}-{step}")


def _listed(failed: int, total: int) -> str:
    return f"{failed} of {total} items failed; the rejects of this run name them"


KEPT_ROWS = 500_000  # rows of a file of flat rows, and of a task that cleans them


def _kept(rows: DataFrame, path: str) -> DataFrame:
    """Rows written once, so that what follows does not read the envelopes again."""
    with settings(rows.sparkSession, RELEASED):
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", KEPT_ROWS).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _narrow_reads(spark: SparkSession, path: str, rows: int) -> dict[str, int]:
    """Settings by which a task reads ``KEPT_ROWS`` kept rows or about as many: they are small where they lie
    and several times wider where they are sorted, so tasks of the usual bytes would spill."""
    if rows <= KEPT_ROWS:
        return {}
    name, share = "spark.sql.files.maxPartitionBytes", files.size(spark, path) * KEPT_ROWS // rows
    usual = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    return {name: min(usual, max(share, 1))}


def _observed(rows: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return rows.observe(seen, *(m.alias(n) for n, m in metrics.items())), seen


def _seen(seen: Observation, written: DataFrame, metrics: dict[str, Column]) -> dict:
    """What was observed. Where Spark found at run time that there are no rows, it drops the observation
    with the rest of the plan; then the written table, which is empty, gives the same."""
    try:
        return seen.get
    except Py4JJavaError:
        return written.agg(*(m.alias(n) for n, m in metrics.items())).first().asDict()


def _counted(rows: DataFrame, path: str, /, **metrics: Column) -> tuple[DataFrame, dict]:
    """``_kept`` rows, and aggregates over them that were observed while they were written."""
    watched, seen = _observed(rows, metrics)
    kept = _kept(watched, path)
    return kept, _seen(seen, kept, metrics)


def _to_silver(
    spark, lake, rows, moment, vendor, dataset, schema, sort, run_id, key=None, tasks=None, **metrics: Column
) -> tuple[DataFrame, dict, str | None]:
    """Write cleaned rows as one Silver run and scan them back; ``metrics`` are observed on the way. Where
    ``tasks`` are given they are written by the ``key``, and the run's name in the catalog comes third."""
    dated = rows.withColumn("dt", F.coalesce("dt", F.lit(moment.run_date))).select(
        *schema.names, "bronze_run_id", "dt"
    )
    watched, seen = _observed(dated, metrics)
    table = None
    if tasks:
        table = write_silver_by_key(watched, lake.silver, vendor, dataset, run_id, sort, key, tasks)
    else:
        write_silver(watched, lake.silver, vendor, dataset, run_id, sort)
    silver = read_silver(spark, lake.silver, vendor, dataset, schema, run_id)
    return silver, _seen(seen, silver, metrics), table


def _advance(spark, lake, silver, key, time, mark, moment) -> None:
    work, spec = lake.work("marks"), begun(spark, lake.gold, upsert.WATERMARKS)
    try:
        marks, seen = _counted(
            watermark.advance(silver, key, time, mark), f"{work}/marks",
            touched=F.collect_set(directory(spec)), n_rows=F.count(F.lit(1)),
        )
        replace_touched(spark, lake.gold, marks, spec, moment.now, seen["touched"], seen["n_rows"])
    finally:
        files.remove(spark, work)


def _finish(ledger, run_id, moment, status, total, failed, notes=None) -> None:
    ledger.finish(
        run_id,
        status=status,
        items_total=total,
        items_success=total - failed,
        items_failed=failed,
        notes=notes,
        at=moment.now,
    )
