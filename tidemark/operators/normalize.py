"""Envelopes to flat rows, one normaliser per vendor.

Every normaliser adds three columns to the vendor's own: ``bronze_run_id``, ``dt`` (the batch start
named by the envelope) and ``ord``, the place of the row in the input: when the envelope was
fetched, which envelope it is, and the position inside it. Keep-last uses ``ord``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import display_name, lenient_date, parse_number
from tidemark.operators.selection import listed_codes
from tidemark.sources.bronze import CORRUPT, envelope_run_id

LINEAGE = ("bronze_run_id", "dt", "ord")


def partition_key(name: str) -> Column:
    """The key an envelope carries in ``meta.partitions``; null when missing or empty."""
    return F.nullif(F.col("meta.partitions")[name], F.lit(""))


def split_keyed(envelopes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Envelopes that carry ``key``, and the rejects with a reason."""
    present = partition_key(key).isNotNull()
    reason = F.when(F.col("meta").isNull(), F.lit("not a JSON envelope")).otherwise(
        F.lit(f"missing meta.partitions.{key}")
    )
    return envelopes.where(present), envelopes.where(~present).withColumn("reason", reason)


def require_keyed(envelopes: DataFrame, key: str) -> DataFrame:
    """Strict form: the query fails on the first envelope without ``key``."""
    message = F.lit(f"bronze envelope is missing meta.partitions.{key}")
    checked = F.when(partition_key(key).isNotNull(), True).otherwise(
        F.raise_error(message).cast("boolean")
    )
    return envelopes.where(checked)


def _head(envelopes: DataFrame, start: Column) -> DataFrame:
    """Add the lineage of the envelope; ``_env`` orders envelopes."""
    path = F.col("file_path") if "file_path" in envelopes.columns else F.lit("")
    run_id = envelope_run_id(path, F.col("meta"))
    # Hashes stand for the path and the request: they only part envelopes fetched in one instant,
    # and eight bytes travel through the shuffles instead of a long text.
    maps = ("meta.partitions", "meta.params")
    which = F.xxhash64(path, *(f(m) for m in maps for f in (F.map_keys, F.map_values)))
    fetched = F.col("meta.fetched_at").try_cast("timestamp")
    return envelopes.withColumns(
        {
            "bronze_run_id": run_id,
            "dt": F.coalesce(start, F.col("meta.params")["start"], F.col("meta.dt")),
            "_env": F.struct(fetched.alias("at"), run_id.alias("run"), which.alias("which")),
        }
    )


def _ordinal(*positions: str) -> Column:
    return F.struct("_env", *positions).alias("ord")


#: What a job knows of an envelope before it is unfolded: how it fails (null: it does not), its key, and more.
STATE = ("kind", "key", "detail")


def _unfold(values: str, whole: bool) -> Column:
    return F.posexplode_outer(values) if whole else F.posexplode(values)


def _state(whole: bool) -> tuple[str, ...]:
    return STATE if whole else ()


def _complete(
    rows: DataFrame, complete: Callable[[Column], Column], values: str, value: str, whole: bool, *positions: str
) -> DataFrame:
    """The rows whose ``value``, one of ``values``, is complete.

    ``whole`` lets every envelope keep a row, so that one pass over the text serves rows and keys: ``good``
    marks the complete rows of envelopes that do not fail, ``alone`` the only row that stands for an
    envelope that fails, and the one for any whose first ``values`` have nothing complete.
    """
    if not whole:
        return rows.where(complete(F.col(value)))
    fails, alone = F.col("kind").isNotNull(), F.lit(True)
    for p in positions:
        alone = alone & (F.coalesce(p, F.lit(0)) == 0)
    some = F.coalesce(F.exists(values, lambda v: F.coalesce(complete(v), F.lit(False))), F.lit(False))
    marks = {
        "good": ~fails & F.coalesce(complete(F.col(value)), F.lit(False)),
        "alone": F.when(alone, fails | ~some).otherwise(False),
    }
    return rows.withColumns(marks).where("good or alone")


def _marks(whole: bool) -> tuple[str, ...]:
    return (*STATE, "good", "alone") if whole else ()


PRICE_FIELDS = ("open", "high", "low", "close", "volume")


def normalize_prices(envelopes: DataFrame) -> DataFrame:
    """Daily price rows. The day is the first ten characters of ``ts``: an offset in the text must
    not move it. Rows without ts or symbol are left out; a price that is no number raises."""
    rows = _head(envelopes, F.col("payload.start")).select(
        "bronze_run_id", "dt", "_env", F.posexplode("payload.rows").alias("pos", "r")
    )
    return rows.where("r.ts is not null and r.symbol is not null").select(
        "r.symbol",
        F.substring("r.ts", 1, 10).alias("ts"),
        *(F.col(f"r.{c}").cast("double").alias(c) for c in PRICE_FIELDS),
        "bronze_run_id",
        "dt",
        _ordinal("pos"),
    )


def price_items(envelopes: DataFrame) -> DataFrame:
    """All that price envelopes hold, in one pass: an item per row, symbol asked for, and failure.

    ``kind`` is ``row`` for a row that can be typed; ``bad_value`` for one with a price that is no
    number or a malformed day, with the texts in ``detail``; ``asked`` for a symbol the envelope was
    fetched for; ``no_rows`` for one the vendor returned nothing for; ``unreadable`` for an envelope
    that is no JSON or has no meta, with its text where the reader kept it. Rows without symbol or
    time are left out.
    """
    kinds = "kind string, symbol string, ts string, " + ", ".join(f"{c} double" for c in PRICE_FIELDS)
    item = f"array<struct<{kinds.replace(' string', ': string').replace(' double', ': double')}, detail: string, pos: int>>"
    blank = {c: F.lit(None).cast("double") for c in PRICE_FIELDS}

    def made(kind: Column | str, symbol: Column, ts: Column, numbers: dict, detail: Column, pos: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(
            kind.alias("kind"),
            symbol.alias("symbol"),
            ts.alias("ts"),
            *(numbers[c].alias(c) for c in PRICE_FIELDS),
            detail.alias("detail"),
            pos.cast("int").alias("pos"),
        )

    none, zero = F.lit(None).cast("string"), F.lit(0)

    def of_row(r: Column, pos: Column) -> Column:
        day = F.substring(r["ts"], 1, 10)
        numbers = {c: parse_number(r[c]) for c in PRICE_FIELDS}
        wrong = F.concat_ws(
            "; ",
            F.when(lenient_date(day).isNull(), F.concat(F.lit("ts "), r["ts"])),
            *(
                F.when(r[c].isNotNull() & numbers[c].isNull(), F.concat(F.lit(f"{c} "), r[c]))
                for c in PRICE_FIELDS
            ),
        )
        kind = F.when(wrong == "", F.lit("row")).otherwise(F.lit("bad_value"))
        return made(kind, r["symbol"], day, numbers, F.nullif(wrong, F.lit("")), pos)

    complete = F.filter(
        F.transform(F.col("payload.rows"), lambda r, i: F.struct(r.alias("r"), i.alias("i"))),
        lambda x: x["r"]["ts"].isNotNull() & x["r"]["symbol"].isNotNull(),
    )
    rows = F.transform(complete, lambda x: of_row(x["r"], x["i"]))
    errors = F.transform(
        F.col("payload.errors"), lambda e: made("no_rows", e["symbol"], none, blank, e["error"], zero)
    )
    listed = F.col("meta.params")["symbols"]
    asked = F.when(listed.isNotNull(), listed_codes(listed)).otherwise(
        F.coalesce(F.col("payload.rows.symbol"), F.array().cast("array<string>"))
    )
    asked = F.transform(asked, lambda s: made("asked", s, none, blank, none, zero))
    text = F.col(CORRUPT) if CORRUPT in envelopes.columns else none
    unreadable = F.when(
        F.col("meta").isNull(),
        F.array(made("unreadable", none, none, blank, F.coalesce(text, F.col("file_path")), zero)),
    )
    empty = F.array().cast(item)
    items = F.concat(*(F.coalesce(x.cast(item), empty) for x in (rows, errors, asked, unreadable)))
    return (
        _head(envelopes, F.col("payload.start"))
        .select("bronze_run_id", "dt", "_env", F.inline(items))
        .withColumn("ord", F.struct("_env", "pos"))
        .drop("_env", "pos")
    )


def failed_symbols(envelopes: DataFrame) -> DataFrame:
    """Symbols the vendor returned nothing for, with the run they belong to."""
    path = F.col("file_path") if "file_path" in envelopes.columns else F.lit("")
    run_id = envelope_run_id(path, F.col("meta")).alias("bronze_run_id")
    return envelopes.select(run_id, F.explode("payload.errors").alias("e")).select(
        "bronze_run_id", "e.symbol", "e.error"
    )


def normalize_macro(envelopes: DataFrame, whole: bool = False) -> DataFrame:
    """Observations of a series. Missing markers, blanks and texts that are no number are left
    out. ``whole``: see ``_complete``."""
    rows = _head(envelopes, F.lit(None)).select(
        partition_key("series").alias("series"),
        "bronze_run_id",
        "dt",
        "_env",
        *_state(whole),
        F.col("payload.observations").alias("observations"),
        _unfold("payload.observations", whole).alias("pos", "o"),
    )

    def complete(o: Column) -> Column:
        return (o["date"] != "") & parse_number(o["value"]).isNotNull()

    return _complete(rows, complete, "observations", "o", whole, "pos").select(
        "series",
        F.col("o.date").alias("ts"),
        parse_number("o.value").alias("value"),
        "bronze_run_id",
        "dt",
        _ordinal("pos"),
        *_marks(whole),
    )


def wrong_macro(rows: DataFrame) -> Column:
    """What is wrong with a normalised observation, or null."""
    return F.when(lenient_date("ts").isNull(), F.concat(F.lit("date "), "ts"))


def wrong_fact(rows: DataFrame) -> Column:
    """What is wrong with a normalised fact whose numbers are texts still, or null."""
    year = parse_number("fy")
    return F.nullif(
        F.concat_ws(
            "; ",
            F.when(lenient_date("period_end").isNull(), F.concat(F.lit("end "), "period_end")),
            F.when(parse_number("val").isNull(), F.concat(F.lit("val "), "val")),
            F.when(
                F.col("fy").isNotNull() & (year.isNull() | (year != F.floor(year))),
                F.concat(F.lit("fy "), "fy"),
            ),
        ),
        F.lit(""),
    )


def typed_facts(rows: DataFrame) -> DataFrame:
    """Facts with their numbers cast; a text that is no number raises."""
    return rows.withColumns(
        {"fy": F.col("fy").cast("double").cast("bigint"), "val": F.col("val").cast("double")}
    )


def normalize_facts(envelopes: DataFrame) -> DataFrame:
    """Reported facts; a value or year that is no number raises."""
    return typed_facts(untyped_facts(envelopes))


def untyped_facts(envelopes: DataFrame, whole: bool = False) -> DataFrame:
    """Reported facts: taxonomy, concept and unit maps unfolded down to single observations.

    Observations without a period end or a value are left out. Numbers are texts. ``whole``: see
    ``_complete``.
    """
    unfolded = (
        _head(envelopes, F.lit(None))
        .select(
            partition_key("symbol").alias("ticker"),
            "bronze_run_id",
            "dt",
            "_env",
            *_state(whole),
            _unfold("payload.facts", whole).alias("p0", "taxonomy", "concepts"),
        )
        .select("*", _unfold("concepts", whole).alias("p1", "name", "body"))
        .select("*", _unfold("body.units", whole).alias("p2", "unit", "observations"))
        .select("*", _unfold("observations", whole).alias("p3", "o"))
    )

    def complete(o: Column) -> Column:
        return (o["end"] != "") & o["val"].isNotNull()

    return _complete(unfolded, complete, "observations", "o", whole, "p0", "p1", "p2", "p3").select(
        "ticker",
        F.concat_ws(":", "taxonomy", "name").alias("concept"),
        "unit",
        F.col("o.start").alias("period_start"),
        F.col("o.end").alias("period_end"),
        "o.fy",
        "o.fp",
        "o.form",
        "o.val",
        "o.accn",
        "o.filed",
        "bronze_run_id",
        "dt",
        _ordinal("p0", "p1", "p2", "p3"),
        *_marks(whole),
    )


FACT_FIELDS = ("end", "start", "val", "accn", "fy", "fp", "form", "filed")


def _entries(value: Column, kind: str = "variant", at: str = "$") -> Column:
    """The (key, value) entries of a VARIANT object or array ``at`` a path, in which places are keys; none where it is
    neither. A value that does not cast to ``kind`` is null."""
    return F.coalesce(
        F.map_entries(F.try_variant_get(value, at, f"map<string, {kind}>")),
        F.transform(
            F.try_variant_get(value, at, f"array<{kind}>"),
            lambda v, i: F.struct(F.lpad(i.cast("string"), 9, "0").alias("key"), v.alias("value")),
        ),
        F.array().cast(f"array<struct<key: string, value: {kind}>>"),
    )


def _each(entries: Column, inner) -> Column:
    """The arrays that ``inner`` gives for the key and value of each entry, as one."""
    return F.flatten(F.transform(entries, lambda e: inner(e["key"], e["value"])))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _unfolded(rows: DataFrame, entries: Column, key: str, out: str) -> DataFrame:
    """A row for each entry."""
    return rows.select("*", F.inline(entries).alias(key, out))


def _whole(facts: Column) -> Column:
    """Whether facts cast to maps are of the usual shape down to each observation: what did not cast is null."""
    lists = lambda units: F.forall(
        F.map_values(units), lambda x: x.isNotNull() & F.forall(x, lambda o: o.isNotNull())
    )
    bodies = lambda t: F.forall(
        F.map_values(t), lambda b: F.coalesce(b["units"].isNotNull() & lists(b["units"]), F.lit(False))
    )
    every = F.forall(F.map_values(facts), lambda t: F.coalesce(t.isNotNull() & bodies(t), F.lit(False)))
    return F.coalesce(every, F.lit(False))


def _by_units(kind: str) -> str:
    """The type of facts of the usual shape, with observations of a type."""
    return f"map<string, map<string, struct<units: map<string, array<{kind}>>>>>"


def _company_facts(lines: DataFrame) -> DataFrame:
    """Envelope lines (column ``value``) down to single observations, as VARIANT."""
    v = F.col("_v")
    rows = lines.select(F.try_parse_json("value").alias("_v"))
    text = lambda path: F.try_variant_get(v, path, "string")
    rows = rows.select(
        "_v",
        F.nullif(text("$.meta.partitions.symbol"), F.lit("")).alias("ticker"),
        text("$.meta.run_id").alias("bronze_run_id"),
        F.coalesce(text("$.meta.params.start"), text("$.meta.dt")).alias("dt"),
        F.struct(
            text("$.meta.fetched_at").try_cast("timestamp").alias("at"),
            text("$.meta.run_id").alias("run"),
            F.xxhash64(F.to_json(F.try_variant_get(v, "$.meta.params", "map<string, string>"))).alias("which"),
        ).alias("_env"),
    )
    return rows


def variant_facts(lines: DataFrame) -> DataFrame:
    """Reported facts from envelope lines as ``untyped_facts`` gives them, with ``extra``: the fields of
    the observation that no schema names, as JSON (null if there are none).

    Envelopes are read as VARIANT, so what a vendor adds arrives, whatever its type. Entries of
    another shape than expected are left out.
    """
    rows = _unfolded(_company_facts(lines), _entries(F.col("_v"), at="$.payload.facts"), "taxonomy", "_t")
    rows = _unfolded(rows.drop("_v"), _entries(F.col("_t")), "name", "_b")
    rows = _unfolded(rows.drop("_t"), _entries(F.col("_b"), at="$.units"), "unit", "_l")
    # Unfolded as maps at once: as a column of its own, filters on them would be moved down and cast anew.
    rows = _unfolded(rows.drop("_b"), _entries(F.col("_l"), "map<string, string>"), "_pos", "o").drop("_l")
    extra = F.map_filter("o", lambda k, v: ~k.isin(*FACT_FIELDS))
    kept = rows.where((F.col("o")["end"] != "") & F.col("o")["val"].isNotNull())
    return kept.select(
        "ticker",
        F.concat_ws(":", "taxonomy", "name").alias("concept"),
        "unit",
        F.col("o")["start"].alias("period_start"),
        F.col("o")["end"].alias("period_end"),
        *(F.col("o")[c].alias(c) for c in ("fy", "fp", "form", "val", "accn", "filed")),
        F.when(F.size(extra) > 0, F.to_json(extra)).alias("extra"),
        "bronze_run_id",
        "dt",
        F.struct("_env", "taxonomy", "name", "unit", "_pos").alias("ord"),
    )


def unknown_fact_fields(lines: DataFrame) -> DataFrame:
    """(level, field, n): fields that company envelopes carry and no schema names, and how often.

    Levels are the payload, the body of a concept, and the observation. Facts of the usual shape are
    cast as a whole, since each part that is taken out as a VARIANT is built anew; others are taken
    apart level by level.
    """
    # A type that nothing but an object casts to: the fields are asked for their names only.
    names = "map<string, struct<none: boolean>>"
    keys = lambda value, at="$": F.transform(
        _entries(value, "struct<none: boolean>", at), lambda e: e["key"]
    )

    def named(level: str, fields: Column, known: tuple[str, ...]) -> Column:
        unknown = F.filter(fields, lambda k: ~k.isin(*known))
        return F.transform(unknown, lambda k: F.struct(F.lit(level).alias("level"), k.alias("field")))

    def usual_observations(t: Column) -> Column:
        entries = F.map_entries
        return _each(entries(t), lambda _, t: _each(entries(t), lambda _, b: _each(
            entries(b["units"]), lambda _, x: F.flatten(F.transform(x, F.map_keys)))))

    by_level = _each(_entries(F.col("_v"), at="$.payload.facts"), lambda _, t: _each(_entries(t), lambda _, b: F.concat(
        named("concept", keys(b), ("units",)),
        named("observation", _each(_entries(b, at="$.units"), lambda _, x: _each(
            _entries(x), lambda _, o: keys(o))), FACT_FIELDS),
    )))

    def usual(t: Column) -> Column:
        bodies = F.map_values(F.try_variant_get("_v", "$.payload.facts", f"map<string, map<string, {names}>>"))
        concepts = F.flatten(F.transform(bodies, lambda t: F.flatten(F.transform(F.map_values(t), F.map_keys))))
        return F.concat(
            named("concept", concepts, ("units",)), named("observation", usual_observations(t), FACT_FIELDS)
        )

    cast = F.try_variant_get("_v", "$.payload.facts", _by_units(names))
    of_facts = _let(cast, lambda t: F.when(_whole(t), usual(t)).otherwise(by_level))
    of_payload = named("payload", keys(F.col("_v"), "$.payload"), ("facts",))
    rows = _company_facts(lines).select(F.inline(F.concat(of_payload, of_facts)))
    return rows.groupBy("level", "field").agg(F.count(F.lit(1)).alias("n"))


def normalize_figi(envelopes: DataFrame, whole: bool = False) -> DataFrame:
    """Identifier candidates of a ticker: every one that has an identifier is kept. ``whole``: see
    ``_complete``."""
    rows = _head(envelopes, F.lit(None)).select(
        partition_key("symbol").alias("ticker"),
        "bronze_run_id",
        "dt",
        "_env",
        *_state(whole),
        F.col("payload.data").alias("data"),
        _unfold("payload.data", whole).alias("pos", "d"),
    )
    return _complete(rows, lambda d: d["figi"] != "", "data", "d", whole, "pos").select(
        "ticker",
        "d.figi",
        F.col("d.compositeFIGI").alias("composite_figi"),
        F.col("d.shareClassFIGI").alias("share_class_figi"),
        F.col("d.securityType").alias("security_type"),
        F.col("d.marketSector").alias("market_sector"),
        F.col("d.exchCode").alias("exch_code"),
        "d.name",
        "bronze_run_id",
        "dt",
        _ordinal("pos"),
        *_marks(whole),
    )


# Fields a ticker's info must carry (a null value counts as carried).
REQUIRED_INFO = ("exchange", "quoteType", "timezone", "currency")


def judge_info(envelopes: DataFrame) -> DataFrame:
    """Instrument candidates from ticker info; ``reason`` is null unless one is rejected.

    An empty payload means the vendor does not know the ticker.
    """
    info = F.col("payload")
    ticker = F.upper(F.trim(partition_key("symbol")))
    lacks = [
        F.when(~F.map_contains_key("payload", key), F.lit(f"missing required field {key}"))
        for key in REQUIRED_INFO
    ]
    reason = F.coalesce(
        F.when(F.coalesce(ticker, F.lit("")) == "", F.lit("ticker is required")),
        F.when(info.isNull() | (F.size(info) == 0), F.lit("unknown ticker")),
        *lacks,
    )
    return _head(envelopes, F.lit(None)).select(
        ticker.alias("ticker"),
        display_name(info, ticker).alias("name"),
        info["exchange"].alias("exchange"),
        info["quoteType"].alias("quote_type"),
        info["timezone"].alias("timezone"),
        info["currency"].alias("currency"),
        reason.alias("reason"),
        "bronze_run_id",
        "dt",
        F.col("_env").alias("ord"),
    )


def normalize_info(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted candidates, and the rejects with a reason."""
    judged = judge_info(envelopes)
    good = judged.where("reason is null").drop("reason")
    return good, judged.where("reason is not null").select("ticker", "reason", "bronze_run_id")
