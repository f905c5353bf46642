"""Landing rows (what a fetch hands over) built from the derived tables.

Every envelope is built from one row, or from one key's days of one month: no group can grow with
the data. Rows the normalisers must leave out are mixed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.plans import derive

EPOCH = 1_700_000_000  # fetch times of the row-wise envelopes count up from here

PRICE_FILE = 2_000  # price envelopes of a file: about 60,000 rows


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by a key, since a table's only row group is read, built and parsed by one task."""
    return rows.repartition(*by)


def _landing(rows: DataFrame, vendor: str, dataset: str, version: int, fetched: Column, **fields) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return rows.select(
        F.lit(vendor).alias("vendor"),
        F.lit(dataset).alias("dataset"),
        fields.get("dt", F.lit(None).cast("date")).alias("dt"),
        fields.get("partitions", none).alias("partitions"),
        fields.get("params", none).alias("params"),
        F.lit(version).alias("schema_version"),
        fetched.alias("fetched_at"),
        fields.get("text", F.to_json(fields.get("payload", none), {"ignoreNullFields": "false"})).alias("payload"),
    )


def _fetch_time(seconds: Column, micros: Column | int = 0) -> Column:
    return F.timestamp_micros((seconds + EPOCH) * 1_000_000 + micros)


def prices(bars: DataFrame, fetched_at: str) -> DataFrame:
    """One envelope per symbol and month: at most 31 days, plus a stale copy of the first day, a
    row without symbol, a row without time, and an error entry."""
    midnight = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" 00:00:00-05:00"))
    row = F.struct(midnight.alias("ts"), "open", "high", "low", "close", "volume", "symbol")
    months = bars.groupBy("symbol", F.trunc("ts", "month").alias("month")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
    )
    first = F.element_at("rows", 1)
    stale = F.struct(
        first["ts"].alias("ts"),
        *((first[c] + 1).alias(c) for c in ("open", "high", "low", "close", "volume")),
        first["symbol"].alias("symbol"),
    )
    blank = "cast(null as string)"
    no_symbol = first.withField("symbol", F.expr(blank))
    no_time = first.withField("ts", F.expr(blank))
    rows = F.concat(F.array(stale), "rows", F.array(no_symbol, no_time))
    error = F.struct(
        F.concat("symbol", F.lit("X")).alias("symbol"), F.lit("no_rows_returned").alias("error")
    )
    params = F.create_map(
        F.lit("start"), F.col("start").cast("string"),
        F.lit("end"), F.col("end").cast("string"),
        F.lit("symbols"), F.concat("symbol", F.lit(","), "symbol", F.lit("X")),
    )
    at = derive.literal_time(fetched_at)
    return _landing(
        months, "yahoo", "history", 2, at,
        dt=F.to_date(at),
        params=params,
        payload=F.struct("start", "end", rows.alias("rows"), F.array(error).alias("errors")),
    )


def faulty_prices(bars: DataFrame, fetched_at: str, *, negative: bool = False) -> DataFrame:
    """Price envelopes of which some are faulty, by the last digit of the symbol's number: 3 quotes
    its closes, 4 has texts for them, 5 has a thirteenth month, 6 is cut off halfway, and 7 has
    negative closes if asked."""
    digit = F.pmod(F.regexp_extract(F.col("params")["symbols"], r"^U(\d+)", 1).cast("bigint"), F.lit(10))
    payload = F.col("payload")
    number = r'"close":([0-9.eE+-]+)'
    faulty = (
        F.when(digit == 3, F.regexp_replace(payload, number, r'"close":"$1"'))
        .when(digit == 4, F.regexp_replace(payload, number, '"close":"n/a"'))
        .when(digit == 5, F.regexp_replace(payload, r'"ts":"(\d{4})-', r'"ts":"$1-13-'))
        .when(digit == 6, F.left(payload, F.floor(F.length(payload) / 2).cast("int")))
        .when((digit == 7) & F.lit(negative), F.regexp_replace(payload, number, r'"close":-$1'))
        .otherwise(payload)
    )
    return prices(bars, fetched_at).withColumn("payload", faulty)


def macro(observations: DataFrame) -> DataFrame:
    """One envelope per observation, with a missing marker, texts that are no number, and entries
    without a date."""

    def entry(date: Column, value: Column) -> Column:
        return F.struct(date.alias("date"), value.alias("value"))

    date, value = F.col("date"), F.col("value")
    none = F.lit(None).cast("string")
    entries = F.array(
        entry(date, F.lit(".")),
        entry(date, value),
        entry(date, none),
        entry(date, F.lit("n/a")),
        entry(date, F.lit("")),
        entry(none, F.lit("1.5")),
        entry(F.lit(""), F.lit("1.5")),
    )
    return _landing(
        _spread(observations, "position"), "fred", "macros", 1, _fetch_time(F.col("position")),
        partitions=F.create_map(F.lit("series"), F.col("series")),
        params=F.create_map(F.lit("start"), F.concat(F.left("date", F.lit(4)), F.lit("-01-01"))),
        payload=F.struct(entries.alias("observations")),
    )


def facts(rows: DataFrame) -> DataFrame:
    """One envelope per fact, nested taxonomy, concept and unit, with an entry without value and
    one without end. Rows are built where they lie."""
    entry = F.struct(
        F.col("period_end").cast("string").alias("end"),
        F.col("period_start").cast("string").alias("start"),
        "val",
        "accn",
        "fy",
        "fp",
        "form",
        F.col("filed").cast("string").alias("filed"),
    )
    no_value = entry.withField("val", F.lit(None).cast("double"))
    no_end = entry.withField("end", F.lit(""))
    units = F.create_map("unit", F.array(no_value, entry, no_end))
    concepts = F.create_map("name", F.struct(units.alias("units")))
    return _landing(
        rows, "sec_edgar", "companyfacts", 1,
        _fetch_time(F.col("ord.l_orderkey"), F.col("ord.l_linenumber")),
        partitions=F.create_map(F.lit("symbol"), F.col("ticker")),
        params=F.create_map(F.lit("start"), F.date_format("filed", "yyyy-01-01")),
        payload=F.struct(F.create_map("taxonomy", concepts).alias("facts")),
    )


def company(rows: DataFrame) -> DataFrame:
    """One envelope per company and month: several taxonomies, concepts, units and observations, with
    fields that no schema names at three levels.

    Rows dealt out by ticker and month meet the grouping of every level where they lie.
    """
    entry = F.struct(
        "ord",
        F.struct(
            F.col("period_end").cast("string").alias("end"),
            F.col("period_start").cast("string").alias("start"),
            "val",
            "accn",
            "fy",
            "fp",
            "form",
            F.col("filed").cast("string").alias("filed"),
            F.concat(F.lit("CY"), F.col("fy").cast("string")).alias("frame"),
        ).alias("o"),
    )
    unit = F.when(F.col("ord.l_linenumber") % 2 == 0, F.lit("shares")).otherwise(F.col("unit"))
    named = rows.withColumn("unit", unit)

    observations = named.groupBy("ticker", "month", "taxonomy", "name", "unit").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["o"])).alias("text")
    )

    def joined(frame: DataFrame, name: str, *by: str) -> DataFrame:
        """The texts of one level as the fields of an object each."""
        field = F.concat(F.lit('"'), name, F.lit('":'), "text")
        fields = F.array_join(F.array_sort(F.collect_list(field)), ",")
        return frame.groupBy(*by).agg(F.concat(F.lit("{"), fields, F.lit("}")).alias("text"))

    units = joined(observations, "unit", "ticker", "month", "taxonomy", "name").withColumn(
        "text", F.concat(F.lit('{"label":"of '), "name", F.lit('","units":'), "text", F.lit("}"))
    )
    facts = joined(joined(units, "name", "ticker", "month", "taxonomy"), "taxonomy", "ticker", "month")
    number = F.regexp_extract("ticker", r"(\d+)", 1)
    return _landing(
        facts, "sec_edgar", "companyfacts", 1, derive.literal_time("2024-02-01 16:05:00"),
        partitions=F.create_map(F.lit("symbol"), F.col("ticker")),
        params=F.create_map(F.lit("start"), F.date_format("month", "yyyy-01-01")),
        text=F.concat(
            F.lit('{"cik":'), number, F.lit(',"entityName":"Company '), number, F.lit('","facts":'), "text", F.lit("}")
        ),
    )


def figi(rows: DataFrame) -> DataFrame:
    """One envelope per candidate, with an entry without identifier. Rows are built where they lie."""
    entry = F.struct(
        "figi",
        F.col("composite_figi").alias("compositeFIGI"),
        F.col("share_class_figi").alias("shareClassFIGI"),
        F.col("security_type").alias("securityType"),
        F.col("market_sector").alias("marketSector"),
        F.col("exch_code").alias("exchCode"),
        "name",
    )
    blank = entry.withField("figi", F.lit(None).cast("string"))
    return _landing(
        rows, "openfigi", "mapping", 1, _fetch_time(F.col("position")),
        partitions=F.create_map(F.lit("symbol"), F.col("ticker")),
        payload=F.struct(F.array(blank, entry).alias("data")),
    )


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One info envelope per customer. Some payloads are empty, some lack a field, some carry a
    null field, and the short name may be blank."""
    rows = derive.read(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    none = F.lit(None).cast("string")
    full = F.create_map(
        F.lit("exchange"), F.when(segment == "BUILDING", none).otherwise(F.lit("NYQ")),
        F.lit("quoteType"), F.lit("EQUITY"),
        F.lit("timezone"), F.lit("America/New_York"),
        F.lit("currency"), F.lit("USD"),
        F.lit("shortName"), F.when(segment == "MACHINERY", F.lit("")).otherwise(F.col("c_name")),
        F.lit("longName"), F.concat("c_name", F.lit(" Inc.")),
    )
    lacking = F.map_filter(full, lambda k, _: k != "currency")
    empty = F.create_map().cast("map<string,string>")
    payload = (
        F.when(segment == "FURNITURE", empty).when(segment == "HOUSEHOLD", lacking).otherwise(full)
    )
    ticker = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    return _landing(
        rows, "yahoo", "info", 1, _fetch_time(F.col("c_custkey")),
        dt=F.lit("2024-02-01").cast("date"),
        partitions=F.create_map(F.lit("symbol"), ticker),
        payload=payload,
    )
