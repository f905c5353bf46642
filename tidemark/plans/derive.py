"""Market-data shaped tables derived from the supplied tables, whole and without sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per user from events: (symbol, ts) is unique."""
    events = read(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        F.to_date("ts").alias("day"),
        "ts",
        "value",
    )
    days = events.groupBy("symbol", "day").agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return days.withColumnRenamed("day", "ts").select(
        "symbol", "ts", "open", "high", "low", "close", "volume"
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from orders: several per (series, ts), missing markers for pending ones."""
    return read(spark, sf_dir, "orders").select(
        F.lower("o_orderpriority").alias("series"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderstatus") == "P", F.lit("."))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("value"),
        F.col("o_orderkey").alias("position"),
    )


def numbered(*parts: str) -> Column:
    """Texts and columns of numbers in turn as one text, as ``format_string`` gives it, null included, at
    less cost."""
    texts = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in parts[1::2])
    return F.concat(*(x for pair in zip(map(F.lit, parts[::2]), texts) for x in pair))


FIGI_ROW = ("l_orderkey", "l_partkey")
FACT_ROW = ("l_orderkey", "l_linenumber", "l_partkey")
TASK_ROWS = 500_000  # narrow rows that one task widens, builds and parses


def dealt_out(table: DataFrame, rows: DataFrame, *by: str) -> DataFrame:
    """Rows of a table dealt out before they are widened: Spark would gather such narrow ones by their size
    into tasks too large for what becomes of them. The table is counted from its footers, and every core
    has as many tasks."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    rounds = max(1, -(-table.count() // (TASK_ROWS * cores)))
    return rows.repartition(rounds * cores, *by)


def facts(spark: SparkSession, sf_dir: str, dealt: tuple[str, ...] = ()) -> DataFrame:
    """Reported facts from lineitem, with restatements: the order key decides the filing day.

    ``dealt`` deals the rows out by columns of lineitem, ticker or month, before they are widened: a
    table's only row group would be read, built and parsed by one task. The month is a column if named.
    """
    table = read(spark, sf_dir, "lineitem")
    ticker, shipped = numbered("S", "l_suppkey"), F.to_date("l_shipdate")
    # Short values travel: a day for a time, a form for a discount, and a number for the ticker dealt by others.
    lineitem = table.withColumns(
        {
            **({"ticker": ticker} if "ticker" in dealt else {}),
            "month": F.trunc(shipped, "month"),
            "l_shipdate": shipped,
            "form": F.when(F.col("l_discount") < 0.05, F.lit("10-K")),
        }
    )
    if dealt:
        lineitem = dealt_out(table, lineitem, *dealt)
    return lineitem.select(
        "ticker" if "ticker" in dealt else ticker.alias("ticker"),
        *(["month"] if "month" in dealt else []),
        F.col("l_returnflag").alias("taxonomy"),
        F.col("l_linestatus").alias("name"),
        F.lit("USD").alias("unit"),
        F.col("l_shipdate").alias("period_end"),
        F.date_sub("l_shipdate", 90).alias("period_start"),
        F.year("l_shipdate").cast("bigint").alias("fy"),
        F.when(F.col("l_linenumber") <= 4, F.concat(F.lit("Q"), F.col("l_linenumber").cast("string")))
        .alias("fp"),
        "form",
        F.col("l_extendedprice").alias("val"),
        numbered("", "l_orderkey", "-", "l_partkey").alias("accn"),
        F.date_add("l_shipdate", F.pmod("l_orderkey", F.lit(400)).cast("int")).alias("filed"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_tax")
        .alias("ord"),
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument candidates from customers and their nations."""
    customer = read(spark, sf_dir, "customer")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("exchange"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("position"),
        F.upper("c_name").alias("ticker"),
        F.col("c_name").alias("name"),
        "exchange",
        F.lit("USD").alias("currency"),
        F.lit("America/New_York").alias("timezone"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.col("c_mktsegment").isin("MACHINERY", "BUILDING").alias("is_scheduled"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments as registry rows: ids follow the customer number."""
    at = literal_time("2024-01-01 00:00:00")
    return instruments(spark, sf_dir).select(
        (F.col("position") + 1).cast("int").alias("id"),
        *("ticker", "name", "exchange", "currency", "timezone", "is_active", "is_scheduled"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def symbol_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of bar symbols: users whose number is that of a customer with no debt."""
    customer = read(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return customer.select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("ticker"))


def supplier_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of fact tickers: suppliers with no debt."""
    supplier = read(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    return supplier.select(F.format_string("S%d", "s_suppkey").alias("ticker"))


def figi(spark: SparkSession, sf_dir: str, dealt: tuple[str, ...] = ()) -> DataFrame:
    """Identifier candidates: the parts a supplier ships, as listings of the supplier's ticker.

    ``dealt`` deals the rows out before the parts widen them, as those of facts.
    """
    table = read(spark, sf_dir, "lineitem")
    lineitem = table.select("l_suppkey", "l_partkey", "l_orderkey")
    if dealt:
        lineitem = dealt_out(table, lineitem, *dealt)
    part = read(spark, sf_dir, "part")
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        numbered("S", "l_suppkey").alias("ticker"),
        F.format_string("BBG%09d", "p_partkey").alias("figi"),
        F.col("p_brand").alias("composite_figi"),
        F.col("p_type").alias("share_class_figi"),
        F.lit("Common Stock").alias("security_type"),
        F.lit("Equity").alias("market_sector"),
        F.format_string("X%d", "p_size").alias("exch_code"),
        F.concat_ws(" ", "p_name", F.col("l_orderkey").cast("string")).alias("name"),
        F.col("l_orderkey").alias("position"),
    )


def literal_time(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def as_text(c: str) -> Column:
    """A timestamp as text, for results that are compared with another engine."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
