"""Schemas of envelopes, Silver frames and Gold tables, and the fixed values that go with them."""

from __future__ import annotations

from pyspark.sql import types as T

# First day loaded for a key that has no high-water mark yet, and the read limits.
DEFAULT_BACKFILL_START = "2015-01-01"
DEFAULT_LIMIT = 500
MAX_LIMIT = 5000

# Series code -> the macro vendor's series id.
MACRO_SERIES = {
    "interest_rate_10y": "GS10",
    "inflation": "CPIAUCNS",
    "cpi": "CPIAUCSL",
    "gdp": "GDP",
    "unemployment": "UNRATE",
    "yield_curve": "T10Y2Y",
    "fed_funds": "FEDFUNDS",
    "usd/eur": "DEXUSEU",
    "usd/cad": "DEXCAUS",
    "usd/jpy": "DEXJPUS",
    "usd/gbp": "DEXUSUK",
}

META = """struct<source: string, dataset: string, fetched_at: string, run_id: string, dt: string,
    schema_version: int, partitions: map<string, string>, params: map<string, string>,
    record_count: int>"""

# Numbers are read as text and cast by the normalisers: a typed JSON read would turn a quoted number,
# or 1000.0 in an integer field, into null without a word.
PRICES_PAYLOAD = """struct<start: string, end: string,
    rows: array<struct<ts: string, open: string, high: string, low: string, close: string,
                       volume: string, symbol: string>>,
    errors: array<struct<symbol: string, error: string>>>"""
MACRO_PAYLOAD = "struct<observations: array<struct<date: string, value: string>>>"
FACTS_PAYLOAD = """struct<facts: map<string, map<string, struct<units: map<string,
    array<struct<`end`: string, start: string, val: string, accn: string, fy: string,
                 fp: string, form: string, filed: string>>>>>>>"""
FIGI_PAYLOAD = """struct<data: array<struct<figi: string, compositeFIGI: string,
    shareClassFIGI: string, securityType: string, marketSector: string, exchCode: string,
    name: string>>>"""
INFO_PAYLOAD = "map<string, string>"


_TYPES = {
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "double": T.DoubleType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
}


def ddl(text: str) -> T.StructType:
    """Flat schema from ``name type, …``. Spark's own parser would need a running session."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SILVER_PRICES = ddl(
    "symbol string, ts date, open double, high double, low double, close double, volume bigint"
)
SILVER_MACRO = ddl("series string, ts date, value double")
SILVER_FACTS = ddl(
    """ticker string, concept string, unit string, period_start date, period_end date, fy bigint,
       fp string, form string, val double, accn string, filed date"""
)
SILVER_FIGI = ddl(
    """ticker string, figi string, composite_figi string, share_class_figi string,
       security_type string, market_sector string, exch_code string, name string"""
)

AUDIT = "source string, run_id string, ingested_at timestamp"
GOLD_PRICES = ddl(
    f"""symbol string, ts date, open double, high double, low double, close double, volume bigint,
        dividends double, stock_split double, close_returns double, {AUDIT}"""
)
GOLD_MACRO = ddl(f"series string, ts date, value double, {AUDIT}")
GOLD_FACTS = ddl(
    f"""ticker string, concept string, unit string, period_end date, fp string, form string,
        fy bigint, period_start date, val double, accn string, filed date, {AUDIT}"""
)
GOLD_FIGI = ddl(
    f"""ticker string, figi string, composite_figi string, share_class_figi string,
        security_type string, market_sector string, exch_code string, name string, {AUDIT}"""
)
WATERMARKS = ddl(
    """source string, dataset string, ticker string, last_ts date, last_run_id string,
       updated_at timestamp"""
)
INSTRUMENTS = ddl(
    """id int, ticker string, name string, exchange string, currency string, timezone string,
       is_active boolean, is_scheduled boolean, created_at timestamp, updated_at timestamp"""
)
REJECTS = ddl(
    """run_id string, dataset string, kind string, key string, detail string, bronze_run_id string"""
)
RUN_EVENTS = ddl(
    """run_id string, dataset string, run_date date, status string, items_total int,
       items_success int, items_failed int, notes string, seq int, at timestamp"""
)
