"""What the jobs need to know about a vendor.

A new source takes a payload schema, a normaliser, a cleaner and a table, and an entry like those
below; ``jobs.run_vendor`` does the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark import schemas
from tidemark.operators import clean, normalize, upsert, watermark


@dataclass(frozen=True)
class Vendor:
    source: str  # vendor name in paths and audit columns
    bronze_name: str  # dataset of its envelopes
    silver_name: str  # dataset of its Silver rows
    run_name: str  # dataset of its ledger rows
    payload: str  # schema of an envelope's payload
    partition: str  # the key in meta.partitions
    normalize: Callable[[DataFrame], DataFrame]
    clean: Callable[[DataFrame], DataFrame]
    silver: T.StructType
    table: upsert.TableSpec
    key: str  # the column that names an item
    time: str | None = None  # the column high-water marks follow
    mark: tuple[str, str] | None = None
    needs_registration: bool = False
    wrong: Callable[[DataFrame], Column] | None = None  # what is wrong with a normalised row, or null
    unknown: Callable[[Column], Column] | None = None  # what is wrong with a key, or null


MACRO = Vendor(
    source="fred",
    bronze_name="macros",
    silver_name="macro",
    run_name="macro",
    payload=schemas.MACRO_PAYLOAD,
    partition="series",
    normalize=normalize.normalize_macro,
    clean=clean.clean_macro,
    wrong=normalize.wrong_macro,
    unknown=lambda code: F.when(~F.lower(code).isin([*schemas.MACRO_SERIES]), F.lit("unknown series")),
    silver=schemas.SILVER_MACRO,
    table=upsert.MACRO,
    key="series",
    time="ts",
    mark=watermark.MACRO_MARK,
)
FACTS = Vendor(
    source="sec_edgar",
    bronze_name="companyfacts",
    silver_name="fundamentals",
    run_name="fundamentals",
    payload=schemas.FACTS_PAYLOAD,
    partition="symbol",
    normalize=normalize.untyped_facts,
    # Several fetches of a ticker may be in one batch: the later fetch wins.
    clean=lambda rows: clean.clean_facts(normalize.typed_facts(rows), clean.ENVELOPE_FIRST),
    wrong=normalize.wrong_fact,
    silver=schemas.SILVER_FACTS,
    table=upsert.FACTS,
    key="ticker",
    time="period_end",
    mark=watermark.FACTS_MARK,
)
FIGI = Vendor(
    source="openfigi",
    bronze_name="mapping",
    silver_name="mapping",
    run_name="figi_mapping",
    payload=schemas.FIGI_PAYLOAD,
    partition="symbol",
    normalize=normalize.normalize_figi,
    clean=clean.clean_figi,
    silver=schemas.SILVER_FIGI,
    table=upsert.FIGI,
    key="ticker",
    needs_registration=True,
)
