"""Wide price panels: one column per (ticker, field)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Field names of a panel, and the row columns they become.
FIELDS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}


def panel_to_rows(
    panel: DataFrame, symbols: list[str], date: str = "Date", separator: str = "|"
) -> DataFrame:
    """Long rows (ts, open, high, low, close, volume, symbol) from a panel.

    Each panel row unfolds to one row per ticker, without a shuffle. Tickers that have no column
    are skipped, as are rows without a date and rows in which the ticker's fields are all null.
    A panel of one ticker may have plain field names.
    """
    flat = all(separator not in c for c in panel.columns)
    names = {
        s: {f: f if flat else f"{s}{separator}{f}" for f in FIELDS}
        for s in (symbols[:1] if flat else symbols)
    }
    rows = [
        F.struct(
            *(
                (F.col(f"`{source}`") if source in panel.columns else F.lit(None))
                .cast("double")
                .alias(FIELDS[f])
                for f, source in columns.items()
            ),
            F.lit(symbol).alias("symbol"),
        )
        for symbol, columns in names.items()
        if any(source in panel.columns for source in columns.values())
    ]
    if not rows:
        return panel.sparkSession.createDataFrame(
            [], "ts date, open double, high double, low double, close double, volume double, symbol string"
        )
    long = panel.select(F.col(date).alias("ts"), F.explode(F.array(*rows)).alias("r"))
    return long.where("ts is not null").select("ts", "r.*").na.drop(
        how="all", subset=list(FIELDS.values())
    )
