"""Keep one row per key, in an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in ``order``, null order values counting as first.

    ``max`` of a struct is an aggregate, so every map task sends at most one row per key: a key
    with a third of all rows costs its reducer one row per task. The remaining columns close the
    struct, so equal order values still give the same row on every attempt.
    """
    return _extreme(df, keys, order, F.max)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in ``order``, null order values counting as first."""
    return _extreme(df, keys, order, F.min)


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = [c for c in order if c not in keys] + rest
    if not packed:
        return df.distinct()
    # Numbered fields keep the struct free of name clashes between order and payload columns.
    fields = [F.col(c).alias(f"f{i}") for i, c in enumerate(packed)]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*fields)).alias("_row"))
    where = {c: F.col(f"_row.f{i}").alias(c) for i, c in enumerate(packed)}
    return chosen.select(*(where.get(c, F.col(c)) for c in df.columns))
