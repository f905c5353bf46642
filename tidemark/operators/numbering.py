"""Consecutive numbers over a whole table without one task seeing all of it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import work_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    It cuts the lineage: what follows sees the same rows however often it is evaluated, and a lost
    executor costs no more than the tasks it ran.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[Column], out: str, name: str = "numbers") -> DataFrame:
    """Add ``out`` = 0, 1, 2, … in the order of ``order``, for any distribution of its values.

    Rows are range-partitioned and sorted, and written with their place in their partition. Only one
    count per partition is summed up in one task, and those counts are all that is broadcast.
    Rows that agree in all of ``order`` are numbered in any order.
    """
    mark = uuid.uuid4().hex[:12]
    place, part, before, count = (f"_{n}_{mark}" for n in ("place", "part", "before", "count"))
    placed = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(place, F.monotonically_increasing_id()),
        name,
    )
    # The number's upper 31 bits are the partition, the lower 33 the row in it.
    placed = placed.withColumn(part, F.shiftright(place, 33))
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias(count))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    row = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), part)
        .withColumn(out, F.col(before) + row)
        .drop(place, part, before)
    )


def number_rows(df: DataFrame, position: str, out: str, *, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = 0, 1, 2, … in the order of ``position``, then ``ties``.

    Positions may be dense, sparse, or hashes, and any number of rows may share one.
    """
    return numbered(df, [F.col(c) for c in (position, *ties)], out)
