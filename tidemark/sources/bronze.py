"""Raw envelopes ``{meta, payload}``: reading, locating, building and landing them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.columns import clean_code, run_id_of
from tidemark.operators.selection import listed_codes
from tidemark.schemas import META
from tidemark.session import RELEASED, settings
from tidemark.sources.tables import appended

CORRUPT = "_corrupt"
FILE_RECORDS = 50_000


def envelope_schema(payload: str, corrupt: bool = True) -> T.StructType:
    text = f"meta {' '.join(META.split())}, payload {' '.join(payload.split())}"
    return T.StructType.fromDDL(f"{text}, {CORRUPT} string" if corrupt else text)


def read_envelopes(
    spark: SparkSession,
    path: str | Iterable[str],
    payload: str,
    *,
    multi_line: bool = False,
    stream: bool = False,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Envelopes below ``path``, one JSON object per line, or one per file if ``multi_line``.

    Partition columns are never taken from paths: a series code may hold a slash. They come from
    ``meta.partitions``. gzip is undone by Spark. Rows that are no JSON have a null meta and their
    text in ``_corrupt``.
    """
    reader = (spark.readStream if stream else spark.read).schema(envelope_schema(payload))
    reader = reader.option("recursiveFileLookup", True).option("multiLine", multi_line)
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    frame = reader.json(path if isinstance(path, str) else list(path))
    return frame.withColumn("file_path", F.col("_metadata.file_path"))


def locate(
    envelopes: DataFrame, run_id: str | None, dt: str | None = None, symbol: str | None = None
) -> DataFrame:
    """The envelopes of one run, day or symbol. The filter on the path leaves other days unread."""
    if not dt and not symbol:
        raise ValueError("a dt or a symbol is needed")
    path = F.col("file_path")
    if dt:
        envelopes = envelopes.where(path.contains(f"/dt={dt}/"))
    if run_id:
        envelopes = envelopes.where(envelope_run_id(path, F.col("meta")) == F.lit(run_id))
    if symbol:
        envelopes = envelopes.where(
            F.upper(F.col("meta.partitions")["symbol"]) == F.lit(symbol.upper())
        )
    return envelopes


def clean_partitions(partitions: Column | str) -> Column:
    """Trim the values and drop null or blank ones; an absent map is an empty one."""
    source = F.col(partitions) if isinstance(partitions, str) else partitions
    trimmed = F.transform_values(source, lambda _, v: F.trim(v))
    kept = F.map_filter(trimmed, lambda _, v: v.isNotNull() & (v != ""))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def record_count(payload_json: Column | str) -> Column:
    """Length of a list, or of the list under ``records``; 1 for anything else.

    Price payloads keep their list under ``rows``, so they count as 1.
    """
    text = F.col(payload_json) if isinstance(payload_json, str) else payload_json
    records = F.get_json_object(text, "$.records")
    counted = F.coalesce(F.json_array_length(text), F.json_array_length(records), F.lit(1))
    # An object without that name, which an escape could spell too, is not parsed for it.
    plain = text.startswith("{") & ~text.contains("records") & ~text.contains("\\")
    return F.when(plain, F.lit(1)).otherwise(counted)


def build_envelopes(landing: DataFrame) -> DataFrame:
    """Envelope text from landing rows.

    In: vendor, dataset, payload (JSON text), partitions and params (maps), dt (date or null),
    schema_version, fetched_at (timestamp). Out: layout columns, run id and ``value``, one JSON
    line.
    """
    fetched = F.to_utc_timestamp("fetched_at", F.current_timezone())
    run_id = F.date_format(fetched, "yyyyMMddHHmmss'Z'")
    meta = F.struct(
        F.col("vendor").alias("source"),
        F.col("dataset"),
        F.date_format(fetched, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("fetched_at"),
        run_id.alias("run_id"),
        F.date_format("dt", "yyyy-MM-dd").alias("dt"),
        F.col("schema_version"),
        clean_partitions("partitions").alias("partitions"),
        F.coalesce("params", F.create_map().cast("map<string,string>")).alias("params"),
        record_count("payload").alias("record_count"),
    )
    payload = F.coalesce("payload", F.lit("null"))
    meta_json = F.to_json(meta, {"ignoreNullFields": "false"})
    return landing.select(
        clean_code("vendor", "lower").alias("vendor"),
        clean_code("dataset", "lower").alias("dataset"),
        F.date_format("dt", "yyyy-MM-dd").alias("dt"),
        run_id.alias("run_id"),
        F.concat(
            F.lit('{"meta":'), meta_json, F.lit(',"payload":'), payload, F.lit("}")
        ).alias("value"),
    )


def land_envelopes(
    landing: DataFrame, root: str, file_records: int = FILE_RECORDS, *, dealt: bool = False
) -> None:
    """Append envelopes as gzip JSON lines below ``root``, by vendor, dataset and dt.

    Many fetches share a file; a directory per fetch would mean a small file per fetch. Spark gathers
    the lines of a day into files of about one size at run time, and a file, which a single task has
    to read later, holds no more than ``file_records`` envelopes: fewer where they are large. Rows of
    few days that were ``dealt`` out to tasks of bounded size before are written where they lie, so
    their text, many times wider, is not shuffled.
    """
    lines = build_envelopes(landing).drop("run_id")
    if not dealt:
        lines = lines.hint("rebalance", "vendor", "dataset", "dt")
    with settings(landing.sparkSession, RELEASED):
        lines.write.mode("append").option("maxRecordsPerFile", file_records).partitionBy(
            "vendor", "dataset", "dt"
        ).text(root, compression="gzip")


def parse_envelopes(lines: DataFrame, payload: str) -> DataFrame:
    """Envelopes from a column ``value`` of JSON lines, for text that is not in files.

    Unfolding the parsed text as an array of one keeps it a column of its own: otherwise every
    later filter on a field of it would be moved down to the text and parse it once more.
    """
    schema = envelope_schema(payload, corrupt=False)
    parsed = lines.select(F.inline(F.array(F.from_json("value", schema))))
    return parsed.withColumn("file_path", F.lit(""))


def landed_path(root: str, vendor: str, dataset: str) -> str:
    return f"{root}/vendor={vendor.strip().lower()}/dataset={dataset.strip().lower()}"


def envelope_run_id(file_path: Column, meta: Column) -> Column:
    """The run id in the path, which the jobs trust; the one in meta where the path has none."""
    return F.coalesce(run_id_of(file_path), meta["run_id"])


def envelope_symbols(meta: Column) -> Column:
    """The symbols an envelope was fetched for: the one in its partitions, else those in its params."""
    own, listed = F.nullif(F.upper(F.trim(meta["partitions"]["symbol"])), F.lit("")), meta["params"]["symbols"]
    return F.when(own.isNotNull(), F.array(own)).otherwise(listed_codes(listed))


INDEX = "symbol string, file_path string"


def refresh_index(spark: SparkSession, path: str, payload: str, index: str) -> int:
    """Bring the index of the files below ``path`` up to date: which symbols are in which file.

    Files are only ever added, so those the index names are not opened again. The names of new files
    pass through the driver, as any read of them would have it. Returns how many there were.
    """
    known = appended(spark, index, T.StructType.fromDDL(INDEX)).select("file_path").distinct()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    fresh = listed.select("_metadata.file_path").join(known, "file_path", "left_anti")
    names = [r.file_path for r in fresh.collect()]
    if names:
        found = read_envelopes(spark, names, payload).select(
            F.explode(envelope_symbols(F.col("meta"))).alias("symbol"), "file_path"
        )
        ordered = found.distinct().repartitionByRange("symbol", "file_path")
        ordered.sortWithinPartitions("symbol", "file_path").write.mode("append").parquet(index)
    return len(names)


def read_symbol(spark: SparkSession, index: str, payload: str, symbol: str) -> DataFrame:
    """The envelopes of a symbol, from the files that hold it alone. One in no file has none."""
    wanted = F.lit(symbol.strip().upper())
    rows = appended(spark, index, T.StructType.fromDDL(INDEX)).where(F.col("symbol") == wanted)
    names = sorted(r.file_path for r in rows.select("file_path").distinct().collect())
    if not names:
        empty = spark.createDataFrame([], envelope_schema(payload))
        return empty.withColumn("file_path", F.lit(""))
    envelopes = read_envelopes(spark, names, payload)
    return envelopes.where(F.array_contains(envelope_symbols(F.col("meta")), wanted))
