"""The run ledger: start and finish events, folded to one row per run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.dedup import keep_last
from tidemark.operators.upsert import TableSpec
from tidemark.schemas import RUN_EVENTS
from tidemark.sources import files
from tidemark.sources.tables import appended, load, read_table

START, FINISH = 0, 1
TAIL_FILES = 64  # appended files beyond which the ledger folds them

#: What folding keeps: of each run the last event of a kind.
EVENTS = TableSpec(
    name="ingestion_events",
    schema=RUN_EVENTS,
    key=("run_id", "seq"),
    updated=("dataset", "run_date", "status", "items_total", "items_success", "items_failed", "notes", "at"),
    touched="",
    layout=("bucket", "pmod(xxhash64(run_id), 4)"),
    files=2,
)


def start_events(runs: DataFrame, at: Column) -> DataFrame:
    """Start events for a table of (run_id, dataset, run_date)."""
    zero = F.lit(0)
    return runs.select(
        "run_id",
        "dataset",
        F.col("run_date").cast("date").alias("run_date"),
        F.lit("running").alias("status"),
        *(zero.alias(c) for c in ("items_total", "items_success", "items_failed")),
        F.lit(None).cast("string").alias("notes"),
        F.lit(START).alias("seq"),
        at.cast("timestamp").alias("at"),
    )


def finish_events(outcomes: DataFrame, at: Column) -> DataFrame:
    """Finish events for (run_id, status, items_total, items_success, items_failed, notes).

    Notes are kept whole; what is cut is an exception's text, by whoever writes it down.
    """
    return outcomes.select(
        "run_id",
        F.lit(None).cast("string").alias("dataset"),
        F.lit(None).cast("date").alias("run_date"),
        "status",
        *(F.col(c).cast("int").alias(c) for c in ("items_total", "items_success", "items_failed")),
        "notes",
        F.lit(FINISH).alias("seq"),
        at.cast("timestamp").alias("at"),
    )


def run_state(events: DataFrame) -> DataFrame:
    """One row per started run: as finished last, or still running."""
    started = F.col("seq") == START
    last = F.struct("seq", "at", "status", "items_total", "items_success", "items_failed", "notes")
    folded = events.groupBy("run_id").agg(
        F.max(F.when(started, F.struct("dataset", "run_date"))).alias("s"),
        F.min(F.when(started, F.col("at"))).alias("started_at"),
        F.max(last).alias("e"),
    )
    return folded.where("s is not null").select(
        "run_id",
        "s.dataset",
        "s.run_date",
        "e.status",
        "e.items_total",
        "e.items_success",
        "e.items_failed",
        "started_at",
        F.when(F.col("e.seq") == FINISH, F.col("e.at")).alias("finished_at"),
        "e.notes",
    )


def unknown_runs(events: DataFrame) -> DataFrame:
    """Run ids that were finished but never started."""
    started = events.where(F.col("seq") == START).select("run_id")
    return events.where(F.col("seq") == FINISH).select("run_id").distinct().join(
        started, "run_id", "left_anti"
    )


class RunLedger:
    """Events in one folder and what was folded of earlier ones. An append is one small file, visible
    at once; beyond ``TAIL_FILES`` of them a finish folds them, so their number stays bounded.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._started: set[str] = set()

    @property
    def _root(self) -> str:
        return self.path.rstrip("/").rpartition("/")[0]

    def events(self) -> DataFrame:
        tail = appended(self.spark, self.path, RUN_EVENTS)
        return read_table(self.spark, self._root, EVENTS).select(*RUN_EVENTS.names).unionByName(tail)

    def state(self) -> DataFrame:
        return run_state(self.events())

    def append(self, events: DataFrame) -> None:
        events.select(*RUN_EVENTS.names).write.mode("append").parquet(self.path)

    def tail(self) -> list[str]:
        """Names of the appended files."""
        return [n for n in files.names(self.spark, self.path) if n.endswith(".parquet")]

    def fold(self) -> None:
        """Move the appended events to the table of events, which has one of a kind for each run.

        Only the files listed first are read and then removed. A fold that breaks off in between
        leaves events in both places, which is one run all the same, and the next fold repeats them.
        """
        names = self.tail()
        if not names:
            return
        paths = [f"{self.path}/{n}" for n in names]
        found = self.spark.read.schema(RUN_EVENTS).parquet(*paths)
        held = read_table(self.spark, self._root, EVENTS).join(found.select("run_id").distinct(), "run_id", "left_semi")
        # A run's first start counts and its last finish; each keeps the time it happened.
        rank = F.when(F.col("seq") == START, -F.unix_micros("at")).otherwise(F.unix_micros("at"))
        both = found.unionByName(held.select(*RUN_EVENTS.names)).withColumn("_rank", rank)
        last = keep_last(both, EVENTS.key, ["_rank"]).drop("_rank")
        load(self.spark, self._root, last, EVENTS, F.current_timestamp(), unique=last)
        for path in paths:
            files.remove(self.spark, path)

    def start(
        self, dataset: str, run_date: str, at: Column | None = None, run_id: str | None = None
    ) -> str:
        """Start a run and return its id, a fresh one unless one is given."""
        run_id = run_id or uuid.uuid4().hex
        runs = self.spark.createDataFrame(
            [(run_id, dataset, str(run_date))], "run_id string, dataset string, run_date string"
        )
        self.append(start_events(runs, at if at is not None else F.current_timestamp()))
        self._started.add(run_id)
        return run_id

    def loaded(self, run_id: str) -> bool:
        """Whether the run was finished, and not as failed."""
        of_run = (F.col("run_id") == run_id) & (F.col("seq") == FINISH) & (F.col("status") != "failed")
        return not self.events().where(of_run).isEmpty()

    def finish(
        self,
        run_id: str,
        *,
        status: str,
        items_total: int = 0,
        items_success: int = 0,
        items_failed: int = 0,
        notes: str | None = None,
        at: Column | None = None,
    ) -> None:
        # Only a run that another ledger object started is sought in the events.
        if run_id not in self._started:
            known = self.events().where((F.col("run_id") == run_id) & (F.col("seq") == START))
            if known.isEmpty():
                raise ValueError(f"run {run_id!r} was never started")
        self._started.discard(run_id)
        outcome = self.spark.createDataFrame(
            [(run_id, status, items_total, items_success, items_failed, notes)],
            """run_id string, status string, items_total int, items_success int,
               items_failed int, notes string""",
        )
        self.append(finish_events(outcome, at if at is not None else F.current_timestamp()))
        if len(self.tail()) > TAIL_FILES:
            self.fold()
