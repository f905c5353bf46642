"""Incremental delivery: every new Bronze file goes through a job once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.jobs import Lake, Moment
from tidemark.sources.bronze import read_envelopes

Job = Callable[..., int]


def load_new_files(
    spark: SparkSession,
    lake: Lake,
    path: str,
    payload: str,
    job: Job,
    moment: Moment,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Run ``job`` on the files below ``path`` that no earlier call with this checkpoint has seen.

    The stream only tells which files are new; state lives in the tables. A batch's run is named by
    the checkpoint and the batch's number. One that is delivered again after its run was loaded is left
    alone; one whose run failed or broke off is run again under the same name, so the ledger, Silver
    and the rejects hold it once.
    """
    envelopes = read_envelopes(spark, path, payload, stream=True, files_per_batch=files_per_batch)

    def handle(batch: DataFrame, number: int) -> None:
        load_batch(lake, batch, number, job, moment, checkpoint)

    return (
        envelopes.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def load_batch(
    lake: Lake, batch: DataFrame, number: int, job: Job, moment: Moment, checkpoint: str
) -> bool:
    """Run ``job`` on one batch of a stream unless its run was loaded before. Returns whether it ran."""
    spark = batch.sparkSession
    run_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{checkpoint}#{number}").hex
    if lake.ledger(spark).loaded(run_id):
        return False
    job(spark, lake, batch, moment, run_id=run_id)
    return True
