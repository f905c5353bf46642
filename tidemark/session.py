"""Session builder for local runs, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session, with a checkpoint folder of its own unless one is given.

    On a cluster, use the session the cluster gives you instead.
    """
    if "spark.checkpoint.dir" not in conf:
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="tidemark-")
    local_cores = os.cpu_count() if cores == "*" else int(cores)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(local_cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Settings of the session for what is written inside, and those it had before afterwards."""
    held = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: A write's shuffle files go when it ends, not when the driver happens to collect its garbage: a job writes a
#: table several times over, and the disk would hold the shuffles of all these writes at once.
RELEASED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables a job writes, below the session's shared checkpoint folder.

    That folder is the one the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local
    session is given a checkpoint folder, once, and a cluster is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
