"""Session defaults and the few helpers every operator shares."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose count has been taken may be broadcast.
BROADCAST_ROWS = 500_000


def local_session(cpus: int = 4, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("leafmill")
    defaults = {
        "spark.sql.shuffle.partitions": str(max(8, cpus)),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with files in the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset
    in a local session, as in tests, a temporary folder is used; a cluster must name one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leafmill-checkpoint-"))
    return df.checkpoint()


def spread(df: DataFrame) -> int:
    """Partitions for work that is heavy for its bytes: some for every core, and no fewer than ``df`` is read in."""
    context = df.sparkSession.sparkContext
    return max(3 * context.defaultParallelism, df.rdd.getNumPartitions())


def small_or_shuffled(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows stay within ``limit``.

    ``df`` should be checkpointed, so that counting reads its files only. Above
    the limit it comes back unmarked and the planner shuffles it.
    """
    count = df.count() if rows is None else rows
    return F.broadcast(df) if count <= limit else df


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """One parquet table of a data folder, cut to ``columns`` if they are given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
