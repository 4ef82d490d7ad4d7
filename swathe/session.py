"""Session helpers: defaults for local runs and the checkpoint location."""

from __future__ import annotations

import functools
import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("swathe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", _local_dir())
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``. ``local_session`` sets one of its own; a cluster
    must name one, since a machine-local folder would be lost with its executor."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return _local_dir()
    raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")


@functools.cache
def _local_dir() -> str:
    """One folder for a driver that is its own only executor."""
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return plain(df.checkpoint(eager=True))


def plain(df: DataFrame) -> DataFrame:
    """The same rows, of whose origin the optimizer knows nothing.

    A checkpoint still knows which filters its columns passed. Where these stand on columns computed from a join key,
    Spark would compute them anew from the key of each row of the other side, for instance for each pixel.
    """
    return df.select(F.inline(F.array(F.struct("*"))))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


TASK_ROWS = 500_000


def width_for(spark: SparkSession, rows: float) -> int:
    """Partitions so that a task holds about ``TASK_ROWS`` rows. Pixel rows compress so well that partitions sized by
    bytes hold many millions of them."""
    return max(shuffle_width(spark), math.ceil(rows / TASK_ROWS))
