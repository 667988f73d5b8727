"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and hand-over tables.

    A machine-local folder is only accepted on a local master, where the driver
    and the tasks are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def hand_over(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and continue from it.

    Cuts the lineage like a checkpoint, and later readers get columns, sizes and filters.
    """
    path, schema = scratch_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of heavy work that a task should have at most.
SPREAD_ROWS = 500_000


def spread(df: DataFrame, task_rows: int = SPREAD_ROWS) -> DataFrame:
    """Deal the rows of a scan out evenly, where its splits do not.

    For heavy work per row over a few files. A split holds the row groups that begin in it, so
    a scan with many splits may still have all its rows in a few of them: the rows of each are
    counted, which reads no column. A scan whose splits are even and small is left alone,
    without any shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    most, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    if rows is None or (most <= 2 * task_rows and most * cores <= 2 * rows):
        return df
    return df.repartition(max(cores, -(-rows // task_rows)))
