"""Spark session defaults and the shared folder for intermediate tables.

The engine never builds its own session in library code; callers pass one in.
``build_session`` exists for tests, the benchmark and local use.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Settings every run wants: AQE re-plans joins from runtime sizes (broadcast
# conversion is then size-checked by Spark), splits skewed join partitions,
# and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "cohortfold",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Uses the directory the cluster names in ``spark.checkpoint.dir`` (or one
    already set on the context). Only a local-mode session without one gets a
    private temporary folder; a cluster session without one is an error,
    because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS, S3, ...) before running cohort jobs on a cluster"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cohortfold-ckpt-"))
    return sc.getCheckpointDir()


def write_intermediate(df: DataFrame, name: str, split: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    ``split`` names a column whose values become partitions of the files.
    This cuts lineage: later actions read the written table instead of
    recomputing the plan (and rescanning the sources) after a lost executor.
    Returns the re-read DataFrame and the path, so callers can delete it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cohortfold/{uuid.uuid4().hex}/{name}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).parquet(path)
    # The written schema, not one read back: no file has to say it.
    return spark.read.schema(df.schema).parquet(path), path


def write_bucketed(df: DataFrame, name: str, key: str, split: str) -> tuple[DataFrame, Callable[[], None]]:
    """Write ``df`` bucketed by ``key`` and partitioned by ``split`` under the
    checkpoint folder, and read it back as a catalog table.

    Joins and aggregates on ``key`` over the result need no shuffle; a filter on
    ``split`` reads that partition alone. ``df`` is best partitioned by ``key``
    into as many partitions as the session shuffles into: then a task writes one
    bucket. Returns the table's rows and how to delete it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cohortfold/{uuid.uuid4().hex}/{name}"
    table = f"cohortfold_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).partitionBy(split).bucketBy(buckets, key).saveAsTable(table)

    def delete() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_path(spark, path)

    return spark.table(table), delete


def delete_path(spark: SparkSession, path: str) -> None:
    """Recursively delete ``path`` on whatever Hadoop filesystem holds it, and
    its parent if that was made for it (see ``write_intermediate``)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hpath, True)
    parent = hpath.getParent()
    if parent.getParent().getName() == "cohortfold" and fs.exists(parent) and not fs.listStatus(parent):
        fs.delete(parent, False)
