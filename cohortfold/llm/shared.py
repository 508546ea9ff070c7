"""Written intermediate tables, and Python code on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import cohortfold
from cohortfold.session import checkpoint_dir, delete_path, write_intermediate


class Scratch:
    """Tables of one operator run, written under ``spark.checkpoint.dir``.

    A written table cuts lineage (a lost executor costs a re-read, not a
    recomputation) and gives Spark an exact size for its join choice.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, self._paths[name] = write_intermediate(df, name)
        return out

    def path(self, name: str) -> str:
        """A new folder for files that are written otherwise."""
        out = f"{checkpoint_dir(self.spark).rstrip('/')}/cohortfold/{uuid.uuid4().hex}/{name}"
        self._paths[name] = out
        return out

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            delete_path(self.spark, self._paths.pop(name))

    def tidy(self) -> None:
        """Let the context cleaner delete shuffle files of finished steps now.

        It acts when the driver's JVM collects its garbage, which may be long
        after a step's tables are written; until then its shuffle files stay.
        """
        self.spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(cohortfold.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="cohortfold-")) / "cohortfold.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
