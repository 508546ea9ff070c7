"""File-based reads and writes (inventory S3, S4).

``FileConnection`` reads any Spark data source format by path and writes
delimited text, one folder per table under ``path + table``. Spark quotes
values that contain the delimiter and writes NULL as an empty field, where the
original joined raw values with commas. ``CatalogConnection`` reads query text
over the session's tables and views and appends to its tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortfold.operators.records import parsed_projection, typed_projection
from cohortfold.session import delete_path


@dataclass
class FileConnection:
    path: str = ""
    format: str = "parquet"
    read_options: dict[str, str] = field(default_factory=dict)
    delimiter: str = ","
    write_format: str = "csv"
    write_mode: str = "append"

    def location(self, name: str) -> str:
        return f"{self.path}{name}"

    def read(
        self,
        spark: SparkSession,
        query: str,
        schema: T.StructType | None = None,
        id_column: str | None = None,
    ) -> DataFrame:
        """Read the dataset at ``path + query``; project to ``schema`` if given.

        Only the schema's columns reach the scan (column pruning), and later
        filters are pushed into it. ``id_column`` is unused: file splits
        already parallelise the scan.

        Text formats never guess. CSV with a header takes the names from it
        and the schema's columns by name, in any order; without one the schema
        must be the whole file's. JSON goes by name. A cell that does not
        parse, or a CSV row of another width, fails its task.
        """
        reader = spark.read.format(self.format).options(**self.read_options)
        if schema is not None and self.format == "csv":
            reader = reader.option("mode", "FAILFAST").option("columnPruning", "false")
            header = str({k.lower(): v for k, v in self.read_options.items()}.get("header", "")).lower() == "true"
            if header:
                return parsed_projection(reader.load(self.location(query)), schema)
            return reader.schema(schema).load(self.location(query))
        if schema is not None and self.format == "json":
            return reader.option("mode", "FAILFAST").schema(schema).load(self.location(query))
        df = reader.load(self.location(query))
        return typed_projection(df, schema) if schema is not None else df

    def write(self, table: str, df: DataFrame) -> None:
        writer = df.write.mode(self.write_mode).format(self.write_format)
        if self.write_format == "csv":
            writer = writer.option("header", "false").option("sep", self.delimiter)
        writer.save(self.location(table))

    def publish(self, spark: SparkSession, job_uid: str, tables: Mapping[str, DataFrame]) -> None:
        """Write a job's ``tables`` so that they appear together, and once.

        An attempt writes to folders of its own (Parquet); one marker file then
        names it as the job's. ``committed`` reads what markers name, so an
        attempt that dies shows nothing, and of several that end only the first
        to set the marker counts. A job that is published already is left as it is.
        """
        job = "job_" + quote(job_uid, safe="").replace("%", "=")
        if job in self._published(spark):
            return
        attempt = uuid.uuid4().hex
        for table, df in tables.items():
            df.write.parquet(f"{self.location(table)}/{job}/{attempt}")
        if not _set_marker(spark, f"{self._markers}/{job}", f"{job} {attempt}"):
            for table in tables:
                delete_path(spark, f"{self.location(table)}/{job}/{attempt}")

    def committed(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        """Rows of ``table`` of all published jobs."""
        paths = [f"{self.location(table)}/{job}/{attempt}" for job, attempt in self._published(spark).items()]
        paths = [p for p in paths if _exists(spark, p)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    @property
    def _markers(self) -> str:
        return f"{self.path}published_jobs"

    def _published(self, spark: SparkSession) -> dict[str, str]:
        """The attempt that counts, of each published job."""
        if not _exists(spark, self._markers):
            return {}
        return dict(r[0].split(" ") for r in spark.read.text(f"{self._markers}/job_*").collect())


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _set_marker(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` with ``text`` in one step, by renaming; False if there is one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"draft_{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    try:
        context.rename(draft, target, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
            raise
        return False
    finally:
        target.getFileSystem(conf).delete(draft, False)
    return True


@dataclass
class CatalogConnection:
    """Query text over catalog tables and views; appends to catalog tables."""

    write_mode: str = "append"

    def read(
        self,
        spark: SparkSession,
        query: str,
        schema: T.StructType | None = None,
        id_column: str | None = None,
    ) -> DataFrame:
        """The query's rows, projected to ``schema`` if given. ``id_column`` is
        unused: the tables' own splits parallelise the scan."""
        df = spark.sql(query)
        return typed_projection(df, schema) if schema is not None else df

    def write(self, table: str, df: DataFrame) -> None:
        df.write.mode(self.write_mode).saveAsTable(table)
