"""Connections through Spark's Python data source interface (inventory S3, S6).

A ``Provider`` is what a store without a Spark connector has to offer: the schema
of a query's rows, the splits that they are read in, and a split's rows as Arrow
batches. ``register`` gives it a name; ``spark.read.format(name)`` then plans one
task a split and streams the batches, so no task holds a split and the driver
sees splits only. ``ProviderConnection`` is the same behind the connection seam.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cohortfold.operators.records import typed_projection


@runtime_checkable
class Provider(Protocol):
    """Sent to executors, so it holds settings and opens what it needs in its methods."""

    def schema(self, query: str) -> T.StructType:
        """Columns of the query's rows."""

    def splits(self, query: str) -> list[Any]:
        """Parts of the query's rows, each row in one; small values that can be pickled."""

    def batches(self, query: str, split: Any, columns: list[str]) -> Iterator[pa.RecordBatch]:
        """A split's rows with these columns of the schema, a batch of bounded size at a time."""


class _Split(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, provider: Provider, query: str, schema: T.StructType):
        self.provider, self.query, self.names = provider, query, schema.names

    def partitions(self) -> list[InputPartition]:
        # Without any split Spark would ask for one without a value.
        return [_Split(s) for s in self.provider.splits(self.query)] or [_Split(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        for batch in self.provider.batches(self.query, partition.value, self.names):
            yield batch.select(self.names)


def register(spark: SparkSession, name: str, provider: Provider) -> None:
    """Make ``spark.read.format(name).option("query", query)`` read from ``provider``.

    ``schema`` of the reader, if given, names the columns to be read, with the
    types that the provider tells.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return provider.schema(self.options.get("query", ""))

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(provider, self.options.get("query", ""), schema)

    # Executors need not have this package installed.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Source)


@dataclass
class ProviderConnection:
    """Queries to a provider that is registered as ``name``; reads only."""

    name: str
    options: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, query: str, schema: T.StructType | None = None, id_column: str | None = None) -> DataFrame:
        """The query's rows, projected to ``schema`` if given: of a provider's
        columns only those that it names are read. ``id_column`` is unused: the
        provider plans the splits."""
        reader = spark.read.format(self.name).options(**self.options).option("query", query)
        if schema is None:
            return reader.load()
        told = reader.load().schema
        wanted = {f.name.lower() for f in schema.fields}
        return typed_projection(reader.schema(T.StructType([f for f in told.fields if f.name.lower() in wanted])).load(), schema)

    def write(self, table: str, df: DataFrame) -> None:
        raise NotImplementedError("a provider is read only")


@dataclass
class ParquetRowGroups:
    """Parquet files by row group: a query is a path under ``root`` on a file system that pyarrow opens."""

    root: str = ""
    batch_rows: int = 10_000

    def _dataset(self, query: str):
        import pyarrow.dataset

        return pyarrow.dataset.dataset(f"{self.root}{query}", format="parquet")

    def schema(self, query: str) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._dataset(query).schema)

    def splits(self, query: str) -> list[tuple[int, int]]:
        return [(i, group.id) for i, f in enumerate(sorted(self._dataset(query).get_fragments(), key=lambda f: f.path)) for group in f.row_groups]

    def batches(self, query: str, split: tuple[int, int], columns: list[str]) -> Iterator[pa.RecordBatch]:
        place, group = split
        fragment = sorted(self._dataset(query).get_fragments(), key=lambda f: f.path)[place].subset(row_group_ids=[group])
        yield from fragment.to_batches(columns=columns, batch_size=self.batch_rows)
