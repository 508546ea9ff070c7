"""The connection seam (inventory S6).

A connection reads a query into a DataFrame with a declared schema and writes
a DataFrame to a named table. Implementations: ``JdbcConnection`` (S1, S5),
``FileConnection`` (S3 generic reads, S4 delimited text sink),
``CatalogConnection`` (query text over the session's tables) and
``ProviderConnection`` (stores without a Spark connector, read by Arrow batches).
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@runtime_checkable
class Connection(Protocol):
    def read(
        self,
        spark: SparkSession,
        query: str,
        schema: T.StructType | None = None,
        id_column: str | None = None,
    ) -> DataFrame: ...

    def write(self, table: str, df: DataFrame) -> None: ...
