"""JDBC reads and appends (inventory S1, S5).

Reads wrap the source query as a derived table and, given a whole-number id
column, split it into ``partitions`` id ranges read in parallel. ``split`` says
where: at equal distances between the smallest and the largest id (one
``min/max`` query), or at quantiles, so that ranges hold about as many rows
however ids cluster. Quantiles come from a histogram that the database makes:
cells that hold too many rows are counted again in finer ones, a query a round,
until they do not. A read that stays one range is spread afterwards. Rows are
fetched ``fetch_size`` at a time. Writes append through Spark's JDBC writer, batched per partition, over at
most ``write_connections`` connections.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortfold.operators.records import rebalance, typed_projection

#: Histogram cells per split, and by how much cells get finer from round to round.
_CELLS = 64
_JOB_UID_LENGTH = 255


@dataclass
class JdbcConnection:
    url: str
    driver: str | None = None
    user: str | None = None
    password: str | None = None
    partitions: int = 1
    # Ranges of equal width ("range") or of equal row counts ("quantile").
    split: str = "range"
    fetch_size: int = 10_000
    write_connections: int = 16
    # Partitions that a one-range read is dealt out to; None leaves it in one.
    spread: int | None = None
    # Derived-table alias; some databases (Oracle) reject the "AS" keyword.
    alias_clause: str = "AS subq"
    # Ends CREATE TABLE ... AS SELECT without rows, as the database words it.
    like_clause: str = "WHERE 1 = 0"
    options: dict[str, str] = field(default_factory=dict)

    def _base_options(self) -> dict[str, str]:
        opts = {"url": self.url, "fetchsize": str(self.fetch_size)}
        if self.driver:
            opts["driver"] = self.driver
        if self.user is not None:
            opts["user"] = self.user
        if self.password is not None:
            opts["password"] = self.password
        opts.update(self.options)
        return opts

    def _derived(self, query: str) -> str:
        return f"({query}) {self.alias_clause}"

    def id_bounds(self, spark: SparkSession, query: str, id_column: str) -> tuple[int, int] | None:
        """min and max of the id column, from a one-row query run by the database."""
        bounds_sql = f"SELECT MIN({id_column}) AS lo, MAX({id_column}) AS hi FROM {self._derived(query)}"
        row = (
            spark.read.format("jdbc")
            .options(**self._base_options())
            .option("dbtable", self._derived(bounds_sql))
            .load()
            .first()
        )
        if row is None or row[0] is None:
            return None
        return int(row[0]), int(row[1])

    def _rows(self, spark: SparkSession, sql: str) -> list:
        """Rows of a query that the database runs."""
        return spark.read.format("jdbc").options(**self._base_options()).option("dbtable", self._derived(sql)).load().collect()

    def id_histogram(self, spark: SparkSession, query: str, id_column: str) -> list[tuple[int, int, int]]:
        """(low, high, rows) of id ranges in order; none holds more than a
        quarter of a split's share, unless it is a single id. Ids that are null are not counted.

        A round has at most some hundred cells a split, whatever the table's size.
        """
        bounds = self.id_bounds(spark, query, id_column)
        if bounds is None:
            return []
        low, high = bounds
        # A power of two, and so are finer ones: cells of a round lie within one of the last.
        width = 1 << max(0, ((high - low) // (_CELLS * self.partitions)).bit_length())
        ranges, done, total = [(low, high)], [], None
        while ranges:
            within = " OR ".join(f"({id_column} BETWEEN {a} AND {b})" for a, b in ranges)
            # Whole-number division; low is the smallest id, so nothing is negative.
            cell = f"SELECT ({id_column} - {low}) / {width} AS c FROM {self._derived(query)} WHERE {within}"
            counts = self._rows(spark, f"SELECT c, COUNT(*) AS n FROM ({cell}) {self.alias_clause}_cells GROUP BY c")
            cells = [(low + int(c) * width, low + (int(c) + 1) * width - 1, int(n)) for c, n in counts]
            total = total if total is not None else sum(n for _, _, n in cells)
            heavy = {c for c in cells if width > 1 and 4 * c[2] * self.partitions > total}
            done += [c for c in cells if c not in heavy]
            ranges = [(a, b) for a, b, _ in sorted(heavy)]
            width = max(1, width // _CELLS)
        return sorted(done)

    def quantile_splits(self, spark: SparkSession, query: str, id_column: str) -> list[int]:
        """Ids at which each split but the first begins."""
        cells = self.id_histogram(spark, query, id_column)
        total, before, starts = sum(n for _, _, n in cells), 0, []
        for low, _, n in cells:
            # A split ends at the cell that brings it nearer to its share than the next would.
            if before + n / 2 > total * (len(starts) + 1) / self.partitions and before > 0 and len(starts) < self.partitions - 1:
                starts.append(low)
            before += n
        return starts

    def read(
        self,
        spark: SparkSession,
        query: str,
        schema: T.StructType | None = None,
        id_column: str | None = None,
    ) -> DataFrame:
        if self.split not in ("range", "quantile"):
            raise ValueError("split must be 'range' or 'quantile'")
        reader = spark.read.format("jdbc").options(**self._base_options())
        reader = reader.option("dbtable", self._derived(query))
        df = None
        if id_column and self.partitions > 1 and self.split == "quantile":
            starts = self.quantile_splits(spark, query, id_column)
            if starts:
                ends = [f"{id_column} < {starts[0]} OR {id_column} IS NULL"]
                ends += [f"{id_column} >= {a} AND {id_column} < {b}" for a, b in zip(starts, starts[1:])]
                predicates = [*ends, f"{id_column} >= {starts[-1]}"]
                options = self._base_options()
                df = spark.read.jdbc(options.pop("url"), self._derived(query), predicates=predicates, properties=options)
        elif id_column and self.partitions > 1:
            bounds = self.id_bounds(spark, query, id_column)
            if bounds is not None:
                df = (
                    reader.option("partitionColumn", id_column)
                    .option("lowerBound", str(bounds[0]))
                    .option("upperBound", str(bounds[1] + 1))
                    .option("numPartitions", str(self.partitions))
                    .load()
                )
        if df is None:
            df = reader.load()
            if self.spread:
                df = rebalance(df, self.spread)
        return typed_projection(df, schema) if schema is not None else df

    def publish(self, spark: SparkSession, job_uid: str, tables: Mapping[str, DataFrame]) -> None:
        """Replace a job's rows in all ``tables`` (which have a ``job_uid``) at once.

        Rows are written to staging tables of this attempt, then one transaction
        deletes the job's old rows and takes over the staged ones, in every
        table. An attempt that dies before that leaves the tables as they were,
        and a repeated one leaves each row once.
        """
        attempt = uuid.uuid4().hex[:12]
        staged = {table: f"{table}_{attempt}" for table in tables}
        try:
            for table, df in tables.items():
                # Large-object text, as some databases get by default, cannot be compared.
                self._append(staged[table], df, createTableColumnTypes=f"job_uid VARCHAR({_JOB_UID_LENGTH})")
            with self._connection(spark) as connection:
                connection.setAutoCommit(False)
                try:
                    for table, df in tables.items():
                        self._ensure(connection, table, staged[table])
                        deleted = connection.prepareStatement(f"DELETE FROM {table} WHERE {self._name('job_uid')} = ?")
                        deleted.setString(1, job_uid)
                        deleted.executeUpdate()
                        names = ", ".join(map(self._name, df.columns))
                        connection.createStatement().executeUpdate(f"INSERT INTO {table} ({names}) SELECT {names} FROM {staged[table]}")
                    connection.commit()
                except BaseException:
                    connection.rollback()
                    raise
        finally:
            with self._connection(spark) as connection:
                for name in staged.values():
                    if self._exists(connection, name):
                        connection.createStatement().executeUpdate(f"DROP TABLE {name}")

    @staticmethod
    def _name(column: str) -> str:
        # Spark's writer quotes the names of the tables it makes.
        return '"' + column.replace('"', '""') + '"'

    @contextmanager
    def _connection(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        if self.driver:
            jvm.java.lang.Class.forName(self.driver)
        properties = jvm.java.util.Properties()
        for key, value in self._base_options().items():
            if key != "url":
                properties.setProperty(key, value)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            yield connection
        finally:
            connection.close()

    @staticmethod
    def _exists(connection, table: str) -> bool:
        found = connection.getMetaData().getTables(None, None, None, None)
        try:
            while found.next():
                if found.getString("TABLE_NAME").lower() == table.lower():
                    return True
            return False
        finally:
            found.close()

    def _ensure(self, connection, table: str, like: str) -> None:
        """Make ``table`` with the columns of ``like`` if it is not there."""
        if not self._exists(connection, table):
            connection.createStatement().executeUpdate(f"CREATE TABLE {table} AS SELECT * FROM {like} {self.like_clause}")

    def write(self, table: str, df: DataFrame) -> None:
        self._append(table, df)

    def _append(self, table: str, df: DataFrame, **options: str) -> None:
        writer = df.write.format("jdbc").options(**self._base_options()).options(**options)
        writer.option("dbtable", table).option("numPartitions", str(self.write_connections)).mode("append").save()
