"""A provider read through Spark's Python data source interface."""

import random
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import types as T

from cohortfold.sources.connection import Connection
from cohortfold.sources.provider import ParquetRowGroups, Provider, ProviderConnection, register

SF = "/root/testdata/sf0.01/"


def numbers() -> Provider:
    """A class of a function's own goes to the workers by value; this module is not there."""

    class Numbers:
        # The query is how many rows there are, in splits of seven.
        def schema(self, query: str) -> T.StructType:
            return T.StructType([T.StructField("n", T.LongType()), T.StructField("text", T.StringType()), T.StructField("odd", T.BooleanType())])

        def splits(self, query: str) -> list[tuple[int, int]]:
            return [(a, min(a + 7, int(query))) for a in range(0, int(query), 7)]

        def batches(self, query: str, split: tuple[int, int], columns: list[str]) -> Iterator[pa.RecordBatch]:
            assert columns == ["n", "odd"] or len(columns) == 3
            kinds = pa.schema([("n", pa.int64()), ("text", pa.string()), ("odd", pa.bool_())])
            for n in range(*split):
                yield pa.RecordBatch.from_pylist([{"n": n, "text": None if n % 3 else f"t{n}", "odd": n % 2 == 1}], schema=kinds)

    return Numbers()


def test_splits_and_projection(spark):
    assert isinstance(numbers(), Provider) and isinstance(ProviderConnection("numbers"), Connection)
    register(spark, "numbers", numbers())
    df = spark.read.format("numbers").option("query", "40").load()
    assert df.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, df.collect())) == [(n, None if n % 3 else f"t{n}", n % 2 == 1) for n in range(40)]
    schema = T.StructType([T.StructField("ODD", T.StringType()), T.StructField("n", T.DecimalType(9, 1))])
    told = ProviderConnection("numbers").read(spark, "9", schema)
    assert told.columns == ["ODD", "n"] and sorted((int(r.n), r.ODD) for r in told.collect()) == [(n, str(n % 2 == 1).lower()) for n in range(9)]
    assert spark.read.format("numbers").option("query", "0").load().count() == 0


def test_parquet_by_row_group(spark, tmp_path):
    rng = random.Random(2)
    table = pa.table({"k": list(range(500)), "v": [rng.choice([None, "x", "y"]) for _ in range(500)], "l": [[i, None] for i in range(500)]})
    for part in range(3):
        pq.write_table(table.slice(part * 160, 160 + 20 * (part == 2)), tmp_path / f"part{part}.parquet", row_group_size=50)
    register(spark, "row_groups", ParquetRowGroups(f"{tmp_path.parent}/", batch_rows=13))
    df = ProviderConnection("row_groups").read(spark, tmp_path.name)
    assert df.rdd.getNumPartitions() == 12
    assert sorted((r.k, r.v, r.l) for r in df.collect()) == [(r["k"], r["v"], r["l"]) for r in table.to_pylist()]


def test_given_table(spark):
    register(spark, "given_tables", ParquetRowGroups(SF))
    assert ProviderConnection("given_tables").read(spark, "orders.parquet").exceptAll(spark.read.parquet(f"{SF}orders.parquet")).count() == 0
