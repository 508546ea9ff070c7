"""Connectors: JDBC against in-process Derby (no server, no port), CSV sink,
generic file reads, and the P3 rebalance."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortfold import AllOf, Leaf, RecordSource, run_cohort_job
from cohortfold.operators.records import RecordMapping, map_records, provided_source, rebalance
from cohortfold.sources.connection import Connection
from cohortfold.sources.files import CatalogConnection, FileConnection
from cohortfold.sources.jdbc import JdbcConnection


def derby(spark, partitions=4):
    name = f"cf{uuid.uuid4().hex[:8]}"
    return JdbcConnection(
        url=f"jdbc:derby:memory:{name};create=true",
        driver="org.apache.derby.iapi.jdbc.AutoloadedDriver",
        partitions=partitions,
        alias_clause="subq",
    )


def seed_table(spark, conn, rows=100):
    df = spark.range(rows).select(
        # Upper case: Spark quotes column names when it creates the table.
        F.col("id").alias("RID"),
        (F.col("id") % 7).cast("string").alias("PAT"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit("A")).alias("CODE"),
        (F.col("id") * 1.5).cast("decimal(10,2)").alias("AMOUNT"),
    )
    conn.write("recs", df)
    return df


def test_protocol():
    assert isinstance(FileConnection(), Connection)
    assert isinstance(JdbcConnection(url="jdbc:x"), Connection)


def test_jdbc_partitioned_read_keeps_nulls_and_append(spark):
    conn = derby(spark)
    seed_table(spark, conn)
    schema = T.StructType(
        [
            T.StructField("RID", T.LongType()),
            T.StructField("PAT", T.StringType()),
            T.StructField("CODE", T.StringType()),
            T.StructField("AMOUNT", T.DecimalType(10, 2)),
        ]
    )
    df = conn.read(spark, "SELECT * FROM recs WHERE rid >= 0", schema, id_column="rid")
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert len(rows) == 100
    assert sum(r.CODE is None for r in rows) == 20  # NULL stays NULL, not ""
    assert {str(r.AMOUNT) for r in rows if r.RID == 3} == {"4.50"}  # exact decimal
    single = JdbcConnection(url=conn.url, driver=conn.driver, alias_clause="subq").read(spark, "SELECT * FROM recs")
    assert single.rdd.getNumPartitions() == 1 and single.count() == 100
    seed_table(spark, conn)  # append doubles the rows
    assert conn.read(spark, "SELECT rid FROM recs").count() == 200


def test_jdbc_job_end_to_end(spark):
    conn = derby(spark, partitions=3)
    seed_table(spark, conn, rows=60)
    raw = conn.read(spark, "SELECT * FROM recs", id_column="rid")
    records = map_records(raw, RecordMapping("PAT", "RID", {"code": "CODE"}))
    res = run_cohort_job(
        spark, [RecordSource("ehr", "x", records)], AllOf(Leaf("A", "x", "code = 'A'")), "job"
    )
    out = derby(spark)
    spark.createDataFrame([], res.cohort.schema)  # schema is stable
    res.write(out)
    assert out.read(spark, "SELECT * FROM cohort").count() == 7
    assert out.read(spark, "SELECT * FROM evidence").count() == 48
    res.release()


def test_csv_sink_round_trip(spark):
    base = tempfile.mkdtemp(prefix="cf-csv-") + "/out_"
    conn = FileConnection(path=base)
    df = spark.createDataFrame([("a,b", 1.5, None), ("c", 2.0, "x")], "s string, d double, n string")
    conn.write("t", df)
    back = spark.read.csv(base + "t", schema="s string, d double, n string").collect()
    assert sorted(back, key=lambda r: r.s) == [("a,b", 1.5, None), ("c", 2.0, "x")]
    # No header line: every line is data.
    text = "".join(open(os.path.join(base + "t", f)).read() for f in os.listdir(base + "t") if f.endswith(".csv"))
    assert text.count("\n") == 2 and '"a,b"' in text


def test_generic_read_prunes_columns(spark):
    conn = FileConnection(path="/root/testdata/sf0.001/", format="parquet")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.StringType())])
    df = conn.read(spark, "orders.parquet", schema)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan.split("ReadSchema")[-1]
    assert df.count() == 1500


def test_rebalance(spark):
    assert rebalance(spark.range(100).coalesce(1), 4).rdd.getNumPartitions() == 4


def test_catalog_read_and_append(spark):
    conn = CatalogConnection()
    spark.range(10).selectExpr("id", "id % 3 AS k").createOrReplaceTempView("cf_numbers")
    schema = T.StructType([T.StructField("total", T.StringType()), T.StructField("k", T.LongType())])
    df = conn.read(spark, "SELECT k, sum(id) AS total, count(*) AS n FROM cf_numbers GROUP BY k", schema)
    assert sorted(df.collect()) == [("12", 1), ("15", 2), ("18", 0)]
    name = f"cf_sink_{uuid.uuid4().hex[:8]}"
    for _ in range(2):
        conn.write(name, df)
    assert spark.table(name).count() == 6
    spark.sql(f"DROP TABLE {name}")


def test_disabled_sources_are_never_read(spark):
    class Recording(CatalogConnection):
        def read(self, spark, query, schema=None, id_column=None):
            asked.append(query)
            return super().read(spark, query, schema, id_column)

    asked = []
    mapping = RecordMapping("p", "r", {"code": "c"})
    sources = [
        provided_source(spark, name, kind, Recording(), f"SELECT 'p1' AS p, '{name}' AS r, 'A' AS c", mapping)
        for name, kind in (("on", "x"), ("off", "x"), ("other", "y"))
    ]
    assert asked == []
    res = run_cohort_job(spark, sources, Leaf("A", "x", "code = 'A'"), "job", enabled_sources=["on", "other"], materialize=None)
    assert res.cohort.count() == 1 and asked == ["SELECT 'p1' AS p, 'on' AS r, 'A' AS c"]


def test_jdbc_options(spark):
    conn = derby(spark)
    conn.spread = 3
    assert conn._base_options()["fetchsize"] == "10000"
    seed_table(spark, conn, rows=40)
    assert conn.read(spark, "SELECT * FROM recs").rdd.getNumPartitions() == 3
    assert conn.read(spark, "SELECT * FROM recs", id_column="rid").rdd.getNumPartitions() == 4
    conn.write_connections = 2
    seed_table(spark, conn, rows=60)
    assert conn.read(spark, "SELECT * FROM recs").count() == 100


def test_release_deletes_intermediates(spark):
    from cohortfold.session import checkpoint_dir

    conn = derby(spark, partitions=2)
    seed_table(spark, conn, rows=30)
    records = map_records(conn.read(spark, "SELECT * FROM recs"), RecordMapping("PAT", "RID", {"code": "CODE"}))
    root = checkpoint_dir(spark).replace("file:", "") + "/cohortfold"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    res = run_cohort_job(spark, [RecordSource("ehr", "x", records)], Leaf("A", "x", "code = 'A'"), "job")
    created = set(os.listdir(root)) - before
    assert len(created) == 4  # records, terms, summary, scores
    assert res.cohort.count() == 7
    res.release()
    assert not created & set(os.listdir(root))


def test_csv_read_with_declared_schema(spark):
    base = tempfile.mkdtemp(prefix="cf-csv-") + "/"
    spark.createDataFrame([(1, "a"), (2, None)], "id long, s string").write.csv(base + "t")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType())])
    back = FileConnection(path=base, format="csv").read(spark, "t", schema)
    assert sorted(back.collect()) == [(1, "a"), (2, None)]


@pytest.mark.parametrize("names", [["id", "s", "d"], ["s", "d"], ["d", "s", "id"], ["D"]])
def test_csv_with_a_header_goes_by_name(spark, names):
    base = tempfile.mkdtemp(prefix="cf-csv-") + "/"
    spark.createDataFrame([(1, "a", 2.5), (2, "b", 3.5)], "id long, s string, d double").write.option("header", "true").csv(base + "t")
    kinds = {"id": T.LongType(), "s": T.StringType(), "d": T.DoubleType()}
    schema = T.StructType([T.StructField(n, kinds[n.lower()]) for n in names])
    back = FileConnection(path=base, format="csv", read_options={"header": "true"}).read(spark, "t", schema)
    rows = {"id": [1, 2], "s": ["a", "b"], "d": [2.5, 3.5]}
    assert sorted(map(tuple, back.collect())) == sorted(zip(*(rows[n.lower()] for n in names)))


def test_csv_never_guesses(spark):
    base = tempfile.mkdtemp(prefix="cf-csv-") + "/"
    spark.createDataFrame([("1", "a"), ("x", "b")], "id string, s string").write.option("header", "true").csv(base + "bad")
    spark.createDataFrame([(1, "a", 2.5)], "id long, s string, d double").write.csv(base + "wide")
    ids = T.StructType([T.StructField("id", T.LongType())])
    with pytest.raises(Exception, match="id does not parse: x"):
        FileConnection(path=base, format="csv", read_options={"header": "true"}).read(spark, "bad", ids).collect()
    with pytest.raises(ValueError, match="missing"):
        FileConnection(path=base, format="csv", read_options={"header": "true"}).read(
            spark, "bad", T.StructType([T.StructField("zz", T.LongType())])
        )
    with pytest.raises(Exception, match="(?i)malformed"):
        FileConnection(path=base, format="csv").read(spark, "wide", T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType())])).collect()


def test_failed_job_leaves_no_intermediates(spark):
    from cohortfold.session import checkpoint_dir

    good = map_records(spark.createDataFrame([("p1", "r1", "A")], "p string, r string, code string"),
                       RecordMapping("p", "r", {"code": "code"}))
    bad = map_records(spark.createDataFrame([(None, "r2", "A")], "p string, r string, code string"),
                      RecordMapping("p", "r", {"code": "code"}))
    root = checkpoint_dir(spark).replace("file:", "") + "/cohortfold"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with pytest.raises(Exception, match="NULL patient_uid"):
        run_cohort_job(spark, [RecordSource("g", "x", good), RecordSource("b", "x", bad)], Leaf("A", "x", "code = 'A'"), "job")
    created = set(os.listdir(root)) - before if os.path.isdir(root) else set()
    assert all(not os.listdir(os.path.join(root, d)) for d in created)
