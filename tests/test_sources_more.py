"""Nested projections, code hierarchies, quantile splits and outputs that appear once."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortfold import AnyOf, Leaf, RecordSource, run_cohort_job
from cohortfold.operators.hierarchy import CodeHierarchy
from cohortfold.operators.records import typed_projection
from cohortfold.sources.files import FileConnection
from cohortfold.sources.jdbc import JdbcConnection


def fields(text):
    return T._parse_datatype_string(text)


def test_nested_fields_go_by_name(spark):
    df = spark.createDataFrame(
        [((1, "x", [(1, "p"), None]), {"k": (5, "v")}), (None, None), ((None, None, None), {})],
        "s struct<a:int,b:string,c:array<struct<u:int,v:string>>>, m map<string,struct<q:int,r:string>>",
    )
    want = fields("m map<string,struct<r:string,q:bigint>>, s struct<C:array<struct<v:string,u:string>>,b:string,a:double>")
    out = typed_projection(df, want)
    assert [f.dataType.simpleString().lower() for f in out.schema] == [f.dataType.simpleString().lower() for f in want]
    rows = [r.asDict(True) for r in out.collect()]
    assert rows[0] == {"m": {"k": {"r": "v", "q": 5}}, "s": {"C": [{"v": "p", "u": "1"}, None], "b": "x", "a": 1.0}}
    assert rows[1] == {"m": None, "s": None} and rows[2] == {"m": {}, "s": {"C": None, "b": None, "a": None}}


def test_missing_and_ambiguous_nested_fields_are_named(spark):
    df = spark.createDataFrame([((1, 2),)], "s struct<a:int,b:int>")
    with pytest.raises(ValueError, match="missing.*s.z"):
        typed_projection(df, fields("s struct<z:int>"))
    df = spark.createDataFrame([((1, 2),)], "s struct<aa:int,aA:int>")
    with pytest.raises(ValueError, match="ambiguous.*s.AA"):
        typed_projection(df, fields("s struct<AA:int>"))


def test_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([(1, (2,))], T.StructType([T.StructField("a.b", T.IntegerType()), T.StructField("c`d", T.StructType([T.StructField("e.f", T.IntegerType())]))]))
    out = typed_projection(df, T.StructType([T.StructField("c`d", T.StructType([T.StructField("e.f", T.LongType())])), T.StructField("a.b", T.StringType())]))
    assert tuple(out.first()) == ((2,), "1")


def closure(edges, roots):
    seen, todo = set(roots), list(roots)
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_expanded_codes_against_a_walk(spark):
    rng = random.Random(4)
    edges = [(f"c{rng.randrange(60)}", f"c{rng.randrange(60)}") for _ in range(70)] + [("c1", "c1"), ("a", "b"), ("b", "a")] * 2
    roots = [("g1", "c0"), ("g1", "c5"), ("g2", "a"), ("g3", "alone"), ("g4", "c1")]
    hierarchy = CodeHierarchy(spark.createDataFrame(edges + [(None, "c0"), ("c0", None)], "up string, down string"), "up", "down")
    got = [tuple(r) for r in hierarchy.expand(spark.createDataFrame(roots + [("g5", None)], "group string, code string")).collect()]
    want = {(g, c) for g in {g for g, _ in roots} for c in closure(edges, [c for h, c in roots if h == g])}
    assert len(got) == len(set(got)) and set(got) == want
    hierarchy.release()


def test_a_leaf_takes_a_root_code(spark):
    hierarchy = CodeHierarchy(spark.createDataFrame([("E", "E1"), ("E1", "E11"), ("E11", "E")], "parent string, child string"))
    records = spark.createDataFrame([("p1", "r1", "E11"), ("p1", "r2", "X"), ("p2", "r3", "E"), ("p3", "r4", None)], "patient_uid string, record_uid string, code string")
    leaves = hierarchy.leaves(spark, "x", {"under e": ["E1"], "x too": ["X", "E11"]})
    res = run_cohort_job(spark, [RecordSource("s", "x", records)], AnyOf(*leaves), "j")
    found = {(r.node_uid, r.evidence_uid) for r in res.evidence.collect()}
    assert found == {("UNDER E", "r1"), ("UNDER E", "r3"), ("X TOO", "r1"), ("X TOO", "r2"), ("X TOO", "r3")}
    res.release()
    hierarchy.release()


def derby(**options):
    name = f"cf{uuid.uuid4().hex[:8]}"
    return JdbcConnection(
        url=f"jdbc:derby:memory:{name};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", alias_clause="subq",
        like_clause="WITH NO DATA", **options,
    )


def test_quantile_splits_of_clustered_ids(spark):
    conn = derby(partitions=6, split="quantile")
    ids = [*range(3000), *range(10**12, 10**12 + 500), 10**15, *[77] * 50]
    df = spark.createDataFrame([(i, "a") for i in ids] + [(None, "none")], "RID long, V string")
    conn.write("recs", df.coalesce(1))
    read = conn.read(spark, "SELECT * FROM recs", id_column="rid")
    sizes = sorted(r["n"] for r in read.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    assert read.rdd.getNumPartitions() == 6 and len(sizes) == 6
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert sorted(-1 if r.RID is None else r.RID for r in read.collect()) == sorted([*ids, -1])
    ranges = JdbcConnection(url=conn.url, driver=conn.driver, alias_clause="subq", partitions=6).read(spark, "SELECT * FROM recs", id_column="rid")
    assert ranges.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] > 3000  # what equal widths give


def test_quantile_splits_of_one_id_few_rows_and_none(spark):
    conn = derby(partitions=4, split="quantile")
    conn.write("alike", spark.createDataFrame([(5,)] * 40, "RID long"))
    assert conn.read(spark, "SELECT * FROM alike", id_column="rid").count() == 40
    conn.write("few", spark.createDataFrame([(-9223372036854775808,), (9223372036854775807,), (0,)], "RID long"))
    conn.write("empty_one", spark.createDataFrame([], "RID long"))
    assert conn.read(spark, "SELECT * FROM empty_one", id_column="rid").count() == 0
    assert conn.read(spark, "SELECT * FROM few WHERE rid >= 0", id_column="rid").count() == 2


def job(spark, uid, boom=False):
    records = spark.createDataFrame([(f"p{i % 5}", f"r{i}", "A") for i in range(40)], "patient_uid string, record_uid string, code string")
    res = run_cohort_job(spark, [RecordSource("s", "x", records)], AnyOf(Leaf("A", "x", "code = 'A'")), uid)
    if boom:  # the evidence dies half-way, after the cohort is written
        broken = F.when(F.col("evidence_uid") == "r39", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("evidence_uid"))
        res.evidence = res.evidence.withColumn("evidence_uid", broken)
    return res


def publish(spark, connection, uid, boom=False):
    res = job(spark, uid, boom)
    try:
        res.publish(connection)
    finally:
        res.release()


def test_files_appear_together_and_once(spark, tmp_path):
    connection = FileConnection(path=f"{tmp_path}/out/")
    res = job(spark, "j/1")
    read = lambda: [connection.committed(spark, t, s.schema).count() for t, s in (("cohort", res.cohort), ("evidence", res.evidence))]
    assert read() == [0, 0]
    with pytest.raises(Exception, match="killed"):
        publish(spark, connection, "j/1", boom=True)
    assert read() == [0, 0]
    publish(spark, connection, "j/1")
    assert read() == [5, 40]
    publish(spark, connection, "j/1")  # a retry after success changes nothing
    assert read() == [5, 40]
    publish(spark, connection, "j2")
    assert read() == [10, 80]
    res.release()


def test_the_first_marker_counts(spark, tmp_path):
    from cohortfold.sources.files import _set_marker

    path = f"{tmp_path}/markers/job_x"
    assert _set_marker(spark, path, "job_x one") and not _set_marker(spark, path, "job_x two")
    assert spark.read.text(path).collect()[0][0] == "job_x one"


def test_database_tables_change_in_one_transaction(spark):
    connection = derby()
    count = lambda t: connection.read(spark, f"SELECT * FROM {t}").count()
    publish(spark, connection, "first")
    assert (count("cohort"), count("evidence")) == (5, 40)
    with pytest.raises(Exception, match="killed"):
        publish(spark, connection, "second", boom=True)
    assert (count("cohort"), count("evidence")) == (5, 40)
    publish(spark, connection, "second")
    publish(spark, connection, "second")
    assert (count("cohort"), count("evidence")) == (10, 80)
    left = connection.read(spark, "SELECT tablename FROM sys.systables WHERE tabletype = 'T'").collect()
    assert sorted(r[0].lower() for r in left) == ["cohort", "evidence"]
