"""The predicate index, pattern counting and the layout of intermediates."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortfold import AnyOf, Leaf, RecordSource, run_cohort_job
from cohortfold.operators.matching import LeafMatcher, coded_counts, criteria_matches
from cohortfold.operators.predicates import Patterns, comparison
from cohortfold.operators.scoring import score_leaves

SCHEMA = T.StructType([
    T.StructField("patient_uid", T.StringType()), T.StructField("record_uid", T.StringType()), T.StructField("n", T.IntegerType()),
    T.StructField("d", T.DoubleType()), T.StructField("x", T.DecimalType(12, 3)), T.StructField("s", T.StringType()), T.StructField("f", T.FloatType()),
])


def records(spark, count=400, seed=1):
    rng = random.Random(seed)
    pick = lambda values: rng.choice([None, *values])
    rows = [
        (f"p{rng.randrange(20)}", f"r{i}", pick(range(-3, 12)), pick([float("nan"), float("inf"), -0.0, 0.1, 2.0, 2.5, 7.0]),
         pick([Decimal("1.500"), Decimal("2.000"), Decimal("2.001"), Decimal("-4")]), pick(["", "a", "B", "b", "é", "z z"]), pick([0.1, 1.0]))
        for i in range(count)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def predicates():
    out = [f"{c} {op} {v}" for c, values in (("n", ["-1", "2", "2.5", "20"]), ("d", ["0", "0.1", "2.5"]), ("x", ["2", "2.001", "1.5000"]), ("s", ["'a'", "'b'", "''", "'é'"]))
           for v in values for op in ("=", "<>", "!=", "<", "<=", ">", ">=")]
    out += ["n BETWEEN 1 AND 4", "n between 4 and 1", "x BETWEEN 1.5 AND 2", "s IN ('a', 'z z')", "n in (1,2, 3.0)", "`s` = 'a'", "S > 'a'", "d IN (2)"]
    return out


OPAQUE = ["n > 1 AND s = 'a'", "n IS NULL", "length(s) = 1", "f > 0.1", "n = '2'", "try_cast(s AS INT) > 1", "n > d", "true", "CAST(NULL AS BOOLEAN)"]


def test_same_answers_as_the_predicates_one_by_one(spark):
    df = records(spark)
    tests = predicates() + OPAQUE
    leaves = {f"L{i}": Leaf(f"L{i}", "x", p) for i, p in enumerate(tests)}
    matcher = LeafMatcher(df, leaves)
    assert len(matcher.patterns.indexes) == 4 and len(matcher.patterns.others) == len(OPAQUE)
    got = {(r[0], r[2]) for r in criteria_matches(df, leaves).collect()}
    want = set()
    for i in range(0, len(tests), 30):
        flags = df.select("record_uid", *[F.expr(p).alias(f"L{i + k}") for k, p in enumerate(tests[i:i + 30])])
        want |= {(name, row["record_uid"]) for row in flags.collect() for name in flags.columns[1:] if row[name]}
    assert got == want


@pytest.mark.parametrize("text", ["a = b", "a > 1 OR a < 0", "a = 'it''s'", "a = 1e3", "a.b = 1", "lower(a) = 'x'", "a IN ()", "NOT a = 1", "a = 'x\\\\'"])
def test_other_texts_are_no_comparison(text):
    assert comparison(text) is None


def test_more_digits_than_a_decimal_holds_are_left_to_the_predicate():
    schema = T.StructType([T.StructField("x", T.DecimalType(38, 0))])
    leaves = [(0, Leaf("a", "x", "x > 123456789012345678901234567890")), (1, Leaf("b", "x", "x > 0.1234567890123"))]
    assert not Patterns(schema, leaves).indexes


@pytest.mark.parametrize("evidence", [True, False])
def test_counts_follow_the_leaves(spark, evidence):
    df = records(spark)
    leaves = {f"L{i}": Leaf(f"L{i}", "x", p) for i, p in enumerate(predicates()[::3] + OPAQUE * 20)}
    leaves["C"] = Leaf("C", "x", codes=["a", "b"], code_column="s")
    rows = coded_counts(df, leaves, evidence, codes=range(100, 100 + len(leaves))).collect()
    matches = criteria_matches(df, leaves).collect()
    keys = list(leaves)
    want, got = {}, {}
    for m in matches:
        key = (m.patient_uid, keys.index(m.criterion_uid) + 100, m.record_uid if evidence else None)
        want[key] = want.get(key, 0) + 1
    for r in df.collect():
        want[r.patient_uid, None, None] = want.get((r.patient_uid, None, None), 0) + 1
    for r in rows:
        assert (r.patient_uid, r.leaf, r.record_uid) not in got and r.kind == ("length" if r.leaf is None else "match")
        got[r.patient_uid, r.leaf, r.record_uid] = r.n
    assert got == want


def largest_method(spark, df):
    package = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    stages = getattr(package, "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max([stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())])


@pytest.mark.parametrize("evidence", [True, False])
def test_code_does_not_grow_with_the_leaves(spark, evidence):
    df = records(spark)
    leaves = {f"L{k}": Leaf(f"L{k}", "x", f"n > {k}" if k % 2 else f"s = 'w{k}'") for k in range(500)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert largest_method(spark, coded_counts(df, leaves, evidence)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_that_are_exploded_are_patterns(spark):
    df = records(spark, 2000)
    leaves = {f"L{k}": Leaf(f"L{k}", "x", f"n > {k}") for k in range(-5, 40)}
    plan = coded_counts(df, leaves, False)._jdf.queryExecution().optimizedPlan().toString()
    # from the top: counts per leaf, the explode, counts per pattern
    assert plan.index("Generate explode") > plan.index("Aggregate [patient_uid") and plan.rindex("Aggregate [patient_uid") > plan.index("Generate explode")
    patterns = LeafMatcher(df, leaves).with_patterns().groupBy("patient_uid", "_class_0").count().count()
    matches = criteria_matches(df, leaves).count()
    assert patterns <= 20 * 16 < matches / 20


def test_written_terms_need_no_shuffle_and_kinds_are_read_apart(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        part = score_leaves(records(spark), {"A": Leaf("A", "x", "n > 2"), "B": Leaf("B", "x", "s = 'a'")})
        joined = part.coded_tf.join(part.doc_len, "patient_uid")
        joined.collect()
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert "Bucketed: true" in text and "kind" in text
        assert part.coded_evidence_rows.schema["leaf"].dataType == T.IntegerType()
        inputs = part.evidence_rows.inputFiles()
        assert inputs and all("kind=" in f for f in inputs)
        metadata = part.coded_evidence_rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(kind" in metadata
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    part.release()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("cohortfold_terms")]


def test_leaf_ids_are_numbers_until_the_output(spark):
    source = RecordSource("s", "x", records(spark))
    res = run_cohort_job(spark, [source], AnyOf(Leaf("zz", "x", "n > 2"), Leaf("aa", "x", "s = 'a'"), Leaf("none", "other", "true")), "j")
    for part in res.parts:
        assert "criterion_uid" not in part.coded_scores.columns and part.keys == ["ZZ", "AA", "NONE"]
    assert {r[0] for r in res.evidence.select("node_uid").distinct().collect()} == {"ZZ", "AA"}
    assert {r[0] for r in res.leaf_scores.select("criterion_uid").distinct().collect()} == {"ZZ", "AA"}
    res.release()


def generated_rows(plan):
    """Rows out of each explode of an executed plan."""
    own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "Generate" else []
    children = plan.children()
    return own + [n for i in range(children.size()) for n in generated_rows(children.apply(i))]


def test_nested_leaves_are_counted_by_what_changes(spark):
    df = spark.createDataFrame([(f"p{i % 2}", f"r{i}", i // 2, "ab"[i % 3 % 2]) for i in range(240)], "patient_uid string, record_uid string, n int, s string")
    df = df.union(spark.createDataFrame([("p0", "null", None, "a"), ("p2", "low", -1, None)], df.schema))
    tests = [f"n > {k}" for k in range(100)] + [f"n BETWEEN {k} AND {k + 60}" for k in range(0, 40, 2)] + ["n <= 70", "n <> 5", "s = 'a'", "s <> 'b'", "n % 2 = 0"]
    leaves = {f"L{i}": Leaf(f"L{i}", "x", t) for i, t in enumerate(tests)}
    assert LeafMatcher(df, leaves).patterns.nested == [0, 1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counted = coded_counts(df, leaves, False)
        got = {(r.patient_uid, r.leaf): r.n for r in counted.collect()}
        assert max(generated_rows(counted._jdf.queryExecution().executedPlan())) < 1000  # 17,000 leaves hold
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for patient, rows in [(p, df.where(F.col("patient_uid") == p)) for p in ("p0", "p1", "p2")]:
        found = rows.select(F.count(F.lit(1)), *[F.count_if(F.expr(t)) for t in tests]).first()
        want.update({(patient, i - 1 if i else None): n for i, n in enumerate(found) if n})
    assert got == want
