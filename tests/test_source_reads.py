"""Each (source, type) is read exactly once per job, whatever the outputs."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from cohortfold.operators.records import RecordSource
from cohortfold.operators.scoring import score_leaves
from cohortfold.plans.job import run_cohort_job
from cohortfold.sources import tables

SF = "/root/testdata/sf0.001"


def probed(spark, df):
    acc = spark.sparkContext.accumulator(0)

    def seen(_):
        acc.add(1)
        return True

    probe = F.udf(seen, T.BooleanType()).asNondeterministic()
    return df.where(probe(F.col("patient_uid"))), acc


@pytest.mark.parametrize("materialize", ["write", "persist"])
def test_job_reads_each_source_once(spark, materialize):
    sources, accs = [], []
    for s in tables.clinical_sources(spark, SF):
        records, acc = probed(spark, s.records)
        sources.append(RecordSource(s.source_id, s.entity_type, records))
        accs.append((acc, s.records.count()))
    res = run_cohort_job(spark, sources, entry.TREE_MIXED, entry.JOB_UID, materialize=materialize)
    res.cohort.count()
    res.evidence.count()
    for acc, rows in accs:
        assert acc.value == rows
    res.release()


def test_standalone_scoring_reads_once(spark):
    records, acc = probed(spark, tables.order_records_a(spark, SF))
    part = score_leaves(records, entry._leaves(entry.L1, entry.L2))
    part.scores.count()
    part.evidence.count()
    assert acc.value == tables.order_records_a(spark, SF).count()
    part.release()


def test_job_invariant_to_partitioning_and_aqe(spark):
    def run():
        res = run_cohort_job(spark, tables.clinical_sources(spark, SF), entry.TREE_MIXED, entry.JOB_UID)
        cohort = sorted((r.person_uid, round(r.score, 9)) for r in res.cohort.collect())
        evidence = sorted((r.node_uid, r.person_uid, r.evidence_uid, round(r.score, 9)) for r in res.evidence.collect())
        res.release()
        return cohort, evidence

    conf = spark.conf
    saved = {k: conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        baseline = run()
        for parts, aqe in (("3", "true"), ("17", "false")):
            conf.set("spark.sql.shuffle.partitions", parts)
            conf.set("spark.sql.adaptive.enabled", aqe)
            assert run() == baseline
    finally:
        for k, v in saved.items():
            conf.set(k, v)
    assert len(baseline[0]) > 0 and len(baseline[1]) > 0
