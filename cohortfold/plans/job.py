"""The cohort job: sources + criteria tree -> cohort and evidence.

Steps, all lazy DataFrame calls until a write:

1. group the tree's leaves by entity type (last leaf wins for a repeated id);
2. score each (type, enabled source offering that type): one intermediate
   table per pair, then its scores (also shared, as both outputs read them);
   the pairs' pipelines run side by side;
3. union the leaf scores (U1);
4. merge sources and fold the tree per patient -> cohort (A8, A9, X2);
5. evidence: one row per (source, criterion, patient, record id) with that
   source's own score, taken before the merge (X4). Two sources with the
   same record id give two rows.

Job and node ids are upper-cased in both outputs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortfold.functions.ids import normalize_uid
from cohortfold.operators.matching import CRITERION
from cohortfold.operators.merge import CODED_SCORE_SCHEMA, cohort_scores, union_all
from cohortfold.operators.records import PATIENT, RECORD, RecordSource, select_sources
from cohortfold.operators.scoring import (
    LeafScores,
    attach_evidence,
    decoded,
    score_source,
    share,
    with_shared_scores,
)
from cohortfold.plans.criteria import Criterion, leaf_keys, leaves_by_type

COHORT_SCHEMA = T.StructType(
    [
        T.StructField("job_uid", T.StringType(), False),
        T.StructField("person_uid", T.StringType(), True),
        T.StructField("score", T.DoubleType(), True),
    ]
)
EVIDENCE_SCHEMA = T.StructType(
    [
        T.StructField("job_uid", T.StringType(), False),
        T.StructField("node_uid", T.StringType(), True),
        T.StructField("person_uid", T.StringType(), True),
        T.StructField("evidence_uid", T.StringType(), True),
        T.StructField("score", T.DoubleType(), True),
    ]
)
EVIDENCE_LONG_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("entity_type", T.StringType(), False),
        T.StructField(CRITERION, T.StringType(), True),
        T.StructField(PATIENT, T.StringType(), True),
        T.StructField(RECORD, T.StringType(), True),
        T.StructField("score", T.DoubleType(), True),
    ]
)


def cohort_output(cohort: DataFrame, job_uid: str) -> DataFrame:
    """Cohort table rows: job_uid, person_uid, score."""
    return cohort.select(
        F.lit(normalize_uid(job_uid)).alias("job_uid"), "person_uid", "score"
    )


def evidence_output(evidence: DataFrame, job_uid: str) -> DataFrame:
    """Evidence table rows: job_uid, node_uid, person_uid, evidence_uid, score.

    ``evidence`` holds per-source rows before the merge, so each row carries
    data_source_count 1 and the score is that source's own (F4).
    """
    cols: list[Column | str] = [
        F.lit(normalize_uid(job_uid)).alias("job_uid"),
        F.upper(F.col(CRITERION)).alias("node_uid"),
        F.col(PATIENT).alias("person_uid"),
        F.col(RECORD).alias("evidence_uid"),
        F.col("score"),
    ]
    return evidence.select(*cols)


@dataclass(eq=False)
class CohortResult:
    job_uid: str
    leaf_scores: DataFrame  # union of per-source leaf scores
    cohort: DataFrame  # job_uid, person_uid, score
    evidence: DataFrame | None  # job_uid, node_uid, person_uid, evidence_uid, score
    parts: list[LeafScores] = field(default_factory=list)

    def write(
        self, connection, cohort_table: str = "cohort", evidence_table: str = "evidence", only: Iterable[str] | None = None
    ) -> None:
        """Write both tables through a connection (see ``cohortfold.sources``).

        The two writes only read the shared intermediates, so they are
        submitted together: the small cohort write does not wait behind the
        evidence write. An append of two tables is not one transaction: if one
        write fails, the error names the table that was written, so that a
        retry can leave it out (``only``).
        """
        tables = {cohort_table: self.cohort, evidence_table: self.evidence}
        wanted = {t: df for t, df in tables.items() if df is not None and (only is None or t in only)}
        with ThreadPoolExecutor(max_workers=2) as pool:
            jobs = {t: pool.submit(connection.write, t, df) for t, df in wanted.items()}
        failed = {t: j.exception() for t, j in jobs.items() if j.exception() is not None}
        if failed:
            done = sorted(set(jobs) - set(failed))
            raise RuntimeError(f"not written: {sorted(failed)}; written: {done}") from next(iter(failed.values()))

    def publish(self, connection, cohort_table: str = "cohort", evidence_table: str = "evidence") -> None:
        """Make both tables' rows of this job appear together, and once, however
        often this is called or dies on the way (``publish`` of the connection)."""
        tables = {cohort_table: self.cohort, evidence_table: self.evidence}
        connection.publish(self.cohort.sparkSession, self.job_uid, {t: df for t, df in tables.items() if df is not None})

    def release(self) -> None:
        for part in self.parts:
            part.release()


def run_cohort_job(
    spark: SparkSession,
    sources: Sequence[RecordSource],
    tree: Criterion,
    job_uid: str,
    *,
    enabled_sources: Iterable[str] | None = None,
    scorer: Callable | None = None,
    plan: str = "long",
    leaf_value: str = "mean",
    materialize: str | None = "write",
    evidence: bool = True,
    max_parallel_sources: int = 8,
) -> CohortResult:
    """Score ``tree`` over ``sources`` (X5; ``enabled_sources=None`` is X6).

    ``evidence=False`` makes the cohort only: no record id is shuffled or kept.
    Up to ``max_parallel_sources`` sources are scored at a time; when one fails,
    the jobs of the others are cancelled.
    """
    chosen = select_sources(sources, enabled_sources)
    keys = leaf_keys(tree)  # leaves go by their place here until the outputs
    specs = [
        (src, entity_type, leaves)
        for entity_type, leaves in leaves_by_type(tree).items()
        for src in chosen
        if src.entity_type == entity_type
    ]

    def build(spec: tuple[RecordSource, str, dict]) -> LeafScores:
        # One source's whole pipeline: its intermediate tables, then its
        # scores, all shared (both outputs read the scores).
        src, entity_type, leaves = spec
        release: list = []
        try:
            part = score_source(
                src.records, leaves, source_id=src.source_id, entity_type=entity_type, scorer=scorer,
                plan=plan, materialize=materialize, evidence=evidence, keys=keys, release=release,
            )
            if materialize is not None:
                part = with_shared_scores(part, share(part.coded_scores, materialize, "scores", release))
            return part
        except BaseException:
            for undo in reversed(release):
                undo()
            raise

    if materialize == "write" and len(specs) > 1:
        # Sources are independent: run their pipelines side by side, so a
        # small source never waits behind the largest one.
        tag = f"cohortfold-{uuid.uuid4().hex}"

        def tagged(spec: tuple[RecordSource, str, dict]) -> LeafScores:
            spark.addTag(tag)
            try:
                return build(spec)
            finally:
                spark.removeTag(tag)

        with ThreadPoolExecutor(max_workers=min(len(specs), max_parallel_sources)) as pool:
            futures = [pool.submit(tagged, spec) for spec in specs]
            first = next((f for f in as_completed(futures) if f.exception() is not None), None)
            if first is not None:
                for f in futures:
                    f.cancel()
                spark.interruptTag(tag)
        if first is not None:
            # Drop what the other sources wrote before reporting the error.
            for f in futures:
                if not f.cancelled() and f.exception() is None:
                    f.result().release()
            raise first.exception()
        parts: list[LeafScores] = [f.result() for f in futures]
    else:
        parts = [build(spec) for spec in specs]
    leaf_scores = union_all(spark, [p.coded_scores for p in parts], CODED_SCORE_SCHEMA)
    # One evidence join for all sources (the keys carry source and type): one
    # hot-pair table and one shuffle instead of one per source.
    evidence_long = None
    if parts and evidence:
        evidence_long = attach_evidence(
            reduce(lambda a, b: a.unionByName(b), [p.coded_evidence_rows for p in parts]), leaf_scores
        )
        evidence_long = decoded(evidence_long, keys)
    elif evidence:
        evidence_long = spark.createDataFrame([], EVIDENCE_LONG_SCHEMA)
    cohort = cohort_output(cohort_scores(leaf_scores, tree, leaf_value, keys), job_uid)
    found = evidence_output(evidence_long, job_uid) if evidence else None
    return CohortResult(normalize_uid(job_uid), decoded(leaf_scores, keys), cohort, found, parts)
