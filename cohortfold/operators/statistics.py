"""Collection statistics for BM25 (inventory A1-A6, J3).

All of them are derived from the tagged-count table of
``matching.tagged_counts`` (or, for the wide plan, from one row per patient),
so the source is scanned once per (source, type).

* N (A1) counts patients with at least one record of this type in this
  source, not all patients.
* Document length (A2) counts every record of the patient, matching or not;
  the average (A3) is the unweighted mean over patients.
* Document frequency (A5) counts distinct patients per criterion (A4 pairs).
* Term frequency (A6) counts matching rows; a repeated record id counts again.

N and the average are one-row aggregates attached by a broadcast cross join
(J3); they never pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortfold.operators.matching import CRITERION, KIND, LEAF
from cohortfold.operators.records import PATIENT, RECORD


def leaf_key(df: DataFrame) -> str:
    """The column that names leaves: their code, or their id once decoded."""
    return LEAF if LEAF in df.columns else CRITERION


def length_rows(base: DataFrame) -> DataFrame:
    # A written base holds its kinds in partitions of their own: only one is read.
    kind = F.col(KIND) == "length" if KIND in base.columns else F.col(leaf_key(base)).isNull()
    return base.where(kind & F.col(PATIENT).isNotNull())


def match_rows(base: DataFrame) -> DataFrame:
    # The patient test is implied (ids are validated) but spelled out: joins
    # on the patient would infer it on one branch only, and the tf exchange
    # used by both the join and the df count would then not be reused.
    kind = F.col(KIND) == "match" if KIND in base.columns else F.col(leaf_key(base)).isNotNull()
    return base.where(kind & F.col(PATIENT).isNotNull())


def doc_lengths(base: DataFrame) -> DataFrame:
    """(patient_uid, doc_len BIGINT); the length rows are already one per patient."""
    return length_rows(base).select(PATIENT, F.col("n").alias("doc_len"))


def collection_stats(doc_len: DataFrame) -> DataFrame:
    """One row: n_docs BIGINT, avg_doc_len DOUBLE (A1 + A3)."""
    return doc_len.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg(F.col("doc_len").cast("double")).alias("avg_doc_len"),
    )


def distinct_pairs(base: DataFrame) -> DataFrame:
    """Distinct (criterion_uid, patient_uid) with at least one match (A4)."""
    return match_rows(base).select(leaf_key(base), PATIENT).dropDuplicates()


def term_frequencies(base: DataFrame) -> DataFrame:
    """(criterion_uid, patient_uid, tf BIGINT)."""
    return (
        match_rows(base)
        .groupBy(leaf_key(base), PATIENT)
        .agg(F.sum("n").cast("bigint").alias("tf"))
    )


def doc_frequencies(tf: DataFrame) -> DataFrame:
    """(criterion_uid, doc_freq BIGINT) over the tf pairs (A5).

    At most one row per leaf of the type, so its size is bounded by the query.
    """
    return tf.groupBy(leaf_key(tf)).agg(F.count(F.lit(1)).alias("doc_freq"))


def evidence_rows(base: DataFrame) -> DataFrame:
    """Distinct (criterion_uid, patient_uid, record_uid) behind each score.

    Long rows, never one array per patient: a heavy patient's evidence stays
    spread over many partitions.
    """
    return match_rows(base).select(leaf_key(base), PATIENT, RECORD)


def term_summary(terms: DataFrame) -> DataFrame:
    """(leaf, docs BIGINT, avg_n DOUBLE) in one pass over length and tf rows: of
    a leaf, its document frequency; of the NULL leaf, N and the average length."""
    return terms.groupBy(LEAF).agg(F.count(F.lit(1)).alias("docs"), F.avg(F.col("n").cast("double")).alias("avg_n"))


def attach_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the one-row statistics to every row (J3): a broadcast cross join."""
    return df.crossJoin(F.broadcast(stats))
