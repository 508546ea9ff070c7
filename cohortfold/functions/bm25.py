"""Scoring functions as Spark Columns (inventory F1, F2, E1).

A scorer maps the per-(criterion, patient) statistics to one score Column.
Everything stays a built-in expression, so it runs inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The BM25 hyper-parameters used by the original scorer.
DEFAULT_K1 = 1.2
DEFAULT_B = 0.75


@dataclass(frozen=True)
class TermStats:
    """The Columns a scorer may read. Each row is one (criterion, patient)."""

    tf: Column  # matching records of the patient
    doc_len: Column  # all records of the patient in this source and type
    n_docs: Column  # patients with at least one record in this source and type
    avg_doc_len: Column  # mean doc_len over those patients
    doc_freq: Column  # patients with at least one matching record


def idf(n_docs: Column, doc_freq: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5) + 1); natural log, always > 0 for n <= N."""
    n = doc_freq.cast("double")
    return F.log((n_docs.cast("double") - n + F.lit(0.5)) / (n + F.lit(0.5)) + F.lit(1.0))


def bm25(
    idf_col: Column,
    tf: Column,
    doc_len: Column,
    avg_doc_len: Column,
    k1: float = DEFAULT_K1,
    b: float = DEFAULT_B,
) -> Column:
    """idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_doc_len))."""
    tf_d = tf.cast("double")
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * (doc_len.cast("double") / avg_doc_len))
    return idf_col * (tf_d * F.lit(k1 + 1.0)) / (tf_d + norm)


@dataclass(frozen=True)
class BM25:
    """Okapi BM25 over record counts (the default scorer)."""

    k1: float = DEFAULT_K1
    b: float = DEFAULT_B

    def __call__(self, s: TermStats) -> Column:
        return bm25(idf(s.n_docs, s.doc_freq), s.tf, s.doc_len, s.avg_doc_len, self.k1, self.b)


@dataclass(frozen=True)
class TfIdf:
    """tf * ln(1 + N / n): a second scorer that proves the extension seam.

    Not in the original job; its definition is ours. Length is ignored.
    """

    def __call__(self, s: TermStats) -> Column:
        return s.tf.cast("double") * F.log(
            F.lit(1.0) + s.n_docs.cast("double") / s.doc_freq.cast("double")
        )
