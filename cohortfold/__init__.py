"""cohortfold: criteria-tree cohort retrieval and BM25 scoring on Spark DataFrames."""

from cohortfold.functions.bm25 import BM25, TermStats, TfIdf, bm25, idf
from cohortfold.operators.records import RecordMapping, RecordSource, map_records
from cohortfold.operators.scoring import LeafScores, score_leaves
from cohortfold.plans.criteria import AllOf, AnyOf, AtLeast, Leaf, Not
from cohortfold.plans.job import CohortResult, run_cohort_job

__all__ = [
    "AllOf",
    "AnyOf",
    "AtLeast",
    "BM25",
    "CohortResult",
    "Leaf",
    "LeafScores",
    "Not",
    "RecordMapping",
    "RecordSource",
    "TermStats",
    "TfIdf",
    "bm25",
    "idf",
    "map_records",
    "run_cohort_job",
    "score_leaves",
]
