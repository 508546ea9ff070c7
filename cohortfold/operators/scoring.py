"""Per-(source, type) leaf scoring (inventory X1, J1, J2, J4, E1).

``score_leaves`` runs the whole per-source pipeline of the original scorer:
match, statistics, joins, score, evidence. Two physical plans give equal
results:

``long`` (default)
    One scan: ``coded_counts`` aggregates lengths and matches in a single
    shuffle. tf, df, N and the average come from that table; evidence rows too.
    Any number of leaves. Written intermediates are bucketed by patient, with
    lengths and matches in partitions of their own, so tf and lengths are joined
    where they lie; leaves go by number until the output.

``wide``
    One aggregate row per patient: ``count(*)`` and one ``count_if(test_k)``
    per leaf in a single ``groupBy(patient)``. Cheapest for a handful of
    predicate leaves when no evidence is needed; evidence needs a second,
    filtered scan. Code-list leaves are not supported here.

The intermediate table (tagged counts or patient rows) is used several times;
``materialize`` decides how it is shared: ``"write"`` (the default) stores it
as parquet in the checkpoint folder (cuts lineage: a lost executor never forces
a rescan of the source), ``"persist"`` caches it (recomputed from the source if
lost), ``None``
leaves the plan as is (the source may then be read more than once, because
filters pushed into each branch keep Spark from reusing the exchange).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortfold.functions.bm25 import BM25, TermStats
from cohortfold.operators import statistics as st
from cohortfold.operators.matching import CRITERION, KIND, LEAF, coded_counts, criteria_matches, decode_criterion
from cohortfold.operators.predicates import constant
from cohortfold.operators.records import PATIENT, RECORD
from cohortfold.plans.criteria import Leaf
from cohortfold.session import delete_path, write_bucketed, write_intermediate

Scorer = Callable[[TermStats], Column]

SCORE_COLUMNS = [
    "source_id",
    "entity_type",
    CRITERION,
    PATIENT,
    "tf",
    "doc_len",
    "score",
    "data_source_count",
]


@dataclass(eq=False)
class LeafScores:
    """Result of scoring one (source, type). ``coded`` frames name leaves by
    their number in ``keys``; the properties name them by criterion id."""

    source_id: str
    entity_type: str
    keys: Sequence[str]
    coded_scores: DataFrame  # SCORE_COLUMNS, with leaf in place of criterion_uid
    coded_evidence_rows: DataFrame | None  # source_id, entity_type, leaf, patient_uid, record_uid
    doc_len: DataFrame  # patient_uid, doc_len
    stats: DataFrame  # one row: n_docs, avg_doc_len
    coded_tf: DataFrame  # leaf, patient_uid, tf
    coded_doc_freq: DataFrame  # leaf, doc_freq
    _release: list[Callable[[], None]] = field(default_factory=list)
    _evidence: DataFrame | None = None

    @property
    def scores(self) -> DataFrame:
        """``SCORE_COLUMNS``."""
        return decoded(self.coded_scores, self.keys)

    @property
    def tf(self) -> DataFrame:
        """criterion_uid, patient_uid, tf."""
        return decoded(self.coded_tf, self.keys)

    @property
    def doc_freq(self) -> DataFrame:
        """criterion_uid, doc_freq."""
        return decoded(self.coded_doc_freq, self.keys)

    @property
    def evidence_rows(self) -> DataFrame | None:
        """source_id, entity_type, criterion_uid, patient_uid, record_uid."""
        return None if self.coded_evidence_rows is None else decoded(self.coded_evidence_rows, self.keys)

    @property
    def evidence(self) -> DataFrame:
        """Evidence rows with their score; built on first use."""
        if self.coded_evidence_rows is None:
            raise ValueError("scored with evidence=False: no record ids were kept")
        if self._evidence is None:
            self._evidence = decoded(attach_evidence(self.coded_evidence_rows, self.coded_scores), self.keys)
        return self._evidence

    def release(self) -> None:
        """Drop cached or written intermediates."""
        while self._release:
            self._release.pop()()


def decoded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Criterion ids in place of leaf codes."""
    return df.select(*[decode_criterion(F.col(LEAF), keys).alias(CRITERION) if c == LEAF else F.col(c) for c in df.columns])


def share(df: DataFrame, materialize: str | None, name: str, release: list, split: str | None = None) -> DataFrame:
    """Share ``df`` between several consumers as ``materialize`` says."""
    if materialize is None:
        return df
    if materialize == "persist":
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        release.append(df.unpersist)
        return df
    if materialize == "write":
        out, path = write_intermediate(df, name, split)
        release.append(lambda: delete_path(df.sparkSession, path))
        return out
    raise ValueError("materialize must be 'write', 'persist' or None")


def share_terms(terms: DataFrame, materialize: str | None, release: list) -> DataFrame:
    """``share`` for rows of (patient, leaf): written, they are bucketed by patient."""
    if materialize != "write":
        return share(terms, materialize, "terms", release)
    out, delete = write_bucketed(terms, "terms", PATIENT, KIND)
    release.append(delete)
    return out


def join_term_stats(
    tf: DataFrame, doc_freq: DataFrame, doc_len: DataFrame, stats: DataFrame
) -> DataFrame:
    """tf ⋈ df (J1) ⋈ doc_len (J2) × scalars.

    ``doc_freq`` has at most one row per leaf, so broadcasting it is safe.
    ``doc_len`` grows with the patients: the join strategy is left to AQE,
    which broadcasts a side only when its measured size allows.
    """
    joined = tf.join(F.broadcast(doc_freq), st.leaf_key(tf)).join(doc_len, PATIENT)
    return st.attach_scalars(joined, stats)


def _score_frame(
    joined: DataFrame, scorer: Scorer, source_id: str, entity_type: str
) -> DataFrame:
    stats = TermStats(
        tf=F.col("tf"),
        doc_len=F.col("doc_len"),
        n_docs=F.col("n_docs"),
        avg_doc_len=F.col("avg_doc_len"),
        doc_freq=F.col("doc_freq"),
    )
    return joined.select(
        F.lit(source_id).alias("source_id"),
        F.lit(entity_type).alias("entity_type"),
        LEAF,
        PATIENT,
        "tf",
        "doc_len",
        scorer(stats).cast("double").alias("score"),
        F.lit(1).cast("bigint").alias("data_source_count"),
    )


# A (source, type, criterion, patient) pair is hot when it holds more rows than
# an even share of a shuffle partition. The pairs' rows add up to the total, so
# there are fewer hot pairs than shuffle partitions: a proven bound, so the
# hot-pair table is broadcast.


def _evidence_keys(df: DataFrame) -> list[str]:
    return ["source_id", "entity_type", st.leaf_key(df), PATIENT]


def salt_hot_pairs(
    evidence: DataFrame, scores: DataFrame, partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add ``_salt`` to both join sides so that hot pairs spread over tasks.

    Hot pairs are found from ``tf`` (already on the score rows). A hot pair's
    evidence rows take a salt from their record id's hash, and its one score
    row is repeated once per salt value; every other pair keeps salt 0. Only
    hot pairs are repeated, at most about 2 * ``partitions`` rows in all
    (default: the session's shuffle partitions).
    """
    partitions = partitions or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _evidence_keys(scores)
    total = scores.agg(F.sum("tf").cast("double").alias("_total"))
    per_split = F.greatest(F.col("_total") / F.lit(partitions), F.lit(1.0))
    # Key columns are never NULL; saying so keeps both uses of ``hot`` equal,
    # so Spark builds and broadcasts it once.
    not_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    hot = (
        scores.where(not_null)
        .crossJoin(F.broadcast(total))
        .where(F.col("tf") > per_split)
        .select(*keys, F.ceil(F.col("tf") / per_split).cast("int").alias("_splits"))
    )
    salted_evidence = evidence.join(F.broadcast(hot), keys, "left").select(
        *evidence.columns,
        F.when(F.col("_splits").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(F.col(RECORD)), F.col("_splits")))
        .cast("int")
        .alias("_salt"),
    )
    salted_scores = (
        scores.select(*keys, "score")
        .join(F.broadcast(hot), keys, "left")
        .select(
            *keys,
            "score",
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)).alias("_salt"),
        )
    )
    return salted_evidence, salted_scores


def attach_evidence(evidence: DataFrame, scores: DataFrame, partitions: int | None = None) -> DataFrame:
    """Evidence rows with their (criterion, patient) score.

    Both sides come from the same match rows, so every evidence row finds
    exactly one score row. One patient may own a large share of all matching
    records, which would send its evidence to one join task; such hot pairs
    are split first (``salt_hot_pairs``).
    """
    salted_evidence, salted_scores = salt_hot_pairs(evidence, scores, partitions)
    return salted_evidence.join(salted_scores, [*_evidence_keys(scores), "_salt"]).drop("_salt")


def score_source(
    records: DataFrame,
    leaves: Mapping[str, Leaf],
    *,
    source_id: str = "",
    entity_type: str = "",
    scorer: Scorer | None = None,
    plan: str = "long",
    materialize: str | None = "write",
    evidence: bool = True,
    keys: Sequence[str] | None = None,
    release: list[Callable[[], None]] | None = None,
) -> LeafScores:
    """``score_leaves``, with leaves numbered as in ``keys`` (default: their order)."""
    scorer = scorer or BM25()
    keys = list(keys if keys is not None else leaves)
    place = {k: i for i, k in enumerate(keys)}
    codes = [place[k] for k in leaves]
    release = release if release is not None else []
    if plan == "long":
        base = coded_counts(records, leaves, evidence, codes)
        evidence_rows = None
        if evidence:
            # Split by kind: evidence reads the matches alone.
            base = share(base, materialize, "records", release, split=KIND)
            evidence_rows = st.evidence_rows(base)
            base = base.groupBy(KIND, LEAF, PATIENT).agg(F.sum("n").alias("n"))
            if materialize == "write":
                base = base.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), PATIENT)
        terms = share_terms(base.select(PATIENT, LEAF, "n", KIND), materialize, release)
        doc_len = st.doc_lengths(terms)
        tf = st.match_rows(terms).select(LEAF, PATIENT, F.col("n").cast("bigint").alias("tf"))
    elif plan == "wide":
        doc_len, tf = _wide_to_long(share(_wide_patient_counts(records, leaves), materialize, "wide", release), codes)
        evidence_rows = None
        if evidence:
            code_of = F.get(constant(codes, "array<int>"), F.array_position(constant(list(leaves), "array<string>"), F.col(CRITERION)).cast("int") - F.lit(1))
            evidence_rows = criteria_matches(records, leaves).dropDuplicates().select(code_of.alias(LEAF), PATIENT, RECORD)
        terms = None
    else:
        raise ValueError("plan must be 'long' or 'wide'")
    if terms is not None and materialize == "write":
        # A row for each leaf and one for the lengths: both joins below are broadcasts of it.
        summary = share(st.term_summary(terms), materialize, "summary", release)
        stats = summary.where(F.col(LEAF).isNull()).agg(F.coalesce(F.max("docs"), F.lit(0)).alias("n_docs"), F.max("avg_n").alias("avg_doc_len"))
        doc_freq = summary.where(F.col(LEAF).isNotNull()).select(LEAF, F.col("docs").alias("doc_freq"))
    else:
        stats, doc_freq = st.collection_stats(doc_len), st.doc_frequencies(tf)
    scores = _score_frame(join_term_stats(tf, doc_freq, doc_len, stats), scorer, source_id, entity_type)
    if evidence_rows is not None:
        named = [F.lit(source_id).alias("source_id"), F.lit(entity_type).alias("entity_type")]
        evidence_rows = evidence_rows.select(*named, LEAF, PATIENT, RECORD)
    return LeafScores(source_id, entity_type, keys, scores, evidence_rows, doc_len, stats, tf, doc_freq, release)


def with_shared_scores(part: LeafScores, scores: DataFrame) -> LeafScores:
    """Point a part at a materialised copy of its (coded) scores (evidence joins it too)."""
    part.coded_scores = scores
    part._evidence = None
    return part


def score_leaves(
    records: DataFrame,
    leaves: Mapping[str, Leaf],
    *,
    source_id: str = "",
    entity_type: str = "",
    scorer: Scorer | None = None,
    plan: str = "long",
    materialize: str | None = "write",
    evidence: bool = True,
) -> LeafScores:
    """Score every leaf of one entity type against one source's records.

    Intermediate tables are written to the shared folder by default (call
    ``release()`` after use). ``evidence=False`` keeps no record ids: records
    are counted by patient and pattern, and ``.evidence`` is unavailable.
    ``plan="wide"`` is the caller's choice for a handful of predicate leaves.
    """
    return score_source(
        records, leaves, source_id=source_id, entity_type=entity_type, scorer=scorer, plan=plan,
        materialize=materialize, evidence=evidence,
    )


def _wide_patient_counts(records: DataFrame, leaves: Mapping[str, Leaf]) -> DataFrame:
    """(patient_uid, doc_len, _tf0 .. _tfK-1): one aggregate row per patient."""
    if any(l.by_code for l in leaves.values()):
        raise ValueError("the wide plan takes predicate leaves only")
    counts = [
        F.count_if(F.coalesce(leaf.condition(), F.lit(False))).alias(f"_tf{i}")
        for i, leaf in enumerate(leaves.values())
    ]
    return records.groupBy(PATIENT).agg(F.count(F.lit(1)).alias("doc_len"), *counts)


def _wide_to_long(per_patient: DataFrame, codes: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    doc_len = per_patient.select(PATIENT, "doc_len")
    if not codes:
        return doc_len, per_patient.select(F.lit(None).cast("int").alias(LEAF), PATIENT, F.lit(0).cast("bigint").alias("tf")).where(F.lit(False))
    pairs = F.array(*[F.struct(F.lit(code).alias(LEAF), F.col(f"_tf{i}").alias("tf")) for i, code in enumerate(codes)])
    tf = per_patient.select(PATIENT, F.inline(pairs)).where(F.col("tf") > 0)
    return doc_len, tf.select(LEAF, PATIENT, F.col("tf").cast("bigint").alias("tf"))
