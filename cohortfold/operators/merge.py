"""Combining leaf scores across sources and up the criteria tree.

Leaf scores are partitioned by patient once. Sources are merged per (patient,
criterion), then the tree is folded a level at a time: each level groups the
matched children of a patient by their parent, which the partitioning by
patient already serves, so no level shuffles again. A level's expressions look
up a node's rule in constant arrays; their size does not grow with the tree.
A patient has at most (#leaves x #sources) rows, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortfold.operators.matching import CRITERION, LEAF
from cohortfold.operators.records import PATIENT
from cohortfold.operators.statistics import leaf_key
from cohortfold.plans.criteria import Criterion, FoldLevel, fold_levels

LEAF_SCORE_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.StringType(), False),
        T.StructField("entity_type", T.StringType(), False),
        T.StructField(CRITERION, T.StringType(), True),
        T.StructField(PATIENT, T.StringType(), True),
        T.StructField("tf", T.LongType(), True),
        T.StructField("doc_len", T.LongType(), True),
        T.StructField("score", T.DoubleType(), True),
        T.StructField("data_source_count", T.LongType(), False),
    ]
)
#: The same with leaf codes in place of criterion ids.
CODED_SCORE_SCHEMA = T.StructType([T.StructField(LEAF, T.IntegerType(), True) if f.name == CRITERION else f for f in LEAF_SCORE_SCHEMA])


def union_all(spark: SparkSession, frames: Sequence[DataFrame], schema: T.StructType) -> DataFrame:
    """Union by name; an empty list gives an empty DataFrame with ``schema``."""
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b), frames)


def cross_source_merge(leaf_scores: DataFrame) -> DataFrame:
    """Per (patient, criterion): summed score and summed source count."""
    return leaf_scores.groupBy(PATIENT, leaf_key(leaf_scores)).agg(
        F.sum("score").alias("score_sum"),
        F.sum("data_source_count").cast("bigint").alias("data_source_count"),
    )


def _leaf_value(score_sum: Column, count_sum: Column, leaf_value: str) -> Column:
    if leaf_value == "mean":
        return score_sum / count_sum
    if leaf_value == "sum":
        return score_sum
    raise ValueError("leaf_value must be 'mean' or 'sum'")


def _at(values: Sequence[int], place: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(place) + F.lit(1))


def _fold(rows: DataFrame, level: FoldLevel) -> DataFrame:
    """(patient, node, matched, score) of a level's nodes from those of their children.

    A node has a row if one of its leaves has; children without a row count as
    their default says (``Not`` is matched where its child has no row).
    """
    children = rows.select(
        PATIENT, _at(level.parent, "node").alias("node"), (F.col("matched") - _at(level.default, "node")).alias("more"), "score"
    )
    nodes = children.groupBy(PATIENT, "node").agg(F.sum("more").alias("more"), F.sum("score").alias("score"))
    count = F.col("more") + _at(level.base, "node")
    nodes = nodes.withColumn("matched", count.between(_at(level.least, "node"), _at(level.most, "node")).cast("int"))
    keep = (F.col("matched") == 1) & (_at(level.scored, "node") == 1)
    return nodes.select(PATIENT, "node", "matched", F.when(keep, F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def cohort_scores(
    leaf_scores: DataFrame, tree: Criterion, leaf_value: str = "mean", keys: Sequence[str] | None = None
) -> DataFrame:
    """(person_uid, score): one row per patient with at least one leaf score.

    ``leaf_value="mean"`` divides a leaf's summed score by the number of
    sources that scored it; ``"sum"`` keeps the plain sum. Rows of criteria
    outside the tree still make their patient a cohort row. With ``keys``, rows
    name their leaf by its place in them (``leaf``), else by ``criterion_uid``.
    """
    places, levels = fold_levels(tree)
    key = leaf_key(leaf_scores)
    if keys is not None:
        code = {k: i for i, k in enumerate(keys)}
        places = [(code[k], node) for k, node in places]
    leaves = leaf_scores.sparkSession.createDataFrame(places, f"{key} {'int' if key == LEAF else 'string'}, node int")
    value = _leaf_value(F.col("score_sum"), F.col("data_source_count"), leaf_value)
    merged = cross_source_merge(leaf_scores.repartition(F.col(PATIENT)))
    rows = merged.join(F.broadcast(leaves), key, "left")  # a row for each leaf of the tree
    inside = F.col("node").isNotNull() & value.isNotNull()
    rows = rows.select(
        PATIENT,
        F.coalesce("node", F.lit(len(places))).alias("node"),
        inside.cast("int").alias("matched"),
        F.when(inside, value).otherwise(F.lit(0.0)).alias("score"),
    )
    for level in levels:
        rows = _fold(rows, level)
    return rows.select(F.col(PATIENT).alias("person_uid"), F.col("score").cast("double").alias("score"))
