"""Record-versus-criteria matching (inventory P4, P5, E2).

Predicate leaves are looked up in an index over the record's columns (see
``predicates``); a record that matches nothing yields no match row, and a NULL
test counts as no match. Code leaves (P5: lists or tables) are answered by one
left join against a ``code -> [leaf codes]`` table, so a record matches each
criterion at most once however many of its codes are listed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortfold.functions.ids import normalize_uid_col
from cohortfold.operators.predicates import Patterns, constant
from cohortfold.operators.records import PATIENT, RECORD
from cohortfold.plans.criteria import Leaf

CRITERION = "criterion_uid"
#: A leaf's number, in place of its id, in all tables before the output.
LEAF = "leaf"
KIND = "kind"

#: Places that records without a code are spread over in a join on codes.
NULL_CODE_SPREAD = 1024


def _code_lookup(spark: SparkSession, leaves: Sequence[tuple[int, Leaf]]) -> DataFrame:
    """(code, criteria ARRAY<INT>) for the given code leaves (leaf codes, sorted).

    Code lists come from the driver, code tables stay in Spark; either way the
    join's strategy is Spark's choice by measured size.
    """
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("_leaf", T.IntegerType(), False)])
    listed = [(code, i) for i, leaf in leaves for code in leaf.codes or ()]
    parts = [spark.createDataFrame(listed, schema)] if listed else []
    for i, leaf in leaves:
        if leaf.code_table is not None:
            column = leaf.code_table.columns[0]
            parts.append(leaf.code_table.select(F.col(f"`{column}`").cast("string").alias("code"), F.lit(i).alias("_leaf")))
    pairs = reduce(lambda a, b: a.unionByName(b), parts)
    return pairs.where(F.col("code").isNotNull()).groupBy("code").agg(F.sort_array(F.collect_set("_leaf")).alias("criteria"))


def _join_codes(df: DataFrame, code_column: str, lookup: DataFrame, how: str) -> DataFrame:
    """Join on the code. A code on a large share of the rows is split by AQE's
    skew join (the lookup has one row per code); rows without a code, which
    match nothing, are spread over keys of their own."""
    code = F.col(f"`{code_column}`").cast("string")
    nowhere = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(PATIENT, RECORD), F.lit(NULL_CODE_SPREAD)).cast("string"))
    keyed = df.withColumn("_code_key", F.coalesce(code, nowhere))
    return keyed.join(lookup.withColumnRenamed("code", "_code_key"), "_code_key", how).drop("_code_key")


def decode_criterion(idx: Column, keys: Sequence[str]) -> Column:
    """Leaf code -> criterion id (a lookup in a constant array; NULL stays NULL).

    ``get`` is NULL for a NULL or absent place; ``element_at`` was seen to
    return the last element for a NULL one.
    """
    return F.get(constant(list(keys), "array<string>"), idx)


class LeafMatcher:
    """All leaves of a type, ready to be matched with its records.

    ``codes`` are the numbers the leaves go by in every table up to the
    output (default: their places in ``leaves``).
    """

    def __init__(self, records: DataFrame, leaves: Mapping[str, Leaf], codes: Sequence[int] | None = None):
        coded = list(zip(codes if codes is not None else range(len(leaves)), leaves.values()))
        self.records = records
        self.patterns = Patterns(records.schema, [(i, l) for i, l in coded if not l.by_code])
        self._by_column: dict[str, list[tuple[int, Leaf]]] = {}
        for i, l in coded:
            if l.by_code:
                self._by_column.setdefault(l.code_column, []).append((i, l))
        self._hits = [f"_code_hits_{j}" for j in range(len(self._by_column))]
        #: Columns of a record's pattern: equal patterns hold the same leaves.
        self.columns = [*self.patterns.columns, *self._hits]

    def with_patterns(self) -> DataFrame:
        df = self.records
        for hits, (code_col, group) in zip(self._hits, self._by_column.items()):
            lookup = _code_lookup(df.sparkSession, group).withColumnRenamed("criteria", hits)
            df = _join_codes(df, code_col, lookup, "left").withColumn(hits, F.coalesce(hits, F.array().cast("array<int>")))
        return self.patterns.add(df)

    def matched(self) -> Column:
        """Whether some leaf holds, of a row with its pattern."""
        tests = [*self.patterns.any(), *(F.size(h) > 0 for h in self._hits)]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def leaves(self, nested: bool = True) -> Column:
        """Codes of the leaves that hold (ARRAY<INT>), of a row with its pattern."""
        parts = [*self.patterns.leaves(nested), *(F.col(h) for h in self._hits)]
        return F.concat(*parts) if parts else F.array().cast("array<int>")

    def leaf_counts(self, counted: DataFrame) -> DataFrame:
        """(patient, leaf, n) from ``_n`` records by (patient, pattern); the NULL leaf
        counts all. A patient's rows are in one partition, and stay there.

        A leaf of a nested index holds from the class where it comes up to where
        it goes, so it counts the patient's records from the first on, less those from
        the other on: a row for each change between two classes that the
        patient has, not for each leaf that a class holds.
        """
        tags = F.concat(F.array(F.lit(None).cast("int")), self.leaves(nested=False))
        nested = self.patterns.nested
        if not nested:
            rows = counted.select(PATIENT, F.col("_n").alias("n"), F.explode(tags).alias(LEAF))
            return rows.groupBy(PATIENT, LEAF).agg(F.sum("n").alias("n"))
        # Of a nested index (its place) a class, else a leaf.
        one = lambda index, place: F.struct(F.lit(index).alias("_index"), place.alias("_place"))
        parts = F.concat(F.array(*[one(i, F.col(f"_class_{i}")) for i in nested]), F.transform(tags, lambda t: one(-1, t)))
        rows = counted.select(PATIENT, "_n", F.explode(parts).alias("_part")).select(PATIENT, "_n", "_part.*")
        rows = rows.groupBy(PATIENT, "_index", "_place").agg(F.sum("_n").alias("_n"))
        falling = Window.partitionBy(PATIENT, "_index").orderBy(F.desc("_place"))
        onwards = F.sum("_n").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.select(PATIENT, "_index", "_place", "_n", onwards.alias("_onwards"), F.lead("_place", 1, 0).over(falling).alias("_below"))
        changes = F.array("_place")
        for i in nested:
            changes = F.when(F.col("_index") == i, self.patterns.changes(i, F.col("_below"), F.col("_place"))).otherwise(changes)
        rows = rows.select(PATIENT, F.when(F.col("_index") < 0, F.col("_n")).otherwise(F.col("_onwards")).alias("n"), "_index", F.explode(changes).alias("_change"))
        goes = (F.col("_index") >= 0) & (F.col("_change") < 0)
        rows = rows.select(
            PATIENT, F.when(goes, F.bitwise_not("_change")).otherwise(F.col("_change")).alias(LEAF), F.when(goes, -F.col("n")).otherwise(F.col("n")).alias("n")
        )
        return rows.groupBy(PATIENT, LEAF).agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def criteria_matches(records: DataFrame, leaves: Mapping[str, Leaf]) -> DataFrame:
    """(criterion_uid, patient_uid, record_uid): one row per (record, matched leaf).

    Repeated record ids stay repeated; that is what term frequency counts.
    """
    matcher = LeafMatcher(records, leaves)
    exploded = matcher.with_patterns().select(F.explode(matcher.leaves()).alias(LEAF), PATIENT, RECORD)
    return exploded.select(decode_criterion(F.col(LEAF), list(leaves)).alias(CRITERION), PATIENT, RECORD)


def match_codes(records: DataFrame, codes: DataFrame, code_column: str = "code") -> DataFrame:
    """P5 against a code table of many criteria held in Spark: codes(criterion_uid, code).

    One row per (record, criterion that lists its code). A criterion's table as
    a leaf of a tree: ``Leaf(..., code_table=...)``.
    """
    ids = codes.where(F.col("code").isNotNull()).groupBy("code").agg(
        F.collect_set(normalize_uid_col(CRITERION)).alias("_criteria")
    )
    found = _join_codes(records, code_column, ids, "inner")
    return found.select(F.explode("_criteria").alias(CRITERION), PATIENT, RECORD)


def coded_counts(
    records: DataFrame, leaves: Mapping[str, Leaf], keep_records: bool = True, codes: Sequence[int] | None = None
) -> DataFrame:
    """(patient_uid, leaf, record_uid, n, kind): what everything else is derived from; one scan.

    * ``kind = 'length'``: one row per patient, ``n`` = its record count
      (document length); ``leaf`` and ``record_uid`` are NULL.
    * ``kind = 'match'``: ``n`` = how many records of the patient hold the leaf
      (by ``record_uid``, if records are kept: repeats of an id count in tf).

    ``keep_records=True`` gives each record a length tag and a tag per leaf
    that holds and counts tags, with one shuffle; a hot patient's tags collapse
    to one length row per map task, and its match rows stay spread over
    partitions by record id.

    ``keep_records=False`` (scores without evidence) counts records per (patient,
    pattern) first, so what is shuffled follows the patterns a patient has, not
    the leaves that its records hold; patterns become leaves after that
    (``LeafMatcher.leaf_counts``), and all of a patient's rows are in one partition
    (at most one for each of its patterns).
    """
    matcher = LeafMatcher(records, leaves, codes)
    df = matcher.with_patterns()
    if keep_records:
        tags = F.concat(F.array(F.lit(None).cast("int")), matcher.leaves())
        exploded = df.select(PATIENT, RECORD, F.explode(tags).alias(LEAF))
        exploded = exploded.withColumn(RECORD, F.when(F.col(LEAF).isNotNull(), F.col(RECORD)))
        counted = exploded.groupBy(PATIENT, LEAF, RECORD).agg(F.count(F.lit(1)).alias("n"))
    else:
        counted = df.groupBy(PATIENT, *matcher.columns).agg(F.count(F.lit(1)).alias("_n"))
        counted = matcher.leaf_counts(counted.repartition(_partitions(records), PATIENT))
        counted = counted.withColumn(RECORD, F.lit(None).cast("string"))
    return counted.select(PATIENT, LEAF, RECORD, "n", F.when(F.col(LEAF).isNull(), "length").otherwise("match").alias(KIND))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tagged_counts(records: DataFrame, leaves: Mapping[str, Leaf], keep_records: bool = True) -> DataFrame:
    """``coded_counts`` with criterion ids: patient_uid, criterion_uid, record_uid, n."""
    counted = coded_counts(records, leaves, keep_records)
    return counted.select(PATIENT, decode_criterion(F.col(LEAF), list(leaves)).alias(CRITERION), RECORD, "n")
