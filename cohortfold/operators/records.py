"""Canonical record tables (inventory P1, P2, P3, P6, S2, E3).

Every (source, entity type) pair becomes one DataFrame with at least
``patient_uid STRING`` and ``record_uid STRING`` plus whatever attribute
columns the leaf predicates read. Patient ids are not qualified by source:
equal strings from two sources are the same patient.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from cohortfold.sources.connection import Connection

PATIENT = "patient_uid"
RECORD = "record_uid"


@dataclass(frozen=True)
class RecordMapping:
    """SQL expressions that turn a source row into a canonical record.

    ``patient`` and ``record`` become strings; ``attributes`` maps an output
    column name to an expression (cast it in the expression if needed).
    """

    patient: str
    record: str
    attributes: Mapping[str, str] = field(default_factory=dict)


class RecordSource:
    """Records of one entity type from one data source.

    ``records`` is a DataFrame, or a function that makes one: then nothing is
    read, not even a schema, before a job that has the source enabled asks.
    """

    def __init__(self, source_id: str, entity_type: str, records: DataFrame | Callable[[], DataFrame]):
        self.source_id, self.entity_type = source_id, entity_type
        self._records = records

    @property
    def records(self) -> DataFrame:
        if not isinstance(self._records, DataFrame):
            self._records = self._records()
        return self._records

    def __repr__(self) -> str:
        return f"RecordSource({self.source_id!r}, {self.entity_type!r})"


def _expr(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def validate_ids(records: DataFrame, on_null: str = "raise") -> DataFrame:
    """Reject (``raise``) or ``drop`` records whose patient or record id is NULL.

    ``raise`` is lazy and row-wise: the first NULL id fails the task with a
    clear message, without an extra pass over the data. Spark would otherwise
    keep a NULL patient as a group of its own and skew N and the lengths.
    """
    bad = F.col(PATIENT).isNull() | F.col(RECORD).isNull()
    if on_null == "drop":
        return records.where(~bad)
    if on_null == "keep":
        return records
    if on_null != "raise":
        raise ValueError("on_null must be 'raise', 'drop' or 'keep'")
    checked = F.when(
        bad, F.raise_error(F.lit("cohortfold: NULL patient_uid or record_uid in records"))
    ).otherwise(F.col(PATIENT))
    return records.withColumn(PATIENT, checked.cast("string"))


def map_records(df: DataFrame, mapping: RecordMapping, on_null: str = "raise") -> DataFrame:
    """Project a source DataFrame to canonical records (P1 + P2)."""
    cols = [
        F.expr(mapping.patient).cast("string").alias(PATIENT),
        F.expr(mapping.record).cast("string").alias(RECORD),
    ]
    cols += [F.expr(e).alias(name) for name, e in mapping.attributes.items()]
    return validate_ids(df.select(*cols), on_null)


def patient_keys(records: DataFrame) -> DataFrame:
    """(patient_uid, record_uid) pairs: the key extraction step alone."""
    return records.select(PATIENT, RECORD)


def quoted(name: str) -> str:
    """A column name as SQL takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def _field(fields: Sequence[T.StructField], name: str, path: str) -> T.StructField:
    """The one field of that name, in whatever case."""
    found = [f for f in fields if f.name.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"columns {'missing from' if not found else 'ambiguous in'} source: {[path + name]}")
    return found[0]


def _shaped(value: Column, have: T.DataType, want: T.DataType, path: str) -> Column:
    """``value`` as type ``want``; structs by field name at every depth."""
    if have == want:
        return value
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        parts = []
        for f in want.fields:
            found = _field(have.fields, f.name, path)
            parts.append(_shaped(value.getField(found.name), found.dataType, f.dataType, f"{path}{f.name}.").alias(f.name))
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: _shaped(x, have.elementType, want.elementType, path))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        entry = lambda e: F.struct(
            _shaped(e.getField("key"), have.keyType, want.keyType, path).alias("key"),
            _shaped(e.getField("value"), have.valueType, want.valueType, path).alias("value"),
        )
        return F.map_from_entries(F.transform(F.map_entries(value), entry))
    return value.cast(want)


def typed_projection(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a declared schema (S2); fail on missing columns.

    Columns go by name, and so do the fields of structs, however deep and
    inside arrays and maps too: order does not matter, undeclared fields are
    not read, one that is missing or there twice is named by its path. Names are
    not case-sensitive. Unlike the original row mapper, DECIMAL stays
    exact and SQL NULL stays NULL (it read primitives without checking
    ``wasNull``).
    """
    missing = [f.name for f in schema.fields if f.name.lower() not in {g.name.lower() for g in df.schema.fields}]
    if missing:
        raise ValueError(f"columns missing from source: {missing}")
    out = []
    for f in schema.fields:
        found = _field(df.schema.fields, f.name, "")
        out.append(_shaped(F.col(quoted(found.name)), found.dataType, f.dataType, f"{f.name}.").alias(f.name))
    return df.select(*out)


def parsed_projection(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``typed_projection`` of text cells: one that does not parse fails its task."""

    def parsed(f: T.StructField) -> Column:
        cell = F.col(quoted(f.name))
        value = cell.try_cast(f.dataType)
        bad = F.raise_error(F.concat(F.lit(f"cohortfold: {f.name} does not parse: "), cell)).cast(f.dataType)
        return F.when(cell.isNotNull() & value.isNull(), bad).otherwise(value).alias(f.name)

    names = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return typed_projection(df, names).select(*[parsed(f) for f in schema.fields])


def rebalance(records: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Spread a badly partitioned source, e.g. a one-partition JDBC read.

    Opt-in: a round-robin shuffle of the raw records is costly, so use it only
    when the input has too few partitions to keep the cluster busy.
    """
    if num_partitions:
        return records.repartition(num_partitions)
    # Let AQE pick the partition count and split skewed partitions.
    return records.hint("rebalance")


def provided_source(
    spark: SparkSession,
    source_id: str,
    entity_type: str,
    connection: Connection,
    query: str,
    mapping: RecordMapping,
    schema: T.StructType | None = None,
    id_column: str | None = None,
    on_null: str = "raise",
) -> RecordSource:
    """A source that reads ``query`` through ``connection`` on first use."""
    return RecordSource(
        source_id, entity_type,
        lambda: map_records(connection.read(spark, query, schema, id_column), mapping, on_null),
    )


def select_sources(
    sources: Sequence[RecordSource], enabled: Iterable[str] | None
) -> list[RecordSource]:
    """Keep the sources whose id is enabled for the project (P6); None = all."""
    if enabled is None:
        return list(sources)
    allowed = set(enabled)
    return [s for s in sources if s.source_id in allowed]


def tag_sources(sources: Sequence[RecordSource], columns: Sequence[str]) -> DataFrame | None:
    """Union of the sources' records with ``source_id`` and ``entity_type``."""
    parts = [
        s.records.select(
            F.lit(s.source_id).alias("source_id"),
            F.lit(s.entity_type).alias("entity_type"),
            *columns,
        )
        for s in sources
    ]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
