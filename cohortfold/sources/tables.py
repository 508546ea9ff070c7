"""The given parquet tables as record sources.

This plays the part of the original's resource providers: for each
(source, entity type) a query over the stored tables and a mapping to
canonical records. Columns not named by a mapping are pruned at the scan.

=========  ==========  ===========  ==================================  ================
source     type        patient      record                              code / status / value
=========  ==========  ===========  ==================================  ================
a          order       o_custkey    o_orderkey                          priority / order status / total price
b          order       o_custkey    l_orderkey-l_linenumber (repeats)   priority / line status / extended price
a          event       user_id      event_id                            event type / NULL / value
docs       token       doc_id       doc_id-position                     the lower-cased word
=========  ==========  ===========  ==================================  ================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortfold.operators.records import (
    RecordMapping,
    RecordSource,
    map_records,
    rebalance,
)

# Fixed value: word boundary used for the token source (letters and digits
# form words; everything else separates them).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def load_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


ORDER_A = RecordMapping(
    patient="o_custkey",
    record="o_orderkey",
    attributes={
        "code": "o_orderpriority",
        "status": "o_orderstatus",
        "value": "CAST(o_totalprice AS DOUBLE)",
        "ts": "o_orderdate",
    },
)

ORDER_B = RecordMapping(
    patient="o_custkey",
    record="concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING))",
    attributes={
        "code": "o_orderpriority",
        "status": "l_linestatus",
        "value": "CAST(l_extendedprice AS DOUBLE)",
        "ts": "l_shipdate",
    },
)

EVENT_A = RecordMapping(
    patient="user_id",
    record="event_id",
    attributes={
        "code": "event_type",
        "status": "CAST(NULL AS STRING)",
        "value": "CAST(value AS DOUBLE)",
        "ts": "ts",
    },
)

TOKEN = RecordMapping(
    patient="doc_id",
    record="concat_ws('-', CAST(doc_id AS STRING), CAST(pos AS STRING))",
    attributes={"code": "token"},
)


def order_records_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"]
    return map_records(load_table(spark, sf_dir, "orders", cols), ORDER_A)


def order_records_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load_table(
        spark, sf_dir, "lineitem",
        ["l_orderkey", "l_linenumber", "l_linestatus", "l_extendedprice", "l_shipdate"],
    )
    # The other join side: the planner picks broadcast or shuffle by its size.
    orders = load_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "inner")
    return map_records(joined, ORDER_B)


def event_records_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["event_id", "user_id", "event_type", "value", "ts"]
    return map_records(load_table(spark, sf_dir, "events", cols), EVENT_A)


def token_records(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """One record per word of each whole document; position is 0-based.

    ``partitions``: spread the documents first (P3), for a table that is one
    unsplittable row group.
    """
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "text"])
    if partitions:
        docs = rebalance(docs, partitions)
    words = docs.select(
        "doc_id",
        F.posexplode(F.split(F.lower(F.col("text")), TOKEN_SPLIT)).alias("pos", "token"),
    ).where(F.col("token") != "")
    return map_records(words, TOKEN)


def clinical_sources(spark: SparkSession, sf_dir: str) -> list[RecordSource]:
    """The three (source, type) pairs of the two-source job."""
    return [
        RecordSource("a", "order", order_records_a(spark, sf_dir)),
        RecordSource("b", "order", order_records_b(spark, sf_dir)),
        RecordSource("a", "event", event_records_a(spark, sf_dir)),
    ]


def token_source(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> RecordSource:
    return RecordSource("docs", "token", token_records(spark, sf_dir, partitions))
