"""

(spark, sf_dir) -> DataFrame; ``oracle_sql()`` gives the same result in SQL.
Doubles are rounded to 6 places here (never in the engine) because summation
order is not fixed.
"""

from __future__ import annotations

import importlib.util
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortfold.functions.bm25 import BM25, TfIdf
from cohortfold.operators import statistics as st
from cohortfold.operators.hierarchy import CodeHierarchy
from cohortfold.operators.matching import criteria_matches
from cohortfold.operators.merge import LEAF_SCORE_SCHEMA, cross_source_merge, union_all
from cohortfold.operators.records import (
    RecordMapping,
    map_records,
    patient_keys,
    rebalance,
    select_sources,
    tag_sources,
    typed_projection,
)
from cohortfold.operators.scoring import LeafScores, score_leaves
from cohortfold.plans.criteria import AllOf, AnyOf, AtLeast, Leaf, Not, leaves_by_type
from cohortfold.plans.job import run_cohort_job
from cohortfold.session import checkpoint_dir
from cohortfold.sources.files import CatalogConnection, FileConnection
from cohortfold.sources.provider import ParquetRowGroups, ProviderConnection, register
from cohortfold.sources.tables import (
    clinical_sources,
    event_records_a,
    order_records_a,
    order_records_b,
    token_source,
)

FLAGSHIP_SF = "/root/testdata/sf0.001"

# Fixed query parameters: criterion and job ids (mixed case on purpose; the
# engine upper-cases them) and the leaf tests.
JOB_UID = "7d3f9a2e-4b1c-4e8a-9F6d-2c5b8a1e0f3d"
L1 = Leaf("5b0e7c1a-2f4d-4a8e-9c3b-7D1E6F2A8B40", "order", "code = '1-URGENT'")
L2 = Leaf("9C4d2e8f-1a3b-4c5d-8e7f-0a1b2c3d4e5f", "order", "status = 'F' AND value > 60000")
L3 = Leaf("e2f1a0b9-8c7d-4e6f-a5b4-C3D2E1F0A9B8", "event", "code = 'error'")
L4 = Leaf("0a9b8c7d-6e5f-4a3b-9c1d-E0F1A2B3C4D5", "order", "code = '5-LOW'")
SLICE_A = Leaf("11111111-2222-4333-8444-55555555AAAA", "order", "code = '1-URGENT'")
SLICE_B = Leaf("66666666-7777-4888-9999-AAAAAAAABBBB", "order", "status = 'F' AND value > 200000")
CODES_1 = Leaf("c0de0001-aaaa-4bbb-8ccc-ddddeeeeffff", "order", codes=["1-URGENT", "2-HIGH"])
CODES_2 = Leaf("c0de0002-aaaa-4bbb-8ccc-ddddeeeeffff", "order", codes=["2-HIGH", "3-MEDIUM"])
# The first two get their codes from tables, see q_bm25_code_table_scores.
CODES_DEAR = Leaf("c0de7ab1-0001-4bbb-8ccc-ddddeeeeffff", "order", codes=[])
CODES_EARLY = Leaf("c0de7ab1-0002-4bbb-8ccc-ddddeeeeffff", "order", codes=[])
CODES_LOW = Leaf("c0de7ab1-0003-4bbb-8ccc-ddddeeeeffff", "order", codes=["5-LOW", "no such code"])
TOKEN_WORDS = ["the", "der", "license", "de"]
TOKEN_LEAVES = [
    Leaf(f"70ce0000-0000-4000-8000-{i:012d}", "token", f"code = '{w}'")
    for i, w in enumerate(TOKEN_WORDS)
]

# Wide trees: leaf k tests value > step * k.
WIDE_STEP = 5000


def _wide_leaves(n: int, step: int) -> list[Leaf]:
    return [Leaf(f"3a1d0000-0000-4000-8000-{k:012d}", "order", f"value > {step * k}") for k in range(n)]


WIDE_LEAVES = _wide_leaves(80, WIDE_STEP)
TREE_WIDE = AtLeast(10, *WIDE_LEAVES)
WIDEST_LEAVES = _wide_leaves(200, 2000)
TREE_WIDEST = AtLeast(25, *WIDEST_LEAVES)

TREE = AllOf(L1, AnyOf(L2, L3))
TREE_MIXED = AnyOf(AllOf(L1, Not(L3)), AtLeast(2, L2, L3, L4))
ENABLED = ["a"]


def _leaves(*leaves: Leaf) -> dict[str, Leaf]:
    return {leaf.key: leaf for leaf in leaves}


def _r6(name: str) -> F.Column:
    return F.round(F.col(name), 6).alias(name)


def _score_all(spark: SparkSession, sf_dir: str, tree=TREE, **kw) -> list[LeafScores]:
    """Leaf scores of every (source, type) that offers one of the tree's types."""
    out = []
    for entity_type, leaves in leaves_by_type(tree).items():
        for src in clinical_sources(spark, sf_dir):
            if src.entity_type == entity_type:
                out.append(
                    score_leaves(
                        src.records, leaves, source_id=src.source_id, entity_type=entity_type, **kw
                    )
                )
    return out


def _tagged(parts: list[LeafScores], attr: str) -> DataFrame:
    frames = [
        getattr(p, attr).select(
            F.lit(p.source_id).alias("source_id"), F.lit(p.entity_type).alias("entity_type"), "*"
        )
        for p in parts
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --------------------------------------------------------------------------
# Queries
# --------------------------------------------------------------------------


def q_bm25_leaf_scores(spark, sf_dir, plan="long"):
    part = score_leaves(
        order_records_a(spark, sf_dir), _leaves(SLICE_A, SLICE_B), source_id="a",
        entity_type="order", plan=plan, evidence=False,
    )
    return part.scores.select("criterion_uid", "patient_uid", "tf", _r6("score"))


def q_bm25_leaf_scores_wide(spark, sf_dir):
    return q_bm25_leaf_scores(spark, sf_dir, plan="wide")


def q_bm25_leaf_scores_tokens(spark, sf_dir):
    src = token_source(spark, sf_dir)
    part = score_leaves(
        src.records, _leaves(*TOKEN_LEAVES), source_id=src.source_id, entity_type="token", evidence=False
    )
    return part.scores.select("criterion_uid", "patient_uid", "tf", "doc_len", _r6("score"))


def q_bm25_leaf_scores_no_evidence(spark, sf_dir):
    # Scores only, 80 leaves: the long plan counted per (patient, leaf).
    part = score_leaves(
        order_records_a(spark, sf_dir), _leaves(*WIDE_LEAVES), source_id="a",
        entity_type="order", evidence=False,
    )
    return part.scores.select("criterion_uid", "patient_uid", "tf", "doc_len", _r6("score"))


def q_bm25_code_leaf_scores(spark, sf_dir):
    part = score_leaves(
        order_records_b(spark, sf_dir), _leaves(CODES_1, CODES_2), source_id="b",
        entity_type="order", evidence=False,
    )
    return part.scores.select("criterion_uid", "patient_uid", "tf", "doc_len", _r6("score"))


def q_bm25_code_table_scores(spark, sf_dir):
    # Codes held in Spark: the priorities of the dearest and of the earliest orders.
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dear = orders.where("o_totalprice > 499900").select("o_orderpriority")
    early = orders.where("o_orderdate < DATE '1995-01-02'").select(F.col("o_orderpriority").alias("p"))
    leaves = _leaves(
        Leaf(CODES_DEAR.uid, "order", code_table=dear), Leaf(CODES_EARLY.uid, "order", code_table=early), CODES_LOW
    )
    part = score_leaves(
        order_records_b(spark, sf_dir), leaves, source_id="b", entity_type="order", evidence=False
    )
    return part.scores.select("criterion_uid", "patient_uid", "tf", "doc_len", _r6("score"))


# Codes below a root: region -> nation -> customer, with edges that run back up.
UNDER = {"c0de7ee0-0001-4bbb-8ccc-ddddeeeeffff": ["R1"], "c0de7ee0-0002-4bbb-8ccc-ddddeeeeffff": ["N3", "N7", "no such code"]}


def q_code_hierarchy_scores(spark, sf_dir):
    # Suppliers scored by their lines for customers at or below the roots.
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('R', n_regionkey) AS parent", "concat('N', n_nationkey) AS child")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('N', c_nationkey) AS parent", "concat('C', c_custkey) AS child")
    back = nation.where("child = 'N3'").selectExpr("child AS parent", "child").unionByName(
        customer.where("child LIKE 'C%9'").selectExpr("child AS parent", "parent AS child")
    )
    edges = nation.unionByName(customer).unionByName(back)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(
        spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    records = map_records(lines, RecordMapping("l_suppkey", "concat_ws('-', l_orderkey, l_linenumber)", {"code": "concat('C', o_custkey)"}))
    leaves = CodeHierarchy(edges).leaves(spark, "line", UNDER)
    part = score_leaves(records, _leaves(*leaves), source_id="lines", entity_type="line", evidence=False)
    return part.scores.select("criterion_uid", "patient_uid", "tf", "doc_len", _r6("score"))


# A leaf of each comparison that is looked up in the index over its column, and one that is not.
INDEXED = [
    "value > 150000", "value >= 901", "value < 20000.5", "value <= 901", "value = 901", "value <> 901", "value BETWEEN 1000 AND 90000.25",
    "value IN (901, 902.01, 5000)", "code = '1-URGENT'", "code <> '5-LOW'", "code >= '3-MEDIUM'", "code IN ('2-HIGH', 'none')",
    "status != 'F'", "value > 100000 AND status = 'O'",
]
INDEX_LEAVES = [Leaf(f"1dec5000-0000-4000-8000-{k:012d}", "order", p) for k, p in enumerate(INDEXED)]


def q_criteria_match_index(spark, sf_dir):
    return criteria_matches(order_records_a(spark, sf_dir), _leaves(*INDEX_LEAVES))


def q_nested_projection(spark, sf_dir):
    # S2 at depth: fields declared in another order, type and case than they come in, some not at all.
    flagged = F.struct("l_returnflag", "l_linestatus", F.col("l_quantity").alias("q.ty"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", F.array(F.struct("l_linenumber", flagged.alias("l_flags"))).alias("lines"),
        F.create_map("l_linenumber", F.struct(F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("off"))).alias("prices"),
    )
    flags = T.StructType([T.StructField("q.ty", T.IntegerType()), T.StructField("L_LINESTATUS", T.StringType()), T.StructField("l_returnflag", T.StringType())])
    line = T.StructType([T.StructField("l_flags", flags), T.StructField("l_linenumber", T.StringType())])
    price = T.StructType([T.StructField("off", T.DoubleType()), T.StructField("price", T.DoubleType())])
    declared = T.StructType([
        T.StructField("prices", T.MapType(T.StringType(), price)), T.StructField("lines", T.ArrayType(line)), T.StructField("l_orderkey", T.StringType()),
    ])
    shaped = typed_projection(lines, declared).select("l_orderkey", F.explode("lines").alias("line"), "prices")
    entry_of = F.element_at("prices", F.col("line.l_linenumber"))
    return shaped.select(
        "l_orderkey", F.col("line.l_linenumber").alias("line_number"), F.col("line.l_flags.`q.ty`").alias("quantity"),
        F.col("line.l_flags.L_LINESTATUS").alias("status"), F.col("line.l_flags.l_returnflag").alias("flag"),
        entry_of.getField("price").alias("price"), entry_of.getField("off").alias("off"),
    )


# E2 on nested records: sentences of a turn are its entries; a test holds of one entry as a whole.
NESTED = [
    ("entry.n_chars > 80 AND entry.place < 3", 1), ("entry.n_chars BETWEEN 1 AND 14 AND entry.place >= 5", 1),
    ("entry.n_chars > 60 AND entry.place > turn AND role = 'user'", 1), ("entry.n_chars > 50", 3), ("entry.n_chars > 1000000", 1),
]
NESTED_LEAVES = [Leaf(f"5e17e9ce-0000-4000-8000-{k:012d}", "turn", p, entry="sentences", entries=n) for k, (p, n) in enumerate(NESTED)]


def q_nested_entry_scores(spark, sf_dir):
    sentences = "transform(split(text, '[.!?\\n]'), (s, i) -> struct(i AS place, length(s) AS n_chars))"
    mapping = RecordMapping("conv_id", "concat_ws('-', conv_id, turn)", {"turn": "turn", "role": "role", "sentences": sentences})
    records = map_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"), mapping)
    part = score_leaves(records, _leaves(*NESTED_LEAVES), source_id="chat", entity_type="turn", evidence=False)
    return part.scores.select("criterion_uid", "patient_uid", "tf", "doc_len", _r6("score"))


def q_scan_provider(spark, sf_dir):
    # A provider behind spark.read.format, one task a row group, columns by the schema.
    register(spark, "row_groups", ParquetRowGroups(f"{sf_dir}/"))
    schema = T.StructType([T.StructField("l_suppkey", T.StringType()), T.StructField("l_quantity", T.DoubleType()), T.StructField("l_returnflag", T.StringType())])
    lines = ProviderConnection("row_groups").read(spark, "lineitem.parquet", schema)
    return lines.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


SCAN_SQL = """
SELECT o_custkey, count(*) AS n_orders, max(o_orderkey) AS last_key, count(DISTINCT o_orderpriority) AS n_priorities
FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey"""


def q_scan_sql(spark, sf_dir):
    # S3: query text over catalog views, projected to a declared schema.
    view = f"cohortfold_orders_{uuid.uuid4().hex[:12]}"
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView(view)
    declared = T.StructType(
        [T.StructField("n_orders", T.IntegerType()), T.StructField("o_custkey", T.StringType()), T.StructField("last_key", T.LongType())]
    )
    return CatalogConnection().read(spark, SCAN_SQL.format(orders=view), declared)


def q_csv_round_trip(spark, sf_dir):
    # Written to the shared folder as CSV with a header, read back by name in another order.
    base = f"{checkpoint_dir(spark).rstrip('/')}/cohortfold/{uuid.uuid4().hex}/"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_linestatus", F.col("l_extendedprice").cast("decimal(15,2)").alias("price"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("flag"),
    )
    lines.write.option("header", "true").csv(f"{base}lines")
    declared = T.StructType(
        [
            T.StructField("price", T.DecimalType(15, 2)),
            T.StructField("flag", T.StringType()),
            T.StructField("l_linenumber", T.IntegerType()),
            T.StructField("l_orderkey", T.LongType()),
        ]
    )
    conn = FileConnection(path=base, format="csv", read_options={"header": "true"})
    return conn.read(spark, "lines", declared).withColumn("price", F.col("price").cast("double"))


ORDERS_DECLARED = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.StringType()),
        T.StructField("o_orderpriority", T.StringType()),
        T.StructField("o_totalprice", T.DecimalType(15, 2)),
        T.StructField("o_orderdate", T.DateType()),
    ]
)

LINES_DECLARED = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_extendedprice", T.DoubleType()),
    ]
)


def q_typed_projection(spark, sf_dir):
    return typed_projection(spark.read.parquet(f"{sf_dir}/orders.parquet"), ORDERS_DECLARED)


def q_scan_generic(spark, sf_dir):
    conn = FileConnection(path=f"{sf_dir.rstrip('/')}/", format="parquet")
    return conn.read(spark, "lineitem.parquet", LINES_DECLARED, id_column="l_orderkey")


def q_records_projection(spark, sf_dir):
    return order_records_b(spark, sf_dir).select(
        "patient_uid", "record_uid", "code", "status", "value"
    )


def q_patient_keying(spark, sf_dir):
    return patient_keys(event_records_a(spark, sf_dir))


def q_rebalance(spark, sf_dir):
    # An explicit round-robin spread; rows must come through unchanged.
    return rebalance(order_records_a(spark, sf_dir), 16).select(
        "patient_uid", "record_uid", "code", "status", "value"
    )


def q_criteria_match(spark, sf_dir):
    return criteria_matches(order_records_b(spark, sf_dir), _leaves(L1, L2))


def q_criteria_match_codes(spark, sf_dir):
    return criteria_matches(order_records_b(spark, sf_dir), _leaves(CODES_1, CODES_2))


def q_source_filter(spark, sf_dir):
    chosen = select_sources(clinical_sources(spark, sf_dir), ENABLED)
    return tag_sources(chosen, ["patient_uid", "record_uid"])


def _stats_parts(spark, sf_dir, materialize=None):
    # Where only one statistic is read, no intermediate is written.
    return _score_all(spark, sf_dir, materialize=materialize, evidence=False)


def q_collection_size(spark, sf_dir):
    return _tagged(_stats_parts(spark, sf_dir), "stats").select("source_id", "entity_type", "n_docs")


def q_avg_doc_length(spark, sf_dir):
    return _tagged(_stats_parts(spark, sf_dir), "stats").select(
        "source_id", "entity_type", _r6("avg_doc_len")
    )


def q_doc_length(spark, sf_dir):
    return _tagged(_stats_parts(spark, sf_dir), "doc_len")


def q_doc_frequency(spark, sf_dir):
    return _tagged(_stats_parts(spark, sf_dir), "doc_freq")


def _source_b_base(spark, sf_dir):
    from cohortfold.operators.matching import tagged_counts

    return tagged_counts(order_records_b(spark, sf_dir), _leaves(L1, L2))


def q_distinct_pairs(spark, sf_dir):
    return st.distinct_pairs(_source_b_base(spark, sf_dir))


def q_term_frequency(spark, sf_dir):
    return st.term_frequencies(_source_b_base(spark, sf_dir))


def q_evidence_sets(spark, sf_dir):
    return st.evidence_rows(_source_b_base(spark, sf_dir))


def _source_a(spark, sf_dir, **kw):
    return score_leaves(
        order_records_a(spark, sf_dir), _leaves(L1, L2), source_id="a", entity_type="order", **kw
    )


def q_idf(spark, sf_dir):
    from cohortfold.functions.bm25 import idf

    parts = _stats_parts(spark, sf_dir, "write")  # df and N both read it
    frames = [
        p.doc_freq.crossJoin(F.broadcast(p.stats)).select(
            F.lit(p.source_id).alias("source_id"),
            F.lit(p.entity_type).alias("entity_type"),
            "criterion_uid",
            F.round(idf(F.col("n_docs"), F.col("doc_freq")), 6).alias("idf"),
        )
        for p in parts
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def q_bm25_score(spark, sf_dir):
    part = _source_a(spark, sf_dir, scorer=BM25(k1=2.0, b=0.5))
    return part.scores.select("criterion_uid", "patient_uid", _r6("score"))


def q_custom_scorer(spark, sf_dir):
    part = _source_a(spark, sf_dir, scorer=TfIdf())
    return part.scores.select("criterion_uid", "patient_uid", _r6("score"))


def q_tf_idf_join(spark, sf_dir):
    from cohortfold.functions.bm25 import idf

    part = _source_a(spark, sf_dir)
    joined = part.tf.join(F.broadcast(part.doc_freq), "criterion_uid")
    joined = st.attach_scalars(joined, part.stats)
    return joined.select(
        "criterion_uid", "patient_uid", "tf", "doc_freq",
        F.round(idf(F.col("n_docs"), F.col("doc_freq")), 6).alias("idf"),
    )


def q_doc_len_join(spark, sf_dir):
    part = _source_a(spark, sf_dir)
    return part.tf.join(part.doc_len, "patient_uid").select(
        "criterion_uid", "patient_uid", "tf", "doc_len"
    )


def q_scalar_broadcast(spark, sf_dir):
    part = _source_a(spark, sf_dir, materialize=None)
    return st.attach_scalars(part.doc_len, part.stats).select(
        "patient_uid", "doc_len", "n_docs", _r6("avg_doc_len")
    )


def q_score_evidence_join(spark, sf_dir):
    part = score_leaves(
        order_records_b(spark, sf_dir), _leaves(L1, L2), source_id="b", entity_type="order"
    )
    return part.evidence.select("criterion_uid", "patient_uid", "record_uid", _r6("score"))


def q_leaf_score_union(spark, sf_dir):
    parts = _score_all(spark, sf_dir)
    return union_all(spark, [p.scores for p in parts], LEAF_SCORE_SCHEMA).select(
        "source_id", "entity_type", "criterion_uid", "patient_uid", "tf", "doc_len",
        _r6("score"), "data_source_count",
    )


def q_cross_source_merge(spark, sf_dir):
    parts = _score_all(spark, sf_dir)
    scores = union_all(spark, [p.scores for p in parts], LEAF_SCORE_SCHEMA)
    return cross_source_merge(scores).select(
        "patient_uid", "criterion_uid", _r6("score_sum"), "data_source_count"
    )


def _job(spark, sf_dir, tree=TREE, enabled=None, evidence=False):
    return run_cohort_job(
        spark, clinical_sources(spark, sf_dir), tree, JOB_UID, enabled_sources=enabled, evidence=evidence
    )


def q_cohort_scores(spark, sf_dir):
    return _job(spark, sf_dir).cohort.select("person_uid", _r6("score"))


def q_cohort_scores_mixed(spark, sf_dir):
    return _job(spark, sf_dir, TREE_MIXED).cohort.select("person_uid", _r6("score"))


def q_cohort_scores_wide_tree(spark, sf_dir):
    return _job(spark, sf_dir, TREE_WIDE).cohort.select("person_uid", _r6("score"))


def q_cohort_scores_widest_tree(spark, sf_dir):
    return _job(spark, sf_dir, TREE_WIDEST).cohort.select("person_uid", _r6("score"))


def q_cohort_output(spark, sf_dir):
    return _job(spark, sf_dir).cohort.select("job_uid", "person_uid", _r6("score"))


def q_evidence_output(spark, sf_dir):
    ev = _job(spark, sf_dir, evidence=True).evidence
    return ev.select("job_uid", "node_uid", "person_uid", "evidence_uid", _r6("score"))


def q_cohort_job_filtered(spark, sf_dir):
    res = _job(spark, sf_dir, TREE, ENABLED)
    return res.cohort.select("job_uid", "person_uid", _r6("score"))


def q_cohort_job_all(spark, sf_dir):
    return _job(spark, sf_dir, TREE_MIXED).cohort.select("job_uid", "person_uid", _r6("score"))


def q_cohort_job_all_evidence(spark, sf_dir):
    ev = _job(spark, sf_dir, TREE_MIXED, evidence=True).evidence
    return ev.select("job_uid", "node_uid", "person_uid", "evidence_uid", _r6("score"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the two-source, three-leaf cohort job on sf0.001."""
    return q_cohort_output(spark, FLAGSHIP_SF)


def _llm():
    """The training-data queries, if their subpackage is there."""
    if importlib.util.find_spec("cohortfold.llm") is None or importlib.util.find_spec("cohortfold.llm.queries") is None:
        return None
    from cohortfold.llm import queries as llm_queries

    return llm_queries


def _pipeline():
    """The corpus pipeline, if it is there."""
    if _llm() is None or importlib.util.find_spec("corpus_pipeline") is None:
        return None
    import corpus_pipeline

    return corpus_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(_core_queries())
    if (llm := _llm()) is not None:
        found.update(llm.QUERIES)
    if (pipeline := _pipeline()) is not None:
        found["pipeline"] = pipeline.run
    return found


def _core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "typed_projection": q_typed_projection,
        "scan_generic": q_scan_generic,
        "records_projection": q_records_projection,
        "patient_keying": q_patient_keying,
        "rebalance": q_rebalance,
        "criteria_match": q_criteria_match,
        "criteria_match_codes": q_criteria_match_codes,
        "criteria_match_index": q_criteria_match_index,
        "code_hierarchy_scores": q_code_hierarchy_scores,
        "nested_projection": q_nested_projection,
        "nested_entry_scores": q_nested_entry_scores,
        "source_filter": q_source_filter,
        "collection_size": q_collection_size,
        "doc_length": q_doc_length,
        "avg_doc_length": q_avg_doc_length,
        "distinct_pairs": q_distinct_pairs,
        "doc_frequency": q_doc_frequency,
        "term_frequency": q_term_frequency,
        "evidence_sets": q_evidence_sets,
        "cross_source_merge": q_cross_source_merge,
        "tf_idf_join": q_tf_idf_join,
        "doc_len_join": q_doc_len_join,
        "scalar_broadcast": q_scalar_broadcast,
        "score_evidence_join": q_score_evidence_join,
        "idf": q_idf,
        "bm25_score": q_bm25_score,
        "leaf_score_union": q_leaf_score_union,
        "bm25_leaf_scores": q_bm25_leaf_scores,
        "bm25_leaf_scores_wide": q_bm25_leaf_scores_wide,
        "bm25_leaf_scores_tokens": q_bm25_leaf_scores_tokens,
        "bm25_leaf_scores_no_evidence": q_bm25_leaf_scores_no_evidence,
        "bm25_code_leaf_scores": q_bm25_code_leaf_scores,
        "bm25_code_table_scores": q_bm25_code_table_scores,
        "scan_sql": q_scan_sql,
        "scan_provider": q_scan_provider,
        "csv_round_trip": q_csv_round_trip,
        "custom_scorer": q_custom_scorer,
        "cohort_scores": q_cohort_scores,
        "cohort_scores_mixed": q_cohort_scores_mixed,
        "cohort_scores_wide_tree": q_cohort_scores_wide_tree,
        "cohort_scores_widest_tree": q_cohort_scores_widest_tree,
        "cohort_output": q_cohort_output,
        "evidence_output": q_evidence_output,
        "cohort_job_filtered": q_cohort_job_filtered,
        "cohort_job_all": q_cohort_job_all,
        "cohort_job_all_evidence": q_cohort_job_all_evidence,
    }


# --------------------------------------------------------------------------
# --------------------------------------------------------------------------

_REC = """
rec AS (
  SELECT 'a' AS src, 'order' AS t, CAST(o_custkey AS VARCHAR) AS p, CAST(o_orderkey AS VARCHAR) AS r,
         o_orderpriority AS code, o_orderstatus AS status, o_totalprice AS val FROM orders
  UNION ALL
  SELECT 'b', 'order', CAST(o_custkey AS VARCHAR), concat_ws('-', l_orderkey, l_linenumber),
         o_orderpriority, l_linestatus, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 'a', 'event', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR),
         event_type, NULL, value FROM events)"""


def _match_cte(leaves: list[tuple[Leaf, str]]) -> str:
    """leaves: (leaf, SQL condition over rec columns code/status/val)."""
    parts = [
        f"SELECT *, '{leaf.key}' AS c FROM rec WHERE t = '{leaf.entity_type}' AND ({cond})"
        for leaf, cond in leaves
    ]
    return "m AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def _stats_ctes(k1: float = 1.2, b: float = 0.75) -> str:
    return f"""
dl AS (SELECT src, t, p, count(*) AS dl FROM rec GROUP BY ALL),
st AS (SELECT src, t, count(*) AS n, avg(dl) AS av FROM dl GROUP BY ALL),
tf AS (SELECT src, t, c, p, count(*) AS tf FROM m GROUP BY ALL),
df AS (SELECT src, t, c, count(*) AS df FROM tf GROUP BY ALL),
s AS (
  SELECT src, t, c, p, tf, dl, n, av, df,
         ln((n - df + 0.5) / (df + 0.5) + 1) AS idf,
         ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * {k1 + 1.0})
           / (tf + {k1} * (1 - {b} + {b} * (dl / av))) AS s
  FROM tf JOIN df USING (src, t, c) JOIN dl USING (src, t, p) JOIN st USING (src, t))"""


COND = {
    L1: "code = '1-URGENT'",
    L2: "status = 'F' AND val > 60000",
    L3: "code = 'error'",
    L4: "code = '5-LOW'",
    SLICE_A: "code = '1-URGENT'",
    SLICE_B: "status = 'F' AND val > 200000",
    CODES_1: "code IN ('1-URGENT', '2-HIGH')",
    CODES_2: "code IN ('2-HIGH', '3-MEDIUM')",
    **{leaf: f"code = '{w}'" for leaf, w in zip(TOKEN_LEAVES, TOKEN_WORDS)},
    **{leaf: f"val > {WIDE_STEP * k}" for k, leaf in enumerate(WIDE_LEAVES)},
    **{leaf: f"val > {2000 * k}" for k, leaf in enumerate(WIDEST_LEAVES)},
    CODES_DEAR: "code IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 499900)",
    CODES_EARLY: "code IN (SELECT o_orderpriority FROM orders WHERE o_orderdate < DATE '1995-01-02')",
    CODES_LOW: "code IN ('5-LOW', 'no such code')",
}


def _with(leaves: list[Leaf], k1: float = 1.2, b: float = 0.75, rec: str = _REC) -> str:
    return (
        "WITH "
        + rec.strip()
        + ",\n"
        + _match_cte([(l, COND[l]) for l in leaves])
        + ","
        + _stats_ctes(k1, b)
        + "\n"
    )


def _tree_sql(leaves: list[Leaf], select_cols: str, where: str = "") -> str:
    """Per-patient leaf values (mean over sources), then ``select_cols``.

    In ``select_cols``, v<i> is leaf i's value (NULL when unmatched) and
    s<i> = coalesce(v<i>, 0).
    """
    cols = ",\n  ".join(
        f"max(v) FILTER (WHERE c = '{l.key}') AS v{i}" for i, l in enumerate(leaves)
    )
    svals = ", ".join(f"coalesce(v{i}, 0) AS s{i}" for i in range(len(leaves)))
    return (
        _with(leaves)
        + f""", mg AS (SELECT p, c, sum(s) / count(*) AS v FROM s {where} GROUP BY ALL),
w AS (SELECT p,
  {cols}
  FROM mg GROUP BY p),
w2 AS (SELECT *, {svals} FROM w)
SELECT {select_cols} FROM w2"""
    )


def _at_least_sql(leaves: list[Leaf], k: int) -> str:
    """One AtLeast node over ``leaves``."""
    matched = ", ".join(f"('{leaf.key}')" for leaf in leaves)
    return _with(leaves) + f""", mg AS (SELECT p, c, sum(s) / count(*) AS v FROM s GROUP BY ALL),
lf(c) AS (VALUES {matched})
SELECT p AS person_uid, round(CASE WHEN count(lf.c) >= {k} THEN sum(v) ELSE 0 END, 6) AS score
FROM mg LEFT JOIN lf USING (c) GROUP BY p"""


_TREE_SCORE = "CASE WHEN v0 IS NOT NULL AND (v1 IS NOT NULL OR v2 IS NOT NULL) THEN s0 + s1 + s2 ELSE 0 END"
_MIXED_SCORE = (
    "(CASE WHEN v0 IS NOT NULL AND NOT (v2 IS NOT NULL) THEN s0 ELSE 0 END)"
    " + (CASE WHEN (CAST(v1 IS NOT NULL AS INT) + CAST(v2 IS NOT NULL AS INT)"
    " + CAST(v3 IS NOT NULL AS INT)) >= 2 THEN s1 + s2 + s3 ELSE 0 END)"
)

_TOKEN_REC = r"""
rec AS (
  SELECT 'docs' AS src, 'token' AS t, CAST(doc_id AS VARCHAR) AS p,
         concat_ws('-', doc_id, i - 1) AS r, w AS code, NULL AS status, NULL AS val
  FROM (SELECT doc_id, unnest(arr) AS w, unnest(generate_series(1, len(arr))) AS i
        FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS arr
              FROM documents))
  WHERE w <> '')"""


def oracle_sql() -> dict[str, str]:
    found = dict(_core_oracles())
    if (llm := _llm()) is not None:
        found.update(llm.ORACLES)
    if (pipeline := _pipeline()) is not None and pipeline.ORACLE_SQL:
        found["pipeline"] = pipeline.ORACLE_SQL
    return found


def _core_oracles() -> dict[str, str]:
    job = JOB_UID.upper()
    main = [L1, L2, L3]
    mixed = [L1, L2, L3, L4]

    def tree(leaves, score, cols, where=""):
        return _tree_sql(leaves, cols, where)

    main_with = _with(main)
    b_with = _with([L1, L2])
    return {
        "typed_projection": """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority,
       CAST(o_totalprice AS DECIMAL(15, 2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
FROM orders""",
        "scan_generic": "SELECT l_orderkey, l_linenumber, l_linestatus, l_extendedprice FROM lineitem",
        "records_projection": "WITH " + _REC.strip() + """
SELECT p AS patient_uid, r AS record_uid, code, status, val AS value FROM rec WHERE src = 'b'""",
        "patient_keying": """
SELECT CAST(user_id AS VARCHAR) AS patient_uid, CAST(event_id AS VARCHAR) AS record_uid FROM events""",
        "rebalance": "WITH " + _REC.strip() + """
SELECT p AS patient_uid, r AS record_uid, code, status, val AS value FROM rec WHERE src = 'a' AND t = 'order'""",
        "criteria_match": b_with
        + "SELECT c AS criterion_uid, p AS patient_uid, r AS record_uid FROM m WHERE src = 'b'",
        "criteria_match_index": "WITH " + _REC.strip() + "\n" + "\nUNION ALL ".join(
            f"SELECT '{leaf.key}' AS criterion_uid, p AS patient_uid, r AS record_uid FROM rec WHERE src = 'a' AND t = 'order' AND ({leaf.predicate.replace('value', 'val')})"
            for leaf in INDEX_LEAVES
        ),
        "code_hierarchy_scores": f"""
WITH RECURSIVE edges AS (
  SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION ALL SELECT 'N3', 'N3' FROM nation WHERE n_nationkey = 3
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer WHERE ('C' || c_custkey) LIKE 'C%9'),
below(c, code) AS (
  SELECT * FROM (VALUES {', '.join(f"('{uid.upper()}', '{code}')" for uid, codes in UNDER.items() for code in codes)}) v(c, code)
  UNION SELECT c, child FROM below JOIN edges ON code = parent),
rec AS (
  SELECT 'lines' AS src, 'line' AS t, CAST(l_suppkey AS VARCHAR) AS p, 'C' || o_custkey AS code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT rec.*, c FROM rec JOIN below USING (code)),{_stats_ctes()}
SELECT c AS criterion_uid, p AS patient_uid, tf, dl AS doc_len, round(s, 6) AS score FROM s""",
        "nested_entry_scores": f"""
WITH turns AS (
  SELECT 'chat' AS src, 'turn' AS t, CAST(conv_id AS VARCHAR) AS p, conv_id, turn, role, string_split_regex(text, '[.!?\\n]') AS parts
  FROM conversations),
rec AS (SELECT * FROM turns),
entries AS (SELECT src, t, p, conv_id, turn, role, unnest(range(len(parts))) AS place, length(unnest(parts)) AS n_chars FROM turns),
m AS ({" UNION ALL ".join(
    f"SELECT src, t, p, '{leaf.key}' AS c FROM entries WHERE {leaf.predicate.replace('entry.', '')} "
    f"GROUP BY src, t, p, conv_id, turn HAVING count(*) >= {leaf.entries}" for leaf in NESTED_LEAVES)}),{_stats_ctes()}
SELECT c AS criterion_uid, p AS patient_uid, tf, dl AS doc_len, round(s, 6) AS score FROM s""",
        "scan_provider": """
SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, l_returnflag, count(*) AS n_lines, round(sum(CAST(l_quantity AS DOUBLE)), 6) AS quantity
FROM lineitem GROUP BY ALL""",
        "nested_projection": """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS line_number, CAST(trunc(l_quantity) AS INTEGER) AS quantity,
  l_linestatus AS status, l_returnflag AS flag, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS off
FROM lineitem""",
        "criteria_match_codes": _with([CODES_1, CODES_2])
        + "SELECT c AS criterion_uid, p AS patient_uid, r AS record_uid FROM m WHERE src = 'b'",
        "source_filter": "WITH " + _REC.strip() + """
SELECT src AS source_id, t AS entity_type, p AS patient_uid, r AS record_uid FROM rec WHERE src IN ('a')""",
        "collection_size": main_with
        + "SELECT src AS source_id, t AS entity_type, n AS n_docs FROM st",
        "doc_length": main_with
        + "SELECT src AS source_id, t AS entity_type, p AS patient_uid, dl AS doc_len FROM dl",
        "avg_doc_length": main_with
        + "SELECT src AS source_id, t AS entity_type, round(av, 6) AS avg_doc_len FROM st",
        "distinct_pairs": b_with
        + "SELECT DISTINCT c AS criterion_uid, p AS patient_uid FROM m WHERE src = 'b'",
        "doc_frequency": main_with
        + "SELECT src AS source_id, t AS entity_type, c AS criterion_uid, df AS doc_freq FROM df",
        "term_frequency": b_with
        + "SELECT c AS criterion_uid, p AS patient_uid, tf FROM tf WHERE src = 'b'",
        "evidence_sets": b_with
        + "SELECT DISTINCT c AS criterion_uid, p AS patient_uid, r AS record_uid FROM m WHERE src = 'b'",
        "cross_source_merge": main_with
        + """SELECT p AS patient_uid, c AS criterion_uid, round(sum(s), 6) AS score_sum,
       CAST(count(*) AS BIGINT) AS data_source_count FROM s GROUP BY p, c""",
        "tf_idf_join": _with([L1, L2])
        + """SELECT c AS criterion_uid, p AS patient_uid, tf, df AS doc_freq, round(idf, 6) AS idf
FROM s WHERE src = 'a'""",
        "doc_len_join": _with([L1, L2])
        + "SELECT c AS criterion_uid, p AS patient_uid, tf, dl AS doc_len FROM s WHERE src = 'a'",
        "scalar_broadcast": _with([L1, L2])
        + """SELECT p AS patient_uid, dl AS doc_len, n AS n_docs, round(av, 6) AS avg_doc_len
FROM dl JOIN st USING (src, t) WHERE src = 'a' AND t = 'order'""",
        "score_evidence_join": b_with
        + """SELECT c AS criterion_uid, p AS patient_uid, r AS record_uid, round(s, 6) AS score
FROM (SELECT DISTINCT src, t, c, p, r FROM m) JOIN s USING (src, t, c, p) WHERE src = 'b'""",
        "idf": main_with
        + """SELECT src AS source_id, t AS entity_type, c AS criterion_uid,
       round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df JOIN st USING (src, t)""",
        "bm25_score": _with([L1, L2], k1=2.0, b=0.5)
        + "SELECT c AS criterion_uid, p AS patient_uid, round(s, 6) AS score FROM s WHERE src = 'a'",
        "leaf_score_union": main_with
        + """SELECT src AS source_id, t AS entity_type, c AS criterion_uid, p AS patient_uid, tf,
       dl AS doc_len, round(s, 6) AS score, CAST(1 AS BIGINT) AS data_source_count FROM s""",
        "bm25_leaf_scores": _with([SLICE_A, SLICE_B])
        + "SELECT c AS criterion_uid, p AS patient_uid, tf, round(s, 6) AS score FROM s WHERE src = 'a'",
        "bm25_leaf_scores_wide": _with([SLICE_A, SLICE_B])
        + "SELECT c AS criterion_uid, p AS patient_uid, tf, round(s, 6) AS score FROM s WHERE src = 'a'",
        "bm25_leaf_scores_tokens": _with(TOKEN_LEAVES, rec=_TOKEN_REC)
        + """SELECT c AS criterion_uid, p AS patient_uid, tf, dl AS doc_len, round(s, 6) AS score
FROM s""",
        "bm25_leaf_scores_no_evidence": _with(WIDE_LEAVES)
        + """SELECT c AS criterion_uid, p AS patient_uid, tf, dl AS doc_len, round(s, 6) AS score
FROM s WHERE src = 'a'""",
        "bm25_code_leaf_scores": _with([CODES_1, CODES_2])
        + """SELECT c AS criterion_uid, p AS patient_uid, tf, dl AS doc_len, round(s, 6) AS score
FROM s WHERE src = 'b'""",
        "bm25_code_table_scores": _with([CODES_DEAR, CODES_EARLY, CODES_LOW])
        + """SELECT c AS criterion_uid, p AS patient_uid, tf, dl AS doc_len, round(s, 6) AS score
FROM s WHERE src = 'b'""",
        "scan_sql": f"""SELECT CAST(n_orders AS INT) AS n_orders, CAST(o_custkey AS VARCHAR) AS o_custkey, last_key
FROM ({SCAN_SQL.format(orders="orders")})""",
        "csv_round_trip": """SELECT CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS DOUBLE) AS price,
  CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag, l_linenumber, l_orderkey FROM lineitem""",
        "custom_scorer": _with([L1, L2])
        + """SELECT c AS criterion_uid, p AS patient_uid, round(tf * ln(1 + n / df), 6) AS score
FROM s WHERE src = 'a'""",
        "cohort_scores": tree(main, _TREE_SCORE, f"p AS person_uid, round({_TREE_SCORE}, 6) AS score"),
        "cohort_scores_mixed": tree(
            mixed, _MIXED_SCORE, f"p AS person_uid, round({_MIXED_SCORE}, 6) AS score"
        ),
        "cohort_scores_wide_tree": _at_least_sql(WIDE_LEAVES, 10),
        "cohort_scores_widest_tree": _at_least_sql(WIDEST_LEAVES, 25),
        "cohort_output": tree(
            main, _TREE_SCORE,
            f"'{job}' AS job_uid, p AS person_uid, round({_TREE_SCORE}, 6) AS score",
        ),
        "evidence_output": main_with
        + f"""SELECT '{job}' AS job_uid, c AS node_uid, p AS person_uid, r AS evidence_uid,
       round(s, 6) AS score
FROM (SELECT DISTINCT src, t, c, p, r FROM m) JOIN s USING (src, t, c, p)""",
        "cohort_job_filtered": tree(
            main, _TREE_SCORE,
            f"'{job}' AS job_uid, p AS person_uid, round({_TREE_SCORE}, 6) AS score",
            where="WHERE src = 'a'",
        ),
        "cohort_job_all": tree(
            mixed, _MIXED_SCORE,
            f"'{job}' AS job_uid, p AS person_uid, round({_MIXED_SCORE}, 6) AS score",
        ),
        "cohort_job_all_evidence": _with(mixed)
        + f"""SELECT '{job}' AS job_uid, c AS node_uid, p AS person_uid, r AS evidence_uid,
       round(s, 6) AS score
FROM (SELECT DISTINCT src, t, c, p, r FROM m) JOIN s USING (src, t, c, p)""",
    }
