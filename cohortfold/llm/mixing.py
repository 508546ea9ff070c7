"""Mixing sources to target weights by hierarchical budgeting (native).

Documents hang on a tree (domain, language, source). A token budget goes from
the root down: a node's budget is shared among its children by weight; a child
that has fewer tokens (times ``max_epochs``) than its share gives the shortage
to its siblings, and only what all of them cannot take stays with the
ancestors. In whole numbers throughout, so results do not depend on the order
of summation.

A leaf with budget b and t tokens takes b div t whole epochs and of the next
epoch a token-prefix of b mod t tokens, in the order of a seeded hash of
(seed, epoch, doc_id). The prefix is found in two steps, sums by hash range and
then the documents of the one range where the prefix ends, so no task sorts a
whole leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortfold.llm.shared import Scratch

#: Hash ranges for each leaf's prefix sums, as a power of two.
RANGE_BITS = 12
_KEY_BITS = 60


def count_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none in a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in the seeded order of an epoch, below 2 ** 60."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, _KEY_BITS // 4), 16, 10).cast("long")


def _share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``alloc`` for each of ``nodes`` (cap, weight, budget of the parent).

    Water-filling: by rising cap / weight, a child is full if its cap is at
    most its share of what the fuller ones before it leave.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = by.orderBy(F.col("cap") / F.col("weight"), "node").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda total, c: total - F.coalesce(F.sum(c).over(before), F.lit(0))
    nodes = nodes.withColumn("rest_weight", left(F.sum("weight").over(by), "weight"))
    nodes = nodes.withColumn("rest_budget", left(F.col("budget"), "cap"))
    full = F.col("cap") * F.col("rest_weight") <= F.col("rest_budget") * F.col("weight")
    nodes = nodes.withColumn("full", full)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(by)
    full_cap = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)
    share = F.expr("(budget - full_cap) * weight div open_weight")
    return (
        nodes.withColumn("open_weight", open_weight).withColumn("full_cap", full_cap)
        .withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(share))
        .drop("rest_weight", "rest_budget", "full", "open_weight", "full_cap", "budget")
    )


def budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """(levels, tokens, alloc) of each leaf. ``weights``: level, node, weight."""
    spread: DataFrame | None = None
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("cap"))
        own = weights.filter(F.col("level") == level).select(F.col("node").alias(level), F.col("weight"))
        nodes = nodes.join(F.broadcast(own), level, "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long")))
        nodes = nodes.filter("weight > 0").withColumn("node", F.col(level))
        if spread is None:
            nodes = nodes.withColumn("budget", F.least(F.lit(budget).cast("long"), F.sum("cap").over(Window.partitionBy(F.lit(0)))))
        else:
            nodes = nodes.join(spread, path[:-1])
        spread = _share_out(nodes, path[:-1]).select(*path, F.col("alloc").alias("budget"))
    return leaves.join(spread.withColumnRenamed("budget", "alloc"), levels)


class Mix:
    """The plan of a mix: one row per leaf, from which rows are selected.

    ``plan`` has levels, tokens, alloc, full_epochs, rest and, if rest > 0, the
    document where the prefix of the next epoch ends: cut_key, cut_id and
    cut_take (tokens taken from it).
    """

    def __init__(self, docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]],
                 budget_ratio: tuple[int, int] = (1, 1), max_epochs: int = 2, seed: int = 0):
        """``levels``: name and column of each level, from the root down; a
        null counts as ``unknown``. ``weights``: by level and node, whole
        numbers, 1 where none is given; 0 leaves the node out. The budget is
        ``budget_ratio`` of the tokens of all documents.

        Documents without tokens (null, empty) are in no leaf and are never
        selected. Rows with the same doc_id in a leaf are one document, drawn
        together. Extra columns are not read."""
        spark = docs.sparkSession
        self.scratch, self.levels, self.seed = Scratch(spark), list(levels), seed
        self._columns = {f"_mix_{k}": F.coalesce(v.cast("string"), F.lit("unknown")) for k, v in levels.items()}
        names = list(self._columns)
        tokens = docs.select(F.col("doc_id"), count_tokens(F.col("text")).alias("n_tokens"), *(c.alias(k) for k, c in self._columns.items()))
        self.tokens = self.scratch.write(tokens.filter("n_tokens > 0"), "tokens")
        leaves = self.scratch.write(self.tokens.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
        table = spark.createDataFrame(
            [(f"_mix_{level}", node, w) for level, of in weights.items() for node, w in of.items()], "level string, node string, weight long"
        )
        total = leaves.agg(F.sum("tokens").alias("total")).first().total or 0
        plan = budgets(leaves, names, table, total * budget_ratio[0] // budget_ratio[1], max_epochs)
        plan = plan.withColumn("full_epochs", F.expr("alloc div tokens")).withColumn("rest", F.expr("alloc % tokens"))
        plan = self.scratch.write(plan, "shares")
        self.plan = self.scratch.write(plan.join(self._cuts(plan, names), names, "left"), "plan")

    def _cuts(self, plan: DataFrame, names: list[str]) -> DataFrame:
        docs = self.tokens.join(plan.filter("rest > 0").select(*names, "full_epochs", "rest"), names)
        docs = docs.withColumn("key", order_key(self.seed, F.col("full_epochs"), F.col("doc_id")))
        docs = docs.withColumn("range", F.shiftright("key", _KEY_BITS - RANGE_BITS))
        sums = docs.groupBy(*names, "rest", "range").agg(F.sum("n_tokens").alias("n"))
        upto = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        last = sums.withColumn("upto", F.sum("n").over(upto)).filter("upto >= rest AND upto - n < rest")
        last = self.scratch.write(last.select(*names, "range", (F.col("upto") - F.col("n")).alias("before")), "last_ranges")
        ending = docs.join(last, [*names, "range"]).groupBy(*names, "rest", "before", "key", "doc_id").agg(F.sum("n_tokens").alias("n"))
        upto = Window.partitionBy(*names).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        ending = ending.withColumn("upto", F.col("before") + F.sum("n").over(upto)).filter("upto >= rest AND upto - n < rest")
        return ending.select(
            *names, F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"),
            (F.col("rest") - F.col("upto") + F.col("n")).alias("cut_take"),
        )

    def _in_prefix(self, doc_id: Column) -> Column:
        key = order_key(self.seed, F.col("full_epochs"), doc_id)
        cut = F.col("cut_key")
        # A null id comes first, as in the order that found the cut.
        upto = doc_id.isNull() | F.coalesce(doc_id <= F.col("cut_id"), F.lit(False))
        return cut.isNotNull() & ((key < cut) | ((key == cut) & upto))

    def selection(self) -> DataFrame:
        """doc_id, levels, epoch (from 0) and tokens taken, for each epoch of each selected document."""
        names = list(self._columns)
        docs = self.tokens.groupBy(*names, "doc_id").agg(F.sum("n_tokens").alias("n_tokens")).join(self.plan, names)
        inside = self._in_prefix(F.col("doc_id"))
        cut = inside & F.col("doc_id").eqNullSafe(F.col("cut_id"))
        docs = docs.withColumn("inside", inside.cast("long")).withColumn("cut", cut)
        docs = docs.filter("full_epochs + inside > 0")
        docs = docs.withColumn("epoch", F.explode(F.expr("sequence(0L, full_epochs + inside - 1)")))
        take = F.when(F.col("cut") & (F.col("epoch") == F.col("full_epochs")), F.col("cut_take")).otherwise(F.col("n_tokens"))
        return docs.select("doc_id", *(F.col(f"_mix_{k}").alias(k) for k in self.levels), "epoch", take.alias("n_taken"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs``, each as often as its epochs; the last document of a prefix stays whole."""
        names = list(self._columns)
        rows = docs.select(F.struct("*").alias("_mix_row"), *(c.alias(k) for k, c in self._columns.items()), (count_tokens(F.col("text")) > 0).alias("_mix_some"))
        rows = rows.filter("_mix_some").join(self.plan, names)
        rows = rows.withColumn("_mix_times", F.col("full_epochs") + self._in_prefix(F.col("_mix_row.doc_id")).cast("long"))
        rows = rows.filter("_mix_times > 0").select("_mix_row", F.explode(F.expr("sequence(1L, _mix_times)")).alias("_mix_copy"))
        return rows.select("_mix_row.*")
