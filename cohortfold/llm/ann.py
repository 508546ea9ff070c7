"""Nearest neighbours by inner product with collision-counting hashing.

Rows are dealt to bins by ranges of their norm. A bin is indexed a shard at a
time, largest norms first: every vector is scaled by the shard's largest norm
and given one more component that makes its length 1, so that the nearest in
distance to a query is the largest inner product. Each of ``PROJECTIONS``
random projections is kept as one sorted array. A query's window, centred on
its own projection, expands on all arrays at once (virtual rehashing: no array
is built again) and only the entries that a step adds are counted. Vectors met
on at least ``THRESHOLD`` of the projections have collided often enough and are
verified on the original vectors.

When to stop follows from the projections and not from the data: a vector at
distance s differs from the query by a normal variate of deviation s on each
projection, so the width at which it has collided often enough with probability
``1 - miss`` is a fixed multiple of s. A shard is done when its windows are that
wide for the distance that the k-th best so far stands for. So each true
neighbour is missed with probability ``miss`` at most, whatever the dimension
and the norms; on vectors without structure this verifies most rows. A shard whose
largest norm cannot reach the k-th best is not searched. ``miss=0`` verifies
all rows of the other shards: exact.

Bins and blocks of queries are bounded in bytes, and every block meets every bin of
its vectors' length, so no task holds all queries or all rows. Rows are copied
once for each block (32,768 queries of 64 components) and queries once for each bin
(65,536 rows of these). All rows are indexed; nothing is fitted.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortfold.llm.shared import Scratch, parallelism, ship

PROJECTIONS = 64
THRESHOLD = 0.5
MISS = 0.02
#: The first half-width, and the factor by which it grows.
FIRST, WIDEN = 0.25, 1.8
#: Rows that are indexed together.
SHARD_ROWS = 8192
#: Of a bin's rows and a block's queries, at 8 bytes a component; and (query, neighbour) pairs of a block.
BIN_BYTES, BLOCK_BYTES, BLOCK_PAIRS = 32 << 20, 16 << 20, 4_000_000
#: Ranges of norms, at most; and rows of a bin where there are fewer bins than cores.
NORM_RANGES, LEAST_ROWS = 256, 1024


def _matrix(table: pa.Table) -> np.ndarray:
    vectors = table.column("vector").combine_chunks()
    return np.asarray(vectors.flatten(), np.float64).reshape(len(table), -1)


def _norms(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(axis=1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1))


@lru_cache
def reach(miss: float, projections: int, least: int) -> float:
    """Half-width, as a multiple of a vector's distance, at which it is in
    ``least`` of the windows with probability ``1 - miss``."""
    few = lambda p: sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(least))
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if few(middle) > miss else (low, middle)
    return NormalDist().inv_cdf(min((1 + high) / 2, 1 - 1e-16))


class Index:
    """Sorted projections of one shard's vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, seed: int = 0):
        self.ids, self.vectors, self.norm = ids, vectors, norms.max()
        scaled = vectors / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        values = np.ascontiguousarray((np.column_stack([scaled, rest]) @ self.directions).T)
        order = np.argsort(values, axis=1, kind="stable")
        #: The sorted arrays end to end, each lifted above the last, so that one search places all windows.
        self._lift = np.arange(PROJECTIONS) * (2 * np.abs(values).max() + 1000.0)
        self._sorted = (np.take_along_axis(values, order, axis=1) + self._lift[:, None]).ravel()
        self._order = order.ravel()

    def search(self, query_id: int, query: np.ndarray, norm: float, k: int, best: tuple[np.ndarray, np.ndarray], miss: float = MISS) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the nearest ``k`` of those in ``best``
        (other shards') and those found here, without the query's own row."""
        n = len(self.ids)
        floor = best[1][-1] if len(best[1]) >= k else -math.inf
        if floor > norm * self.norm * (1 + 1e-9):
            return best
        if miss <= 0:
            return self._merge(best, np.arange(n), query_id, query, k)
        least = math.ceil(THRESHOLD * PROJECTIONS)
        wide = reach(miss, PROJECTIONS, least)
        centre = (query / norm) @ self.directions[:-1] + self._lift
        begin = np.arange(PROJECTIONS) * n
        low = high = np.clip(np.searchsorted(self._sorted, centre), begin, begin + n)
        count = np.zeros(n, np.int64)
        verified = np.zeros(n, bool)
        half = FIRST
        while True:
            floor = best[1][-1] if len(best[1]) >= k else -math.inf
            # The distance of a vector that equals the k-th best; no product is below minus the norms.
            distance = math.sqrt(max(0.0, 2 - 2 * max(floor / (norm * self.norm), -1.0)))
            enough = wide * distance + 1e-7
            half = min(half, enough)
            ends = np.searchsorted(self._sorted, np.concatenate([centre - half, centre + half]))
            down = np.minimum(np.maximum(ends[:PROJECTIONS], begin), low)
            up = np.maximum(np.minimum(ends[PROJECTIONS:], begin + n), high)
            count += self._met(np.concatenate([down, high]), np.concatenate([low, up]))
            low, high = down, up
            found = np.flatnonzero((count >= least) & ~verified)
            if len(found):
                verified[found] = True
                best = self._merge(best, found, query_id, query, k)
            if half >= enough or verified.all():
                return best
            half *= WIDEN

    def _met(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each row lies in the entries from ``start`` to ``end`` of the arrays."""
        parts = [self._order[a:b] for a, b in zip(start.tolist(), end.tolist()) if a < b]
        return np.bincount(np.concatenate(parts), minlength=len(self.ids)) if parts else np.zeros(len(self.ids), np.int64)

    def _merge(self, best: tuple[np.ndarray, np.ndarray], found: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = (self.vectors @ query)[found] if 4 * len(found) > len(self.ids) else self.vectors[found] @ query
        keep = self.ids[found] != query_id
        found, score = found[keep], score[keep]
        # Rounded products only choose what is computed again in one fixed order, so that equal vectors get equal scores.
        margin = 1e-9 * max(1.0, np.abs(score).max(initial=0.0))
        if len(best[1]) >= k:
            keep = score >= best[1][-1] - margin
            found, score = found[keep], score[keep]
        if len(found) > k:
            found = found[score >= np.partition(score, len(score) - k)[len(score) - k] - margin]
        ids = np.concatenate([best[0], self.ids[found]])
        score = np.concatenate([best[1], (self.vectors[found] * query).sum(axis=1)])
        first = np.lexsort((ids, -score))[:k]
        return ids[first], score[first]


def _searched(k: int, miss: float):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        asked = np.zeros(0, np.int64)
        if len(rows) and len(queries):
            # A shuffle's order is not fixed.
            rows, queries = rows.sort_by("vec_id"), queries.sort_by("vec_id")
            ids, vectors = np.asarray(rows.column("vec_id")), _matrix(rows)
            asked, sought = np.asarray(queries.column("vec_id")), _matrix(queries)
            norms, lengths = _norms(vectors), _norms(sought)
            order = np.argsort(-norms, kind="stable")
            out = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
            for at in range(0, len(order), SHARD_ROWS):
                part = order[at:at + SHARD_ROWS]
                index = Index(ids[part], vectors[part], norms[part])
                for i, query_id in enumerate(asked.tolist()):
                    out[i] = index.search(query_id, sought[i], lengths[i], k, out[i], miss)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        return pa.table({
            "query_id": np.repeat(asked, [len(i) for i, _ in out]),
            "vec_id": join([i for i, _ in out], np.int64), "score": join([s for _, s in out], np.float64),
        })

    return search


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and only finite components."""
    infinity = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < infinity), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _dealt(rows: DataFrame, scratch: Scratch, k: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their bin and block, and the plan: size, range, offset, bins, all_bins, blocks.

    A length of vectors has at most ``NORM_RANGES`` ranges of norms, of about equal
    rows; a range that holds too much (equal norms) has several bins, dealt by a hash.
    """
    spark = rows.sparkSession
    cores = parallelism(spark)
    ends = F.percentile_approx("norm", [i / NORM_RANGES for i in range(1, NORM_RANGES)], 10_000)
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_query").alias("queries"), ends.alias("ends"))
    fit = lambda most: F.greatest(F.lit(1), F.floor(F.lit(most) / (8 * F.col("size"))))
    sizes = sizes.withColumn("most", F.least(fit(BIN_BYTES), F.greatest(F.ceil(F.col("rows") / cores), F.lit(LEAST_ROWS))))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("queries") / F.least(fit(BLOCK_BYTES), F.lit(max(1, BLOCK_PAIRS // k)))))
    sizes = scratch.write(sizes.withColumn("ranges", F.least(F.ceil(F.col("rows") / F.col("most")), F.lit(NORM_RANGES))), "sizes")
    below = F.size(F.filter("ends", lambda e: e < F.col("norm")))
    placed = rows.join(sizes.drop("rows", "queries"), "size")
    placed = placed.withColumn("range", F.floor(below * F.col("ranges") / NORM_RANGES)).drop("ends", "ranges")
    placed = scratch.write(placed, "placed")
    plan = placed.groupBy("size", "range", "most", "blocks").agg(F.count(F.lit(1)).alias("n"))
    plan = plan.withColumn("bins", F.ceil(F.col("n") / F.col("most")))
    whole = Window.partitionBy("size")
    offset = F.sum("bins").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bins")
    plan = plan.select("size", "range", offset.alias("offset"), "bins", F.sum("bins").over(whole).alias("all_bins"))
    return placed, scratch.write(plan, "plan")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id", miss: float = MISS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each query row.

    Nearness is the inner product in double precision on the original vectors,
    ties go to the smaller vec_id. ``miss`` is the probability with which a true
    neighbour may be missed; 0 gives exactly the nearest. A query's own vec_id is
    no candidate. Rows with a null id, or whose vector is null, zero, or holds a
    null or non-finite component, take no part. Vectors of different lengths have no
    inner product: each length is searched on its own. Rows that repeat a vec_id
    are one, with the smallest of their vectors (component by component), a query
    if any of them is. Other columns are not read. No rows: no result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    ship(spark)
    kind = "array<float>" if dict(rows.dtypes)[vector] == "array<float>" else "array<double>"
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("is_query").alias("is_query"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = scratch.write(rows.withColumn("size", F.size("vector")).withColumn("norm", norm), "rows")
    placed, plan = _dealt(rows, scratch, k)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    placed = placed.join(plan, ["size", "range"])
    columns = ["vec_id", "vector", "size", "bin", "block"]
    indexed = placed.filter("blocks > 0").withColumn("bin", F.col("offset") + deal("bins")).withColumn("block", each("blocks")).select(*columns)
    asked = placed.filter("is_query").withColumn("bin", each("all_bins")).withColumn("block", deal("blocks"))
    asked = asked.select(*(F.col(c).alias(c) for c in columns))  # the same columns on both sides would be ambiguous
    key = ["size", "bin", "block"]
    found = indexed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_searched(k, miss), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
