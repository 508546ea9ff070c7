"""Whitening of vectors by shifted CholeskyQR.

Vectors are made whole numbers, and each distinct one counts once in the fit.
Their rows, centred, are a tall matrix Y that is never gathered. A pass sums
its Gram matrix over the tasks; Cholesky gives a triangular R, the next pass
solves each row against it, and so on until the rows are orthonormal. The
first Cholesky is shifted, so that it succeeds whatever Y's condition. With
Y = Q R, where R is the product of the passes' factors, the singular values of
R are Y's and its right singular vectors are the components.

Only matrices of (length x length) reach the driver, and the tasks, whatever
the number of rows. Means are exact: sums are whole numbers, and a row is
centred before anything is multiplied.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortfold.llm.shared import Scratch, map_arrow, ship

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
#: Scaled entries are held to this, so that sums over a batch fit 64 bits.
LIMIT = 1 << 46
#: Passes after which the rows count as orthonormal, those without variance apart.
MOST_PASSES = 5
_UNIT = np.finfo(np.float64).eps / 2
#: Directions whose deviation is less than this share of the largest have no variance.
_NO_VARIANCE = 1e-10


@dataclass
class Model:
    """Centre and factors of the vectors of one length."""

    n: int
    sums: list[int]
    #: Factors of the passes so far, first to last.
    factors: list[np.ndarray] = field(default_factory=list)
    #: Columns map a centred row to whitened components; one without variance is null.
    project: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float | None = None

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        """Rows of Q: centred rows, solved against each factor in turn."""
        y = self.centred(x)
        for factor in self.factors:
            y = np.linalg.solve(factor.T, y.T).T  # a triangular system, though the routine is general
        return y

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.project

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2; null beyond 64 bits."""
        apart = x - self.whole
        most = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if most**2 * x.shape[1] < 1 << 63:
            return ((apart * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(row, self.rest)) for row in apart]
        return [value if value < 1 << 63 else None for value in exact]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of it, their vectors) for each length of vectors in the batch."""
    lists = batch.column("x")
    offsets, flat = np.asarray(lists.offsets, np.int64), np.asarray(lists.values)
    size = np.diff(offsets)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        yield length, rows, flat[offsets[rows][:, None] + np.arange(length)]


def _summing(measure):
    """Sums ``measure(length, x)``, a matrix, over a task; one output row for each of its rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = defaultdict(float)
        for batch in batches:
            for length, _, x in _by_length(batch):
                if length:
                    total[length] = total[length] + measure(length, x)
        part = TaskContext.get().partitionId()
        rows = [(length, i, part, row.tobytes()) for length, matrix in sorted(total.items()) for i, row in enumerate(matrix)]
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else ((),) * 4, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                              names=["length", "i", "part", "row"])

    return add


def _merged(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")  # the same order of addition at every run
    total = sum(np.frombuffer(r, np.float64) for r in rows.column("row").to_pylist())
    return pa.table({"length": rows.column("length")[:1], "i": rows.column("i")[:1], "row": pa.array([total.tobytes()], pa.binary())})


def _sum_matrix(fit: DataFrame, measure) -> dict[int, np.ndarray]:
    """Sum over all rows of ``measure``, by length. Matrix rows are added apart, so a task holds one of each partial sum."""
    partial = map_arrow(fit, _summing(measure), "length int, i int, part int, row binary")
    total = partial.groupBy("length", "i").applyInArrow(_merged, "length int, i int, row binary")
    out: dict[int, list] = defaultdict(list)
    for r in total.orderBy("length", "i").collect():  # length x length numbers for each length
        out[r["length"]].append(np.frombuffer(bytes(r["row"]), np.float64))
    return {length: np.array(rows) for length, rows in out.items()}


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, int] = defaultdict(int)
    total: dict[int, list[int]] = {}
    for batch in batches:
        for length, rows, x in _by_length(batch):
            count[length] += len(rows)
            total[length] = [a + int(b) for a, b in zip(total.get(length, [0] * length), x.sum(axis=0))]
    rows = [(length, i, count[length], s >> 32, s & 0xFFFFFFFF) for length in sorted(total) for i, s in enumerate(total[length])]
    yield pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else ((),) * 5)], names=["length", "i", "n", "high", "low"])


def _models(fit: DataFrame) -> dict[int, Model]:
    sums = map_arrow(fit, _sums, "length long, i long, n long, high long, low long").groupBy("length", "i").agg(
        *(F.sum(c).alias(c) for c in ("n", "high", "low"))
    )
    of: dict[int, list] = defaultdict(list)
    for r in sums.orderBy("length", "i").collect():  # one row a dimension
        of[r["length"]].append(r)
    return {length: Model(rows[0]["n"], [(r["high"] << 32) + r["low"] for r in rows]) for length, rows in of.items()}


def _factor(gram: np.ndarray, n: int) -> np.ndarray:
    """The upper triangular R of a Gram matrix; shifted where it is (nearly) singular."""
    size = len(gram)
    spread = np.linalg.eigvalsh(gram)
    if spread[0] > 1e-8 * spread[-1] and spread[0] > 0:
        return np.linalg.cholesky(gram).T
    shift = 11 * (n * size + size * (size + 1)) * _UNIT * max(np.trace(gram), np.finfo(np.float64).tiny)
    return np.linalg.cholesky(gram + shift * np.eye(size)).T


def _orthonormal(gram: np.ndarray) -> bool:
    spread = np.abs(np.linalg.eigvalsh(gram))
    return bool((np.minimum(spread, np.abs(spread - 1)) < 1e-12).all())


def _components(model: Model, gram: np.ndarray, most: int) -> None:
    """Singular values and right vectors of Y, from its factors and the Gram matrix of Q."""
    value, vector = np.linalg.eigh(gram)
    product = (vector * np.sqrt(np.maximum(value, 0))).T
    for factor in reversed(model.factors):
        product = product @ factor
    _, deviation, right = np.linalg.svd(product)
    count = min(most, len(deviation))
    told = deviation[:count] > _NO_VARIANCE * deviation[0]
    scale = np.divide(np.sqrt(model.n), deviation[:count], out=np.full(count, np.nan), where=told)
    model.project = right[:count].T * scale
    total = (deviation**2).sum()
    model.explained = np.where(told, deviation[:count] ** 2, 0.0) / total if total else np.full(count, np.nan)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of ``vectors`` (x array<long>, each distinct one once)."""
    models = _models(vectors)
    running = set(models)
    grams: dict[int, np.ndarray] = {}
    for step in range(MOST_PASSES + 1):

        def gram(length: int, x: np.ndarray, models=models, running=frozenset(running)) -> np.ndarray:
            if length not in running:
                return np.zeros((0, length))
            q = models[length].orthogonal(x)
            return q.T @ q

        grams |= {k: g for k, g in _sum_matrix(vectors, gram).items() if len(g)}
        for length in sorted(running):
            if step and (step == MOST_PASSES or _orthonormal(grams[length])):
                running.remove(length)
            else:
                models[length].factors.append(_factor(grams[length], models[length].n))
        if not running:
            break
    for length, model in models.items():
        _components(model, grams[length], components)

    def covariance(length: int, x: np.ndarray) -> np.ndarray:
        w = models[length].whitened(x)
        w = np.column_stack([np.nan_to_num(w), np.ones(len(w))])
        return w.T @ w

    for length, total in _sum_matrix(vectors, covariance).items():
        model = models[length]
        mean = total[-1, :-1] / model.n
        told = ~np.isnan(model.project[0])
        apart = total[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(len(told))
        model.identity_error = float(np.abs(apart[np.ix_(told, told)]).max()) if told.any() else None
    return models


def whole_numbers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each entry; beyond +-LIMIT it is held there."""
    held = lambda c: F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(held(c)) + F.lit(offset))


def finite(vector: Column) -> Column:
    """Not null, and without null or non-finite entries."""
    infinity = F.lit(float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < infinity), F.lit(False))), F.lit(False))


def _whitening(models: dict[int, Model]):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, x in _by_length(batch):
                if not length:
                    continue
                model = models[length]
                count = model.project.shape[1]
                repeat = np.repeat(np.arange(len(rows)), count)
                deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(repeat))
                yield pa.record_batch([
                    batch.column("vec_id").take(pa.array(rows[repeat])), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(repeat), model.n)), deviation, pa.array(model.whitened(x).ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, len(rows)), from_pandas=True), pa.array([model.identity_error] * len(repeat), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whiten


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are dropped;
    all others come with each of the first ``components`` components, repeated
    rows and null ids too. An empty vector has no component, so no row. Vectors
    of different lengths are whitened apart, each length with its own n. A
    component without variance (fewer distinct vectors than components, say)
    explains 0 and has a null ``whitened``; it does not count in
    ``identity_error``. All vectors equal: ``explained`` and
    ``identity_error`` are null. Scaled entries beyond +-2^46 count as that, and
    a ``deviation`` beyond 64 bits is null. Other columns are not read. No rows:
    no result.
    """
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark)
    ship(spark)
    kept = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector")).filter(finite(F.col("vector")))
    kept = kept.select("vec_id", whole_numbers(F.col("vector")).alias("x"))
    distinct = scratch.write(kept.select("x").distinct(), "distinct")
    models = fit(distinct, components)
    scratch.drop("distinct")
    id_type = rows.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return map_arrow(kept, _whitening(models), schema)
