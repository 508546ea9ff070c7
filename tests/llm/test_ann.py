import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortfold.llm import ann, queries

SF = "/root/testdata/sf0.1"
EVERY_20 = "vec_id % 20 = 0"


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    place = {v: i for i, v in enumerate(ids)}
    got = {}
    for r in queries.op6_nearest(spark, SF).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {v for v in ids.tolist() if v % 20 == 0}
    recalls = []
    for q, found in got.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        scores = x @ x[place[q]]
        assert all(abs(r.score - scores[place[r.vec_id]]) < 1e-12 and r.vec_id != q for r in found)
        scores[place[q]] = -np.inf
        recalls.append(len({r.vec_id for r in found} & set(ids[np.argsort(-scores)[:20]].tolist())) / 20)
    assert np.mean(recalls) >= 0.95


def _unit(rng, n, size):
    x = rng.standard_normal((n, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_recall_on_other_norms_and_dimensions():
    rng = np.random.default_rng(5)
    outlier = _unit(rng, 4000, 64)
    outlier[100] *= 10
    clusters = _unit(rng, 50, 64)[rng.integers(0, 50, 4000)] + 0.05 * rng.standard_normal((4000, 64))
    for x in (outlier, _unit(rng, 4000, 64) * rng.lognormal(0, 0.25, (4000, 1)), _unit(rng, 4000, 256), _unit(rng, 4000, 768), clusters):
        norms = ann._norms(x)
        index = ann.Index(np.arange(len(x)), x, norms)
        recalls = []
        for q in range(50):
            scores = x @ x[q]
            scores[q] = -np.inf
            found, _ = index.search(q, x[q], norms[q], 20, (np.zeros(0, np.int64), np.zeros(0)))
            recalls.append(len(set(found.tolist()) & set(np.argsort(-scores)[:20].tolist())) / 20)
        assert np.mean(recalls) >= 0.95


def test_reach_keeps_the_miss_probability():
    rng = np.random.default_rng(6)
    for miss in (0.2, 0.02):
        inside = np.abs(rng.standard_normal((20_000, ann.PROJECTIONS))) <= ann.reach(miss, ann.PROJECTIONS, 32)
        assert abs((inside.sum(axis=1) < 32).mean() - miss) < 0.01


def test_exact_in_small_bins_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(160)]
    for name, value in (("SHARD_ROWS", 16), ("BIN_BYTES", 50 * 64), ("BLOCK_BYTES", 7 * 64), ("NORM_RANGES", 5)):
        monkeypatch.setattr(ann, name, value)
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.expr(EVERY_20), miss=0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    x = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        want = sorted((-float((x[v] * x[q]).sum()), v) for v in x if v != q)[:20]
        assert [v for _, v in sorted(found)] == [v for _, v in want]
    assert len(got) == sum(i % 20 == 0 for i in x)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<float>, vector string, rank int, score string"
    assert ann.nearest(spark.createDataFrame([], schema), F.expr(EVERY_20)).count() == 0
    vectors = {0: [1, 0], 1: [2, 0], 2: [2, 0], 3: None, 4: [0, 0], 5: [1, nan], 6: [inf, 1], 7: [None, 1], 8: [], 9: [1, 2, 3], 20: [-1, 1], 40: None, 60: [0, 0, 2]}
    rows = [(k, None if v is None else [None if y is None else float(y) for y in v], "x", 1, "y") for k, v in vectors.items()]
    out = ann.nearest(spark.createDataFrame([*rows, rows[1], (1, [3.0, 0.0], "x", 1, "y"), (None, [1.0, 1.0], "x", 1, "y")], schema), F.expr(EVERY_20))
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0), (20, 3, 2, -2.0), (60, 1, 9, 6.0)]


def test_order_of_arrival_does_not_matter():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 64)) * rng.lognormal(0, 0.5, (2000, 1))
    table = pa.table({"vec_id": np.arange(2000), "vector": pa.FixedSizeListArray.from_arrays(x.ravel(), 64)})
    asked = table.slice(0, 200)
    search = ann._searched(20, ann.MISS)
    want = search(table, asked).sort_by([("query_id", "ascending"), ("vec_id", "ascending")])
    for seed in range(3):
        order = np.random.default_rng(seed)
        got = search(table.take(order.permutation(2000)), asked.take(order.permutation(200)))
        assert got.sort_by([("query_id", "ascending"), ("vec_id", "ascending")]).equals(want)
