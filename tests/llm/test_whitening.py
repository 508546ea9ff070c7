import numpy as np
import pytest

from cohortfold.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def expected(vectors, most=16):
    """n, deviations, |whitened| and explained by a dense eigendecomposition of the distinct rows."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    with np.errstate(all="ignore"):
        whitened = np.abs((x - sums / n) @ vector[:, :most] / np.sqrt(value[:most]))
    return n, ((n * x - sums) ** 2).sum(axis=1), whitened, value[:most] / value.sum()


def run(spark, rows, schema=SCHEMA, **options):
    return whitening.whiten(spark.createDataFrame(rows, schema), **options).toPandas()


def assert_equal(out, rows, **tolerance):
    n, deviation, whitened, explained = expected([v for _, v in rows])
    table = out.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    np.testing.assert_allclose(np.abs(table), whitened, rtol=1e-6, atol=1e-7)
    assert set(out["n"]) == {n}
    first = out[out.component == 1].set_index("vec_id")
    assert first.deviation.loc[[i for i, _ in rows]].tolist() == deviation.tolist()
    np.testing.assert_allclose(out.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-6)
    assert out.identity_error.max() < 1e-9
    # one sign for all rows: the columns are uncorrelated over the distinct vectors
    distinct = np.unique(np.round(table, 9), axis=0)
    np.testing.assert_allclose(distinct.T @ distinct / n, np.eye(table.shape[1]), atol=1e-6)


def test_query_against_dense_eigenvectors(spark):
    out = queries.op12_whitening(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert len(out) == 16 * len(rows)
    assert_equal(out, [(r[0], r[1]) for r in rows])


def test_copies_count_once_and_scales_differ(spark):
    rng = np.random.default_rng(1)
    scale = np.array([1000.0, 10.0, 1.0, 0.3, 200.0])
    rows = [(i, (rng.standard_normal(5) * scale + 5000).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    assert_equal(run(spark, rows), [(i, np.array(v, np.float32)) for i, v in rows])


def test_directions_without_variance(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((200, 3)) * 20
    rows = [(i, [*v, v[0], 7.0]) for i, v in enumerate(base.tolist())]  # a repeated and a constant dimension
    out = run(spark, rows)
    kept = out[out.component <= 3]
    assert kept.whitened.notna().all() and out[out.component > 3].whitened.isna().all()
    assert (out[out.component > 3].explained == 0).all()
    assert out.identity_error.max() < 1e-9
    _, _, whitened, explained = expected([np.array(v, np.float32) for _, v in rows])
    table = kept.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    np.testing.assert_allclose(np.abs(table), whitened[:, :3], rtol=1e-5, atol=1e-6)
    np.testing.assert_allclose(kept.drop_duplicates("component").explained, explained[:3], rtol=1e-9)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (None, [3.0, 1.0]), (1, [1.0, 2.0]), (7, [0.5, 0.0])]
    out = run(spark, rows)
    assert sorted(out.vec_id.fillna(-1).tolist()) == [-1, -1, 1, 1, 1, 1, 7, 7]
    assert set(out["n"]) == {3}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_no_rows(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_equal_vectors(spark):
    out = run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(out) == 4 and (out["n"] == 1).all() and (out.deviation == 0).all()
    assert out[["whitened", "explained", "identity_error"]].isna().all().all()


def test_lengths_apart_huge_entries_and_clashing_names(spark):
    rows = [(i, [float(i), float(i * i)], i, "q", 0.5) for i in range(5)] + [(10 + i, [float(i), 2.0, -float(i * i)], i, "q", 0.5) for i in range(4)]
    rows += [(20, [3e38], 1, "q", 0.5), (21, [-3e38], 1, "q", 0.5)]
    out = run(spark, rows, "vec_id long, embedding array<float>, n int, x string, whitened double")
    assert out.groupby("vec_id").size().to_dict() == {**{i: 2 for i in range(5)}, **{10 + i: 3 for i in range(4)}, 20: 1, 21: 1}
    assert out[out.vec_id < 5].n.eq(5).all() and out[out.vec_id.between(10, 13)].n.eq(4).all()
    assert out[out.vec_id >= 20].deviation.isna().all() and np.allclose(out[out.vec_id >= 20].whitened.abs(), 1)
