import numpy as np
import pytest

from lodeframe.llm import whitening
from lodeframe.llm.whitening import components, covariance, deviations, matrix, sums_of, vectors, whiten


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, component string")


def by_definition(rows, scale, k):
    """x, its sums, covariance, and what each row gives, in exact numbers where they are asked for."""
    x = [[int(np.floor(scale * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centre = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    v = centre.T @ centre / n
    return n, deviation, centre, v


def test_against_the_definition(spark, monkeypatch):
    # several row blocks, a last column block that is narrower than the others
    monkeypatch.setattr(whitening, "ROW_BYTES", 40 * 70)
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(70, 70))
    rows = [(i, (rng.normal(size=70) @ mix).astype(np.float32).tolist()) for i in range(600)]
    n, deviation, centre, v = by_definition(rows, 64, 32)
    got = whiten(table(spark, [(i, v, 0, "c") for i, v in rows]).repartition(3)).collect()
    assert len(got) == 600 * 32
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    w = np.zeros((600, 32))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-10)
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    vectors_ = np.linalg.eigh(v)[1][:, ::-1][:, :32]
    for k in range(32):
        expected = centre @ vectors_[:, k] / np.sqrt(values[k])
        assert min(np.abs(w[:, k] - expected).max(), np.abs(w[:, k] + expected).max()) < 1e-7


@pytest.mark.parametrize("tile", [1, 7, 32, 64])
def test_tiles_make_up_the_covariance(spark, tile):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=33) * 10.0 ** rng.integers(0, 5)).astype(np.float32).tolist()) for i in range(90)]
    fit = vectors(table(spark, [(i, v, 0, "c") for i, v in rows]), "vec_id", "embedding").repartition(3)
    sums = sums_of(fit, 33, 64.0)
    got = covariance(fit, 33, 90, sums, 64.0, tile, 16)
    assert np.allclose(got, by_definition(rows, 64, 0)[3], rtol=1e-12)


def test_deviations_are_exact_up_to_a_long():
    y = np.array([[3_000_000_000], [3_037_000_499], [3_037_000_500], [1 << 40]])
    assert deviations(y, 1, [0]) == [9 * 10**18, 3_037_000_499**2, None, None]
    n = 3_000_001
    assert deviations(np.array([[700, -3]]), n, [12, 5]) == [(n * 700 - 12) ** 2 + (n * -3 - 5) ** 2]


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 0.25, 0.0]), (2, [0.5, -0.25, 1.0]), (None, [0.1, 0.0, 3.0]), (1, [0.5, 0.25, 0.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 0.0]), (8, [nan, 1.0, 0.0]), (9, [inf, 1.0, 0.0]), (10, [-inf, 1.0, 0.0]), (11, [1.0])]
    got = whiten(table(spark, [(i, v, 7, "x") for i, v in good + bad])).collect()
    assert sorted({(r.vec_id is None, r.vec_id or 0) for r in got}) == [(False, 1), (False, 2), (True, 0)]
    assert len(got) == 4 * 2 and {r.n for r in got} == {4}  # three distinct points span two dimensions
    assert got[0].identity_error < 1e-9


def test_without_variance_or_rows(spark, none):
    assert whiten(table(spark, [(1, [1.0, 2.0], 0, "x")])).count() == 0
    assert whiten(table(spark, [(1, [1.0, 2.0], 0, "x"), (2, [1.0, 2.0], 0, "x")])).count() == 0
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, None, 0, "x")])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_too_many_dimensions_are_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST", 2)
    with pytest.raises(ValueError, match="3 dimensions"):
        whiten(table(spark, [(1, [1.0, 2.0, 3.0], 0, "x")]))


def test_sizes_beyond_the_bound(spark):
    fit = vectors(table(spark, [(1, [3e38, -3e38], 0, "x")]), "vec_id", "embedding")
    assert sums_of(fit, 2, 64.0) == [1 << 40, -(1 << 40)]
    assert components(np.diag([1.0, 4.0, 0.0]), 5)[0].tolist() == [4.0, 1.0]
    assert matrix(fit.toArrow().to_batches()[0], 2, 64.0).tolist() == [[1 << 40, -(1 << 40)]]
