import numpy as np
import pytest

from wavemark.llm import whitening
from wavemark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n long, dims int"


def plain(rows):
    """Whitening by one eigendecomposition of the whole covariance, with whole numbers for the sums."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    d = n * x - s
    centred = (d / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [int(r) for r in (d * d).sum(1)], centred, e, v


def check(found, rows, most=32):
    n, deviation, centred, e, v = plain(rows)
    got = {}
    for r in found:
        got.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(got) == list(range(1, min(most, len(e)) + 1))
    for c, by_id in got.items():
        w = np.array([by_id[i].whitened for i, _ in rows])
        want = centred @ v[:, c - 1] / np.sqrt(e[c - 1])
        assert np.allclose(w, want if w @ want > 0 else -want, atol=1e-6)
        assert all(by_id[i].deviation == x and by_id[i].n == n for (i, _), x in zip(rows, deviation, strict=True))
        assert by_id[rows[0][0]].explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


def test_equal_to_one_decomposition_whatever_the_parts(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(900, 40)) * np.geomspace(30, 0.5, 40) + r.normal(size=40) * 100
    rows = [(i, [float(c) for c in np.float32(x)]) for i, x in enumerate(v)]
    for parts in (1, 3, 40):
        df = spark.createDataFrame([(i, x, -1, -2) for i, x in rows], SCHEMA).repartition(parts, "vec_id")
        check(whitening.whiten(df).collect(), rows)


def test_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op11_embedding_whitening"](spark, sf).collect(), rows)


def test_merging_loses_no_dimension():
    r = np.random.default_rng(1)
    x = whitening.whole(r.normal(size=(500, 30)) * np.geomspace(1000, 0.1, 30))
    parts = [whitening.Fit.of(p) for p in np.split(x, [1, 3, 20, 25, 300])]  # some with fewer rows than dimensions
    fit = parts[0]
    for p in parts[1:]:
        fit = fit.merged(whitening.Fit.loads(p.dumps(), 30))
    one = whitening.Fit.of(x)
    assert fit.n == 500 and fit.sums == one.sums and len(fit.values) == 30
    assert np.allclose(fit.values, one.values, rtol=1e-10)


def test_rows_that_are_left_out_and_flat_components(spark):
    odd = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("-inf"), 1.0]), (5, []), (None, [1.0, 5.0]), (7, [2.0, 5.0]), (7, [2.0, 5.0]), (8, [1.0, 2.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, 0) for i, v in odd], SCHEMA)).collect()
    two = [r for r in got if r.n == 3]
    assert sorted((r.vec_id or 0, r.component) for r in two) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2)]
    assert all(r.whitened is None for r in two if r.component == 2) and all(r.explained == pytest.approx(1) for r in two if r.component == 1)
    assert {r.deviation for r in two if r.vec_id is None} == {(3 * (64 - 0) - (64 + 128 + 128)) ** 2}
    alone = [r for r in got if r.vec_id == 8]
    assert len(alone) == 3 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in alone)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deviations_of_any_size(spark):
    rows = [(1, [2.0**39, 0.0]), (2, [-(2.0**39), 1.0]), (3, [5.0, 2.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    _, want, *_ = plain([(1, [2.0**39, 0.0]), (2, [-(2.0**39), 1.0]), (3, [5.0, 2.0])])
    assert got == {i: x if x < 2**63 else None for i, x in zip((1, 2, 3), want, strict=True)} and got[1] is None and got[3] is not None
