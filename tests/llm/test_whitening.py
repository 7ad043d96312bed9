import math
from fractions import Fraction

import numpy as np
import pytest

from formlens.llm import whitening
from formlens.llm.queries import op13_embedding_whitening

NAMES = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows, most=4):
    """By fractions: n, deviations by id, eigenvalues and eigenvectors, the mean, the trace."""
    x = {i: tuple(math.floor(256.0 * c) for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    cov = [[float(sum((v[a] - Fraction(s[a], n)) * (v[b] - Fraction(s[b], n)) for v in fit) / n) for b in range(d)] for a in range(d)]
    values, vectors = np.linalg.eigh(np.array(cov))
    deviation = {i: sum((n * v[k] - s[k]) ** 2 for k in range(d)) for i, v in x.items()}
    centred = {i: np.array([float(v[k] - Fraction(s[k], n)) for k in range(d)]) for i, v in x.items()}
    return n, deviation, values[::-1][:most], vectors[:, ::-1][:, :most], centred, float(np.trace(cov))


def same(got, rows, most=4):
    n, deviation, values, vectors, centred, trace = brute(rows, most)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert {k for _, k in by} == set(range(1, len(values) + 1)) and len(got) == len(rows) * len(values)
    for k, (e, v) in enumerate(zip(values, vectors.T, strict=True), 1):
        want = {i: centred[i] @ v / math.sqrt(e) for i, _ in rows}
        sign = np.sign(sum(by[i, k][0].whitened * want[i] for i in want))
        for i in want:
            for r in by[i, k]:
                assert r.n == n and r.deviation == (deviation[i] if deviation[i] < 2**63 else None)
                assert r.whitened == pytest.approx(sign * want[i], rel=1e-6, abs=1e-9)
                assert r.explained == pytest.approx(e / trace, rel=1e-9) and r.identity_error < 1e-9


def test_query_as_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(op13_embedding_whitening(spark, sf).collect(), rows)


def test_far_means_and_copies(spark):
    """A mean of 2^40 over a spread of a few units: sums of squares in doubles would lose every digit of it."""
    rng = np.random.default_rng(1)
    base = 2.0**40 + rng.normal(size=(60, 5)) * [9, 7, 5, 3, 1]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(60 + i, base[0].tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert got[0].n == 60
    same(got, rows)


def test_exact_scatter_of_large_integers(spark):
    rng = np.random.default_rng(2)
    for most in (100, 1 << 30, 1 << 62, (1 << 63) - 1):
        x = rng.integers(-most, most, (9000 if most < 1000 else 300, 3), dtype=np.int64)
        x[0], x[1] = -most, most
        fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(3)
        shift = x[2]
        n, sums, products = whitening.exact_scatter(fit, shift)
        big = [[int(a) - int(b) for a, b in zip(v, shift, strict=True)] for v in x]
        assert n == len(x) and sums.tolist() == [sum(v[k] for v in big) for k in range(3)]
        assert products.tolist() == [[sum(v[a] * v[b] for v in big) for b in range(3)] for a in range(3)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, []), (102, [1.0, None]), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [1.0]), (106, [1.0, 2.0, 3.0])]
    rows = [(1, [0.0, 1.0]), (2, [1.0, -1.0]), (3, [-0.001, 2.0]), (3, [-0.001, 2.0]), (None, [-0.0, 5.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "'y' AS id", "2 AS component")
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", *NAMES]
    got = got.collect()
    assert {r.vec_id for r in got} == {1, 2, 3, None} and len(got) == 10
    same(got, [(i, v) for i, v in rows])
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.filter("vec_id > 99 AND vec_id < 105")).collect() == []


def test_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 4.0, 3.0])], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    assert [abs(got[i, 1].whitened) for i in (1, 2)] == [1.0, 1.0] and got[1, 1].explained == 1.0 and got[1, 1].identity_error == 0.0
    assert got[1, 2].whitened is None and got[1, 3].whitened is None and len(got) == 6
    one = whitening.whiten(df.filter("vec_id = 1")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 3
    huge = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert sorted(r.deviation is None for r in whitening.whiten(huge).collect()) == [False, True, True]
