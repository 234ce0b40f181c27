"""Exact products against Python's whole numbers, whitening against numpy, and the defined cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.llm.queries import op13_whitening
from driftline.llm.whitening import Gram, centred, decomposed, limbs, multiplied, whiten

NUMBER = st.integers(-(1 << 62), (1 << 62) - 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(NUMBER, st.integers(-5, 5), st.integers(-(10**6), 10**6)), min_size=1, max_size=9))
def test_products_are_exact(rows):
    x, n = np.array(rows, np.int64), len(rows)
    sums = x.astype(object).sum(0)
    y = x.astype(object) * n - sums
    assert (centred(x, n, sums) == y).all()
    gram = Gram(3)
    gram.add(centred(x, n, sums))
    gram.add(centred(x, n, sums))
    assert (gram.value() == 2 * (y.T @ y)).all()
    assert (multiplied(y.T, y) == y.T @ y).all()
    assert (sum(part.astype(object) * 2 ** (20 * k) for k, part in enumerate(map(lambda f: f.astype(np.int64), limbs(y)))) == y).all()


def test_close_eigenvalues_keep_double_precision():
    """V = Q diag(3, 2 + 1e-13, 2, 1e-9) Q' from whole numbers: the residual of every pair is at the last bit."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    m = np.vectorize(int, otypes=[object])(np.ldexp(q * [3, 2 + 1e-13, 2, 1e-9] @ q.T, 90).astype(object))
    m = np.triu(m) + np.triu(m, 1).T
    found = decomposed(m, 1, np.zeros(4, object), 4)
    for e, v in zip(found.values, found.vectors.T):
        exact = [sum(Fraction(m[i, j]) * Fraction(v[j]) for j in range(4)) - Fraction(e) * Fraction(v[i]) for i in range(4)]
        assert float(max(map(abs, exact))) < 3 * 2.0**90 * 4e-16
        assert abs(math.fsum(v * v) - 1) < 1e-15


def brute(rows, components=16):
    """Rows of (id, component, n, deviation, whitened, explained), from whole numbers and one numpy decomposition."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lists = sorted({tuple(x) for _, x in kept})
    n, d = len(lists), len(lists[0])
    sums = [sum(x[j] for x in lists) for j in range(d)]
    y = np.array([[n * x[j] - sums[j] for j in range(d)] for x in lists], object)
    v = (y.T @ y / n**3).astype(float)
    e, q = (a[..., ::-1] for a in np.linalg.eigh(v))
    out = {}
    for i, x in kept:
        own = [n * x[j] - sums[j] for j in range(d)]
        z = np.array([float(Fraction(o, n)) for o in own]) @ q[:, :components] / np.sqrt(e[:components])
        out.setdefault(i, []).append((n, sum(o * o for o in own), z, (e / e.sum())[:components]))
    return out


def agree(found, expected):
    assert sum(map(len, found.values())) == sum(map(len, expected.values())) and found.keys() == expected.keys()
    k = len(next(iter(expected.values()))[0][2])
    flat = [(g, w) for i in expected for g, w in zip(sorted(found[i], key=lambda r: r[1]), sorted(expected[i], key=lambda r: r[1]))]
    for g, w in flat:
        assert g[:2] == w[:2] and len(g[2]) == k and np.allclose(g[3], w[3], rtol=1e-9)
    a, b = np.array([g[2] for g, _ in flat]), np.array([w[2] for _, w in flat])
    sign = np.sign((a * b).sum(0))
    assert np.abs(a * sign - b).max() < 1e-7


def test_query_matches_numpy(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = {}
    for (i, n, dev), own in op13_whitening(spark, folder).toPandas().sort_values("component").groupby(["vec_id", "n", "deviation"]):
        assert own["component"].tolist() == list(range(1, 17)) and (own["identity_error"] < 1e-9).all()
        found.setdefault(i, []).append((n, dev, own["whitened"].to_numpy(), own["explained"].to_numpy()))
    agree(found, brute(rows))


def test_defined_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)] + [(3, [0.5] * 5)] * 3 + [(None, [0.25] * 5), (99, [1.0, 2.0, 3.0, -4.0, 1e3])]
    bad = [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [float("nan")] * 5), (53, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "id long, v array<double>, `a.b` int, white int").withColumn("whole", F.lit("x"))
    made = whiten(df.repartition(4), components=3, vector="v")
    assert made.columns == ["id", "v", "a.b", "whole", "white"]
    found = {}
    for r in made.collect():
        found.setdefault(r.id, []).append((r.white.n, int(r.white.deviation), np.array(r.white.whitened), np.array(r.white.explained)))
        assert r.white.identity_error < 1e-6
    agree(found, brute(rows, 3))


def test_widths_constants_and_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0, 2.0]), (4, [7.0]), (5, [7.0]), (6, []), (7, [1.5, 2.0])], schema)
    white = {r.vec_id: r.white for r in whiten(df).collect()}
    assert [white[i].n for i in (1, 2, 3, 7)] == [4] * 4 and len(white[1].whitened) == 1  # the second entry has no variance
    assert white[4].n == 1 and white[4].whitened == [] and white[4].deviation == 0
    assert white[6].n is None and white[6].whitened is None
    assert whiten(df.filter("false")).collect() == []
    with pytest.raises(Exception, match="does not fit"):
        whiten(spark.createDataFrame([(1, [1e30])], schema)).collect()
