import math

import pytest

from brindle.functions import theory


def g_upper(n, p, q):
    half, nq = 0.5 * math.log(2 * math.pi * n * q), n * q
    return (8 * q * q - 15 * q + 8) / (12 * nq) - (24 * q**3 - 55 * q * q + 41 * q - 10) / (12 * nq * nq) - (3 * q * q - 5 * q + 2) / (6 * n * nq * nq) - (1 - p) ** n * (half - 5 / 6 + 1 / (3 * nq)) - n * p * (1 - p) ** (n - 1) * (half + math.log(nq) - 11 / 3 + 9 / (2 * nq) - 9 / (4 * nq * nq) + 1 / (2 * nq**3))


def true_entropy(n, ps):
    """Over all outcomes of the counts, two or three categories."""
    def outcomes(m, left):
        if m == 1:
            yield (left,)
            return
        for k in range(left + 1):
            for rest in outcomes(m - 1, left - k):
                yield (k, *rest)

    h = 0.0
    for ks in outcomes(len(ps), n):
        w = math.exp(math.lgamma(n + 1) + sum(k * math.log(p) - math.lgamma(k + 1) for k, p in zip(ks, ps)))
        h -= w * math.log(w)
    return h


def test_bounds_hold_the_entropy(spark):
    grid = [(0, 40, [0.5, 0.5]), (1, 60, [0.2, 0.3, 0.5]), (2, 30, [0.3, 0.7])]
    rows = [(i, n, p) for i, n, ps in grid for p in ps]
    spark.createDataFrame(rows, "id int, n int, p double").createOrReplaceTempView("categories")
    got = {r["id"]: r for r in spark.sql(theory.bounds_sql("categories")).collect()}
    for i, n, ps in grid:
        h = true_entropy(n, ps)
        assert got[i]["lower_nats"] <= h + 1e-9 <= got[i]["upper_nats"] + 2e-9 and got[i]["upper_nats"] - got[i]["lower_nats"] < 0.2
    n, ps = 60, [0.2, 0.3, 0.5]
    want = 0.5 * math.log((2 * math.pi * n * math.e) ** 2 * math.prod(ps)) + sum(g_upper(n, p, p) for p in ps)
    assert got[1]["upper_nats"] == pytest.approx(want)
