import random

import pytest

from brindle.operators.components import connected_components, roots


@pytest.mark.parametrize("last", [0, 10, 10_000])
def test_like_union_find(spark, last):
    r = random.Random(7)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2050)] + [(5, 5)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "src long, dst long"), last).collect()))
    assert got == roots([p for p in pairs if p[0] != p[1]])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long"), 0).count() == 0
