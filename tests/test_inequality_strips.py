"""Two inequalities over strips: values that fill strips of their own, and rows sent once or twice whatever the number of strips."""

import operator
import random

import numpy as np
import pytest

from quern.operators import inequality

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@pytest.mark.parametrize("x, y", [("<", ">="), ("<=", "<"), (">", ">"), (">=", "<=")])
def test_hot_values_and_many_strips(spark, monkeypatch, x, y):
    monkeypatch.setattr(inequality, "TILE_ROWS", 25)
    rng = random.Random(x + y)
    number = lambda: rng.choice([0.0, -0.0, 5.0, 5.0, 5.0, rng.uniform(-9, 9), float("inf"), None])
    left, right = [(i, number(), number()) for i in range(200)], [(number(), number(), rng.randint(-9, 2**40)) for _ in range(300)]
    shipped, plain = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *a: shipped.append(df) or plain(df, *a))
    l, r = spark.createDataFrame(left, "id long, a double, b double"), spark.createDataFrame(right, "c double, d double, v long")
    got = sorted(map(tuple, inequality.inequality_aggregate(l, r, ("a", x, "c"), ("b", y, "d"), "id", "v").collect()))
    monkeypatch.undo()
    expected = []
    for i, a, b in left:
        met = [v for c, d, v in right if None not in (a, b, c, d) and OPS[x](a, c) and OPS[y](b, d)]
        expected.append((i, len(met), sum(met)))
    assert got == expected
    assert sum(df.count() for df in shipped) <= 2 * (len(left) + len(right))


def test_beyond_against_loops():
    rng = np.random.default_rng(1)
    for m, q in ((0, 3), (1, 4), (7, 9), (64, 50)):
        x, y, lx, ly = (rng.integers(0, 12, k).astype(float) for k in (m, m, q, q))
        v = rng.integers(-5, 5, m)
        for sx in (True, False):
            for sy in (True, False):
                met = [(x > a if sx else x >= a) & (y > b if sy else y >= b) for a, b in zip(lx, ly)]
                n, total = inequality._beyond(x, y, v, lx, ly, sx, sy)
                assert n.tolist() == [int(k.sum()) for k in met] and total.tolist() == [int(v[k].sum()) for k in met]
