import math
import random

from lorewell.llm.topk import top_k


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int")


def brute(rows, k, every):
    ok = {(i, tuple(math.floor(64 * c) for c in v)) for i, v, *_ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for q, x in ok:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(x) == len(y))[:k]
            out += [(q, n, i, -v) for n, (v, i) in enumerate(s, 1)]
    return sorted(out)


def test_matches_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(24)], 0, 0) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 0, 0) for i in range(60)]  # many equal vectors: ties go to smaller ids
    rows += [(2000, None, 0, 0), (2020, [], 0, 0), (2040, [float("nan")] * 24, 0, 0), (2060, [None] * 24, 0, 0), (2080, [1.0, 2.0], 0, 0), (2100, [3.0, 4.0], 0, 0), (2120, [float("inf")] * 24, 0, 0), (None, rows[0][1], 0, 0), rows[20]]
    for sizes in ({"block": 50, "query_block": 3, "group": 2, "stride": 4}, {}):
        got = sorted(tuple(x) for x in top_k(table(spark, rows), 20, 20, **sizes).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute(rows, 20, 20)


def test_empty_and_few(spark):
    assert top_k(table(spark, [])).collect() == []
    assert top_k(table(spark, [(0, [1.0], 0, 0)])).collect() == []
    assert [tuple(x) for x in top_k(table(spark, [(0, [1.0], 0, 0), (1, [-0.5], 0, 0)])).collect()] == [(0, 1, 1, -2048)]


def test_blocks_that_can_hold_nothing_are_not_moved(spark):
    """Long vectors come last in their cell, so blocks of short ones are ruled out by their statistics."""
    r = random.Random(4)
    rows = [(i, [r.gauss(4 if i % 2 else 0.01, 0.1) * (10 if i > 560 else 0.1) for _ in range(16)], 0, 0) for i in range(600)]
    got = sorted(tuple(x) for x in top_k(table(spark, rows), 5, 20, block=20, query_block=4, stride=2).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 5, 20)
    many = [(i, v, 0, 0) for i in range(0, 2000, 20) for v in [[r.gauss(0, 1) for _ in range(8)]]]  # every row is a query
    got = sorted(tuple(x) for x in top_k(table(spark, many), 3, 20, block=16, query_block=8, stride=3).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(many, 3, 20)


def test_bounds_hold():
    import numpy as np

    from lorewell.llm.topk import LEVELS, statistics

    r = np.random.default_rng(1)
    x, y = r.normal(size=(50, 30)), r.normal(2, 3, size=(60, 30))
    exact, last = x @ y.T, np.full((50, 60), np.inf)
    for level in LEVELS:
        bound = statistics(x, level) @ statistics(y, level).T
        assert (bound >= exact - 1e-9).all() and (bound <= last + 1e-9).mean() > 0.9
        last = bound
