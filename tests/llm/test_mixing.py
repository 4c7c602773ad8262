import random
from collections import Counter, defaultdict

import numpy as np

from lorewell.llm.mixing import flight, landing, mixed, mixture, source_targets

from .cases import ROWS, clashing, docs, empty


def filled(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by rounds, as the words of the contract have it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        share = {s: (total - sum(fixed.values())) * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s: most * sizes[s] for s in rest if share[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return fixed | share
        fixed |= over


def test_targets_match_rounds(spark):
    r = random.Random(4)
    for sizes in ({"a": 10, "b": 1, None: 100, "Z": 5, "é": 7}, {"x": 5}, {"x": 0, "y": 9}, {str(i): r.choice((1, 10, 1000)) for i in range(11)}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {x.source: x.target for x in source_targets(rows).collect()}
        want = filled(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_flight_keeps_both_totals():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 500):
        size = r.integers(0, 30, n).astype(float)
        p = np.full(n, 0.37)
        q = flight(p, size, r)
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-6
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2 and q.min(initial=0) >= 0 and q.max(initial=0) <= 1


def test_every_document_keeps_its_probability():
    r = np.random.default_rng(1)
    size, p, n = r.integers(1, 30, 14).astype(float), r.random(14), 3000
    taken = sum(landing(flight(p, size, np.random.default_rng(k)), size, np.zeros(14, bool)) for k in range(n))
    # the flight itself is unbiased; the landing moves at most two documents
    flown = sum(flight(p, size, np.random.default_rng(k)) for k in range(n)) / n
    assert np.abs(flown - p).max() < 5 * np.sqrt(0.25 / n) and np.abs(taken / n - p).max() < 0.2


def many(spark, n=6000):
    r = random.Random(2)
    rows = [(i, "w " * r.choice((0, 1, 5, 30, 200)), r.choice(("a", "a", "a", "b", "c", None))) for i in range(n)]
    return rows, docs(spark, rows)


def test_takes_come_near_and_reruns_agree(spark):
    rows, df = many(spark)
    got = mixture(df, block=256).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixture(df.repartition(7), block=256).collect()))
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    taken, target = defaultdict(int), {}
    for x in got:
        assert x.size == len(rows[x.doc_id][1].split()) and x.taken == x.size * x.times and 0 <= x.times <= 3
        taken[source[x.doc_id]] += x.taken
        target[source[x.doc_id]] = x.target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)


def test_awkward_rows(spark):
    assert mixture(docs(spark)).count() == len(ROWS)
    assert mixture(clashing(docs(spark))).count() == len(ROWS)
    assert mixture(empty(spark)).collect() == []


def test_mixed_repeats_rows(spark):
    _, df = many(spark, 600)
    want = {x.doc_id: x.times for x in mixture(df).collect() if x.times}
    out = mixed(clashing(df))
    assert out.columns == clashing(df).columns
    got = defaultdict(int)
    for x in out.collect():
        got[x[0]] += 1
    assert got == want


def test_mixed_rows_of_one_id_take_their_own_times(spark):
    df = docs(spark, [(i, f"{n} " + "w " * (n % 7), s) for i, s in ((5, "a"), (None, "b")) for n in range(20)])
    got = Counter((x.doc_id, x.text) for x in mixed(df).collect())
    times = Counter((x.doc_id, x.size, x.times) for x in mixture(df).collect() if x.times)
    assert max(got.values()) <= 3 and Counter((i, len(t.split()), n) for (i, t), n in got.items()) == times
