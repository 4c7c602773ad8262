import random

import numpy as np

from lorewell.llm import near_dedup as D
from lorewell.operators.components import components

from .cases import ROWS, clashing, docs, empty


def shingle_set(t, width):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width):
    s = {i: shingle_set(t, width) for i, t, *_ in rows if i is not None}
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and s[b] and root(a) != root(b):
                both = len(s[a] & s[b])
                if 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
                    up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(s[i]), root(i)) for i in ids}


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    rows, hot = [], r.choices(words, k=60)
    for i in range(260):  # one large group of near copies, far from alike among themselves
        t = [r.choice(words) if r.random() < 0.1 * r.random() else w for w in hot]
        rows.append((i, " ".join(t), "a"))
    shared = r.choices(words, k=25)
    rows += [(300 + i, " ".join(shared + r.choices(words, k=40)), "b") for i in range(150)]  # a passage in common, no more
    rows += [(500 + i, rows[0][1].upper(), "c") for i in range(50)]  # copies
    for i in range(100):  # chains: each differs a little from the one before
        t = rows[-1][1].split() if i % 10 else r.choices(words, k=r.choice((3, 5, 12, 40)))
        t[r.randrange(len(t))] = r.choice(words)
        rows.append((600 + i, " ".join(t), "d"))
    return rows


def test_components_match_brute_force(spark):
    rows = corpus() + [x for x in ROWS if x[0] is None or x[0] not in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)] + [(9000 + i, t, s) for i, (_, t, s) in enumerate(ROWS)]
    for width in (2, 5):
        want = brute(rows, width)
        for bound in ({}, {"bucket_block": 40}, {"block_shingles": 900}) if width == 2 else ({},):
            got = D.near_duplicates(docs(spark, rows), width=width, **bound).collect()
            assert len(got) == len(rows)
            for r in got:
                if r.doc_id is not None:
                    assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
                else:
                    assert r.component_id is None and r.kept


def test_sketches_are_full_and_concentrated():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 1 << 63, 400).astype(np.uint64), r.integers(0, 1 << 63, 100).astype(np.uint64)
    one, two = np.sort(a), np.sort(np.concatenate((a[:300], b)))  # similarity 0.6
    s = D.sketches(np.concatenate((one, two, one[:1])), np.array([400, 400, 1, 0]), 200)
    assert (s[:3] != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12


def test_components_of_paths_and_stars(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1100)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(80)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    from lorewell.llm.common import shared_dir

    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark)).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_awkward_tables(spark):
    assert D.near_duplicates(clashing(docs(spark))).count() == len(ROWS)
    assert D.near_duplicates(empty(spark)).collect() == []
    df = clashing(docs(spark))
    out = D.without_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r[0] or 0 for r in out.collect()) == [0, 1, 3, 4, 5, 6, 8, 10, 11, 12]


def test_bytes_that_agree_by_chance_hide_no_pair(spark):
    """Two linked documents whose first coordinates differ but for a byte, in a bucket whose centre is linked to neither."""
    from pyspark.sql import functions as F

    from lorewell.llm.common import word_hashes

    def sketch(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        return D.sketches(*D.shingles(*word_hashes(data, np.array([0, len(data)])), 1), 2)[0]

    base = [f"base{i}" for i in range(9)]
    plain, low = sketch(base), {}
    for i in range(10_000):
        s = sketch(base + [f"new{i}"])
        if s[0] != plain[0] and s[1] == plain[1]:
            k, first = low.setdefault(int(s[0]) & 255, (i, s[0]))
            if first != s[0]:
                break
    one, two = base + [f"new{k}"], base + [f"new{i}"]
    centre = next(w for b in base for n in range(1000) for w in [[b, f"far{n}", f"off{n}"]] if sketch(w)[1] == plain[1] and sketch(w)[0] not in (sketch(one)[0], sketch(two)[0]))
    order = [r.id for r in spark.range(1, 4).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, " ".join(w), "s") for i, w in zip(order, (centre, one, two))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_duplicates(docs(spark, rows), width=1, rows=1, n_bands=2).collect()}
    assert got == brute(rows, 1) and got[order[1]][1] == got[order[2]][1]
