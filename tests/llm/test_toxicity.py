import math
import random
from collections import Counter

import numpy as np

from lorewell.llm import toxicity as X

from .cases import ROWS, clashing, docs, empty


def corpus(n=1500, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    bad = ["grumbel", "snarkos", "vilefin"]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        w = r.choices(words, k=r.randint(1, 80))
        if toxic:
            for _ in range(r.randint(1, 6)):
                w.insert(r.randrange(len(w) + 1), r.choice(bad) + r.choice(("", "en", "ich")))
        rows.append((i, " ".join(w), "s"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels, bad


def test_held_out_accuracy_and_order(spark):
    rows, labels, bad = corpus()
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = X.toxicity(df, lab).collect()
    held = [(r, any(b in rows[r.doc_id][1] for b in bad)) for r in got if r.doc_id % 2]
    assert sum(r.rejected == t for r, t in held) >= 0.97 * len(held)
    for r in got:
        assert 1 >= r.p_mild >= r.p_strong >= r.p_severe >= 0 and abs(r.expected_severity - r.p_mild - r.p_strong - r.p_severe) < 1e-9
    many = lambda r: sum(rows[r.doc_id][1].count(b) for b in bad)
    severe = [r.expected_severity for r, _ in held if many(r) >= 5]
    mild = [r.expected_severity for r, _ in held if many(r) == 1]
    assert sum(severe) / len(severe) > sum(mild) / len(mild) + 0.5


def test_filter_keeps_all_columns(spark):
    rows, labels, bad = corpus(600)
    df, lab = clashing(docs(spark, rows)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = X.without_toxic(df, lab)
    assert out.columns == df.columns
    kept = {r[0] for r in out.collect()}
    assert sum((i in kept) == (not any(b in t for b in bad)) for i, t, _ in rows) >= 0.95 * len(rows)


def test_awkward_rows_and_missing_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 1), (2, None, 0), (None, 1, 1), (3, 1, None), (77, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for lab in (none, odd):
        assert X.toxicity(clashing(docs(spark)), lab).count() == len(ROWS)
        assert X.toxicity(empty(spark), lab).collect() == []
    assert not any(r.rejected for r in X.toxicity(docs(spark), none).collect())


def brute_model(rows, labels, most_features=400, least_docs=4):
    """The fit from plain Python counts, for a table whose labelled rows are all in the sample."""
    toxic = {}
    for i, _, t in labels:
        if i is not None and t is not None:
            toxic[i] = max(toxic.get(i, 0), int(t > 0))
    texts = {}
    for i, t, _ in rows:
        if i in toxic:
            texts[t] = max(texts.get(t, 0), toxic[i])
    bags = {t: X.counted(t) for t in texts}
    share, size = Counter(toxic.values()), Counter(texts.values())
    rate = size[1] / len(texts)
    a, b = Counter(), Counter()
    for t, bag in bags.items():
        b.update(bag.keys())
        a.update(bag.keys() if texts[t] else ())
    part = lambda n, all_, p: n * math.log(n / (all_ * p)) if n else 0.0
    gain = {f: 2 * (part(a[f], n, rate) + part(n - a[f], n, 1 - rate)) * (1 if a[f] > rate * n else -1) for f, n in b.items() if n >= least_docs}
    names = sorted(gain, key=lambda f: (-abs(gain[f]), f))[:most_features]
    at, telling = {f: i for i, f in enumerate(names)}, {f for f in names if gain[f] > gain[names[0]] / 10}
    hits = {t: sum(n for f, n in bag.items() if f in telling) for t, bag in bags.items()}
    cuts = np.quantile([hits[t] for t in texts if texts[t]], [1 / 3, 2 / 3])
    sample = []
    for t, y in texts.items():
        e = sorted((at[f], n) for f, n in bags[t].items() if f in at)
        sample.append((1 + int(hits[t] > cuts[0]) + int(hits[t] > cuts[1]) if y else 0, share[y] / size[y], [i for i, _ in e], [n for _, n in e]))
    return X.fitted(sample, names)


def test_model_and_scores_match_plain_python(spark):
    rows, labels, _ = corpus(500)
    rows += [(0, "grumbel of another text with the same id grumbelen", "s"), (None, "no id grumbel", "s"), (4, rows[4][1], "s")]
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want, got = brute_model(rows, labels), X.trained(df.select("doc_id", "text"), lab)
    assert set(want.weights) == set(got.weights)
    assert max(abs(want.weights[f] - got.weights[f]) for f in want.weights) < 1e-5 and np.allclose(want.thresholds, got.thresholds, atol=1e-5)
    scored = {}
    for r in X.toxicity(df, lab, model=got).collect():
        scored.setdefault(r.doc_id, []).append((r.p_mild, r.p_strong, r.p_severe))
    for i, t, _ in rows:
        z = sum(got.weights[f] * math.log1p(n) for f, n in X.counted(t).items() if f in got.weights)
        assert any(np.allclose(p, [1 / (1 + math.exp(c - z)) for c in got.thresholds]) for p in scored[i])


def test_fit_is_at_the_minimum():
    """The loss, as the definition has it, can't be lowered by moving any weight or threshold."""
    r = np.random.default_rng(3)
    rows = [(int(g), 1.0, [0, 1], [int(r.integers(1, 4)) + int(g), int(r.integers(1, 5))]) for g in r.integers(0, 4, 300)]
    m = X.fitted(rows, ["a", "b"], steps=4000, rate=0.02)

    def loss(w, cut):
        sig = lambda v: 1 / (1 + math.exp(-max(-40, min(40, v))))
        total = 0.0
        for g, _, _, n in rows:
            z = w[0] * math.log1p(n[0]) + w[1] * math.log1p(n[1])
            total -= math.log((1.0 if g == 3 else sig(cut[g] - z)) - (0.0 if g == 0 else sig(cut[g - 1] - z)))
        return total / len(rows) + 5e-5 / 2 * (w[0] ** 2 + w[1] ** 2)

    w, cut = [m.weights["a"], m.weights["b"]], m.thresholds
    best = loss(w, cut)
    for k in range(5):
        for step in (-0.05, 0.05):
            x = [*w, *cut]
            x[k] += step
            assert loss(x[:2], x[2:]) >= best - 1e-6
