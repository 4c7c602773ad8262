import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorewell.llm import kneser_ney as K

from .cases import ROWS, clashing, docs, empty


def brute(rows):
    toks = lambda t: (t or "").encode().lower().split() + [None]
    train = [toks(t) for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    uni, bi = Counter(), Counter()
    for w in train:
        uni.update(w)
        bi.update(zip(["<s>", *w[:-1]], w))
    n, v, before, ctx = sum(uni.values()), len(uni), Counter(w for _, w in bi), defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in bi.items():
        ctx[u][0] += c
        ctx[u][min(c, 3)] += 1
    of = lambda values: K.discounts([sum(x == k for x in values) for k in (1, 2, 3, 4)])
    d2, d1, a = of(bi.values()), of(before.values()), max(len(bi), 1)
    gap = sum(d1[min(x, 3) - 1] for x in before.values()) / a if bi else 1.0

    def low(w):
        return (before[w] - d1[min(before[w], 3) - 1] if before[w] else 0) / a + gap / (v + 1)

    def p(u, w):
        s = ctx.get(u)
        if not s:
            return low(w)
        c = bi[u, w]
        return (c - d2[min(c, 3) - 1] if c else 0) / s[0] + sum(x * y for x, y in zip(s[1:], d2)) / s[0] * low(w)

    out = []
    for i, t, _ in rows:
        w = toks(t)
        out.append((i, len(w), sum(x in uni for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w[:-1]], w))))
    return out


def test_scores_match_brute_force(spark):
    check(spark, ROWS + [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 40)), "s") for i in range(100, 400)])


def test_frequent_contexts_have_ranges_of_their_own(spark):
    rows = [(i, " ".join(f"a w{(i * j) % 97} a z{j % 7}" for j in range(30)), "s") for i in range(300)]
    model = K.trained(docs(spark, rows).select("doc_id", "text"))
    assert model.hot and len(model.keys) > model.words.ranges
    check(spark, rows)


def test_counts_above_32_bits():
    keys, n = np.array([3, 1 << 40], np.uint64), np.array([(1 << 32) + 5, 1], np.int64)
    a, b = K._unpack(K._pack(keys, n))
    assert a.tolist() == keys.tolist() and b.tolist() == n.tolist()
    assert K.narrow(n).dtype == np.dtype("<u8") and K.narrow(n[1:]).dtype == np.dtype("<u4")


def test_counts_of_either_width_are_read_back(tmp_path):
    for name, n in (("a", [7, (1 << 33) + 1, 2]), ("b", [7, 1, 2]), ("c", [])):
        K._save(f"{tmp_path}/{name}", K.narrow(np.array(n, np.int64)))
        assert K._counts(f"{tmp_path}/{name}", len(n)).tolist() == n


def check(spark, rows):
    got = K.scores(docs(spark, rows)).collect()
    key = lambda x: repr(x[:4])
    mine = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    for x, y in zip(mine, sorted(brute(rows), key=key), strict=True):
        assert x[:4] == y[:4]
        assert x[4] == pytest.approx(y[4], rel=1e-9) and x[5] == pytest.approx(y[5], rel=1e-9)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(50) if not K.in_training(i))
    (r,) = K.scores(docs(spark, [(held, "some words", "s")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_awkward_rows(spark):
    assert K.scores(clashing(docs(spark))).count() == len(ROWS)
    assert K.scores(empty(spark)).collect() == []


def test_shared_folder_must_be_files():
    with pytest.raises(ValueError):
        K._local("hdfs://x/y")
    assert K._local("file:///a/b") == "/a/b"
