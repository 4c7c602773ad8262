from math import log

from pyspark.sql import functions as F

from lorewell.operators import pack, search


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "p", f"s{i % 3}") for i, t in enumerate(texts)], "id long, content string, project string, source_path string")


def brute(texts, phrases):
    import re

    w = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    n, a = len(w), sum(map(len, w)) / len(w)
    tf = lambda d, p: sum(d[i : i + len(p)] == list(p) for i in range(len(d)))
    out = {}
    for i, d in enumerate(w):
        s = hit = 0
        for p in phrases:
            k = sum(tf(x, p) > 0 for x in w)
            idf = log((n - k + 0.5) / (k + 0.5))
            f = tf(d, p)
            hit += f
            s += max(idf, 1e-6 if idf <= 0 else idf) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / a))
        if hit:
            out[i] = s
    return out


def test_bm25(spark):
    texts = ["alpha beta beta", "foo-bar alpha", "foo x bar", None, "", "gamma", "beta foo bar foo bar", "delta", "x y z", "q"]
    q = search.phrases('beta "foo-bar" beta, ?!')
    assert q == [["beta"], ["foo", "bar"], ["beta"]]
    got = {r.id: r.score for r in search.bm25(frame(spark, texts), q).collect()}
    want = brute(texts, q)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert search.bm25(frame(spark, texts), []).count() == 0


def test_round_robin_and_versions(spark):
    rows = [(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "b", 4), (5, None, 5), (6, "b", 6)]
    df = spark.createDataFrame(rows, "id long, source_path string, rank int")
    order = [r.id for r in search.round_robin(df, 5).orderBy("place").collect()]
    assert order == [1, 4, 5, 2, 6]
    assert [r.id for r in search.round_robin(df, 6).orderBy("place").collect()] == [1, 2, 3, 4, 5, 6]
    v = spark.createDataFrame([(1, "a", "s", 1, 1), (2, "a", "s", 3, 2), (3, None, None, None, 3), (4, None, None, None, 4)], "id long, source_path string, section string, version int, rank int")
    assert sorted((r.id, r.rank) for r in search.latest_versions(v).collect()) == [(2, 1), (3, 3), (4, 4)]


def test_cjk(spark):
    df = frame(spark, ["苏轼是宋代词人", "宋代的历史很长", "nothing", "苏轼 苏轼 苏轼"]).withColumn("section", F.lit(None).cast("string"))
    assert search.cjk_search(df, "苏轼词人", 3).count() == 0  # none of its trigrams occurs
    got = [r.id for r in search.cjk_search(df, "宋代词人", 3).orderBy("rank").collect()]
    assert got[0] == 0 and 2 not in got
    assert [r.id for r in search.cjk_search(df, "苏", 3).collect()] and search.focus("项目中苏轼是什么?") == "苏轼"
    assert search.trigrams("宋代词人 x 宋代词") == ["宋代词", "代词人"]


def test_packing_folds(spark):
    rows = spark.createDataFrame([(1, r, c) for r, c in enumerate((50, 70, 40, 10, 30), 1)], "q int, rank int, cost int")
    got = {r["rank"]: r.admitted for r in pack.packed(rows, 100, ["q"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}
    got = {r["rank"]: r.admitted for r in pack.prefix_packed(rows, 125, ["q"], F.col("rank")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def fused_plain(triples, chunks, budget, share=0.4, k=3):
    reserve = int(budget * share)
    left, one, docs = budget - reserve, [], []
    for i, (c, ev) in enumerate(triples):
        if c <= left:
            one.append(i)
            left -= c
            for d, e in ev if i < k else ():
                if e <= left:
                    docs.append(d)
                    left -= e
    left += reserve
    two = []
    for i, (d, c) in enumerate(chunks):
        if d not in docs and c <= left:
            two.append(i)
            left -= c
    three = []
    for i, (c, _) in enumerate(triples):
        if i not in one and c <= left:
            three.append(i)
            left -= c
    return one, three, two, docs, budget - left


def test_three_passes(spark):
    import random

    r = random.Random(6)
    rows = []
    for q in range(60):
        t = [(r.randint(1, 30), [(r.randint(1, 9), r.randint(1, 40)) for _ in range(r.randint(0, 3))]) for _ in range(r.randint(0, 8))]
        c = [(d, r.randint(1, 60)) for d in r.sample(range(1, 12), r.randint(0, 6))]
        rows.append((q, r.randint(0, 150), t, c))
    for budget in (0, 60, 120):
        df = spark.createDataFrame([(q, t, c) for q, _, t, c in rows], "q int, t array<struct<cost:bigint,evidence:array<struct<doc_id:bigint,cost:bigint>>>>, c array<struct<doc_id:bigint,cost:bigint>>")
        for x in df.select("q", pack.fused(F.col("t"), F.col("c"), budget).alias("f")).collect():
            assert (x.f.triples, x.f.backfill, x.f.chunks, x.f.evidence, x.f.used) == fused_plain(rows[x.q][2], rows[x.q][3], budget)


def test_footer():
    assert pack.footer(2, 3, 1234, 2000) == "(returned 2/3 triples, ~1,234/2,000 tokens; raise --budget for more)"
    assert pack.footer(3, 3, 10, 20, (1, 1)) == "(returned 3/3 triples, 1/1 FTS chunks, ~10/20 tokens)"
    assert pack.partition_budget(2000, 0.15, 100) == (300, 1900)


def test_similar_pairs_are_the_best_of_all(spark, monkeypatch):
    """Held to a plain join of words, with small blocks, copies, ties and two projects."""
    import math
    import random
    from collections import Counter

    from lorewell.operators import blocks

    monkeypatch.setattr(blocks, "LEAST", 5)
    rng = random.Random(5)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(1, 14)))
    rows = [(i, f"p{i % 2}", f"title {text()}", text() if i % 7 else "the same words", "more") for i in range(80)]
    words = {r[0]: " ".join(r[2:]).split() for r in rows}
    asked = {r[0]: Counter(" ".join(r[2:4]).split()) for r in rows}
    n, a = len(rows), sum(map(len, words.values())) / len(rows)
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: x if (x := math.log((n - d + 0.5) / (d + 0.5))) > 0 else 1e-6 for w, d in df.items()}
    want = set()
    for i in words:
        scores = []
        for j, ws in words.items():
            if i != j and i % 2 == j % 2 and asked[i].keys() & set(ws):
                f = Counter(ws)
                scores.append((-round(sum(t * idf[w] * f[w] * 2.2 / (f[w] + 1.2 * (0.25 + 0.75 * len(ws) / a)) for w, t in asked[i].items() if w in f), 6), j))
        want |= {(min(i, j), max(i, j)) for _, j in sorted(scores)[:5]}
    units = spark.createDataFrame(rows, "id long, project string, title string, content string, context string")
    found = search.similar_pairs(units)
    assert {tuple(r) for r in found.collect()} == want
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_without_a_shuffle(spark):
    rows = [(1, "b a b c a b"), (2, ""), (3, "a"), (4, None), (5, "Zé zé d " * 30)]
    docs = spark.createDataFrame(rows, "id long, content string")
    found = search.postings(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.term, r.id): (r.frequency, list(r.positions), r.length) for r in found.collect()}
    want = {("a", 1): (2, [1, 4], 6), ("b", 1): (3, [0, 2, 5], 6), ("c", 1): (1, [3], 6), ("a", 3): (1, [0], 1), ("d", 5): (30, list(range(2, 90, 3)), 90), ("ze", 5): (60, [i for i in range(90) if i % 3 < 2], 90)}
    assert got == want


def test_trigrams_are_counted_where_they_overlap(spark):
    texts = ["一一一一", "一二一二一", "AB一二一", "一二", "", "𠀀一二一\n二一", ".*?一二一"]
    grams = ["一一一", "一二一"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string").withColumn("c", search.trigram_counts(F.col("content"), grams))
    for r in df.collect():
        windows = [texts[r.id].lower()[k : k + 3] for k in range(len(texts[r.id]) - 2)]
        assert (r.c.n, list(r.c.tf)) == (len(windows), [windows.count(g) for g in grams])
