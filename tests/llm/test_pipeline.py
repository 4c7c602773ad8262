import random
from collections import Counter

import corpus_pipeline as P
from lorewell.llm import mixing, toxicity
from lorewell.llm.common import shared_dir, written
from lorewell.llm.packing import cuts

from .cases import clashing, docs
from .test_exact_dedup import folded
from .test_near_dedup import brute, corpus


def tables(spark, tmp_path):
    r = random.Random(8)
    rows = corpus()
    rows += [(2000 + i, t, s) for i, (_, t, s) in enumerate(rows[:40])]
    rows += [(3000 + i, " ".join(f"v{r.randrange(500)}" for _ in range(30)) + (" grumbel snarkos vilefin grumbel" if i % 4 == 0 else ""), r.choice(("a", "b", None))) for i in range(400)]
    rows += [(4000, None, "a"), (4001, "", None)]
    df = docs(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "source", "cast(length(text) AS long) AS n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3000 + i, 1, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages_match_plain_python(spark, tmp_path):
    rows = tables(spark, tmp_path)
    text, d = {i: t for i, t, _ in rows}, str(tmp_path)
    now, top = spark.read.parquet(f"{d}/documents.parquet"), shared_dir(spark)
    columns, before = now.columns, set(text)
    model = toxicity.trained(now.select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
    for name, stage in P.STAGES:
        out = written(stage(spark, now, d), f"{top}/{name}")
        if name != "packing":
            assert out.columns == columns
            ids = [r.doc_id for r in out.collect()]
        if name == "toxicity":
            assert set(ids) == {i for i in before if model.severity(text[i])[0] < 0.5}
            assert sum((i in set(ids)) != ("grumbel" in (text[i] or "")) for i in before) >= 0.97 * len(before)
        elif name == "exact_dedup":
            last = {}
            for i in sorted(before):
                last[folded(text[i])] = i
            assert sorted(ids) == sorted(last.values())
        elif name == "near_dedup":
            want = brute([(i, text[i]) for i in before], 5)
            assert sorted(ids) == sorted(i for i in before if want[i][1] == i)
        elif name == "mixing":
            times = {r.doc_id: r.times for r in mixing.mixture(now).collect()}
            assert Counter(ids) == {i: n for i, n in times.items() if n}
        else:
            pieces = out.collect()
            own = Counter((r.doc_id, r.piece, r.start, r.length) for r in pieces)
            total = {i: max(s + n for (j, _, s, n) in own if j == i) for i in set(ids)}
            assert own == Counter({(i, k, s, n): c for i, c in Counter(ids).items() for k, (s, n) in enumerate(cuts(total[i], 1024))})
            used = Counter()
            for r in pieces:
                used[r.sequence_id] += r.length
            assert max(used.values()) <= 1024
        now, before = out, set(ids)


def test_run_is_the_stages_in_order(spark, tmp_path):
    tables(spark, tmp_path)
    out = P.run(spark, str(tmp_path))
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_awkward_tables(spark, tmp_path):
    """Rows that repeat an id or have none, clashing names, no rows: no stage fails, copies go, all columns stay."""
    r = random.Random(9)
    text = lambda: " ".join(f"v{r.randrange(500)}" for _ in range(30))
    twice = text()
    rows = [(1, "a b c d e f", "a"), (1, "a b c d e f", "a"), (2, twice, "a"), (2, twice.upper(), "b"), (None, twice, "b"), (None, twice + " end", None), (None, None, None), (3, "", "a"), (4, text() + " Ä", "b")]
    rows += [(10 + i, text() + (" grumbel" if i % 3 == 0 else ""), "a") for i in range(90)]
    extra = [c for c in clashing(docs(spark, rows)).columns if c not in ("text", "source", "doc_id")]
    spark.createDataFrame([(10 + i, 1, int(i % 3 == 0)) for i in range(60)] + [(1, None, None), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, table in (("full", rows), ("none", [])):
        clashing(docs(spark, table)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        for k, (stage, f) in enumerate(P.STAGES):
            out = written(f(spark, now, str(tmp_path)), f"{tmp_path}/{name}{k}")
            if stage != "packing":
                assert out.columns == now.columns and set(extra) <= set(out.columns)
            if stage == "near_dedup":
                texts = [folded(x.text) for x in out.collect()]
                assert len(set(texts)) == len(texts) and (name == "none" or sum(t.startswith(twice[:40]) for t in texts) == 1)
                assert not table or {"", "a b c d e f"} <= set(texts)
            if stage == "mixing":
                times = Counter((x.doc_id, x.text) for x in out.collect())
                assert max(times.values(), default=0) <= 3
            now = out
        assert (now.count() > 0) == bool(table)
