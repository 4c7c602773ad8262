import hashlib
from collections import Counter

from lorewell.llm.exact_dedup import directory, exact_duplicates, without_exact_duplicates

from .cases import ROWS, clashing, docs, empty


def folded(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def test_classes_match_brute_force(spark):
    got = exact_duplicates(docs(spark), capacity=2).collect()
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(folded(t), []).append(i)
    want = []
    for i, t, _ in ROWS:
        g = groups[folded(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(folded(t).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_extra_columns_and_empty_table(spark):
    assert exact_duplicates(clashing(docs(spark))).count() == len(ROWS)
    assert exact_duplicates(empty(spark)).collect() == []


def test_filter_keeps_all_columns(spark):
    df = clashing(docs(spark))
    out = without_exact_duplicates(df)
    assert out.columns == df.columns
    assert {r[0] for r in out.collect()} == {2, 5, 7, 8, 9, 10, 11, 12, 4, None}


def test_directory_doubles_until_buckets_hold_their_keys(spark, tmp_path):
    high = [k << 52 for k in range(5)] + [(0b001 << 61) + 1, (0b110 << 61) - (1 << 64) + 1]
    keys = spark.createDataFrame([(k,) for k in high], "key long")
    slots, depth, start = directory(keys, len(high), 2, str(tmp_path))
    assert start == 0 and depth >= 11  # five keys differ in bits 10 to 12
    got = {(r.bucket, r.bits): r.slot for r in slots.collect()}
    assert {(1 << depth - 3, 3), (1 << depth - 1, 1)} <= set(got)
    held = Counter(b for b, _ in ((r.bucket, r.slot) for r in slots.collect()))
    assert max(held.values()) <= 2
    even = spark.range(1000).selectExpr("xxhash64(id) AS key")
    slots, depth, start = directory(even, 1000, 16, f"{tmp_path}/even")
    rows = even.selectExpr(f"shiftrightunsigned(key, {64 - depth}) AS slot").join(slots, "slot").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in rows) == 1000 and max(r["count"] for r in rows) <= 16 and start <= 6 <= depth


def test_empty_directory(spark, tmp_path):
    assert directory(spark.createDataFrame([], "key long"), 0, 4, str(tmp_path))[0].collect() == []


def test_colliding_keys_are_links_of_a_chain(spark, monkeypatch):
    """With a hash of few values, unequal texts share keys and must stay apart."""
    from pyspark.sql import functions as F

    from lorewell.llm import exact_dedup as E

    rows = [(i, f"text {i % 40}", "s") for i in range(120)]
    plain = F.xxhash64
    monkeypatch.setattr(E.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") if isinstance(c[0], str) and c == ("norm",) else plain(*c))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(docs(spark, rows), capacity=1).collect()}
    monkeypatch.undo()
    assert got == {i: (80 + i % 40, 3) for i in range(120)}


def test_frequent_groups_are_looked_up_apart(spark, monkeypatch):
    from lorewell.llm import exact_dedup as E

    monkeypatch.setattr(E, "HOT", 3)
    rows = [(i, "hot" if i % 2 else f"own {i // 3}", "s") for i in range(90)]
    got = exact_duplicates(docs(spark, rows)).collect()
    assert len(got) == 90 and {(r.keep_id, r.group_size) for r in got if r.doc_id % 2} == {(89, 45)}


def test_one_row_of_each_class_stays(spark):
    rows = [(1, "Same", "a"), (1, "same", "b"), (1, "other", "a"), (None, "no id", "a"), (None, "NO id", "b"), (None, "same", "c"), (2, None, "a"), (None, "", "a")]
    out = without_exact_duplicates(docs(spark, rows)).collect()
    assert sorted((folded(t), i or 0) for i, t, _ in out) == [("", 2), ("no id", 0), ("other", 1), ("same", 1)]
