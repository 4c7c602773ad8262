import random

from lorewell.operators import graph
from lorewell.tables import numbered, upserted


def test_traversal_with_cycle_and_several_seeds(spark):
    e = spark.createDataFrame([("a", "p", "b", None), ("b", "p", "c", None), ("c", "p", "a", None), ("c", "p", "d", None), ("x", "p", "y", None), ("d", "p", "z", 7)], "source string, predicate string, target string, superseded_by long")
    seeds = spark.createDataFrame([("a",), ("x",)], "id string")
    assert {(r.id, r.depth) for r in graph.traverse(e, seeds, 2).collect()} == {("a", 0), ("x", 0), ("b", 1), ("c", 1), ("y", 1), ("d", 2)}
    assert {r.id for r in graph.traverse(e, seeds, 0).collect()} == {"a", "x"}
    assert "z" in {r.id for r in graph.traverse(e, seeds, 5, superseded=True).collect()}
    assert graph.traverse(e, seeds.limit(0), 2).count() == 0
    assert graph.neighbours(e, seeds).count() == 3


def test_supersession_forms(spark):
    facts = [(1, "s", "p", "old", "f", 1), (2, "s", "p", "new", "f", 2), (3, "s", "p", "new", "g", 1), (4, "s", "q", "old", None, 1), (5, "s", "p", "old", "f", 3), (6, "t", "p", "same", "f", 1), (7, "t", "p", "same", "f", 2)]
    df = spark.createDataFrame(facts, "id long, subject string, predicate string, object string, path string, version long")
    assert {(r.id, r.superseded_by) for r in graph.superseded_by(df).collect()} == {(1, 2), (2, 5)}
    got = {(r.subject, r.predicate, r.object): r.superseded_by_object for r in graph.replayed_supersession(df.withColumnRenamed("id", "ord")).collect()}
    assert got == {("s", "p", "old"): "new", ("s", "p", "new"): "old", ("s", "q", "old"): None, ("t", "p", "same"): None}


def test_resolution_and_nearest(spark):
    rows = [(1, "Ada", "P", [1.0, 0.0]), (2, " ada ", "Q", [0.0, 1.0]), (3, "Adah", "P", [0.99, 0.1]), (4, "Bob", "P", [0.0, 1.0]), (5, "Cyd", "P", None)]
    df = spark.createDataFrame(rows, "ord long, name string, type string, embedding array<double>")
    assert {(r.ord, r.leader_ord) for r in graph.resolve(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    e = df.selectExpr("ord AS id", "type", "embedding")
    q = spark.createDataFrame([(9, "P", [1.0, 0.05]), (10, "Q", [1.0, 0.0])], "query_id long, type string, embedding array<double>")
    assert [(r.query_id, r.id) for r in graph.nearest(q, e).collect()] == [(9, 3)] or [(r.query_id, r.id) for r in graph.nearest(q, e).collect()] == [(9, 1)]
    a = spark.createDataFrame([("ADA", 1)], "alias string, entity_id long")
    assert [r.entity_id for r in graph.by_alias(df.select("name", "ord"), a).orderBy("ord").collect()] == [1, 1, None, None, None]


def test_numbers_and_upserts(spark):
    r = random.Random(1)
    rows = list({r.randrange(10**6) for _ in range(3000)})
    got = numbered(spark.createDataFrame([(x,) for x in rows], "x long").repartition(5), __import__("pyspark").sql.functions.col("x")).collect()
    assert [x.x for x in sorted(got, key=lambda v: v.id)] == sorted(rows) and sorted(x.id for x in got) == list(range(1, len(rows) + 1))
    old = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t2")], "k int, v string, t string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "t3")], "k int, v string, t string")
    assert {tuple(x) for x in upserted(old, new, ["k"], keep_old_if_null=["t"]).collect()} == {(1, "a", "t1"), (2, "c", "t2"), (3, "d", "t3")}


def test_running_sums(spark):
    from pyspark.sql import functions as F

    from lorewell.tables import running

    r = random.Random(2)
    rows = [(k, r.random(), r.randrange(50)) for k in range(400)]
    got = {x.k: (x.a, x.b) for x in running(spark.createDataFrame(rows, "k int, v double, n int").repartition(7), F.col("v"), a="v", b="n").collect()}
    a = b = 0.0
    for k, v, n in sorted(rows, key=lambda x: x[1]):
        assert abs(got[k][0] - a) < 1e-9 and got[k][1] == b
        a, b = a + v, b + n


def test_prompt_context():
    assert graph.prompt_context([], []) == "本地记忆库中没有找到相关背景信息。"
    assert graph.prompt_context([("a", "p", "b")], ["d1", "d2"], 1).split("\n") == ["【知识拓扑】", "[a] --(p)--> [b]", "", "【上下文溯源】", "- d1"]


def test_nearest_takes_norms_once_for_each_vector(spark):
    q = spark.createDataFrame([(1, 0, [3.0, 4.0]), (2, 0, [0.0, 0.0])], "query_id long, type int, embedding array<double>")
    e = spark.createDataFrame([(1, 0, [3.0, 4.0]), (7, 0, [6.0, 8.0]), (5, 0, [4.0, 3.0]), (6, 0, [1.0]), (8, 0, None)], "id long, type int, embedding array<double>")
    found = graph.nearest(q, e, 0.1, others=True)
    assert [tuple(r) for r in found.collect()] == [(1, 7, 1.0)]
    assert "SQRT" not in found._jdf.queryExecution().executedPlan().toString().upper()
