import pytest
from pyspark.sql import functions as F

from lorewell.operators import distill
from lorewell.operators import lifecycle as L

TRACES = [
    ("message", "user", "Always run the tests", "explicit_decision_or_rule", "preference"), ("message", "assistant", "Always run the tests", "weak_context_only", "preference"),
    ("message", "assistant", "The migration failed; then verify it", "failure_fix_or_procedure", "procedure"), ("event", "bash", "step: verify schema, error", "weak_context_only", "procedure"),
    ("message", "assistant", "hello there", "weak_context_only", "context"), ("message", "assistant", "fact: storage is sqlite", "declared_durable_fact", "fact"),
    ("message", "assistant", "plan: new architecture", "declared_durable_plan", "plan"), ("event", "x", "plan: new architecture", "weak_context_only", "plan"), ("message", "assistant", "更正：使用新的", "explicit_decision_or_rule", "decision"),
    ("message", "assistant", "error was unresolved", "weak_context_only", "context"), ("message", "assistant", "error resolved", "failure_fix_or_procedure", "learning"), ("message", "assistant", None, "weak_context_only", "context"),
]


def test_triage(spark):
    df = spark.createDataFrame([(i, k, r, t) for i, (k, r, t, *_) in enumerate(TRACES)], "i int, trace_kind string, role string, text string")
    for r in L.triage(df).collect():
        assert (r.reason, r.unit_type) == TRACES[r.i][3:], TRACES[r.i]
        assert r.should_extract == (r.reason != "weak_context_only") and len(r.labels) > 0
    assert all(r.reason == "manual_intent" and r.importance == 0.9 for r in L.triage(df, manual=True).collect())


UNIT = "id long, project string, unit_type string, status string, title string, content string, context string, importance double, confidence double, labels array<string>, sources array<struct<source_kind:string,source_ref:string,quote:string>>, valid_to string, why string"


def unit(i, content, kind="fact", status="active_unit", title=None, sources=None, labels=("cli",), valid_to=None, project="p", conf=0.6, imp=0.6):
    src = [("history_message", f"s{i}:msg:1", content)] if sources is None else sources
    return (i, project, kind, status, title or f"title number {i}", content, "", imp, conf, list(labels), src, valid_to, None)


def test_consolidation_precedence(spark):
    rows = [
        unit(1, "prefer sqlite storage backend for everything"), unit(2, "prefer postgres storage backend rather than sqlite for everything"),  # conflict
        unit(3, "maybe retry network calls three times", "plan"), unit(4, "retry network calls five times", "decision"),  # superseded
        unit(5, "the deployment window closed yesterday evening", valid_to="2024-01-01T00:00:00Z"), unit(6, "the quarterly goals horizon ended already", "plan", valid_to="2024-01-01"),
        unit(7, "verify backups after failure every monday morning", "procedure"), unit(8, "owner confirmed naming scheme for branches"), unit(9, "yes ok", title="some long title here"),
        unit(10, "nothing holds this statement upright anywhere", sources=[]), unit(11, "calm waters reveal honest reflections", "learning", "crystal_candidate"),
    ]
    u = spark.createDataFrame(rows, UNIT)
    n = spark.createDataFrame([(i, 1) for i in range(1, 12)], "unit_id long, n_sources int")
    got = {r.id: (r.action, r.superseded_by) for r in L.consolidation(u, n, F.lit("2024-06-01").cast("timestamp")).collect()}
    assert got == {1: ("conflict", None), 2: ("conflict", None), 3: ("supersede", 4), 5: ("archive", None), 6: ("review", None), 7: ("candidate", None), 8: ("promote", None), 10: ("reject", None), 11: ("demote", None)} | ({9: got[9]} if 9 in got else {})
    low = spark.createDataFrame([(3, 0.2), (7, 0.9)], "id long, score double")
    kept = {r.id for r in L.consolidation(u, n, F.lit("2024-06-01").cast("timestamp"), low).collect()}
    assert 3 not in kept and 7 in kept


def test_transitions_are_all_or_nothing(spark):
    u = spark.createDataFrame([(1, "active_unit"), (2, "active_unit")], "id long, status string")
    w = lambda *rows: spark.createDataFrame(list(rows), "id long, to_status string, superseded_by long")
    assert {tuple(r) for r in L.transitions(u, w((1, "superseded", 2)))[0].collect()} == {(1, "superseded", 2), (2, "active_unit", None)}
    for bad in ((3, "archived", None), (1, "superseded", 9), (1, "superseded", 1)):
        with pytest.raises(ValueError):
            L.transitions(u, w(bad))
    log = spark.createDataFrame([(1, 1, "crystal", "archived"), (2, 1, "archived", "crystal"), (3, 1, "active_unit", "archived")], "log_id long, id long, from_status string, to_status string")
    gone = spark.createDataFrame([(1, "archived"), (5, "archived")], "id long, status string")
    assert {tuple(r) for r in L.restored(gone, log).collect()} == {(1, "active_unit"), (5, "active_unit")}


def test_sources_units_and_sections(spark):
    s = spark.createDataFrame([(1, "history_message", "k:s1:msg:1"), (1, "history_event", "k:s1:evt:2"), (1, "document", "d"), (2, "history_message", "k:s2:msg:1")], "unit_id long, source_kind string, source_ref string")
    assert {tuple(r) for r in L.independent_sources(s).collect()} == {(1, 2), (2, 1)}
    u = spark.createDataFrame([unit(1, "a durable statement", labels=("security",)), unit(2, "another statement", "decision"), unit(3, "third statement", "procedure"), unit(4, "fourth", "learning"), unit(5, "fifth", "event")], UNIT)
    assert [r.s for r in u.orderBy("id").select(L.export_section().alias("s")).collect()] == ["Gotchas", "Architecture decisions", "Rules / Conventions", "Discovered durable knowledge", "Other"]


def test_distill(spark):
    rows = [unit(1, "verify migrations before release", "procedure", title="verify migrations"), unit(2, "verify migrations after release", "procedure", title="verify migrations again"), unit(3, "unrelated musing about weather", "learning")]
    u = spark.createDataFrame(rows, UNIT).withColumn("recall_count", F.lit(2))
    s = u.select(F.col("id").alias("unit_id"), F.explode("sources").alias("s")).select("unit_id", "s.source_kind", "s.source_ref")
    assets = spark.createDataFrame([("script", "verify-migrations", "scripts/verify-migrations.sh")], "form string, name string, path string")
    (r,) = distill.candidates(u, s, assets).collect()
    assert (r.root, r.n_units, r.evidence, r.recalls, r.recommended_form, list(r.members), r.covered_by) == (1, 2, 2, 4, "script", [1, 2], "scripts/verify-migrations.sh")


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    import random

    from lorewell.operators import blocks

    monkeypatch.setattr(blocks, "LEAST", 7)
    rng = random.Random(3)
    rows = [(i * 3, sorted({f"w{i % 20}-{rng.randint(1, 25)}" for _ in range(rng.randint(2, 9))} | {f"any{rng.randint(1, 9)}"})) for i in range(120)] + [(1000 + i, ["same", "words", f"own{i}"]) for i in range(40)] + [(2000, ["alone"])]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in rows:
        for j, t in rows:
            if i < j and len({*s} & {*t}) / min(len(s), len(t)) >= 0.35:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    units = spark.createDataFrame(rows, "id long, tokens array<string>")
    found = distill.links(units)
    assert len({find(i) for i in root}) > 5
    assert {r.id: r.root for r in distill.components(units, found).collect()} == {i: find(i) for i in root}
