import json

import pytest

from lorewell.operators import evaluate, ingest
from lorewell.sources import assets


def test_files_sections_and_versions(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("intro\n\n## One\nbody\n\n## Two\nmore", encoding="utf-8")
    rows = ingest.sections(ingest.read_files(spark, str(tmp_path)))
    got = ingest.versions(rows).orderBy("version").collect()
    assert [(r.section, r.content, r.version, r.project) for r in got] == [(None, "intro", 1, "notes"), ("One", "body", 2, "notes"), ("Two", "more", 3, "notes")]
    known = spark.createDataFrame([(got[0].path, 7)], "path string, version long")
    assert [r.version for r in ingest.versions(rows, known, by="ingest").collect()] == [8, 8, 8]


def test_graphs(spark):
    g = {"entities": [{"name": "A", "type": "X", "description": "1"}, {"name": "A", "type": "Y", "description": "2"}], "relations": [{"source": "A", "target": "B", "predicate": "Used"}], "units": [{"unit_type": "fact", "title": "t", "content": "c"}]}
    df = spark.createDataFrame([(1, json.dumps(g)), (2, "not json")], "doc_id long, json string")
    t = ingest.graph_tables(ingest.parsed_graphs(df))
    assert {(r.name, r.type, r.description) for r in t["entities"].collect()} == {("A", "Y", "2"), ("B", "Unknown", "")}
    assert [(r.predicate, r.text) for r in t["relations"].collect()] == [("uses", "A uses B")]
    (u,) = t["units"].collect()
    assert (u.status, u.importance, u.sources[0].source_message_id) == ("active_unit", 0.5, "unit:0:t")


def test_upserts_and_bookkeeping(spark):
    old = spark.createDataFrame([("a", "b", "p", [1.0]), ("a", "c", "p", None)], "source string, target string, predicate string, embedding array<double>")
    new = spark.createDataFrame([("a", "b", "p", [2.0]), ("a", "c", "p", [3.0]), ("x", "y", "p", None)], "source string, target string, predicate string, embedding array<double>")
    assert {(r.target, None if r.embedding is None else tuple(r.embedding)) for r in ingest.relations_upserted(old, new).collect()} == {("b", (1.0,)), ("c", (3.0,)), ("y", None)}
    e = spark.createDataFrame([(1, "abc"), (2, None)], "id long, description string")
    d = spark.createDataFrame([(1, 1, "xy"), (2, 1, "one"), (2, 2, "two")], "id long, ord int, description string")
    assert {tuple(r) for r in ingest.longer_descriptions(e, d).collect()} == {(1, "abc"), (2, "one")}
    u = spark.createDataFrame([(1, 0.6, 0, None), (2, 0.6, 4, "x")], "id long, confidence double, recall_count int, last_recalled_at string")
    s = spark.createDataFrame([(1, "history_message", "k:a:msg:1")], "unit_id long, source_kind string, source_ref string")
    n = spark.createDataFrame([(1, "history_message", "k:a:msg:2"), (1, "history_message", "k:b:msg:1")], "unit_id long, source_kind string, source_ref string")
    assert {r.id: round(r.confidence, 2) for r in ingest.attached(u, s, n).collect()} == {1: 0.65, 2: 0.6}
    assert {(r.id, r.recall_count, r.last_recalled_at) for r in ingest.recalled(u, u.where("id = 1"), "now").collect()} == {(1, 1, "now"), (2, 4, "x")}


def test_extractor_failures_are_rows(spark):
    docs = spark.createDataFrame([(1, "fine"), (2, "bad")], "id long, content string")

    def extract(t):
        if t == "bad":
            raise RuntimeError("no")
        return {"entities": [{"name": t, "type": "T", "description": ""}]}

    tables, failed = ingest.ingested(docs, extract)
    assert [r.name for r in tables["entities"].collect()] == ["fine"] and [r.id for r in failed.collect()] == [2]
    with pytest.raises(ValueError):
        ingest.prompt("poem", "x")


def test_evaluation(spark):
    a = spark.createDataFrame([("s", ["Foo"], "a foo", 10), ("s", ["bar"], "no", 20), ("m", ["x", "y"], "XY", 30)], "category string, expected_keywords array<string>, output string, tokens int")
    assert {(r.category, r.n, r.hits) for r in evaluate.keyword_hits(a).collect()} == {("s", 2, 1), ("m", 1, 1), ("all", 3, 2)}
    g = spark.createDataFrame([(True, True, "f", "f", "t"), (True, False, "f", "p", "T"), (False, True, "f", "f", "u")], "predicted boolean, gold boolean, predicted_type string, gold_type string, title string")
    assert tuple(evaluate.gate_metrics(g).first()) == (0.5, 0.5, 1.0, 0.5)
    c = spark.createDataFrame([(0.9, True), (0.2, True)], "score double, human_keeps boolean")
    assert tuple(evaluate.agreement(c).first()) == (2, 0.5)
    gold = spark.createDataFrame([(1, ["a.md"]), (2, ["a.md", "z.md"])], "id int, source array<string>")
    assert [r.id for r in evaluate.answerable(gold, ["a.md", "b.md"]).collect()] == [1]


def test_assets_and_payloads(tmp_path):
    for p in ("scripts/run.sh", "commands/do.md", "skills/fly/SKILL.md", "docs/rules.md", "scripts/skip.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / "Makefile").write_text("build: x\n\tcc\n.PHONY: build\n")
    assert assets.inventory(str(tmp_path)) == [("command", "do", "commands/do.md"), ("convention_doc", "rules", "docs/rules.md"), ("script", "build", "Makefile:build"), ("script", "run", "scripts/run.sh"), ("skill_file", "fly", "skills/fly/SKILL.md")]
    log = tmp_path / "pi" / "d1"
    log.mkdir(parents=True)
    (log / "s.jsonl").write_text('{"type": "session", "id": "z", "cwd": "/w"}\n{"type": "message", "id": "m1", "message": {"role": "user", "content": "hi"}}\n')
    assert assets.sessions_of("/w", str(tmp_path / "pi"), "pi") == [str(log / "s.jsonl")] and assets.sessions_of("/q", str(tmp_path / "pi"), "pi") == []
    row, note = assets.payload(str(log / "s.jsonl"), "pi", "pi-jsonl:z:msg:m1")
    assert row["text"] == "hi" and not note and assets.payload("/nope", "pi", "x")[0] is None
