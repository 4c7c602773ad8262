import json

import pytest

from lorewell.memory import Memory, main


def test_from_files_and_logs_to_answers(spark, tmp_path, capsys):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("## Storage\nWe keep the ledger in sqlite.\n\n## Retrieval\nRanking uses bm25 scores.", encoding="utf-8")
    (tmp_path / "logs").mkdir()
    rows = [{"type": "session", "id": "s1", "project": "notes", "started_at": "2024-01-01"}, {"type": "message", "id": "m1", "role": "user", "text": "Decision: always keep the ledger schema small. token=abcdefghijkl"},
            {"type": "message", "id": "m2", "role": "user", "text": "hello"}, {"type": "event", "kind": "tool_result", "body": "all fine", "is_error": False}]
    (tmp_path / "logs" / "x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    m = Memory(spark, str(tmp_path / "root"))
    assert "0/0 chunks" in m.query("ledger")
    assert m.ingest_files(str(tmp_path / "notes")) == 2
    for n in (1, 0):  # the same again is skipped and changes nothing
        assert m.pull(str(tmp_path / "logs"), "native") == {"sessions": n, "messages": 2 * n, "events": n, "bad_lines": 0}
        assert m.table("messages").count() == 2
    assert "[REDACTED]" in m.table("messages").where("external_id = 'm1'").first().text
    assert m.checkpoint().count() == 1
    assert m.checkpoint().count() == 0 and m.table("units").count() == 1
    text = m.query("where is the ledger kept?")
    assert "Memories" in text and "sqlite" in text and "1/1 memories" in text
    assert m.history("ledger").count() == 1
    assert m.consolidate("2024-06-01").count() <= 1
    assert "ledger schema" in m.export()
    with pytest.raises(ValueError):
        m.set_status(99, "retracted")
    assert main(["--root", str(tmp_path / "root"), "retract", "1"], lambda: spark) == 0
    assert m.export() == "" and m.table("units").first().status == "retracted"
    assert main(["--root", str(tmp_path / "root"), "query", "ledger"], lambda: spark) == 0
    assert "chunks)" in capsys.readouterr().out


def test_a_graph_is_taken_and_asked(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "root"))

    def embed(texts):
        return [[1.0, 0.0] if "grace" in t.lower() else [0.0, 1.0] if "queue" in t.lower() else [0.8, -0.6] if "rome" in t.lower() else [0.6, 0.8] for t in texts]

    first = {"entities": [{"name": "Grace", "type": "Person", "description": "engineer"}, {"name": "Queue", "type": "Tool", "description": ""}], "relations": [{"source": "Grace", "target": "Queue", "predicate": "created"}, {"source": "Grace", "target": "Kiel", "predicate": "works at"}],
             "units": [{"unit_type": "fact", "title": "Grace owns the queue", "content": "Grace owns the queue and its retries.", "labels": ["storage"]}]}
    got = m.ingest_graph(json.dumps(first), "p", "notes.md", "Team", "2024-01-02", "Grace created the queue in Kiel.", embed)
    assert got == {"entities": 3, "relations": 2, "units": 1}
    second = {"entities": [{"name": " grace ", "type": "Person", "description": "engineer and author of the queue"}], "relations": [{"source": "grace", "target": "Rome", "predicate": "works at"}], "units": []}
    assert m.ingest_graph(json.dumps(second), "p", "notes.md", None, "2024-02-03", "Grace moved to Rome.", embed) == {"entities": 3, "relations": 1, "units": 0}
    names = {r.canonical_name: r.description for r in m.entities().collect()}
    assert names == {"Grace": "engineer and author of the queue", "Queue": "", "Kiel": "", "Rome": ""}
    rel = {(r.source, r.predicate, r.target): r.superseded_by for r in m.relations().collect()}
    assert rel[("Grace", "develops", "Queue")] is None and rel[("Grace", "works_at", "Rome")] is None and rel[("Grace", "works_at", "Kiel")] is not None
    with pytest.raises(ValueError):
        m.ingest_graph('{"entities": [{"name": " "}]}')
    with pytest.raises(ValueError):
        m.ingest_graph("no json")
    shown = m.query("what did Grace do?", embed=embed)
    assert "Grace: " in shown and "develops Queue" in shown and "works_at Rome" in shown and "Kiel" not in shown.split("Evidence")[0] and "Evidence" in shown and "[p notes.md ## Team 2024-01-02]" in shown
    assert "Kiel" in m.query("what did Grace do?", superseded=True).split("Evidence")[0]
    assert m.attach(1, "manual", "me") is None and m.table("units").first().confidence > 0.7
    m.query("queue retries", as_of="2024-06-01")
    assert m.table("units").first().recall_count == 1


def test_queue_of_contents(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "root"))

    def extract(t):
        if "bad" in t:
            raise ValueError("no")
        return {"entities": [{"name": t.split()[0], "type": "Word", "description": ""}], "relations": []}

    assert [m.enqueue("good text", "p"), m.enqueue("bad text", "p", "b.md")] == [1, 2]
    assert "queued documents" in m.query("anything") and m.queue_counts()["pending"] == 2
    assert m.process(extract) == {"pending": 0, "processing": 0, "done": 1, "failed": 1}
    for n in (2, 3, 3):
        m.process(extract, retry=True)
        assert {r.id: r.retries for r in __import__("lorewell.streaming.queue", fromlist=["x"]).latest(m.table("queue")).collect()}[2] == n
    assert {r.canonical_name for r in m.entities().collect()} == {"good"} and m.queue_counts()["failed"] == 1


def test_restore_and_compare_and_set(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "root"))
    unit = {"units": [{"unit_type": "plan", "title": "Plan", "content": "A plan of some length.", "labels": ["cli"]}], "entities": [], "relations": []}
    m.ingest_graph(json.dumps(unit), "p")
    m.set_status(1, "crystal", expected="active_unit")
    with pytest.raises(ValueError):
        m.set_status(1, "archived", expected="active_unit")
    m.set_status(1, "archived", reason="old")
    assert m.restore(1) == "crystal"
    with pytest.raises(ValueError):
        m.restore(1)
    log = [(r.from_status, r.to_status, r.command) for r in m.table("status_log").orderBy("log_id").collect()]
    assert log == [(None, "active_unit", "ingest-graph"), ("active_unit", "crystal", "crystal"), ("crystal", "archived", "archived"), ("archived", "crystal", "crystal")]
