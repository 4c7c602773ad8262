import json

import pytest
from pyspark.sql import functions as F

from lorewell.operators import trace
from lorewell.sources import logtail, sessions
from lorewell.streaming import queue


def put(path, *rows, tail=""):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows) + tail, encoding="utf-8")


def read(spark, tmp_path, dialect):
    out = sessions.read(spark, str(tmp_path), dialect).collect()
    return {r.path.rsplit("/", 1)[1]: r for r in out}


def test_native(spark, tmp_path):
    put(tmp_path / "a.jsonl", {"type": "session", "id": "s1", "project": "p", "title": "t", "started_at": "T0"}, {"type": "message", "role": "user", "text": "hi"}, {"type": "message", "role": "user", "text": "hi"},
        {"type": "event", "kind": "odd", "body": "b"}, "", "{garbage", "[1]", {"type": "event", "kind": "tool_call", "call_id": "c9", "created_at": "T5"}, tail='{"type": "message"')
    put(tmp_path / "b.jsonl", {"type": "message", "text": "no header"})
    got = read(spark, tmp_path, "native")
    a = got["a.jsonl"]
    assert a.session.id == "capture:s1" and a.bad_lines == 2 and a.error is None and len(a.messages) == 2
    assert a.messages[1].external_id == a.messages[0].external_id + "~2" and a.messages[0].created_at == "T0" and [m.seq for m in a.messages] == [0, 1]
    assert [(e.kind, e.anchor, e.ordinal) for e in a.events] == [("other", a.messages[1].external_id + "#0", 0), ("tool_call", "c9", 1)] and a.events[1].created_at == "T5"
    assert got["b.jsonl"].error and got["b.jsonl"].session is None
    t = sessions.tables(sessions.read(spark, str(tmp_path), "native"))
    assert (t["sessions"].count(), t["messages"].count(), t["events"].count()) == (1, 2, 2)


def test_rollout(spark, tmp_path):
    item = lambda **p: {"timestamp": "T2", "type": "response_item", "payload": p}
    put(tmp_path / "r.jsonl", {"timestamp": "T1", "type": "session_meta", "payload": {"id": "x", "cwd": "/w/proj"}}, item(type="message", role="user", content=[{"type": "input_text", "text": "a"}, {"type": "text", "text": "b"}]),
        item(type="function_call", name="sh", arguments="{}", call_id="k1"), item(type="function_call_output", output="  Error: bad"), item(type="function_call_output", output="fine"), item(type="reasoning"), {"type": "event_msg", "payload": {}})
    r = read(spark, tmp_path, "codex")["r.jsonl"]
    assert (r.session.project, r.session.ended_at, r.messages[0].text) == ("proj", "T2", "a\nb")
    assert [(e.kind, e.anchor.split("#")[-1], e.is_error) for e in r.events] == [("tool_call", "k1", False), ("tool_result", "0", True), ("tool_result", "1", False)]


def test_threaded(spark, tmp_path):
    say = lambda u, p, t, kind, content, **x: {"type": kind, "uuid": u, "parentUuid": p, "timestamp": t, "sessionId": "S", "cwd": "/w/q", "message": {"role": kind, "content": content}} | x
    put(tmp_path / "c.jsonl", say("u2", "u1", "T1", "assistant", [{"type": "text", "text": "yes"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/f"}}]),
        say("u1", None, "T1", "user", "question\nmore"), say("u0", None, "T0", "user", "skip", isMeta=True), say("u3", "u2", "T2", "user", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "out"}], "is_error": True}]),
        {"type": "ai-title", "aiTitle": "first"}, {"type": "ai-title", "aiTitle": "last"}, {"type": "summary"})
    r = read(spark, tmp_path, "claude")["c.jsonl"]
    assert [m.external_id for m in r.messages] == ["u2", "u1", "u3"] or [m.external_id for m in r.messages] == ["u1", "u2", "u3"]
    assert r.session.title == "last" and r.session.started_at == "T0" and r.session.ended_at == "T2"
    assert [(e.kind, e.anchor, e.file_path, e.is_error) for e in r.events if e.kind != "reasoning"] == [("tool_call", "t1", "/f", False), ("tool_result", "t1", None, True)]


def test_conversation_and_registry(spark, tmp_path):
    m = lambda role, text, **x: {"type": "message", "timestamp": "T3", "message": {"role": role, "content": [{"type": "text", "text": text}]}} | x
    put(tmp_path / "p.jsonl", {"type": "session", "id": "z", "cwd": "/a/b", "timestamp": "T1"}, m("user", "hello", id="i1"), m("assistant", "  "), m("tool", "no"), m("assistant", "there"))
    r = read(spark, tmp_path, "pi")["p.jsonl"]
    assert [(x.external_id, x.text) for x in r.messages] == [("i1", "hello"), ("seq-1", "there")]
    with pytest.raises(ValueError):
        sessions.importer("nope")
    state = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "path string, mtime long, size long")
    files = spark.createDataFrame([("a", 1, 10), ("b", 2, 25), ("c", 3, 5)], "path string, mtime long, size long")
    assert {x.path for x in sessions.changed(files, state).collect()} == {"b", "c"}
    assert sessions.encoded_cwd("/home/me/x") == "-home-me-x"


def test_tail_resumes_and_waits_for_whole_lines(spark, tmp_path):
    logtail.register(spark)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text('{"n": 1}\n{"n": 2}\n{"n"')

    def run():
        s = spark.readStream.format("jsonl_tail").option("path", f"{logs}/*.jsonl").load()
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(r.line for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == ['{"n": 1}', '{"n": 2}']
    with (logs / "a.jsonl").open("a") as f:
        f.write(': 3}\n')
    assert run() == ['{"n": 1}', '{"n": 2}', '{"n": 3}']


def test_queue_drains_and_keeps_failures(spark, tmp_path):
    spark.createDataFrame([(i, "bad" if i % 3 == 0 else "ok") for i in range(9)], "id long, content string").write.parquet(f"{tmp_path}/q")
    items = spark.readStream.schema("id long, content string").parquet(f"{tmp_path}/q")
    queue.drain(items, lambda df: df.select("id", F.when(F.col("content") == "bad", "broken").alias("error")), f"{tmp_path}/log", f"{tmp_path}/cp")
    first = spark.createDataFrame([(i, 0, "pending", None) for i in range(10)], "id long, seq long, status string, error string")
    state = queue.latest(first.unionByName(spark.read.parquet(f"{tmp_path}/log")))
    assert {r.status: r.n for r in queue.counts(state).collect()} == {"pending": 1, "processing": 0, "done": 6, "failed": 3}
    assert {r.id for r in queue.retryable(state).collect()} == {0, 3, 6} and queue.retryable(state, 1).count() == 0
    assert [r.id for r in queue.recent_failures(state, 2).collect()] == [6, 3] and queue.pending(state).count() == 1


def test_trace_filters(spark):
    e = spark.createDataFrame([(1, "s", "tool_result", "sh", True, "boom", "2024-01-02", "src/a.py"), (2, "s", "tool_result", "sh", False, "fine", None, "src"), (3, "s", "other", None, True, "x", "2024-01-03", "srcs/b")], "id long, session_id string, kind string, tool_name string, is_error boolean, body string, created_at string, file_path string")
    ids = lambda **f: [r.id for r in trace.recent(e, 9, **f).collect()]
    assert ids() == [3, 1, 2] and ids(kind="tool_error") == [1] and ids(path="src/") == [1, 2] and ids(since="2024-01-03") == [3]
    m = spark.createDataFrame([("s", i, "r", f"t{i}") for i in range(10)], "session_id string, seq long, role string, text string")
    c = spark.createDataFrame([("s", 0), ("s", 5)], "session_id string, seq long")
    assert sorted((r.center_seq, r.seq) for r in trace.around(m, c, 1).collect()) == [(0, 0), (0, 1), (5, 4), (5, 5), (5, 6)]
    s = trace.storable(spark.createDataFrame([("password=abcdefghij",)], "text string"), "text", 12).first()
    assert (s.text, s.text_truncated) == ("password=[RE", True)
