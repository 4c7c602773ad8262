"""Session logs in four JSONL dialects as tables of sessions, messages and events.

A file is one session and its lines depend on those before, so each file is
folded by one task; files are spread over the cluster. A dialect is a function
from the file's records to rows; registry names map to them.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = "id string, external_id string, project string, title string, started_at string, ended_at string, source_kind string, source_ref string"
MESSAGE = "id string, session_id string, external_id string, role string, agent_id string, parent_id string, seq long, text string, created_at string"
EVENT = "id string, session_id string, message_id string, message_external_id string, anchor string, kind string, tool_name string, file_path string, ordinal long, body string, is_error boolean, created_at string"
PARSED = f"path string, bad_lines long, error string, session struct<{SESSION.replace(' string', ':string')}>, messages array<struct<{MESSAGE.replace(' string', ':string').replace(' long', ':bigint')}>>, events array<struct<{EVENT.replace(' string', ':string').replace(' long', ':bigint').replace(' boolean', ':boolean')}>>"
EVENT_KINDS = ("tool_call", "tool_result", "reasoning", "other")


def records(data: bytes, offset: int = 0) -> tuple[list[dict], int, int]:
    """(objects, offset after the last whole line, bad lines): blank lines are skipped, a last line without its end waits."""
    end = data.rfind(b"\n") + 1
    found, bad = [], 0
    for line in data[offset:end].split(b"\n"):
        if not line.strip():
            continue
        try:
            value = json.loads(line)
        except ValueError:
            value = None
        if isinstance(value, dict):
            found.append(value)
        else:
            bad += 1
    return found, max(end, offset), bad


def text_or_none(value: object) -> str | None:
    return value if isinstance(value, str) else None


@dataclass
class Log:
    """Rows of one session as they are read."""

    path: str
    kind: str = ""
    external: str = ""
    session: dict | None = None
    messages: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    ids: set[str] = field(default_factory=set)
    ordinals: Counter = field(default_factory=Counter)

    def begin(self, kind: str, external: str, project: str, title: str, started: str | None, ended: str | None = None) -> None:
        self.kind, self.external = kind, external
        self.session = {"id": f"{kind}:{external}", "external_id": external, "project": project, "title": title, "started_at": started, "ended_at": ended, "source_kind": kind, "source_ref": self.path}

    def made_id(self, role: str, stamp: object, text: str) -> str:
        """Digest of role, time and the text's head; ``~2``, ``~3`` and so on if it is taken."""
        digest = hashlib.sha256(f"{role}\x00{stamp}\x00{text[:256]}".encode()).hexdigest()[:16]
        n, own = 1, digest
        while own in self.ids:
            n += 1
            own = f"{digest}~{n}"
        return own

    def message(self, external: str, role: str, text: str, stamp: str | None, parent: str | None = None, agent: str = "") -> str:
        self.ids.add(external)
        own = f"{self.kind}:{self.external}:msg:{external}"
        self.messages.append({"id": own, "session_id": self.session["id"], "external_id": external, "role": role, "agent_id": agent, "parent_id": parent, "seq": len(self.messages), "text": text, "created_at": stamp})
        return own

    def event(self, anchor: str, kind: str, body: str, stamp: str | None, message: str = "", tool: str | None = None, file: str | None = None, ordinal: int = 0, error: bool = False) -> None:
        self.events.append({
            "id": f"{self.kind}:{self.external}:evt:{anchor}:{kind}", "session_id": self.session["id"], "message_id": f"{self.kind}:{self.external}:msg:{message}" if message else None, "message_external_id": message,
            "anchor": anchor, "kind": kind, "tool_name": tool, "file_path": file, "ordinal": ordinal, "body": body, "is_error": error, "created_at": stamp,
        })

    def next_of(self, *key: str) -> int:
        self.ordinals[key] += 1
        return self.ordinals[key] - 1


def blocks_text(content: object) -> str:
    """The text blocks of a message, one per line."""
    if isinstance(content, str):
        return content
    parts = [b["text"] for b in content if isinstance(b, dict) and b.get("type") in ("text", "input_text", "output_text") and isinstance(b.get("text"), str)] if isinstance(content, list) else []
    return "\n".join(parts)


def flat(content: object) -> str:
    """A tool's result as text; blocks without text as JSON."""
    if content is None or isinstance(content, str):
        return content or ""
    if not isinstance(content, list):
        return str(content)
    return "\n".join(b["text"] if isinstance(b, dict) and isinstance(b.get("text"), str) else json.dumps(b, ensure_ascii=False) if isinstance(b, dict) else str(b) for b in content)


def native(log: Log, rows: Iterable[dict]) -> None:
    """The library's own format: a session line, then messages and events."""
    last, last_stamp = "", None
    for r in rows:
        kind = r.get("type")
        if kind == "session":
            log.begin(str(r.get("source_kind", "capture")), str(r.get("id", PurePosixPath(log.path).stem)), str(r.get("project", "")), str(r.get("title", "")), text_or_none(r.get("started_at")), text_or_none(r.get("ended_at")))
        elif log.session is None:
            raise ValueError("the first record must be a session")
        elif kind == "message":
            role, text = str(r.get("role", "")), str(r.get("text", ""))
            last = str(r["id"]) if r.get("id") is not None else log.made_id(role, r.get("created_at"), text)
            last_stamp = text_or_none(r.get("created_at")) or log.session["started_at"]
            parent = f"{log.kind}:{log.external}:msg:{r['parent_id']}" if r.get("parent_id") else None
            log.message(last, role, text, last_stamp, parent, str(r.get("agent_id", "")))
        elif kind == "event":
            of = str(r.get("message_id") or last)
            n = log.next_of(of)
            what = r.get("kind") if r.get("kind") in EVENT_KINDS else "other"
            stamp = text_or_none(r.get("created_at")) or last_stamp or log.session["started_at"]
            log.event(str(r.get("call_id") or f"{of}#{n}"), what, str(r.get("body", "")), stamp, of, text_or_none(r.get("tool_name")), text_or_none(r.get("file_path")), n, bool(r.get("is_error", False)))


def rollout(log: Log, rows: Iterable[dict]) -> None:
    """Codex logs: session_meta, then response items; reasoning and other records are passed over."""
    last, stamp = "", None
    for r in rows:
        own, p = text_or_none(r.get("timestamp")), r.get("payload")
        stamp = own or stamp
        if not isinstance(p, dict):
            continue
        if r.get("type") == "session_meta":
            cwd = text_or_none(p.get("cwd")) or ""
            stem = PurePosixPath(log.path).stem
            log.begin("codex-jsonl", str(p.get("id") or stem), PurePosixPath(cwd).name, cwd or stem, text_or_none(p.get("timestamp")) or own)
        elif log.session is not None and r.get("type") == "response_item":
            kind = p.get("type")
            if kind == "message":
                role, text = str(p.get("role", "")), blocks_text(p.get("content"))
                last = log.made_id(role, own, text)
                log.message(last, role, text, own)
            elif kind in ("function_call", "function_call_output"):
                call = kind == "function_call"
                what, anchor, n = "tool_call" if call else "tool_result", text_or_none(p.get("call_id")), 0
                if anchor is None:
                    n = log.next_of(last, what)
                    anchor = f"{last}#{n}"
                out = p.get("arguments", "") if call else p.get("output")
                body = out if isinstance(out, str) else str(out or "")
                log.event(anchor, what, body, own, last, text_or_none(p.get("name")) if call else None, None, n, not call and body[:200].lstrip().startswith(("Error", "error:", '{"error')))
    if log.session and stamp and log.session["ended_at"] is None:
        log.session["ended_at"] = stamp


def threaded(log: Log, rows: Iterable[dict]) -> None:
    """Claude logs: lines in order of time, then depth in the chain of parents, then place in the file."""
    title, chats, depth = None, [], {}
    for r in rows:
        if r.get("type") in ("user", "assistant", "system"):
            chats.append(r)
            own, parent = text_or_none(r.get("uuid")), text_or_none(r.get("parentUuid"))
            if own is not None:
                depth[own] = depth.get(parent, 0) + 1 if parent else 0
        elif r.get("type") == "ai-title":
            title = text_or_none(r.get("aiTitle")) or title
    chats.sort(key=lambda r: (text_or_none(r.get("timestamp")) or "", depth.get(text_or_none(r.get("uuid")) or "", 0)))
    stamps = [t for r in chats if (t := text_or_none(r.get("timestamp"))) is not None]
    external = next((s for r in chats if (s := text_or_none(r.get("sessionId")))), None)
    if not chats or external is None:
        raise ValueError("no chat lines with a session id")
    cwd = next((c for r in chats if (c := text_or_none(r.get("cwd")))), "")
    log.begin("claude-jsonl", external, PurePosixPath(cwd).name, "", stamps[0] if stamps else None, stamps[-1] if stamps else None)
    snippet = ""
    for r in chats:
        kind, own, stamp = r["type"], text_or_none(r.get("uuid")) or "", text_or_none(r.get("timestamp"))
        if kind == "user" and r.get("isMeta") is True:
            continue
        body = r if kind == "system" else r.get("message")
        if not isinstance(body, dict):
            continue
        content = body.get("content", "")
        text = blocks_text(content)
        if kind == "user" and not snippet and text.strip():
            snippet = text.strip().splitlines()[0][:200]
        if own:
            log.message(own, kind, text, stamp, text_or_none(r.get("parentUuid")) or None)
        for n, b in enumerate(content if isinstance(content, list) else []):
            if not isinstance(b, dict):
                continue
            if kind == "assistant" and b.get("type") == "tool_use":
                tool, given = text_or_none(b.get("name")), b.get("input")
                file = text_or_none(given.get("file_path")) if tool in ("Read", "Edit", "Write") and isinstance(given, dict) else None
                if anchor := text_or_none(b.get("id")):
                    log.event(anchor, "tool_call", json.dumps(given, ensure_ascii=False), stamp, own, tool, file)
            elif kind == "assistant" and b.get("type") == "thinking":
                log.event(f"{own}#{n}", "reasoning", str(b.get("thinking", "")), stamp, own, None, None, n)
            elif kind == "user" and b.get("type") == "tool_result" and (anchor := text_or_none(b.get("tool_use_id"))):
                log.event(anchor, "tool_result", flat(b.get("content")), stamp, own, error=bool(b.get("is_error")))
    log.session["title"] = title or snippet or external


def conversation(log: Log, rows: Iterable[dict]) -> None:
    """Pi logs: the text of users and assistants only."""
    stamp = None
    for r in rows:
        own = text_or_none(r.get("timestamp"))
        stamp = own or stamp
        if r.get("type") == "session":
            cwd, stem = text_or_none(r.get("cwd")) or "", PurePosixPath(log.path).stem
            log.begin("pi-jsonl", str(r.get("id") or stem), PurePosixPath(cwd).name, cwd or stem, own)
        elif log.session is not None and r.get("type") == "message" and isinstance(m := r.get("message"), dict) and m.get("role") in ("user", "assistant"):
            text = blocks_text(m.get("content", []))
            if text.strip():
                log.message(str(r["id"]) if r.get("id") else f"seq-{len(log.messages)}", m["role"], text, text_or_none(m.get("timestamp")) or own)
    if log.session and stamp and log.session["ended_at"] is None:
        log.session["ended_at"] = stamp


DIALECTS: dict[str, Callable[[Log, Iterable[dict]], None]] = {"native": native, "codex": rollout, "claude": threaded, "pi": conversation}


def importer(name: str) -> Callable[[Log, Iterable[dict]], None]:
    if name not in DIALECTS:
        raise ValueError(f"unknown session format {name!r}; there are {', '.join(DIALECTS)}")
    return DIALECTS[name]


def parsed(path: str, data: bytes, dialect: str, project: str | None = None) -> dict:
    """One file's rows; an unusable file has an error and no rows."""
    found, _, bad = records(data)
    log, error = Log(path), None
    try:
        importer(dialect)(log, found)
        if log.session is None:
            raise ValueError("no session record")
    except ValueError as e:
        log, error = Log(path), str(e)
    if log.session and project:
        log.session["project"] = project
    return {"path": path, "bad_lines": bad, "error": error, "session": log.session, "messages": log.messages, "events": log.events}


def read(spark: SparkSession, paths: str | list[str], dialect: str, project: str | None = None) -> DataFrame:
    """path, bad_lines, error, session, messages, events of each file that matches."""
    importer(dialect)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(paths).select("path", "content")

    def run(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [parsed(p, c, dialect, project) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["path", "bad_lines", "error", "session", "messages", "events"])

    return files.mapInPandas(run, PARSED)


def tables(parsed_files: DataFrame) -> dict[str, DataFrame]:
    """sessions, messages and events as tables."""
    good = parsed_files.where("session IS NOT NULL")
    return {"sessions": good.select("session.*"), "messages": good.select(F.explode("messages").alias("m")).select("m.*"), "events": good.select(F.explode("events").alias("e")).select("e.*")}


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, mtime, size) that aren't as in state (path, mtime, size)."""
    s = state.select("path", F.col("mtime").alias("s_mtime"), F.col("size").alias("s_size"))
    return files.join(s, "path", "left").where("NOT (mtime <=> s_mtime AND size <=> s_size)").drop("s_mtime", "s_size")


def encoded_cwd(cwd: str) -> str:
    """The folder name under which logs of a working directory are kept."""
    return cwd.rstrip("/").replace("/", "-")
