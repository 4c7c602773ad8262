"""Files of a project on the driver: workflow assets, sessions to import, one record's original payload."""

from __future__ import annotations

import json
import re
from pathlib import Path

# Where workflow assets are, and the form each place has.
PLACES = (("script", "scripts", "*"), ("command", "commands", "*.md"), ("convention_doc", "docs", "*.md"), ("skill_file", "skills", "**/SKILL.md"), ("skill_file", "skills", "*.md"))
SUFFIXES = (".md", ".py", ".sh", ".bash", ".zsh", ".just")
TARGET = re.compile(r"^([A-Za-z0-9_.-]+)\s*:(?:\s|$)")


def inventory(root: str) -> list[tuple[str, str, str]]:
    """(form, name, path) of scripts, commands, documents, skills and make targets under root, sorted by form and path."""
    top, out = Path(root), set()
    for form, folder, pattern in PLACES:
        for p in (top / folder).glob(pattern) if (top / folder).is_dir() else ():
            if p.is_file() and p.suffix in SUFFIXES:
                out.add((form, p.parent.name if p.name == "SKILL.md" else p.stem, str(p.relative_to(top))))
    for name in ("Makefile", "justfile"):
        if (top / name).is_file():
            for line in (top / name).read_text(encoding="utf-8").splitlines():
                m = TARGET.match(line)
                if m and not m[1].startswith("."):
                    out.add(("script", m[1], f"{name}:{m[1]}"))
    return sorted(out, key=lambda a: (a[0], a[2]))


def project_of(path: str) -> str:
    """Name of the nearest folder above a file that is a repository, or of its own folder."""
    p = Path(path).resolve()
    return next((d.name for d in p.parents if (d / ".git").exists()), p.parent.name)


def sessions_of(cwd: str, root: str, dialect: str) -> list[str]:
    """Log files of a working directory: by the folder's encoded name, or by the cwd that a folder's first log records."""
    top = Path(root).expanduser()
    if dialect == "claude":
        from .sessions import encoded_cwd

        return sorted(map(str, (top / encoded_cwd(cwd)).glob("*.jsonl")))
    if dialect == "pi":
        out: list[str] = []
        for d in sorted(x for x in top.glob("*") if x.is_dir()) if top.is_dir() else ():
            logs = sorted(d.glob("*.jsonl"), reverse=True)
            if logs and _recorded_cwd(logs[0]) == cwd:
                out += map(str, logs)
        return out
    return []


def _recorded_cwd(path: Path) -> str | None:
    with path.open(encoding="utf-8", errors="replace") as f:
        for line in f:
            try:
                value = json.loads(line)
            except ValueError:
                continue
            if isinstance(value, dict) and isinstance(value.get("cwd"), str):
                return value["cwd"]
    return None


def payload(path: str, dialect: str, record_id: str) -> tuple[object, str]:
    """(what the log says now about a record, a note if it can't be found); nothing of it is stored."""
    from .sessions import parsed

    try:
        data = Path(path).read_bytes()
    except OSError as e:
        return None, f"the log can't be read: {e}"
    got = parsed(path, data, dialect)
    for row in [*got["messages"], *got["events"]]:
        if row["id"] == record_id:
            return row, ""
    return None, got["error"] or "the log no longer has this record"
