"""Session traces: storing, searching and looking around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .search import bm25, phrases, top


def storable(traces: DataFrame, column: str, most_bytes: int = 16384) -> DataFrame:
    """traces with the column redacted, then cut to so many bytes, and ``<column>_truncated``."""
    value, cut = T.byte_cap(T.redact(F.col(column)), most_bytes)
    return traces.withColumn(f"{column}_truncated", cut).withColumn(column, value)


def trace_union(messages: DataFrame, events: DataFrame) -> DataFrame:
    """trace_kind, trace_id, role, text, created_at of messages and events; an event's role is its tool, or its kind."""
    m = messages.select(F.lit("message").alias("trace_kind"), F.col("id").cast("string").alias("trace_id"), "role", "text", F.col("created_at") if "created_at" in messages.columns else F.lit(None).cast("timestamp").alias("created_at"))
    e = events.select(F.lit("event").alias("trace_kind"), F.col("id").cast("string").alias("trace_id"), F.coalesce("tool_name", "kind").alias("role"), F.col("body").alias("text"), "created_at")
    return m.unionByName(e)


def filtered(rows: DataFrame, project: str | None = None, session: str | None = None, since: str | None = None, kind: str | None = None, tool: str | None = None, path: str | None = None) -> DataFrame:
    """Search filters: ``tool_error`` means failed tool results; a path is a file or a folder above it; since drops null times."""
    cond = F.lit(True)
    for name, value in (("project", project), ("session_id", session), ("tool_name", tool)):
        if value is not None:
            cond = cond & (F.col(name) == value)
    if since is not None:
        cond = cond & (F.col("created_at") >= since)
    if kind == "tool_error":
        cond = cond & (F.col("kind") == "tool_result") & F.col("is_error")
    elif kind is not None:
        cond = cond & (F.col("kind") == kind)
    if path is not None:
        cond = cond & under(F.col("file_path"), path)
    return rows.where(cond)


def under(column: Column, path: str) -> Column:
    base = path.rstrip("/")
    return (column == base) | column.startswith(base + "/")


def search(messages: DataFrame, events: DataFrame, question: str, k: int = 20, **filters) -> DataFrame:
    """Best k of messages and events: pool, id, score, rank. Each pool is ranked by its own statistics; event filters leave messages out."""
    terms = phrases(question)
    own = {n: v for n, v in filters.items() if n in ("project", "session", "since")}
    pools = []
    if not any(filters.get(n) is not None for n in ("kind", "tool", "path")):
        pools.append(filtered(bm25(messages, terms, "text"), **own).select(F.lit("message").alias("pool"), F.col("id").cast("string").alias("id"), "score"))
    pools.append(filtered(bm25(events, terms, "body"), **filters).select(F.lit("event").alias("pool"), F.col("id").cast("string").alias("id"), "score"))
    both = None
    for p in pools:
        p = p.orderBy(F.desc("score"), "id").limit(k)
        both = p if both is None else both.unionByName(p)
    return top(both, k, F.desc("score"), F.col("pool"), F.col("id"))


def around(messages: DataFrame, centers: DataFrame, radius: int) -> DataFrame:
    """Messages whose seq is within radius of a centre's (session_id, seq), with center_seq."""
    c = centers.select("session_id", F.col("seq").alias("center_seq"), F.explode(F.sequence(F.col("seq") - radius, F.col("seq") + radius)).alias("seq"))
    return messages.join(c, ["session_id", "seq"])


def recent(events: DataFrame, k: int, **filters) -> DataFrame:
    """The newest k events, those without a time last."""
    return filtered(events, **filters).orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(k)
