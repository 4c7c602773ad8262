"""A memory as a folder of snapshot tables, and what a user asks of it; ``python -m lorewell`` runs the same from a shell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunk, distill, excerpt, graph, ingest, lifecycle, pack, search, trace
from .sources import assets, sessions
from .streaming import queue
from .tables import numbered, shared_dir, upserted, written

SCHEMAS = {
    "documents": "id long, path string, project string, doc_date string, section string, content string, version long",
    "sessions": sessions.SESSION,
    "messages": sessions.MESSAGE + ", project string, text_truncated boolean",
    "events": sessions.EVENT + ", project string, body_truncated boolean",
    "import_state": "path string, mtime timestamp, size long",
    "entities": "id long, canonical_name string, type string, description string, embedding array<double>",
    "aliases": "alias string, entity_id long",
    "relations": "id long, source_id long, predicate string, target_id long, embedding array<double>, superseded_by long",
    "evidence": "relation_id long, doc_id long",
    "triage": "trace_kind string, trace_id string, gate_version string, project string, created_at string, should_extract boolean, reason string, importance double, confidence double, unit_type string, temporal_type string, "
    "labels array<string>, hint string, consumed boolean",
    "units": "id long, project string, unit_type string, status string, title string, content string, context string, why string, how_to_apply string, next_step string, importance double, confidence double, temporal_type string, "
    "labels array<string>, sources array<struct<source_kind:string,source_ref:string,quote:string>>, trace_id string, content_hash string, superseded_by long, valid_to string, recall_count long, last_recalled_at string, "
    "created_at string, updated_at string",
    "status_log": "log_id long, id long, from_status string, to_status string, command string, reason string, superseded_by long",
    "queue": "id long, seq long, status string, error string",
    "queue_items": "id long, content string, project string, path string, doc_date string",
    "meta": "key string, value string",
}


class Memory:
    """Tables under root, each a series of numbered snapshots; a change writes the next one, readers see whole snapshots only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _snapshots(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        done = [p.getName() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[1:]) for n in done if n[1:].isdigit())

    def table(self, name: str) -> DataFrame:
        known = self._snapshots(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{known[-1]}") if known else self.spark.createDataFrame([], SCHEMAS[name])

    def _write(self, name: str, df: DataFrame) -> None:
        names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema.fields]
        df.select(*names).write.mode("overwrite").parquet(f"{self.root}/{name}/v{([0, *self._snapshots(name)])[-1] + 1}")

    def _last(self, name: str, column: str = "id") -> int:
        return self.table(name).agg(F.max(column)).first()[0] or 0

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # Documents and the graph ---------------------------------------------

    def _added(self, new: DataFrame) -> DataFrame:
        """new (path, project, doc_date, chunk, section, content) as numbered documents with versions, written."""
        old = self.table("documents")
        new = ingest.versions(new, old.select("path", "version"))
        new = numbered(new, F.col("path"), F.col("chunk"), start=self._last("documents")).select(*old.columns)
        new = written(new, f"{shared_dir(self.spark)}/new")
        self._write("documents", old.unionByName(new))
        return new

    def ingest_files(self, paths: str | list[str], project: str | None = None, glob: str = "*.md", max_tokens: int = 2000, extract: Callable[[str], dict] | None = None, embed: Callable | None = None) -> int:
        """Add the chunks of text files as documents, and with an extractor what it finds in them as graph; returns how many chunks."""
        return self._content(ingest.sections(ingest.read_files(self.spark, paths, project, glob), max_tokens), extract, embed)[0]

    def _content(self, parts: DataFrame, extract: Callable[[str], dict] | None, embed: Callable | None) -> tuple[int, DataFrame]:
        """(chunks added, (id, error) of those that the extractor failed on); a chunk that fails stays a document."""
        new = self._added(parts)
        failed = self._frame([], "id long, error string")
        if extract is not None:
            got = written(chunk.extracted(new, extract), f"{shared_dir(self.spark)}/extracted")
            failed = got.where("error IS NOT NULL").select("id", "error")
            none = F.expr("cast(null AS array<struct<unit_type:string,title:string,content:string,context:string,why:string,how_to_apply:string,next_step:string,labels:array<string>>>)")
            self._take(got.where("error IS NULL").select(F.col("id").alias("doc_id"), F.struct("entities", "relations", none.alias("units")).alias("graph")), new, embed)
        return new.count(), failed

    def ingest_graph(self, text: str, project: str = "", path: str | None = None, section: str | None = None, doc_date: str | None = None, source: str = "", embed: Callable | None = None) -> dict[str, int]:
        """Take a graph that an agent has made, as JSON: its source as a document, entities, relations and units; ValueError if it isn't one."""
        graphs = ingest.parsed_graphs(self._frame([(1, text)], "doc_id long, json string"))
        wrong = [r.reason for r in ingest.invalid_graphs(graphs).collect()]  # of one graph
        if wrong:
            raise ValueError("; ".join(wrong))
        doc = self._added(self._frame([(path, project, doc_date, 0, section, source)], "path string, project string, doc_date string, chunk int, section string, content string"))
        return self._take(graphs.crossJoin(doc.select("id")).select(F.col("id").alias("doc_id"), "graph"), doc, embed)  # one row by one

    def _embedding(self, texts: DataFrame, embed: Callable | None) -> DataFrame:
        """(text, embedding) by the embedder, whose name and length must be those of the stored vectors; no rows without one."""
        if embed is None:
            return self._frame([], "text string, embedding array<double>")
        from .tables import embedder_matches

        probe = embed([""])[0]
        name = getattr(embed, "__name__", type(embed).__name__)
        meta = {r.key: r.value for r in self.table("meta").collect()}  # two rows
        embedder_matches(meta, name, len(probe))
        if not meta:
            self._write("meta", self._frame([("embedding_model", name), ("embedding_dim", str(len(probe)))], SCHEMAS["meta"]))
        return chunk.embedded(texts, embed).select("text", F.col("embedding").cast("array<double>").alias("embedding"))

    def _take(self, graphs: DataFrame, docs: DataFrame, embed: Callable | None) -> dict[str, int]:
        """Resolve entities, add aliases and longer descriptions, upsert relations with their evidence, mark what is superseded, add units."""
        top = shared_dir(self.spark)
        t = ingest.graph_tables(graphs)
        specs = numbered(t["entities"], F.col("doc_id"), F.col("name"), name="ord")
        texts = specs.select(F.col("name").alias("text")).unionByName(t["relations"].select("text"))
        vectors = written(self._embedding(texts, embed), f"{top}/vectors")
        specs = written(specs.join(vectors.withColumnRenamed("text", "name"), "name", "left"), f"{top}/specs")
        entities, aliases = self.table("entities"), self.table("aliases")
        made, names, of = ingest.resolved(specs, entities, aliases, self._last("entities") + 1)
        of = written(specs.select("ord", "doc_id", "name", "description").join(of, "ord"), f"{top}/of")
        longer = ingest.longer_descriptions(entities.unionByName(made.select(*entities.columns)), of.select(F.col("entity_id").alias("id"), "description", "ord"))
        self._write("entities", longer)
        self._write("aliases", aliases.unionByName(names.join(aliases, "alias", "left_anti").select(*aliases.columns)))

        end = lambda c: of.select("doc_id", F.col("name").alias(c), F.col("entity_id").alias(f"{c}_id"))
        rel = t["relations"].join(end("source"), ["doc_id", "source"]).join(end("target"), ["doc_id", "target"]).join(vectors, "text", "left")
        rel = written(rel.select("doc_id", "source_id", "predicate", "target_id", "embedding"), f"{top}/relations")
        keys = ["source_id", "predicate", "target_id"]
        old = self.table("relations")
        fresh = rel.groupBy(*keys).agg(F.first("embedding", True).alias("embedding"))
        new = numbered(fresh.join(old, keys, "left_anti"), *[F.col(k) for k in keys], start=self._last("relations")).withColumn("superseded_by", F.lit(None).cast("long"))
        filled = old.join(fresh.withColumnRenamed("embedding", "lw_new"), keys, "left").withColumn("embedding", F.coalesce("embedding", "lw_new"))
        both = written(filled.select(*old.columns).unionByName(new.select(*old.columns)), f"{top}/both")
        evidence = self.table("evidence").unionByName(rel.join(both.select(*keys, F.col("id").alias("relation_id")), keys).select("relation_id", "doc_id")).distinct()
        evidence = written(evidence, f"{top}/evidence")
        self._write("evidence", evidence)
        where = self.table("documents").select(F.col("id").alias("doc_id"), "path", "version")
        facts = evidence.join(both.withColumnRenamed("id", "relation_id"), "relation_id").join(where, "doc_id")
        facts = numbered(facts.select("doc_id", "relation_id", F.col("source_id").alias("subject"), "predicate", F.col("target_id").alias("object"), "path", "version"), F.col("doc_id"), F.col("relation_id"), name="ord")
        told = graph.replayed_supersession(facts).where("superseded_by_object IS NOT NULL")
        by = both.select(F.col("source_id").alias("subject"), "predicate", F.col("target_id").alias("superseded_by_object"), F.col("id").alias("lw_by"))
        gone = told.join(by, ["subject", "predicate", "superseded_by_object"]).select(F.col("subject").alias("source_id"), "predicate", F.col("object").alias("target_id"), "lw_by")
        self._write("relations", both.join(gone, keys, "left").withColumn("superseded_by", F.coalesce("superseded_by", "lw_by")))

        u = t["units"].join(docs.select(F.col("id").alias("doc_id"), "project"), "doc_id")
        sources = F.transform("sources", lambda s: F.struct(s["source_kind"].alias("source_kind"), F.concat_ws("#", s["source_ref"], s["source_message_id"]).alias("source_ref"), s["quote"].alias("quote")))
        u = u.withColumn("sources", sources).withColumn("trace_id", F.concat_ws(":", "doc_id", "at")).withColumn("temporal_type", F.lit("unknown")).withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
        n_units = self._created(u, "ingest-graph").count()
        return {"entities": specs.count(), "relations": rel.count(), "units": n_units}

    def entities(self) -> DataFrame:
        return self.table("entities").select("id", "canonical_name", "type", "description").orderBy("id")

    def relations(self) -> DataFrame:
        name = lambda c: self.table("entities").select(F.col("id").alias(f"{c}_id"), F.col("canonical_name").alias(c))
        return self.table("relations").join(name("source"), "source_id").join(name("target"), "target_id").select("id", "source", "predicate", "target", "superseded_by").orderBy("id")

    # The queue -----------------------------------------------------------

    def enqueue(self, content: str, project: str = "", path: str | None = None, doc_date: str | None = None) -> int:
        first = self._last("queue_items") + 1
        items, log = queue.enqueued(self._frame([(content, project, path, doc_date)], "content string, project string, path string, doc_date string"), first)
        old = self.table("queue_items")
        self._write("queue_items", old.unionByName(items.select(*old.columns)))
        self._logged(log)
        return first

    def _logged(self, entries: DataFrame) -> None:
        old = self.table("queue")
        self._write("queue", old.unionByName(written(entries.select(*old.columns), f"{shared_dir(self.spark)}/log")))

    def process(self, extract: Callable[[str], dict] | None = None, embed: Callable | None = None, retry: bool = False, max_tokens: int = 2000) -> dict[str, int]:
        """Work off the queue: what an ended worker left is taken up, with retry failed items too; returns the counts per status."""
        state = lambda: queue.latest(self.table("queue"))
        self._logged(queue.recovered(state()))
        if retry:
            self._logged(queue.reset(state()))
        taken = written(state().where("status = 'pending'").select("id"), f"{shared_dir(self.spark)}/taken")
        n = taken.count()
        if n:
            self._logged(queue.claimed(state(), n))
            items = self.table("queue_items").join(taken, "id")
            parts = chunk.chunked(items.select("id", "content"), max_tokens).join(items.drop("content"), "id")
            item_of = parts.select(F.coalesce("path", F.concat(F.lit("queue:"), F.col("id").cast("string"))).alias("path"), "project", "doc_date", "chunk", "section", "content")
            before = self._last("documents")
            _, failed = self._content(item_of, extract, embed)
            new = self.table("documents").where(F.col("id") > before).join(failed, "id").groupBy("path").agg(F.min("error").alias("error"))
            keyed = items.select("id", F.coalesce("path", F.concat(F.lit("queue:"), F.col("id").cast("string"))).alias("path"))
            self._logged(queue.marked(state(), keyed.join(new, "path", "left").select("id", "error")))
        return self.queue_counts()

    def queue_counts(self) -> dict[str, int]:
        return {r.status: r.n for r in queue.counts(queue.latest(self.table("queue"))).collect()}  # four rows

    # History -------------------------------------------------------------

    def pull(self, paths: str | list[str], dialect: str, project: str | None = None) -> dict[str, int]:
        """Import session logs that aren't as they were: redacted, cut, and upserted by id, so that repeating it changes nothing."""
        state = self.table("import_state")
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(paths).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
        todo = written(sessions.changed(listed, state), f"{shared_dir(self.spark)}/todo")
        names = [r.path for r in todo.select("path").toLocalIterator()]  # paths of the logs that have changed
        if not names:
            return {"sessions": 0, "messages": 0, "events": 0, "bad_lines": 0}
        files = written(sessions.read(self.spark, names, dialect, project), f"{shared_dir(self.spark)}/parsed")
        got, counts = sessions.tables(files), {}
        of = got["sessions"].select(F.col("id").alias("session_id"), "project")
        fresh = {"sessions": got["sessions"]}
        for name, column in (("messages", "text"), ("events", "body")):
            fresh[name] = trace.storable(got[name].join(of, "session_id", "left"), column)
        for name, df in fresh.items():
            df = df.dropDuplicates(["id"])
            old = self.table(name)
            keep = ["started_at", "ended_at"] if name == "sessions" else []
            self._write(name, upserted(old, df.select(*old.columns), ["id"], keep_old_if_null=keep))
            counts[name] = df.count()
        self._write("import_state", upserted(state, todo.select(*state.columns), ["path"]))
        return counts | {"bad_lines": files.agg(F.sum("bad_lines")).first()[0] or 0}

    def traces(self) -> DataFrame:
        m = self.table("messages").select(F.lit("message").alias("trace_kind"), F.col("id").alias("trace_id"), "project", "role", "text", "created_at")
        e = self.table("events").select(F.lit("event").alias("trace_kind"), F.col("id").alias("trace_id"), "project", F.coalesce("tool_name", "kind").alias("role"), F.col("body").alias("text"), "created_at")
        return m.unionByName(e)

    def history(self, question: str, k: int = 20, **filters) -> DataFrame:
        return trace.search(self.table("messages"), self.table("events"), question, k, **filters)

    def around(self, message_id: str, radius: int = 3) -> DataFrame:
        m = self.table("messages")
        return trace.around(m, m.where(F.col("id") == message_id), radius).orderBy("seq")

    def record(self, record_id: str) -> DataFrame:
        """The message, or else the event, of this id: kind, and the row as JSON."""
        m = self.table("messages").where(F.col("id") == record_id).select(F.lit("message").alias("kind"), F.to_json(F.struct("*")).alias("row"))
        e = self.table("events").where(F.col("id") == record_id).select(F.lit("event").alias("kind"), F.to_json(F.struct("*")).alias("row"))
        return m.unionByName(e).orderBy(F.desc("kind")).limit(1)

    def fetch(self, record_id: str, dialect: str) -> tuple[object, str]:
        """(what the log says now about a record, a note if it can't be found)."""
        found = self.record(record_id).first()
        if found is None:
            return None, "no such record"
        session = self.table(f"{found.kind}s").where(F.col("id") == record_id).join(self.table("sessions").select(F.col("id").alias("session_id"), "source_ref"), "session_id").first()
        return assets.payload(session.source_ref.removeprefix("file://").removeprefix("file:"), dialect, record_id) if session else (None, "the record's session is gone")

    def events_of(self, path: str, k: int = 50, project: str | None = None) -> DataFrame:
        return trace.recent(self.table("events"), k, path=path, project=project)

    def failures(self, k: int = 50, since: str | None = None, project: str | None = None) -> DataFrame:
        return trace.recent(self.table("events"), k, kind="tool_error", since=since, project=project)

    # Units ---------------------------------------------------------------

    def triage(self, project: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
        """Triage the traces that these rules haven't seen and keep what they say; returns the pending rows."""
        old = self.table("triage")
        t = trace.filtered(self.traces(), project=project, since=since)
        t = t.join(old.where(F.col("gate_version") == lifecycle.GATE).select("trace_kind", "trace_id"), ["trace_kind", "trace_id"], "left_anti")
        if limit is not None:
            t = t.orderBy(F.asc_nulls_first("created_at"), "trace_kind", "trace_id").limit(limit)
        self._write("triage", lifecycle.triage_upserted(old, lifecycle.triage_records(lifecycle.triage(t))))
        return lifecycle.pending_triage(self.table("triage"), project)

    def extract(self, project: str | None = None, limit: int | None = None) -> DataFrame:
        """Turn pending triage rows into units that aren't there yet, and mark the rows as consumed; returns the new units."""
        table = self.table("triage")
        rows = written(lifecycle.pending_triage(table, project, limit=limit), f"{shared_dir(self.spark)}/pending")
        text = self.traces().join(rows.select("trace_kind", "trace_id"), ["trace_kind", "trace_id"], "left_semi")
        new = self._created(lifecycle.new_units(lifecycle.units_from(lifecycle.triage(text)), "trace_id"), "extract")
        self._write("triage", lifecycle.consumed(table, rows))
        return new

    def _created(self, units: DataFrame, command: str) -> DataFrame:
        """Units none of whose sources is covered and whose content is new, numbered, written and logged; ValueError if one is outside the closed sets."""
        old = self.table("units")
        for f in old.schema.fields:
            if f.name not in units.columns:
                units = units.withColumn(f.name, F.lit(0 if f.name == "recall_count" else None).cast(f.dataType))
        units = lifecycle.new_units(units, "trace_id")
        new = lifecycle.uncovered(units, old).join(old.select("content_hash"), "content_hash", "left_anti")
        new = written(numbered(new, F.col("trace_id"), start=self._last("units")).select(*old.columns), f"{shared_dir(self.spark)}/units")
        wrong = lifecycle.invalid(new).first()
        if wrong is not None:
            raise ValueError(f"unit {wrong.id}: {wrong.reason}")
        self._write("units", old.unionByName(new))
        log = new.select("id", F.lit(None).cast("string").alias("from_status"), F.col("status").alias("to_status"), F.lit(command).alias("command"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("superseded_by"))
        self._append_log(numbered(log, F.col("id"), start=self._last("status_log", "log_id"), name="log_id"))
        return new

    def _append_log(self, rows: DataFrame) -> None:
        old = self.table("status_log")
        self._write("status_log", old.unionByName(rows.select(*old.columns)))

    def checkpoint(self, apply: bool = True, project: str | None = None, since: str | None = None, limit: int | None = None, pull: tuple[str, str] | None = None) -> DataFrame:
        """Pull the logs of (paths, dialect), triage what is new and turn what is worth it into units; returns the new units. Without apply nothing is kept."""
        if not apply:
            seen = self.table("triage").where("consumed").select("trace_kind", "trace_id")
            t = trace.filtered(self.traces(), project=project, since=since).join(seen, ["trace_kind", "trace_id"], "left_anti")
            old = self.table("units")
            new = lifecycle.new_units(lifecycle.units_from(lifecycle.triage(t)), "trace_id")
            return lifecycle.uncovered(new, old).join(old.select("content_hash"), "content_hash", "left_anti")
        if pull is not None:
            self.pull(*pull, project=project)
        self.triage(project, since, limit)
        return self.extract(project)

    def _sources(self, units: DataFrame) -> DataFrame:
        return units.select(F.col("id").alias("unit_id"), F.explode("sources").alias("s")).select("unit_id", "s.source_kind", "s.source_ref")

    def _moved(self, wanted: DataFrame, command: str) -> None:
        after, log = lifecycle.transitions(self.table("units"), wanted, command, self._last("status_log", "log_id") + 1)
        log = written(log, f"{shared_dir(self.spark)}/log")
        self._write("units", after)
        self._append_log(log)

    def consolidate(self, as_of: str, apply: bool = True, project: str | None = None, since: str | None = None, limit: int | None = None, scores: DataFrame | None = None) -> DataFrame:
        """The plan for all live units; with apply its transitions are made, all or none."""
        live = lifecycle.scan(self.table("units"), "consolidate", project, since, limit)
        plan = lifecycle.consolidation(live, lifecycle.independent_sources(self._sources(live)), F.lit(as_of).cast("timestamp"), scores)
        to = F.element_at(F.create_map(*[F.lit(x) for kv in {"supersede": "superseded", "archive": "archived", "promote": "crystal", "candidate": "crystal_candidate", "demote": "active_unit"}.items() for x in kv]), F.col("action"))
        plan = written(plan.join(live.select("id", F.col("status").alias("from_status")), "id"), f"{shared_dir(self.spark)}/plan")
        if apply:
            self._moved(plan.where(F.col("action").isin(*lifecycle.APPLY_ORDER)).select("id", "from_status", to.alias("to_status"), "reason", "superseded_by"), "consolidate")
        order = F.coalesce(F.array_position(F.array(*map(F.lit, lifecycle.APPLY_ORDER)), F.col("action")), F.lit(0))
        return plan.drop("from_status").orderBy(F.when(order == 0, 99).otherwise(order), "id")

    def attach(self, unit_id: int, source_kind: str, source_ref: str) -> None:
        """A further source of a unit; its confidence rises if that is independent of the others."""
        units = self.table("units")
        new = self._frame([(unit_id, source_kind, source_ref)], "unit_id long, source_kind string, source_ref string")
        raised = ingest.attached(units, self._sources(units), new)
        one = F.struct(F.lit(source_kind).alias("source_kind"), F.lit(source_ref).alias("source_ref"), F.lit("").alias("quote"))
        there = F.exists("sources", lambda s: (s["source_kind"] == source_kind) & (s["source_ref"] == source_ref))
        more = F.when((F.col("id") == unit_id) & ~there, F.concat("sources", F.array(one))).otherwise(F.col("sources"))
        self._write("units", raised.withColumn("sources", more))
        last = self._last("status_log", "log_id") + 1
        self._append_log(units.where(F.col("id") == unit_id).select(F.lit(last).cast("long").alias("log_id"), "id", F.col("status").alias("from_status"), F.col("status").alias("to_status"), F.lit("attach-source").alias("command"), F.lit(source_ref).alias("reason"), F.lit(None).cast("long").alias("superseded_by")))

    def set_status(self, unit_id: int, status: str, superseded_by: int | None = None, expected: str | None = None, reason: str | None = None) -> None:
        """Retract, archive or supersede one unit, if it is in the status expected."""
        if status not in lifecycle.STATUSES:
            raise ValueError(f"unknown status {status!r}")
        self._moved(self._frame([(unit_id, expected, status, reason, superseded_by)], "id long, from_status string, to_status string, reason string, superseded_by long"), status)

    def restore(self, unit_id: int, reason: str | None = None) -> str:
        """An archived unit back in the status that it had before; returns that."""
        found = lifecycle.restored(self.table("units").where(F.col("id") == unit_id), self.table("status_log")).first()
        if found is None:
            raise ValueError("there is no such archived unit")
        self.set_status(unit_id, found.status, expected="archived", reason=reason)
        return found.status

    def units(self, project: str | None = None, limit: int | None = 50) -> DataFrame:
        return lifecycle.scan(self.table("units"), "list", project, limit=limit)

    def search_units(self, question: str, project: str | None = None, statuses: tuple[str, ...] | None = None, k: int = 20) -> DataFrame:
        u = self.table("units").withColumn("body", F.concat_ws(" ", "title", "content", "context"))
        found = search.bm25(u, search.phrases(question), "body").drop("body")
        if project is not None:
            found = found.where(F.col("project") == project)
        return (found.where(F.col("status").isin(*statuses)) if statuses else found).orderBy(F.desc("score"), "id").limit(k)

    def distill(self, found: DataFrame | None = None, project: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
        """Groups of live procedures and learnings worth distilling; found: assets as from inventory()."""
        u = lifecycle.scan(self.table("units"), "distill", project, since, limit)
        return distill.candidates(u, self._sources(u), found)

    def inventory(self, root: str) -> DataFrame:
        return self._frame(assets.inventory(root), "form string, name string, path string")

    # Queries -------------------------------------------------------------

    def recalled(self, question: str, as_of: str, project: str | None = None, k: int = 20) -> DataFrame:
        """The k units that answer best: BM25 of four times as many, scaled, by importance, confidence and age, crystals first if equal."""
        u = self.table("units").where(F.col("superseded_by").isNull()).withColumn("body", F.concat_ws(" ", "title", "content", "context"))
        hits = search.bm25(u, search.phrases(question), "body").drop("body").where(F.col("status").isin(*lifecycle.LIVE))
        if project is not None:
            hits = hits.where(F.col("project") == project)
        pool = hits.orderBy(F.desc("score"), "id").limit(4 * k)
        stamp = T.parse_stamp(F.coalesce("updated_at", "created_at"))
        crystal = F.col("status") == "crystal"
        score = lifecycle.recall_score(search.min_max(F.col("score"), equal=1.0), F.col("importance"), F.col("confidence"), T.recency(stamp, F.lit(as_of).cast("timestamp")), crystal)
        return pool.withColumn("score", score).orderBy(F.desc("score"), F.desc(crystal), "id").limit(k)

    def seeds(self, question: str, names: list[str] | None = None, longest: int = 5) -> DataFrame:
        """Entities that are named: by names, or by runs of words of the question that are aliases."""
        words = [w for p in search.phrases(question) for w in p]
        asked = names if names is not None else [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        keys = self._frame([(a,) for a in asked], "name string").select(T.normalize_name(F.col("name")).alias("alias")).distinct()
        return self.table("aliases").join(keys, "alias", "left_semi").select(F.col("entity_id").alias("id")).distinct()

    def triples(self, question: str, max_hops: int = 2, names: list[str] | None = None, project: str | None = None, superseded: bool = False, embed: Callable | None = None) -> DataFrame:
        """Relations around the seeds with their scores: best first, then fewest hops, then newest."""
        seeds = written(self.seeds(question, names), f"{shared_dir(self.spark)}/seeds")
        rel = self.table("relations") if superseded else self.table("relations").where("superseded_by IS NULL")
        edges = rel.select("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "predicate", "embedding")
        depths = graph.traverse(edges, seeds, max_hops)
        docs = self.table("documents")
        n = self.table("evidence").count()
        evidence = graph.evidence_of(edges, self.table("evidence"), docs.withColumnRenamed("path", "source_path"), project, n)
        scored = graph.scored(edges, depths, evidence, search.bm25(docs, search.phrases(question)).select(F.col("id").alias("doc_id"), "score"), embed([question])[0] if embed else None, max_hops, max(rel.count(), n))
        name = lambda c: self.table("entities").select(F.col("id").alias(c), F.col("canonical_name").alias(f"{c}_name"))
        named = scored.join(name("source"), "source").join(name("target"), "target")
        return named.orderBy(*graph.score_order(F.col("score"), F.col("hops"), F.col("best_date")), "id")

    def passages(self, question: str, k: int = 10, project: str | None = None) -> DataFrame:
        """The k documents that answer best: over-fetched, newest versions, by anchor words, from all sources in turn, cut to excerpts."""
        docs = self.table("documents")
        chinese = any("㐀" <= c <= "鿿" for c in question)
        found = search.cjk_search(docs, question, 16 * k).drop("rank", "anchor") if chinese else search.bm25(docs, search.phrases(question))
        if project is not None:
            found = found.where(F.col("project") == project)
        ranked = search.top(found, 16 * k, F.desc("score"), F.col("id"))
        best = search.latest_versions(ranked.withColumn("source_path", F.col("path")))
        if not chinese:
            best = search.lexical_rerank(best, question)
            best = best.withColumn("rank", F.row_number().over(search.Window.orderBy(F.desc("anchor"), "rank")))
        best = written(search.round_robin(best, k), f"{shared_dir(self.spark)}/passages")
        cut = excerpt.cjk(best, question) if chinese else excerpt.lexical(best, self._anchors(question))
        return best.drop("content").join(cut, "id").withColumnRenamed("excerpt", "content")

    def _anchors(self, question: str) -> list[str]:
        return self.spark.range(1).select(T.anchor_terms(F.lit(question)).alias("a")).first().a

    def query(
        self, question: str, project: str | None = None, budget: int = 2000, k: int = 10, memory_share: float = 0.15, chunk_share: float = 0.4, max_hops: int = 2, names: list[str] | None = None,
        as_of: str = "9999-01-01", superseded: bool = False, embed: Callable | None = None, remember: bool = True,
    ) -> str:
        """What is known about a question as text within a token budget: memories, then facts and passages that share the rest."""
        hits = self.recalled(question, as_of, project).select("id", "title", "content", "status").withColumn("line", F.concat(F.lit("- "), F.when(F.col("status") == "crystal", "* ").otherwise(""), "title", F.lit(": "), T.first_line(F.col("content"))))
        hits = hits.withColumn("cost", T.est_tokens(F.col("line"))).collect()  # 20 rows at most
        lines, ids, spent, allowance = [], [], 0, int(budget * memory_share)
        for h in hits:  # a prefix: the first that doesn't fit ends it
            if spent + h.cost > allowance:
                break
            lines.append(h.line)
            ids.append(h.id)
            spent += h.cost
        _, room = pack.partition_budget(budget, memory_share, spent)
        if ids and remember and as_of != "9999-01-01":
            self._write("units", ingest.recalled(self.table("units"), self._frame([(i,) for i in ids], "id long"), as_of))

        triples = written(self.triples(question, max_hops, names, project, superseded, embed).withColumn("n", F.monotonically_increasing_id()), f"{shared_dir(self.spark)}/triples")
        docs = self.table("documents").select(F.col("id").alias("doc_id"), "project", "path", "section", "doc_date", "content")
        tag = F.concat(F.lit("["), T.provenance_tag(F.col("project"), F.col("path"), F.col("section"), F.col("doc_date")), F.lit("]"))
        shown = docs.select("doc_id", tag.alias("tag"), "content", (T.est_tokens(tag) + T.est_tokens(F.col("content"))).alias("cost"))
        chunks = self.passages(question, k, project).select(F.col("place").alias("n"), F.col("id").alias("doc_id"), tag.alias("tag"), "content", (T.est_tokens(tag) + T.est_tokens(F.col("content"))).alias("cost"))
        ev = self.table("evidence").join(triples.select(F.col("id").alias("relation_id")), "relation_id", "left_semi").join(shown, "doc_id")
        ev = ev.groupBy("relation_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.col("cost").cast("long").alias("cost")))).alias("evidence"))
        line = F.concat_ws(" ", F.concat("source_name", F.lit(":")), "predicate", "target_name")
        none = F.array().cast("array<struct<doc_id:bigint,cost:bigint>>")
        t = triples.join(ev, F.col("id") == F.col("relation_id"), "left").select(F.struct("n", F.coalesce(T.est_tokens(line), F.lit(0)).cast("long").alias("cost"), F.coalesce("evidence", none).alias("evidence"), F.col("source_name").alias("s"), "predicate", F.col("target_name").alias("o")).alias("t"))
        one = t.agg(F.sort_array(F.collect_list("t")).alias("triples"))
        c = chunks.select(F.struct("n", "doc_id", F.col("cost").cast("long").alias("cost"), "tag", "content").alias("c")).agg(F.sort_array(F.collect_list("c")).alias("chunks"))
        f = one.crossJoin(c).withColumn("f", pack.fused(F.col("triples"), F.col("chunks"), room, chunk_share)).first()  # one row
        out = ["Memories", *lines, ""] if lines else []
        grouped: dict[str, list[str]] = {}
        for i in [*f.f.triples, *f.f.backfill]:
            x = f.triples[i]
            grouped.setdefault(x.s, []).append(f"{x.predicate} {x.o}")
        if grouped:
            out += ["Facts", *(f"{s}: {' | '.join(p)}" for s, p in grouped.items()), ""]
        if f.f.evidence:
            texts = {r.doc_id: r for r in shown.where(F.col("doc_id").isin(list(f.f.evidence))).collect()}  # those that fit the budget
            out += ["Evidence", *[x for d in f.f.evidence for x in (texts[d].tag, texts[d].content.strip())], ""]
        if f.f.chunks:
            out += ["Relevant source chunks", *[x for i in f.f.chunks for x in (f.chunks[i].tag, f.chunks[i].content.strip())], ""]
        out.append(f"(returned {len(lines)}/{len(hits)} memories, {len(f.f.chunks)}/{len(f.chunks)} chunks)")
        out.append(pack.footer(len(f.f.triples) + len(f.f.backfill), len(f.triples), spent + f.f.used, budget, (len(f.f.chunks), len(f.chunks))))
        waiting = queue.pending(queue.latest(self.table("queue"))).count()
        return "\n".join([*out, *([pack.pending_note(waiting)] if waiting else [])])

    def export(self) -> str:
        """Live units as a memory file, by section; for people, so it is gathered on the driver line by line."""
        u = self.table("units").where(F.col("status").isin(*lifecycle.LIVE))
        rows = u.select(lifecycle.export_section().alias("section"), "id", F.concat(F.lit("- "), "title", F.lit(": "), "content").alias("line")).orderBy("section", "id")
        out, last = [], None
        for r in rows.toLocalIterator():
            if r.section != last:
                out += ["", f"## {r.section}", ""]
                last = r.section
            out.append(r.line)
        return "\n".join(out).strip()


#: Commands of the shell and their options: ``name`` is one value, ``name*`` are several, ``--name`` may be left out.
COMMANDS = {
    "query": ("question", "--budget", "--as-of", "--hops"), "ingest": ("content", "--path", "--date"), "ingest-file": ("paths*",), "process": ("--retry",), "queue": (), "extract-prompt": ("purpose", "text"), "ingest-graph": ("json", "--path", "--section", "--date"),
    "list-entities": (), "list-relations": (), "pull": ("paths*", "--dialect"), "history": ("question", "--kind", "--tool", "--path", "--since", "--session"), "around": ("record", "--radius"), "fetch": ("record", "--dialect"), "file": ("path",), "failures": ("--since",),
    "triage": ("--since", "--limit"), "extract": ("--limit",), "consolidate": ("--as-of", "--since", "--limit"), "export": (), "list": ("--limit",), "show": ("unit",), "retract": ("unit",), "restore": ("unit",), "supersede": ("unit", "by"),
    "checkpoint": ("--since", "--limit", "--paths", "--dialect"), "distill": ("--assets", "--since", "--as-of"), "version": (),
}
VERSION = "0.2"


def main(args: list[str], spark_of: Callable[[], SparkSession] = lambda: SparkSession.builder.appName("lorewell").getOrCreate()) -> int:
    import argparse
    from pathlib import Path

    p = argparse.ArgumentParser(prog="lorewell")
    p.add_argument("--root", required=True, help="folder of the memory's tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in COMMANDS.items():
        s = sub.add_parser(name)
        for o in options:
            if o == "--retry":
                s.add_argument(o, action="store_true")
            else:
                s.add_argument(o.rstrip("*"), **({"nargs": "+"} if o.endswith("*") else {}))
        s.add_argument("--project")
    a = p.parse_args(args)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "extract-prompt":
        print(ingest.prompt(a.purpose, a.text))
        return 0
    m = Memory(spark_of(), a.root)
    whole = lambda x: None if x is None else int(x)
    since = getattr(a, "since", None)
    if since is not None and len(since) < 8:
        since = T.since_bound(since, getattr(a, "as_of", None) or str(m.spark.sql("SELECT current_timestamp()").first()[0]))
    text = {
        "query": lambda: m.query(a.question, a.project, int(a.budget or 2000), as_of=a.as_of or "9999-01-01", max_hops=int(a.hops or 2)), "ingest": lambda: f"queued as {m.enqueue(a.content, a.project or '', a.path, a.date)}",
        "ingest-file": lambda: f"{m.ingest_files(a.paths, a.project)} chunks", "process": lambda: str(m.process(retry=a.retry)), "queue": lambda: str(m.queue_counts()), "pull": lambda: str(m.pull(a.paths, a.dialect or "native", a.project)),
        "ingest-graph": lambda: str(m.ingest_graph(Path(a.json).read_text(encoding="utf-8"), a.project or "", a.path, a.section, a.date)), "fetch": lambda: str(m.fetch(a.record, a.dialect or "native")), "export": m.export,
        "retract": lambda: str(m.set_status(int(a.unit), "retracted") or "retracted"), "restore": lambda: m.restore(int(a.unit)), "supersede": lambda: str(m.set_status(int(a.unit), "superseded", int(a.by)) or "superseded"),
    }
    rows = {
        "list-entities": m.entities, "list-relations": m.relations, "history": lambda: m.history(a.question, kind=a.kind, tool=a.tool, path=a.path, since=since, session=a.session, project=a.project), "around": lambda: m.around(a.record, int(a.radius or 3)),
        "file": lambda: m.events_of(a.path, project=a.project), "failures": lambda: m.failures(since=since, project=a.project), "triage": lambda: m.triage(a.project, since, whole(a.limit)), "extract": lambda: m.extract(a.project, whole(a.limit)),
        "consolidate": lambda: m.consolidate(a.as_of or "now", project=a.project, since=since, limit=whole(a.limit)), "list": lambda: m.units(a.project, whole(a.limit) or 50), "show": lambda: m.table("units").where(F.col("id") == int(a.unit)),
        "checkpoint": lambda: m.checkpoint(project=a.project, since=since, limit=whole(a.limit), pull=(a.paths, a.dialect or "native") if a.paths else None), "distill": lambda: m.distill(m.inventory(a.assets) if a.assets else None, a.project, since),
    }
    if a.command in text:
        print(text[a.command]())
    else:
        rows[a.command]().show(50, truncate=60, vertical=a.command == "show")
    return 0
