"""Ingest: files, extracted graphs and their units into snapshot tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import dealt, numbered, shared_dir, written
from . import chunk

GRAPH = (
    "struct<entities:array<struct<name:string,type:string,description:string>>,relations:array<struct<source:string,target:string,predicate:string>>,"
    "units:array<struct<unit_type:string,title:string,content:string,context:string,why:string,how_to_apply:string,next_step:string,labels:array<string>>>>"
)


def read_files(spark: SparkSession, paths: str | list[str], project: str | None = None, glob: str = "*.md") -> DataFrame:
    """path, project, doc_date, content of whole text files; the date is that of the last change (UTC)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    own = F.element_at(F.split("path", "/"), -2)
    return files.select("path", (F.lit(project) if project else own).alias("project"), F.date_format("modificationTime", "yyyy-MM-dd").alias("doc_date"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def sections(files: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """path, project, doc_date, chunk, section, content of files' chunks."""
    own = files.withColumn("id", F.xxhash64("path"))
    parts = chunk.chunked(own.select("id", "content"), max_tokens)
    return own.drop("content").join(parts, "id").select("path", "project", "doc_date", "chunk", "section", "content")


def versions(new: DataFrame, known: DataFrame | None = None, order: str = "chunk", by: str = "chunk") -> DataFrame:
    """new (path, ...) with version: counting on from the path's highest in known (path, version).

    by: ``chunk`` counts each chunk, ``ingest`` gives all chunks of one pass the same version.
    """
    n = F.row_number().over(Window.partitionBy("path").orderBy(order)) if by == "chunk" else F.lit(1)
    df = new.withColumn("lw_n", n)
    if known is not None:
        df = df.join(known.groupBy("path").agg(F.max("version").alias("lw_last")), "path", "left")
    else:
        df = df.withColumn("lw_last", F.lit(0))
    return df.withColumn("version", F.when(F.col("path").isNotNull(), F.coalesce("lw_last", F.lit(0)) + F.col("lw_n")).cast("long")).drop("lw_n", "lw_last")


def parsed_graphs(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with graph, parsed from JSON; what isn't a graph has null."""
    return rows.withColumn("graph", F.from_json(column, GRAPH, {"mode": "PERMISSIVE"}))


def graph_tables(graphs: DataFrame) -> dict[str, DataFrame]:
    """entities, relations and units of graphs (doc_id, graph).

    Of equal entity names in one document the last specification counts;
    endpoints without one are entities of type Unknown. Predicates are normalised.
    """
    spec = graphs.select("doc_id", F.posexplode("graph.entities").alias("at", "e")).select("doc_id", "at", "e.*").where(T.has_text(F.col("name")))
    last = spec.groupBy("doc_id", "name").agg(F.max_by(F.struct("type", "description"), "at").alias("e")).select("doc_id", "name", F.coalesce("e.type", F.lit("Unknown")).alias("type"), F.coalesce("e.description", F.lit("")).alias("description"))
    rel = graphs.select("doc_id", F.posexplode("graph.relations").alias("at", "r")).select("doc_id", "at", "r.*").where(T.has_text(F.col("source")) & T.has_text(F.col("target")) & T.has_text(F.col("predicate")))
    rel = rel.withColumn("predicate", T.normalize_predicate(F.col("predicate"), T.PREDICATES)).withColumn("text", F.concat_ws(" ", "source", "predicate", "target"))
    ends = rel.select("doc_id", F.explode(F.array("source", "target")).alias("name")).distinct().join(last.select("doc_id", "name"), ["doc_id", "name"], "left_anti")
    entities = last.unionByName(ends.select("doc_id", "name", F.lit("Unknown").alias("type"), F.lit("").alias("description")))
    units = graphs.select("doc_id", F.posexplode("graph.units").alias("at", "u")).select("doc_id", "at", "u.*")
    source = F.struct(F.lit("document").alias("source_kind"), F.col("doc_id").cast("string").alias("source_ref"), F.concat(F.lit("unit:"), F.col("at").cast("string"), F.lit(":"), F.col("title")).alias("source_message_id"), F.lit("").alias("quote"))
    units = units.withColumn("status", F.lit("active_unit")).withColumn("importance", F.lit(0.5)).withColumn("confidence", F.lit(0.7)).withColumn("sources", F.array(source))
    return {"entities": entities, "relations": rel, "units": units}


def relations_upserted(old: DataFrame, new: DataFrame, rows: int | None = None) -> DataFrame:
    """Distinct (source, target, predicate) of both, an old embedding kept, a missing one filled in; evidence is appended apart.

    rows: how many there are at most in both; they are counted where that is None.
    """
    keys = ["source", "target", "predicate"]
    both = old.select(*keys, "embedding", F.lit(0).alias("age")).unionByName(new.select(*keys, "embedding", F.lit(1).alias("age")))
    return dealt(both, rows, *keys).groupBy(*keys).agg(F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("age"))).alias("embedding"))


def longer_descriptions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, description): the new description where it is strictly longer, the first longest if there are several (id, ord, description)."""
    best = new.groupBy("id").agg(F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("lw_new"))
    better = F.length("lw_new") > F.coalesce(F.length("description"), F.lit(0))
    return old.join(best, "id", "left").select(*[F.when(better, F.col("lw_new")).otherwise(F.col("description")).alias("description") if c == "description" else F.col(c) for c in old.columns])


def attached(units: DataFrame, sources: DataFrame, new: DataFrame) -> DataFrame:
    """units with confidence raised for new sources (unit_id, source_kind, source_ref) that are independent of those in sources."""
    from .lifecycle import independent_sources

    cols = ["unit_id", "source_kind", "source_ref"]
    before = independent_sources(sources.select(*cols)).withColumnRenamed("n_sources", "n0")
    after = independent_sources(sources.select(*cols).unionByName(new.select(*cols)).distinct()).withColumnRenamed("n_sources", "n1")
    n = after.join(before, "unit_id", "left").select(F.col("unit_id").alias("id"), (F.col("n1") - F.coalesce("n0", F.lit(0))).alias("lw_more"))
    raised = T.evolved_confidence(F.col("confidence"), F.coalesce("lw_more", F.lit(0)))
    return units.join(n, "id", "left").select(*[raised.alias(c) if c == "confidence" else F.col(c) for c in units.columns])


def recalled(units: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """units with recall_count one higher and last_recalled_at set for ids (id)."""
    hit = ids.select("id").distinct().withColumn("lw_hit", F.lit(True))
    df = units.join(hit, "id", "left")
    count = (F.coalesce("recall_count", F.lit(0)) + F.coalesce(F.col("lw_hit").cast("int"), F.lit(0))).alias("recall_count")
    when = F.when(F.col("lw_hit"), F.lit(at)).otherwise(F.col("last_recalled_at")).alias("last_recalled_at")
    return df.select(*[count if c == "recall_count" else when if c == "last_recalled_at" else F.col(c) for c in units.columns])


def resolved(specs: DataFrame, entities: DataFrame, aliases: DataFrame, first_id: int, threshold: float = 0.85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new entities, new aliases, (ord, entity_id) of every spec) for specs (ord, name, type, description, embedding), ord from 1.

    A name whose alias is known is that entity. Else the nearest entity of the
    type above the threshold takes the name as a further alias, be it old or
    one that an earlier spec has made; else the spec makes an entity.
    """
    from . import graph

    top = shared_dir(specs.sparkSession)
    met = written(graph.by_alias(specs, aliases), f"{top}/met")
    open_ = met.where("entity_id IS NULL").drop("entity_id")
    known = entities.where("embedding IS NOT NULL").select((F.col("id") - F.lit(1 << 40)).alias("ord"), "type", "embedding")  # before all specs, in order of their ids
    led = written(graph.resolve(open_.select("ord", "name", "type", "embedding"), threshold, known), f"{top}/led")
    makers = led.where("leader_ord > 0").select(F.col("leader_ord").alias("ord")).distinct()
    made = numbered(open_.join(makers, "ord", "left_semi"), F.col("ord"), start=first_id - 1)
    made = written(made.select("id", F.trim("name").alias("canonical_name"), "type", "description", "embedding", "ord"), f"{top}/made")
    of = led.join(made.select(F.col("ord").alias("leader_ord"), "id"), "leader_ord", "left").select("ord", "name", F.when(F.col("leader_ord") > 0, F.col("id")).otherwise(F.col("leader_ord") + (1 << 40)).alias("entity_id"))
    new_aliases = of.groupBy(T.normalize_name(F.col("name")).alias("alias")).agg(F.min("entity_id").alias("entity_id"))
    every = met.where("entity_id IS NOT NULL").select("ord", "entity_id").unionByName(of.select("ord", "entity_id"))
    return made.drop("ord"), new_aliases, every


def invalid_graphs(graphs: DataFrame) -> DataFrame:
    """(doc_id, reason) of graphs that can't be taken: no JSON object, labels or types of units outside the closed sets, nameless entities, relations without an end."""
    from .lifecycle import ALL_LABELS, UNIT_TYPES

    g = F.col("graph")
    lacks = lambda c, *names: F.exists(c, lambda x: F.exists(F.array(*[x[n] for n in names]), lambda v: ~T.has_text(v)))
    rows = F.array(
        F.when(g.isNull() | (g["entities"].isNull() & g["relations"].isNull() & g["units"].isNull()), "not a graph"), F.when(lacks(g["entities"], "name"), "an entity has no name"),
        F.when(lacks(g["relations"], "source", "target", "predicate"), "a relation has no end or predicate"), F.when(F.exists(g["units"], lambda u: ~u["unit_type"].isin(*UNIT_TYPES)), "unknown unit type"),
        F.when(F.exists(g["units"], lambda u: F.exists(F.coalesce(u["labels"], F.array().cast("array<string>")), lambda x: ~x.isin(*ALL_LABELS))), "unknown label"),
    )
    return graphs.select("doc_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("reason"))


def ingested(docs: DataFrame, extract: Callable[[str], dict]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Graph tables of docs (id, content) by a pluggable extractor, and the rows it failed on."""
    got = chunk.extracted(docs, extract)
    empty = "cast(null AS array<struct<unit_type:string,title:string,content:string,context:string,why:string,how_to_apply:string,next_step:string,labels:array<string>>>)"
    graphs = got.where("error IS NULL").select(F.col("id").alias("doc_id"), F.struct("entities", "relations", F.expr(empty).alias("units")).alias("graph"))
    return graph_tables(graphs), got.where("error IS NOT NULL").select("id", "error")


#: What to ask a model for, by purpose; the reply is a graph in JSON.
PROMPTS = {
    "entities": "List the entities and the relations between them that this text states. Reply with JSON: entities (name, type, description) and relations (source, target, predicate).\n\n{text}",
    "query": "List the names of the entities that this question is about, as a JSON array of strings.\n\n{text}",
    "units": "List what is worth remembering from this text. Reply with JSON: units (unit_type, title, content, context, why, how_to_apply, next_step, labels).\n\n{text}",
}


def prompt(purpose: str, text: str) -> str:
    if purpose not in PROMPTS:
        raise ValueError(f"unknown purpose {purpose!r}; there are {', '.join(PROMPTS)}")
    return PROMPTS[purpose].format(text=text)
