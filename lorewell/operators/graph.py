"""The knowledge graph: aliases, entity resolution, neighbours, bounded traversal, supersession, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, norm, normalize_name
from ..tables import dealt, few, shared_dir, written

#: The graph's defaults.
HOP_DECAY, ALPHA, DISAMBIGUATION = 0.7, 0.6, 0.85


def by_alias(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """names with the entity_id of their normalised alias (null without one)."""
    known = aliases.select(normalize_name(F.col("alias")).alias("lw_alias"), "entity_id").dropDuplicates(["lw_alias"])
    return names.join(known, normalize_name(F.col(name)) == F.col("lw_alias"), "left").drop("lw_alias")


def nearest(queries: DataFrame, entities: DataFrame, threshold: float = DISAMBIGUATION, same_type: bool = True, others: bool = False) -> DataFrame:
    """For each query (query_id, type, embedding) the entity (id, type, embedding) of highest cosine above the threshold, the smallest id if equal.

    Within a type it is an equi-join; the queries are the small side. With
    ``others`` a query's own id is no entity of its.
    """
    own = norm(F.col("embedding")).alias("norm")  # once for each vector, not for each pair
    e = written(entities.where("embedding IS NOT NULL").select("id", F.col("type").alias("e_type"), F.col("embedding").alias("e_vec"), own.alias("e_norm")), f"{shared_dir(entities.sparkSession)}/entities")
    q = written(queries.where("embedding IS NOT NULL").select("query_id", "type", "embedding", own), f"{shared_dir(queries.sparkSession)}/queries")
    joined = q.join(e, F.col("type") == F.col("e_type")) if same_type else q.join(e, F.size("embedding") == F.size("e_vec"))
    joined = joined.where("query_id <> id") if others else joined
    similarity = cosine(F.col("embedding"), F.col("e_vec"), (F.col("norm"), F.col("e_norm")))
    scored = joined.withColumn("similarity", similarity).where(F.col("similarity") > threshold)
    best = scored.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("id")).alias("neg"))).alias("b"))
    return best.select("query_id", (-F.col("b.neg")).alias("id"), F.col("b.similarity").alias("similarity"))


def resolve(specs: DataFrame, threshold: float = DISAMBIGUATION, known: DataFrame | None = None) -> DataFrame:
    """Find-or-create over specs (ord, name, type, embedding): each spec's leader_ord, the spec that made its entity.

    The first occurrence of a normalised name decides. Then, in order and type
    by type, a name joins the leader of highest cosine above the threshold, or
    leads. known (ord, type, embedding), with numbers below all of specs, are
    leaders from the start. A type's leaders are one matrix in memory, and a
    name is compared with all of them in one product.
    """
    named = specs.withColumn("alias", normalize_name(F.col("name")))
    firsts = named.groupBy("alias").agg(F.min("ord").alias("ord")).join(named.drop("alias"), "ord").select("ord", "alias", "type", "embedding", F.lit(False).alias("leads"))
    if known is not None:
        firsts = firsts.unionByName(known.select("ord", F.lit(None).cast("string").alias("alias"), "type", "embedding", F.lit(True).alias("leads")))

    def lead(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("ord")
        groups: dict[int, list] = {}  # leaders by the length of their vectors: [matrix of unit vectors, how many, their numbers]
        out = []
        for ord_, alias, vec, leads in zip(pdf["ord"], pdf["alias"], pdf["embedding"], pdf["leads"]):
            v = None if vec is None else np.asarray(vec, float)
            size = 0.0 if v is None else float(np.linalg.norm(v))
            leader = ord_
            if size > 0:
                v = v / size
                g = groups.setdefault(len(v), [np.zeros((16, len(v))), 0, []])
                near = g[0][: g[1]] @ v
                at = int(np.argmax(near)) if g[1] else -1
                if not leads and at >= 0 and near[at] > threshold:
                    leader = g[2][at]
                else:
                    if g[1] == len(g[0]):
                        g[0] = np.concatenate((g[0], np.zeros_like(g[0])))
                    g[0][g[1]] = v
                    g[1] += 1
                    g[2].append(ord_)
            if not leads:
                out.append((alias, leader))
        return pd.DataFrame(out, columns=["alias", "leader_ord"])

    led = firsts.groupBy("type").applyInPandas(lead, "alias string, leader_ord long")
    return named.join(led, "alias").select("ord", "name", "type", "leader_ord")


def neighbours(edges: DataFrame, frontier: DataFrame, superseded: bool = False) -> DataFrame:
    """Edges that touch the frontier (id) at either end: two equi-joins, not one join with OR."""
    e = edges if superseded or "superseded_by" not in edges.columns else edges.where("superseded_by IS NULL")
    f = frontier.select("id").distinct()
    return e.join(f, e["source"] == f["id"], "left_semi").unionByName(e.join(f, e["target"] == f["id"], "left_semi")).distinct()


def traverse(edges: DataFrame, seeds: DataFrame, max_hops: int, superseded: bool = False, rows: int | None = None) -> DataFrame:
    """(id, depth) of every entity within max_hops edges of the seeds (id), by levels; each level is written once.

    A level of many entities is joined with edges that are dealt by their
    number. rows: how many edges there are at most; they are counted where it
    is None and such a level is met.
    """
    spark = edges.sparkSession
    e = edges if superseded or "superseded_by" not in edges.columns else edges.where("superseded_by IS NULL")
    both = e.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(e.select(F.col("target").alias("a"), F.col("source").alias("b")))
    top = shared_dir(spark)
    seen = level = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)), f"{top}/0")
    for hop in range(1, max_hops + 1):
        last = level.select("id")
        if few(level):
            last = F.broadcast(last)
        else:
            rows = e.count() if rows is None else rows
            last = dealt(last, 2 * rows, "id").hint("merge")  # the edges are dealt as the level is
        edge_ends = both.join(last, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct()
        new = edge_ends.join(seen, "id", "left_anti").withColumn("depth", F.lit(hop))
        level = written(new, f"{top}/{hop}")
        seen = seen.unionByName(level)
        if level.isEmpty():
            break
    return seen


def triples_within(edges: DataFrame, depths: DataFrame, max_hops: int, rows: int | None = None) -> DataFrame:
    """Edges met by a traversal of max_hops, with hops: the smaller depth of their ends. rows: how many edges there are at most; they are counted where that is None."""
    inner = depths.where(F.col("depth") < max_hops)  # an edge is met from these only
    a, b = inner.select(F.col("id").alias("source"), F.col("depth").alias("d1")), inner.select(F.col("id").alias("target"), F.col("depth").alias("d2"))
    if few(inner):
        near = edges.join(F.broadcast(a), "source", "left").join(F.broadcast(b), "target", "left")
    else:
        rows = edges.count() if rows is None else rows
        near = dealt(dealt(edges, rows, "source").join(a.hint("merge"), "source", "left"), rows, "target").join(b.hint("merge"), "target", "left")
    return near.withColumn("hops", F.least("d1", "d2")).where(F.col("hops") < max_hops).drop("d1", "d2")


def superseded_by(facts: DataFrame) -> DataFrame:
    """(id, superseded_by): the fact with another object, a higher version and, of those, the highest version, then id.

    Facts of one subject, predicate, path and object are first reduced to
    their extremes, so a long history is no quadratic join.
    """
    keys = ["subject", "predicate", "path"]
    f = facts.where("path IS NOT NULL")
    best = f.groupBy(*keys, "object").agg(F.max(F.struct("version", "id")).alias("m"))
    order = Window.partitionBy(*keys).orderBy(F.desc("m"))
    two = best.withColumn("n", F.row_number().over(order)).where("n <= 2")  # the newest object, and the newest other one
    tops = two.groupBy(*keys).agg(F.max(F.when(F.col("n") == 1, F.struct("object", "m"))).alias("one"), F.max(F.when(F.col("n") == 2, F.struct("object", "m"))).alias("two"))
    joined = f.join(tops, keys)
    rival = F.when(F.col("one.object") != F.col("object"), F.col("one.m")).otherwise(F.col("two.m"))
    return joined.withColumn("rival", rival).where(F.col("rival.version") > F.col("version")).select("id", F.col("rival.id").alias("superseded_by"))


def replayed_supersession(facts: DataFrame) -> DataFrame:
    """Ordered form: facts (ord, subject, predicate, object, path, version) asserted one by one; (subject, predicate, object, superseded_by_object).

    Asserting marks active facts of the same subject, predicate and path with
    another object and evidence of a lower version. Asserting a superseded
    fact again doesn't revive it, yet it may still supersede others. So a fact
    is superseded by the first assertion of another object that comes after,
    and is newer than, some evidence of its own. For most evidence that is the
    next assertion of another object; only where that isn't newer are all
    later ones of the path looked at.
    """
    keys = ["subject", "predicate", "path"]
    f = facts.where("path IS NOT NULL AND version IS NOT NULL").select("ord", *keys, "object", "version")
    forward, back = Window.partitionBy(*keys).orderBy("ord"), Window.partitionBy(*keys).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.lag("object").over(forward)
    f = f.withColumn("first", F.when(last.isNull() | (last != F.col("object")), F.struct("ord", "object", "version")))
    f = f.withColumn("next", F.last("first", True).over(back))
    own = Window.partitionBy(*keys, "object").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    low = F.min("version").over(own)
    lows = f.withColumn("low", low).where((F.col("low").isNull() | (F.col("version") < F.col("low"))) & F.col("next").isNotNull())  # others are dominated by these
    cols = ["subject", "predicate", "object"]
    plain = lows.where("next.version > version").select(*cols, F.struct("next.ord", "next.object").alias("by"))
    rest = lows.where("next.version <= version").select(*keys, "object", F.col("ord").alias("e_ord"), F.col("version").alias("e_version"))
    later = f.select(*keys, F.col("ord").alias("a_ord"), F.col("object").alias("a_object"), F.col("version").alias("a_version"))
    hard = rest.join(later, keys).where("a_ord > e_ord AND a_version > e_version AND a_object <> object").select(*cols, F.struct(F.col("a_ord").alias("ord"), F.col("a_object").alias("object")).alias("by"))
    by = plain.unionByName(hard).groupBy(*cols).agg(F.min("by").alias("by"))
    return facts.select(*cols).distinct().join(by, cols, "left").select(*cols, F.col("by.object").alias("superseded_by_object"))


def composite_score(hops: Column, similarity: Column, bm25: Column, decay: float = HOP_DECAY, alpha: float = ALPHA) -> Column:
    """decay ** hops * (alpha * similarity + (1 - alpha) * bm25)."""
    return F.pow(F.lit(decay), hops) * (alpha * similarity + (1 - alpha) * bm25)


def score_order(score: Column, hops: Column, date: Column) -> Sequence[Column]:
    """Best score, then fewest hops, then newest date (none last)."""
    return (F.desc(score), F.asc(hops), F.coalesce(F.translate(date, "0123456789", "9876543210"), F.lit("z")).asc())


def evidence_of(relations: DataFrame, evidence: DataFrame, docs: DataFrame, project: str | None = None, rows: int | None = None) -> DataFrame:
    """(relation_id, doc_id, project, source_path, section, doc_date) of relations (id); with a project only its documents count.

    A relation without any matching document has no row, so it drops out of
    whatever is joined with this. rows: how much evidence there is at most;
    it is counted where that is None.
    """
    rows = evidence.count() if rows is None else rows
    d = docs.select(F.col("id").alias("doc_id"), *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("project", "source_path", "section", "doc_date")])
    if project is not None:
        d = d.where(F.col("project") == project)
    known = dealt(relations.select(F.col("id").alias("relation_id")), rows, "relation_id").distinct()
    of = dealt(evidence, rows, "doc_id").join(d, "doc_id").join(known.hint("merge"), "relation_id")  # numbers pack well: a file that is small enough to be sent about can hold many millions
    return of.select("relation_id", "doc_id", "project", "source_path", "section", "doc_date")


def best_dates(evidence: DataFrame, rows: int | None = None) -> DataFrame:
    """(relation_id, best_date): the latest date of a relation's documents; dates are text. rows: as for evidence_of."""
    return dealt(evidence, rows, "relation_id").groupBy("relation_id").agg(F.max("doc_date").alias("best_date"))


def scored(relations: DataFrame, depths: DataFrame, evidence: DataFrame, bm25: DataFrame, query_vector: Sequence[float] | None, max_hops: int, rows: int | None = None) -> DataFrame:
    """Relations (id, source, target, predicate, embedding) met by a traversal, with hops, similarity, bm25, best_date and score.

    evidence: as from evidence_of; relations without any are left out. bm25:
    (doc_id, score). A relation's best score is scaled over all that are met.
    Without a query vector only BM25 counts; vectors that are missing or of
    another length have no similarity. rows: how many relations and how much
    evidence there are at most; the evidence is counted where that is None.
    """
    top = shared_dir(relations.sparkSession)
    near = written(triples_within(relations, depths, max_hops, rows), f"{top}/near")
    rows = evidence.count() if rows is None else rows
    own = evidence.join(dealt(near.select(F.col("id").alias("relation_id")), rows, "relation_id").hint("merge"), "relation_id", "left_semi")
    both = dealt(dealt(own, rows, "doc_id").join(bm25, "doc_id", "left"), rows, "relation_id")
    best = both.groupBy("relation_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("b"), F.max("doc_date").alias("best_date"))
    near = written(near.join(best.hint("merge"), F.col("id") == F.col("relation_id")).drop("relation_id"), f"{top}/met")
    ends = near.agg(F.min("b").alias("lo"), F.max("b").alias("hi"))  # one row
    near = near.crossJoin(F.broadcast(ends)).withColumn("bm25", F.when(F.col("hi") > F.col("lo"), (F.col("b") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    if query_vector is None:
        near = near.withColumn("similarity", F.lit(0.0))
    else:
        q = F.array(*[F.lit(float(x)) for x in query_vector])
        near = near.withColumn("similarity", F.coalesce((1 + cosine(F.col("embedding"), q)) / 2, F.lit(0.0)))
    score = composite_score(F.col("hops"), F.col("similarity"), F.col("bm25"), alpha=0.0 if query_vector is None else ALPHA)
    return near.withColumn("score", score).drop("b", "lo", "hi")


def prompt_context(triples: Sequence[tuple[str, str, str]], passages: Sequence[str], most: int = 5) -> str:
    """Facts and passages as a block of text for a prompt, with fixed headings."""
    if not triples and not passages:
        return "本地记忆库中没有找到相关背景信息。"
    facts = [f"[{s}] --({p})--> [{o}]" for s, p, o in triples]
    return "\n".join(["【知识拓扑】", *facts, "", "【上下文溯源】", *(f"- {d}" for d in passages[:most])])
