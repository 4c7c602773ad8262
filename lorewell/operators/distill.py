"""Workflow distillation: memory units grouped by shared tokens into candidates for scripts, commands and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import shared_dir, written
from . import blocks
from .components import components as connected
from .lifecycle import confirmed

# Thresholds and words that name a form.
GROUP_OVERLAP, EVIDENCE, ASSET_OVERLAP = 0.35, 2, 0.40
SCRIPT = ("check", "checks", "migration", "migrations", "script", "test", "tests", "verify")
COMMAND = ("cli", "command", "commands")
SKILL = ("agent", "agents", "workflow", "workflows", "reuse", "reusable")


def links(units: DataFrame, least: float = GROUP_OVERLAP) -> DataFrame:
    """Pairs (a, b) of units (id, tokens) that connect whatever units whose token sets overlap by at least ``least`` of the smaller set connect.

    Every pair is compared, by counts of shared tokens between blocks of units;
    of the links between two blocks a spanning forest goes on, so there are at
    most as many rows as units for each pair of blocks.
    """
    units = written(units.select("id", "tokens"), f"{shared_dir(units.sparkSession)}/tokens")
    each = units.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    codes = blocks.coded(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token"))
    rows = each.join(codes, "token").groupBy("id", "n").agg(F.collect_list("code").alias("codes"))

    def forest(x, y):
        import numpy as np
        import pandas as pd

        right, n_y, id_x, id_y = blocks.Block(y["codes"], kind="float32"), y["n"].to_numpy(), x["id"].to_numpy(), y["id"].to_numpy()
        group, out = np.arange(len(y)), []
        for k, shared in right.scores(x["codes"]):
            smaller = np.minimum(x["n"].to_numpy()[k : k + len(shared), None], n_y)
            hits = (shared.astype("float64") / smaller >= least) & (id_x[k : k + len(shared), None] != id_y)
            for i in np.flatnonzero(hits.any(axis=1)):
                at = np.flatnonzero(hits[i])
                first = np.full(len(y), -1)
                first[group[at]] = at
                met = np.flatnonzero(first >= 0)
                out.append((np.full(len(met), id_x[k + i]), id_y[first[met]]))
                if len(met) > 1:
                    group = np.where(first[group] >= 0, met[0], group)
        a, b = (np.concatenate(z) for z in zip(*out)) if out else ([], [])
        return pd.DataFrame({"a": a, "b": b})

    return blocks.across(rows, rows, forest, "a long, b long", upper=True)


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root) of nodes (id): the smallest id reachable over pairs (a, b), a node's own if it has none."""
    roots = connected(pairs, shared_dir(nodes.sparkSession))
    return nodes.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))


def form(kinds: Column, hit) -> Column:
    """The recommended form of a group with these unit types; hit(words): whether it has any of the words."""
    procedure = F.array_contains(kinds, "procedure")
    return (
        F.when(procedure & hit(SCRIPT), "script").when(procedure & hit(COMMAND), "command").when((F.size(kinds) == 1) & F.array_contains(kinds, "learning"), "convention_doc")
        .when(hit(SKILL) | (F.size(kinds) > 1), "skill_file").when(procedure, "command").otherwise("convention_doc")
    )


def candidates(units: DataFrame, sources: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Groups of units worth distilling: root, n_units, evidence, recalls, recommended_form, members, covered_by.

    units: id, title, content, context, unit_type, sources, recall_count;
    sources: unit_id, source_kind, source_ref; assets: form, name, path.
    """
    from .lifecycle import independent_sources

    body = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "content", "context")])
    t = units.withColumn("tokens", T.distill_tokens(body)).withColumn("confirmed", confirmed()).withColumn("title_tokens", T.distill_tokens(F.coalesce("title", F.lit(""))))
    roots = components(t, links(t.where(F.size("tokens") > 0)))
    t = written(t.join(roots, "id").select("root", "id", "unit_type", "recall_count", "confirmed", "tokens", "title_tokens"), f"{shared_dir(units.sparkSession)}/grouped")
    n = independent_sources(sources.join(roots.withColumnRenamed("id", "unit_id"), "unit_id"), "root")
    told = {"lw_script": SCRIPT, "lw_command": COMMAND, "lw_skill": SKILL}
    grouped = t.groupBy("root").agg(
        F.count("*").alias("n_units"), F.sum("recall_count").alias("recalls"), F.max("confirmed").alias("confirmed"), F.sort_array(F.collect_set("unit_type")).alias("kinds"),
        F.sort_array(F.collect_list("id")).alias("members"), *[F.max(F.arrays_overlap("tokens", F.array(*map(F.lit, words)))).alias(n) for n, words in told.items()],
    )
    g = grouped.join(n, "root", "left").withColumn("evidence", F.coalesce("n_sources", F.lit(0))).where((F.col("evidence") >= EVIDENCE) | F.col("confirmed"))
    g = g.withColumn("recommended_form", form(F.col("kinds"), lambda words: F.col(next(n for n, w in told.items() if w == words))))
    if assets is None:
        g = g.withColumn("covered_by", F.lit(None).cast("string"))
    else:
        # A group's words as rows: one group can hold most of the units.
        titles = t.select("root", F.explode("title_tokens").alias("token")).distinct()
        n_titles = titles.groupBy("root").agg(F.count("*").alias("n_titles"))
        a = assets.select(F.col("form").alias("recommended_form"), "path", T.distill_tokens(F.col("name")).alias("name_tokens")).distinct()
        a = a.select("recommended_form", "path", "name_tokens", F.size("name_tokens").alias("n_name"), F.explode("name_tokens").alias("token"))
        met = titles.join(F.broadcast(a), "token").groupBy("root", "recommended_form", "path", "name_tokens", "n_name").agg(F.count("*").alias("shared"))
        hit = met.join(n_titles, "root").where(F.col("shared") / F.least("n_titles", "n_name") >= ASSET_OVERLAP).groupBy("root", "recommended_form").agg(F.min("path").alias("covered_by"))
        g = g.join(hit, ["root", "recommended_form"], "left")
    return g.select("root", "n_units", "evidence", "recalls", "recommended_form", "members", "covered_by")
