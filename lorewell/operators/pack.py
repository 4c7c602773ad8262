"""Packing into a token budget, as folds over sorted arrays: one row per question, no driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy(items: Column, budget: Column, cost: str = "cost") -> Column:
    """Skip-and-continue admission: the struct (left, admitted), admitted being the positions (from 0) of items that fit in turn."""

    def step(acc: Column, x: Column) -> Column:
        fits = x[cost] <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - x[cost]).otherwise(acc["left"]).alias("left"), (acc["at"] + 1).alias("at"),
            F.when(fits, F.concat(acc["admitted"], F.array(acc["at"]))).otherwise(acc["admitted"]).alias("admitted"),
        )

    start = F.struct(budget.cast("long").alias("left"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("admitted"))
    return F.aggregate(items, start, step, lambda a: F.struct(a["left"].alias("left"), a["admitted"].alias("admitted")))


def packed(rows: DataFrame, budget: int, by: list[str], rank: str = "rank", cost: str = "cost") -> DataFrame:
    """rows with admitted: per group, in order of rank, each row whose cost fits what is left of the budget."""
    own = [c for c in rows.columns if c not in by]
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("lw_rank"), F.col(cost).cast("long").alias("lw_cost"), *own))).alias("items"))
    lists = lists.withColumn("fold", greedy(F.col("items"), F.lit(budget), "lw_cost"))
    flat = lists.select(*by, F.posexplode("items").alias("at", "item"), F.col("fold.admitted").alias("taken"))
    return flat.select(*by, *[F.col(f"item.{c}").alias(c) for c in own], F.array_contains("taken", F.col("at")).alias("admitted"))


def prefix_packed(rows: DataFrame, budget: int, by: list[str], *order: Column, cost: str = "cost") -> DataFrame:
    """rows with admitted: the longest prefix whose running cost is within the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("admitted", F.sum(cost).over(w) <= budget)


def fused(triples: Column, chunks: Column, budget: int, share: float = 0.4, top_evidence: int = 3) -> Column:
    """Three passes over one budget: triples with evidence, chunks, triples again.

    triples: array of structs with cost and evidence (array of structs with
    doc_id and cost); chunks: array of structs with doc_id and cost; both best
    first. Pass 1 has the budget less the share reserved for chunks, and
    charges the evidence of the first ``top_evidence`` triples as it goes; pass
    2 has the reserve and what is left, and skips documents shown as evidence;
    pass 3 fills in triples without evidence. Returns a struct of positions
    (triples, backfill, chunks), evidence document ids and the tokens used.
    """
    reserve = int(budget * share)
    ints, longs = F.array().cast("array<int>"), F.array().cast("array<long>")

    def with_evidence(acc: Column, t: Column) -> Column:
        fits = t["cost"] <= acc["left"]
        after = F.struct((acc["left"] - t["cost"]).alias("left"), acc["docs"].alias("docs"))

        def show(a: Column, e: Column) -> Column:
            ok = e["cost"] <= a["left"]
            return F.struct(F.when(ok, a["left"] - e["cost"]).otherwise(a["left"]).alias("left"), F.when(ok, F.concat(a["docs"], F.array(e["doc_id"]))).otherwise(a["docs"]).alias("docs"))

        shown = F.when(acc["at"] < top_evidence, F.aggregate(t["evidence"], after, show)).otherwise(after)
        return F.struct(
            F.when(fits, shown["left"]).otherwise(acc["left"]).alias("left"), (acc["at"] + 1).alias("at"),
            F.when(fits, F.concat(acc["admitted"], F.array(acc["at"]))).otherwise(acc["admitted"]).alias("admitted"),
            F.when(fits, shown["docs"]).otherwise(acc["docs"]).alias("docs"),
        )

    first = F.aggregate(triples, F.struct(F.lit(budget - reserve).cast("long").alias("left"), F.lit(0).alias("at"), ints.alias("admitted"), longs.alias("docs")), with_evidence)

    def second(one: Column) -> Column:
        cost = F.transform(chunks, lambda c: F.struct(F.when(F.array_contains(one["docs"], c["doc_id"]), F.lit(1 << 62)).otherwise(c["cost"]).cast("long").alias("cost")))
        return F.struct(one.alias("one"), greedy(cost, one["left"] + reserve).alias("two"))

    def third(s: Column) -> Column:
        cost = F.transform(triples, lambda t, i: F.struct(F.when(F.array_contains(s["one"]["admitted"], i), F.lit(1 << 62)).otherwise(t["cost"]).cast("long").alias("cost")))
        back = greedy(cost, s["two"]["left"])
        return F.element_at(
            F.transform(F.array(back), lambda b: F.struct(s["one"]["admitted"].alias("triples"), b["admitted"].alias("backfill"), s["two"]["admitted"].alias("chunks"), s["one"]["docs"].alias("evidence"), (F.lit(budget) - b["left"]).alias("used"))), 1
        )

    steps = F.transform(F.array(first), second)
    return F.element_at(F.transform(steps, third), 1)


def subject_lines(rows: DataFrame, by: list[str]) -> DataFrame:
    """Admitted triples as one line per subject, ``subject: predicate object | ...``, in order of admission (column pos)."""
    parts = F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(" ", "predicate", "object").alias("part"))))
    lines = rows.groupBy(*by, "subject").agg(F.min("pos").alias("pos"), parts.alias("parts"))
    return lines.select(*by, "pos", F.concat(F.col("subject"), F.lit(": "), F.array_join(F.transform("parts", lambda p: p["part"]), " | ")).alias("line"))


def partition_budget(budget: int, memory_share: float, memory_used: int) -> tuple[int, int]:
    """(allowance of the memory section, what is left for the rest)."""
    allowance = int(budget * memory_share)
    return allowance, budget - min(memory_used, allowance)


def footer(shown: int, total: int, used: int, budget: int, chunks: tuple[int, int] | None = None) -> str:
    """The line that says how much of what was found is shown."""
    cut = shown < total or (chunks is not None and chunks[0] < chunks[1])
    middle = f", {chunks[0]}/{chunks[1]} FTS chunks" if chunks else ""
    return f"(returned {shown}/{total} triples{middle}, ~{used:,}/{budget:,} tokens{'; raise --budget for more)' if cut else ')'}"


def pending_note(pending: int) -> str:
    """A line for what is still queued, empty if nothing is."""
    return f"({pending} queued documents are not searchable yet)" if pending else ""
