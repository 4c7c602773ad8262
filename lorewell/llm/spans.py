"""Places of regular expression matches in whole texts, with DataFrame functions only.

Java's split() and its find() see the same matches, so the pieces between
matches and the matches themselves give every match's place by a running sum
of lengths. Texts without a match are told apart by one search.

Patterns avoid what makes a backtracking engine slow or deep on long texts:
quantified groups are possessive, and a run of characters is entered only at
its first character or where the last match ended (``\\G``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,end:int,kind:string,match:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


#: Matches that one fold gathers; a fold copies what it has gathered at each step.
BLOCK = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column], Column]) -> Column:
    """Array of matches for which keep(match) holds: start and end in code points (end exclusive), rank, kind, match.

    Places are counted within blocks of matches, and the blocks are then put
    one after the other, so a text with very many matches is no quadratic fold.
    """
    cut = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda before, match: F.struct(F.length(before).alias("gap"), match.alias("match")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"))
        good = x["match"].isNotNull() & keep(F.coalesce(x["match"], F.lit("")))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    empty = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))

    def moved(found: Column, by: Column) -> Column:
        return F.transform(found, lambda s: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["match"].alias("match")))

    def joined(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["found"], F.array(moved(x["found"], acc["at"]))).alias("found"))

    def blocks(c: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(c), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(c, i, BLOCK), empty, step))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("found")), joined, lambda a: F.flatten(a["found"]))

    return F.when(text.rlike(pattern), once(cut, blocks)).otherwise(no_spans())


def listed(found: Column) -> Column:
    """kind:start:end of each span by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def table(values: Sequence[float]) -> Column:
    """A constant array of doubles that the optimizer folds into one literal."""
    joined = ",".join(repr(round(float(v), 6)) for v in values)
    return F.expr(f"cast(split('{joined}', ',') as array<double>)")


def without_overlaps(found: Column, score: str = "score") -> Column:
    """Of spans in order of start that overlap, the one with the highest score (the earlier, if equal)."""

    def step(acc: Column, x: Column) -> Column:
        clear = (F.size(acc) == 0) | (F.get(acc, F.size(acc) - 1)["end"] <= x["start"])
        return F.when(clear, F.concat(acc, F.array(x))).when(F.get(acc, F.size(acc) - 1)[score] >= x[score], acc).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x)))

    return F.aggregate(F.array_sort(found), F.filter(found, lambda x: F.lit(False)), step)
