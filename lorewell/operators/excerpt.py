"""Excerpts of long texts around what was asked for, as arithmetic on the places of its words."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What ends a sentence or line in CJK text, and the mark of a current phase.
SENTENCE_ENDS, PHASE_ASKED, PHASE_SAID, PHASE_BONUS = "[\n。；;]", "当前阶段", "current phase", 12


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _gaps(text: Column, pattern: str) -> Column:
    """Lengths of what lies between the places at which a zero-width pattern matches, the first one more by one."""
    return F.transform(F.split(F.concat(F.lit("\n"), text), pattern, -1), lambda p: F.length(p))


def places(docs: DataFrame, terms: Sequence[str], text: str) -> DataFrame:
    """(id, total, term, size, at) for each place of each term (its number and length) in the text, total characters long."""
    each = F.array(*[F.struct(F.lit(k).alias("term"), F.lit(len(t)).alias("size"), _gaps(F.col(text), rf"(?=\Q{t}\E)").alias("gaps")) for k, t in enumerate(terms)])
    rows = docs.select("id", F.length(text).alias("total"), F.explode(each).alias("e")).where(F.size("e.gaps") > 1)
    rows = rows.select("id", "total", "e.term", "e.size", F.size("e.gaps").alias("n"), F.posexplode("e.gaps").alias("i", "gap"))
    up_to = Window.partitionBy("id", "term").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("at", F.sum("gap").over(up_to) - 1).where("i < n - 1").select("id", "total", "term", "size", "at")


def lexical(docs: DataFrame, anchors: Sequence[str], threshold: int = 700, before: int = 320, after: int = 680, windows: int = 2) -> DataFrame:
    """(id, excerpt) of docs (id, content), ids distinct: a long text cut to windows around anchor words.

    Each place of an anchor makes a window; the one that holds most anchors
    comes first, the earliest if several do, then such that add an anchor.
    Windows that meet are joined. Texts of threshold tokens or fewer, and those
    without an anchor, stay as they are; null is empty. An anchor that overlaps
    itself has a window at each of its places. Places are rows, so a text's
    length costs no more than in proportion.
    """
    base = docs.select("id", F.coalesce("content", F.lit("")).alias("content"))
    if not anchors:
        return base.select("id", F.col("content").alias("excerpt"))
    found = places(base.where(T.est_tokens(F.col("content")) > threshold).withColumn("low", F.lower("content")), anchors, "low")
    start, end = F.greatest(F.col("at") - before, F.lit(0)), F.least(F.col("total"), F.col("at") + F.col("size") + after)
    around = Window.partitionBy("id").orderBy("at").rangeBetween(-before, after + max(map(len, anchors)))
    w = found.withColumn("start", start).withColumn("end", end).withColumn("near", F.collect_list(F.struct("term", "at", "size")).over(around))
    inside = F.filter("near", lambda o: (o["at"] >= F.col("start")) & (o["at"] + o["size"] <= F.col("end")))
    w = w.withColumn("has", F.array_distinct(F.transform(inside, lambda o: o["term"])))
    w = w.select("id", F.struct((-F.size("has")).alias("few"), "start", "term", "at", "end", "has").alias("w"))
    span = lambda c: F.struct(F.col(f"{c}.start").alias("start"), F.col(f"{c}.end").alias("end"))
    chosen = w.groupBy("id").agg(F.min("w").alias("b")).select("id", F.array(span("b")).alias("spans"), F.col("b.has").alias("seen"))
    for _ in range(windows - 1):
        more = w.join(chosen, "id").where(F.size(F.array_except("w.has", "seen")) > 0).groupBy("id").agg(F.min("w").alias("b"))
        chosen = chosen.join(more, "id", "left").select(
            "id", F.when(F.col("b").isNotNull(), F.concat("spans", F.array(span("b")))).otherwise(F.col("spans")).alias("spans"), F.coalesce(F.array_union("seen", "b.has"), F.col("seen")).alias("seen")
        )

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["end"], wider).otherwise(F.concat(acc, F.array(s)))

    spans = F.aggregate(F.array_sort("spans"), F.filter("spans", lambda s: F.lit(False)), join)
    parts = F.transform(spans, lambda s: stripped(F.substring(F.col("content"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    out = base.join(chosen, "id", "left")
    return out.select("id", F.when(F.col("spans").isNull(), F.col("content")).otherwise(F.concat(F.lit("[excerpt]\n"), F.array_join(parts, "\n...\n"))).alias("excerpt"))


def cjk_anchors(question: str, least: int = 2, longest: int = 4, most: int = 96) -> list[str]:
    """n-grams of each run of CJK characters, longest first, once each in order."""
    runs = re.findall("[㐀-鿿]+", question)
    return list(dict.fromkeys(r[i : i + k] for r in runs for k in range(longest, least - 1, -1) for i in range(len(r) - k + 1)))[:most]


def _summed(gaps: Column) -> Column:
    """Places from the lengths between them, as numbers from 0; the last length leads to the end and is none."""
    step = lambda a, g: F.struct((a["sum"] + g).alias("sum"), F.concat(a["at"], F.array(a["sum"] + g)).alias("at"))
    start = F.struct(F.lit(-1).alias("sum"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), start, step, lambda a: a["at"])


def cjk(docs: DataFrame, question: str, before: int = 80, after: int = 260) -> DataFrame:
    """(id, excerpt) of docs (id, content): of a text, trimmed, the sentences around the question's n-grams that say most, if that is shorter.

    A window around a place is widened to whole sentences. Its score is the
    length of the n-grams in it that are part of no longer one there. The best
    window is taken, the earliest if several are, and the next best apart from
    it if it has another n-gram or half the score. All of it is one projection
    of columns, meant for chunks: work grows with places times sentences.
    """
    terms = cjk_anchors(question)
    base = docs.select("id", stripped(F.coalesce("content", F.lit(""))).alias("text"))
    if not terms:
        return base.select("id", F.col("text").alias("excerpt"))
    t, known = F.col("text"), F.array(*map(F.lit, terms))
    base = base.withColumn("total", F.length(t)).withColumn("ends", _summed(_gaps(t, f"(?={SENTENCE_ENDS})")))
    each = [F.transform(_summed(_gaps(t, rf"(?=\Q{x}\E)")), lambda p: F.struct(p.alias("at"), F.lit(0).alias("extra"))) for x in terms]
    if PHASE_ASKED in question:
        said = F.instr(F.lower(t), PHASE_SAID)
        each.insert(0, F.when(said > 0, F.array(F.struct((said - 1).alias("at"), F.lit(PHASE_BONUS).alias("extra")))).otherwise(F.array().cast("array<struct<at:int,extra:int>>")))

    def window(p: Column, n: Column) -> Column:
        a, b = F.greatest(p["at"] - before, F.lit(0)), F.least(F.col("total"), p["at"] + after)
        left, right = F.array_max(F.filter("ends", lambda e: e < a)), F.array_min(F.filter("ends", lambda e: e >= b))
        return F.struct(F.coalesce(left + 1, a).alias("start"), F.coalesce(right + 1, b).alias("end"), p["extra"].alias("extra"), n.alias("n"))

    def scored(w: Column) -> Column:
        part = F.substring(t, w["start"] + 1, w["end"] - w["start"])
        return F.struct((-(T.maximal_match_score(part, known) + w["extra"])).alias("minus"), w["start"].alias("start"), w["n"].alias("n"), w["end"].alias("end"), F.filter(known, lambda x: F.contains(part, x)).alias("has"))

    df = base.withColumn("windows", F.transform(F.concat(*each), window)).withColumn("windows", F.transform("windows", scored))
    df = df.withColumn("one", F.array_min("windows"))
    one = F.col("one")
    apart = F.filter("windows", lambda w: ((w["end"] <= one["start"]) | (w["start"] >= one["end"])) & ((F.size(F.array_except(w["has"], one["has"])) > 0) | (w["minus"] * 2 <= one["minus"])))
    df = df.withColumn("two", F.array_min(apart))
    span = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.start").alias("start"), F.col(f"{c}.end").alias("end")))
    spans = F.array_sort(F.filter(F.array(span("one"), span("two")), lambda s: s.isNotNull()))

    def shown(s: Column) -> Column:
        part = stripped(F.substring(t, s["start"] + 1, s["end"] - s["start"]))
        return F.concat(F.when(s["start"] > 0, "...").otherwise(""), part, F.when(s["end"] < F.col("total"), "...").otherwise(""))

    df = df.withColumn("out", F.concat(F.lit("\n\n[excerpt]\n"), F.array_join(F.transform(spans, shown), "\n\n...\n\n")))
    shorter = one.isNotNull() & (T.est_tokens(F.col("out")) < T.est_tokens(t))
    return df.select("id", F.when(shorter, F.col("out")).otherwise(t).alias("excerpt"))
