"""Evaluation as queries: keyword hits, gold rows, gate metrics, comparator agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answerable(gold: DataFrame, files: list[str]) -> DataFrame:
    """Gold rows whose source files are all there."""
    return gold.where(F.forall("source", lambda s: s.isin(files)))


def keyword_hits(answers: DataFrame) -> DataFrame:
    """category (``all`` for the total), n, hits, hit_rate, mean_tokens of answers (category, expected_keywords, output, tokens)."""
    hit = F.forall("expected_keywords", lambda k: F.contains(F.lower("output"), F.lower(k)))
    rows = answers.withColumn("hit", hit.cast("int")).rollup("category")
    rows = rows.agg(F.grouping("category").alias("g"), F.count("*").alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("hit_rate"), F.avg("tokens").alias("mean_tokens"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n", "hits", "hit_rate", "mean_tokens")


def gate_metrics(rows: DataFrame) -> DataFrame:
    """precision, recall, type_accuracy, duplicate_rate of rows (predicted, gold booleans, predicted_type, gold_type, title)."""
    both = F.col("predicted") & F.col("gold")
    tp, p, g = F.count_if(both), F.count_if("predicted"), F.count_if("gold")
    titles = F.countDistinct(F.when(F.col("predicted"), F.lower("title")))
    return rows.agg(
        F.when(p > 0, tp / p).otherwise(1.0).alias("precision"), F.when(g > 0, tp / g).otherwise(1.0).alias("recall"),
        F.when(tp > 0, F.count_if(both & (F.col("predicted_type") == F.col("gold_type"))) / tp).otherwise(1.0).alias("type_accuracy"), F.when(p > 0, 1 - titles / p).otherwise(0.0).alias("duplicate_rate"),
    )


def agreement(cases: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n and agreement of cases (score, human_keeps): how often keeping what scores the threshold or more is what people did."""
    return cases.agg(F.count("*").alias("n"), F.avg(((F.col("score") >= threshold) == F.col("human_keeps")).cast("int")).alias("agreement"))
