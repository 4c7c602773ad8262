"""A small table of awkward documents, and the same with clashing columns."""

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{i % 977} other{i % 13}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "a"), (2, "THE quick brown fox jumps over the lazy dog and runs away", "a"), (3, None, None), (4, "", "b"),
    (5, "   \t\n ", "b"), (6, "one", "b"), (7, "ONE", None), (8, LONG, "a"), (9, LONG + " end", "c"), (None, "no id here at all", "c"), (10, "same row twice in this table", "c"),
    (10, "same row twice in this table", "c"), (11, "Äpfel und Öl <|endoftext|> \U0001f600 ñ", "a"), (12, "äpfel und Öl <|endoftext|> \U0001f600 ñ", "a"),
]


def docs(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string, source string")


def clashing(df: DataFrame) -> DataFrame:
    """More columns, with names that operators use themselves or that differ in case only."""
    names = ["rank", "key", "h", "size", "bands", "n", "label", "TEXT", "Doc_ID", "norm", "score", "block", "start", "length", "base", "found", "blocks", "root", "b", "a", "id", "c0", "c1"]
    return df.selectExpr("*", *[f"'x' AS `{n}`" for n in names if n not in ("TEXT", "Doc_ID")]).toDF(*df.columns, *[n for n in names if n not in ("TEXT", "Doc_ID")])


def empty(spark: SparkSession) -> DataFrame:
    return docs(spark, [])
