"""Snapshot tables: written results, ids in a fixed order, upserts as full outer joins."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: So many rows a task sorts or groups where rows are dealt by their number: its memory stays the same, there are more tasks.
ROWS = 1 << 19


def tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks so many rows are dealt to: the session's, or more."""
    return max(-(-rows // ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df dealt by its keys to tasks of about ROWS rows, so that a join or a group by these keys sorts no more in one task; few rows stay as they are.

    rows: how many there are at most; they are counted where it is None.
    """
    rows = df.count() if rows is None else rows
    return df if rows <= ROWS else df.repartition(tasks(df.sparkSession, rows), *keys)


def few(df: DataFrame) -> bool:
    """Whether df has at most as many rows as one task takes, so that each task of a join can have all of them."""
    return df.count() <= ROWS


def shared_dir(spark: SparkSession) -> str:
    """The qualified path of a new folder under spark.checkpoint.dir.

    Where that is unset, a folder of this machine is taken and set, which is
    right only if driver and executors are one process: any other master is
    refused with ValueError.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        top = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(top)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/lorewell-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table in a shared folder: lineage is cut and lost executors lose nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column, start: int = 0, name: str = "id", rows: int | None = None) -> DataFrame:
    """Ids from start + 1 on in a fixed order, without one task that sorts all rows.

    Rows are range-partitioned and sorted; each partition's first number is
    the sum of the sizes before it (one row per partition). Where it is known
    how many rows there are at most, they go to partitions of about ROWS.
    """
    top = shared_dir(df.sparkSession)
    by = order if rows is None or rows <= ROWS else (tasks(df.sparkSession, rows), *order)
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*order)
    own = written(ranged.withColumn("lw_p", F.spark_partition_id()).withColumn("lw_m", F.monotonically_increasing_id()), f"{top}/ranged")
    sizes = own.groupBy("lw_p").agg(F.count("*").alias("n"), F.min("lw_m").alias("lw_first"))
    before = sizes.withColumn("lw_before", F.sum("n").over(Window.orderBy("lw_p")) - F.col("n")).drop("n")
    out = own.join(F.broadcast(before), "lw_p")  # one row per partition
    return out.withColumn(name, F.col("lw_m") - F.col("lw_first") + F.col("lw_before") + start + 1).drop("lw_p", "lw_m", "lw_first", "lw_before")


def running(df: DataFrame, *order: Column, **sums: str) -> DataFrame:
    """df with columns of sums over all rows before a row in the order (0.0 for the first): ``running(df, col("x"), before="n")``.

    Like numbered(): ranges of rows are summed by themselves, and a range's
    start is the sum of the ranges before it (one row per partition).
    """
    top = shared_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = written(ranged.withColumn("lw_p", F.spark_partition_id()).withColumn("lw_m", F.monotonically_increasing_id()), f"{top}/ranged")
    whole = own.groupBy("lw_p").agg(*[F.sum(F.col(c).cast("double")).alias(f"lw_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("lw_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("lw_p", *[F.coalesce(F.sum(f"lw_{n}").over(earlier), F.lit(0.0)).alias(f"lw_{n}") for n in sums])
    inner = Window.partitionBy("lw_p").orderBy("lw_m").rowsBetween(Window.unboundedPreceding, -1)
    out = own.join(F.broadcast(starts), "lw_p")  # one row per partition
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"lw_{n}") + F.coalesce(F.sum(F.col(c).cast("double")).over(inner), F.lit(0.0)))
    return out.drop("lw_p", "lw_m", *[f"lw_{n}" for n in sums])


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old_if_null: Sequence[str] = (), keep_old: Sequence[str] = ()) -> DataFrame:
    """The next snapshot: rows of new replace those of old with the same keys, others stay.

    Columns of keep_old_if_null keep the old value where the new one is null;
    those of keep_old keep it wherever there is one.
    """
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("lw_old"))
    b = new.select(*keys, F.struct(*rest).alias("lw_new"))

    def value(c: str) -> Column:
        o, n = F.col(f"lw_old.{c}"), F.col(f"lw_new.{c}")
        if c in keep_old:
            return F.coalesce(o, n)
        if c in keep_old_if_null:
            return F.coalesce(n, o)
        return F.when(F.col("lw_new").isNotNull(), n).otherwise(o)

    return a.join(b, list(keys), "full_outer").select(*keys, *[value(c).alias(c) for c in rest])


def embedder_matches(meta: dict[str, str], model: str, dim: int) -> None:
    """Raise ValueError if stored vectors were made by another model or have another length."""
    if meta and (meta.get("embedding_model"), meta.get("embedding_dim")) != (model, str(dim)):
        raise ValueError(f"stored embeddings are {meta.get('embedding_model')} of {meta.get('embedding_dim')}, not {model} of {dim}")
