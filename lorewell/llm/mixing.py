"""Operator 2: mixing sources to target weights by cube-method balanced sampling.

A source whose target is m times its size takes each of its documents floor(m)
times, and once more with probability m - floor(m). Which documents those are
is decided by the cube method: the fractional probabilities move along the
null space of the constraints (number of documents, number of words), so both
totals keep their expected values while one probability after another becomes
0 or 1. This flight runs in blocks of documents of bounded size, each leaving
at most two documents undecided; those meet in blocks of the next level, until
one block per source is left. Its last documents land where the word total is
nearest, and a few decisions of that block are reversed if that is nearer yet.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import numbered as ranked
from ..tables import running
from .common import WORD, documents, numbered, pick, shared_dir, written

EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities until at most two are fractional; sums of p and of p * size stay."""
    p = p.astype(float).copy()
    active: list[int] = []
    todo = iter(range(len(p)))
    draw = iter(())
    while True:
        while len(active) < 3:
            k = next((k for k in todo if EPS < p[k] < 1 - EPS), None)
            if k is None:
                break
            active.append(k)
        if len(active) < 2:
            return p
        a, b = active[0], active[1]
        if len(active) == 3:
            c = active[2]
            u = [size[c] - size[b], size[a] - size[c], size[b] - size[a]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif size[a] == size[b]:
            u = [1.0, -1.0]
        else:
            return p
        up = min((1 - p[k]) / v if v > 0 else -p[k] / v for k, v in zip(active, u) if v)
        down = min(p[k] / v if v > 0 else (p[k] - 1) / v for k, v in zip(active, u) if v)
        x = next(draw, None)
        if x is None:
            draw = iter(rng.random(4096).tolist())
            x = next(draw)
        step = up if x * (up + down) < down else -down
        for k, v in zip(active, u):
            q = p[k] + step * v
            p[k] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q
        active = [k for k in active if 0 < p[k] < 1]


def landing(p: np.ndarray, size: np.ndarray, free: np.ndarray, flips: int = 16) -> np.ndarray:
    """Round the few fractional probabilities that are left so that the total of p * size is nearest.

    A long document among them can leave that total far off; then decisions
    on ``free`` documents of this block are reversed, each the one that brings
    the total nearest, while that helps.
    """
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    want = (p[left] * size[left]).sum()
    best = min(product((0, 1), repeat=len(left)), key=lambda z: (abs((np.array(z) * size[left]).sum() - want), z))
    off = (np.array(best) * size[left]).sum() - want
    p[left] = best
    p = np.rint(p)
    for _ in range(flips):
        change = np.where(free, (1 - 2 * p) * size, np.inf)
        k = int(np.argmin(np.abs(off + change))) if len(p) else 0
        if not len(p) or abs(off + change[k]) >= abs(off):
            break
        p[k], off = 1 - p[k], off + change[k]
    return p


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Per source of (source, size): rank, n (documents), source_size, target; sources by code point, null last, get the weights in turn.

    Targets share the total by weight; none exceeds ``most`` times its
    source's size, and the excess goes to the others by weight. The level at
    which the rest stops is found from running sums over the sources in the
    order in which they reach their limits; numbers and sums go by ranges of
    sources, so no task needs all of them.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    s = ranked(s, F.col("source").asc_nulls_last(), name="rank").withColumn("rank", (F.col("rank") - 1).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    s = running(s, F.col("cap") / F.col("weight"), F.col("rank"), caps="cap", shares="weight")
    whole = s.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    s = s.crossJoin(F.broadcast(whole))
    # The level if all sources before this one have stopped and no other has; it rises while that is too few and falls after.
    top = s.agg(F.max((F.col("all_size") - F.col("caps")) / (F.col("all_weight") - F.col("shares"))).alias("level"))  # one row
    s = s.crossJoin(F.broadcast(top))
    return s.select("source", "rank", "n", "source_size", F.least(F.col("level") * F.col("weight"), "cap").alias("target"))


def _level(seed: int, level: int, block: int):
    """The flight of one block of one source, and the landing if it is the source's only one."""

    def run(key, table):
        import pyarrow as pa

        order = np.lexsort([table[c].fill_null(-1).to_numpy() for c in ("lw_row", "size", "doc_id", "order") if c in table.column_names])
        table = table.take(pa.array(order))
        rng = np.random.default_rng([seed, level, int(key[0].as_py()), int(key[1].as_py())])
        size, old, blocks = table["size"].to_numpy().astype(float), table["p"].to_numpy(), table["blocks"][0].as_py()
        p = flight(old, size, rng)
        if blocks == 1:
            p = landing(p, size, (old > EPS) & (old < 1 - EPS))
        after = max(1, -(-blocks * 2 // block))
        new = {"p": pa.array(p), "blocks": pa.array(np.full(len(p), after, np.int64)), "block": pa.array(table["block"].to_numpy() % after)}
        return pa.table([new.get(c, table[c]) for c in table.column_names], names=table.column_names)

    return run


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = 1024, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many times each document is taken: doc_id, size, source_size, target, taken, times.

    size counts the words of the text (null: 0); a null source is a source of
    its own, the last. No document is taken more than three times. The choice
    depends on ids, texts and the seed alone, so reruns agree; rows that
    repeat an id, or have none, are decided one by one and are dealt into
    blocks by their texts, too. Empty
    documents take part in the balance of documents and add no words. An empty
    table gives no rows.
    """
    base = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"), source=(source_col, "string"))
    return _times(base, shared_dir(docs.sparkSession), weights, block, seed)


def _times(base: DataFrame, top: str, weights: tuple[int, ...] = (1, 2, 3), block: int = 1024, seed: int = 20) -> DataFrame:
    """mixture of (doc_id, text, source); a column lw_row goes along and comes last."""
    row = [c for c in base.columns if c == "lw_row"]
    base = written(base.select(*row, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("own")), f"{top}/sizes")
    targets = written(source_targets(base, weights), f"{top}/targets")
    joined = base.join(targets, base["source"].eqNullSafe(targets["source"])).select(*row, "doc_id", "size", "own", "source_size", "target", "rank", "n")
    joined = joined.withColumn("m", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    joined = joined.withColumn("whole", F.floor("m").cast("int")).withColumn("p", F.col("m") - F.col("whole"))
    joined = joined.withColumn("order", F.xxhash64("own", F.lit(seed))).withColumn("blocks", F.ceil(F.col("n") / block))
    state = joined.withColumn("block", F.pmod(F.xxhash64("own", F.lit(seed + 1)), F.col("blocks")))
    blocks = -(-(targets.agg(F.max("n")).first()[0] or 0) // block)  # of the source that has most
    level, decided = 0, []
    schema = "doc_id long, size long, source_size long, target double, rank int, whole int, p double, order long, blocks long, block long" + "".join(f", {c} long" for c in row)
    while True:
        state = state.select(*(c.split()[0] for c in schema.split(", ")))
        state = written(state.groupBy("rank", "block").applyInArrow(_level(seed, level, block), schema), f"{top}/level{level}")
        decided.append(state.where("p = 0 or p = 1"))
        if blocks <= 1:
            break
        state = state.where("p > 0 and p < 1")
        level, blocks = level + 1, max(1, -(-blocks * 2 // block))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    times = (F.col("whole") + F.col("p")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), *row)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row repeated as often as the mixture takes it; all columns stay. Ids may repeat or be null."""
    top = shared_dir(docs.sparkSession)
    rows = numbered(docs, f"{top}/rows")
    base = pick(rows.toDF(*docs.columns, "lw_row"), lw_row=("lw_row", "long"), doc_id=(id_col, "long"), text=(text_col, "string"), source=(source_col, "string"))
    times = _times(base, top, **options).select("lw_row", F.col("times").cast("int").alias("lw_times")).where("lw_times > 0")
    out = rows.join(times, "lw_row").withColumn("lw_times", F.explode(F.sequence(F.lit(1), "lw_times")))
    return out.drop("lw_row", "lw_times").toDF(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))
