"""Operator 8: exact top-k search with multi-resolution segment statistics.

Vectors are cut into segments; with a segment's mean and deviation, the
distance of two vectors is at least the root of sum of
``length * ((difference of means)**2 + (difference of deviations)**2)``, so
their inner product is at most the sum of
``length * (product of means + product of deviations)``. What a query has found
so far rules out candidates whose bound is lower: whole blocks by the ranges of
their statistics, then vectors with few long segments, then with more short
ones; the exact score is computed for those that survive all of them.

Candidates and queries are dealt into blocks of bounded size, neighbours by the
signs of their segments' means and by length. A first pass over one block in
``stride`` gives each query a score that its k-th best can't be below; pairs of
blocks whose bound is below that of all their queries are dropped before any
vector moves. A task takes one block of queries and a group of blocks of
candidates one after the other, and returns at most k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import numbered
from .common import pick, shared_dir, written

#: Segments, coarse to fine.
LEVELS = (4, 16)
#: Queries that are compared with a block at a time.
TILE = 256


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row, means and deviations of its segments, each times the root of the segment's length."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            part = x[:, a:b]
            out += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.column_stack(out)


class Search:
    """A block of queries and the k best candidates so far of each, ties to smaller ids; a query's own id is no candidate."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.least = floor.astype(float)  # scores below can't be among the k best
        self.sides = [statistics(x, s) for s in LEVELS]
        self.reach = float(np.abs(x).max(initial=0)) * x.shape[1]
        self.row, self.other, self.score = (np.zeros(0, t) for t in (np.int64, np.int64, float))

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        sides = [statistics(x, s) for s in LEVELS]
        slack = 1e-9 * (1 + float(np.abs(x).max(initial=0)) * self.reach)
        for a in range(0, len(self.ids), TILE):
            b = min(a + TILE, len(self.ids))
            least = self.least[a:b, None] - slack
            open_ = self.sides[0][a:b] @ sides[0].T >= least
            open_ &= ids[None, :] != self.ids[a:b, None]
            if open_.mean() > 0.05:  # many are left: whole products are cheaper than picking pairs
                open_ &= self.sides[1][a:b] @ sides[1].T >= least
                score = np.where(open_, np.rint(self.x[a:b] @ x.T), -np.inf)
                if score.shape[1] > self.k:
                    kth = np.partition(score, -self.k, axis=1)[:, -self.k]
                    open_ &= score >= np.maximum(kth, self.least[a:b])[:, None]
                row, col = np.nonzero(open_)
                found = score[row, col]
            else:
                row, col = np.nonzero(open_)
                near = np.einsum("ij,ij->i", self.sides[1][a + row], sides[1][col]) >= least[row, 0]
                row, col = row[near], col[near]
                found = np.rint(np.einsum("ij,ij->i", self.x[a + row], x[col]))
            good = found >= self.least[a + row]
            self._keep(a, b, a + row[good], ids[col[good]], found[good])

    def _keep(self, a: int, b: int, row: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        """Merge candidates of queries a .. b-1 into what they have."""
        if not len(row):
            return
        old = (self.row >= a) & (self.row < b)
        row, other, score = (np.concatenate(p) for p in ((self.row[old], row), (self.other[old], other), (self.score[old], score)))
        order = np.lexsort((other, -score, row))
        row, other, score = row[order], other[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        full = nth == self.k - 1
        self.least[row[full]] = np.maximum(self.least[row[full]], score[full])
        best = nth < self.k
        self.row, self.other, self.score = (np.concatenate((x[~old], y[best])) for x, y in ((self.row, row), (self.other, other), (self.score, score)))

    def found(self):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.other), pa.array(self.score.astype(np.int64))], ["query_id", "vec_id", "score"])


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in as few bytes as hold them all."""
    most = np.abs(x).max(initial=0)
    kind = "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, x.astype(kind).tobytes()


BLOCK = "d int, block long, ids binary, kind string, x binary, floor binary, low array<double>, high array<double>, least double"


def _packed(key, table):
    """One row for a block: ids, vectors, floors, ranges of the coarse statistics, the lowest floor."""
    import pyarrow as pa

    d = key[0].as_py()
    ids, floor = table["vec_id"].to_numpy().astype("<i8"), table["floor"].to_numpy().astype("<f8")
    x = table["x"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, d)
    kind, data = _narrow(x)
    side = statistics(x, LEVELS[0])
    return pa.table({"d": pa.array([d], pa.int32()), "block": [key[1].as_py()], "ids": [ids.tobytes()], "kind": [kind], "x": [data], "floor": [floor.tobytes()], "low": [side.min(0)], "high": [side.max(0)], "least": [float(floor.min())]})


def _bound() -> Column:
    """What no pair of a block of queries (q_...) and one of candidates can exceed, with room for rounding."""
    each = F.arrays_zip(F.col("q_low"), F.col("q_high"), F.col("low"), F.col("high"))
    top = lambda z: F.greatest(z["q_low"] * z["low"], z["q_low"] * z["high"], z["q_high"] * z["low"], z["q_high"] * z["high"])
    size = lambda z: F.greatest(F.abs(z["q_low"]), F.abs(z["q_high"])) * F.greatest(F.abs(z["low"]), F.abs(z["high"]))
    return F.aggregate(each, F.lit(1.0), lambda s, z: s + top(z) + 1e-9 * size(z))


def _scanned(candidates: DataFrame, queries: DataFrame, k: int, group: int, tasks: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query for each group of blocks of candidates; both are written tables of BLOCK."""
    side = queries.select("d", F.col("block").alias("q_block"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), "least")
    met = candidates.select("d", "block", "low", "high").join(side, "d").where(_bound() >= F.col("least")).select("d", "block", "q_block")  # a row per pair of blocks
    met = met.withColumn("grp", F.floor(F.col("block") / group))
    keys = ["d", "q_block", "grp"]
    data = ["ids", "kind", "x", "floor"]
    one = met.select(*keys).distinct().join(queries.select("d", F.col("block").alias("q_block"), *data), ["d", "q_block"]).withColumn("block", F.lit(-1).cast("long"))
    two = met.join(candidates.select("d", "block", *data), ["d", "block"])
    cols = [*keys, "block", *data]
    rows = one.select(*cols).unionByName(two.select(*cols)).repartition(tasks, *keys).sortWithinPartitions(*keys, "block")

    def run(batches) -> Iterator:
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                d, block, kind = (batch.column(c)[i].as_py() for c in (0, 3, 5))
                ids, floor = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((4, "<i8"), (7, "<f8")))
                x = np.frombuffer(batch.column(6)[i].as_buffer(), kind).reshape(-1, d).astype(float)
                if block < 0:
                    if now is not None:
                        yield now.found()
                    now = Search(ids, x, floor, k)
                else:
                    now.see(ids, x)
        if now is not None:
            yield now.found()

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, query_block: int = 32_768, block: int = 8192, group: int = 16, stride: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all rows with another id. Components become floor(scale * x) first. Null
    ids, null or empty vectors, and vectors that hold null, NaN or infinity
    take no part; vectors of other lengths than the query's are no candidates
    of it. Rows that repeat an id and a vector count once; rows that repeat an
    id with other vectors are candidates, or queries, one by one, and their
    results as queries share one ranking. Extra columns are ignored.
    """
    top = shared_dir(vectors.sparkSession)
    v = pick(vectors, vec_id=(id_col, "long"), raw=(vector_col, "array<double>"))
    fine = F.forall("raw", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & (F.size("raw") > 0) & fine)
    v = v.select("vec_id", F.transform("raw", lambda c: F.floor(F.lit(float(scale)) * c).cast("double")).alias("x")).distinct().withColumn("d", F.size("x"))

    def half(i: int) -> Column:  # the sign of the i-th of four stretches
        return F.aggregate(F.slice("x", F.floor(F.col("d") * i / 4).cast("int") + 1, F.ceil(F.col("d") / 4).cast("int")), F.lit(0.0), lambda s, c: s + c) > 0

    v = v.withColumn("cell", sum((half(i).cast("int") * 2**i for i in range(4)), F.lit(0))).withColumn("norm", F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    v = numbered(v, F.col("d"), F.col("cell"), F.col("norm"), F.xxhash64("vec_id", "x"), name="nth").select("vec_id", "x", "d", "nth")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    told = v.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    if not told["q"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    no = F.lit(float("-inf")).alias("floor")

    def of(df: DataFrame, size: int) -> DataFrame:  # a block has 32 MB of vectors at most, or one vector
        own = F.greatest(F.least(F.lit(size), F.floor(F.lit(1 << 22) / F.col("d"))), F.lit(1))
        return df.withColumn("b", F.floor((F.col("nth") - 1) / own)).groupBy("d", "b").applyInArrow(_packed, BLOCK)

    c = written(of(v.select("vec_id", "x", "d", "nth", no), block), f"{top}/blocks")
    q = numbered(v.where(is_query).select("vec_id", "x", "d", F.col("nth").alias("at")), F.col("at"), name="nth")
    q = written(q.select("vec_id", "x", "d", "nth"), f"{top}/queries")
    tasks = lambda blocks: int(min(max(1, -(-told["q"] // query_block) * -(-blocks // group)), 200_000))
    n_blocks = -(-told["n"] // block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    some = c.where(F.col("block") % stride == 0).withColumn("block", F.floor(F.col("block") / stride))
    first = _scanned(some, written(of(q.select("*", no), query_block), f"{top}/first"), k, group, tasks(-(-n_blocks // stride)))
    first = written(first.withColumn("rank", rank).where(F.col("rank") <= k), f"{top}/early")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    known = q.join(floors, "vec_id", "left").select("vec_id", "x", "d", "nth", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
    more = _scanned(c.where(F.col("block") % stride != 0), written(of(known, query_block), f"{top}/second"), k, group, tasks(n_blocks))
    found = first.drop("rank").unionByName(more)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
