"""Products of sparse rows between blocks of two tables: every pair of rows is scored, no pair is shuffled.

A table of pairs that share words grows with the square of each word's rows.
Here both tables are dealt into blocks, each pair of blocks is one group, and
scores are matrix products in its memory; only what the caller keeps of a
block of scores goes on. Work grows with the product of the tables' rows,
what is shuffled with rows times blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import shared_dir, written

#: Rows of a block at least and at most, and the number of blocks from which they grow, so that shuffles stay small.
LEAST, MOST, BLOCKS = 2048, 16384, 48
#: Rows that are scored at a time, and terms of a sum that are laid out at a time.
BATCH, TERMS = 256, 2_000_000


def coded(terms: DataFrame) -> DataFrame:
    """The rows of terms, of which each is there once, with a number as code; a written table."""
    return written(terms.withColumn("code", F.monotonically_increasing_id()), f"{shared_dir(terms.sparkSession)}/codes")


def across(left: DataFrame, right: DataFrame, found: Callable, schema: str, by: Column | None = None, upper: bool = False) -> DataFrame:
    """What found(left block, right block) gives, two pandas tables to one of this schema, for every pair of blocks with an equal ``by``.

    Rows without a ``by`` take no part. With ``upper`` both tables hold the
    same rows by id, and of two blocks only one order is a group.
    """
    by, n = F.lit(0) if by is None else by, F.count("*")

    def dealt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        keyed = df.select(*[F.col(c).alias(c) for c in df.columns], by.alias("lw_by")).where("lw_by IS NOT NULL")  # columns of their own: both may be one table
        return keyed, keyed.groupBy("lw_by").agg(F.greatest(F.lit(1), F.least(F.ceil(n / LEAST), F.greatest(F.lit(BLOCKS), F.ceil(n / MOST)))).cast("int").alias("lw_n"))

    (a, n_a), (b, n_b) = dealt(left), dealt(right)
    own = F.pmod(F.xxhash64("id"), F.col("lw_n")).cast("int")
    a = a.join(n_a, "lw_by").withColumn("lw_i", own).drop("lw_n").join(n_b, "lw_by")
    b = b.join(n_b, "lw_by").withColumn("lw_j", own).drop("lw_n").join(n_a, "lw_by")
    last = F.col("lw_n") - 1
    a = a.withColumn("lw_j", F.explode(F.sequence(F.col("lw_i") if upper else F.lit(0), last))).drop("lw_n")
    b = b.withColumn("lw_i", F.explode(F.sequence(F.lit(0), F.col("lw_j") if upper else last))).drop("lw_n")
    keys = ["lw_by", "lw_i", "lw_j"]

    def both(x, y):
        import pandas as pd

        none = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return found(x, y) if len(x) and len(y) else none

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(both, schema)


class Block:
    """Right rows of a product: codes and values of each row, the codes that are in many rows as a dense matrix."""

    def __init__(self, codes, values=None, dense: float = 1 / 12, kind: str = "float64"):
        import numpy as np

        self.kind, self.n = kind, len(codes)
        self.known, at, row, val = self._flat(codes, values)
        df = np.bincount(at, minlength=len(self.known))
        heavy = df > max(1, dense * self.n)
        self.heavy = np.where(heavy, np.cumsum(heavy) - 1, -1)
        is_heavy = heavy[at]
        self.matrix = np.zeros((int(heavy.sum()), self.n), kind)
        self.matrix[self.heavy[at[is_heavy]], row[is_heavy]] = val[is_heavy]
        at, row, val = at[~is_heavy], row[~is_heavy], val[~is_heavy]
        order = np.argsort(at, kind="stable")
        self.row, self.val = row[order], val[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(self.known)))))

    @staticmethod
    def _flat(codes, values):
        import numpy as np

        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.concatenate([*codes, np.zeros(0, np.int64)]).astype(np.int64)
        known, at = np.unique(flat, return_inverse=True)
        val = np.ones(len(flat)) if values is None else np.concatenate([*values, np.zeros(0)]).astype(float)
        return known, at, np.repeat(np.arange(len(codes)), sizes), val

    def scores(self, codes, values=None) -> Iterator:
        """(first row, matrix of products) of left rows with all right ones, some rows at a time."""
        import numpy as np

        known, at, row, val = self._flat(codes, values)
        place = np.searchsorted(self.known, known)
        there = place < len(self.known)
        there[there] = self.known[place[there]] == known[there]
        keep = there[at]
        at, row, val = place[at[keep]], row[keep], val[keep]
        ends = np.searchsorted(row, np.arange(0, len(codes) + BATCH, BATCH))
        for k in range(0, len(codes), BATCH):
            m, cut = min(BATCH, len(codes) - k), slice(ends[k // BATCH], ends[k // BATCH + 1])
            t, r, v = at[cut], row[cut] - k, val[cut]
            h = self.heavy[t] >= 0
            left = np.zeros((m, len(self.matrix)), self.kind)
            left[r[h], self.heavy[t[h]]] = v[h]
            out = left @ self.matrix
            t, r, v = t[~h], r[~h], v[~h]
            n = self.start[t + 1] - self.start[t]
            step = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + TERMS, TERMS), "left") if len(n) else [0]
            edges = np.unique(np.concatenate((step, [len(n)])))
            for a, b in zip(edges[:-1], edges[1:]):
                c = n[a:b]
                which = np.repeat(np.arange(a, b), c)
                right = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c) + self.start[t[which]]
                out += np.bincount(r[which] * self.n + self.row[right], v[which] * self.val[right], m * self.n).reshape(m, self.n).astype(self.kind, copy=False)
            yield k, out
