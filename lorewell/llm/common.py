"""What the operators of this subpackage share: column picking, shared tables, bounded filters, word hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir, written  # noqa: F401 - the operators take them from here

#: Fixed value: the characters that separate words, as a Java character class.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """Columns of df under new names and types: ``pick(df, doc_id=("doc_id", "long"))``.

    Columns go by position, so further columns, even ones whose names differ
    only in case or that occur twice, do no harm. An exact name wins over one
    that differs in case; a missing column raises ValueError.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    out = []
    for new, (old, kind) in wanted.items():
        at = [i for i, n in enumerate(names) if n == old] or [i for i, n in enumerate(names) if n.lower() == old.lower()]
        if not at:
            raise ValueError(f"no column {old!r} among {names}")
        out.append(F.col(f"c{at[0]}").cast(kind).alias(new))
    return plain.select(*out)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null stays null. lower() does it for pure ASCII, at a fraction of translate()'s cost."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def numbered(df: DataFrame, path: str) -> DataFrame:
    """df with columns c0, c1, ... and lw_row, a number of each row's own that all later reads agree on.

    A table that is read from files as it is has its rows in the same order at
    each read, whatever columns are read, so numbers by partition and place
    are fixed; anything else is written first.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).withColumn("lw_row", F.monotonically_increasing_id())
    scan = df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LogicalRelation"
    return plain if scan else written(plain, path)


# A filter of bounded size ------------------------------------------------

#: log2 of the filter's bits; 2**22 bits are at most 65,536 words of 64 bits, whatever the data.
FILTER_BITS = 22


def bit_words(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The 64-bit words of a one-hash Bloom filter over a long column: at most 2**(bits-6) rows, so it may be broadcast at any scale."""
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    return keys.select(F.shiftright(slot, 6).alias("bf_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {1 << bits}L) & 63L as int))").alias("bf_bit")).groupBy("bf_word").agg(F.bit_or("bf_bit").alias("bf_bits"))


def bit_filtered(df: DataFrame, key: str, words: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of df whose key may be in the filter; all that are in it pass. A full filter lets more rows pass and stays correct."""
    hit = F.expr(f"(bf_bits & shiftleft(1L, cast(pmod(xxhash64({key}), {1 << bits}L) & 63L as int))) <> 0")
    return df.withColumn("bf_word", F.expr(f"shiftright(pmod(xxhash64({key}), {1 << bits}L), 6)")).join(F.broadcast(words), "bf_word").where(hit).drop("bf_word", "bf_bits")


# Words of Arrow text batches as 64-bit hashes ---------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k:] = [np.cumprod(steps, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and each row's offsets into them; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, ASCII lower-cased, and the number of words in each row.

    A word's hash is a polynomial in its bytes modulo 2**64, then mixed; prefix
    sums give all words of a batch at once.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    low = _FOLD[data]
    gap = np.ones(n + 1, bool)  # gap[i]: no word goes from byte i-1 to byte i
    sp = _SPACE[low]
    gap[1:n] = sp[1:] | sp[:-1]
    gap[off] = True
    first = np.flatnonzero(gap[:n] & ~sp)
    last = np.flatnonzero(gap[1:] & ~sp) + 1
    up, down = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[last] - total[first]) * down[first])
    return h, np.diff(np.searchsorted(first, off))


def slices(off: np.ndarray, most: int = 1 << 21):
    """Row ranges of at most so many bytes each (a longer row alone), so that work arrays stay small."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b
