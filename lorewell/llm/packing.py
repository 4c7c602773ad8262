"""Operator 1: best-fit packing of token sequences.

How pieces share sequences depends on their lengths alone, so the packing is
solved once, exactly for all pieces, on the histogram of lengths: ``seq_len``
numbers at any size of input. Each bin is filled greedily with the longest
pieces that fit; then its smallest piece is taken out again if two unpacked
pieces fit the gap that this leaves more tightly. A filling is repeated as
often as the histogram allows, so the plan has a few thousand patterns, not
one per sequence. Pieces find their places by their rank among the pieces of
their length, which two levels of counting give without a global sort.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, pick, shared_dir, written

#: Runs of blanks (Unicode's White_Space, as in the tokenizer's pattern) on which the pattern may run out of stack.
LONG_RUN = 1 << 16
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_RUN)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encoder(path: str, special: dict[str, int]):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoded(encoder, text: str) -> np.ndarray:
    """Ids of a text; the strings of the encoder's special tokens are tokens, others are ordinary text.

    A long run of blanks is cut out as the pattern cuts it: all of it is one
    piece, but for its last character if a word follows, which that begins with.
    """
    parts, at = [], 0
    for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
        end = run.end() - (run.end() < len(text))
        parts.append(encoder.encode_to_numpy(text[at : run.start()], allowed_special="all"))
        parts.append(np.asarray(encoder._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    parts.append(encoder.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def cuts(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if it fits, else full ones with the remainder in front."""
    first = n if n <= seq_len else n % seq_len or seq_len
    return [(0, first)] + [(s, seq_len) for s in range(first, n, seq_len)]


def tokenised(docs: DataFrame, path: str, seq_len: int, end_id: int, keep_ids: bool = False, special: dict[str, int] | None = None) -> DataFrame:
    """Pieces of every document, with the checksum of their ids or, if asked for, the ids."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(path, special or {})
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids = np.append(np.asarray(encoded(encoder, text), "<u4"), np.uint32(end_id)) if text else np.array([end_id], "<u4")
                for k, (a, n) in enumerate(cuts(len(ids), seq_len)):
                    part = ids[a : a + n].astype("<u4")
                    for c, v in zip(cols, (doc, k, a, n, zlib.crc32(part.tobytes()), part.astype(np.int64).tolist() if keep_ids else None)):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            k = 5 + keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds)], names[:k])

    return docs.mapInArrow(run, PIECES + (", ids array<long>" if keep_ids else ""))


def fillings(counts: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit on a histogram of lengths: (lengths in one bin, longest first; number of such bins).

    Every piece of the histogram is in exactly one bin. Bins of the same
    filling are made at once, as many as the counts allow.
    """
    left = np.zeros(seq_len + 1, np.int64)
    for k, n in counts.items():
        if n and not 0 < k <= seq_len:
            raise ValueError(f"a piece of {k} tokens can't be in a sequence of {seq_len}")
        left[k] += n
    out = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        mine: Counter = Counter()
        gap, last = seq_len, 0
        while True:
            fit = there[there <= gap]
            fit = fit[::-1]
            nxt = next((int(x) for x in fit if left[x] > mine[int(x)]), 0)
            if not nxt:
                break
            mine[nxt] += 1
            gap, last = gap - nxt, nxt
        if gap and sum(mine.values()) > 1:
            small = last
            room = gap + small
            mine[small] -= 1
            free = np.array([x for x in there if x < room and left[x] > mine[int(x)]], np.int64)
            best = (small, 0, 0)
            for a in free[::-1]:  # two pieces, a >= b, with a + b as near to the room as can be
                b = min(int(a), room - int(a))
                at = int(np.searchsorted(free, b, "right")) - 1
                while at >= 0 and free[at] == a and left[a] - mine[int(a)] < 2:
                    at -= 1
                if at >= 0 and a + free[at] > best[0]:
                    best = (int(a + free[at]), int(a), int(free[at]))
                if best[0] == room or 2 * a < best[0]:
                    break
            if best[1]:
                mine[best[1]] += 1
                mine[best[2]] += 1
            else:
                mine[small] += 1
        mine = +mine
        times = min(int(left[k]) // n for k, n in mine.items())
        for k, n in mine.items():
            left[k] -= n * times
        out.append((tuple(sorted(mine.elements(), reverse=True)), times))


def _runs(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, in order of rank: (first rank, pieces of this length in a bin, first bin, offset in the bin)."""
    used: Counter = Counter()
    runs: dict[int, list] = {}
    base = 0
    for lengths, times in plan:
        offset = 0
        for k, n in sorted(Counter(lengths).items(), reverse=True):
            runs.setdefault(k, []).append((used[k], n, base, offset))
            used[k] += n * times
            offset += n * k
        base += times
    return runs


def packed(pieces: DataFrame, seq_len: int = 1024, group_pieces: int = 1_000_000) -> DataFrame:
    """Adds sequence_id (from 0) and offset to pieces that are a written table with doc_id, piece and length.

    Only the histogram of lengths (at most seq_len rows) reaches the driver;
    only the plan made from it goes to the tasks.
    """
    groups = max(64, -(-pieces.count() // group_pieces))
    pieces = pieces.withColumn("lw_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    counts = pieces.groupBy("length", "lw_group").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("lw_group")) - F.col("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = _runs(fillings(histogram, seq_len))
    tables = {k: np.array(v, np.int64) for k, v in runs.items()}
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "lw_group").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before.select(F.col("length").alias("b_length"), F.col("lw_group").alias("b_group"), "before"), (F.col("length") == F.col("b_length")) & (F.col("lw_group") == F.col("b_group")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("lw_group", "b_length", "b_group", "before")
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64) for c in ("length", "rank"))
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                table = tables[int(k)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                nth, slot = np.divmod(rank[at] - row[:, 0], row[:, 1])
                seq[at], offset[at] = row[:, 2] + nth, row[:, 3] + slot * k
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str | None = None, seq_len: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, special_tokens: dict[str, int] | None = None) -> DataFrame:
    """All documents in as few sequences of at most seq_len tokens as the method finds.

    tokenizer: a file of byte-level BPE ranks; the one given by default holds
    the vocabulary of byte_bpe_50k.json and gives its ids (the tests compare
    them), several times as fast. As that vocabulary's description has it
    (``encode_special_tokens = True``), the string of a special token in a text
    is ordinary text; special_tokens names strings and ids that are tokens
    wherever they occur, as ``{"<|endoftext|>": 50256}``. A document's ids are followed by end_id;
    null and empty texts are end_id alone. Longer documents are cut into full
    pieces, the remainder first. Returns doc_id, piece, start, length,
    ids_crc32, sequence_id, offset, and with keep_ids the ids. Rows that repeat
    an id are packed one by one; null ids are kept; an empty table gives no
    rows; extra columns are ignored.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    pieces = tokenised(texts, path, seq_len, end_id, keep_ids, special_tokens)
    return packed(written(pieces, f"{shared_dir(docs.sparkSession)}/pieces"), seq_len)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
