"""Operator 4: language-model scores with an interpolated modified Kneser-Ney bigram model.

Spark counts the words and then the word pairs of the training texts. Tasks
reduce their part of a text to sorted arrays of distinct keys with counts, so
what is shuffled is packed arrays, one for each range of keys; a task per range
merges them and writes sorted arrays to the shared folder. Words are 64-bit
hashes; a word's number is its place in the sorted array of all hashes, and a
pair is its two numbers in one 64-bit key. Scoring tasks map the arrays into
memory, so what they hold is bounded by the pages they touch.

The model: ``p(w | u) = max(c(u w) - D(c), 0) / c(u .) + g(u) * p(w)``, where
``p(w)`` is made in the same way from the number of distinct words before w,
interpolated with the uniform distribution over the training words and one
unknown. There are three discounts at each level, from the counts of counts. A
text starts after a begin mark, which is no token, and ends with an end token.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix, pick, shared_dir, slices, text_bytes, word_hashes, written

END = int(mix(np.array([0xE17D], np.uint64))[0])
#: Bytes of text that a task holds as arrays at a time, and distinct keys that it gathers before it passes them on.
TEXT_BYTES, MOST_KEYS = 1 << 23, 1 << 22


def in_training(doc_id: int | None, modulus: int = 7, held_out: int = 2) -> bool:
    """Whether the model learns from the document; one without an id is held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus != held_out


def tokens(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, hashes of all tokens, tokens per row) of an Arrow string array, some megabytes at a time."""
    data, off = text_bytes(column)
    for a, b in slices(off, TEXT_BYTES):
        h, n = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        out = np.full(len(h) + b - a, END, np.uint64)
        last = np.cumsum(n + 1) - 1
        inner = np.ones(len(out), bool)
        inner[last] = False
        out[inner] = h
        yield a, b, out, n + 1


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts added up."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)
    return keys[first], n.astype(np.int64)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts as 32-bit numbers if all fit, else as 64-bit ones; readers tell them apart by the number of bytes."""
    return counts.astype("<u8" if counts.max(initial=0) >> 32 else "<u4")


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts in bytes: differences of the upper halves and counts compress well, lower halves don't."""
    up = np.diff(keys >> np.uint64(32), prepend=np.uint64(0)).astype("<u4")
    return b"".join([np.array([len(keys)], "<u8").tobytes(), (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), zlib.compress(up.tobytes() + narrow(counts).tobytes(), 1)])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    low = np.frombuffer(blob, "<u4", n, 8).astype(np.uint64)
    rest = zlib.decompress(blob[8 + 4 * n :])
    up = np.frombuffer(rest, "<u4", n).astype(np.uint64)
    return (np.cumsum(up) << np.uint64(32)) | low, np.frombuffer(rest, "<u8" if len(rest) == 12 * n else "<u4", n, 4 * n).astype(np.int64)


def _save(path: str, array: np.ndarray) -> None:
    """Written aside and renamed, so that a repeated task replaces it by the same file."""
    own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        f.write(np.ascontiguousarray(array).tobytes())
    os.replace(own, path)


_MAPPED: dict[str, np.ndarray] = {}


def _mapped(path: str, kind: str) -> np.ndarray:
    if path not in _MAPPED:
        if len(_MAPPED) > 50_000:
            _MAPPED.clear()
        _MAPPED[path] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    return _MAPPED[path]


def _counts(path: str, n: int) -> np.ndarray:
    """n counts, of the width that the file's size tells."""
    return _mapped(path, "<u8" if n and os.path.getsize(path) == 8 * n else "<u4")


def _find(paths: list[str], at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For sorted wanted keys, of which at[r]:at[r+1] belong to file r: their places in that file, or -1."""
    out = np.full(len(wanted), -1, np.int64)
    for r in np.flatnonzero(np.diff(at)):
        part, keys = wanted[at[r] : at[r + 1]], _mapped(paths[r], "<u8")
        if len(keys):
            i = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            out[at[r] : at[r + 1]] = np.where(keys[i] == part, i, -1)
    return out


@dataclass
class Vocabulary:
    """Sorted hashes of all training words in ``ranges`` files by leading bits, and their counts."""

    folder: str
    ranges: int
    sizes: list[int]
    total: int  # tokens

    def __post_init__(self):
        self.starts = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)
        self.size = int(self.starts[-1])
        self.limits = range_limits(self.ranges)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of sorted hashes; -1 if unknown."""
        at = np.append(np.searchsorted(hashes, self.limits), len(hashes))
        found = _find([f"{self.folder}/word-{r}" for r in range(self.ranges)], at, hashes)
        return np.where(found >= 0, found + np.repeat(self.starts[:-1], np.diff(at)), -1)

    def values(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Entries of a per-word array for sorted numbers, 0 for -1."""
        out = np.zeros(len(numbers), np.int64)
        at = np.searchsorted(numbers, self.starts)
        for r in np.flatnonzero(np.diff(at)):
            out[at[r] : at[r + 1]] = _counts(f"{self.folder}/{name}-{r}", self.sizes[r])[numbers[at[r] : at[r + 1]] - self.starts[r]]
        return out


def range_limits(ranges: int) -> np.ndarray:
    """The least hash of each range."""
    return np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)


def discounts(t: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from how many entries have count 1, 2, 3, 4."""
    if not t[0] or not t[1]:
        return 0.5, 0.75, 0.9
    y = t[0] / (t[0] + 2 * t[1])
    d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2] if t[2] else 2.0]
    return tuple(min(max(v, 0.05), k + 0.95) for k, v in enumerate(d))


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


@dataclass
class Model:
    words: Vocabulary
    pairs: int  # distinct
    before: tuple[int, int, int]  # words with 1, 2, 3 or more distinct words before them
    d_pair: tuple[float, float, float]
    d_word: tuple[float, float, float]
    keys: np.ndarray  # least key of each range of pairs; a range has whole contexts, or a part of one frequent context
    starts: np.ndarray  # first context of each range
    hot: dict[int, np.ndarray]  # frequent contexts: occurrences, and followers seen once, twice, more often

    def scored(self, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row of n tokens each: known tokens, base score, model score."""
        v, folder = self.words, self.words.folder
        distinct, back = np.unique(hashes, return_inverse=True)
        number = v.numbers(distinct)
        order = np.argsort(number, kind="stable")
        count, before = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[order], before[order] = v.values("count", number[order]), v.values("before", number[order])
        uniform = 1 / (v.size + 1)
        if self.pairs:
            lower = _discounted(before, self.d_word) / self.pairs + sum(a * b for a, b in zip(self.before, self.d_word)) / self.pairs * uniform
        else:
            lower = np.full(len(number), uniform)
        base = np.log10((count + 1) / (v.total + v.size + 1))
        number, known = number[back], count[back] > 0
        row = np.repeat(np.arange(len(n)), n)
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        context = np.concatenate(([v.size], number[:-1]))
        context[first] = v.size
        p = lower[back]
        use = np.flatnonzero(context >= 0)
        keys, inverse = np.unique((context[use].astype(np.uint64) << np.uint64(32)) | np.where(number[use] < 0, 0xFFFFFFFF, number[use]).astype(np.uint64), return_inverse=True)
        ctx = (keys >> np.uint64(32)).astype(np.int64)
        at = np.append(np.searchsorted(keys, self.keys), len(keys))
        place = _find([f"{folder}/pair-{r}" for r in range(len(self.starts))], at, keys)
        share, weight = np.zeros(len(keys)), np.ones(len(keys))
        for r in np.flatnonzero(np.diff(at)):
            s = slice(at[r], at[r + 1])
            n_pairs = os.path.getsize(f"{folder}/pair-{r}") // 8
            c = np.where(place[s] >= 0, _counts(f"{folder}/paircount-{r}", n_pairs)[np.maximum(place[s], 0)], 0).astype(np.int64) if n_pairs else np.zeros(at[r + 1] - at[r], np.int64)
            if int(self.starts[r]) in self.hot:
                stats = np.broadcast_to(self.hot[int(self.starts[r])], (len(c), 4))
            else:
                width = (int(self.starts[r + 1]) if r + 1 < len(self.starts) else v.size + 1) - int(self.starts[r])
                stats = _counts(f"{folder}/context-{r}", 4 * width).reshape(-1, 4)[ctx[s] - self.starts[r]].astype(np.int64)
            seen = stats[:, 0] > 0
            den = np.maximum(stats[:, 0], 1)
            share[s] = np.where(seen, _discounted(c, self.d_pair) / den, 0.0)
            weight[s] = np.where(seen, stats[:, 1:] @ np.array(self.d_pair) / den, 1.0)
        p[use] = share[inverse] + weight[inverse] * p[use]
        add = lambda x: np.bincount(row, x, len(n))
        return add(known).astype(np.int64), add(base[back]), add(np.log10(p))


def _local(folder: str) -> str:
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"{folder} can't be mapped into memory; give model_dir, a folder that all executors mount")
    return folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")


def _emit(range_of: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """A record batch with one row for each range that has keys; range_of: the least key of each range."""
    import pyarrow as pa

    at = np.append(np.searchsorted(keys, range_of), len(keys))
    full = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_pack(keys[at[r] : at[r + 1]], counts[at[r] : at[r + 1]]) for r in full], pa.binary())], ["r", "blob"])


def _gathered(batches, limits: np.ndarray, keys_of) -> Iterator:
    """Distinct keys of training texts with counts, passed on by ranges whenever there are many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for a, b, h, n in tokens(batch.column(1)):
            learn = np.array([in_training(i) for i in ids[a:b]], bool)
            keys = keys_of(h, n, learn)
            held.append(summed(keys))
            size += len(held[-1][0])
            if size >= MOST_KEYS:
                yield _emit(limits, *summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])))
                held, size = [], 0
    if held:
        yield _emit(limits, *summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])))


def _merged(table) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(b.as_py()) for b in table["blob"]]
    return summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def pair_ranges(size: int, ranges: int, hot: dict[int, int], part: int) -> np.ndarray:
    """Least keys of the ranges of pairs: ``ranges`` equal runs of contexts, each frequent context (count above part) apart and cut by its second word."""
    limits = {(size + 1) * r // ranges << 32 for r in range(ranges)}
    for u, n in hot.items():
        parts = -(-n // part)
        limits |= {(u << 32) + (size * k // parts) for k in range(parts)} | ({(u + 1) << 32} if u < size else set())
    return np.array(sorted(limits), np.uint64)


def trained(texts: DataFrame, model_dir: str | None = None, range_bytes: int = 1 << 24, most_ranges: int = 65_536) -> Model:
    """Counts, merges and writes the model of the training texts in texts (doc_id, text).

    There is a range of keys for each range_bytes of text, at least one for
    each shuffle partition. A word that is the context of more pairs than an
    average range holds has ranges of its own, so no task merges more than a
    few times range_bytes, whatever is frequent.
    """
    import pyarrow as pa

    spark = texts.sparkSession
    top = shared_dir(spark)
    folder = _local(model_dir or top) + "/kneser_ney"
    os.makedirs(folder, exist_ok=True)
    told = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    volume = (told["bytes"] or 0) + told["rows"]
    ranges = int(min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12, -(-volume // range_bytes)), most_ranges))
    part = max(volume // (4 * ranges), 1 << 12)  # a token takes two bytes or more, so at most 2 * ranges words are more frequent
    limits = range_limits(ranges)

    def count_words(batches):
        return _gathered(batches, limits, lambda h, n, learn: h[np.repeat(learn, n)])

    def merge_words(key, table):
        r = key[0].as_py()
        words, n = _merged(table)
        _save(f"{folder}/word-{r}", words.astype("<u8"))
        _save(f"{folder}/count-{r}", narrow(n))
        hot = np.flatnonzero(n > part)
        return pa.table({"r": pa.array([r], pa.int32()), "words": [len(words)], "tokens": [int(n.sum())], "hot": pa.array([hot], pa.list_(pa.int64())), "n": pa.array([n[hot]], pa.list_(pa.int64()))})

    found = texts.mapInArrow(count_words, "r int, blob binary").groupBy("r").applyInArrow(merge_words, "r int, words long, tokens long, hot array<long>, n array<long>").collect()  # a row per range
    sizes = {x.r: x.words for x in found}
    for r in set(range(ranges)) - set(sizes):
        for name in ("word", "count"):
            _save(f"{folder}/{name}-{r}", np.zeros(0, "<u8"))
    words = Vocabulary(folder, ranges, [sizes.get(r, 0) for r in range(ranges)], sum(x.tokens for x in found))
    if words.size > 0xFFFFFFFE:
        raise ValueError(f"{words.size} distinct words; the keys of pairs have room for 2**32 - 2")
    begin = words.size
    often = {int(words.starts[x.r]) + k: n for x in found for k, n in zip(x.hot, x.n)}
    if told["rows"] > part:
        often[begin] = told["rows"]
    pair_keys = pair_ranges(begin, ranges, often, part)
    starts = (pair_keys >> np.uint64(32)).astype(np.int64)

    def count_pairs(batches):
        def keys(h, n, learn):
            h, n = h[np.repeat(learn, n)], n[learn]
            if not len(n):
                return np.zeros(0, np.uint64)
            distinct, back = np.unique(h, return_inverse=True)
            number = words.numbers(distinct)[back].astype(np.uint64)
            before = np.concatenate(([begin], number[:-1])).astype(np.uint64)
            before[np.concatenate(([0], np.cumsum(n)[:-1]))] = begin
            return (before << np.uint64(32)) | number

        return _gathered(batches, pair_keys, keys)

    word_limits = words.starts[:-1].astype(np.uint64)
    many = len(pair_keys)
    width = lambda r: int((starts[r + 1] if r + 1 < many else begin + 1) - starts[r])

    def merge_pairs(key, table):
        r = key[0].as_py()
        pairs, n = _merged(table)
        _save(f"{folder}/pair-{r}", pairs.astype("<u8"))
        _save(f"{folder}/paircount-{r}", narrow(n))
        kinds = (n, n == 1, n == 2, n > 2)
        if int(starts[r]) in often:
            stats = [int(k.sum()) for k in kinds]
        else:
            ctx, stats = (pairs >> np.uint64(32)).astype(np.int64) - starts[r], []
            dense = np.zeros((width(r), 4), np.int64)
            for j, k in enumerate(kinds):
                np.add.at(dense[:, j], ctx, k)
            _save(f"{folder}/context-{r}", narrow(dense))
        after = _emit(word_limits, *summed(pairs & np.uint64(0xFFFFFFFF)))
        k = after.num_rows
        lists = lambda first: pa.array([first] + [[]] * (k - 1), pa.list_(pa.int64()))
        return pa.table({"r": after.column(0), "blob": after.column(1), "pairs": [len(pairs)] + [0] * (k - 1), "t": lists(counts_of_counts(n)), "stats": lists(stats), "own": pa.array([r] + [-1] * (k - 1), pa.int32())})

    pairs = texts.mapInArrow(count_pairs, "r int, blob binary").groupBy("r").applyInArrow(merge_pairs, "r int, blob binary, pairs long, t array<long>, stats array<long>, own int")
    pairs = written(pairs, f"{top}/before")
    rows = pairs.where("own >= 0").select("own", "pairs", "t", "stats").collect()  # a row per range
    for r in set(range(many)) - {x.own for x in rows}:
        for name, size in (("pair", 0), ("paircount", 0), ("context", 0 if int(starts[r]) in often else 4 * width(r))):
            _save(f"{folder}/{name}-{r}", np.zeros(size, "<u4"))
    hot = {u: np.zeros(4, np.int64) for u in often}
    for x in rows:
        if x.stats:
            hot[int(starts[x.own])] += np.array(x.stats, np.int64)

    def merge_before(key, table):
        r = key[0].as_py()
        number, n = _merged(table)
        dense = np.zeros(words.sizes[r], np.int64)
        dense[number.astype(np.int64) - words.starts[r]] = n
        _save(f"{folder}/before-{r}", narrow(dense))
        return pa.table({"r": pa.array([r], pa.int32()), "t": pa.array([counts_of_counts(n)], pa.list_(pa.int64())), "more": [int((n > 2).sum())]})

    low = pairs.select("r", "blob").groupBy("r").applyInArrow(merge_before, "r int, t array<long>, more long").collect()  # a row per range
    for r in set(range(ranges)) - {x.r for x in low}:
        _save(f"{folder}/before-{r}", np.zeros(words.sizes[r], "<u4"))
    add = lambda rows: [sum(x.t[k] for x in rows) for k in range(4)]
    t = add(low)
    return Model(words, sum(x.pairs for x in rows), (t[0], t[1], sum(x.more for x in low)), discounts(add(rows)), discounts(t), pair_keys, starts, hot)


def scores(docs: DataFrame, model_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each text.

    Null and empty texts are the end token alone. A null id is held out. Rows
    that repeat an id are learnt from and scored one by one; an empty table
    gives no rows; extra columns are ignored. The model's arrays are in
    model_dir, or else in the shared folder, which must be one that executors
    can open as files.
    """
    texts = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    model = trained(texts, model_dir)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, h, n in tokens(batch.column(1)):
                known, base, score = model.scored(h, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array([not in_training(i) for i in ids[a:b]]), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(b - a, model.words.total, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / n, 300))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
