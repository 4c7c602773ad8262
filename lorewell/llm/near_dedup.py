"""Operator 10: near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has t coordinates. In each round every shingle of a document is
hashed into one bin with a value that grows with the round; from round t on,
round t + i puts all of them into bin i, so after 2 t rounds every coordinate
is filled, and most documents need a few rounds only. The share of equal
coordinates is as concentrated about the Jaccard similarity as with t
independent permutations. Bands of coordinates make buckets; at 40 bands of 5 a
pair at similarity 0.8 shares no bucket with a probability near 1e-7.

Links are confirmed on full sets, without making all pairs of a bucket:

1. Documents with equal sets (two 64-bit sums over the shingles and their
   number) are one class, and one document stands for it.
2. In each bucket, every member is compared to one centre, the member with the
   lowest hash. Different bands give a large group many centres. Links give
   components.
3. Buckets whose members are all in one component need no more. In the others,
   pairs of different components whose sketches leave a link possible are
   compared, each in the first bucket that it shares, until a link joins their
   components. Sketches come first, so only texts with such a partner are
   moved. Buckets above a bound of members or of shingles are worked on in
   pairs of blocks. What leaves
   a task are links that join components, never pairs.

Sketches rule a pair out if the share of equal coordinates is ``margin`` below
the limit; at 200 coordinates 0.14 is five deviations.

A centre's members are dealt into blocks, and verification streams over a
block, so no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import bit_filtered, bit_words, documents, mix, numbered, pick, shared_dir, slices, text_bytes, word_hashes, written

ROUND_BITS = np.uint64(54)
_A = np.uint64(0xD6E8FEB86659FD93)


def shingles(h: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, row by row in order, and their number per row, from word hashes and words per row.

    Rows with fewer words than width have their whole sequence as one
    shingle; rows without words have none.
    """
    end = np.cumsum(n)
    start = end - n
    out, size = [], np.zeros(len(n), np.int64)
    grams = np.zeros(len(h), np.uint64)
    for k in range(min(width, len(h))):
        grams[: len(h) - k] = mix(grams[: len(h) - k] * _A + h[k:])  # grams[i]: words i .. i+k
    for i in range(len(n)):
        if n[i] >= width:
            own = np.sort(grams[start[i] : end[i] - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n[i]:
            x = np.uint64(width)
            for w in h[start[i] : end[i]]:
                x = mix(np.array([x], np.uint64) * _A + w)[0]
            own = np.array([x], np.uint64)
        else:
            continue
        out.append(own)
        size[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), size


def sketches(s: np.ndarray, n: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates for each document, from its distinct shingles; documents without any keep the largest number."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(n), t), none)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(len(n)), n)
    low = (np.uint64(1) << ROUND_BITS) - np.uint64(1)
    for k in range(2 * t):
        if not len(row):
            break
        key = mix(s + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = ((key >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if k < t else np.full(len(s), k - t)
        value = (np.uint64(k) << ROUND_BITS) | (mix(key) & low)
        np.minimum.at(flat, row * t + bins, value)
        open_ = (out == none).any(1)
        left = open_[row]
        s, row = s[left], row[left]
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of coordinates."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64), (n, t // rows)).copy()
    for k in range(rows):
        key = mix(key * _A + parts[:, :, k])
    return key


SKETCHED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"


def sketched(texts: DataFrame, width: int, rows: int, n_bands: int) -> DataFrame:
    """Each document's number of shingles, two sums that identify its set, band keys, and a byte of each coordinate."""
    t = rows * n_bands

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for a, b in slices(off):
                s, n = shingles(*word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a]), width)
                full = np.flatnonzero(n)
                sums = np.zeros((2, b - a), np.uint64)
                if len(full):
                    at = (np.cumsum(n) - n)[full]
                    sums[0, full], sums[1, full] = np.add.reduceat(mix(s ^ _A), at), np.add.reduceat(mix(s), at)
                sk = sketches(s, n, t)
                keys = bands(sk, rows).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * n_bands, n_bands), pa.int32()), pa.array(keys.reshape(-1)))
                small = (sk & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), lists, pa.array([x.tobytes() for x in small], pa.binary())],
                    ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"],
                )

    return texts.mapInArrow(run, SKETCHED)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 256) -> DataFrame:
    """Of distinct pairs (a, b), those with 100 * intersection >= percent * union of full shingle sets.

    texts: (id, text). The members of each b are dealt into blocks; a block's
    rows follow their b's text, so a task holds one set and one batch.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = pairs.join(many, "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks"))).select("a", "b", "block")
    members = dealt.join(texts, F.col("a") == F.col("id")).select("b", "block", "a", "text")
    heads = many.select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(texts, F.col("b") == F.col("id"))
    both = members.unionByName(heads.select("b", F.col("block").cast("long").alias("block"), F.lit(None).cast("long").alias("a"), "text"))
    both = both.repartition(F.col("b"), F.col("block")).sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())

    def run(batches) -> Iterator:
        import pyarrow as pa

        head, sets = None, None
        for batch in batches:
            data, off = text_bytes(batch.column(3))
            b_all, block_all, a_all = (batch.column(i).to_pylist() for i in range(3))
            links: list[tuple[int, int]] = []
            for x, y in slices(off):
                s, n = shingles(*word_hashes(data[off[x] : off[y]], off[x : y + 1] - off[x]), width)
                at = np.concatenate(([0], np.cumsum(n)))
                for i in range(y - x):
                    own = s[at[i] : at[i + 1]]
                    b, k, a = b_all[x + i], block_all[x + i], a_all[x + i]
                    if a is None:
                        if head != (b, k):
                            head, sets = (b, k), []
                        sets.append(own.copy())
                    elif head == (b, k):
                        for whole in sets:
                            i_ = len(np.intersect1d(own, whole, assume_unique=True)) if min(len(own), len(whole)) * 100 >= percent * max(len(own), len(whole)) else 0
                            if i_ and 100 * i_ >= percent * (len(own) + len(whole) - i_):
                                links.append((a, b))
                                break
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def _possible(table, need: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows): pairs of different components in one bucket, or pair of blocks, whose sketches leave a link possible.

    A pair that shares several bands is left to the first of them, by the keys
    that make the buckets: bytes of a sketch can agree where the keys don't.
    """
    first, second, nth = (table[c][0].as_py() for c in ("first", "second", "nth"))
    rep, root, blk = (table[c].to_numpy() for c in ("rep", "root", "blk"))
    sk = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(rep), -1)
    keys = table["earlier"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), nth)
    least = sk.shape[1] * (need * 255 / 256 + 1 / 256)
    right = np.flatnonzero(blk == second)
    for i in np.flatnonzero(blk == first):
        others = right[(root[right] != root[i]) & ((rep[right] > rep[i]) | (first != second))]
        for c in range(0, len(others), 4096):
            part = others[c : c + 4096]
            near = part[(sk[part] == sk[i]).sum(1) >= least]
            if len(near):
                yield i, near[~(keys[near] == keys[i]).any(1)]


def _involved(need: float):
    """Members of a bucket with a partner to be compared with."""

    def run(table):
        mine = np.zeros(table.num_rows, bool)
        for i, partners in _possible(table, need):
            mine[i] |= len(partners) > 0
            mine[partners] = True
        return table.select(["band", "nth", "rep", "root", "blk", "first", "second", "sketch", "earlier"]).filter(mine)

    return run


#: Partners whose sets are compared at a time; links that these make spare later ones.
CHUNK = 32


def _linked(need: float, width: int, percent: int):
    """Links between components in a bucket, by full sets; components that a link has joined need no more."""

    def run(table):
        import pyarrow as pa

        rep, root = table["rep"].to_numpy(), table["root"].to_numpy()
        data, off = text_bytes(table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0))
        sets: list[np.ndarray] = []  # sorted, 8 bytes a shingle
        for x, y in slices(off):
            s, n = shingles(*word_hashes(data[off[x] : off[y]], off[x : y + 1] - off[x]), width)
            sets += np.split(s, np.cumsum(n)[:-1])
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while v in up:
                up[v], v = up.get(up[v], up[v]), up[v]
            return v

        found, size = [], np.array([len(x) for x in sets])
        for i, partners in _possible(table, need):
            mine = sets[i]
            for c in range(0, len(partners), CHUNK):
                own = top(int(root[i]))
                part = [j for j in partners[c : c + CHUNK].tolist() if top(int(root[j])) != own]
                if not part:
                    continue
                n = size[part]  # all at once: how many of each partner's shingles are mine
                flat = np.concatenate([sets[j] for j in part])
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
                for k in np.flatnonzero(100 * both >= percent * (len(mine) + n - both)):
                    a, b = top(int(root[i])), top(int(root[part[k]]))
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        found.append((int(rep[i]), int(rep[part[k]])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = 5, n_bands: int = 40, margin: float = 0.14, bucket_block: int = 4096, block_shingles: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: near-duplicate components of whole texts.

    A document's set holds its distinct shingles of ``width`` words, lower-cased
    in A-Z; with fewer words the whole sequence is one shingle. Documents
    are linked if 100 * intersection >= percent * union. component_id is the
    smallest id that can be reached over links. Null and empty texts have no
    shingles and no links. Rows with a null id have no links, a null
    component_id and are kept; rows that repeat an id are one document as far
    as links go. An empty table gives no rows; extra columns are ignored.
    """
    top = shared_dir(docs.sparkSession)
    texts = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    done = written(sketched(texts, width, rows, n_bands), f"{top}/sketches")
    linked = done.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linked.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, f"{top}/classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    heads = written(linked.join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch"), f"{top}/heads")
    members = heads.select("rep", "n_shingles", F.posexplode("bands").alias("nth", "band"))
    counted = members.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("volume"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep"))["rep"].alias("center")).where("n > 1")
    buckets = written(counted, f"{top}/buckets")
    members = bit_filtered(members, "band", bit_words(buckets, "band", 24), 24).join(buckets, "band").select("band", "nth", "rep", "center", "n", "volume")
    members = written(members, f"{top}/members")
    ids = members.select(F.col("rep").alias("id")).distinct()
    near = bit_filtered(texts.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id"), "id", bit_words(ids, "id")).join(ids, "id", "left_semi")
    near = written(near, f"{top}/texts")

    tried = written(members.where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct(), f"{top}/tried")
    roots = written(components(confirmed(tried, near, width, percent), f"{top}/stars"), f"{top}/roots")
    rooted = members.join(roots, F.col("rep") == F.col("node"), "left").select("band", "nth", "rep", "n", "volume", F.coalesce("root", "rep").alias("root"))
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    rest = rooted.join(split, "band", "left_semi").join(heads.select("rep", "sketch", "bands"), "rep")
    rest = rest.withColumn("blocks", F.ceil(F.greatest(F.col("n") / bucket_block, F.col("volume") / block_shingles))).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<long>")))
    group = "band long, nth int, rep long, root long, blk long, first long, second long, sketch binary, earlier array<long>"
    rest = rest.select("band", "nth", "rep", "root", "blk", F.least("blk", "other").alias("first"), F.greatest("blk", "other").alias("second"), "sketch", F.slice("bands", 1, F.col("nth")).alias("earlier"))
    need, keys = percent / 100 - margin, ["band", "first", "second"]
    rest = written(rest.groupBy(*keys).applyInArrow(_involved(need), group), f"{top}/involved")
    more = rest.join(near, F.col("rep") == F.col("id")).drop("id").groupBy(*keys).applyInArrow(_linked(need, width, percent), "a long, b long").distinct()
    r = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    more = more.join(r("a"), "a", "left").join(r("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    tops = written(components(more, f"{top}/joined").select(F.col("node").alias("mid"), F.col("root").alias("top")), f"{top}/tops")
    reps = classes.join(roots, F.col("rep") == F.col("node"), "left").select("n_shingles", "s1", "s2", F.coalesce("root", "rep").alias("mid"))
    classes = reps.join(tops, "mid", "left").select("n_shingles", "s1", "s2", F.coalesce("top", "mid").alias("root"))
    out = done.join(classes, ["n_shingles", "s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row, that of the smallest id, of each component; all columns stay.

    Rows are told apart by a number of their own: of rows that repeat an id or
    have none, too, one of a component stays, and a null id goes before none.
    """
    top = shared_dir(docs.sparkSession)
    rows = numbered(docs, f"{top}/rows")
    picked = pick(rows.toDF(*docs.columns, "lw_row"), lw_row=("lw_row", "long"), doc_id=(id_col, "long"), text=(text_col, "string"))
    found = near_duplicates(picked.select("lw_row", "text"), id_col="lw_row", **options).select(F.col("doc_id").alias("lw_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "lw_row"))["lw_row"]
    stay = found.join(picked.select("lw_row", "doc_id"), "lw_row").groupBy("component_id").agg(first.alias("lw_row")).select("lw_row")
    return rows.join(stay, "lw_row", "left_semi").drop("lw_row").toDF(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of two words, as the contract has it."""
    return near_duplicates(documents(spark, sf_dir), width=2)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) ELSE w END AS s FROM w
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, len(a.s) + len(b.s) AS n, len(list_intersect(a.s, b.s)) AS k
  FROM s a JOIN s b ON a.doc_id < b.doc_id AND len(a.s) > 0 AND 100 * len(a.s) >= 80 * len(b.s) AND 100 * len(b.s) >= 80 * len(a.s)
), l AS (
  SELECT a, b FROM p WHERE 100 * k >= 80 * (n - k) UNION ALL SELECT b, a FROM p WHERE 100 * k >= 80 * (n - k)
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM reach r JOIN l ON l.a = r.id AND r.root < l.b
), c AS (
  SELECT id, min(root) AS component_id FROM reach GROUP BY id
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.id = s.doc_id
"""
