"""Operator 9: exact deduplication with an extendible-hash index on shared files.

Every text, lower-cased in A-Z only, has a 64-bit key. The index maps keys to
chains of texts and is kept as tables in the shared folder:

* ``directory``: a slot for each key prefix of ``depth`` bits, with the bucket
  that it points to. It doubles as long as a slot holds more distinct keys
  than a bucket's capacity; a bucket that holds few keeps a shorter prefix, and
  several slots point to it. Only the 64 bits of a key end the doubling.
* ``index``: the entries of all keys by owner and bucket. An owner is a range
  of keys, the leading bits; its task has all buckets of its range. Texts of
  one key are compared byte by byte, and those that differ are links of a chain.

A row finds its class by its slot, that slot's bucket and the chain of its key
there. Only texts whose key occurs twice can be equal, so only those are
moved for the comparison: a filter of bounded size keeps the others where they
are, and rows of one text are pre-aggregated before the shuffle, so a group of
copies of any size arrives as one row from each task. Groups that hold more
than one in ``HOT`` of all rows, fewer than ``HOT``, are looked up by a broadcast,
so no task reads all rows of such a group.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bit_filtered, bit_words, documents, numbered, pick, shared_dir, written

HOT = 10_000
#: Bits by which the directory grows at a time, and by which it starts below the depth that an even spread would need.
STEP, EARLY = 3, 2


def prefix(key: str, bits: int) -> Column:
    """The leading bits of a key as a number; 0 for no bits."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, n: int, capacity: int, path: str) -> tuple[DataFrame, int, int]:
    """Of n distinct keys (key): the directory (slot, bucket, bits), its depth, and the depth at which it started.

    A slot's bucket is named by its first slot; bits is its local depth: the
    shortest prefix, from the start's on, that at most capacity keys have.
    Slots without keys are left out.
    """
    even = max(0, ceil(log2(max(n, 1) / capacity)))
    start, depth = max(0, even - EARLY), min(64, even + STEP)
    while True:
        slots = written(keys.groupBy(prefix("key", depth).alias("slot")).agg(F.count("*").alias("n")), f"{path}/slots{depth}")
        if depth == 64 or (slots.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        depth = min(64, depth + STEP)
    each = slots.withColumn("bits", F.explode(F.sequence(F.lit(start), F.lit(depth))))
    each = each.withColumn("head", F.when(F.col("bits") > 0, F.expr(f"shiftrightunsigned(slot, {depth} - bits)")).otherwise(F.lit(0)).cast("long"))
    fits = each.groupBy("bits", "head").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("bits") == depth)).select("bits", "head")
    found = each.join(fits, ["bits", "head"]).groupBy("slot").agg(F.min(F.struct("bits", "head")).alias("b"))
    bucket = F.when(F.col("b.bits") > 0, F.expr(f"shiftleft(b.head, {depth} - b.bits)")).otherwise(F.lit(0)).cast("long")
    return written(found.select("slot", bucket.alias("bucket"), F.col("b.bits").alias("bits")), f"{path}/directory"), depth, start


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> DataFrame:
    """Each row's class of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text is
    an empty one. keep_id is the largest id of the class; ids that are null are
    never the largest, and a class of null ids only has a null keep_id. kept
    says whether doc_id is keep_id (null equals null here); rows that repeat an
    id within a class are all marked alike. An empty table gives no rows.
    Extra columns are ignored. capacity: distinct keys that a bucket holds.
    """
    return _classes(pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")), shared_dir(docs.sparkSession), capacity)


def _classes(picked: DataFrame, top: str, capacity: int = 4096) -> DataFrame:
    """exact_duplicates of (doc_id, text); further columns of picked come first."""
    more = [c for c in picked.columns if c not in ("doc_id", "text")]
    texts = picked.select(*more, "doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm")).withColumn("key", F.xxhash64("norm"))
    sha = F.unhex(F.sha2("norm", 256)).alias("digest")
    entries = written(texts.select(*more, "doc_id", "key", sha), f"{top}/entries")
    keys = written(entries.groupBy("key").agg(F.count("*").alias("n"), F.first("digest").alias("digest"), F.max("doc_id").alias("keep_id")), f"{top}/keys")
    told = keys.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("n").alias("rows")).first()
    slots, depth, start = directory(keys.select("key"), told["keys"], capacity, top)
    owner = min(start, max(start - 6, 6))

    again = keys.where("n > 1").select("key")
    bits = min(max(ceil(log2(8 * told["repeated"] + 1)), 12), 26)  # at most 2**20 words are broadcast
    shared = bit_filtered(texts, "key", bit_words(again, "key", bits), bits)
    # Equal bytes meet in one group; what remains apart under one key are the links of its chain.
    compared = shared.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    links = compared.select("key", sha, "keep_id", "group_size").join(again, "key", "left_semi")
    links = links.unionByName(keys.where("n = 1").select("key", "digest", "keep_id", F.col("n").alias("group_size")))
    owned = links.withColumn("slot", prefix("key", depth)).join(slots, "slot").withColumn("owner", prefix("key", owner))
    owned = owned.repartition("owner").sortWithinPartitions("owner", "bucket", "key", "digest")
    link = F.expr("row_number() OVER (PARTITION BY owner, bucket, key ORDER BY digest) - 1")
    index = written(owned.withColumn("link", link).select("owner", "bucket", "key", "link", "digest", "keep_id", "group_size"), f"{top}/index")

    hot = index.where(F.col("group_size") > max((told["rows"] or 0) / HOT, 1)).select("key", "digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    met = entries.join(F.broadcast(hot), ["key", "digest"], "left")  # fewer than HOT rows
    walked = met.where("hot_size IS NULL").drop("hot_id", "hot_size").withColumn("slot", prefix("key", depth)).join(slots.select("slot", "bucket"), "slot")
    walked = walked.join(index.select("bucket", "key", "digest", "keep_id", "group_size"), ["bucket", "key", "digest"])
    cols = [*more, "doc_id", "digest", "keep_id", "group_size"]
    found = met.where("hot_size IS NOT NULL").select(*more, "doc_id", "digest", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size")).unionByName(walked.select(*cols))
    return found.select(*more, "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of equal texts, one with the class's keep_id; all columns stay. Ids may repeat or be null."""
    top = shared_dir(docs.sparkSession)
    rows = numbered(docs, f"{top}/rows")
    picked = pick(rows.toDF(*docs.columns, "lw_row"), lw_row=("lw_row", "long"), doc_id=(id_col, "long"), text=(text_col, "string"))
    stay = _classes(picked, top).where("kept").groupBy("text_sha256").agg(F.min("lw_row").alias("lw_row")).select("lw_row")
    return rows.join(stay, "lw_row", "left_semi").drop("lw_row").toDF(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP9_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
