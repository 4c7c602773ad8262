"""Operator 6: toxicity by cumulative-link ordinal regression on sparse text features.

Severity has grades 0 (clean) to 3. One weight per feature is shared by all
grades, and ordered thresholds cut the sum of weights into grades:
``P(grade >= k) = logistic(weights * features - threshold_k)``. The expected
severity is the sum of these probabilities over k; a text is rejected if grade
1 or more is as likely as not.

The labels say toxic or not. Among toxic samples the grade follows how often
features of toxic texts occur: the thirds of their counts are grades 1, 2, 3.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pick, shared_dir, written

TOKEN = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
GRADES = 3


def counted(text: str | None) -> Counter:
    """Sparse features of a text: its words in lower case, and the words' first letters (marked with ``^``)."""
    words = Counter(TOKEN.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                out[f"^{w[:k]}"] += n
    return out


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]  # ascending; empty if there was nothing to learn from

    def severity(self, text: str | None) -> tuple[float, ...]:
        """P(grade >= k) for k = 1 .. GRADES."""
        if not self.thresholds:
            return (0.0,) * GRADES
        words = Counter(TOKEN.findall((text or "").lower()))
        sums: dict[str, int] = {}
        for w, n in words.items():
            if w in self.weights:
                sums[w] = sums.get(w, 0) + n
            for k in STEMS:
                if len(w) > k and (s := "^" + w[:k]) in self.weights:
                    sums[s] = sums.get(s, 0) + n
        z = sum(self.weights[f] * np.log1p(n) for f, n in sums.items())
        return tuple(float(1 / (1 + np.exp(-np.clip(z - t, -500, 500)))) for t in self.thresholds)


def fitted(rows: list[tuple[int, float, list[int], list[int]]], names: list[str], steps: int = 600, rate: float = 0.1, ridge: float = 5e-5) -> Model:
    """Weights and thresholds from rows of (grade, sample weight, feature numbers, counts), by Adam on the whole sample."""
    y, sw = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    sw = sw / sw.sum()
    row = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    col = np.concatenate([np.asarray(r[2], np.int64) for r in rows]) if len(row) else np.zeros(0, np.int64)
    val = np.log1p(np.concatenate([np.asarray(r[3], float) for r in rows])) if len(row) else np.zeros(0)
    k, n = GRADES, len(names)
    x = np.concatenate((np.zeros(n), [1.0], np.zeros(k - 1)))  # weights, first threshold, logs of the gaps
    m, v = np.zeros_like(x), np.zeros_like(x)
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    for step in range(1, steps + 1):
        w, gaps = x[:n], np.exp(x[n + 1 :])
        cut = np.concatenate(([-np.inf], x[n] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
        z = np.bincount(row, w[col] * val, len(rows))
        up, low = sig(cut[y + 1] - z), sig(cut[y] - z)
        up[y == k], low[y == 0] = 1.0, 0.0
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up), low * (1 - low)
        gz = sw * (du - dl) / p  # gradient of the loss by z
        gcut = np.zeros(k)
        np.add.at(gcut, y[y < k], (-sw * du / p)[y < k])
        np.add.at(gcut, y[y > 0] - 1, (sw * dl / p)[y > 0])
        tail = np.cumsum(gcut[::-1])[::-1]
        g = np.concatenate((np.bincount(col, gz[row] * val, n) + ridge * w, [tail[0]], tail[1:] * gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    cut = x[n] + np.concatenate(([0.0], np.cumsum(np.exp(x[n + 1 :]))))
    return Model({f: float(v) for f, v in zip(names, x[:n]) if v}, [float(c) for c in cut])


def trained(docs: DataFrame, labels: DataFrame, most_labels: int = 8000, most_features: int = 400, least_docs: int = 4) -> Model:
    """A model from at most most_labels labelled documents, half of them toxic if there are as many.

    They are those of lowest hash of the id, so the sample is the same at each
    run; equal texts are one sample, and rows that repeat an id are samples of
    their own. Features are the most_features that tell
    most by the likelihood-ratio statistic, among those in least_docs sample
    documents. labels: doc_id,
    toxic; null ids or labels don't count, and of labels that contradict each
    other toxic wins. Without both kinds of labels the model rejects nothing.
    """
    top = shared_dir(docs.sparkSession)
    known = pick(labels, doc_id=("doc_id", "long"), toxic=("toxic", "int")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r.toxic: r.n for r in known.withColumn("toxic", (F.col("toxic") > 0).cast("int")).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(share) != {0, 1}:
        return Model({}, [])
    half = most_labels // 2
    picked = [known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for c in ("toxic > 0", "toxic = 0")]
    ids = written(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("l_id"), (F.col("toxic") > 0).cast("int").alias("toxic")), f"{top}/labels")  # at most most_labels rows
    sample = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = sample.select(F.xxhash64("text").alias("hash"), "toxic", "text")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [counted(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["hash", "toxic", "f", "n"])

    bags = sample.mapInArrow(run, "hash long, toxic int, f array<string>, n array<int>")
    bags = written(bags.withColumn("row", F.monotonically_increasing_id()), f"{top}/bags")  # a row for each sample, whatever its id
    sizes = {r.toxic: r.n for r in bags.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model({}, [])
    df = bags.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("b")).where(F.col("b") >= least_docs)
    b_, rate_t = F.col("b") - F.col("a"), sizes[1] / (sizes[0] + sizes[1])
    part = lambda n, share: F.when(n > 0, n * F.log(n / (F.col("b") * share))).otherwise(0.0)
    gain = 2 * (part(F.col("a"), rate_t) + part(b_, 1 - rate_t))
    best = df.select("f", F.when(F.col("a") > rate_t * F.col("b"), gain).otherwise(-gain).alias("z")).orderBy(F.desc(F.abs("z")), "f").limit(most_features).collect()
    names = [r.f for r in best]
    at = {f: i for i, f in enumerate(names)}
    telling = {i for i, r in enumerate(best) if r.z > best[0].z / 10}
    lookup = docs.sparkSession.createDataFrame([(f, i) for f, i in at.items()], "f string, i int")  # at most most_features rows
    e = bags.select("row", F.explode(F.arrays_zip("f", "n")).alias("e")).select("row", F.col("e.f").alias("f"), F.col("e.n").alias("n"))
    e = e.join(F.broadcast(lookup), "f").groupBy("row").agg(F.collect_list(F.struct("i", "n")).alias("e"))
    features = {r.row: sorted((x.i, x.n) for x in r.e) for r in e.collect()}
    labelled = [(r.row, r.toxic) for r in bags.select("row", "toxic", "hash").orderBy("hash", "row").collect()]  # at most most_labels and those that repeat an id
    hits = {d: sum(n for i, n in features.get(d, ()) if i in telling) for d, _ in labelled}
    cuts = np.quantile([hits[d] for d, t in labelled if t], [1 / 3, 2 / 3])
    sample_rows = []
    for d, t in labelled:
        grade = 1 + int(hits[d] > cuts[0]) + int(hits[d] > cuts[1]) if t else 0
        e = features.get(d, [])
        sample_rows.append((grade, share[t] / sizes[t], [i for i, _ in e], [n for _, n in e]))
    return fitted(sample_rows, names)


SCORES = "doc_id long, p_mild double, p_strong double, p_severe double, expected_severity double, grade int, rejected boolean"


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, **options) -> DataFrame:
    """Each document's probabilities of severity 1, 2, 3 or more, expected severity, likeliest grade, and whether it is rejected.

    Null texts are empty. Rows that repeat an id are scored one by one, null
    ids stay, an empty table gives no rows, extra columns are ignored.
    """
    texts = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    model = model or trained(texts, labels, **options)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            p = np.array([model.severity(t.as_py()) for t in batch.column(1)]).reshape(-1, GRADES)
            full = np.column_stack((np.ones(len(p)), p, np.zeros(len(p))))
            grade = np.argmax(full[:, :-1] - full[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(GRADES)), pa.array(p.sum(1)), pa.array(grade, pa.int32()), pa.array(p[:, 0] >= limit)], SCORES.replace(",", "").split()[::2])

    return texts.mapInArrow(run, SCORES)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5, **options) -> DataFrame:
    """docs without the rows that the operator rejects; all its columns stay, whatever their names and types."""
    model = trained(pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")), labels, **options)
    cols = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*cols), docs.columns.index(text_col)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([model.severity(t.as_py())[0] < limit for t in batch.column(at)], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
