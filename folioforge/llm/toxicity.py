"""Operator 6: toxicity by a character n-gram linear classifier with naive Bayes scaled features.

A text's features are the hashed n-grams of code points of the whole text (A-Z in lower case,
white space runs as one space, a space at both ends), each counted once. A feature's scale is
its naive Bayes log-count ratio between toxic and other training rows; a linear support vector
machine is fitted to the scaled features (dual coordinate descent) and mixed with the mean
magnitude of its weights. A logistic curve turns the margin into a score; it is fitted to the
margins that each fourth of the rows gets from a machine fitted to the other rows.

The fit takes a bounded sample of the labelled training rows: at most SAMPLE rows of each
label, those with the smallest hashes of their ids, of texts of at most SAMPLE_CHARS code
points. Scoring takes every row and whole texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import cut, prepare, table, texts_of

BITS = 20
GRAMS = (3, 4, 5, 6)
SAMPLE, SAMPLE_CHARS = 1500, 20_000
LEAST_ROWS, LEAST_Z = 6, 3.5
FOLDS = 4
#: Features with a smaller |z| among all sampled rows are not looked at; the fit asks for LEAST_Z.
FIRST_Z = 2.0
#: Partitions of the sample.
SAMPLE_PARTS = 12
#: Bytes of a text that are taken at once.
SLICE = 1 << 18
FACTOR, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _code_points(text: bytes):
    """The cleaned text's code points, a slice at a time; each slice but the first begins with the last ones of that before it."""
    clean = b" " + b" ".join(text.lower().split()) + b" "
    keep, at = np.zeros(0, np.uint64), 0
    while at < len(clean):
        end = min(len(clean), at + SLICE)
        while end < len(clean) and clean[end] & 0xC0 == 0x80:  # within a character
            end += 1
        own = np.frombuffer(clean[at:end].decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        whole = np.concatenate((keep, own))
        yield whole, len(keep)
        keep, at = whole[max(0, len(whole) - max(GRAMS) + 1) :], end


def grams(text: bytes) -> np.ndarray:
    """Feature numbers of a text's n-grams of code points, repeats included; only those that end in a slice are added by it."""
    found = []
    for points, before in _code_points(text):
        h = points
        for n in range(1, max(GRAMS) + 1):
            if n > 1:
                h = h[:-1] * FACTOR + points[n - 1 :]
            if not len(h):
                break
            if n in GRAMS:
                mixed = (h[max(0, before - n + 1) :] + np.uint64(n)) * TURN
                found.append((((mixed ^ mixed >> np.uint64(32)) * FACTOR) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


class Once:
    """Picks each number once, without sorting."""

    def __init__(self):
        self.stamp = np.zeros(1 << BITS, np.int32)

    def of(self, features: np.ndarray) -> np.ndarray:
        at = np.arange(len(features), dtype=np.int32)
        self.stamp[features] = at
        return features[self.stamp[features] == at]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        margin = float(self.weights[features].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def held_out(doc_id: int | None) -> bool:
    """Whether the row's label is kept for testing: crc32 of the id as text is a multiple of 5."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def _svm(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """L2-loss support vector machine over rows of feature numbers, whose values are scale's."""
    w, b = np.zeros(len(scale)), 0.0
    norms = np.array([float((scale[r] ** 2).sum()) + 1 for r in rows])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            gradient = y[i] * (w[r] @ scale[r] + b) - 1 + alpha[i] / (2 * cost[i])
            new = max(0.0, alpha[i] - gradient / (norms[i] + 1 / (2 * cost[i])))
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * scale[r]
                b += step
                alpha[i] = new
    return w, b


def _curve(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by damped Newton steps, a little regularised."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - y) * weight * margins).sum() + 0.05 * (a - 1), ((p - y) * weight).sum()])
        v = weight * np.maximum(p * (1 - p), 1e-4)
        hess = np.array([[(v * margins**2).sum() + 0.05, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(a, 1e-3), b


def _weights(rows: list[np.ndarray], labels: np.ndarray, pick: np.ndarray, mix: float) -> tuple[np.ndarray, float]:
    """Weights of all features, and the bias, of the machine fitted to the picked rows, which have both labels."""
    n = 1 << BITS

    def counts(own):
        return np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(own)]), minlength=n).astype(float)

    p, q = counts(pick & (labels == 1)), counts(pick & (labels == 0))
    np_, nq = float((pick & (labels == 1)).sum()), float((pick & (labels == 0)).sum())
    ratio = np.log((p + 0.5) / (np_ + 1)) - np.log((q + 0.5) / (nq + 1))
    share = (p + q) / (np_ + nq)
    z = np.abs(p / np_ - q / nq) / np.sqrt(share * (1 - share) * (1 / np_ + 1 / nq) + 1e-12)
    scale = np.where((p + q >= LEAST_ROWS) & (z >= LEAST_Z), ratio, 0.0)
    some = np.flatnonzero(pick)
    y = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(y == 1, 0.5 / np_, 0.5 / nq) * 200
    w, b = _svm([rows[i][scale[rows[i]] != 0] for i in some], y[some], scale, cost[some])
    active = w != 0
    if active.any():
        w = (1 - mix) * np.where(active, np.sign(w) * np.abs(w[active]).mean(), 0) + mix * w
    return w * scale, b


def fit(rows: list[np.ndarray], labels: np.ndarray, shares: tuple[float, float], mix: float = 0.25) -> Model:
    """rows: feature numbers, each once; shares: how many rows of the corpus one sampled row of label 0 and 1 stands for."""
    if not (labels == 1).any() or not (labels == 0).any():
        share = float((labels == 1).mean()) if len(labels) else 0.0
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    whole, bias = _weights(rows, labels, np.ones(len(rows), bool), mix)
    margins = np.array([whole[r].sum() + bias for r in rows])
    fold = np.arange(len(rows)) % FOLDS
    for k in range(FOLDS):
        if len(np.unique(labels[fold != k])) == 2:
            w, b = _weights(rows, labels, fold != k, mix)
            own = np.flatnonzero(fold == k)
            margins[own] = [w[rows[i]].sum() + b for i in own]
    slope, shift = _curve(margins, (labels == 1).astype(float), np.where(labels == 1, shares[1], shares[0]))
    return Model(whole.astype(np.float32), float(bias), slope, shift)


def _counted(batches):
    """Rows (text, label) -> of each feature how many rows of either label have it."""
    once, counts = Once(), np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, label in zip(texts_of(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            counts[label, once.of(grams(text))] += 1
    some = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(counts[k, some].astype(np.int64)) for k in (0, 1))], names=["feature", "n0", "n1"])


def _features(shared):
    def run(batches):
        once, wanted = Once(), np.zeros(1 << BITS, bool)
        wanted[shared.value] = True
        for batch in batches:
            rows = [f[wanted[f]].tobytes() for f in (once.of(grams(t)) for t in texts_of(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("at"), pa.array(rows, pa.binary())], names=["label", "at", "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from at most `sample` rows of each label that are not held out.

    Rows without a label, an id or a text of at most sample_chars are not learnt from; a row
    that repeats is learnt from as often. Where one label is missing, or a table is empty, the
    score is the same for all texts: the share of label 1. Features are counted in tasks, and
    the driver gets those that a row has of the features whose share differs between the labels.
    """
    spark = prepare(docs.sparkSession)
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    ids = ids.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    totals = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}
    fitting = docs.select(F.col(id_col).cast("long").alias("id"), F.char_length(F.col(text_col)).alias("size")).where(F.col("size") <= sample_chars).select("id")
    chosen = None
    for label in (0, 1):
        part = ids.where(F.col("label") == label).join(fitting, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    chosen = spark.createDataFrame(chosen.collect(), "id long, label int")  # 2 * sample rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = cut(texts.where(F.char_length("text") <= sample_chars).select("text", "label", F.xxhash64("id").alias("at")).repartition(SAMPLE_PARTS))
    n = {r.label: float(r["count"]) for r in texts.groupBy("label").count().collect()}
    n0, n1 = max(1.0, n.get(0, 0.0)), max(1.0, n.get(1, 0.0))
    counts = texts.mapInArrow(_counted, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    wanted = counts.where((F.col("n0") + F.col("n1") >= LEAST_ROWS) & (z >= FIRST_Z)).select("feature").toArrow().column("feature").to_numpy()
    got = texts.mapInArrow(_features(spark.sparkContext.broadcast(wanted)), "label int, at long, features binary").collect()
    got = sorted(got, key=lambda r: (r["at"], r["label"], bytes(r["features"])))
    y = np.array([r["label"] for r in got], np.int64)
    shares = tuple(max(1.0, totals.get(k, 0) / max(1, int((y == k).sum()))) for k in (0, 1))
    return fit([np.frombuffer(r["features"], np.int32) for r in got], y, shares)


def _scores(shared):
    def run(batches):
        model, once = shared.value, Once()
        for batch in batches:
            scores = [model.score(once.of(grams(t))) for t in texts_of(batch.column("text"))]
            out = [held_out(i) for i in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, score, predicted), one for each row of docs.

    Null text counts as empty, and empty texts have a score; rows that repeat stay; a null
    id stays null and is not held out; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_scores(spark.sparkContext.broadcast(model)), "id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text has a score of 0.5 or more; all columns stay as they are.

    Null text counts as empty; rows that repeat stay or go together; ids are not looked at; an
    empty table gives an empty result.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        own, once = shared.value, Once()
        for batch in batches:
            yield batch.filter(pa.array([own.score(once.of(grams(t))) < 0.5 for t in texts_of(batch.column(text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.withColumnRenamed("id", "doc_id")
