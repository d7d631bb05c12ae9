"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training sees at most ``max_train`` labelled documents, the ones whose hashed id is
smallest, so its cost is bounded at any corpus size; scoring covers every word of
every document in one scan without a shuffle. The L1 term leaves few non-zero
coordinates, and only those are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.llm import words as W
from brackwater.sources.shared import spread

MAX_TRAIN = 8000
BITS = 20
GAPS = (1, 2, 3)  # bigrams, then skip-grams over one and two words


@dataclass(frozen=True)
class Model:
    """Sparse weights by feature index, the bias, the score from which a document is toxic, held-out figures."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    threshold: float
    bits: int
    held_out: dict


def features(array: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes with their rows, repeated as often as they occur."""
    words, rows = W.word_hashes(array)
    shift = np.uint64(64 - bits)
    index, row = [(words >> shift).astype(np.int32)], [np.repeat(np.arange(len(array)), np.diff(rows))]
    for gap in GAPS:
        h, r = W.pair_hashes(words, rows, gap, gap)
        index.append((h >> shift).astype(np.int32))
        row.append(r)
    return np.concatenate(index), np.concatenate(row)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-proximal on binary features; the bias is not penalised."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    penalty = np.full((1 << bits) + 1, l1)
    penalty[-1] = 0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * penalty[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= penalty[i]] = 0
        return w

    for epoch in range(epochs):
        for k in np.argsort(W.stream(epoch + 1, len(examples))):
            i = examples[k]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / alpha * w
            n[i] = grown
    w = weights(np.arange((1 << bits) + 1))
    return w[:-1], float(w[-1])


def fit_sample(array: pa.Array, labels: np.ndarray, bits: int = BITS, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.15, l2: float = 0.0) -> Model:
    """Fit on four fifths, set the threshold where F1 is best on the last fifth (the middle of the best range).

    The L1 penalty is l1 times the root of the number of training documents, as the
    noise of a coordinate's gradient sum grows with that root.
    """
    bias = np.array([1 << bits], np.int32)
    examples = []
    for a, b in W.slices(array):
        index, row = features(array.slice(a, b - a), bits)
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(b - a + 1))
        examples += [np.concatenate([np.unique(index[order[cuts[k] : cuts[k + 1]]]), bias]) for k in range(b - a)]
    held = np.arange(len(examples)) % 5 == 4
    train = np.flatnonzero(~held)
    if not len(train) or len(np.unique(labels[train])) < 2:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), -35.0, 0.5, bits, {"rows": len(examples)})
    w, b = ftrl([examples[k] for k in train], labels[train], bits, epochs, alpha, beta, l1 * len(train) ** 0.5, l2)
    index = np.flatnonzero(w)
    dense = np.append(w.astype(np.float32), 0)
    judged = np.flatnonzero(held) if held.any() and len(np.unique(labels[held])) == 2 else train
    p = np.array([1 / (1 + np.exp(-np.clip(dense[examples[k]].sum() + b, -35, 35))) for k in judged])
    y = labels[judged]
    marks = np.unique(np.concatenate([p, [0.5]]))
    mids = (marks[1:] + marks[:-1]) / 2 if len(marks) > 1 else marks
    f1 = np.array([2 * (y[p >= m] == 1).sum() / max(1, (p >= m).sum() + (y == 1).sum()) for m in mids])
    best = mids[f1 == f1.max()]
    threshold = float(best[np.argmin(np.abs(best - 0.5))])
    got = p >= threshold
    figures = {"rows": len(examples), "f1": float(f1.max()), "accuracy": float((got == (y == 1)).mean()), "non_zero": len(index)}
    return Model(index.astype(np.int32), dense[index], b, threshold, bits, figures)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **options) -> Model:
    """Fit on at most max_train labelled documents, whole.

    Labels with a null id or label are left out; of several labels of one id the
    larger counts, of several texts of one id the least. Documents without text have no
    features. With no labels, or labels of one class only, the model rejects nothing.
    """
    spark = docs.sparkSession
    W.bound_batches(spark)
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).cast("int").alias("__y"))
        .where("__id is not null and __y is not null")
        .groupBy("__id").agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    )
    sample = (
        docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
        .where("__text is not null")
        .join(F.broadcast(chosen), "__id")  # max_train rows of two numbers at any size
        .groupBy("__id").agg(F.min("__text").alias("__text"), F.max("__y").alias("__y"))  # a row for each label, however often its id repeats
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        table = table.sort_by([("h", "ascending"), ("__id", "ascending"), ("__text", "ascending")])
        m = fit_sample(table["__text"].combine_chunks(), table["__y"].to_numpy().astype(float), **options)
        said = [float(m.held_out.get(k, 0)) for k in ("rows", "f1", "accuracy")]
        index = np.concatenate([m.index, np.arange(-5, 0)]).astype(np.int32)
        weight = np.concatenate([m.weight.astype(float), [m.bias, m.threshold, *said]])
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(weight)], ["i", "w"])

    rows = (
        sample.withColumn("h", F.xxhash64("__id")).repartition(1)
        .mapInArrow(train, "i int, w double").toArrow()
    )
    bits = options.get("bits", BITS)
    i, w = rows["i"].to_numpy(), rows["w"].to_numpy()
    if not len(i):
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), -35.0, 0.5, bits, {"rows": 0})
    extra = dict(zip(i[i < 0].tolist(), w[i < 0].tolist()))
    keep = i >= 0
    return Model(i[keep], w[keep].astype(np.float32), extra[-5], extra[-4], bits, {"rows": int(extra[-3]), "f1": extra[-2], "accuracy": extra[-1], "non_zero": int(keep.sum())})


def scores(array: pa.Array, model: Model, dense: np.ndarray) -> np.ndarray:
    """The probability of each row."""
    out = np.empty(len(array))
    for a, b in W.slices(array):
        index, row = features(array.slice(a, b - a), model.bits)
        hit = np.flatnonzero(dense[index])
        pairs = np.unique(row[hit].astype(np.int64) << 32 | index[hit])
        out[a:b] = np.bincount(pairs >> 32, dense[pairs & 0xFFFFFFFF], b - a) + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _dense(model: Model) -> np.ndarray:
    dense = np.zeros(1 << model.bits, np.float32)
    dense[model.index] = model.weight
    return dense


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity, toxic) of every document, in one scan.

    A null or empty text has the score of the bias alone, a score at the threshold is
    toxic. Repeated rows, null ids and very long texts are scored like any other row; an
    empty table gives an empty one. Other columns of docs are not read.
    """
    W.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dense = _dense(m)
        for batch in batches:
            p = scores(batch.column(1), m, dense)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= m.threshold)], ["doc_id", "toxicity", "toxic"])

    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("toxicity", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(run, out)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without its toxic rows, with all its columns; the cases of score() hold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dense = _dense(m)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(place), m, dense) < m.threshold))

    return W.through(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole documents table by a model of its labels."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
