"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import fold, labelled_sample, learned, pieces, table, text_or_empty, wider

#: Lengths of the n-grams, in characters of the lower-cased text between two spaces.
GRAMS = (3, 4, 5, 6)
#: Learn from at most so many labelled rows of each class, and keep so many n-grams.
SAMPLE = {0: 6000, 1: 2000}
FEATURES = 2048
#: Characters worked on at once; pieces of a longer text overlap by the longest n-gram.
PIECE = 400_000
SLOT_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """64-bit codes of all n-grams, as arrays with one length and one piece of the text each."""
    text = f" {text.lower()} "
    for start in range(0, len(text), PIECE):
        part = text[start : start + PIECE + max(GRAMS) - 1]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        points[points - np.uint64(9) <= 4] = 32  # any ASCII white space
        code = points
        for n in range(2, max(GRAMS) + 1):
            if len(points) < n:
                break
            code = code[:-1] * BASE + points[n - 1 :]
            if n in GRAMS:
                yield code * MIX


def slots(codes: np.ndarray) -> np.ndarray:
    return codes >> np.uint64(64 - SLOT_BITS)


def gathered(text: str, wanted: np.ndarray) -> np.ndarray:
    """The distinct codes of a text whose slots are wanted."""
    hits = [codes[wanted[slots(codes)]] for codes in gram_codes(text)]
    return np.unique(np.concatenate(hits)) if hits else np.empty(0, np.uint64)


@dataclass
class Model:
    """Sorted codes, and what each adds to the log odds of a document that holds it, however often."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        wanted = np.zeros(1 << SLOT_BITS, dtype=bool)
        wanted[slots(self.codes)] = True
        odds = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            _, at, _ = np.intersect1d(self.codes, gathered(text, wanted), assume_unique=True, return_indices=True)
            odds[i] += self.weights[at].sum()
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))


def ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Naive Bayes log-count ratio of document counts, smoothed by one."""
    return np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))


def evidence(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log likelihood gained by telling the classes apart with a feature; 0 below three documents."""
    both = (pos + neg) / (n_pos + n_neg)

    def fit(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    gain = fit(pos, n_pos, pos / n_pos) + fit(neg, n_neg, neg / n_neg) - fit(pos, n_pos, both) - fit(neg, n_neg, both)
    return np.where(pos + neg >= 3, gain, 0.0)


def fit(texts: list[str], labels: list[int], share: float, features: int = FEATURES, steps: int = 600, ridge: float = 1e-5) -> Model:
    """Selects n-grams by the evidence they give, scales them by their log-count ratio, fits logistic regression.

    Document counts are first taken by hash slot, then by exact code in the best slots. Without rows of both
    classes the model is the share of label 1 alone.
    """
    y = np.array(labels, dtype=np.float64)
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    prior = np.log((share * len(y) + 0.1) / ((1 - share) * len(y) + 1.0)) if len(y) else -3.0
    if not n_pos or not n_neg:
        return Model(np.empty(0, np.uint64), np.empty(0), float(prior))
    counts = np.zeros((2, 1 << SLOT_BITS), dtype=np.int32)
    for text, label in zip(texts, labels, strict=True):
        seen = [slots(codes) for codes in gram_codes(text)]
        if seen:
            counts[label, np.unique(np.concatenate(seen))] += 1
    some = np.flatnonzero(counts.sum(axis=0) >= 3)
    gain = np.empty(len(some))
    for k in range(0, len(some), 1 << 18):  # the slots are many, and the driver holds several arrays of them
        part = some[k : k + (1 << 18)]
        gain[k : k + len(part)] = evidence(counts[1, part].astype(float), counts[0, part].astype(float), n_pos, n_neg)
    best = np.argsort(-gain, kind="stable")[: 2 * features]
    wanted = np.zeros(1 << SLOT_BITS, dtype=bool)
    wanted[some[best[gain[best] > 0]]] = True
    del counts, some
    held = [gathered(text, wanted) for text in texts]
    codes, at = np.unique(np.concatenate(held), return_inverse=True)
    doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
    pos = np.bincount(at, weights=y[doc], minlength=len(codes))
    neg = np.bincount(at, minlength=len(codes)) - pos
    gain = evidence(pos, neg, n_pos, n_neg)
    kept = np.sort(np.argsort(-gain, kind="stable")[:features])
    kept = kept[gain[kept] > 0]
    place = np.full(len(codes), -1)
    place[kept] = np.arange(len(kept))
    scale = ratio(pos[kept], neg[kept], n_pos, n_neg).astype(np.float32)
    x = np.zeros((len(y), len(kept)), dtype=np.float32)
    inside = place[at] >= 0
    x[doc[inside], place[at][inside]] = scale[place[at][inside]]
    beta, bias = np.zeros(len(kept), dtype=np.float32), float(np.log(n_pos / n_neg))
    del held, at, doc, inside
    step = 4.0 / max(1e-6, float(np.einsum("ij,ij->i", x, x).mean()) + 1.0)
    ahead, ahead_bias = beta, bias
    for k in range(steps):  # accelerated gradient descent
        error = 1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -30, 30))) - y.astype(np.float32)
        new, new_bias = ahead - step * (x.T @ error / len(y) + ridge * ahead), ahead_bias - step * float(error.mean())
        ahead, ahead_bias = new + k / (k + 3) * (new - beta), new_bias + k / (k + 3) * (new_bias - bias)
        beta, bias = new, new_bias
    bias += prior - np.log(n_pos / n_neg)  # the classes were sampled apart
    return Model(codes[kept], (beta * scale).astype(np.float64), float(bias))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Adds score and predicted to all rows of docs (doc_id, text and any others, which pass through).

    A null text counts as empty and gets the model's bias; equal texts get equal scores. Columns of docs with
    the names of the results are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            p = shared.value.score([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    docs = docs.drop("score", "predicted")
    return docs.mapInArrow(run, wider(docs, score="double", predicted="int"))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Learns from the labels of sf_dir that belong to docs; folds by crc32 keep a fifth of the rows out.

    Labels that are null or neither 0 nor 1 and null ids don't count; of several labels of an id the largest
    does, of several texts that with the smallest hash; a null text is empty. Without labels of both classes
    the model is their share alone.
    """
    sample, share = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", SAMPLE)
    return learned(sample, lambda texts, labels: fit(texts, labels, share))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained(spark, docs, sf_dir)
    out = score(docs.select("doc_id", text_or_empty().alias("text")), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
