"""Quality: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import fold, labelled_sample, learned, pieces, table, text_or_empty, utf8, wider

#: Bytes of a passage; the last one of a text may be shorter.
PASSAGE = 512
#: Learn from at most so many labelled rows of each class.
SAMPLE = {0: 3000, 1: 6000}
#: Byte classes: lower, upper, digit, space, newline, stop, comma, bar, mark, other ASCII, beyond ASCII.
CLASSES = 11


def _classes() -> np.ndarray:
    kind = np.full(256, 9, dtype=np.int64)
    kind[128:] = 10
    for n, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".;:?", b",", b"|", b"!#$%&*<>=@^_~")):
        kind[list(chars)] = n
    return kind


KIND = _classes()
WIDTH = CLASSES * CLASSES + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and how many each text has (an empty text has an empty one).

    Per passage: shares of the pairs of byte classes (as square roots), shares of words equal to the word
    before and of distinct words, mean word length, words, bytes, and a flag for the first passage.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    total = int(counts.sum())
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    inside = np.arange(len(raw)) - np.repeat(start, sizes)
    home = np.repeat(first, sizes) + inside // PASSAGE
    out = np.zeros((total, WIDTH), dtype=np.float32)
    if len(raw):
        kind = KIND[raw]
        before = np.where(inside == 0, 4, np.concatenate([[4], kind[:-1]]))
        pairs = np.bincount(home * (CLASSES * CLASSES) + before * CLASSES + kind, minlength=total * CLASSES * CLASSES)
        length = np.bincount(home, minlength=total)
        out[:, : CLASSES * CLASSES] = np.sqrt(pairs.reshape(total, -1) / np.maximum(length, 1)[:, None])
        word = (kind != 3) & (kind != 4)
        begin = np.flatnonzero(word & ((before == 3) | (before == 4)))
        if len(begin):
            place = np.arange(len(raw)) - begin[np.searchsorted(begin, np.arange(len(raw)), side="right") - 1]
            sign = np.add.reduceat(np.where(word, (raw.astype(np.int64) + 1) * (place * 7919 + 104729), 0), begin)
            letters = np.add.reduceat(word.astype(np.int64), begin)
            at = home[begin]
            same = np.concatenate([[False], (sign[1:] == sign[:-1]) & (at[1:] == at[:-1])])
            words = np.bincount(at, minlength=total)
            order = np.lexsort((sign, at))
            new = np.concatenate([[True], (sign[order][1:] != sign[order][:-1]) | (at[order][1:] != at[order][:-1])])
            distinct = np.bincount(at[order][new], minlength=total)
            some = np.maximum(words, 1)
            k = CLASSES * CLASSES
            out[:, k] = np.bincount(at[same], minlength=total) / some
            out[:, k + 1] = distinct / some
            out[:, k + 2] = np.minimum(np.bincount(at, weights=letters, minlength=total) / some, 40) / 10
            out[:, k + 3] = np.log1p(words) / 5
        out[:, CLASSES * CLASSES + 4] = length / PASSAGE
    out[first, CLASSES * CLASSES + 5] = 1.0
    return out, counts


@dataclass
class Model:
    """Encoder e, gates v and u with w, and the document's logit c; mean and scale of the inputs."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Encodes passages, weighs them by gated attention within each document, scores the weighted mean."""
        p = self.p
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        h = np.tanh(x @ p["e"] + p["e0"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), counts))
        a = a / np.repeat(np.add.reduceat(a, first), counts)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ p["c"] + p["c0"][0]}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss of documents with labels y, by parameter."""
        p, o = self.p, self.forward(x, counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        g = (1 / (1 + np.exp(-np.clip(o["logit"], -30, 30))) - y) * weight / len(y)
        dz = g[:, None] * p["c"]
        dz_rows = np.repeat(dz, counts, axis=0)
        da = (dz_rows * o["h"]).sum(axis=1)
        dl = o["a"] * (da - np.repeat(np.add.reduceat(o["a"] * da, first), counts))
        dts = dl[:, None] * p["w"]
        dt, ds = dts * o["s"] * (1 - o["t"] ** 2), dts * o["t"] * o["s"] * (1 - o["s"])
        dh = o["a"][:, None] * dz_rows + dt @ p["v"].T + ds @ p["u"].T
        de = dh * (1 - o["h"] ** 2)
        return {"e": x.T @ de, "e0": de.sum(axis=0), "v": o["h"].T @ dt, "u": o["h"].T @ ds, "w": (o["t"] * o["s"]).T @ dl, "c": o["z"].T @ g, "c0": np.array([g.sum()], np.float32)}

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, counts = passages(texts)
        return 1 / (1 + np.exp(-np.clip(self.forward((x - self.mean) / self.scale, counts)["logit"].astype(np.float64), -30, 30)))


def fit(texts: list[str], labels: list[int], share: float, hidden: int = 32, gates: int = 16, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> Model:
    """Adam on the log loss of whole documents; rows are weighted so that the classes weigh as in all rows.

    Without rows of both classes the score is the share of label 1 (a half if there are no rows).
    """
    rng = np.random.default_rng(7)
    p = {k: (rng.standard_normal(n) / np.sqrt(n[0])).astype(np.float32) for k, n in (("e", (WIDTH, hidden)), ("e0", (hidden,)), ("v", (hidden, gates)), ("u", (hidden, gates)), ("w", (gates,)), ("c", (hidden,)), ("c0", (1,)))}
    y = np.array(labels, dtype=np.float32)
    model = Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), p)
    if len(set(labels)) < 2:
        share = share if labels else 0.5
        p["c"][:] = 0
        p["c0"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    parts, some, size = [], [], 0
    for i, t in enumerate(texts):  # a few megabytes at a time, as the counting needs much more than the text
        some.append(t.encode("utf-8", "surrogatepass"))
        size += len(some[-1])
        if size > 1_000_000 or i == len(texts) - 1:
            parts.append(passages(some))
            some, size = [], 0
    x, counts = (np.concatenate(k) for k in zip(*parts, strict=True))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    x = (x - model.mean) / model.scale
    ends = np.cumsum(counts)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for some in (order[i : i + batch] for i in range(0, len(order), batch)):
            n = counts[some]
            rows = np.concatenate([np.arange(ends[d] - counts[d], ends[d]) for d in some])
            grads = model.gradients(x[rows], n, y[some], weight[some])
            step += 1
            for k, grad in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] -= (rate * (0.5 if epoch > epochs * 2 // 3 else 1)) * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * p[k])
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Adds score and predicted to all rows of docs; other columns pass through.

    A null text counts as empty: one passage without bytes, scored like any other. Equal texts get equal scores.
    Columns of docs with the names of the results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2_000_000):
            p = shared.value.score(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    docs = docs.drop("score", "predicted")
    return docs.mapInArrow(run, wider(docs, score="double", predicted="int"))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Learns from the labels of sf_dir that belong to docs: a bounded sample of each class, none of the held-out fold.

    Labels that are null or neither 0 nor 1 and null ids don't count; of several labels of an id the largest
    does, of several texts that with the smallest hash; a null text is empty. Without labels of both classes
    the model is constant.
    """
    sample, share = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", SAMPLE)
    return learned(sample, lambda texts, labels: fit(texts, labels, share))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained(spark, docs, sf_dir)
    out = score(docs.select("doc_id", text_or_empty().alias("text")), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
