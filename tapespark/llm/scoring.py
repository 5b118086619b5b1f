"""LM scoring: a log-bilinear model trained by noise-contrastive estimation, and a smoothed unigram base."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, pieces, table, text_or_empty, utf8, written

#: Units of the first level: the most frequent words, classes of all others by their ending, the end.
UNITS, CLASSES = 256, 64
SHORT = UNITS - CLASSES - 1
STOP = UNITS - 1
#: The end of a text in the table of counts; no word holds white space.
END = b"\n"
#: Words that are frequent enough are sent to all tasks, never more than this, and have a vector of their own in the
#: second level; the others are joined, and share what their class leaves to them.
FREQUENT = 1 << 17
#: Dimensions, noise samples per token, rounds of training, steps of a task in each, tasks.
DIM, NOISE, ROUNDS, STEPS, PARTS = 24, 16, 12, 24, 16
#: Dimensions and steps of the second level, one model for each class.
INNER_DIM, INNER_STEPS = 8, 40
#: What the second level knows of the word before: the frequent words, GROUPS groups of the classes, the end.
GROUPS = 16
BEFORE = np.concatenate([np.arange(SHORT), SHORT + np.arange(CLASSES) % GROUPS, [SHORT + GROUPS]])
BEFORES = SHORT + GROUPS + 1
#: How strongly its vectors are held near zero and its biases near the unigram's, in counts.
PRIOR = 4.0


def class_of(word: bytes) -> int:
    return SHORT + zlib.crc32(word[-3:]) % CLASSES


class _Places(dict):
    """word -> place in the table of frequent words, -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """Frequent words in order (the first SHORT are units of their own), their counts, and the sums that the base and the classes need.

    rest_tokens, rest_types: of the words of each class that are not frequent.
    """

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    types: int
    ends: int
    rest_tokens: np.ndarray
    rest_types: np.ndarray

    def __post_init__(self) -> None:
        self.places = _Places((w, i) for i, w in enumerate(self.words))
        self.units = np.array([i if i < SHORT else class_of(w) for i, w in enumerate(self.words)], dtype=np.int64)
        self.base = np.log10((self.counts + 1) / (self.tokens + self.types + 1))

    def members(self, kind: int) -> np.ndarray:
        """Places of the frequent words of a class."""
        return np.flatnonzero(self.units == SHORT + kind)

    def unigram(self, kind: int) -> np.ndarray:
        """Smoothed probabilities of a class's frequent words and, last, of its others."""
        seen = np.append(self.counts[self.members(kind)], self.rest_tokens[kind]) + 1.0
        return seen / seen.sum()

    def targets(self, place: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """What the second level tells apart: a frequent word by its place, the others of a class by the number of words and the class; -1 for units that are words."""
        kind = unit - SHORT
        return np.where((kind < 0) | (unit == STOP), -1, np.where(place >= 0, place, len(self.words) + kind))

    def sequence(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """Over all texts: places (-1: not frequent, -2: the end), units, tokens of each text; and the words not frequent, by text."""
        places, sizes, others = [], [], []
        look = self.places.__getitem__
        for raw in raws:
            words = raw.lower().split()
            at = np.fromiter(map(look, words), dtype=np.int64, count=len(words))
            places += [at, np.array([-2])]
            sizes.append(len(words) + 1)
            others.append([words[i] for i in np.flatnonzero(at < 0).tolist()])
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        unit = np.where(place >= 0, self.units[place] if len(self.units) else STOP, STOP)
        rest = [class_of(w) for some in others for w in some]
        unit[place == -1] = rest
        return place, unit, np.array(sizes, dtype=np.int64), others


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, END for the ends; each task adds up its own words before they are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ends = Counter(), 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        for batch in pieces(batches, "text", 3_000_000):
            for raw in utf8(batch.column("text")):
                found.update(raw.lower().split())
                ends += 1
            if len(found) > 300_000:
                yield give()
                found.clear()
        found[END] += ends
        if ends:
            yield give()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words with at least the smallest power of two that leaves no more than FREQUENT, and the sums over all."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    steps = {r[0]: r[1] for r in counts.where(F.col("word") != END).groupBy(F.floor(F.log2("n")).alias("e")).count().collect()}
    least, held = 64, 0
    while least > 0 and held + steps.get(least - 1, 0) <= FREQUENT:
        least -= 1
        held += steps.get(least, 0)
    some = counts.where((F.col("word") != END) & (F.col("n") >= (1 << min(least, 62)))).toArrow()
    pairs = sorted(zip(some.column("word").to_pylist(), some.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    kind = F.pmod(F.crc32(F.expr("substr(word, -3)")), F.lit(CLASSES)).cast("int")
    rest = counts.where((F.col("word") != END) & (F.col("n") < (1 << min(least, 62))))
    rest_tokens, rest_types = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for k, n, v in rest.groupBy(kind.alias("k")).agg(F.sum("n"), F.count("*")).collect():
        rest_tokens[k], rest_types[k] = n, v
    return Vocabulary([w for w, _ in pairs], np.array([n for _, n in pairs], dtype=np.int64), totals[0], totals[1], totals[2], rest_tokens, rest_types)


def contexts(unit: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two units before each token; before a text stand ends."""
    one, two = np.full(len(unit), STOP), np.full(len(unit), STOP)
    one[1:], two[2:] = unit[:-1], unit[:-2]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
    one[first] = STOP
    two[first] = STOP
    second = first[sizes > 1] + 1
    two[second] = STOP
    return two, one


class _Tally:
    """Counts of whole numbers, given out whenever there are many."""

    def __init__(self) -> None:
        self.keys, self.counts, self.new, self.held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.held += len(keys)

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Adds up once more than 3 million keys are new; all counts once there are more than most of them."""
        if self.held <= 3_000_000 and most:
            return None
        new, n = np.unique(np.concatenate([np.empty(0, np.int64), *self.new]), return_counts=True)
        keys, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([self.counts, n]), minlength=len(keys)).astype(np.int64)
        self.new, self.held = [], 0
        if len(keys) <= most:
            self.keys, self.counts = keys, counts
            return None
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        return keys, counts


def count_followers(docs: DataFrame, vocab) -> DataFrame:
    """(level, key, n) over all texts. Level 1: a context and its unit, at most UNITS cubed rows. Level 2: the class, the target in it and what is known of the word before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = (_Tally(), _Tally())

        def give(most: int) -> Iterator[pa.RecordBatch]:
            for level, tally in enumerate(tallies, 1):
                if (found := tally.take(most)) is not None:
                    keys, n = found
                    for k in range(0, len(keys), 500_000):
                        some = keys[k : k + 500_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), level, np.int8)), pa.array(some), pa.array(n[k : k + 500_000])], names=["level", "key", "n"])

        for batch in pieces(batches, "text", 3_000_000):
            place, unit, sizes, _ = vocab.value.sequence(utf8(batch.column("text")))
            two, one = contexts(unit, sizes)
            tallies[0].add((two * UNITS + one) * UNITS + unit)
            target = vocab.value.targets(place, unit)
            some = target >= 0
            tallies[1].add((unit[some] - SHORT) << 40 | target[some] << 12 | BEFORE[one[some]])
            yield from give(2_000_000)
        yield from give(0)

    return docs.select("text").mapInArrow(run, "level byte, key long, n long").groupBy("level", "key").agg(F.sum("n").alias("n"))


def start(unigram: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters before training: with small vectors, the biases alone give the unigram probabilities."""
    rng = np.random.default_rng(seed)
    small = lambda *n: (0.1 * rng.standard_normal(n)).astype(np.float32)
    return {"r": small(UNITS, DIM), "w": small(UNITS, DIM), "c1": np.eye(DIM, dtype=np.float32) + small(DIM, DIM), "c2": np.eye(DIM, dtype=np.float32) + small(DIM, DIM), "b": np.log(unigram).astype(np.float32)}


def train_steps(p: dict[str, np.ndarray], context: np.ndarray, counts: np.ndarray, noise: np.ndarray, round_: int, steps: int = STEPS, batch: int = 512, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Adam steps on the noise-contrastive loss over contexts (ids) and the counts of what follows them.

    The score of unit x after units i, j is (r_i C1 + r_j C2) . w_x + b_x. Each seen token is told from NOISE
    samples of the noise distribution; the samples' part of the loss is taken in expectation.
    """
    rng = np.random.default_rng(round_)
    p = {k: v.copy() for k, v in p.items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    log_noise = np.log(NOISE * noise).astype(np.float32)
    weight = counts.sum(axis=1)
    order = np.empty(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < min(batch, len(context)):
            order = np.concatenate([order, rng.permutation(len(context))])
        some, order = order[:batch], order[batch:]
        i, j = context[some] // UNITS, context[some] % UNITS
        q = p["r"][i] @ p["c1"] + p["r"][j] @ p["c2"]
        s = 1 / (1 + np.exp(-np.clip(q @ p["w"].T + p["b"] - log_noise, -30, 30)))
        total = max(1.0, float(weight[some].sum()))
        ds = (counts[some] * (s - 1) + weight[some][:, None] * (NOISE * noise) * s) / total
        dq = ds @ p["w"]
        dr = np.zeros_like(p["r"])
        np.add.at(dr, i, dq @ p["c1"].T)
        np.add.at(dr, j, dq @ p["c2"].T)
        grads = {"r": dr, "w": ds.T @ q, "c1": p["r"][i].T @ dq, "c2": p["r"][j].T @ dq, "b": ds.sum(axis=0)}
        for k, g in grads.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            p[k] -= (rate / (1 + 0.3 * round_) * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return p


def _pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(x.astype("<f4").tobytes() for x in p.values())


def _unpack(flat: np.ndarray, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    cuts = np.cumsum([int(np.prod(n)) for n in shapes.values()])[:-1]
    return {k: x.reshape(n).astype(np.float32) for (k, n), x in zip(shapes.items(), np.split(flat, cuts), strict=True)}


def _pack_part(group: pa.Table) -> pa.Table:
    """A part's contexts and counts as one row, so that each round reads it as it is."""
    blobs = [pa.array([group.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("key", "n")]
    return pa.table([group.column("part")[:1].combine_chunks(), *blobs], names=["part", "key", "n"])


def _round(now: bytes, round_: int, shapes: dict[str, tuple], noise: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n in zip(batch.column("key"), batch.column("n"), strict=True):
                key, n = (np.frombuffer(x.as_buffer(), "<i8") for x in (key, n))
                context, row = np.unique(key // UNITS, return_inverse=True)
                counts = np.zeros((len(context), UNITS), dtype=np.float32)
                counts[row, key % UNITS] = n
                params = train_steps(_unpack(np.frombuffer(now, "<f4"), shapes), context, counts, noise, round_)
                yield pa.RecordBatch.from_arrays([pa.array([float(counts.sum())]), pa.array([_pack(params)], pa.binary())], names=["n", "p"])

    return work


def train(triples: DataFrame, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of steps in tasks, each on its own contexts, with the parameters averaged after each round.

    Every token of the corpus is in the counts. A part holds at most UNITS squared / PARTS contexts, and what
    it returns is as large as the model.
    """
    seen = np.ones(UNITS)
    for unit, n in triples.groupBy(F.pmod("key", F.lit(UNITS)).alias("u")).agg(F.sum("n")).collect():
        seen[unit] += n
    noise = (seen / seen.sum()).astype(np.float32)
    p = start(noise)
    part = F.pmod(F.xxhash64(F.floor(F.col("key") / UNITS)), F.lit(PARTS)).cast("int").alias("part")
    packed = triples.select(part, "key", "n").groupBy("part").applyInArrow(_pack_part, "part int, key binary, n binary")
    dealt = written(packed.repartitionByRange(PARTS, "part"), "lm-parts")
    shapes = {k: x.shape for k, x in p.items()}
    for round_ in range(rounds):
        found = dealt.mapInArrow(_round(_pack(p), round_, shapes, noise), "n double, p binary").toArrow().to_pylist()
        if not found:
            break
        whole = sum(f["n"] for f in found)
        p = _unpack(sum(np.frombuffer(f["p"], "<f4").astype(np.float64) * (f["n"] / whole) for f in found), shapes)
    return p


def train_class(before: np.ndarray, target: np.ndarray, n: np.ndarray, unigram: np.ndarray, steps: int = INNER_STEPS, rate: float = 0.06) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of what is before, vectors and biases of a class's targets, from the counts n of (before, target).

    The score of target x after i is r_i . w_x + b_x; the loss is the noise-contrastive one, with the class's
    own unigram probabilities as noise and its expectation taken. All counts are in each step.
    """
    rng = np.random.default_rng(9)
    some, row = np.unique(before, return_inverse=True)
    counts = np.zeros((len(some), len(unigram)), dtype=np.float32)
    counts[row, target] = n
    weight = counts.sum(axis=1, keepdims=True)
    total = float(weight.sum())
    log_noise, log_unigram = np.log(NOISE * unigram).astype(np.float32), np.log(unigram).astype(np.float32)
    p = {"r": (0.1 * rng.standard_normal((len(some), INNER_DIM))).astype(np.float32), "w": (0.1 * rng.standard_normal((len(unigram), INNER_DIM))).astype(np.float32), "b": log_unigram.copy()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    noise = (NOISE * unigram).astype(np.float32)
    for t in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(p["r"] @ p["w"].T + (p["b"] - log_noise), -30, 30)))
        ds = (counts * (s - 1) + weight * noise * s) / total
        grads = {"r": ds @ p["w"] + PRIOR / total * p["r"], "w": ds.T @ p["r"] + PRIOR / total * p["w"], "b": ds.sum(axis=0) + PRIOR / total * (p["b"] - log_unigram)}
        for k, g in grads.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            p[k] -= rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    r = np.zeros((BEFORES, INNER_DIM), np.float32)
    r[some] = p["r"]
    return r, p["w"], p["b"]


def _class_model(shared) -> Callable[[pa.Table], pa.Table]:
    def work(group: pa.Table) -> pa.Table:
        vocab, key = shared.value, group.column("key").to_numpy()
        kind = int(key[0] >> 40)
        members, seen = vocab.members(kind), vocab.unigram(kind)
        target, words = key >> 12 & (1 << 28) - 1, len(vocab.words)
        place = np.where(target >= words, len(members), np.searchsorted(members, np.minimum(target, words - 1)))
        r, w, b = train_class(key & 4095, place, group.column("n").to_numpy(), seen)
        return pa.table({"kind": pa.array([kind], pa.int32()), "p": pa.array([b"".join(x.astype("<f4").tobytes() for x in (r, w, b))], pa.binary())})

    return work


def train_classes(pairs: DataFrame, shared, vocab: Vocabulary) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A model for each class that occurs; a task holds the counts of one class, and the driver gets what the vocabulary's size allows."""
    found = pairs.groupBy(F.shiftright("key", 40).alias("kind")).applyInArrow(_class_model(shared), "kind int, p binary").toArrow().to_pylist()
    out = {}
    for f in found:
        flat, many = np.frombuffer(f["p"], "<f4"), len(vocab.members(f["kind"])) + 1
        cut = [BEFORES * INNER_DIM, (BEFORES + many) * INNER_DIM]
        out[f["kind"]] = (flat[: cut[0]].reshape(BEFORES, INNER_DIM), flat[cut[0] : cut[1]].reshape(many, INNER_DIM), flat[cut[1] :])
    return out


@dataclass
class Model:
    """Tables of the trained model. First level: what each unit before adds to each unit, the biases, and the log of the normaliser for each context.
    Second level: by class and what is before the vectors and the log of the normaliser, by target the vectors and biases."""

    far: np.ndarray
    near: np.ndarray
    log_z: np.ndarray
    before: np.ndarray
    inner_z: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @classmethod
    def of(cls, p: dict[str, np.ndarray], vocab: Vocabulary, inner: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
        far, near = p["r"] @ p["c1"] @ p["w"].T, p["r"] @ p["c2"] @ p["w"].T + p["b"]
        log_z = np.empty((UNITS, UNITS))
        for i in range(UNITS):  # a batched product gives all units after the contexts (i, any)
            log_z[i] = _log_sum(far[i] + near)
        words = len(vocab.words)
        before, inner_z = np.zeros((CLASSES, BEFORES, INNER_DIM), np.float32), np.zeros((CLASSES, BEFORES), np.float32)
        target, bias = np.zeros((words + CLASSES, INNER_DIM), np.float32), np.zeros(words + CLASSES, np.float32)
        for kind in range(CLASSES):
            at = np.append(vocab.members(kind), words + kind)
            bias[at] = np.log(vocab.unigram(kind))
            if kind in inner:
                before[kind], target[at], bias[at] = inner[kind]
            inner_z[kind] = _log_sum(before[kind] @ target[at].T + bias[at])
        return cls(far.astype(np.float32), near.astype(np.float32), log_z.astype(np.float32), before, inner_z, target, bias)

    def log10(self, two: np.ndarray, one: np.ndarray, unit: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each token's unit and, within a class, its target, given the two units before."""
        out = (self.far[two, unit] + self.near[one, unit] - self.log_z[two, one]).astype(np.float64)
        some = np.flatnonzero(target >= 0)
        for k in range(0, len(some), 1 << 16):
            at = some[k : k + (1 << 16)]
            kind, i, x = unit[at] - SHORT, BEFORE[one[at]], target[at]
            out[at] += np.einsum("ij,ij->i", self.before[kind, i], self.target[x]) + self.bias[x] - self.inner_z[kind, i]
        return out / np.log(10)


def _log_sum(s: np.ndarray) -> np.ndarray:
    top = s.max(axis=1)
    return top + np.log(np.exp(s - top[:, None]).sum(axis=1))


def trained(learn: DataFrame) -> tuple[Vocabulary, Model, DataFrame]:
    """The vocabulary, the model, and the table of all words' counts (word, n) of the rows (text)."""
    spark = learn.sparkSession
    counts = written(count_words(learn), "lm-counts")
    vocab = vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocab)
    followers = written(count_followers(learn, shared), "lm-followers")
    p = train(followers.where("level = 1").select("key", "n"))
    return vocab, Model.of(p, vocab, train_classes(followers.where("level = 2").select("key", "n"), shared, vocab)), counts


def lm_scores(docs: DataFrame, parts: int = 7, held_out: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A token is a word or the end of the text. The first level gives a probability to a word's unit, given the
    two units before; the second shares a class's probability among its frequent words and all others, given the
    unit before; these others share theirs by their smoothed counts (one unseen word more). So over all known
    words and one unseen word for each class the probabilities add up to one. A null text is empty: its only
    token is the end. Without training rows the probabilities are those of one unseen token (base) and of even
    biases. Repeated rows are scored each; a null doc_id is of the fold of the empty text.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"), (fold("doc_id", parts) == held_out).alias("held_out"))
    vocab, model, counts = trained(rows.where(~F.col("held_out")))
    shared, tables = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(model)
    end_base, end_known = float(np.log10((vocab.ends + 1) / (vocab.tokens + vocab.types + 1))), int(vocab.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net, at = shared.value, tables.value, TaskContext.get().partitionId() << 33
        base_of = np.append(known.base, [0.0, end_base])
        for batch in pieces(batches, "text", 3_000_000):
            place, unit, sizes, others = known.sequence(utf8(batch.column("text")))
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            two, one = contexts(unit, sizes)
            score = np.add.reduceat(net.log10(two, one, unit, known.targets(place, unit)), first)
            place = np.where(place == -2, len(known.words) + 1, np.where(place == -1, len(known.words), place))
            base = np.add.reduceat(base_of[place], first)
            some = np.add.reduceat((place < len(known.words)).astype(np.int64), first) + end_known
            left = [Counter(x) for x in others]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in left])]).astype(np.int32)
            words = pa.array([w for x in left for w in x], pa.binary())
            times = pa.array([n for x in left for n in x.values()], pa.int64())
            rest = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([words, times], names=["word", "n"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(sizes))), batch.column("doc_id"), batch.column("held_out"), pa.array(sizes), pa.array(some), pa.array(base), pa.array(score), rest], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"])
            at += len(sizes)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = written(rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,n:bigint>>"), "lm-rows")
    sums = F.element_at(F.array(*[F.lit(float(a + b + 1)) for a, b in zip(vocab.rest_tokens.tolist(), vocab.rest_types.tolist(), strict=True)]), F.pmod(F.crc32(F.expr("substr(word, -3)")), F.lit(CLASSES)).cast("int") + 1)
    rare = scored.select("row", F.explode("rest").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    rare = rare.join(counts.hint("merge"), "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("c"), sums.alias("inside"))
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(vocab.tokens + vocab.types + 1)))).alias("more_base"), F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.col("inside"))).alias("more_score"))
    out = scored.drop("rest").join(rare, "row", "left")
    zero = F.lit(0.0)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(int(vocab.tokens)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("more_score", zero)).alias("score"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
