"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, text_or_empty, utf8, written

#: Words of a block; a passage is two blocks that follow one another, so passages overlap by half.
BLOCK = 24
#: Items of one latent space, its dimensions, and the cosine from which a passage is a candidate for an item.
#: With most of the items' directions kept, a rare word keeps its weight.
SPACE, RANK, COSINE = 256, 192, 0.30
#: A space is fitted on the items' passages, of weight 1 each, and on all passages of the corpus, of this weight in
#: all: a heavier corpus would fill the space with its frequent words.
CORPUS = 20.0
#: Terms of one space, whose products with one another a task holds, and of these, the rows that are summed at once.
WIDTH, STRIPE = 4096, 16
#: Bytes of the corpus' passages that a task works off, and tasks whose sums are added at once.
SHARE, FAN = 32_000_000, 64
#: Blocks of a text that are in latent space at once.
AT_ONCE = 256
#: Share of an item's words that the longest common subsequence must hold; the lower one if the answer is there too.
SURE, LIKELY, ANSWER = 0.75, 0.5, 0.8
#: Items that one pass over the documents looks for; a larger benchmark takes several passes.
ITEMS = 4_000
#: Items of fewer words are found by exact match only.
LEAST = 5
#: Items of more words stand in the latent space as several pieces of a passage's length.
LONG = 4 * BLOCK
#: Letters of scripts that put no spaces between words.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
EDGES = b".,;:!?\"'()[]{}*#$%&|<>"


def words(raw: bytes) -> list[bytes]:
    """Lower-cased words without marks at their ends; marks alone are no words."""
    return [w for w in (x.strip(EDGES) for x in raw.lower().split()) if w]


def answer(text: str) -> list[bytes]:
    """The words of the last sentence of an item, if it has several."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if words(p.encode())]
    return words(parts[-1].encode()) if len(parts) > 1 else []


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of an integer."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def cut(item: list[bytes]) -> list[list[bytes]]:
    """The item, or pieces of a passage's length that cover a long one."""
    if len(item) <= LONG:
        return [item]
    return [item[k : k + 2 * BLOCK] for k in [*range(0, len(item) - 2 * BLOCK, 2 * BLOCK), len(item) - 2 * BLOCK]]


class Terms(dict):
    """Number of the term that a token stands for: -1 for a word that no item has, -2 for marks alone."""

    def __init__(self, terms: list[bytes]):
        self.places = {x: i for i, x in enumerate(terms)}

    def __missing__(self, token: bytes) -> int:
        word = token.strip(EDGES)
        found = self.places.get(word, -1) if word else -2
        if len(self) < 1_000_000:
            self[token] = found
        return found

    def numbers(self, raw: bytes) -> np.ndarray:
        """The terms of all words of a text in order."""
        tokens = raw.lower().split()
        found = np.fromiter(map(self.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        return found[found != -2]

    def of_column(self, column: pa.Array) -> list[np.ndarray]:
        """The same for all texts of a string column."""
        if not len(column):
            return []
        lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(column))
        bare = pa.compute.ascii_trim(lists.flatten(), EDGES.decode())
        found = pa.compute.index_in(bare.cast(pa.binary()), value_set=pa.array(list(self.places), pa.binary()))
        found = pa.compute.fill_null(found, -1).to_numpy(zero_copy_only=False)
        kept = pa.compute.binary_length(bare).to_numpy(zero_copy_only=False) > 0
        ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        return np.split(found[kept], ends[:-1])


class Short:
    """Items of fewer than LEAST words: found as the same words in a row, or the same characters where a script has no spaces."""

    def __init__(self, items: list[tuple[int, list[bytes]]], terms: Terms):
        self.words: dict[tuple[int, ...], set[int]] = {}
        self.runs: dict[str, set[tuple[str, int]]] = {}
        for i, w in items:
            run = b"".join(w).decode("utf-8", "surrogatepass")
            if UNSPACED.search(run):
                self.runs.setdefault(run[0], set()).add((run, i))
            else:
                self.words.setdefault(tuple(terms.places[x] for x in w), set()).add(i)
        self.lengths = sorted({len(w) for w in self.words})
        self.starts = np.array(sorted({w[0] for w in self.words}), np.int32)

    def search(self, text: np.ndarray, raw: bytes) -> set[int]:
        found: set[int] = set()
        if self.words:
            for k in np.flatnonzero(np.isin(text, self.starts)).tolist():
                some = text[k : k + LEAST].tolist()
                for n in self.lengths:
                    found |= self.words.get(tuple(some[:n]), set())
        if self.runs:
            run = b"".join(words(raw)).decode("utf-8", "surrogatepass")
            for k, c in enumerate(run):
                found |= {i for x, i in self.runs.get(c, ()) if run.startswith(x, k)}
        return found


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each in whole blocks after an empty one, and the first block of each."""
    blocks = np.array([-(-len(x) // BLOCK) + 1 for x in texts], np.int64)
    first = np.cumsum(blocks) - blocks + 1
    flat = np.full((int(blocks.sum()) + 1) * BLOCK, -1, np.int32)
    for text, k in zip(texts, (first * BLOCK).tolist(), strict=True):
        flat[k : k + len(text)] = text
    return flat, first


@dataclass
class Space:
    """Items as terms, once for each piece, and their latent space: what each term adds to a passage's product with each piece.

    place (terms + 1): the row of a term, -1 without one (also for terms -1); idf (rows); products (rows, pieces).
    """

    ids: list[int]
    items: list[np.ndarray]
    answers: list[np.ndarray]
    first: list[int]
    place: np.ndarray
    idf: np.ndarray
    products: np.ndarray

    def search(self, texts: list[np.ndarray]) -> list[dict[int, float]]:
        """For each text (terms): item_id -> share of the item's words found in order, for the items that it holds."""
        found: list[dict[int, float]] = [{} for _ in texts]
        if not texts:
            return found
        flat, first = laid_out(texts)
        heads, pieces = self.near(flat)
        # A passage that begins with the empty block before a text is its first block.
        doc = np.searchsorted(first, heads + 1, side="right") - 1
        inside = heads < (first + [-(-len(x) // BLOCK) for x in texts])[doc]
        spans: dict[tuple[int, int], list[list[int]]] = {}  # by first piece of an item; of a long one, those that overlap are one
        for d, k, i in zip(doc[inside].tolist(), (BLOCK * np.maximum(heads - first[doc], 0))[inside].tolist(), pieces[inside].tolist(), strict=True):
            n, own = len(self.items[i]), spans.setdefault((d, self.first[i]), [])
            a, b = max(0, k - n), k + 2 * BLOCK + n
            if own and n > LONG and a <= own[-1][1]:
                own[-1][1] = max(b, own[-1][1])
            elif not own or own[-1] != [a, b]:
                own.append([a, b])
        here = np.zeros(len(self.place), bool)
        for (d, i), own in spans.items():
            item, last = self.items[i], self.answers[i]
            for a, b in own:
                near = texts[d][a:b]
                here[near], here[-1] = True, False
                held, told = np.count_nonzero(here[item]), np.count_nonzero(here[last])  # no common subsequence is longer
                here[near] = False
                if held < LIKELY * len(item) or held < SURE * len(item) and (len(last) < 3 or told < ANSWER * len(last)):
                    continue
                share = self.check(i, near.tolist())
                if share > found[d].get(self.ids[i], 0.0):
                    found[d][self.ids[i]] = share
        return found

    def near(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first block, piece) of the passages with a cosine of COSINE or more in latent space; AT_ONCE blocks at a time."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for start in range(0, len(flat), AT_ONCE * BLOCK):  # with one block more, which the last passage shares
            at = self.place[flat[start : start + (AT_ONCE + 1) * BLOCK]]
            hit = np.flatnonzero(at >= 0)
            if not len(hit):
                continue
            home, term = hit // BLOCK, at[hit].astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
            some = home[starts]  # only blocks with a word of the benchmark
            part = np.add.reduceat(self.products[term], starts, axis=0)
            part = np.vstack([part, np.zeros((1, part.shape[1]), np.float32)])
            once, tf = np.unique(home * len(self.idf) + term, return_counts=True)
            mass = np.bincount(once // len(self.idf), weights=(tf * self.idf[once % len(self.idf)]) ** 2, minlength=AT_ONCE + 2)
            row = np.full(AT_ONCE + 2, len(some))
            row[some] = np.arange(len(some))
            heads = np.unique(np.concatenate([some, some - 1]))
            heads = heads[(heads >= 0) & (heads < AT_ONCE)]
            least = (COSINE * np.sqrt(mass[heads] + mass[heads + 1])).astype(np.float32)
            w, i = np.nonzero(part[row[heads]] + part[row[heads + 1]] >= least[:, None])
            out.append((heads[w] + start // BLOCK, i))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def check(self, i: int, near: list[int]) -> float:
        """The share of the item's words in order within a span not much longer than the item; 0 if too few."""
        item, last = self.items[i].tolist(), self.answers[i].tolist()
        if common_length(item, near) < LIKELY * len(item):
            return 0.0
        width = len(item) + max(4, len(item) // 3)
        share = max(common_length(item, near[k : k + width]) for k in range(0, max(1, len(near) - len(item) + 1), 2)) / len(item)
        if share >= SURE or share >= LIKELY and len(last) >= 3 and common_length(last, near) >= ANSWER * len(last):
            return share
        return 0.0


TOLD = "docs long, passages long, bytes long, term array<int>, found array<long>, hits binary"
TOLD_ARROW = pa.schema([("docs", pa.int64()), ("passages", pa.int64()), ("bytes", pa.int64()), ("term", pa.list_(pa.int32())), ("found", pa.list_(pa.int64())), ("hits", pa.binary())])


def told(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """The terms of all documents, a row for some of them: in how many each term is, and their passages one after the other.

    The passages follow one another without overlap, so each word of the corpus is in one. hits are the numbers
    of their terms in order, the number of terms ending a passage; words that no item has are left out, and so
    are passages without others. bytes is the length of hits.
    """
    shared, width = docs.sparkSession.sparkContext.broadcast(terms), 2 * BLOCK
    kind = np.min_scalar_type(len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(shared.value)
        end = len(terms.places)
        for batch in pieces(batches, "text"):
            texts = terms.of_column(pa.compute.fill_null(batch.column("text"), ""))
            lengths = np.array([len(x) for x in texts], np.int64)
            rows = -(-lengths // width)
            flat, home = np.concatenate(texts), np.repeat(np.arange(len(texts)), lengths)
            known = flat >= 0
            found = np.bincount(np.unique(home[known] * end + flat[known]) % end, minlength=end)
            own = np.flatnonzero(found)
            at = np.full((int(rows.sum()), width + 1), -1, np.int64)
            place = np.arange(len(flat)) + np.repeat(width * (np.cumsum(rows) - rows) - (np.cumsum(lengths) - lengths), lengths)
            at[place // width, place % width] = flat
            at[(at >= 0).any(axis=1), -1] = end
            hits = at[at >= 0].astype(kind).tobytes()
            row = {"docs": len(texts), "passages": int(rows.sum()), "bytes": len(hits), "term": own.tolist(), "found": found[own].tolist(), "hits": hits}
            yield pa.RecordBatch.from_pylist([row], TOLD_ARROW)

    return docs.select("text").mapInArrow(run, TOLD)


def _row(at: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage's rows in a space as a sparse unit row: columns and values."""
    columns, tf = np.unique(at, return_counts=True)
    v = tf * idf[columns]
    return columns, (v / np.linalg.norm(v)).astype(np.float32)


def add_products(out: np.ndarray, hits: np.ndarray, end: int, place: np.ndarray, idf: np.ndarray, at_once: int = 200_000) -> None:
    """Adds to out (terms, terms), on and above its diagonal, the products of the term frequencies of each passage, over its TF-IDF row's square."""
    home = np.cumsum(hits == end)
    at = np.append(place[:end], -1)[hits]
    home, at = home[at >= 0], at[at >= 0].astype(np.int64)
    if not len(at):
        return
    width, flat = len(idf), out.reshape(-1)
    once, tf = np.unique(home * width + at, return_counts=True)
    over = (1 / np.maximum(np.bincount(once // width, weights=(tf * idf[once % width]) ** 2), 1e-30)).astype(np.float32)[home]
    np.add.at(flat, at * (width + 1), over)
    for start in range(0, len(at), at_once):  # pairs of words by their distance
        for far in range(1, 2 * BLOCK):
            n = min(at_once, len(at) - far - start)
            if n <= 0:
                break
            k = start + np.flatnonzero(home[start : start + n] == home[start + far : start + far + n])
            if not len(k):
                break
            a, b = at[k], at[k + far]
            np.add.at(flat, np.minimum(a, b) * width + np.maximum(a, b), np.where(a == b, 2 * over[k], over[k]))


SUMS = "space int, part int, stripe int, cells binary, vals binary"


def products(rows: DataFrame, shared, parts: int) -> DataFrame:
    """For each space the sums over all passages of what add_products adds, a row for each STRIPE of its terms that has any.

    Each space goes over all rows in so many tasks, and their sums are added FAN by FAN, so that no task holds
    more of them, whatever the size of the corpus.
    """

    def work(s: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            end, spaces = shared.value
            place, idf, _ = spaces[s]
            out, kind = np.zeros((len(idf), len(idf)), np.float32), np.min_scalar_type(end)
            for batch in batches:
                for hits in batch.column("hits"):
                    add_products(out, np.frombuffer(hits.as_buffer(), kind), end, place, idf)
            part = TaskContext.get().partitionId() % parts
            for stripe in range(0, len(out), STRIPE):
                some = out[stripe : stripe + STRIPE].reshape(-1)
                if len(cells := np.flatnonzero(some)):
                    yield _sums(s, part, stripe, cells, some[cells])

        return run

    def add(group: pa.Table) -> pa.Table:
        s, part, stripe = (group.column(c)[0].as_py() for c in ("space", "part", "stripe"))
        out = np.zeros(STRIPE * WIDTH)
        for cells, vals in zip(group.column("cells").to_pylist(), group.column("vals").to_pylist(), strict=True):
            out[np.frombuffer(cells, "<i4")] += np.frombuffer(vals, "<f4")
        cells = np.flatnonzero(out)
        return pa.Table.from_batches([_sums(s, part, stripe, cells, out[cells])])

    found = rows.select("hits").coalesce(parts)
    out = reduce(DataFrame.unionByName, [found.mapInArrow(work(s), SUMS) for s in range(len(shared.value[1]))])
    left = parts
    while left > 1:
        left = -(-left // FAN)
        out = out.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("space", "stripe", "part").applyInArrow(add, SUMS)
    return out


def _sums(s: int, part: int, stripe: int, cells: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([x], pa.int32()) for x in (s, part, stripe)] + [pa.array([cells.astype("<i4").tobytes()], pa.binary()), pa.array([vals.astype("<f4").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["space", "part", "stripe", "cells", "vals"])


def square(cells: Iterator[tuple[int, bytes, bytes]], idf: np.ndarray) -> np.ndarray:
    """The sums (stripe, cells, vals) of a space as the whole symmetric matrix A'A of its TF-IDF unit rows."""
    out = np.zeros((len(idf), len(idf)), np.float32)
    for stripe, where, vals in cells:
        out.reshape(-1)[stripe * len(idf) + np.frombuffer(where, "<i4").astype(np.int64)] = np.frombuffer(vals, "<f4")
    for k in range(len(out)):
        out[k:, k] = out[k, k:]
    out *= idf.astype(np.float32)[:, None]
    out *= idf.astype(np.float32)
    return out


def bases(sums: DataFrame, shared, passages: int, rank: int = RANK, rounds: int = 4, seed: int = 5) -> list[np.ndarray]:
    """For each space an orthonormal basis (terms, rank) of the main directions of its items' rows and the corpus' passages.

    Randomised SVD: the row space is sampled by a random matrix and refined by power iterations over A'A. A task
    has a space.
    """
    spark = sums.sparkSession

    def fit(group: pa.Table) -> pa.Table:
        s = group.column("space")[0].as_py()
        _, idf, items = shared.value[1][s]
        a = square(zip(*(group.column(c).to_pylist() for c in ("stripe", "cells", "vals")), strict=True), idf)
        a *= CORPUS / max(passages, 1)
        for c, v in items:
            a[np.ix_(c, c)] += np.outer(v, v)
        x = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(a), min(len(a), rank + 16))))[0].astype(np.float32)
        for _ in range(rounds):
            x = np.linalg.svd(a @ x, full_matrices=False)[0]
        return pa.table({"space": pa.array([s], pa.int32()), "basis": pa.array([x[:, :rank].astype("<f4").tobytes()], pa.binary())})

    each = spark.createDataFrame([(s, 0, 0, b"", b"") for s in range(len(shared.value[1]))], SUMS)  # a space that no passage has a word of
    found = sums.unionByName(each).groupBy("space").applyInArrow(fit, "space int, basis binary").toArrow()
    found = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    return [np.frombuffer(found[s], "<f4").reshape(len(idf), -1) for s, (_, idf, _) in enumerate(shared.value[1])]


def index(docs: DataFrame, items: list[tuple[int, str]]) -> tuple[list[bytes], list[Space], Short]:
    """All terms, spaces of up to SPACE items or pieces of long items and WIDTH terms each, and the short items. Frequencies and spaces are those of all documents."""
    spark = docs.sparkSession
    wanted = [(i, w, answer(t)) for i, t in items if i is not None and t is not None and (w := words(t.encode("utf-8", "surrogatepass")))]
    terms = sorted({x for _, w, _ in wanted for x in w})
    number = Terms(terms).places
    short = Short([(i, w) for i, w, _ in wanted if len(w) < LEAST], Terms(terms))
    to = lambda w: [number[x] for x in w]
    kept = [(i, to(w), to(last), to(piece), k) for k, (i, w, last) in enumerate(wanted) if len(w) >= LEAST for piece in cut(w)]
    if not kept:
        return terms, [], short
    corpus = written(told(docs, terms), "passages")
    n, passages, size = (x or 0 for x in corpus.agg(F.sum("docs"), F.sum("passages"), F.sum("bytes")).first())
    found = corpus.select(F.explode(F.arrays_zip("term", "found")).alias("x")).groupBy("x.term").agg(F.sum("x.found").alias("n")).toArrow()
    counts = np.zeros(len(terms))
    counts[found.column("term").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((n + 1) / (counts + 1)) + 0.1  # frequent ones too: a widely copied item makes its own words frequent
    groups, own = [[]], set()
    for x in kept:
        if groups[-1] and (len(groups[-1]) == SPACE or len(own.union(x[3])) > WIDTH):
            groups.append([])
            own = set()
        groups[-1].append(x)
        own.update(x[3])
    spaces, rows = [], []
    for some in groups:
        own = np.array(sorted({x for *_, piece, _ in some for x in piece}))
        place = np.full(len(terms) + 1, -1, np.int32)
        place[own] = np.arange(len(own))
        first = {x[-1]: j for j, x in reversed(list(enumerate(some)))}
        spaces.append(Space([x[0] for x in some], [np.array(x[1], np.int64) for x in some], [np.array(x[2], np.int64) for x in some], [first[x[-1]] for x in some], place, idf[own], np.empty(0)))
        rows.append([_row(place[x[3]], idf[own]) for x in some])
    shared = spark.sparkContext.broadcast((len(terms), [(s.place, s.idf, own) for s, own in zip(spaces, rows, strict=True)]))
    sums = products(corpus, shared, max(8, -(-size // SHARE)))
    for space, own, basis in zip(spaces, rows, bases(sums, shared, passages), strict=True):
        latent = np.array([v @ basis[c] for c, v in own])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 0.3)
        space.products = ((basis * space.idf[:, None]) @ latent.T).astype(np.float32)  # of a passage's latent vector with each piece's, term by term
        space.idf = space.idf.astype(np.float32)
    shared.unpersist()
    return terms, spaces, short


def decontaminate(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """Adds item_ids (sorted) and share (the largest, 0 if none) to all rows of docs; contaminated where there are any.

    A passage that is near an item in latent space is compared with it: the item's words must be found in
    order, nearly all, or most of them together with its answer. Items of fewer than five words must be found
    exactly. Null and empty texts hold nothing; items with a null id, a null text or no words are not looked for.
    Repeated items are found each. Columns item_ids and share of docs are replaced; others pass through.
    """
    spark = docs.sparkSession
    total = benchmark.count()
    passes = max(1, -(-total // items))
    out = docs.drop("item_ids", "share").withColumns({"item_ids": F.array().cast("array<long>"), "share": F.lit(0.0)})
    for k in range(passes):
        some = benchmark if passes == 1 else benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        found = [tuple(r) for r in some.select("item_id", "text").orderBy("item_id", "text").collect()]
        shared = spark.sparkContext.broadcast(index(docs, found))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, spaces, short = shared.value
            terms = Terms(names)
            for batch in pieces(batches, "text"):
                ids, shares = batch.column("item_ids").to_pylist(), batch.column("share").to_pylist()
                raws = utf8(batch.column("text"))
                texts = terms.of_column(batch.column("text"))
                found = [dict.fromkeys(short.search(text, raw), 1.0) for text, raw in zip(texts, raws, strict=True)]
                for space in spaces:
                    for own, more in zip(found, space.search(texts), strict=True):
                        for x, share in more.items():
                            own[x] = max(share, own.get(x, 0.0))
                for i, own in enumerate(found):
                    if own:
                        ids[i], shares[i] = sorted({*ids[i], *own}), max([shares[i], *own.values()])
                rest = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in ("item_ids", "share")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.list_(pa.int64())), pa.array(shares, pa.float64())], names=[x for x in batch.schema.names if x not in ("item_ids", "share")] + ["item_ids", "share"])

        out = out.mapInArrow(run, out.schema)
        if k + 1 < passes:
            out = written(out, "decontaminated")
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "share")
