"""SimHash near-duplicates: pigeonhole blocks, Hamming check, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import collect_garbage, pieces, table, text_or_empty, utf8, wider, written

SHINGLE = 3
DISTANCE = 3
#: Rows of one key that a task compares in memory; larger keys are split by more bits first.
LARGE_KEY = 4096
#: Edges from which on the links of one node may be too many for a task.
STARS = 5_000_000
#: Edges up to which one task joins them all (some 100 bytes an edge); more go by rounds.
ONE_TASK = 1_000_000


def fingerprint(raw: bytes, n: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 (seed 42) of all n-word shingles of the lower-cased text."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=False)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Adds fp, the fingerprint as a long; a null text counts as empty (fingerprint 0). text is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            seen: dict[bytes, int] = {}  # copies often stand together
            found = []
            for raw in utf8(batch.column("text")):
                if raw not in seen:
                    seen[raw] = fingerprint(raw, n)
                found.append(seen[raw])
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=[*(x for x in batch.schema.names if x != "text"), "fp"])

    return docs.mapInArrow(run, wider(docs.select(*[c for c in docs.columns if c != "text"]), fp="long"))


def masks(blocks: int, distance: int, bits: list[int]) -> list[int]:
    """Masks of which two values that differ in at most distance of the given bits agree on at least one."""
    cut = [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(1 << b for i in some for b in cut[i]) for some in combinations(range(blocks), blocks - distance)]


def blocks_for(count: int, distance: int = DISTANCE) -> int:
    """The fewest blocks at which chance alone puts under one other value on a key; any number is exact."""
    blocks = distance + 2
    while comb(blocks, distance) < 100 and count > 2 ** (64 * (blocks - distance) / blocks - 2):
        blocks += 1
    return blocks


def _near(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest, (smallest, member), of the values linked within one key; fps are distinct and sorted."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if len(fps) == 2:
        if int(fps[0] ^ fps[1]).bit_count() <= distance:
            yield int(fps[0]), int(fps[1])
        return
    for i in range(len(fps) - 1):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    for i in range(len(fps)):
        if (a := find(i)) != i:
            yield int(fps[a]), int(fps[i])


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (table, key, fp) in this order; a key's rows stand together and may go on in the next batch."""
    rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]

    def work(part: list[np.ndarray]) -> pa.RecordBatch:
        t, key, fp = part
        cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        edges = np.concatenate([[0], cut, [len(fp)]])
        many = np.flatnonzero(np.diff(edges) > 1)
        two = many[np.diff(edges)[many] == 2]
        a, b = fp[edges[two]], fp[edges[two] + 1]
        near = np.bitwise_count(a ^ b) <= distance
        left, right = [np.minimum(a, b)[near]], [np.maximum(a, b)[near]]
        for g in many[np.diff(edges)[many] > 2]:
            found = list(_near(np.sort(fp[edges[g] : edges[g + 1]]), distance))
            left.append(np.array([x for x, _ in found], dtype=np.uint64))
            right.append(np.array([y for _, y in found], dtype=np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["u", "v"])

    for batch in batches:
        new = [batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        part = [np.concatenate([a, b]) for a, b in zip(rest, new, strict=True)]
        if not len(part[0]):
            continue
        last = np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [x[cut:] for x in part]
        if cut:
            yield work([x[:cut] for x in part])
    if len(rest[0]):
        yield work(rest)


def links(fps: DataFrame, distance: int = DISTANCE, large: int = LARGE_KEY) -> DataFrame:
    """(u, v) between distinct fingerprints fp: links that connect all that differ in at most distance bits.

    Each fingerprint goes under one key for each choice of blocks, so a close pair meets under some key. Keys
    of one value are dropped. Within a key, the values are compared in memory and only a spanning forest is
    returned, never all pairs. A key with more than large values is dealt anew by choices among its other
    bits, again and again, until each part is small; close pairs meet in some part each time.
    """
    count = fps.count()
    every = list(range(64))
    seeds = masks(blocks_for(count, distance), distance, every)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(seeds)])).alias("k")).select("k.t", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"), "fp")
    found = []
    while True:
        sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = written(keyed.join(sizes, ["t", "key"]), "simhash-keys")
        small = shared.where(F.col("n") <= large).select("t", "key", "fp")
        found.append(small.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(lambda batches: _links(batches, distance), "u long, v long"))
        again = shared.where(F.col("n") > large).select("t", "mask", "key", "fp")
        if again.isEmpty():
            break
        keyed = _finer(again, distance)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _finer(rows: DataFrame, distance: int) -> DataFrame:
    """Deals each key's rows by choices of blocks among the bits that the key leaves open."""
    rules = {}
    for t, mask in rows.select("t", "mask").distinct().collect():  # one row for each choice of blocks at most
        open_bits = [b for b in range(64) if not mask >> b & 1]
        rules[t, mask] = [_signed(m | mask & (1 << 64) - 1) for m in masks(distance + 1, distance, open_bits)]
    cases = [(F.col("t") == t, F.array(*[F.struct(F.lit(64 * (t + 1) + i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(rule)])) for (t, _), rule in rules.items()]
    chosen = F.coalesce(*[F.when(test, rule) for test, rule in cases])
    return rows.select("fp", F.explode(chosen).alias("k")).select("k.t", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"), "fp")


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges, and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) that a task gets."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _roots(*map(np.concatenate, zip(*ends, strict=True)))], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (u, v): the smallest node reachable.

    Up to ONE_TASK distinct edges are joined in one task; more by large and small stars. Each round of these
    links every node to the smallest of its neighbours; the number of rounds grows with the logarithm of the
    longest path. Each round's edges are written, so no lineage builds up. From STARS edges on
    so are the smallest neighbours: both sides of their join are plain shuffles then, and a node with very many
    links is split over tasks (below, all edges would fit one). Without edges the result is empty.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "stars")
    state = (now.count(), None)
    if state[0] <= ONE_TASK:
        return written(now.repartition(1).mapInArrow(_joined, "node long, root long"), "stars")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = written(least, "stars-least") if state[0] >= STARS else least
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def classes(docs: DataFrame, distance: int = DISTANCE, n: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp and component_id (the smallest doc_id reachable) for all rows of docs (doc_id, text).

    Equal fingerprints are one value before any comparison, so copies cost no pairs. Rows without a text or
    without words have fingerprint 0 and link like any other; a null doc_id is never the smallest unless
    alone; repeated rows are in one class. An empty table gives no rows.
    """
    text = text_or_empty()
    rows = written(fingerprints(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")), n), "simhash-rows")
    values = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-values")
    linked = components(links(values.select("fp"), distance))
    root = values.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = written(root.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    found = written(root.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(found, "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each class the row with the smallest doc_id (null last), then text hash.

    found are classes of docs (doc_id, text_hash, component_id). Rows equal in both are repeated; the first by
    their other columns stays. All columns pass through.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash"))
    keep = found.groupBy("component_id").agg(best.alias("b")).select(F.col("b.doc_id").alias("_id"), F.col("b.text_hash").alias("_hash"))
    rows = docs.withColumn("_own", F.xxhash64(text_or_empty()))
    rows = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_id"]) & (rows["_own"] == keep["_hash"]), "left_semi")
    order = [c for c in docs.columns if c not in ("doc_id", "text")]
    rank = F.row_number().over(Window.partitionBy("doc_id", "_own").orderBy(*order or ["doc_id"]))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_own")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by similarity of shingle sets: blocks of a wide fingerprint find candidates, the sets decide.

#: Words of a shingle and least similarity (shared shingles over all shingles of the two texts).
SET_SHINGLE, SIMILARITY = 5, 0.8
#: Signed buckets of the shingles. Each of two random rotations turns them into as many projections, in blocks of SIDE.
BUCKETS, SIDE = 2048, 64
BLOCKS = 2 * BUCKETS // SIDE
#: Bits of the wide fingerprint (the signs of its first projections), and differing bits up to which a pair is a
#: candidate: a pair at the least similarity differs in about 78 bits, give or take 9.
WIDE, WIDE_DISTANCE = 512, 108
WORDS = [f"s{i}" for i in range(WIDE // 64)]
TOPS = [f"t{i}" for i in range(BLOCKS // 8)]  # eight tops a column
#: Share of pairs at the least similarity that should meet under some key, and the logarithm of how many values may meet on a key by chance.
FOUND, CHANCE = 0.98, 5.5
#: Bytes of the texts of a block; a task holds the shingle sets of two blocks.
BLOCK_BYTES = 8_000_000
#: A table of keys up to so many rows is sent to all tasks; a larger one is joined.
SMALL_TABLE = 100_000


@dataclass(frozen=True)
class Limits:
    """How a crowded key is worked off; no choice leaves a pair out.

    few: rows of a key up to which many keys are compared together; at_once: rows compared as one part; split:
    rows of a key that one task gets; heads: members of a class that meet other classes before all members do;
    block_bytes: text of one block of the last, complete comparison.
    """

    few: int = 64
    at_once: int = 1024
    split: int = 20_000
    heads: int = 16
    block_bytes: int = BLOCK_BYTES


LIMITS = Limits()


def shingle_codes(raw: bytes, n: int = SET_SHINGLE) -> np.ndarray:
    """Distinct hashes of the n-word shingles (the whole sequence if it is shorter; none without words)."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)], dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 7) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=False)), dtype=np.uint64))


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def projections(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BLOCKS, SIDE): the sets in signed buckets, rotated by sign flips and Hadamard transforms, twice and once more."""
    half = BLOCKS // 2
    flips = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (3, half, SIDE))
    left, right = _hadamard(half), _hadamard(SIDE)
    codes = np.concatenate([np.empty(0, np.uint64), *sets])
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    place = row * BUCKETS + (codes >> np.uint64(20)).astype(np.int64) % BUCKETS
    x = np.bincount(place, weights=np.where(codes & np.uint64(1), 1.0, -1.0), minlength=len(sets) * BUCKETS)
    turns = [x.astype(np.float32).reshape(len(sets), half, SIDE)]
    for flip in flips:
        turns.append(left @ ((turns[-1] * flip).reshape(-1, SIDE) @ right).reshape(turns[-1].shape))
    return np.concatenate(turns[2:], axis=1)


def wide_fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sets, WIDE / 64) words of signs, and (sets, BLOCKS) tops: the place and the sign of each block's largest projection.

    The largest projection of a block is the bit of it that a small change of the text flips least.
    """
    signs, tops = np.zeros((len(sets), WIDE // 64), dtype=np.uint64), np.zeros((len(sets), BLOCKS), dtype=np.uint8)
    for k in range(0, len(sets), 128):
        x = projections(sets[k : k + 128])
        signs[k : k + len(x)] = np.packbits(x.reshape(len(x), -1)[:, :WIDE] > 0, axis=1).view(">u8").astype(np.uint64)
        top = np.abs(x).argmax(axis=2)
        tops[k : k + len(x)] = top + SIDE * (np.take_along_axis(x, top[:, :, None], 2)[:, :, 0] > 0)
    return signs, tops


def agreement(similarity: float = SIMILARITY, draws: int = 4000) -> float:
    """How often two sets of this similarity have the same top in a block, by simulation."""
    rng, cosine = np.random.default_rng(5), 2 * similarity / (1 + similarity)
    x, other = rng.standard_normal((2, draws, SIDE))
    y = cosine * x + np.sqrt(1 - cosine * cosine) * other
    a, b = np.abs(x).argmax(1), np.abs(y).argmax(1)
    at = np.arange(draws)
    return float(((a == b) & ((x[at, a] > 0) == (y[at, b] > 0))).mean())


def choices(count: int) -> list[list[int]]:
    """The blocks whose tops make a key, for each key: long enough that few of count values meet by chance, and many enough that FOUND meet.

    The number of keys grows with a small power of count: about 25 keys of two blocks up to 740 000 values, 70
    of three to 95 million, 220 of four to 12 billion.
    """
    width = max(1, int(np.ceil((np.log2(max(count, 2)) - CHANCE) / np.log2(2 * SIDE))))
    p = agreement()
    likely = np.array([comb(BLOCKS, k) * p**k * (1 - p) ** (BLOCKS - k) for k in range(BLOCKS + 1)])  # that k blocks agree
    hit = np.array([comb(k, width) / comb(BLOCKS, width) for k in range(BLOCKS + 1)])
    many = 1
    while likely @ (1 - hit) ** many > 1 - FOUND:
        many += 1
    rng, deck, out = np.random.default_rng(23), [], []
    for _ in range(many):
        if len(deck) < width:
            deck = rng.permutation(BLOCKS).tolist()
        out.append(sorted(deck[:width]))
        deck = deck[width:]
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, the shingle set's size and 128-bit hash h0, h1, the tops t0.., and the wide fingerprint s0.. of docs (doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4_000_000):
            raws = utf8(batch.column("text"))
            fps = np.array([fingerprint(r) for r in raws], dtype=np.uint64)
            sets = [shingle_codes(r) for r in raws]
            wide, tops = wide_fingerprints(sets)
            whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
            size = np.array([len(x) for x in sets], np.int64)
            found = [fps.view(np.int64), size, *whole.T.copy()]
            signs = [np.ascontiguousarray(wide[:, i]).view(np.int64) for i in range(wide.shape[1])]
            found += [*tops.view("<i8").T.copy(), *signs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *map(pa.array, found)], names=["doc_id", "text_hash", *names])

    names = ["fp", "size", "h0", "h1", *TOPS, *WORDS]
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, wider(docs.select("doc_id", "text_hash"), **{n: "long" for n in names}))


def _forest(sig: np.ndarray, distance: int) -> tuple[list[tuple[int, int]], np.ndarray, bool]:
    """Edges of a least spanning forest of the pairs within distance (Prim's rule), which rows have such a pair, and whether there are others than the edges."""
    n = len(sig)
    best, via, open_, near = np.full(n, 1 << 30), np.full(n, -1), np.ones(n, bool), np.zeros(n, np.int64)
    out, now = [], 0
    for _ in range(n):
        open_[now] = False
        d = np.bitwise_count(sig ^ sig[now]).sum(axis=1, dtype=np.int64)
        near[now] = np.count_nonzero(d <= distance) - 1
        closer = open_ & (d < best)
        best[closer], via[closer] = d[closer], now
        left = np.flatnonzero(open_)
        if not len(left):
            break
        now = int(left[best[left].argmin()])
        if best[now] <= distance:
            out.append((int(via[now]), now))
    return out, near > 0, int(near.sum()) > 2 * len(out)


def _small_keys(group: np.ndarray, ids: np.ndarray, sig: np.ndarray, end: np.ndarray, few: int, distance: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Forests of many keys of up to few rows at once, as pairs of ids, and the rows of the pairs that they stand for. end: where a row's key ends (0: not of such a key)."""
    left, a, d = np.arange(len(end)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    b = [np.empty(0, np.int64)]
    for k in range(1, few):  # one distance between rows after the other
        left = left[left + k < end[left]]
        if not len(left):
            break
        bits = np.bitwise_count(sig[left] ^ sig[left + k]).sum(axis=1, dtype=np.int64)
        near = bits <= distance
        a.append(left[near])
        b.append(left[near] + k)
        d.append(bits[near])
    a, b, d = map(np.concatenate, (a, b, d))
    alone = np.bincount(group[a], minlength=int(group[-1]) + 1)[group[a]] == 1 if len(a) else np.empty(0, bool)
    edges = list(zip(ids[a[alone]].tolist(), ids[b[alone]].tolist(), strict=True))
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = i = root.get(up, up)
        return i

    marked: set[int] = set()
    rest = np.flatnonzero(~alone)
    rest = rest[np.argsort(d[rest], kind="stable")]
    for i, j in zip(a[rest].tolist(), b[rest].tolist(), strict=True):
        x, y = find(i), find(j)
        if x == y:
            marked |= {i, j}
        else:
            root[y] = x
            edges.append((int(ids[i]), int(ids[j])))
    return edges, sorted(marked)


def _candidates(batches: Iterator[pa.RecordBatch], distance: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, parts, id, s0..) with those of a (key, part) together: least forests of the near pairs, as (u, v), and marks.

    A mark (u, null, key) says that under this key the id may be near others than its edges tell: a row of a
    near pair that the forest stands for, and each row of a key that is worked off in several parts.
    """
    held: list[np.ndarray] = []
    at_once = limits.at_once
    anchor: tuple = (None, None, None)  # the first rows of the key at hand, which its later parts meet

    def table(edges: list[tuple[int, int]], marks: list[tuple[int, int]]) -> pa.RecordBatch:
        none = [None] * len(edges)
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges] + [m[0] for m in marks], pa.int64()), pa.array([e[1] for e in edges] + [None] * len(marks), pa.int64()), pa.array(none + [m[1] for m in marks], pa.int64())], names=["u", "v", "key"])

    def large(key: int, part: int, split: bool, ids: np.ndarray, sig: np.ndarray, edges: list, marks: list) -> None:
        nonlocal anchor
        if anchor[0] != (key, part):
            anchor = ((key, part), ids[:0], sig[:0])
        crowded = split or len(ids) >= at_once or len(anchor[1]) > 0
        for k in range(0, len(ids), at_once):
            some, bits = np.concatenate([anchor[1], ids[k : k + at_once]]), np.concatenate([anchor[2], sig[k : k + at_once]])
            found, near, others = _forest(bits, distance)
            edges += [(int(some[a]), int(some[b])) for a, b in found]
            if crowded or others:
                marks += [(int(i), key) for i in (ids[k : k + at_once] if crowded else some[near])]
            if not len(anchor[1]):
                anchor = ((key, part), some[: limits.few], bits[: limits.few])

    def work(key: np.ndarray, part: np.ndarray, parts: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, [len(key)]])
        sizes = np.diff(cut)
        few = (sizes <= limits.few) & (parts[cut[:-1]] == 1)
        few[0] &= (key[0], part[0]) != anchor[0]
        group = np.repeat(np.arange(len(sizes)), sizes)
        edges, marked = _small_keys(group, ids, sig, np.repeat(cut[1:], sizes) * np.repeat(few, sizes), limits.few, distance)
        marks = [(int(ids[i]), int(key[i])) for i in marked]
        for g in np.flatnonzero(~few):
            a, b = cut[g], cut[g + 1]
            large(int(key[a]), int(part[a]), bool(parts[a] > 1), ids[a:b], sig[a:b], edges, marks)
        return table(edges, marks)

    for batch in batches:
        new = [c.to_numpy() for c in batch.columns[:4]] + [np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[4:]], axis=1)]
        rows = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if len(rows[0]) - cut > at_once:  # the rest of a crowded key comes with the next batches
            cut = len(rows[0]) - (len(rows[0]) - cut) % at_once
        held = [x[cut:] for x in rows]
        if cut:
            yield work(*[x[:cut] for x in rows])
    if held and len(held[0]):
        yield work(*held)


def _sent(table: DataFrame) -> DataFrame:
    """A written table as a join's side: sent to all tasks if it is small."""
    return F.broadcast(table) if table.count() <= SMALL_TABLE else table


def candidates(values: DataFrame, limits: Limits = LIMITS, distance: int = WIDE_DISTANCE) -> DataFrame:
    """Candidate links (u, v, null) and marks (u, null, key) of _candidates among wide fingerprints (id, t0.., s0..).

    Two values meet under a key if they agree in the tops of its blocks. A key with very many rows is spread
    over tasks in parts; all its rows are marked then.
    """
    some = choices(values.count())
    top = lambda b: F.shiftright(TOPS[b // 8], 8 * (b % 8)).bitwiseAND(F.lit(255).cast("long"))
    keys = [F.xxhash64(F.lit(t), *map(top, blocks)) for t, blocks in enumerate(some)]
    keyed = values.select("id", *WORDS, F.explode(F.array(*keys)).alias("key"))
    crowded = keyed.groupBy("key").count().where(F.col("count") > limits.split).select("key", F.ceil(F.col("count") / limits.split).alias("parts"))
    keyed = keyed.join(_sent(written(crowded, "near-crowds")), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    keyed = keyed.select("key", F.pmod(F.xxhash64("id", "key"), F.col("parts")).alias("part"), "parts", "id", *WORDS)
    return keyed.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lambda batches: _candidates(batches, distance, limits), "u long, v long, key long")


def alike(pairs: DataFrame, bodies: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose texts (id, text) share that part of their shingles.

    Texts are dealt into blocks of BLOCK_BYTES or less, enough of them to keep all tasks busy, and a pair goes to the cell of its two blocks; there,
    each text that the cell's pairs need comes once, before them.
    """
    tasks = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(ceil(sqrt(2 * tasks)), -(-int(bodies.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    cells = pairs.select(F.least(block("u"), block("v")).alias("lo"), F.greatest(block("u"), block("v")).alias("hi"), "u", "v")
    needed = cells.select("lo", "hi", F.col("u").alias("id")).unionByName(cells.select("lo", "hi", F.col("v").alias("id"))).distinct()
    first = needed.join(bodies, "id").select("lo", "hi", F.lit(0).alias("kind"), F.col("id").alias("u"), F.lit(0).cast("long").alias("v"), "text")
    both = first.unionByName(cells.select("lo", "hi", F.lit(1).alias("kind"), "u", "v", F.lit(None).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for batch in pieces(batches, "text", 4_000_000):
            u, v = [], []
            for lo, hi, kind, a, b, raw in zip(*(c.to_pylist() for c in batch.columns[:5]), utf8(batch.column("text")), strict=True):
                if cell != (lo, hi):
                    cell, sets = (lo, hi), {}
                if not kind:
                    sets[a] = shingle_codes(raw)
                    continue
                x, y = sets[a], sets[b]
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= similarity * (len(x) + len(y) - shared):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return both.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "kind").mapInArrow(run, "u long, v long")


def _linked(ids: list[int], block: list[int], root: list[int], sets: list[np.ndarray], across: bool, similarity: float) -> list[tuple[int, int]]:
    """Links that join the roots of a cell wherever two sets are similar; of rows of one block only, unless across."""
    top: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := top.get(i, i)) != i:
            top[i] = i = top.get(up, up)
        return i

    size = np.array([len(x) for x in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    main = max(set(root), key=root.count)  # pairs within the most frequent root are never needed
    of, blocks, out = np.array(root), np.array(block), []
    mark = np.zeros(int(place.max()) + 1, np.int64)
    for i in sorted((k for k in range(len(ids)) if root[k] != main), key=lambda k: root[k]):
        own = place[start[i] : start[i] + size[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[place], start)
        mark[own] = 0
        hit = (shared >= similarity * (size + size[i] - shared)) & (of != of[i])
        if across:
            hit &= blocks != blocks[i]
        for j in np.flatnonzero(hit).tolist():
            a, b = find(root[i]), find(root[j])
            if a != b:
                top[b] = a
                out.append((ids[i], ids[j]))
    return out


def crowd_links(open_: DataFrame, bodies: DataFrame, limits: Limits = LIMITS, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v) similar pairs that join the roots of marked rows (key, id, root): within each key all pairs of unlike roots are compared.

    The sets are compared in the task and only links between roots leave it. A key's texts are cut into
    blocks of about limits.block_bytes, and each block meets each other one in a cell of its own.
    """
    sized = open_.join(bodies.select("id", F.octet_length("text").alias("n")), "id")
    parts = sized.groupBy("key").agg(F.ceil(F.sum("n") / limits.block_bytes).cast("int").alias("parts")).select("key", F.greatest("parts", F.lit(1)).alias("parts"))
    rows = open_.join(written(parts, "near-parts"), "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "root", "id").join(bodies, "id")
    rows = rows.select("key", "lo", "hi", "block", "root", "id", "text").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def work() -> pa.RecordBatch:
            found = []
            if len({r for _, r, _, _ in held}) > 1:
                blocks, roots, ids, sets = map(list, zip(*held, strict=True))
                found = _linked(ids, blocks, roots, sets, cell[1] != cell[2], similarity)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in pieces(batches, "text", 4_000_000):
            for key, lo, hi, block, root, i, raw in zip(*(c.to_pylist() for c in batch.columns[:6]), utf8(batch.column("text")), strict=True):
                if cell != (key, lo, hi):
                    if held:
                        yield work()
                    cell, held = (key, lo, hi), []
                held.append((block, root, i, shingle_codes(raw)))
        if held:
            yield work()

    return rows.mapInArrow(run, "u long, v long")


def near_classes(docs: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, text_hash and component_id for all rows of docs: classes linked by similar shingle sets or close fingerprints.

    Links: five-word shingle sets that share SIMILARITY of their shingles (candidates by the wide fingerprint,
    then the sets themselves; equal sets are one), and the 64-bit fingerprints within DISTANCE. First the
    links of least forests are checked; then, under the keys where those leave several classes, all pairs of
    unlike classes are. Texts are compared once however often they occur; a text is named by its hash and its
    set's, 192 bits. Nulls, empty texts and repeated rows as in classes().
    """
    text = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = written(signatures(rows), "near-rows")
    name = ["text_hash", "h0", "h1"]
    texts = signed.groupBy(*name).agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("fp", "size", *TOPS, *WORDS)])
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "near-texts")
    by_fp = written(texts.groupBy("fp").agg(F.min("id").alias("rep")), "near-fp")
    by_set = written(texts.groupBy("h0", "h1").agg(F.min("id").alias("rep")), "near-sets")
    # A set so small that one more shingle is too many resembles no set but itself.
    values = texts.join(by_set.select(F.col("rep").alias("id")), "id", "left_semi").where(F.col("size") >= SIMILARITY * (F.col("size") + 1)).select("id", *TOPS, *WORDS)
    values = written(values, "near-values")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, text), one row of each text that is needed, by its smallest doc_id: a text of very many copies isn't moved for each."""
        needed = ids.distinct().join(texts.select("id", "text_hash", "first"), "id").select("id", F.col("text_hash").alias("_hash"), F.col("first").alias("_id"))
        found = rows.join(needed, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        return written(found.groupBy("id").agg(F.first("text").alias("text")), "near-bodies")

    def linked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Checked links and marks of candidates."""
        pairs = written(found.where("v IS NOT NULL").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-pairs")
        bodies = texts_of(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))))
        return alike(pairs, bodies), found.where("v IS NULL").select("key", F.col("u").alias("id")).distinct()

    def open_rows(marks: DataFrame, found: DataFrame) -> DataFrame:
        """(key, id, root) of the marks whose key has several roots."""
        rooted = written(marks.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "near-rooted")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("key")
        return written(rooted.join(mixed, "key", "left_semi"), "near-open")

    to_rep = lambda by, *c: texts.join(by.select(*c, "rep"), list(c)).where("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    close = components(links(by_fp.select("fp")))  # as a forest of stars: one link for each value
    close = close.join(by_fp.select(F.col("fp").alias("node"), F.col("rep").alias("u")), "node").join(by_fp.select(F.col("fp").alias("root"), F.col("rep").alias("v")), "root").where("u != v").select("u", "v")
    same = lambda found: found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    collect_garbage(docs.sparkSession)
    some = written(candidates(values, limits), "near-candidates")
    edges, marks = linked(some)
    found = components(edges.unionByName(close).unionByName(to_rep(by_fp, "fp")).unionByName(to_rep(by_set, "h0", "h1")))
    left = open_rows(marks, found)
    # Keys of many parts: a few members of each class meet first, so that the classes of the parts become one.
    while not left.groupBy("key").count().where(F.col("count") > limits.split).isEmpty():
        rank = F.row_number().over(Window.partitionBy("key", "root").orderBy(F.xxhash64("id", "key"), "id"))
        heads = left.withColumn("rank", rank).where(F.col("rank") <= limits.heads).select("id").distinct()
        edges, _ = linked(written(candidates(values.join(heads, "id", "left_semi"), limits), "near-candidates"))
        roots = found.withColumnRenamed("root", "r")
        edges = edges.join(roots.select(F.col("node").alias("u"), F.col("r").alias("a")), "u").join(roots.select(F.col("node").alias("v"), F.col("r").alias("b")), "v").where("a != b").select("u", "v")
        edges = written(edges, "near-heads")
        if edges.isEmpty():
            break
        found = components(edges.unionByName(same(found)))
        left = open_rows(marks, found)
    if not left.isEmpty():
        more = written(crowd_links(left, texts_of(left.select("id")), limits), "near-more")
        found = components(more.unionByName(same(found)))
    root = texts.select(*name, "first", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(*name, "first", F.coalesce("root", "id").alias("root"))
    collect_garbage(docs.sparkSession)
    least = written(root.groupBy("root").agg(F.min("first").alias("component_id")), "near-least")
    named = written(root.join(least, "root").select(*name, "component_id"), "near-classes")
    return signed.select("doc_id", *name).join(named, name).select("doc_id", "text_hash", "component_id")
