"""Each operator against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tapespark.llm import chat, common, decontamination, langid, media, mixing, quality, scoring, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().lower().split()


def corpus(n=240, seed=1):
    rng = np.random.default_rng(seed)
    vocab = {"en": ["the", "of", "and", "house", "river", "thing", "under", "water", "light", "stone"], "de": ["der", "die", "und", "haus", "fluss", "ding", "unter", "wasser", "licht", "stein"]}
    rows = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        text = " ".join(rng.choice(vocab[lang], rng.integers(20, 60)))
        rows.append((i, text, lang, f"src{i % 3}" if i % 7 else None, len(text)))
    return rows


ODD = [(1000, None, None, None, None), (1001, "", "en", "src0", 0), (1002, "\t\n ", None, "src1", 3), (1003, "the " * 60_000, "en", "src0", 240_000), (None, "the river", "en", "src2", 9), (5, "the house of stone " * 5, "en", "src1", 95), (5, "the house of stone " * 5, "en", "src1", 95)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus() + ODD, DOCS).withColumn("score", F.lit("x")).withColumn("share", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# mixing


def mixed(rows, weights=(1, 2, 3), cap=3.0):
    size = {i: len(words(r[1])) for i, r in enumerate(rows)}
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: s.encode()) + ([None] if any(r[3] is None for r in rows) else [])
    total = {s: sum(size[i] for i, r in enumerate(rows) if r[3] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(total.values()))
    while open_:  # reshare until nothing is above its cap
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > cap * total[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = cap * total[s]
            left -= target[s]
            open_.remove(s)
    return total, target


def test_mix_meets_every_budget(docs):
    rows = [tuple(r)[:5] for r in docs.collect()]
    total, target = mixed(rows)
    out = mixing.mix(docs, bucket_rows=7, carry=("source",)).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, abs=1)
    again = mixing.mix(docs.repartition(5), bucket_rows=7).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in out)


def test_mix_of_nothing(empty, spark):
    assert mixing.mix(empty).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, "a", "s", 0)], DOCS)).collect()] == [0]


# chat


def test_chat_escapes_come_back(spark):
    nasty = ["", "<|im_end|>", "<\\|im_start|>\\n", "a\n<|im_start|>assistant\nb", "<\\\\|x", "\\b\\n", "<|" * 50, "é" * 3]
    turns = spark.createDataFrame([(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate([("user\n<|x", nasty[0]), *[("assistant", n) for n in nasty], ("tool\\n", None)])], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.conversations(turns))).collect()}
    for r in got.values():
        assert [(t.role, t.text) for t in r.read_turns] == [("user\n<|x", "")] + [("assistant", n) for n in nasty] + [("tool\\n", "")]
        assert r.loss_text == "".join(nasty)
        assert r.formatted.count("<|im_start|>") == len(nasty) + 2


def test_chat_layouts_become_canonical_turns(spark):
    schema = "id int, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, instruction string, input string, output string, prompt string, completion string, system string"
    rows = [
        (1, [("user", "q"), ("assistant", None)], None, None, None, None, None, None, "s"),
        (2, None, [("human", "q"), ("gpt", "a")], None, None, None, None, None, None),
        (3, None, None, "do", "this", "done", None, None, None),
        (4, None, None, "do", None, None, None, None, None),
        (5, None, None, None, None, None, "p", "c", None),
        (6, None, None, None, None, None, None, None, None),
        (7, None, [("human", "q")], "both", None, None, None, None, None),
    ]
    got = {r.id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.canonical(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("messages", [("system", "s"), ("user", "q"), ("assistant", "")]),
        2: ("sharegpt", [("user", "q"), ("assistant", "a")]),
        3: ("instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        4: ("instruction", [("user", "do")]),
        5: ("prompt", [("user", "p"), ("assistant", "c")]),
        6: (None, []),
        7: (None, []),
    }


def test_chat_handles_null_keys_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string, extra string"
    rows = [(None, 0, None, None, "x"), (None, None, "user", "a", None), (3, 1, "user", "b", None), (3, 1, "user", "b", None)]
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.conversations(spark.createDataFrame(rows, schema)))).collect()}
    assert len(got[3].read_turns) == 2 and set(got) == {None, 3}
    assert chat.conversations(spark.createDataFrame([], schema)).count() == 0


# simhash


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, distance=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_matches_brute_force(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.classes(docs).collect()), key=str)
    fps = [fingerprint(t) for _, t in rows]
    assert sorted((str(i), f) for (i, _), f in zip(rows, fps, strict=True)) == sorted((str(i), f) for i, f, _ in got)
    found = classes(fps)
    least = {}
    for (i, _), c in zip(rows, found, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((str(i), str(least.get(c))) for (i, _), c in zip(rows, found, strict=True))
    assert want == sorted((str(i), str(c)) for i, _, c in got)


def test_simhash_links_survive_large_keys(spark):
    rng = np.random.default_rng(3)
    values = {int(x) for x in rng.integers(0, 2**63, 40)}
    centre = int(rng.integers(0, 2**63))
    for _ in range(150):  # a crowded neighbourhood, far more than a key may hold
        v = centre
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            v ^= 1 << int(b)
        values.add(v)
    values = sorted(values)
    fps = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    for large in (8, 4096):
        edges = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(fps, large=large).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in edges) or large  # spanning edges may join through others
        place = {v: i for i, v in enumerate(values)}
        root = list(range(len(values)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = find(place[a]), find(place[b])
            root[max(x, y)] = min(x, y)
        want = classes(values)
        assert len({(find(i), w) for i, w in enumerate(want)}) == len(set(want)) == len({find(i) for i in range(len(values))})


def test_components_follow_long_paths(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200}
    assert simhash.components(edges.where("u < 0")).count() == 0


@pytest.mark.parametrize("in_task", [1_000_000, 0])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, in_task):
    monkeypatch.setattr(simhash, "ONE_TASK", in_task)
    rng = np.random.default_rng(8)
    nodes = rng.integers(-(1 << 62), 1 << 62, 400)
    pairs = [(int(nodes[a]), int(nodes[b])) for a, b in rng.integers(0, 400, (220, 2))] + [(int(a), int(b)) for a, b in zip(nodes[:90], nodes[1:90], strict=False)]
    want = {i: i for edge in pairs for i in edge if edge[0] != edge[1]}
    for _ in range(len(want)):
        before = dict(want)
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    got = [(r.node, r.root) for r in simhash.components(spark.createDataFrame(pairs, "u long, v long").repartition(5)).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_few_edges_take_two_tables(spark):
    edges, at = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long"), common.mark()
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    assert common.mark() - at <= 2  # before, a table a round, and each of its files starts processes in the executors


def test_one_of_each_class_stays(docs, empty):
    found = simhash.near_classes(docs)
    kept = simhash.one_of_each(docs, found).select("doc_id", "text", "share")
    by = {}
    for r in found.collect():
        by.setdefault(r.component_id, set()).add(r.doc_id)
    rows = kept.collect()
    assert len(rows) == len(by)
    assert {r.doc_id for r in rows} == {min((i for i in c if i is not None), default=None) for c in by.values()}
    assert simhash.one_of_each(empty, simhash.near_classes(empty)).count() == 0


def similar(a, b):
    x, y = set(simhash.shingle_codes(a.encode()).tolist()), set(simhash.shingle_codes(b.encode()).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def joined(texts, at_least=0.8, by_bits=True):
    """Brute force: the class of each text by similar sets and close fingerprints, and the pairs with similar sets."""
    sets, fps = [set(simhash.shingle_codes(t.encode()).tolist()) for t in texts], [simhash.fingerprint(t.encode()) for t in texts]
    root, pairs = list(range(len(texts))), []

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            alike = (n := len(x & sets[j])) >= at_least * (len(x) + len(sets[j]) - n)
            if alike:
                pairs.append((j, i))
            if alike or by_bits and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], pairs


def random_word(rng):
    return "".join(rng.choice(list("abcdefghij"), 6))


SMALL_LIMITS = simhash.Limits(few=4, at_once=16, split=50, heads=3, block_bytes=20_000)


@pytest.mark.parametrize("limits", [simhash.LIMITS, SMALL_LIMITS], ids=["usual", "small"])
def test_near_classes_find_similar_texts(spark, limits):
    rng = np.random.default_rng(12)
    texts = [" ".join(random_word(rng) for _ in range(rng.integers(100, 300))) for _ in range(60)]
    base = [random_word(rng) for _ in range(200)]
    for i in range(150):  # a family of copies that differ in one to sixteen words, and so resemble each other more or less
        w = list(base)
        for k in rng.choice(200, 1 + i % 16, replace=False):
            w[k] = random_word(rng)
        texts.append(" ".join(w))
    for i in range(40):  # pairs of graded likeness
        w = texts[i].split()
        for _ in range(1 + i // 8):
            w[rng.integers(0, len(w))] = random_word(rng)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_classes(docs, limits).collect()}
    want, pairs = joined(texts)
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)
    assert all(want[i] == want[c] for i, c in got.items())  # nothing else is joined


def test_near_classes_find_pairs_at_the_edge(spark):
    rng = np.random.default_rng(21)
    texts = []
    for i in range(500):  # pairs whose likeness is 0.8 to 0.85: a run of new words at the end
        n = int(rng.integers(40, 400))
        w = [random_word(rng) for _ in range(n)]
        k = max(1, int((n - 4) * rng.uniform(0.085, 0.108)))
        texts += [" ".join(w), " ".join(w[:-k] + [random_word(rng) for _ in range(k)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_classes(docs).collect()}
    edge = [i for i in range(0, 1000, 2) if 0.8 <= similar(texts[i], texts[i + 1]) < 0.85]
    assert len(edge) > 300
    assert sum(got[i] == got[i + 1] for i in edge) >= 0.98 * len(edge)
    assert all(c // 2 == i // 2 for i, c in got.items())


def test_near_classes_of_a_crowd_with_far_members_first(spark):
    rng = np.random.default_rng(22)
    base, other = ([random_word(rng) for _ in range(120)] for _ in range(2))

    def copy(words, changes):
        w = list(words)
        for k in rng.choice(len(w), changes, replace=False):
            w[k] = random_word(rng)
        return " ".join(w)

    texts = [copy(base, 9) for _ in range(2200)] + [copy(base, 1) for _ in range(600)] + [copy(other, 2) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want, pairs = joined(texts)
    for limits in (simhash.LIMITS, simhash.Limits(few=32, at_once=200, split=1000, heads=8, block_bytes=300_000)):
        got = {r.doc_id: r.component_id for r in simhash.near_classes(docs, limits).collect()}
        assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
        assert all(want[i] == want[c] for i, c in got.items())


def test_near_classes_keep_different_short_texts_apart(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(1 + i % 6)) for i in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(6000 + i, t.upper()) for i, t in enumerate(texts[:50])], "doc_id long, text string")
    close = {r.doc_id: r.component_id for r in simhash.classes(docs).collect()}  # the 3-bit rule links of its own
    got = {r.doc_id: r.component_id for r in simhash.near_classes(docs).collect()}
    assert all(got[6000 + i] == got[i] for i in range(50))
    assert len(set(got.values())) == len(set(close.values())) > 5900


@pytest.mark.parametrize("limits", [simhash.LIMITS, simhash.Limits(few=4, at_once=16, split=50, block_bytes=3000)], ids=["usual", "small"])
def test_classes_of_a_crowded_key_all_meet(spark, limits):
    rng = np.random.default_rng(3)
    base = [[random_word(rng) for _ in range(30)] for _ in range(40)]
    texts = [" ".join(base[i % 40] + [random_word(rng)] * (i // 40)) for i in range(120)]
    rows = [(k, i, i) for k in (1, 2) for i in range(120)]  # all in each key, each a class of its own
    open_ = spark.createDataFrame(rows, "key long, id long, root long").repartition(3)
    bodies = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [(r.u, r.v) for r in simhash.crowd_links(open_, bodies, limits).collect()]
    root = list(range(120))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in got:
        assert similar(texts[a], texts[b]) >= 0.8
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(120)] == joined(texts, by_bits=False)[0]
    alone = open_.where("key = 1").withColumn("root", F.lit(5))
    assert simhash.crowd_links(alone, bodies, limits).count() == 0


def test_forests_span_and_mark_what_they_leave_out():
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 6, 90))
    sig = rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64)[rng.integers(0, 6, 90)]
    sig ^= np.uint64(1) << rng.integers(0, 63, (90, 8)).astype(np.uint64)
    near = {(i, j) for j in range(90) for i in range(j) if key[i] == key[j] and np.bitwise_count(sig[i] ^ sig[j]).sum() <= 40}
    assert len(near) > 100
    for limits in (simhash.LIMITS, simhash.Limits(few=4), simhash.Limits(few=2, at_once=8)):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 25].copy()) for x in (key, np.zeros(90, np.int64), np.ones(90, np.int64), np.arange(90), *sig.view(np.int64).T)], names=["key", "part", "parts", "id", *simhash.WORDS]) for k in range(0, 90, 25)]
        rows = [r for b in simhash._candidates(iter(batches), 40, limits) for r in b.to_pylist()]
        edges = {(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in rows if r["v"] is not None}
        marks = {(r["key"], r["u"]) for r in rows if r["v"] is None}
        assert edges <= near and len(edges) < 90
        assert all((i, j) in edges or {(key[i], i), (key[j], j)} <= marks for i, j in near)


# media


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1536, 1537, 49152, 49153, 300_000])
def test_media_round_trip(n):
    raw = bytes((7 * i + i // 251) % 256 for i in range(n))
    stored = media.write(media.padded(raw))
    found = media.read(stored)
    payload = b"".join(stored[at : at + size] for *_, at, size, _ in [(p[0], p[3], p[4], p[5]) for p in found.packets])
    assert payload == media.padded(raw) and len(payload) % 192 == 0 and payload
    assert found.doc_type == "matroska" and found.tracks[1] == {"type": 2, "codec": "A_PCM/INT/LIT", "depth": 8, "frame_ns": 24_000_000}
    assert [p[2] for p in found.packets] == [24 * i for i in range(len(found.packets))]
    assert [c[2] for c in found.cues] == found.clusters


@pytest.mark.parametrize("lacing", [media.XIPH_LACING, media.EBML_LACING, media.FIXED_LACING])
def test_media_laces(lacing):
    frames = [b"a" * 9, b"b" * 9, b"c" * 9] if lacing == media.FIXED_LACING else [b"a" * 700, b"b", b"c" * 255, b"d" * 5000, b"e" * 3]
    block = b"\x82" + (5).to_bytes(2, "big") + bytes([lacing << 1]) + media.lace(frames, lacing)
    tail = media.element(media.CLUSTER, media.number(media.CLUSTER_TIME, 1000) + media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block) + media.number(media.BLOCK_DURATION, 10 * len(frames))))
    data = media.element(media.EBML, media.element(media.DOC_TYPE, b"webm")) + media.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + tail
    found = media.read(data)  # the segment's size isn't known
    assert [data[p[3] : p[3] + p[4]] for p in found.packets] == frames
    assert [(p[0], p[2]) for p in found.packets] == [(2, 1005 + 10 * i) for i in range(len(frames))]


UNKNOWN = b"\x01" + b"\xff" * 7
HEAD = media.element(media.EBML, media.element(media.DOC_TYPE, b"webm"))


def open_element(ident, body):
    return ident.to_bytes(4, "big") + UNKNOWN + body


def simple(time, frame, flags=0x80):
    return media.element(media.SIMPLE_BLOCK, b"\x81" + time.to_bytes(2, "big") + bytes([flags]) + frame)


def test_media_clusters_of_unknown_size():
    cues = media.element(media.CUES, media.element(media.CUE_POINT, media.number(media.CUE_TIME, 0) + media.element(media.CUE_POSITIONS, media.number(media.CUE_TRACK, 1) + media.number(media.CUE_CLUSTER, 0))))
    live = b"".join(open_element(media.CLUSTER, media.number(media.CLUSTER_TIME, 100 * k) + simple(1, b"a%d" % k) + simple(2, b"b%d" % k, 0)) for k in range(3))
    for segment in (open_element(media.SEGMENT, live + cues), media.element(media.SEGMENT, live + cues), open_element(media.SEGMENT, live) + open_element(media.SEGMENT, live)):
        data = HEAD + segment
        found = media.read(data)
        times = len(found.packets) // 6
        assert [(p[1], p[2], data[p[3] : p[3] + p[4]], p[5]) for p in found.packets] == [(3 * s + k, 100 * k + 1 + j, b"%s%d" % (b"ab"[j : j + 1], k), j == 0) for s in range(times) for k in range(3) for j in range(2)]
        assert len(found.clusters) == 3 * times and len(found.cues) == (times == 1)


def test_media_durations_and_key_frames():
    def track(n, *more):
        return media.element(media.TRACK, media.number(media.TRACK_NUMBER, n) + media.number(media.TRACK_TYPE, 2) + media.element(media.CODEC, b"x") + b"".join(more))

    tracks = media.element(media.TRACKS, track(1, media.number(media.DEFAULT_DURATION, 20_000_000)) + track(2))
    block = lambda n: bytes([0x80 | n]) + (0).to_bytes(2, "big") + bytes([media.FIXED_LACING << 1]) + media.lace([b"x", b"y"], media.FIXED_LACING)
    body = media.number(media.CLUSTER_TIME, 50) + media.element(media.SIMPLE_BLOCK, block(1)) + media.element(media.SIMPLE_BLOCK, block(2))
    body += media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block(1)))
    body += media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block(2)) + media.number(media.BLOCK_DURATION, 8) + media.element(media.REFERENCE_BLOCK, b"\xff"))
    found = media.read(HEAD + media.element(media.SEGMENT, tracks + media.element(media.CLUSTER, body)))
    assert [(p[0], p[2], p[5]) for p in found.packets] == [(1, 50, False), (1, 70, False), (2, 50, False), (2, 50, False), (1, 50, True), (1, 70, True), (2, 50, False), (2, 54, False)]


def test_media_damage_is_told(spark):
    bad_duration = media.element(media.INFO, media.element(media.DURATION, b"abc"))
    short_block = media.element(media.CLUSTER, media.element(media.SIMPLE_BLOCK, b"\x81\x00"))
    whole = media.write(media.padded(b"x" * 1000))
    rows = [(1, HEAD + media.element(media.SEGMENT, bad_duration)), (2, HEAD + media.element(media.SEGMENT, short_block)), (3, None), (4, b""), (5, whole[: len(whole) // 2]), (6, whole)]
    got = {r.id: (r.error is not None, len(r.packets)) for r in media.packets(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 0), 4: (True, 0), 5: (True, 0), 6: (False, 6)}


def test_media_tables(docs, empty):
    rows = {r.doc_id: r for r in media.digests(docs).collect() if r.doc_id not in (None, 5)}
    for r in docs.where("doc_id != 5").collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        got = rows[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    table = media.packets(media.encoded(docs.select("doc_id", "text").limit(5))).withColumn("n", F.size("packets"))
    assert all(r.n > 0 and r.error is None for r in table.collect())
    broken = media.packets(docs.select("doc_id", F.lit(b"\x1a\x45\xdf\xa3\x00").alias("media")).limit(1)).first()
    assert broken.error and broken.packets == []
    assert media.digests(empty).count() == 0


# warc


def test_warc_round_trip(spark, tmp_path):
    schema = "page_id long, url string, html string, extra int"
    rows = [(3, "http://a.b/x", "<p>one</p>", 1), (1, "http://a.b/y", "<p>one</p>", 1), (2, None, None, 1), (4, "u", "", None), (7, "http://c\r\nd/", "\r\n\r\nWARC/1.1\r\n\r\n" * 3, 1), (8, "z", "é" * 70_000, 1), (9, "z", "two", 1), (9, "z", "two", 1), (9, "z", "three", 1), (None, "n", "null page", 1)]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, schema).repartition(3), path)
    found = warc.records(spark, path, payloads=True)
    assert {r.kind for r in found.select("kind").distinct().collect()} == {"request", "metadata", "response", "revisit"}
    got = warc.captures(found).collect()
    assert len(got) == len({(r[0], r[2] or "") for r in rows})
    by = {(r.metadata.page_id, r.answer.digest): r for r in got}
    for page, _, html, _ in rows:
        body = (html or "").encode()
        digest = __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
        r = by[page, digest]
        first = min((p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None), default=None)
        assert r.answer.kind == ("response" if page in (first, None) else "revisit")
        assert r.request.kind == "request" and r.metadata.copies == sum(x[0] == page and (x[2] or "") == (html or "") for x in rows)
        if r.answer.kind == "response":
            assert r.answer.payload == body and r.answer.payload_digest == digest
        else:
            assert r.answer.refers_to == f"<urn:capture:{first}:{digest}:response>"


def test_warc_of_nothing(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captures(warc.records(spark, path)).count() == 0
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(b"nothing"))


# classifiers


def labelled(n=600, bad=("idiot", "scum"), seed=2):
    rng = np.random.default_rng(seed)
    base = ["the", "of", "river", "stone", "under", "light", "water", "house", "clear", "idea"]
    texts, labels = [], []
    for i in range(n):
        w = list(rng.choice(base, rng.integers(30, 80)))
        y = int(i % 5 == 0)
        if y:
            w[rng.integers(0, len(w))] = bad[i % len(bad)]
        texts.append(" ".join(w))
        labels.append(y)
    return texts, labels


def test_toxicity_finds_held_out_words():
    texts, labels = labelled()
    model = toxicity.fit(texts[:400], labels[:400], 0.2, steps=300)
    p = model.score(texts[400:])
    assert ((p >= 0.5) == np.array(labels[400:])).mean() > 0.97
    long = "the river " * 100_000
    assert model.score([long])[0] < 0.5 <= model.score([long + "you IDIOT, you scum"])[0]
    assert model.score(["", "x"]).max() < 0.5


def test_toxicity_without_both_classes(docs, empty):
    model = toxicity.fit([], [], 0.0)
    out = toxicity.score(docs, model)
    assert out.where("score >= 0.5").count() == 0 and out.count() == docs.count() and out.columns.count("score") == 1
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(["a"], [1], 1.0).score(["a"])[0] > 0.5


def test_quality_tells_junk_passages():
    rng = np.random.default_rng(4)
    texts, labels = labelled(500, seed=5)
    for i in range(0, 500, 4):
        texts[i] = texts[i].upper().replace(" ", "!! ") if i % 8 else " ".join([str(rng.choice(["Xa", "Yb"]))] * 90)
    y = [int(i % 4 != 0) for i in range(500)]
    model = quality.fit(texts[:350], y[:350], np.mean(y), epochs=15)
    assert ((model.score([t.encode() for t in texts[350:]]) >= 0.3) == np.array(y[350:])).mean() > 0.95
    assert np.isfinite(model.score([b"", b"a" * 200_000, b" "])).all()


def passage_by_hand(raw, first):
    """The features of one passage: raw with the byte before it (None at a text's start), counted byte by byte."""
    before, body = raw
    kinds = [quality.KIND[b] for b in body]
    prior = [4 if before is None else quality.KIND[before], *kinds[:-1]]
    pairs = np.zeros(quality.CLASSES**2)
    for x, y in zip(prior[: len(kinds)], kinds, strict=True):
        pairs[x * quality.CLASSES + y] += 1
    return np.concatenate([np.sqrt(pairs / max(len(body), 1)), [len(body) / quality.PASSAGE, float(first)]])


def test_quality_features_and_scores_match_loops():
    texts = [b"One two two.\nThree | 4,5! " * 60, "é\u2003ü".encode() * 400, b"", b" ", b"a" * 1025]
    x, counts = quality.passages(texts)
    assert counts.tolist() == [max(1, -(-len(t) // 512)) for t in texts]
    row = 0
    for t in texts:
        for k in range(0, max(len(t), 1), 512):
            want = passage_by_hand((t[k - 1] if k else None, t[k : k + 512]), k == 0)
            n = quality.CLASSES**2
            assert x[row, :n] == pytest.approx(want[:n], abs=1e-6) and x[row, n + 4 :] == pytest.approx(want[n:], abs=1e-6)
            row += 1
    words_of = b"so so fine words here, so fine fine".split()
    x, _ = quality.passages([b" ".join(words_of)])
    n = quality.CLASSES**2
    assert x[0, n : n + 4] == pytest.approx([2 / 8, 4 / 8, sum(map(len, words_of)) / 8 / 10, np.log1p(8) / 5], abs=1e-6)
    model = quality.fit(["a b c. " * 200, "D!! E!! " * 200, "x y"], [1, 0, 1], 0.6, epochs=2)
    p, got = model.p, model.score(texts)
    for text, score in zip(texts, got, strict=True):
        rows, _ = quality.passages([text])
        hidden = [np.tanh((r - model.mean) / model.scale @ p["e"] + p["e0"]) for r in rows]
        energy = [float(np.tanh(h @ p["v"]) * (1 / (1 + np.exp(-(h @ p["u"])))) @ p["w"]) for h in hidden]
        share = np.exp(np.array(energy) - max(energy))
        logit = sum(a * h for a, h in zip(share / share.sum(), hidden, strict=True)) @ p["c"] + p["c0"][0]
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_quality_gradients_agree_with_differences():
    x, counts = quality.passages([b"One two. " * 100, b"A B C", b"", b"zz! " * 400])
    model = quality.fit(["a b c", "D!! E!!"], [1, 0], 0.5, epochs=1)
    assert model.forward(x, counts)["a"].sum() == pytest.approx(4, abs=1e-4) and counts.tolist() == [2, 1, 1, 4]
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y, weight = x.astype(np.float64), np.array([1.0, 0.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5, 1.0])

    def loss():
        logit = model.forward(x, counts)["logit"]
        return float((weight * (np.log1p(np.exp(-np.abs(logit))) + np.maximum(logit, 0) - y * logit)).sum() / len(y))

    grads, rng = model.gradients(x, counts, y, weight), np.random.default_rng(1)
    for name, values in model.p.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in values.shape)
            kept = values[at]
            values[at] = kept + 1e-5
            up = loss()
            values[at] = kept - 1e-5
            down = loss()
            values[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-7)


def grams_by_hand(text):
    """The codes of all n-grams of a text, letter by letter."""
    points = [32 if 9 <= ord(c) <= 13 else ord(c) for c in f" {text.lower()} "]
    found = set()
    for n in toxicity.GRAMS:
        for k in range(len(points) - n + 1):
            code = points[k]
            for c in points[k + 1 : k + n]:
                code = (code * int(toxicity.BASE) + c) % 2**64
            found.add(code * int(toxicity.MIX) % 2**64)
    return found


def test_toxicity_scores_match_loops():
    texts, labels = labelled(300, seed=8)
    model = toxicity.fit(texts, labels, 0.2, steps=50)
    weights = dict(zip(model.codes.tolist(), model.weights.tolist(), strict=True))
    some = [*texts[:12], "", "x", "idiot\tSCUM \U0001f600 é", "the idiot " * 300]
    got = model.score(some)
    for text, score in zip(some, got, strict=True):
        odds = model.bias + sum(weights.get(c, 0.0) for c in grams_by_hand(text))
        assert score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)
    pos = sum(labels)
    for code in model.codes[::40].tolist():  # the scale of a kept n-gram is its log-count ratio
        a = sum(code in grams_by_hand(t) for t, y in zip(texts, labels, strict=True) if y)
        b = sum(code in grams_by_hand(t) for t, y in zip(texts, labels, strict=True) if not y)
        assert toxicity.ratio(np.array([a]), np.array([b]), pos, len(labels) - pos)[0] == pytest.approx(np.log((a + 1) / (pos + 2)) - np.log((b + 1) / (len(labels) - pos + 2)))
        assert a + b >= 3


def test_quality_frame(docs, empty):
    out = quality.score(docs, quality.fit([], [], 0.0))
    assert {round(r.score, 6) for r in out.collect()} == {0.5} and quality.score(empty, quality.fit([], [], 0.0)).count() == 0


# language


def test_language_fuses_evidence(spark, docs):
    model = langid.trained(docs)
    assert model.languages == ["de", "en"]
    pages = [(i, f"https://h{i % 4}.example.{('com', 'de')[i % 2]}/p", f"<html lang='{('en', 'de')[i % 2]}'><body><script>der die und</script><p>{t}</p></body></html>") for i, t, *_ in corpus(80, 9)]
    pages += [(900, "https://h1.example.de/", "<html lang=de><p>Zug</p></html>"), (901, None, None), (902, "x", "<p>123 456</p>"), (903, "https://h0.example.com/", "<p>" + "the house " * 50_000 + "</p>")]
    rows = langid.pages_as_rows(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.page_id: r for r in langid.identify(rows, model, markup=True).collect()}
    assert all(got[i].language == ("en", "de")[i % 2] for i in range(80))
    assert got[900].language == "de" and got[901].language == got[902].language == "und" and got[903].language == "en"
    with_join = langid.identify(rows, model, markup=True)
    langid.HOSTS, kept = 0, langid.HOSTS
    try:
        joined = langid.identify(rows, model, markup=True)
        assert sorted(map(str, joined.collect())) == sorted(map(str, with_join.collect()))
    finally:
        langid.HOSTS = kept


def test_language_without_training(empty, docs):
    model = langid.trained(empty)
    rows = docs.withColumns({"_host": F.col("source"), "_suffix": F.lit(""), "_declared": F.col("lang")})
    assert {r.language for r in langid.identify(rows, model).collect()} == {"und"}


def test_language_reads_whole_pages_texts_and_languages(spark):
    late = f"<!-- {'x' * 70_000} --><html lang=de><body>a</body></html>"
    pages = spark.createDataFrame([(1, "http://a.de", late), (2, "http://a.de", "<html><body>a</body></html>")], "page_id long, url string, html string")
    assert {r.page_id: r._declared for r in langid.pages_as_rows(pages).collect()} == {1: "de", 2: None}
    docs = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)}", f"l{i:02d}") for i in range(70)]
    assert langid.trained(spark.createDataFrame(docs, "doc_id long, text string, lang string")).languages == [x[2] for x in docs]
    model = langid.trained(spark.createDataFrame([(1, "abc " * 500_001 + "xyzw", "a"), (2, "abc", "b")], "doc_id long, text string, lang string"))
    slot = next(langid.codes("xyz"))[1]
    assert model.logs[slot, 0] > model.logs[:, 0].min()


def test_language_chunks_change_nothing():
    text = "Der Fluß, die Häuser; 12 und? " * 50
    whole = np.concatenate(list(langid.codes(text)))
    for chunk in (1, 7, 64, 1000):
        assert np.concatenate(list(langid.codes(text, chunk))).tolist() == whole.tolist()
    assert list(langid.codes("")) == []


def test_language_codes_and_null_hosts(spark):
    docs = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate([("alpha beta gamma", "en"), ("kamusta ka aking", "fil"), ("tervetuloa kaikki", "fi")] * 20)], "doc_id long, text string, lang string")
    rows = [(1, "xq", "h", "s", "fil-PH"), (2, "xq", "h", "s", "FI"), (3, "xq", "h", "s", "en_GB"), (4, "kamusta", None, None, None), (5, "tervetuloa", "", "", "deu")]
    got = {r.id: r for r in langid.identify(spark.createDataFrame(rows, "id long, text string, _host string, _suffix string, _declared string"), langid.trained(docs), least=0.0).collect()}
    assert [got[i]._host for i in (4, 5)] == [None, ""] and got[4].language == "fil" and got[5].language == "fi"


def posteriors(rows, model):
    """Bayes' rule by the book: rows are (text, host, suffix, declared)."""
    names, logs = model.languages, [model.likelihood(r[0] or "") for r in rows]
    best = [int(ll.argmax()) if letters else -1 for ll, letters in logs]
    value = [("none" if d is None else v if (v := d.lower().split("-")[0]) in names else "other") for *_, d in rows]
    count = lambda test: np.array([sum(b == i and test(k) for k, b in enumerate(best)) for i in range(len(names))], float)
    every = count(lambda k: True)
    base = (every + 1) / (every + 1).sum()
    for k, (_, host, suffix, _) in enumerate(rows):
        if best[k] < 0:
            yield langid.UNKNOWN, 0.0
            continue
        of_suffix = count(lambda j, s=suffix: rows[j][2] == s)
        of_suffix = (of_suffix + langid.SUFFIX_LEAN * base) / (of_suffix.sum() + langid.SUFFIX_LEAN)
        of_host = count(lambda j, h=host, s=suffix, k=k: rows[j][1] == h and rows[j][2] == s and j != k)
        prior = (of_host + langid.HOST_LEAN * of_suffix) / (of_host.sum() + langid.HOST_LEAN)
        said = count(lambda j, k=k: value[j] == value[k])
        said = (said + langid.DECLARED_LEAN / (len(names) + 2)) / (every + langid.DECLARED_LEAN)
        log = logs[k][0] + np.log(prior) + np.log(said)
        p = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
        yield (names[int(p.argmax())] if p.max() >= langid.LEAST else langid.UNKNOWN), float(p.max())


def test_language_matches_brute_force(spark, docs):
    model = langid.trained(docs)
    rng = np.random.default_rng(15)
    rows = [(t if k % 9 else " ".join(t.split()[:2]), f"h{k % 5}" if k % 11 else None, ("com", "de", None)[k % 3], (None, "en", "de-AT", "xx")[int(rng.integers(0, 4))]) for k, t, *_ in corpus(90, 17)]
    rows += [(None, "h1", "com", "en"), ("123", "h1", "com", "de"), ("und the", "h1", "de", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, _host string, _suffix string, _declared string").repartition(3)
    got = {r.id: (r.language, r.posterior) for r in langid.identify(frame, model).collect()}
    for i, (language, p) in enumerate(posteriors(rows, model)):
        assert got[i][0] == language and got[i][1] == pytest.approx(p, abs=1e-9)


# decontamination


def test_decontamination_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    items = [(i, " ".join(word() for _ in range(rng.integers(15, 60))) + ". " + " ".join(word() for _ in range(5)) + ".") for i in range(40)] + [(100, None), (101, "a b"), (None, "nothing to find here at all")]
    filler = [word() for _ in range(400)]
    docs, want = [], {}
    for d in range(200):
        w = list(rng.choice(filler, rng.integers(0, 300)))
        if d % 5 == 0:
            i = int(rng.integers(0, 40))
            p = items[i][1].upper().split()
            if d % 10 == 0:  # a paraphrase: some words fall out
                p = [x for k, x in enumerate(p) if k % 9 != 4]
            k = int(rng.integers(0, len(w) + 1))
            w[k:k] = p
            want[d] = [i]
        docs.append((d, " ".join(w), "x"))
    docs += [(900, None, "x"), (901, "", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, share string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for n in (20_000, 10):
        got = {r.doc_id: r.item_ids for r in decontamination.decontaminate(frame, bench, items=n).collect()}
        assert {d: x for d, x in got.items() if x} == want and len(got) == 202
    assert decontamination.decontaminate(frame, bench.limit(0)).where("size(item_ids) > 0").count() == 0


def test_decontamination_finds_an_item_in_a_third_of_all_documents(spark):
    rng = np.random.default_rng(16)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    docs = [(d, " ".join([word() for _ in range(60)] + ([items[7][1]] if d % 3 == 0 else []) + [word() for _ in range(60)])) for d in range(300)]
    out = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r.item_ids for r in out.collect()} == {d: [7] if d % 3 == 0 else [] for d in range(300)}


def test_decontamination_finds_a_word_for_word_item_in_many_documents(spark):
    rng = np.random.default_rng(18)
    items = [(i, " ".join(random_word(rng) for _ in range(15))) for i in range(5)]
    docs = [(d, " ".join([random_word(rng) for _ in range(40)] + ([items[2][1]] if d % 10 == 0 else []) + [random_word(rng) for _ in range(40)])) for d in range(200)]
    out = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in out.where("size(item_ids) > 0").collect()} == set(range(0, 200, 10))


@pytest.mark.parametrize("kind", ["dropped", "substituted", "reordered"])
def test_decontamination_recalls_paraphrases(spark, monkeypatch, kind):
    """Against an exhaustive search: every passage of every document is compared with every item."""
    rng = np.random.default_rng(19)
    vocab = np.array([random_word(rng)[: 2 + k // 500] + str(k) for k in range(2500)])
    zipf = 1 / np.arange(1, 2501)
    draw = lambda n: rng.choice(vocab, n, p=zipf / zipf.sum()).tolist()
    items = [(i, " ".join(draw(int(rng.integers(20, 60)))) + ". " + " ".join(draw(6)) + ".") for i in range(60)]
    docs = []
    for d in range(240):
        w = items[d % 60][1].replace(".", "").split()
        share = (0.05, 0.15, 0.25)[d % 3]
        if kind == "dropped":
            w = [x for x in w if rng.random() > share]
        elif kind == "substituted":
            w = [draw(1)[0] if rng.random() < share else x for x in w]
        else:
            for k in range(0, len(w) - 1, 2):
                if rng.random() < 2 * share:
                    w[k], w[k + 1] = w[k + 1], w[k]
        docs.append((d, " ".join(draw(int(rng.integers(0, 120))) + w + draw(int(rng.integers(0, 120))))))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, i) for r in decontamination.decontaminate(frame, bench).collect() for i in r.item_ids}
    names, spaces, _ = decontamination.index(frame, items)
    monkeypatch.setattr(decontamination.Space, "near", lambda self, flat: tuple(x.ravel() for x in np.meshgrid(np.arange(len(flat) // decontamination.BLOCK), np.arange(len(self.ids)), indexing="ij")))
    terms = decontamination.Terms(names)
    want = {(d, i) for space in spaces for (d, _), found in zip(docs, space.search([terms.numbers(text.encode()) for _, text in docs]), strict=True) for i in found}
    assert got <= want and len(want) > 150
    assert len(got) >= 0.95 * len(want)


def test_decontamination_of_one_very_long_text(spark, monkeypatch):
    rng = np.random.default_rng(20)
    items = [(i, " ".join(random_word(rng) for _ in range(40))) for i in range(8)]
    fill = [random_word(rng) for _ in range(300)]
    size = decontamination.AT_ONCE * decontamination.BLOCK
    w = rng.choice(fill + items[6][1].split(), 3 * size).tolist()
    for i, at in enumerate((0, size - 20, size + 40, 2 * size - 1, 3 * size)):  # items on the edges of what is searched at once
        w[at:at] = items[i][1].split()
    out = decontamination.decontaminate(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert out.first().item_ids == [0, 1, 2, 3, 4]


def test_decontamination_finds_long_and_short_items(spark):
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 9)))
    items = [(0, " ".join(word() for _ in range(1200))), (1, "Kuala Zyx!"), (2, "東京は日本の首都です"), (3, " ".join(word() for _ in range(30)))]
    fill = lambda n: " ".join(word() for _ in range(n))
    docs = [(0, f"{fill(70)} {items[0][1]} {fill(200)}"), (1, "to kuala zyx"), (2, "昨日、東京は日本の首都です。と言った"), (3, f"{fill(40)} {items[3][1]}"), (4, "kuala and zyx"), (5, fill(900)), (6, " ".join(items[0][1].split()[:500]))]
    out = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r.item_ids for r in out.collect()} == {0: [0], 1: [1], 2: [2], 3: [3], 4: [], 5: [], 6: []}


@pytest.mark.parametrize("parts", [1, 5, 70])
def test_latent_space_is_fitted_on_all_passages(spark, parts):
    """Frequencies and the matrix that is decomposed, against loops over every passage of a corpus of more documents than any sample had."""
    rng = np.random.default_rng(21)
    vocab = [random_word(rng) + str(k) for k in range(90)]
    terms = sorted(x.encode() for x in vocab[:60])
    texts = [" ".join(rng.choice(vocab, int(rng.integers(0, 130)))) for _ in range(2500)] + [None, "", "nothing known"]
    corpus = decontamination.told(spark.createDataFrame([(t,) for t in texts], "text string").repartition(6), terms).cache()
    number, width = {x: i for i, x in enumerate(terms)}, 2 * decontamination.BLOCK
    split = [[number.get(w.encode(), -1) for w in (t or "").split()] for t in texts]
    passages = [w[k : k + width] for w in split for k in range(0, len(w), width)]
    assert tuple(corpus.agg(F.sum("docs"), F.sum("passages")).first()) == (len(texts), len(passages))
    frequent = corpus.select(F.explode(F.arrays_zip("term", "found")).alias("x")).groupBy("x.term").agg(F.sum("x.found")).collect()
    assert dict(map(tuple, frequent)) == {i: n for i in range(60) if (n := sum(i in w for w in split))}
    place = np.append(np.where(np.arange(60) % 3, np.cumsum(np.arange(60) % 3 > 0) - 1, -1), -1).astype(np.int32)  # a space of two thirds of the terms
    idf = rng.random(40) + 0.1
    want = np.zeros((40, 40))
    for w in passages:
        row = np.bincount([place[x] for x in w if place[x] >= 0], minlength=40) * idf
        if row.any():
            want += np.outer(row, row) / (row @ row)
    shared = spark.sparkContext.broadcast((60, [(np.full(61, -1, np.int32), idf[:0], []), (place, idf, [])]))
    sums = decontamination.products(corpus, shared, parts).toArrow().to_pylist()
    assert {r["space"] for r in sums} == {1} and len({r["stripe"] for r in sums}) == len(sums)
    assert np.allclose(decontamination.square(((r["stripe"], r["cells"], r["vals"]) for r in sums), idf), want, rtol=1e-4)


def test_spaces_are_cut_by_their_terms(spark, monkeypatch):
    rng = np.random.default_rng(22)
    items = [(i, " ".join(random_word(rng) for _ in range(20))) for i in range(12)]
    docs = [(d, " ".join([random_word(rng) for _ in range(30)] + ([items[d % 12][1]] if d % 2 else []))) for d in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(decontamination, "WIDTH", 50)
    _, spaces, _ = decontamination.index(frame, items)
    assert len(spaces) >= 6 and all(len(x.idf) <= 50 for x in spaces) and sum(len(x.ids) for x in spaces) == 12
    out = decontamination.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r.item_ids for r in out.collect()} == {d: [d % 12] if d % 2 else [] for d in range(60)}


def test_terms_of_a_column_are_those_of_its_texts():
    terms = decontamination.Terms([b"a", b"b\xc3\xa9", b"c"])
    texts = ["a  bé\x0bc\x0c (c) ... D ", "", None, "\x1c a\u0085 \u00a0c c\u2003a", "*** --", "A\tBé."]
    got = terms.of_column(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [decontamination.Terms([b"a", b"b\xc3\xa9", b"c"]).numbers((t or "").encode()).tolist() for t in texts]
    assert terms.of_column(pa.array([], pa.string())) == []


def test_common_length():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = ([bytes([x]) for x in rng.integers(0, 5, rng.integers(0, 30))] for _ in range(2))
        assert decontamination.common_length(a, b) == slow(a, b)


# language model


def test_lm_base_and_normalisation(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learn = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    c = Counter()
    for t in learn:
        c.update([*words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    got = scoring.lm_scores(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), b"\n"]), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), b"\n"]), 5)) for i, t in rows)
    assert want == sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got)
    assert {r.train_tokens for r in got} == {n}
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def zipf_docs(n=400, seed=23):
    """Texts over 3000 words, in which a word tells much about the next one; doc_id, text."""
    rng = np.random.default_rng(seed)
    vocab = [random_word(rng)[: 2 + k % 5] + str(k % 97) for k in range(3000)]
    start = 1 / np.arange(1, 3001)
    out = []
    for d in range(n):
        k, w = int(rng.choice(3000, p=start / start.sum())), []
        for _ in range(rng.integers(0, 120)):
            w.append(vocab[k])
            k = int(rng.choice(3000, p=start / start.sum())) if rng.random() < 0.3 else (7 * k + int(rng.integers(0, 3))) % 3000
        out.append((d, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def language_model(spark):
    rows = zipf_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2)
    scoring.FREQUENT, kept = 1500, scoring.FREQUENT  # so that some words are not sent to all tasks
    try:
        vocab, model, counts = scoring.trained(learn)
        scored = scoring.lm_scores(docs).collect()
    finally:
        scoring.FREQUENT = kept
    return rows, vocab, model, {bytes(r.word): r.n for r in counts.collect()}, scored


def test_lm_probabilities_add_up(language_model):
    _, vocab, model, counts, _ = language_model
    assert scoring.SHORT < len(vocab.words) <= 1500 < vocab.types and vocab.rest_tokens.sum() > 0
    words = len(vocab.words)
    for two, one in ((0, 1), (scoring.STOP, scoring.STOP), (17, 200)):
        total = 0.0
        unit = np.append(vocab.units, scoring.STOP)  # every frequent word and the end
        target = np.append(vocab.targets(np.arange(words), vocab.units), -1)
        total += (10 ** model.log10(np.full(words + 1, two), np.full(words + 1, one), unit, target)).sum()
        kinds = np.arange(scoring.CLASSES)  # what each class leaves to its other words
        total += (10 ** model.log10(np.full(len(kinds), two), np.full(len(kinds), one), scoring.SHORT + kinds, words + kinds)).sum()
        assert total == pytest.approx(1, abs=1e-4)
    for kind in range(scoring.CLASSES):  # shared among them and one unseen word
        rest = [n for w, n in counts.items() if w != b"\n" and w not in vocab.places and scoring.class_of(w) == scoring.SHORT + kind]
        assert sum(rest) == vocab.rest_tokens[kind] and len(rest) == vocab.rest_types[kind]
        assert sum(n + 1 for n in rest) + 1 == vocab.rest_tokens[kind] + vocab.rest_types[kind] + 1


def test_lm_scores_match_plain_sums(language_model):
    rows, vocab, model, counts, scored = language_model
    got = {r.doc_id: r for r in scored}

    def log10_softmax(values, at):
        return (values[at] - max(values) - np.log(sum(np.exp(v - max(values)) for v in values))) / np.log(10)

    for d, text in rows[::9]:
        before, total = [scoring.STOP, scoring.STOP], 0.0
        for w in [*words(text), None]:
            place = vocab.places[w] if w is not None else -2
            unit = scoring.STOP if w is None else place if 0 <= place < scoring.SHORT else scoring.class_of(w)
            i, j = before[-2:]
            total += log10_softmax([float(model.far[i, k] + model.near[j, k]) for k in range(scoring.UNITS)], unit)
            if scoring.SHORT <= unit < scoring.STOP:
                kind = unit - scoring.SHORT
                targets = [*vocab.members(kind).tolist(), len(vocab.words) + kind]
                own = place if place >= 0 else len(vocab.words) + kind
                total += log10_softmax([float(model.before[kind, scoring.BEFORE[j]] @ model.target[x] + model.bias[x]) for x in targets], targets.index(own))
                if place < 0:
                    total += np.log10((counts.get(w, 0) + 1) / (vocab.rest_tokens[kind] + vocab.rest_types[kind] + 1))
            before.append(unit)
        assert got[d].score == pytest.approx(total, abs=1e-3 * max(1, got[d].n_tokens))


def test_lm_tells_what_words_follow(language_model):
    scored = language_model[-1]
    held = [r for r in scored if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.1


def test_lm_of_nothing(empty, spark):
    assert scoring.lm_scores(empty).count() == 0
    one = scoring.lm_scores(spark.createDataFrame([(i, None) for i in range(3)], "doc_id long, text string")).collect()
    assert [r.n_tokens for r in one] == [1, 1, 1]
