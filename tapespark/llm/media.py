"""Media columns: Matroska files as binary values, and packet tables from their EBML elements."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, table, text_or_empty, utf8, wider

# Element identifiers of the Matroska and EBML specifications.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXER, WRITER, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster or a segment of unknown size.
AFTER_CLUSTER = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}
AFTER_SEGMENT = {EBML, SEGMENT}
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3

#: Samples of a frame: 24 ms at 8000 a second. Frames of a laced block, blocks of a cluster.
FRAME, SAMPLE_RATE, LACED, BLOCKS = 192, 8000, 8, 32
FRAME_MS = FRAME * 1000 // SAMPLE_RATE
PACKET = "array<struct<track:int,cluster:int,timestamp_ms:bigint,offset:bigint,size:bigint,keyframe:boolean>>"


def size_bytes(n: int, least: int = 1) -> bytes:
    """A variable-length integer; all ones are kept for sizes that aren't known."""
    width = least
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The body of a block after its flags."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH_LACING:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING and len(frames) > 1:
        head += size_bytes(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            d, width = len(b) - len(a), 1
            while not -(1 << (7 * width - 1)) < d < 1 << (7 * width - 1):
                width += 1
            head += (d + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")
    return head + b"".join(frames)


def padded(raw: bytes, unit: int = FRAME) -> bytes:
    """Appends spaces up to a positive multiple of unit."""
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def write(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples: frames in fixed-size laces, clusters, and a cue for each cluster."""
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(MUXER, b"tapespark") + element(WRITER, b"tapespark"))
    audio = element(AUDIO, element(RATE, struct.pack(">f", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    parts = [info, element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + audio))]
    at, cues, block = sum(map(len, parts)), [], FRAME * LACED
    for start in range(0, len(payload), block * BLOCKS):
        time = start // FRAME * FRAME_MS
        body = [number(CLUSTER_TIME, time)]
        for k in range(start, min(start + block * BLOCKS, len(payload)), block):
            data = payload[k : k + block]
            many = len(data) > FRAME
            lead = b"\x81" + struct.pack(">h", (k - start) // FRAME * FRAME_MS) + bytes([0x80 | (FIXED_LACING << 1 if many else 0)])
            body.append(element(SIMPLE_BLOCK, lead + (bytes([len(data) // FRAME - 1]) if many else b"") + data))
        parts.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


@dataclass
class Media:
    """What a file holds: its tracks by number, packets (track, cluster, ms, offset, size, keyframe), cues (ms, track, cluster offset)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)  # where their elements begin; cues point there


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """Value (with its marker if keep), width and the next position."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    return (n if keep else n & (1 << 7 * width) - 1), width, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, start, end) of the bodies. A size that isn't known reaches to the end of the parent, or of a
    cluster or segment to the first element that cannot be in it."""
    while at < end:
        ident, _, at = vint(data, at, keep=True)
        n, width, at = vint(data, at)
        stop = at + n
        if n == (1 << 7 * width) - 1:
            stop = _first_of(data, at, end, AFTER_CLUSTER if ident == CLUSTER else AFTER_SEGMENT) if ident in (CLUSTER, SEGMENT) else end
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} ends outside its parent")
        yield ident, at, stop
        at = stop


def _first_of(data: bytes, at: int, end: int, kinds: set[int]) -> int:
    """Where the first element of these kinds begins among the elements from at on; end without one."""
    while at < end:
        ident, _, body = vint(data, at, keep=True)
        if ident in kinds:
            return at
        n, width, body = vint(data, body)
        at = body + n if n != (1 << 7 * width) - 1 else _first_of(data, body, end, AFTER_CLUSTER) if ident == CLUSTER else end
    return end


def _unlace(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == FIXED_LACING:
        each, odd = divmod(end - at, count)
        if odd:
            raise ValueError("fixed-size laces of uneven size")
        return [(at + i * each, each) for i in range(count)]
    if lacing == XIPH_LACING:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif count > 1:
        n, _, at = vint(data, at)
        sizes.append(n)
        for _ in range(count - 2):
            d, width, at = vint(data, at)
            sizes.append(sizes[-1] + d - (1 << 7 * width - 1) + 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laces longer than their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def read(data: bytes) -> Media:
    """Parses a file; raises ValueError where it is damaged."""
    out, whole = Media(), lambda a, b: int.from_bytes(data[a:b], "big")
    found = [x for x in elements(data, 0, len(data))]
    if not found or found[0][0] != EBML:
        raise ValueError("no EBML header")
    for ident, a, b in elements(data, *found[0][1:]):
        if ident == DOC_TYPE:
            out.doc_type = data[a:b].decode()
    for segment in (x for x in found if x[0] == SEGMENT):
        head = segment[1]
        for ident, a, b in elements(data, *segment[1:]):
            if ident == INFO:
                for k, c, d in elements(data, a, b):
                    if k == TIMESTAMP_SCALE:
                        out.scale = whole(c, d)
                    elif k == DURATION:
                        out.duration = struct.unpack(">d" if d - c == 8 else ">f", data[c:d])[0]
            elif ident == TRACKS:
                for _, c, d in (x for x in elements(data, a, b) if x[0] == TRACK):
                    track = {k: (e, f) for k, e, f in elements(data, c, d)}
                    sound = {k: (e, f) for k, e, f in elements(data, *track[AUDIO])} if AUDIO in track else {}
                    out.tracks[whole(*track[TRACK_NUMBER])] = {"type": whole(*track[TRACK_TYPE]), "codec": data[slice(*track[CODEC])].decode(), "depth": whole(*sound[DEPTH]) if DEPTH in sound else None, "frame_ns": whole(*track[DEFAULT_DURATION]) if DEFAULT_DURATION in track else None}
            elif ident == CLUSTER:
                _cluster(data, a, b, out)
                out.clusters.append(head)
            elif ident == CUES:
                for _, c, d in (x for x in elements(data, a, b) if x[0] == CUE_POINT):
                    point = {k: (e, f) for k, e, f in elements(data, c, d)}
                    place = {k: (e, f) for k, e, f in elements(data, *point[CUE_POSITIONS])}
                    out.cues.append((whole(*point[CUE_TIME]), whole(*place[CUE_TRACK]), segment[1] + whole(*place[CUE_CLUSTER])))
            head = b
    return out


def _cluster(data: bytes, a: int, b: int, out: Media) -> None:
    """Adds a cluster's packets. A laced frame begins one frame's length after the one before: the block's duration shared out, else its track's default; without either all begin with the block."""
    time, blocks = 0, []
    for ident, c, d in elements(data, a, b):
        if ident == CLUSTER_TIME:
            time = int.from_bytes(data[c:d], "big")
        elif ident == SIMPLE_BLOCK:
            blocks.append((c, d, None, None))
        elif ident == BLOCK_GROUP:
            group = {k: (e, f) for k, e, f in elements(data, c, d)}
            lasts = int.from_bytes(data[slice(*group[BLOCK_DURATION])], "big") if BLOCK_DURATION in group else None
            blocks.append((*group[BLOCK], lasts, REFERENCE_BLOCK not in group))
    for c, d, lasts, key in blocks:
        track, _, at = vint(data, c)
        if at + 3 > d:
            raise ValueError(f"block at byte {c} is cut off")
        offset, flags = struct.unpack(">h", data[at : at + 2])[0], data[at + 2]
        frames = _unlace(data, at + 3, d, flags >> 1 & 3)
        step = out.tracks.get(track, {}).get("frame_ns") or 0 if lasts is None else lasts * out.scale / len(frames)
        for i, (start, n) in enumerate(frames):
            ms = round(((time + offset) * out.scale + i * step) / 1_000_000)
            out.packets.append((track, len(out.clusters), ms, start, n, bool(flags & 0x80) if key is None else key))


def encoded(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds a binary column with each row's text as a file (null as empty, which is one frame of spaces); one of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            files = pa.array([write(padded(x)) for x in utf8(batch.column(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, files], names=[*batch.schema.names, media])

    df = df.drop(media)
    return df.mapInArrow(run, wider(df, **{media: "binary"}))


def packets(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds packets (track, cluster, timestamp, byte range, keyframe) and error (null unless the file is damaged or null); columns of these names are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("track", "cluster", "timestamp_ms", "offset", "size", "keyframe")
        for batch in pieces(batches, media):
            found, errors = [], []
            for data in batch.column(media).to_pylist():
                try:
                    found.append([dict(zip(names, p, strict=True)) for p in read(data or b"").packets])
                    errors.append(None)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    found.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            kind = pa.list_(pa.struct([("track", pa.int32()), ("cluster", pa.int32()), ("timestamp_ms", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(errors, pa.string())], names=[*batch.schema.names, "packets", "error"])

    df = df.drop("packets", "error")
    return df.mapInArrow(run, wider(df, packets=PACKET, error="string"))


def digest(raw: bytes) -> tuple:
    """Stores a text's bytes, reads them back, and tells what was read."""
    stored = write(padded(raw))
    found = read(stored)
    payload = b"".join([stored[at : at + n] for _, _, _, at, n, _ in found.packets])
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    starts = set(found.clusters)
    cued = sum(place in starts for _, _, place in found.cues)
    feature = f"packets={len(found.packets)};clusters={len(found.clusters)};cues={cued};last_ms={found.packets[-1][2]};sum={samples.sum()};energy={(samples * samples).sum()};turns={int((np.diff((samples > 127).astype(np.int8)) != 0).sum())}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def digests(df: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): sizes and digests of what is read back from the stored file.

    Null and empty texts are one frame of spaces; a null doc_id stays null; repeated rows give a row each; an
    empty table gives none. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            raw = utf8(batch.column("text"))
            rows = list(zip(*map(digest, raw), strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), *[pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.mapInArrow(run, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text")))
