"""The framed record log: Spark source and sink, append, check, repair, verified copies."""

from __future__ import annotations

import glob
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..schema import RECORD

# Marks and layouts of the log format.
FILE_MARK, FRAME_MARK, END_MARK = b"MRLOG001", b"MRF1", b"MRE1"
HEADER, TRAILER = struct.Struct("<4sQQI"), struct.Struct("<4sQI")
DICTIONARY = ["exchange", "market", "symbol", "channel", "event_type", "side", "action", "taker_side"]
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
SCHEMA = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in (x.strip() for x in RECORD.split(","))])


class Damaged(ValueError):
    """A log that doesn't hold what it says."""


@dataclass(frozen=True)
class Frame:
    path: str
    offset: int
    size: int
    rows: int
    crc: int

    @property
    def end(self) -> int:
        return self.offset + self.size + TRAILER.size


def walk(path: str) -> Iterator[Frame]:
    """The committed frames of a file, one after the other; what ends them is returned as (where, why)."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        if f.read(len(FILE_MARK)) != FILE_MARK:
            if size >= len(FILE_MARK):
                raise Damaged(f"{path}: not a record log")
            return 0, "no header"
        at = len(FILE_MARK)
        while at < size:
            f.seek(at)
            head = f.read(HEADER.size)
            if len(head) < HEADER.size:
                return at, "cut off in a frame's header"
            mark, n, rows, crc = HEADER.unpack(head)
            frame = Frame(path, at + HEADER.size, n, rows, crc)
            if mark != FRAME_MARK or frame.end > size:
                return at, "cut off in a frame" if mark == FRAME_MARK else "no frame"
            f.seek(frame.offset + n)
            if TRAILER.unpack(f.read(TRAILER.size)) != (END_MARK, n, crc):
                return at, "a frame that wasn't committed"
            yield frame
            at = frame.end
    return at, ""


def frames(path: str) -> tuple[list[Frame], int, str]:
    """The committed frames of a file, where they end, and why the rest doesn't count (empty if there is none)."""
    found, steps = [], walk(path)
    while True:
        try:
            found.append(next(steps))
        except StopIteration as end:
            return found, *end.value


def payload(frame: Frame) -> bytes:
    with open(frame.path, "rb") as f:
        f.seek(frame.offset)
        return f.read(frame.size)


def latest(frame: Frame) -> int:
    """The last receive time of a frame, from the statistics in its Parquet footer; without them beyond any."""
    told = pq.ParquetFile(pa.BufferReader(payload(frame))).metadata
    place = SCHEMA.get_field_index("local_ts_ns")
    stats = [told.row_group(g).column(place).statistics for g in range(told.num_row_groups)]
    return max((x.max for x in stats if x is not None and x.has_min_max), default=1 << 63) if all(x is not None and x.has_min_max for x in stats) else 1 << 63


def bounds(paths: list[str]) -> list[tuple[str, int, int, int]]:
    """(path, rows, first, last receive time) of logs: the first frame's least and the last frame's largest time; the frames between aren't decoded."""
    out = []
    for path in paths:
        found, _, _ = frames(path)
        times = [load(f, ["local_ts_ns"]).column(0) for f in (found[:1] + found[-1:])]
        seen = [pa.compute.min_max(t).as_py() for t in times if len(t)]
        if seen:
            out.append((path, sum(f.rows for f in found), seen[0]["min"], seen[-1]["max"]))
    return out


def load(frame: Frame, columns: list[str] | None = None) -> pa.Table:
    """A frame's rows; raises Damaged if its bytes or number of rows aren't those it was written with."""
    data = payload(frame)
    if zlib.crc32(data) != frame.crc:
        raise Damaged(f"{frame.path}: wrong checksum at byte {frame.offset}")
    table = pq.read_table(pa.BufferReader(data), columns=columns)
    if table.num_rows != frame.rows:
        raise Damaged(f"{frame.path}: wrong number of rows at byte {frame.offset}")
    return table


def check(path: str, repair: bool = False, payloads: bool = False) -> tuple[int, int, int]:
    """(frames, rows, bytes cut off). An uncommitted tail raises Damaged, or is cut off with repair."""
    found, end, why = frames(path)
    if why and not repair:
        raise Damaged(f"{path}: {why} at byte {end}")
    lost = os.path.getsize(path) - end
    if why:
        with open(path, "r+b") as f:
            f.truncate(end)
            if not end:
                f.write(FILE_MARK)
    if payloads:
        for frame in found:
            if not load(frame).schema.equals(SCHEMA, check_metadata=False):
                raise Damaged(f"{path}: another schema at byte {frame.offset}")
    return len(found), sum(f.rows for f in found), lost if why else 0


def encode(table: pa.Table) -> bytes:
    """A table as one frame."""
    out = pa.BufferOutputStream()
    pq.write_table(table.cast(SCHEMA), out, compression="zstd", use_dictionary=DICTIONARY)
    payload = out.getvalue().to_pybytes()
    crc = zlib.crc32(payload)
    return HEADER.pack(FRAME_MARK, len(payload), table.num_rows, crc) + payload + TRAILER.pack(END_MARK, len(payload), crc)


def append(path: str, table: pa.Table) -> int:
    """Adds a frame; what was written goes again if the write fails. Returns the bytes added."""
    new = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "ab") as f:
        start = f.tell()
        try:
            return f.write((FILE_MARK if new else b"") + encode(table))
        except Exception:
            f.truncate(start)
            raise


def copy_committed(source: str, target: str) -> tuple[int, int]:
    """Copies the committed part of a log beside the target, checks it, and puts it in place. Returns frames and rows."""
    found, end, _ = frames(source)
    part = f"{target}.{uuid.uuid4().hex}.part"
    with open(source, "rb") as a, open(part, "wb") as b:
        left = end
        while left and (chunk := a.read(min(left, 1 << 20))):
            b.write(chunk)
            left -= len(chunk)
    n, rows, _ = check(part, payloads=True)
    if (n, rows) != (len(found), sum(f.rows for f in found)):
        os.unlink(part)
        raise Damaged(f"{source}: the copy doesn't hold what was committed")
    os.replace(part, target)
    return n, rows


#: Bytes of a log that one task reads; frames belong to the stretch in which they begin.
STRETCH = 64 << 20


@dataclass
class Stretch(InputPartition):
    """Frames of a file that begin at start or later and before end."""

    path: str
    start: int
    end: int


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(glob.glob(os.path.join(path, "*.mrec"))) if os.path.isdir(path) else [path]


def _bytes(path: str) -> int:
    return os.path.getsize(path)


def stretch_frames(part: Stretch) -> Iterator[Frame]:
    """The frames of a stretch: the headers are walked by the task, from the file's start, and no payload before the stretch is read."""
    for frame in walk(part.path):
        at = frame.offset - HEADER.size
        if at >= part.end:
            return
        if at >= part.start:
            yield frame


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], after: int | None) -> None:
        self.path, self.columns, self.after = path, columns, after

    def partitions(self) -> list[InputPartition]:
        """Stretches of the files: the driver lists files and sizes only."""
        return [Stretch(p, k, k + STRETCH) for p in _files(self.path) for k in range(0, max(_bytes(p), 1), STRETCH)] or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([SCHEMA.field(c) for c in self.columns])
        if partition.path:
            for frame in stretch_frames(partition):
                if self.after is None or latest(frame) > self.after:
                    yield from load(frame, self.columns).select(self.columns).cast(schema).to_batches()


class _StreamReader(DataSourceStreamReader):
    """Offsets are the committed ends of the files; frames before the start were read."""

    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: frames(p)[1] for p in _files(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first = lambda p: max(start.get(p, 0), len(FILE_MARK))
        return [Stretch(p, k, min(k + STRETCH, stop)) for p, stop in sorted(end.items()) for k in range(first(p), stop, STRETCH)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([SCHEMA.field(c) for c in self.columns])
        for frame in stretch_frames(partition):
            yield from load(frame, self.columns).select(self.columns).cast(schema).to_batches()


@dataclass
class _Written(WriterCommitMessage):
    part: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Each task writes a file of its own under a name that readers skip; the commit puts all in place."""

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        part, rows = os.path.join(self.path, f"{uuid.uuid4().hex}.part"), 0
        for batch in batches:
            if batch.num_rows:
                append(part, pa.Table.from_batches([batch]).select(SCHEMA.names))
                rows += batch.num_rows
        return _Written(part if rows else "", rows)

    def commit(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and m.part:
                os.replace(m.part, m.part.removesuffix(".part") + ".mrec")

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and m.part and os.path.exists(m.part):
                os.unlink(m.part)


class RecordLog(DataSource):
    """spark.read.format("recordlog").load(path), .readStream and .write, after spark.dataSource.register(RecordLog).

    The path is a file or a folder of .mrec files on a file system that all executors mount. A task reads a
    stretch of a file and walks its frames itself, so one long file is read in parallel. The option columns (names,
    comma-separated) prunes what is decoded, and after (nanoseconds) leaves out frames received until then.
    """

    @classmethod
    def name(cls) -> str:
        return "recordlog"

    def columns(self) -> list[str]:
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or SCHEMA.names
        if unknown := sorted(set(names) - set(SCHEMA.names)):
            raise ValueError(f"a record has no {', '.join(unknown)}")
        return names

    def schema(self) -> str:
        kinds = dict(c.strip().split() for c in RECORD.split(","))
        return ", ".join(f"{c} {kinds[c]}" for c in self.columns())

    def reader(self, schema) -> DataSourceReader:
        after = self.options.get("after")
        return _Reader(self.options["path"], self.columns(), None if after is None else int(after))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self.columns())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def after(rows: DataFrame, cutoff: int) -> DataFrame:
    """The rows received after a time: what an extension of a log adds to what was processed."""
    return rows.where(F.col("local_ts_ns") > cutoff)
