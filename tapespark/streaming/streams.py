"""Structured Streaming: bars under a watermark, books and rate control as keyed state, resumable runs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows count as settled once so much time has passed after them.
SETTLE = "2 seconds"


def source(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table (a file, or the files of a folder) as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes all there is, into Parquet at path; a later call with the same checkpoint goes on from there."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def record(stream: DataFrame, path: str, checkpoint: str, keys: list[str], rows: int = 50_000, seconds: float | None = None):
    """A running query that appends a stream to one folder per key: at most rows a file, a flush every so many seconds.

    Without seconds it takes what there is and ends. Files appear whole or not at all, and a query that is
    started again with the same checkpoint goes on after the last flush that it committed.
    """
    writer = stream.writeStream.format("parquet").partitionBy(*keys).option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows).option("compression", "zstd")
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def bars(ticks: DataFrame, width: str, price: str, order: list[str], settle: str = SETTLE) -> DataFrame:
    """Bars per series and window of event time, emitted once the watermark has passed their end."""
    first, last = F.min_by(price, F.struct(*order)), F.max_by(price, F.struct(*order))
    out = ticks.withWatermark("at", settle).groupBy("series", F.window("at", width).alias("w"))
    out = out.agg(first.alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), last.alias("close"), F.count("*").alias("ticks"))
    return out.select("series", F.unix_micros("w.start").alias("bar"), "open", "high", "low", "close", "ticks")


def once(rows: DataFrame, keys: list[str], settle: str = SETTLE) -> DataFrame:
    """The first row of each key within the settling time."""
    return rows.withWatermark("at", settle).dropDuplicatesWithinWatermark(keys)


BBO = "series long, ts long, seq long, epoch long, bid long, ask long"


def book(rows: DataFrame) -> DataFrame:
    """The best bid and ask after every row (series, ts, seq, side, price, quantity, is_snapshot), in order of ts and seq.

    The state of a series is its book: snapshots clear it, no quantity deletes a level.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, text = state.get if state.exists else (0, "[[], []]")
        sides = [{int(p): int(q) for p, q in side} for side in json.loads(text)]
        pdf = pd.concat(list(parts)).sort_values(["ts", "seq"])
        out = []
        for r in pdf.itertuples(index=False):
            if r.is_snapshot:
                sides, epoch = [{}, {}], epoch + 1
            elif isinstance(r.side, str) and r.side in ("bid", "ask") and not pd.isna(r.price):
                levels = sides[r.side == "ask"]
                if r.quantity > 0:
                    levels[int(r.price)] = int(r.quantity)
                else:
                    levels.pop(int(r.price), None)
            bid, ask = max(sides[0], default=None), min(sides[1], default=None)
            ok = epoch > 0 and bid is not None and ask is not None and bid < ask
            out.append((key[0], r.ts, r.seq, epoch, bid if ok else None, ask if ok else None))
        state.update((epoch, json.dumps([list(s.items()) for s in sides])))
        frame = pd.DataFrame(out, columns=["series", "ts", "seq", "epoch", "bid", "ask"])
        yield frame.astype({"bid": "Int64", "ask": "Int64"})

    return rows.groupBy("series").applyInPandasWithState(step, BBO, "epoch long, levels string", "append", GroupStateTimeout.NoTimeout)


RATE = "series long, at_us long, cutoff double, qualified boolean, accepted boolean"


def rate(rows: DataFrame, quantile: float, cap: int, fallback: float, history: int = 2000, least: int = 100) -> DataFrame:
    """The rate controller as keyed state: rows (series, at_us, day, score) in order of at_us."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, day, taken = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], -1, 0)
        out = []
        for r in pd.concat(list(parts)).sort_values("at_us").itertuples(index=False):
            if r.day != day:
                day, taken = int(r.day), 0
            cutoff = float(np.quantile(past, quantile)) if len(past) >= least else fallback
            qualified = bool(r.score >= cutoff)
            accepted = qualified and taken < cap
            taken += accepted
            past = [*past, float(r.score)][-history:]
            out.append((key[0], r.at_us, cutoff, qualified, accepted))
        state.update((past, day, taken))
        yield pd.DataFrame(out, columns=["series", "at_us", "cutoff", "qualified", "accepted"])

    return rows.groupBy("series").applyInPandasWithState(step, RATE, "past array<double>, day long, taken long", "append", GroupStateTimeout.NoTimeout)


def recurrent(rows: DataFrame, features: list[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """Probabilities of a recurrent policy row by row: rows (series, event, at_us, features) in order of at_us.

    The state of a series is its event and the cell; a new event starts from zero, and the next micro-batch
    goes on where the last one ended.
    """
    from ..operators.models import lstm

    n = weights["u"].shape[1]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        event, h, c = state.get if state.exists else (-1, [0.0] * n, [0.0] * n)
        out = []
        for r in pd.concat(list(parts)).sort_values("at_us").itertuples(index=False):
            if r.event != event:
                event, h, c = int(r.event), [0.0] * n, [0.0] * n
            y, (h, c) = lstm(np.array([[float(getattr(r, f)) for f in features]]), weights, (np.array(h), np.array(c)))
            out.append((key[0], event, r.at_us, float(1 / (1 + np.exp(-y[0, 0])))))
        state.update((event, [float(v) for v in h], [float(v) for v in c]))
        yield pd.DataFrame(out, columns=["series", "event", "at_us", "probability"])

    return rows.groupBy("series").applyInPandasWithState(step, "series long, event long, at_us long, probability double", "event long, h array<double>, c array<double>", "append", GroupStateTimeout.NoTimeout)


class Health(StreamingQueryListener):
    """Rows and rows a second of each query's last progress, starts and failures."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.rate: dict[str, float] = {}
        self.starts = self.failures = 0

    def onQueryStarted(self, event) -> None:
        self.starts += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows
        self.rate[str(p.id)] = p.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.failures += event.exception is not None
