"""Views of the sample tables in the engine's terms, in Spark and in DuckDB SQL, and the list of queries.

Prices are whole cents and times whole microseconds, so that sums are exact and both engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B

HOUR = 3_600_000_000
DAY = 24 * HOUR
SECOND = 1_000_000
CARRY = 2
VENUES = 9


class Plans:
    """Queries of one module and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            key = name or f.__name__
            self.QUERIES[key] = f
            if sql is not None:
                self.SQL[key] = sql
            return f

        return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.rint(x * 100).cast("long")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """events: one price tick per row of nine series."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), micros(F.col("ts")).alias("ts"), F.pmod("user_id", F.lit(VENUES)).alias("series"), cents(F.col("value")).alias("px"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")


TICK = f"""tick AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts, user_id % {VENUES} AS series, CAST(round_even(value * 100, 0) AS BIGINT) AS px,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events)"""


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """ticks with a bid and ask around the price, in cents."""
    half = 5 + F.pmod("k", F.lit(5))
    return ticks(spark, sf).withColumns({"bid": F.col("px") - half, "ask": F.col("px") + half})


QUOTE = TICK + """, quote AS (SELECT *, px - (5 + k % 5) AS bid, px + (5 + k % 5) AS ask FROM tick)"""


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars of each series from quotes, regular and in segments; weight is k, 0 on carried rows."""
    raw = B.ohlc(quotes(spark, sf), ["series"], "ts", HOUR, "px", ["ts", "seq"], carry=("bid", "ask"), totals=("k",))
    out = B.regular(raw, ["series"], HOUR, CARRY, part=28 * DAY)
    return out.withColumn("weight", F.when(F.col("observed"), F.col("k")).otherwise(F.lit(0).cast("long"))).drop("k")


BARS = QUOTE + f""", raw AS (
  SELECT series, ts // {HOUR} * {HOUR} AS bar, arg_min(px, seq) AS open, max(px) AS high, min(px) AS low, arg_max(px, seq) AS close,
         arg_min(bid, seq) AS first_bid, arg_min(ask, seq) AS first_ask, arg_max(bid, seq) AS last_bid, arg_max(ask, seq) AS last_ask,
         count(*) AS ticks, max(ts) AS last_ts, CAST(sum(k) AS BIGINT) AS k FROM quote GROUP BY ALL),
stepped AS (
  SELECT *, (lead(bar) OVER w - bar) // {HOUR} AS ahead, (bar - lag(bar) OVER w) // {HOUR} AS back FROM raw
  WINDOW w AS (PARTITION BY series ORDER BY bar)),
cut AS (
  SELECT *, CAST(sum(CASE WHEN back > {CARRY} + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY bar) AS BIGINT) AS segment_id,
         CASE WHEN ahead IS NULL THEN 0 ELSE least(ahead - 1, {CARRY}) END AS more FROM stepped),
bars AS (
  SELECT series, bar + i * {HOUR} AS bar, segment_id, i = 0 AS observed, CAST(i AS BIGINT) AS gap_rows,
         CASE WHEN i > 0 THEN close ELSE open END AS open, CASE WHEN i > 0 THEN close ELSE high END AS high,
         CASE WHEN i > 0 THEN close ELSE low END AS low, close,
         CASE WHEN i > 0 THEN last_bid ELSE first_bid END AS first_bid, CASE WHEN i > 0 THEN last_ask ELSE first_ask END AS first_ask,
         last_bid, last_ask, CASE WHEN i > 0 THEN 0 ELSE ticks END AS ticks, last_ts,
         CASE WHEN i > 0 THEN greatest(bar + i * {HOUR} - last_ts, 0) / 1000.0::DOUBLE ELSE 0.0 END AS age_ms,
         CASE WHEN i > 0 THEN 0 ELSE k END AS weight
  FROM cut, LATERAL (SELECT unnest(range(0, more + 1)) AS i))"""


def average_sql(value: str, weight: str, window: int | None, by: str = "series, segment_id", order: str = "bar") -> str:
    """The weighted average as a plain sliding frame."""
    frame = "UNBOUNDED PRECEDING" if window is None else f"{window - 1} PRECEDING"
    over = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {frame} AND CURRENT ROW)"
    return f"CASE WHEN sum({weight}) {over} > 0 THEN CAST(sum({value} * {weight}) {over} AS DOUBLE) / CAST(sum({weight}) {over} AS DOUBLE) ELSE CAST({value} AS DOUBLE) END"


def whole(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def r6(x: Column, name: str, digits: int = 6) -> Column:
    return F.round(x, digits).cast("double").alias(name)


SEG = ["series", "segment_id"]


def averaged(spark: SparkSession, sf: str, *horizons: int) -> DataFrame:
    """bars with mid (half cents) and its weighted averages."""
    rows = bars(spark, sf).withColumn("mid", F.col("last_bid") + F.col("last_ask"))
    return B.averages(rows, SEG, ["bar"], "mid", "weight", horizons)


def averaged_sql(*horizons: int) -> str:
    cols = ", ".join(f"{average_sql('mid', 'weight', h)} AS avg_{h}" for h in horizons)
    return BARS + f""", mids AS (SELECT *, last_bid + last_ask AS mid FROM bars),
averaged AS (SELECT *, {cols} FROM mids)"""
