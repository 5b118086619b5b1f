"""Sources and sinks on the sample tables: venue messages, record logs, catalogues, candles, archives."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import book as K
from ..schema import RECORD
from ..sources import feeds, files, recordlog
from .base import DAY, HOUR, TICK, Plans, cents, micros, r6, table, ticks

P = Plans()
QUERIES, SQL = P.QUERIES, P.SQL


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the place that all executors share; a session on one machine may name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or f'file:///tmp/checkpoints/{spark.sparkContext.applicationId}').rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def messages(spark: SparkSession, sf: str, body) -> DataFrame:
    return ticks(spark, sf).select((F.col("ts") * 1000).alias("local_ts_ns"), F.col("seq").alias("message_id"), F.to_json(body).alias("raw"))


def s(x, name: str):
    return x.cast("string").alias(name)


@P.add(f"""WITH {TICK}, l AS (SELECT seq, ts, 0 AS row_idx, 'bid' AS side, px / 100.0::DOUBLE AS price, k AS q FROM tick UNION ALL SELECT seq, ts, 1, 'ask', (px + 1) / 100.0::DOUBLE, 99 - k FROM tick)
SELECT seq * 65536 AS event_id, CAST(row_idx AS INTEGER) AS row_idx, ts * 1000 AS local_ts_ns, ts // 1000 * 1000000 AS exchange_ts_ns, CAST(seq + 1 AS VARCHAR) AS sequence, CAST(seq - 1 AS VARCHAR) AS prev_sequence, side, price, CAST(q AS DOUBLE) AS quantity, CASE WHEN q = 0 THEN 'delete' ELSE 'set' END AS action, 'BTCUSDT' AS symbol FROM l""")
def normalise_binance(spark: SparkSession, sf: str) -> DataFrame:
    """Depth updates: bids first, no quantity deletes."""
    c = F.col
    level = lambda p, q: F.array(F.array((p / 100.0).cast("string"), q.cast("string")))
    data = F.struct(F.lit("depthUpdate").alias("e"), F.lit("BTCUSDT").alias("s"), F.floor(c("ts") / 1000).alias("E"), c("seq").alias("U"), (c("seq") + 1).alias("u"), (c("seq") - 1).alias("pu"), level(c("px"), c("k")).alias("b"), level(c("px") + 1, 99 - c("k")).alias("a"))
    out = feeds.normalise(messages(spark, sf, F.struct(data.alias("data"))), "binance_perpetual", "depth", "X")
    return out.select("event_id", "row_idx", "local_ts_ns", "exchange_ts_ns", "sequence", "prev_sequence", "side", "price", "quantity", "action", "symbol")


@P.add(f"""WITH {TICK} SELECT seq * 65536 AS event_id, CAST(px / 100.0 AS DOUBLE) AS price, CAST(k AS DOUBLE) AS quantity, CASE WHEN k % 2 = 0 THEN 'sell' ELSE 'buy' END AS taker_side, CASE WHEN k % 2 = 0 THEN 'long' ELSE 'short' END AS liquidation_side, ts // 1000 * 1000000 AS engine_ts_ns FROM tick""")
def normalise_liquidations(spark: SparkSession, sf: str) -> DataFrame:
    """A venue that names the liquidated position: buy means a long was liquidated by a sale."""
    c = F.col
    item = F.struct(F.floor(c("ts") / 1000).alias("T"), F.when(F.pmod("k", F.lit(2)) == 0, "Buy").otherwise("Sell").alias("S"), s(c("px") / 100.0, "p"), s(c("k"), "v"))
    out = feeds.normalise(messages(spark, sf, F.struct(F.lit("allLiquidation.BTCUSDT").alias("topic"), F.floor(c("ts") / 1000).alias("ts"), F.array(item).alias("data"))), "bybit_perpetual", "allLiquidation", "BTCUSDT")
    return out.select("event_id", "price", "quantity", "taker_side", "liquidation_side", "engine_ts_ns")


@P.add(f"""WITH {TICK} SELECT seq * 65536 AS event_id, 0 AS row_idx, CASE WHEN k % 3 = 0 THEN 'ask' ELSE 'bid' END AS side, CAST(px / 100.0 AS DOUBLE) AS price, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 + k END::DOUBLE AS quantity, CASE WHEN k % 5 = 0 THEN 'delete' ELSE 'set' END AS action, CAST(k % 5 AS DOUBLE) AS order_count FROM tick""")
def normalise_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """A venue of bare arrays: the sign is the side, no orders delete."""
    c = F.col
    raw = F.concat(F.lit("[17,["), (c("px") / 100.0).cast("string"), F.lit(","), F.pmod("k", F.lit(5)).cast("string"), F.lit(","), (F.when(F.pmod("k", F.lit(3)) == 0, -1).otherwise(1) * (1 + c("k"))).cast("string"), F.lit("]]"))
    m = ticks(spark, sf).select((c("ts") * 1000).alias("local_ts_ns"), c("seq").alias("message_id"), raw.alias("raw"))
    return feeds.normalise(m, "bitfinex_spot", "book", "tBTCUSD").select("event_id", "row_idx", "side", "price", "quantity", "action", "order_count")


@P.add(f"""WITH {TICK}, d AS (SELECT series, seq, ts, k AS first, k + 2 AS last, k - 1 AS previous, k + 2 >= 40 AS live FROM tick), p AS (SELECT *, lag(CASE WHEN live THEN last END) OVER (PARTITION BY series ORDER BY ts) AS b FROM d)
SELECT series, seq, CASE WHEN NOT live THEN 'stale' WHEN b IS NULL THEN CASE WHEN first <= 40 THEN 'first' ELSE 'gap' END WHEN previous = b THEN 'next' ELSE 'gap' END AS state FROM p""")
def bridge_states(spark: SparkSession, sf: str) -> DataFrame:
    """Diffs after a snapshot: stale, first, next or gap."""
    rows = ticks(spark, sf).select("series", "seq", F.col("ts").alias("local_ts_ns"), F.col("k").alias("first"), (F.col("k") + 2).alias("last"), (F.col("k") - 1).alias("previous"), F.lit(40).alias("snapshot_id"))
    return feeds.bridged(rows, ["series"], spot=False).select("series", "seq", "state")


def records(spark: SparkSession, sf: str) -> DataFrame:
    have = {"exchange": F.lit("binance"), "market": F.lit("spot"), "symbol": F.lit("BTCUSDT"), "channel": F.lit("trades"), "event_type": F.lit("trade"), "event_id": F.col("seq"), "row_idx": F.lit(0), "local_ts_ns": F.col("ts") * 1000, "price": F.col("px") / 100.0, "quantity": F.col("k").cast("double")}
    return ticks(spark, sf).select(*[have.get(n, F.lit(None)).cast(k).alias(n) for n, k in (c.strip().split() for c in RECORD.split(","))])


@P.add(f"""WITH {TICK} SELECT seq AS event_id, ts * 1000 AS local_ts_ns, CAST(px / 100.0 AS DOUBLE) AS price, CAST(k AS DOUBLE) AS quantity FROM tick""")
def recordlog_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Records through the framed log's sink and source: only the four columns that are asked for are decoded."""
    spark.dataSource.register(recordlog.RecordLog)
    path = scratch(spark, "log")
    records(spark, sf).write.format("recordlog").mode("append").save(path)
    rows = spark.read.format("recordlog").option("columns", "event_id,local_ts_ns,price,quantity").option("after", 0).load(path)
    return recordlog.after(rows, 0)


@P.add(f"""WITH {TICK}, c AS (SELECT (min(ts) + max(ts)) // 2 AS cut FROM tick) SELECT seq, ts FROM tick, c WHERE ts > cut""")
def suffix_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Rows after a cut-off: the filter reaches the scan."""
    t = ticks(spark, sf)
    low, high = t.agg(F.min("ts"), F.max("ts")).first()
    return t.where(F.col("ts") > (low + high) // 2).select("seq", "ts")


STEMS = ("binance_um_futures_btcusdt_depth", "binance_um_futures_btcusdt_trades", "kraken_spot_btcusd_level3", "okx_swap_btc_usdt_swap_books", "x~syncthing~y")


@P.add(f"""WITH {TICK}, n AS (SELECT [{', '.join(repr(x) for x in STEMS)}][k % 5 + 1] AS stem, ts FROM tick), b AS (SELECT stem, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM n WHERE stem NOT LIKE '%~syncthing~%' GROUP BY stem)
SELECT stem, rows, first, last, CASE WHEN stem LIKE '%depth' OR stem LIKE '%books' THEN 'book' WHEN stem LIKE '%trades' THEN 'trade' ELSE 'l3' END AS kind, CASE WHEN stem LIKE 'binance%' THEN 'binance_perpetual' WHEN stem LIKE 'kraken%' THEN 'kraken_spot' ELSE 'okx_perpetual' END AS venue FROM b""")
def catalogue_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Streams told from file names, with rows and time bounds."""
    stem = F.element_at(F.array(*map(F.lit, STEMS)), (F.pmod("k", F.lit(5)) + 1).cast("int"))
    out = files.catalogue(ticks(spark, sf).select(stem.alias("stem"), "ts"), "stem", "ts")
    return out.select("stem", "rows", "first", "last", "kind", "venue")


@P.add(f"""WITH {TICK}, n AS (SELECT k % 4 AS stem, ts FROM tick), b AS (SELECT stem, min(ts) AS first, max(ts) AS last FROM n WHERE stem <> 1 GROUP BY stem) SELECT max(first) AS low, min(last) AS high FROM b""")
def common_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The time that all book streams cover."""
    stem = F.element_at(F.array(*map(F.lit, STEMS)), (F.pmod("k", F.lit(4)) + 1).cast("int"))
    return files.common_interval(files.catalogue(ticks(spark, sf).select(stem.alias("stem"), "ts"), "stem", "ts"))


@P.add("""WITH f AS (SELECT 'kraken_spot_btcusd_book_20240101_0000' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || CASE WHEN event_id % 2 = 0 THEN '_3' ELSE '' END AS stem FROM events WHERE user_id % 2 = 0 UNION ALL SELECT 'okx_swap_btc_usdt_swap_books' FROM events WHERE user_id % 2 = 1)
SELECT regexp_replace(stem, '_\\d{8}_\\d{6}(_\\d+)?$', '') AS name, count(DISTINCT stem) AS sources, count(*) AS rows FROM f GROUP BY 1""")
def compaction_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Rotated segments under their logical names."""
    e = table(spark, sf, "events")
    rotated = F.concat(F.lit("kraken_spot_btcusd_book_20240101_0000"), F.lpad(F.pmod("event_id", F.lit(60)).cast("string"), 2, "0"), F.when(F.pmod("event_id", F.lit(2)) == 0, "_3").otherwise(""))
    rows = e.select(F.when(F.pmod("user_id", F.lit(2)) == 0, rotated).otherwise("okx_swap_btc_usdt_swap_books").alias("stem"))
    return rows.groupBy(files.logical_name(F.col("stem")).alias("name")).agg(F.countDistinct("stem").alias("sources"), F.count("*").alias("rows"))


SEGMENTS = ("a_20240101_000000", "a_20240101_000100_2", "b_20240101_000000", "c")


def rename_parts(spark: SparkSession, folder: str, target: str) -> None:
    """Moves the one file of each folder name=<stem> to target/<stem>.parquet, on whatever file system they are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(target))
    for part in fs.listStatus(hadoop.Path(folder)):
        if (name := part.getPath().getName()).startswith("name="):
            for f in fs.listStatus(part.getPath()):
                if f.getPath().getName().endswith(".parquet"):
                    fs.rename(f.getPath(), hadoop.Path(f"{target}/{name.removeprefix('name=')}.parquet"))


@P.add(f"""WITH {TICK}, s AS (SELECT [{', '.join(map(repr, SEGMENTS))}][k % 4 + 1] AS stem FROM tick)
SELECT regexp_replace(stem, '_\\d{{8}}_\\d{{6}}(_\\d+)?$', '') AS name, count(DISTINCT stem) AS sources, count(*) AS rows FROM s GROUP BY 1""")
def compact_segments(spark: SparkSession, sf: str) -> DataFrame:
    """A real rewrite: rotated segments as one file per logical name, with checked counts."""
    stem = F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.pmod("k", F.lit(4)) + 1).cast("int"))
    parts, source = scratch(spark, "parts"), scratch(spark, "segments")
    ticks(spark, sf).withColumn("name", stem).repartition(4, "name").write.partitionBy("name").parquet(parts)
    rename_parts(spark, parts, source)
    return files.compact(spark, source, scratch(spark, "compacted"))


@P.add("""WITH o AS (SELECT o_orderdate AS ts, o_orderkey, o_totalprice AS p FROM orders),
c AS (SELECT ts, arg_min(p, o_orderkey) AS open, max(p) AS high, min(p) AS low, arg_max(p, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM o GROUP BY ts),
g AS (SELECT *, lag(close) OVER (ORDER BY ts) AS before FROM c)
SELECT epoch_us(ts) AS ts, round(coalesce(ln(close) - ln(before), 0) * 10000, 5) AS return_bps, round((ln(close) - ln(open)) * 10000, 5) AS body_bps, round(greatest(ln(high) - ln(low), 1e-9) * 10000, 5) AS range_bps, round((ln(high) - greatest(ln(open), ln(close))) / greatest(ln(high) - ln(low), 1e-9), 6) AS upper_fraction, round(ln(1 + volume), 6) AS log_volume FROM g""")
def candle_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Candles of the orders, read with the candle rules, and their log geometry."""
    o = table(spark, sf, "orders")
    raw = B.ohlc(o.select(micros(F.col("o_orderdate")).alias("ts"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("p"), F.lit("x").alias("all")), ["all"], "ts", 1, "p", ["key"])
    rows = files.candles(raw.select(F.timestamp_micros("bar").alias("timestamp"), "open", "high", "low", "close", F.col("ticks").cast("double").alias("volume")), least=100)
    out = B.candle_features(rows.where(B.sane_candle()), ["timestamp"])
    return out.select(F.unix_micros("timestamp").alias("ts"), *[r6(F.col(c), c, 5) for c in ("return_bps", "body_bps", "range_bps")], r6(F.col("upper_fraction"), "upper_fraction"), r6(F.col("log_volume"), "log_volume"))


@P.add("SELECT o_orderkey AS minute, round((o_custkey + o_orderkey % 7) / 100000.0, 5) AS open, round((o_custkey + 9) / 100000.0, 5) AS high, round(o_custkey / 100000.0, 5) AS low, round((o_custkey + o_orderkey % 5) / 100000.0, 5) AS close FROM orders")
def trendbar_decode(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("minute"), F.col("o_custkey").alias("low"), F.pmod("o_orderkey", F.lit(7)).alias("delta_open"), F.lit(9).alias("delta_high"), F.pmod("o_orderkey", F.lit(5)).alias("delta_close"), F.lit(1).alias("volume"))
    return files.trendbars(rows, 5).drop("volume")


@P.add(f"WITH {TICK} SELECT seq, ts, px FROM tick")
def zip_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Zipped CSV archives, one a day, written and read back."""
    t = ticks(spark, sf).withColumn("day", F.floor(F.col("ts") / DAY))

    def pack(rows: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            lines = ["seq,ts,px", *(f"{a},{b},{c}" for a, b, c in zip(*(rows.column(n).to_pylist() for n in ("seq", "ts", "px")), strict=True))]
            z.writestr("day.csv", "\n".join(lines))
        return pa.table({"content": pa.array([out.getvalue()], pa.binary())})

    packed = t.select("day", "seq", "ts", "px").groupBy("day").applyInArrow(pack, "content binary")
    return files.unzipped(packed, "seq bigint, ts bigint, px bigint")


@P.add(f"""WITH {TICK}, a AS (SELECT series, ts // {HOUR} AS t, seq, px, NULL::BIGINT AS extra FROM tick WHERE seq % 2 = 0 UNION ALL SELECT series, ts // {HOUR}, seq, px, k FROM tick WHERE seq % 2 = 1)
SELECT series, t, seq, px, extra FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY series, t ORDER BY seq DESC) = 1) WHERE px > 500""")
def recorded_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with differing columns as one table: the last row of each time, valid ones."""
    t = ticks(spark, sf).withColumn("t", F.floor(F.col("ts") / HOUR))
    odd = F.pmod("seq", F.lit(2)) == 1
    return files.recorded_parts([t.where(~odd).select("series", "t", "seq", "px"), t.where(odd).select("series", "t", "seq", "px", F.col("k").alias("extra"))], ["series", "t"], ["seq"], F.col("px") > 500)


@P.add("SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS cents FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns and a time bound: both reach the Parquet scan."""
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return li.select("l_orderkey", "l_linenumber", cents(F.col("l_extendedprice")).alias("cents"))


@P.add(f"WITH {TICK} SELECT seq, ts, series, px, k, event_type FROM tick")
def verified_artifact(spark: SparkSession, sf: str) -> DataFrame:
    """A table written with a manifest and read back against it."""
    path = scratch(spark, "artifact")
    files.save_with_manifest(ticks(spark, sf), path)
    return files.load_verified(spark, path)


@P.add(f"""WITH {TICK} SELECT series, ts, count(*) AS rows, bool_or(event_type = 'error') AS snapshot FROM tick GROUP BY ALL""")
def packetise(spark: SparkSession, sf: str) -> DataFrame:
    """Atomic packets of rows of one receive time and event."""
    rows = ticks(spark, sf).select("series", "ts", F.lit(0).alias("event_id"), F.col("seq").alias("row_idx"), F.lit("bid").alias("side"), F.col("px").alias("price"), F.col("k").alias("quantity"), F.lit("set").alias("action"), F.lit(False).alias("is_snapshot"), F.when(F.col("event_type") == "error", "snapshot").otherwise("update").alias("event_type"))
    return K.packets(rows, ["series"]).select("series", "ts", "rows", "snapshot")
