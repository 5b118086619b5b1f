"""Bars, gap segments, rolling contracts, as-of state and alignment on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bars as B
from ..operators import excursions as X
from ..operators import temporal as T
from .base import BARS, DAY, HOUR, QUOTE, SEG, TICK, Plans, average_sql, averaged, averaged_sql, bars, quotes, r6, ticks, whole

P = Plans()
QUERIES, SQL = P.QUERIES, P.SQL
W = "(PARTITION BY series, segment_id ORDER BY bar"


@P.add(f"""WITH {averaged_sql(60)}
SELECT series, bar, segment_id, observed, ticks, close, weight, avg_60,
       CAST(coalesce(last_value(nullif(sign(mid - avg_60), 0) IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS side
FROM averaged""")
def bars_vwap(spark: SparkSession, sf: str) -> DataFrame:
    """Bars, gap segments, weighted average over 60 rows, side of the excursion."""
    rows = averaged(spark, sf, 60).withColumn("delta", F.col("mid") - F.col("avg_60"))
    return X.sides(rows, "delta", SEG, "bar").select("series", "bar", "segment_id", "observed", *whole("ticks", "close", "weight"), "avg_60", "side")


@P.add(f"""WITH {BARS.split(', stepped AS')[0]}
SELECT series, bar, open, high, low, close, first_bid, first_ask, last_bid, last_ask, ticks, last_ts, k FROM raw""")
def ohlc_bars(spark: SparkSession, sf: str) -> DataFrame:
    out = B.ohlc(quotes(spark, sf), ["series"], "ts", HOUR, "px", ["ts", "seq"], carry=("bid", "ask"), totals=("k",))
    return out.select("series", "bar", "open", "high", "low", "close", "first_bid", "first_ask", "last_bid", "last_ask", "ticks", "last_ts", "k")


@P.add(f"WITH {BARS} SELECT series, bar, segment_id, observed, gap_rows, open, high, low, close, first_bid, first_ask, ticks, age_ms, weight FROM bars")
def gap_fill_segments(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("series", "bar", "segment_id", "observed", "gap_rows", *whole("open", "high", "low", "close", "first_bid", "first_ask", "ticks"), "age_ms", "weight")


@P.add(f"WITH {averaged_sql(*B.HORIZONS)} SELECT series, bar, {', '.join(f'avg_{h}' for h in B.HORIZONS)} FROM averaged")
def vwap_multi(spark: SparkSession, sf: str) -> DataFrame:
    return averaged(spark, sf, *B.HORIZONS).select("series", "bar", *[f"avg_{h}" for h in B.HORIZONS])


@P.add(f"""WITH {BARS} SELECT series, bar, {average_sql('last_bid', 'weight', 60)} AS bid_avg, {average_sql('last_ask', 'weight', 60)} AS ask_avg,
       {average_sql('close', 'weight', None, by=f'series, bar // {DAY}')} AS daily_avg FROM bars""")
def weighted_vwap(spark: SparkSession, sf: str) -> DataFrame:
    """Averages of both sides of the book within segments, and since the start of the day across them."""
    rows = bars(spark, sf).withColumn("day", F.floor(F.col("bar") / DAY))
    avg = lambda c, keys, n: T.weighted_average(F.col(c), F.col("weight"), keys, ["bar"], n)
    return rows.select("series", "bar", avg("last_bid", SEG, 60).alias("bid_avg"), avg("last_ask", SEG, 60).alias("ask_avg"), avg("close", ["series", "day"], None).alias("daily_avg"))


@P.add(f"WITH {averaged_sql(24)} SELECT series, bar, avg_24 FROM averaged")
def vwap_chunked(spark: SparkSession, sf: str) -> DataFrame:
    """The same average over chunks of 64 rows with a halo of the window: a long segment is many tasks."""
    rows = bars(spark, sf).withColumn("mid", F.col("last_bid") + F.col("last_ask"))
    op = lambda part, keys: part.withColumn("avg_24", T.weighted_average(F.col("mid"), F.col("weight"), keys, ["bar"], 24))
    return T.chunked(rows, SEG, F.floor(F.col("bar") / HOUR), 23, 64, op).select("series", "bar", "avg_24")


@P.add(f"""WITH {BARS}, r AS (SELECT *, close - lag(close) OVER {W}) AS d1, close - lag(close, 5) OVER {W}) AS d5 FROM bars)
SELECT series, bar, d1, d5,
       CASE WHEN count(d1) OVER w5 = 5 THEN round(sqrt(sum(CAST(d1 * d1 AS DOUBLE)) OVER w5 / 5.0), 6) END AS rms5,
       CASE WHEN count(d1) OVER w5 = 5 THEN round(sum(d1) OVER w5 / 5.0, 6) END AS full5,
       round(avg(close) OVER w5, 6) AS part5
FROM r WINDOW w5 AS {W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Lag changes within segments, and the three contracts: full windows (mean, RMS) and partial means."""
    rows = bars(spark, sf).withColumns({"d1": T.lag_delta(F.col("close"), SEG, ["bar"]), "d5": T.lag_delta(F.col("close"), SEG, ["bar"], 5)})
    d = F.col("d1").cast("double")
    return rows.select("series", "bar", "d1", "d5", r6(T.full_rms(d, SEG, ["bar"], 5), "rms5"), r6(T.full_mean(d, SEG, ["bar"], 5), "full5"), r6(T.partial_mean(F.col("close"), SEG, ["bar"], 5), "part5"))


@P.add(f"""WITH {BARS} SELECT series, bar, max(high) OVER w AS high24, min(low) OVER w AS low24,
       round(ln(close / max(high) OVER w) * 10000, 6) AS from_high_bps, round(ln(close / min(low) OVER w) * 10000, 6) AS from_low_bps
FROM bars WHERE low > 0 WINDOW w AS (PARTITION BY series ORDER BY bar ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def rolling_extreme(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling extremes that run across segments, and the distance of the close from them."""
    w = T.over(["series"], ["bar"], 23)
    rows = bars(spark, sf).where("low > 0").withColumns({"high24": F.max("high").over(w), "low24": F.min("low").over(w)})
    away = lambda c: F.log(F.col("close") / F.col(c)) * 10000
    return rows.select("series", "bar", "high24", "low24", r6(away("high24"), "from_high_bps"), r6(away("low24"), "from_low_bps"))


@P.add(f"""WITH {averaged_sql(5)}, moves AS (
  SELECT *, CAST(mid - lag(mid) OVER s AS DOUBLE) AS p, round(avg_5 - lag(avg_5) OVER s, 4) AS v,
         observed AND lag(observed) OVER s AS ok FROM averaged WINDOW s AS {W})),
lagged AS (SELECT *, lag(p) OVER s AS p1, lag(v) OVER s AS v1, coalesce(ok AND lag(ok) OVER s, false) AS good FROM moves WINDOW s AS {W})),
stats AS (SELECT series, bar,
  sum(CASE WHEN good THEN 1 END) OVER w AS n,
  sum(CASE WHEN good THEN p1 END) OVER w AS sx, sum(CASE WHEN good THEN v END) OVER w AS sy,
  sum(CASE WHEN good THEN p1 * p1 END) OVER w AS sxx, sum(CASE WHEN good THEN v * v END) OVER w AS syy, sum(CASE WHEN good THEN p1 * v END) OVER w AS sxy,
  sum(CASE WHEN good THEN v1 END) OVER w AS tx, sum(CASE WHEN good THEN p END) OVER w AS ty,
  sum(CASE WHEN good THEN v1 * v1 END) OVER w AS txx, sum(CASE WHEN good THEN p * p END) OVER w AS tyy, sum(CASE WHEN good THEN v1 * p END) OVER w AS txy
  FROM lagged WINDOW w AS {W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
parts AS (SELECT series, bar, sxx / n - sx / n * (sx / n) AS vx, syy / n - sy / n * (sy / n) AS vy, sxy / n - sx / n * (sy / n) AS cxy,
  txx / n - tx / n * (tx / n) AS ux, tyy / n - ty / n * (ty / n) AS uy, txy / n - tx / n * (ty / n) AS dxy FROM stats)
SELECT series, bar, round(CASE WHEN vx > 1e-4 AND vy > 1e-4 THEN cxy / sqrt(vx * vy) ELSE 0 END, 4) AS price_leads, round(CASE WHEN vx > 1e-4 THEN cxy / vx ELSE 0 END, 4) AS price_beta,
       round(CASE WHEN ux > 1e-4 AND uy > 1e-4 THEN dxy / sqrt(ux * uy) ELSE 0 END, 4) AS average_leads, round(CASE WHEN ux > 1e-4 THEN dxy / ux ELSE 0 END, 4) AS average_beta FROM parts""")
def rolling_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Lead and lag between price and average: causal correlations and betas over 60 rows of valid pairs."""
    s = Window.partitionBy(*SEG).orderBy("bar")
    rows = averaged(spark, sf, 5)
    rows = rows.withColumns({"p": T.lag_delta(F.col("mid"), SEG, ["bar"]).cast("double"), "v": F.round(T.lag_delta(F.col("avg_5"), SEG, ["bar"]), 4), "ok": F.col("observed") & F.lag("observed").over(s)})
    rows = rows.withColumns({"p1": F.lag("p").over(s), "v1": F.lag("v").over(s), "good": F.coalesce(F.col("ok") & F.lag("ok").over(s), F.lit(False))})

    def over_chunks(part: DataFrame, keys: list[str]) -> DataFrame:
        one = T.correlation(F.col("p1"), F.col("v"), F.col("good"), keys, ["bar"], 60, floor=1e-4)
        two = T.correlation(F.col("v1"), F.col("p"), F.col("good"), keys, ["bar"], 60, floor=1e-4)
        return part.withColumns({"o0": one[0], "o1": one[1], "t0": two[0], "t1": two[1]})

    rows = T.chunked(rows, SEG, (F.col("bar") / HOUR).cast("long"), 59, 480, over_chunks)
    one, two = (F.col("o0"), F.col("o1")), (F.col("t0"), F.col("t1"))
    return rows.select("series", "bar", r6(one[0], "price_leads", 4), r6(one[1], "price_beta", 4), r6(two[0], "average_leads", 4), r6(two[1], "average_beta", 4))


@P.add(f"""WITH {QUOTE}, bounds AS (SELECT series, min(ts) AS lo, max(ts) AS hi FROM quote GROUP BY series),
grid AS (SELECT series, t AS ts FROM bounds, LATERAL (SELECT unnest(range(-(-lo // {HOUR}) * {HOUR} + CASE WHEN lo % {HOUR} <> 0 THEN {HOUR} ELSE 0 END, hi // {HOUR} * {HOUR} + 1, {HOUR})) AS t))
SELECT g.series, g.ts, q.bid, q.ask, q.ts AS asof_ts, g.ts - q.ts AS age FROM grid g ASOF LEFT JOIN quote q ON g.series = q.series AND g.ts >= q.ts""")
def asof_grid(spark: SparkSession, sf: str) -> DataFrame:
    """State of each series' quote at every hour of the grid between its first and last tick."""
    q = quotes(spark, sf)
    grid = T.grid(q.groupBy("series").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")), ["series"], "lo", "hi", HOUR)
    out = T.asof_last(grid, q, ["series"], ["bid", "ask"], order=["seq"], bucket_width=DAY)
    return out.select("series", "ts", "bid", "ask", "asof_ts", (F.col("ts") - F.col("asof_ts")).alias("age"))


LATENCIES = (100_000, 250_000, 500_000)


@P.add(f"""WITH {QUOTE}, signals AS (SELECT series, seq, ts, ts + l AS due, l AS latency FROM quote, (SELECT unnest([{', '.join(map(str, LATENCIES))}]::BIGINT[]) AS l))
SELECT s.series, s.seq, s.latency, q.bid, q.ask, coalesce(s.due - q.ts <= {4 * HOUR} AND q.bid > 0 AND q.bid <= q.ask AND q.k >= 10, false) AS valid
FROM signals s ASOF LEFT JOIN quote q ON s.series = q.series AND s.due >= q.ts""")
def latency_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes that signals meet after each latency, valid if fresh, sound and large enough."""
    q = quotes(spark, sf)
    grid = q.select("series", "seq", F.explode(F.array(*[F.lit(x).cast("long") for x in LATENCIES])).alias("latency"), "ts")
    grid = grid.withColumn("due", F.col("ts") + F.col("latency"))
    out = T.asof_last(grid, q.withColumnRenamed("seq", "n"), ["series"], ["bid", "ask", "k"], at="due", order=["n"], bucket_width=DAY)
    ok = (F.col("due") - F.col("asof_ts") <= 4 * HOUR) & S.quote_valid(F.col("bid").cast("double"), F.col("ask").cast("double")) & (F.col("k") >= 10)
    return out.select("series", "seq", "latency", "bid", "ask", F.coalesce(ok, F.lit(False)).alias("valid"))


@P.add(f"""WITH {QUOTE}, bounds AS (SELECT series, min(ts) // {HOUR} AS lo, max(ts) // {HOUR} AS hi FROM quote GROUP BY series),
grid AS (SELECT series, h FROM bounds, LATERAL (SELECT unnest(range(lo, hi + 1)) AS h)),
lasts AS (SELECT series, ts // {HOUR} AS h, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask, arg_max(bid, CASE WHEN ts % {HOUR} <= {HOUR // 4} THEN seq END) AS phase_bid FROM quote GROUP BY ALL),
filled AS (SELECT g.series, g.h, l.phase_bid, lag(last_value(l.bid IGNORE NULLS) OVER w) OVER (PARTITION BY g.series ORDER BY g.h) AS bid, lag(last_value(l.ask IGNORE NULLS) OVER w) OVER (PARTITION BY g.series ORDER BY g.h) AS ask
  FROM grid g LEFT JOIN lasts l ON g.series = l.series AND g.h = l.h WINDOW w AS (PARTITION BY g.series ORDER BY g.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT series, h, bid, ask, coalesce(phase_bid, bid) AS execution_bid FROM filled""".replace("lag(last_value(l.bid IGNORE NULLS) OVER w) OVER (PARTITION BY g.series ORDER BY g.h)", "last_value(l.bid IGNORE NULLS) OVER p").replace("lag(last_value(l.ask IGNORE NULLS) OVER w) OVER (PARTITION BY g.series ORDER BY g.h)", "last_value(l.ask IGNORE NULLS) OVER p").replace("WINDOW w AS (PARTITION BY g.series ORDER BY g.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "WINDOW p AS (PARTITION BY g.series ORDER BY g.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def phase_quote(spark: SparkSession, sf: str) -> DataFrame:
    """Dense hours: the state is the last quote of earlier hours; orders fill at the first quarter's last quote, else at the state."""
    q = quotes(spark, sf).withColumn("h", F.floor(F.col("ts") / HOUR))
    lo_hi = q.groupBy("series").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    grid = T.grid(lo_hi, ["series"], "lo", "hi", 1, "h")
    early = F.when(F.pmod("ts", F.lit(HOUR)) <= HOUR // 4, F.col("seq"))
    lasts = q.groupBy("series", "h").agg(F.max_by("bid", "seq").alias("bid"), F.max_by("ask", "seq").alias("ask"), F.max_by("bid", early).alias("phase"))
    rows = T.forward_fill(grid.join(lasts, ["series", "h"], "left"), ["series"], ["h"], ["bid", "ask"])
    before = Window.partitionBy("series").orderBy("h")
    rows = rows.withColumns({"bid": F.lag("bid").over(before), "ask": F.lag("ask").over(before)})
    return rows.select("series", "h", "bid", "ask", F.coalesce("phase", "bid").alias("execution_bid"))


@P.add(f"""WITH {BARS} SELECT series, bar, lead(last_bid, 3) OVER w AS bid_later, lead(last_ask, 3) OVER w AS ask_later, lead(segment_id, 3) OVER w = segment_id AS same
FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar)""")
def latency_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes a whole number of grid steps later: ceil(latency / cadence), here 2.5 hours."""
    steps = -(-int(2.5 * HOUR) // HOUR)
    w = Window.partitionBy("series").orderBy("bar")
    return bars(spark, sf).select("series", "bar", F.lead("last_bid", steps).over(w).alias("bid_later"), F.lead("last_ask", steps).over(w).alias("ask_later"), (F.lead("segment_id", steps).over(w) == F.col("segment_id")).alias("same"))


@P.add(f"""WITH {TICK}, many AS (SELECT series, ts, seq, px, 0 AS serial FROM tick WHERE event_type = 'click' UNION ALL SELECT series, ts, seq, px, 1 FROM tick WHERE event_type = 'view' UNION ALL SELECT series, ts, seq, px, 2 FROM tick WHERE event_type = 'purchase')
SELECT series, ts, seq, px, serial, CAST(row_number() OVER (PARTITION BY series ORDER BY ts, seq, serial) AS INTEGER) AS place FROM many""")
def merge_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Three streams in one causal order; the stream's place breaks ties."""
    t = ticks(spark, sf).select("series", "ts", "seq", "px", "event_type")
    rows = T.merged([t.where(F.col("event_type") == x).drop("event_type") for x in ("click", "view", "purchase")], ["ts", "seq"])
    at = rows.withColumn("at", F.monotonically_increasing_id())  # grows with the merged order
    return at.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy("at"))).drop("at")


@P.add(f"""WITH {TICK} SELECT series, k, ts, seq, px FROM tick QUALIFY row_number() OVER (PARTITION BY series, k ORDER BY ts DESC, seq DESC) = 1""")
def dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    return T.keep_last(ticks(spark, sf), ["series", "k"], ["ts", "seq"]).select("series", "k", "ts", "seq", "px")


@P.add(f"""WITH {TICK} SELECT series, seq, px FROM tick QUALIFY (row_number() OVER (PARTITION BY series ORDER BY ts, seq) - 1) % 5 = 0""")
def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    return T.every_nth(ticks(spark, sf), ["series"], ["ts", "seq"], 5, 7 * DAY).select("series", "seq", "px")


@P.add(f"""WITH {QUOTE} SELECT series, ts // {2 * HOUR} * {2 * HOUR} AS bar, arg_max(bid, seq) AS last_bid, arg_max(ask, seq) AS last_ask, arg_max(k, seq) AS last_k, CAST(sum(k) AS BIGINT) AS k_total, count(*) AS n,
  max(px) - min(px) AS mid_range, arg_max(px, seq) - arg_min(px, seq) AS mid_change FROM quote GROUP BY ALL""")
def last_of_bar(spark: SparkSession, sf: str) -> DataFrame:
    """Longer bars: the last row's state as one struct, sums, range and change."""
    return B.last_of_bars(quotes(spark, sf), ["series"], "ts", 2 * HOUR, ["ts", "seq"], ["bid", "ask", "k"], ["k"], "px")


@P.add(f"""WITH {TICK}, bounds AS (SELECT series, min(ts) // {HOUR} AS lo, max(ts) // {HOUR} AS hi FROM tick GROUP BY series),
grid AS (SELECT series, h FROM bounds, LATERAL (SELECT unnest(range(lo, hi + 1)) AS h)),
sums AS (SELECT series, ts // {HOUR} AS h, sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS buy, sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END) AS sell, count(*) AS n FROM tick GROUP BY ALL)
SELECT g.series, g.h, CAST(coalesce(lag(coalesce(buy, 0)) OVER w, 0) AS BIGINT) AS buy, CAST(coalesce(lag(coalesce(sell, 0)) OVER w, 0) AS BIGINT) AS sell, CAST(coalesce(lag(coalesce(n, 0)) OVER w, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN sums s ON g.series = s.series AND g.h = s.h WINDOW w AS (PARTITION BY g.series ORDER BY g.h)""")
def shifted_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Trades of an hour count in the next one, on a dense grid."""
    t = ticks(spark, sf).withColumn("h", F.floor(F.col("ts") / HOUR))
    grid = T.grid(t.groupBy("series").agg(F.min("h").alias("lo"), F.max("h").alias("hi")), ["series"], "lo", "hi", 1, "h")
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("k")).otherwise(0))
    sums = t.groupBy("series", "h").agg(of("purchase").alias("buy"), of("click").alias("sell"), F.count("*").alias("n"))
    return T.shifted(grid, sums, ["series"], "h", ["buy", "sell", "n"])


@P.add(f"""WITH {BARS}, m AS (SELECT *, last_bid + last_ask AS mid FROM bars WHERE last_bid > 0),
r AS (SELECT *, abs(mid - lag(mid) OVER w) AS step, ln(mid / lag(mid) OVER w) * 10000 AS move, ln(mid / lag(mid, 3) OVER w) * 10000 AS m3, ln(mid / lag(mid, 12) OVER w) * 10000 AS m12, abs(mid - lag(mid, 6) OVER w) AS net FROM m WINDOW w AS (PARTITION BY series ORDER BY bar))
SELECT series, bar, round(coalesce(m3, 0), 5) AS momentum3, round(coalesce(m12, 0), 5) AS momentum12, round(sqrt(coalesce(avg(move * move) OVER w6, 0)), 5) AS vol6,
       round(coalesce(net / greatest(CAST(sum(step) OVER w6 AS DOUBLE), 1e-12), 0), 6) AS efficiency6
FROM r WINDOW w6 AS (PARTITION BY series ORDER BY bar ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def momentum_vol(spark: SparkSession, sf: str) -> DataFrame:
    """Log momentum at several lags, realised volatility over what there is, and path efficiency; not cut at segments."""
    keys, order = ["series"], ["bar"]
    rows = bars(spark, sf).where("last_bid > 0").withColumn("mid", F.col("last_bid") + F.col("last_ask"))
    w = Window.partitionBy("series").orderBy("bar")
    ret = lambda k: F.log(F.col("mid") / F.lag("mid", k).over(w)) * 10000
    rows = rows.withColumns({"step": F.abs(T.lag_delta(F.col("mid"), keys, order)), "move": ret(1), "net": F.abs(T.lag_delta(F.col("mid"), keys, order, 6))})
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    path = F.greatest(F.sum("step").over(T.over(keys, order, 5)).cast("double"), F.lit(1e-12))
    return rows.select("series", "bar", r6(zero(ret(3)), "momentum3", 5), r6(zero(ret(12)), "momentum12", 5), r6(F.sqrt(zero(T.partial_mean(F.col("move") * F.col("move"), keys, order, 6))), "vol6", 5), r6(zero(F.col("net") / path), "efficiency6"))


@P.add(f"""WITH {BARS}, c AS (SELECT bar, median(CAST(last_bid + last_ask AS DOUBLE)) AS mid, count(*) AS n FROM bars WHERE observed AND last_bid > 0 GROUP BY bar)
SELECT bar, n, round(mid, 4) AS mid, {', '.join(f'round(coalesce((mid / lag(mid, {k}) OVER (ORDER BY bar) - 1) * 10000, 0), 5) AS return_{k}' for k in (1, 2, 5))} FROM c""")
def consensus_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Median over the venues' mids, and its returns at several lags across segments; 0 where there is none yet.

    The lags run over one row per grid step, after the venues are aggregated away.
    """
    c = bars(spark, sf).where("observed AND last_bid > 0").groupBy("bar").agg(F.median((F.col("last_bid") + F.col("last_ask")).cast("double")).alias("mid"), F.count("*").alias("n"))
    w = Window.orderBy("bar")
    ret = lambda k: r6(F.coalesce((F.col("mid") / F.lag("mid", k).over(w) - 1) * 10000, F.lit(0.0)), f"return_{k}", 5)
    return c.select("bar", "n", r6(F.col("mid"), "mid", 4), ret(1), ret(2), ret(5))

