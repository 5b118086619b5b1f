"""Books, trades, liquidations, venue state and audits on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bars as B
from ..operators import book as K
from ..operators import temporal as T
from .base import DAY, HOUR, QUOTE, TICK, Plans, cents, quotes, r6, table, ticks

P = Plans()
QUERIES, SQL = P.QUERIES, P.SQL
SIX = 6 * HOUR


def levels(spark: SparkSession, sf: str) -> DataFrame:
    """ticks as book rows: a side, a price on it, k as quantity (0 deletes); errors are snapshot marks."""
    kind = F.col("event_type")
    side = F.when(kind.isin("click", "view"), "bid").when(kind.isin("signup", "purchase"), "ask")
    price = F.when(side == "bid", 100_000 - F.pmod("px", F.lit(50))).when(side == "ask", 100_001 + F.pmod("px", F.lit(50)))
    return ticks(spark, sf).select("series", "ts", "seq", side.alias("side"), price.alias("price"), F.col("k").alias("quantity"), (kind == "error").alias("is_snapshot"))


LEVELS = TICK + """, lvl AS (SELECT series, ts, seq, CASE WHEN event_type IN ('click', 'view') THEN 'bid' WHEN event_type IN ('signup', 'purchase') THEN 'ask' END AS side,
  CASE WHEN event_type IN ('click', 'view') THEN 100000 - px % 50 WHEN event_type IN ('signup', 'purchase') THEN 100001 + px % 50 END AS price, k AS quantity, event_type = 'error' AS is_snapshot FROM tick)"""


def standing(spark: SparkSession, sf: str, cadence: int) -> DataFrame:
    rows = levels(spark, sf)
    last = rows.groupBy("series").agg(F.max("ts").alias("last"))
    held = K.versions(rows, ["series"], ["ts", "seq"], F.col("is_snapshot"), alive=F.col("quantity") > 0, width=7 * DAY)
    return K.at_ticks(held.join(F.broadcast(last), "series"), cadence, F.col("last"))  # one row per venue


STANDING = LEVELS + """, epochs AS (SELECT *, CAST(sum(CASE WHEN is_snapshot THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS epoch FROM lvl),
ends AS (SELECT series, epoch, lead(min(ts)) OVER (PARTITION BY series ORDER BY epoch) AS over FROM epochs GROUP BY series, epoch),
vers AS (SELECT series, epoch, side, price, quantity, ts, lead(ts) OVER (PARTITION BY series, epoch, side, price ORDER BY ts, seq) AS nxt FROM epochs WHERE side IS NOT NULL),
grid AS (SELECT series, t AS tick FROM (SELECT series, min(ts) // {c} * {c} AS lo, max(ts) // {c} * {c} AS hi FROM lvl GROUP BY series), LATERAL (SELECT unnest(range(lo, hi + 1, {c})) AS t)),
standing AS (SELECT v.*, g.tick FROM vers v JOIN ends USING (series, epoch) JOIN grid g ON g.series = v.series AND g.tick >= v.ts AND (nxt IS NULL OR g.tick < nxt) AND (over IS NULL OR g.tick < over) WHERE quantity > 0)"""


@P.add(f"""WITH {STANDING.format(c=HOUR)}, b AS (SELECT series, tick, max(CASE WHEN side = 'bid' THEN price END) AS b, min(CASE WHEN side = 'ask' THEN price END) AS a, max(ts) AS updated, max(epoch) AS epoch FROM standing GROUP BY ALL)
SELECT series, tick, epoch, updated, CASE WHEN b < a AND epoch > 0 THEN b END AS bid, CASE WHEN b < a AND epoch > 0 THEN a END AS ask FROM b""")
def book_bbo_at_tick(spark: SparkSession, sf: str) -> DataFrame:
    """Best bid and ask on an hourly grid, from validity intervals of the book's levels."""
    return K.bbo(standing(spark, sf, HOUR), ["series", "tick"]).select("series", "tick", "epoch", "updated", "bid", "ask")


@P.add(f"""WITH {STANDING.format(c=SIX)}, r AS (SELECT *, row_number() OVER (PARTITION BY series, tick, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS n FROM standing),
a AS (SELECT series, tick, {', '.join(f"CAST(sum(CASE WHEN side = '{s}' AND n <= {d} THEN quantity ELSE 0 END) AS BIGINT) AS {s}_{d}" for d in (1, 5, 10, 25) for s in ('bid', 'ask'))},
  max(CASE WHEN side = 'bid' AND n = 1 THEN price END) AS b1, max(CASE WHEN side = 'bid' AND n = 10 THEN price END) AS b10, max(CASE WHEN side = 'ask' AND n = 1 THEN price END) AS a1, max(CASE WHEN side = 'ask' AND n = 10 THEN price END) AS a10 FROM r GROUP BY ALL)
SELECT series, tick, {', '.join(f'{s}_{d}' for d in (1, 5, 10, 25) for s in ('bid', 'ask'))}, {', '.join(f'round((bid_{d} - ask_{d}) / greatest(CAST(bid_{d} + ask_{d} AS DOUBLE), 1e-12), 6) AS imbalance_{d}' for d in (1, 5, 10, 25))},
  round(coalesce((b1 - b10) / ((b1 + a1) * 0.5::DOUBLE) * 10000, 0), 6) AS bid_slope, round(coalesce((a10 - a1) / ((b1 + a1) * 0.5::DOUBLE) * 10000, 0), 6) AS ask_slope FROM a""")
def top_n_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities of the best N levels of each side, imbalances and slopes."""
    out = K.depth(standing(spark, sf, SIX), ["series", "tick"], depths=(1, 5, 10, 25))
    return out.select(*[c if not c.startswith("imbalance") and not c.endswith("slope") else r6(F.col(c), c) for c in out.columns])


@P.add(f"""WITH {LEVELS}, t AS (SELECT *, -(-ts // {HOUR}) * {HOUR} AS cell, max(CASE WHEN is_snapshot THEN seq END) OVER (PARTITION BY series, -(-ts // {HOUR})) AS snap FROM (SELECT *, ts AS z FROM lvl))
SELECT series, ts - ts % {HOUR} + CASE WHEN ts % {HOUR} > 0 THEN {HOUR} ELSE 0 END AS cell, side, price, quantity, seq FROM
 (SELECT *, max(CASE WHEN is_snapshot THEN seq END) OVER (PARTITION BY series, ts - ts % {HOUR} + CASE WHEN ts % {HOUR} > 0 THEN {HOUR} ELSE 0 END) AS last_snap FROM lvl)
WHERE side IS NOT NULL AND (last_snap IS NULL OR seq >= last_snap)
QUALIFY row_number() OVER (PARTITION BY series, ts - ts % {HOUR} + CASE WHEN ts % {HOUR} > 0 THEN {HOUR} ELSE 0 END, side, price ORDER BY seq DESC) = 1""".replace(f", t AS (SELECT *, -(-ts // {HOUR}) * {HOUR} AS cell, max(CASE WHEN is_snapshot THEN seq END) OVER (PARTITION BY series, -(-ts // {HOUR})) AS snap FROM (SELECT *, ts AS z FROM lvl))", ""))
def tick_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Updates of a tick after its last snapshot, the last of each side and price."""
    rows = levels(spark, sf).withColumns({"cell": S.ceil_grid(F.col("ts"), HOUR), "side": F.coalesce("side", F.lit("")), "row": F.lit(0)})
    return K.collapsed(rows, ["series"], "cell", ["seq", "row"]).select("series", "cell", "side", "price", "quantity", "seq")


@P.add(f"""WITH {TICK}, s AS (SELECT series, ts, seq, k AS last, k - 3 AS first, lag(k) OVER (PARTITION BY series ORDER BY ts, seq) AS prev FROM tick),
g AS (SELECT *, coalesce(first > prev + 1, false) AS gap FROM s)
SELECT series, seq, coalesce(last <= prev, false) AS stale, gap, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM g""")
def seq_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence checks of a diff stream: stale and missing updates, and the runs between resyncs."""
    rows = ticks(spark, sf).withColumns({"last": F.col("k"), "first": F.col("k") - 3})
    return K.flagged_gaps(rows, ["series"], ["ts", "seq"], "first", "last", width=7 * DAY).select("series", "seq", "stale", "gap", "run")


TRADE = """trade AS (SELECT l_suppkey % 9 AS venue, epoch_us(l_shipdate) // 86400000000 AS day, l_orderkey AS trade_id, l_linenumber AS line, CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS notional, CAST(l_quantity AS BIGINT) AS quantity,
  CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'Sell' ELSE 'n/a' END AS taker FROM lineitem)"""


def trade_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    taker = F.when(F.col("l_returnflag") == "A", "buy").when(F.col("l_returnflag") == "R", "Sell").otherwise("n/a")
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000)
    return li.select(F.pmod("l_suppkey", F.lit(9)).alias("venue"), day.alias("day"), F.col("l_orderkey").alias("trade_id"), F.col("l_linenumber").alias("line"), cents(F.col("l_extendedprice")).alias("notional"), F.col("l_quantity").cast("long").alias("quantity"), taker.alias("taker"))


@P.add(f"""WITH {TRADE}, a AS (SELECT venue, day, count(*) AS n, CAST(sum(CASE WHEN lower(taker) = 'buy' THEN quantity ELSE 0 END) AS BIGINT) AS buy, CAST(sum(CASE WHEN lower(taker) = 'sell' THEN quantity ELSE 0 END) AS BIGINT) AS sell, CAST(sum(notional) AS BIGINT) AS notional FROM trade GROUP BY ALL)
SELECT venue, day, n, buy, sell, notional, buy - sell AS signed, CASE WHEN buy + sell > 0 THEN notional END AS paid FROM a""")
def trade_tick(spark: SparkSession, sf: str) -> DataFrame:
    """Trades per venue and day; the average, here times that quantity, divides all notional by the quantity of known takers."""
    rows = trade_rows(spark, sf).withColumns({"price": F.col("notional") / F.col("quantity").cast("double")})
    out = K.trades(rows, ["venue", "day"])
    total = F.col("buy") + F.col("sell")
    return out.select("venue", "day", "n", "buy", "sell", F.rint("notional").cast("long").alias("notional"), "signed", F.rint(F.col("vwap") * total).cast("long").alias("paid"))


@P.add(f"""WITH {TRADE}, u AS (SELECT DISTINCT ON (venue, day, trade_id) venue, day, trade_id FROM trade), a AS (SELECT venue, day, count(*) AS n FROM u GROUP BY ALL),
b AS (SELECT venue, day, CAST(sum(CASE WHEN lower(taker) IN ('buy', 'sell') THEN notional ELSE 0 END) AS BIGINT) AS known_notional FROM trade GROUP BY ALL)
SELECT venue, day, n AS unique_trades, known_notional FROM a JOIN b USING (venue, day)""")
def trade_options(spark: SparkSession, sf: str) -> DataFrame:
    """The optional forms: trades counted once per id, and notional of known takers alone."""
    rows = trade_rows(spark, sf).withColumns({"price": F.col("notional"), "size": F.col("quantity"), "quantity": F.lit(1).cast("long")})
    once = K.trades(rows, ["venue", "day"], dedupe=("trade_id",)).select("venue", "day", F.col("n").alias("unique_trades"))
    return once.join(K.trades(rows, ["venue", "day"], known_only=True).select("venue", "day", F.col("notional").alias("known_notional")), ["venue", "day"])


@P.add(f"""WITH {TICK} SELECT series, ts // {HOUR} AS h, CAST(sum(CASE WHEN event_type = 'error' AND k % 2 = 0 THEN px ELSE 0 END) AS BIGINT) AS long_liquidated, CAST(sum(CASE WHEN event_type = 'error' AND k % 2 = 1 THEN px ELSE 0 END) AS BIGINT) AS short_liquidated,
  count(CASE WHEN event_type = 'error' THEN 1 END) AS n FROM tick GROUP BY ALL""")
def liquidations(spark: SparkSession, sf: str) -> DataFrame:
    """Liquidated amounts by side within each tick; counters start anew in the next."""
    side = F.when(F.col("event_type") == "error", F.when(F.pmod("k", F.lit(2)) == 0, "long").otherwise("short"))
    rows = ticks(spark, sf).withColumn("h", F.floor(F.col("ts") / HOUR))
    return K.liquidated(rows, ["series", "h"], side, F.col("px"))


@P.add(f"""WITH {TICK} SELECT series, seq, last_value(CASE WHEN event_type = 'click' THEN px END IGNORE NULLS) OVER w AS mark, last_value(CASE WHEN event_type = 'view' THEN px END IGNORE NULLS) OVER w AS index_price,
  last_value(CASE WHEN event_type = 'signup' AND k > 50 THEN k END IGNORE NULLS) OVER w AS open_interest FROM tick WINDOW w AS (PARTITION BY series ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def context_carry(spark: SparkSession, sf: str) -> DataFrame:
    """Derivative context: each field keeps its last value, as updates leave the others out."""
    kind = F.col("event_type")
    rows = ticks(spark, sf).withColumns({"mark": F.when(kind == "click", F.col("px")), "index_price": F.when(kind == "view", F.col("px")), "open_interest": F.when((kind == "signup") & (F.col("k") > 50), F.col("k"))})
    return T.forward_fill(rows, ["series"], ["ts", "seq"], ["mark", "index_price", "open_interest"], 7 * DAY).select("series", "seq", "mark", "index_price", "open_interest")


VENUE_LIST = ", ".join(f"'{v}'" for v in S.VENUES)


@P.add(f"""WITH {QUOTE}, bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM quote), grid AS (SELECT v AS series, t AS tick FROM bounds, LATERAL (SELECT unnest(range(lo // {HOUR} * {HOUR} + {HOUR}, hi + 1, {HOUR})) AS t), (SELECT unnest(range(9)) AS v)),
st AS (SELECT g.series, g.tick, [{VENUE_LIST}][g.series + 1] AS venue, q.bid, q.ask, (g.tick - q.ts) / 1000.0::DOUBLE AS stale FROM grid g ASOF LEFT JOIN quote q ON g.series = q.series AND g.tick >= q.ts),
m AS (SELECT tick, venue, venue LIKE '%\\_spot' ESCAPE '\\' AS spot, coalesce(bid > 0 AND bid < ask, false) AS valid, CAST(bid + ask AS DOUBLE) AS mid, coalesce(stale, 1e18) AS stale FROM st),
c AS (SELECT tick, venue, spot, valid, valid AND stale <= 7200000 AS cur, CASE WHEN valid THEN mid END AS mid FROM m),
g AS (SELECT tick, median(CASE WHEN spot THEN mid END) AS s, median(CASE WHEN NOT spot THEN mid END) AS d, median(mid) AS a FROM c GROUP BY tick)
SELECT tick, round(coalesce(any_value(s), 0), 4) AS spot_mid, round(coalesce(any_value(d), 0), 4) AS derivative_mid, round(CASE WHEN any_value(s) > 0 AND any_value(d) > 0 THEN 0.5 * (any_value(s) + any_value(d)) ELSE greatest(coalesce(any_value(s), 0), coalesce(any_value(d), 0)) END, 4) AS consensus,
  round(CASE WHEN any_value(s) > 0 AND any_value(d) > 0 THEN 10000 * (any_value(d) / any_value(s) - 1) ELSE 0 END, 4) AS basis_bps, round(coalesce(stddev_pop(10000 * (mid / a - 1)), 0), 3) AS dispersion_bps,
  count(CASE WHEN valid THEN 1 END) AS valid_venues, bool_or(cur AND venue = 'binance_perpetual') AND count(CASE WHEN cur THEN 1 END) >= 4 AND bool_or(cur AND spot) AND bool_or(cur AND NOT spot) AS valid,
  round(avg(CASE WHEN cur THEN mid END), 4) AS mean_mid, min(CASE WHEN cur THEN mid END) AS min_mid, max(CASE WHEN cur THEN mid END) AS max_mid, round(stddev_pop(CASE WHEN cur THEN mid END), 3) AS std_mid
FROM c JOIN g USING (tick) GROUP BY tick""")
def consensus_mid(spark: SparkSession, sf: str) -> DataFrame:
    """Venue state on the grid: group medians, consensus, basis, dispersion, fresh statistics, validity of the tick."""
    q = quotes(spark, sf)
    bounds = q.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).withColumn("lo", S.bucket(F.col("lo"), HOUR) + HOUR)
    grid = T.grid(bounds, [], "lo", "hi", HOUR, "tick").withColumn("series", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    st = T.asof_last(grid, q, ["series"], ["bid", "ask"], at="tick", order=["seq"], bucket_width=24 * HOUR)
    st = st.select("tick", F.element_at(F.array(*map(F.lit, S.VENUES)), (F.col("series") + 1).cast("int")).alias("venue"), (F.col("bid") + F.col("ask")).cast("double").alias("mid"), S.quote_valid(F.col("bid").cast("double"), F.col("ask").cast("double"), strict=True).alias("valid"), F.coalesce((F.col("tick") - F.col("asof_ts")) / 1000.0, F.lit(1e18)).alias("stale_ms"))
    out = K.venue_state(st, max_stale=7_200_000.0)
    places = {"dispersion_bps": 3, "std_mid": 3}
    return out.select("tick", *[r6(F.col(c), c, places.get(c, 4)) for c in ("spot_mid", "derivative_mid", "consensus", "basis_bps", "dispersion_bps", "mean_mid", "std_mid")], "valid_venues", "valid", "min_mid", "max_mid")


@P.add(f"""WITH {QUOTE}, d AS (SELECT *, CAST(ts - lag(ts) OVER w AS DOUBLE) AS step_us, px <= lag(px) OVER w AS falls FROM quote WINDOW w AS (PARTITION BY series ORDER BY ts, seq))
SELECT series, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(CASE WHEN bid <= 0 OR ask <= bid OR k <= 0 THEN 1 END) AS invalid, count(CASE WHEN falls THEN 1 END) AS falls, count(DISTINCT event_type) AS kinds,
  round(quantile_cont(CAST(ask - bid AS DOUBLE), 0.5), 4) AS spread_p50, round(quantile_cont(CAST(ask - bid AS DOUBLE), 0.95), 4) AS spread_p95, round(quantile_cont(step_us, 0.5), 3) AS step_p50, round(quantile_cont(step_us, 0.99), 3) AS step_p99 FROM d GROUP BY series""")
def recording_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, bounds, invalid rows, backward steps and exact quantiles of a recording."""
    rows = T.neighbours(quotes(spark, sf), ["series"], ["ts", "seq"], ["ts", "px"], 7 * DAY)
    rows = rows.withColumns({"step_us": (F.col("ts") - F.col("lag_ts")).cast("double"), "falls": F.col("px") <= F.col("lag_px"), "spread": (F.col("ask") - F.col("bid")).cast("double")})
    bad = (F.col("bid") <= 0) | (F.col("ask") <= F.col("bid")) | (F.col("k") <= 0)
    q = lambda c, p, name, d: r6(F.percentile(c, F.lit(p)), name, d)
    return rows.groupBy("series").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(bad).alias("invalid"), F.count_if("falls").alias("falls"), F.countDistinct("event_type").alias("kinds"), q("spread", 0.5, "spread_p50", 4), q("spread", 0.95, "spread_p95", 4), q("step_us", 0.5, "step_p50", 3), q("step_us", 0.99, "step_p99", 3))


QUOTES_BY_ID = TICK + """, qb AS (SELECT series, ts, seq, k % 20 AS quote_id, CASE WHEN event_type IN ('click', 'view') THEN 'bid' ELSE 'ask' END AS side, CASE WHEN event_type IN ('click', 'view') THEN 100000 - px % 20 ELSE 100001 + px % 20 END AS price, 1 + px % 7 AS size, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'new' END AS type FROM tick)"""


@P.add(f"""WITH {QUOTES_BY_ID}, v AS (SELECT *, lead(ts) OVER (PARTITION BY series, quote_id ORDER BY ts, seq) AS nxt FROM qb),
grid AS (SELECT series, t AS tick FROM (SELECT series, min(ts) // {SIX} * {SIX} AS lo, max(ts) // {SIX} * {SIX} AS hi FROM qb GROUP BY series), LATERAL (SELECT unnest(range(lo, hi + 1, {SIX})) AS t)),
h AS (SELECT v.*, g.tick FROM v JOIN grid g ON g.series = v.series AND g.tick >= v.ts AND (nxt IS NULL OR g.tick < nxt) WHERE type = 'new' AND size > 0),
b AS (SELECT *, max(CASE WHEN side = 'bid' THEN price END) OVER w AS bb, min(CASE WHEN side = 'ask' THEN price END) OVER w AS ba FROM h WINDOW w AS (PARTITION BY series, tick)),
a AS (SELECT series, tick, any_value(bb) AS best_bid, any_value(ba) AS best_ask, CAST(sum(CASE WHEN side = 'bid' AND price = bb THEN size WHEN side = 'bid' THEN 0 END) AS BIGINT) AS bid_size, CAST(sum(CASE WHEN side = 'ask' AND price = ba THEN size WHEN side = 'ask' THEN 0 END) AS BIGINT) AS ask_size,
  count(CASE WHEN side = 'bid' THEN 1 END) AS bid_levels, count(CASE WHEN side = 'ask' THEN 1 END) AS ask_levels, sum(CASE WHEN side = 'bid' THEN price * size END) / sum(CASE WHEN side = 'bid' THEN size END) AS bid_average FROM b GROUP BY ALL)
SELECT series, tick, best_bid, best_ask, bid_size, ask_size, bid_levels, ask_levels, round(bid_average, 5) AS bid_average, round(CAST(best_ask * bid_size + best_bid * ask_size AS DOUBLE) / (bid_size + ask_size), 5) AS microprice FROM a WHERE best_bid IS NOT NULL AND best_ask IS NOT NULL""")
def quote_book(spark: SparkSession, sf: str) -> DataFrame:
    """The book of quotes by id on a grid: sizes summed at the best price, levels, averages, microprice."""
    kind, px = F.col("event_type"), F.col("px")
    bid = kind.isin("click", "view")
    rows = ticks(spark, sf).select("series", "ts", "seq", F.pmod("k", F.lit(20)).alias("quote_id"), F.when(bid, "bid").otherwise("ask").alias("side"), F.when(bid, 100_000 - F.pmod(px, F.lit(20))).otherwise(100_001 + F.pmod(px, F.lit(20))).alias("price"), (1 + F.pmod(px, F.lit(7))).alias("size"), F.when(kind == "error", "deleted").otherwise("new").alias("type"))
    last = rows.groupBy("series").agg(F.max("ts").alias("last"))
    out = K.quote_book(rows.join(F.broadcast(last), "series"), ["series"], ["ts", "seq"], SIX, F.col("last"), 7 * DAY)
    return out.select("series", "tick", "best_bid", "best_ask", "bid_size", "ask_size", "bid_levels", "ask_levels", r6(F.col("bid_average"), "bid_average", 5), r6(F.col("microprice"), "microprice", 5))


SNAPS = f"""sn AS (SELECT series, ts // {HOUR} AS ts, CASE WHEN event_type IN ('click', 'view') THEN (100000 - px % 50)::DOUBLE ELSE 0 END AS bid, CASE WHEN event_type IN ('signup', 'purchase') THEN (100001 + px % 50)::DOUBLE ELSE 0 END AS ask, (1 + k)::DOUBLE AS size, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'new' END AS type FROM tick)"""


@P.add(f"""WITH {TICK}, {SNAPS}, n AS (SELECT * FROM sn WHERE type = 'new'),
r AS (SELECT *, row_number() OVER (PARTITION BY series, ts, bid > 0 ORDER BY CASE WHEN bid > 0 THEN bid ELSE -ask END DESC, CASE WHEN bid > 0 THEN size ELSE -size END DESC) AS i,
   row_number() OVER (PARTITION BY series, ts, bid > 0 ORDER BY CASE WHEN bid > 0 THEN bid ELSE -ask END DESC, size DESC) AS top FROM n),
a AS (SELECT series, ts, max(CASE WHEN bid > 0 THEN bid END) AS best_bid, min(CASE WHEN ask > 0 THEN ask END) AS best_ask, max(CASE WHEN bid > 0 AND top = 1 THEN size END) AS bid_size, max(CASE WHEN ask > 0 AND top = 1 THEN size END) AS ask_size,
  count(CASE WHEN bid > 0 THEN 1 END) AS bid_levels, count(CASE WHEN ask > 0 THEN 1 END) AS ask_levels, count(*) AS new_quotes, coalesce(sum(CASE WHEN bid > 0 AND i <= 3 THEN size END), 0) AS bid_depth3, coalesce(sum(CASE WHEN ask > 0 AND i <= 3 THEN size END), 0) AS ask_depth3,
  max(CASE WHEN bid > 0 AND i = 3 THEN bid END) AS bid3, max(CASE WHEN ask > 0 AND i = 3 THEN ask END) AS ask3 FROM r GROUP BY ALL)
SELECT series, ts, best_bid, best_ask, bid_size, ask_size, bid_levels, ask_levels, new_quotes, best_ask - best_bid AS spread_ticks, bid_depth3, ask_depth3, best_bid - bid3 AS bid_width3, ask3 - best_ask AS ask_width3,
  round((best_ask * bid_size + best_bid * ask_size) / (bid_size + ask_size), 6) AS microprice, round((bid_size - ask_size) / (bid_size + ask_size), 6) AS imbalance1, round((bid_depth3 - ask_depth3) / (bid_depth3 + ask_depth3), 6) AS imbalance3
FROM a WHERE bid_levels >= 1 AND ask_levels >= 1 AND new_quotes <= 20 AND best_ask - best_bid > 0 AND best_ask - best_bid <= 60""")
def snapshot_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots from depth quotes of one time: best levels and sizes, three-level depth and widths, accepted ones."""
    kind, px = F.col("event_type"), F.col("px")
    rows = ticks(spark, sf).select("series", F.floor(F.col("ts") / HOUR).alias("ts"), F.when(kind.isin("click", "view"), 100_000 - F.pmod(px, F.lit(50))).otherwise(0).cast("double").alias("bid"), F.when(kind.isin("signup", "purchase"), 100_001 + F.pmod(px, F.lit(50))).otherwise(0).cast("double").alias("ask"), (1 + F.col("k")).cast("double").alias("size"), F.when(kind == "error", "deleted").otherwise("new").alias("type"))
    out = B.snapshots(rows, ["series"], tick=1.0, levels=1, most_new=20, max_spread=60.0)
    return out.select("series", "ts", "best_bid", "best_ask", "bid_size", "ask_size", "bid_levels", "ask_levels", "new_quotes", "spread_ticks", "bid_depth3", "ask_depth3", "bid_width3", "ask_width3", r6(F.col("microprice"), "microprice"), r6(F.col("imbalance1"), "imbalance1"), r6(F.col("imbalance3"), "imbalance3"))


@P.add(f"""WITH {LEVELS} SELECT series, seq, greatest(CAST(sum(CASE WHEN is_snapshot THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - 1, 0) AS segment FROM lvl""")
def snapshot_segments(spark: SparkSession, sf: str) -> DataFrame:
    """A new snapshot of the anchor stream starts a segment; the first one does not."""
    rows = T.running_total(levels(spark, sf), ["series"], ["ts", "seq"], F.col("is_snapshot").cast("long"), "n", 7 * DAY)
    return rows.select("series", "seq", F.greatest(F.col("n") - 1, F.lit(0).cast("long")).alias("segment"))


@P.add(f"""WITH {LEVELS}, r AS (SELECT series, ts, seq, 'o' || (seq % 37) AS oid, side, price, quantity AS q, quantity % 5 = 0 AS gone, is_snapshot, -(-ts // {HOUR}) AS x, row_number() OVER w AS rn, sum(CASE WHEN is_snapshot THEN 1 ELSE 0 END) OVER w AS epoch FROM lvl WINDOW w AS (PARTITION BY series ORDER BY ts, seq)),
c AS (SELECT *, ts - ts % {HOUR} + CASE WHEN ts % {HOUR} > 0 THEN {HOUR} ELSE 0 END AS cell, NOT gone AND side IS NOT NULL AS live FROM r),
h AS (SELECT *, coalesce(lag(live) OVER o, false) AS had, lag(q) OVER o AS old, least(coalesce(lead(rn) OVER o, 1000000000), coalesce(min(rn) OVER e, 1000000000)) AS until FROM c
  WINDOW o AS (PARTITION BY series, epoch, oid ORDER BY rn), e AS (PARTITION BY series ORDER BY epoch RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)),
n AS (SELECT series, cell, max(rn) AS z, count(CASE WHEN live AND NOT had THEN 1 END) AS adds, count(CASE WHEN gone THEN 1 END) AS deletes, count(CASE WHEN live AND had THEN 1 END) AS modifies, sum(CASE WHEN live AND NOT had THEN q ELSE 0 END) AS add_qty, sum(CASE WHEN gone AND had THEN old ELSE 0 END) AS delete_qty FROM h GROUP BY ALL),
st AS (SELECT n.series, n.cell, count(h.oid) AS orders, coalesce(sum(CASE WHEN side = 'bid' THEN q END), 0) AS b, coalesce(sum(CASE WHEN side = 'ask' THEN q END), 0) AS a, max(CASE WHEN side = 'bid' THEN price END) AS bb, min(CASE WHEN side = 'ask' THEN price END) AS ba FROM n LEFT JOIN h ON h.series = n.series AND live AND h.rn <= n.z AND h.until > n.z GROUP BY ALL)
SELECT series, cell AS tick, orders, CAST(b AS DOUBLE) AS bid_qty, CAST(a AS DOUBLE) AS ask_qty, round(CAST(b - a AS DOUBLE) / greatest(a + b, 1e-12), 6) AS imbalance, adds, deletes, modifies, CAST(add_qty AS DOUBLE) AS add_qty, CAST(delete_qty AS DOUBLE) AS delete_qty, CAST(bb AS DOUBLE) AS best_bid, CAST(ba AS DOUBLE) AS best_ask FROM n JOIN st USING (series, cell)""")
def l3_book(spark: SparkSession, sf: str) -> DataFrame:
    """Order-by-order book: state and counters per hour, with permanent eviction beyond 30 levels a side."""
    rows = levels(spark, sf).withColumns({"order_id": F.concat(F.lit("o"), F.pmod("seq", F.lit(37)).cast("string")), "action": F.when(F.pmod("quantity", F.lit(5)) == 0, "delete").otherwise("set"), "event_id": F.col("seq"), "row_idx": F.lit(0), "price": F.col("price").cast("double"), "quantity": F.col("quantity").cast("double")})
    return K.l3_features(rows.select("series", "ts", "event_id", "row_idx", "is_snapshot", "order_id", "side", "price", "quantity", "action"), "series", HOUR, 30).withColumn("imbalance", F.round("imbalance", 6))


@P.add(f"""WITH {QUOTE}, s AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY series ORDER BY ts, seq)) / 1000.0::DOUBLE AS stale FROM quote)
SELECT series, seq, coalesce(bid > 0 AND bid < ask AND stale <= 3600000 AND k >= 800000.0 / greatest(ask, 1e-12) AND 99 - k >= 800000.0 / greatest(ask, 1e-12), false) AS able FROM s""")
def liquidity_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes whose both sides hold what a notional buys, and are fresh: age is the time since the series' last quote."""
    rows = T.neighbours(quotes(spark, sf), ["series"], ["ts", "seq"], ["ts"], 7 * DAY)
    c = F.col
    able = S.capacity(c("bid").cast("double"), c("ask").cast("double"), c("k"), 99 - c("k"), 800_000.0, (c("ts") - c("lag_ts")) / 1000.0, 3_600_000.0)
    return rows.select("series", "seq", able.alias("able"))
