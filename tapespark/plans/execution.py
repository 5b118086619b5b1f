"""Decoders, ledgers, equity, backtests and position paths on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ledgers as L
from ..operators import temporal as T
from .base import BARS, HOUR, SEG, Plans, average_sql, bars, r6, table

P = Plans()
QUERIES, SQL = P.QUERIES, P.SQL


def hazards(spark: SparkSession, sf: str) -> DataFrame:
    """bars with made-up hazards from their prices; execution is valid where the row is observed."""
    rows = bars(spark, sf)
    return rows.withColumns({f"h{i}": F.pmod(F.col(c), F.lit(97)) / 97.0 for i, c in enumerate(("open", "high", "low", "close"))} | {"valid": F.col("observed"), "bid": F.col("last_bid"), "ask": F.col("last_ask")})


HAZARDS = BARS + ", hz AS (SELECT *, open % 97 / 97.0::DOUBLE AS h0, high % 97 / 97.0::DOUBLE AS h1, low % 97 / 97.0::DOUBLE AS h2, close % 97 / 97.0::DOUBLE AS h3, row_number() OVER (PARTITION BY series, segment_id ORDER BY bar) AS n FROM bars)"
DECODED = HAZARDS + """, dec(series, segment_id, n, bar, action, position) AS (
  SELECT series, segment_id, 0::BIGINT, 0::BIGINT, 0, 0 FROM hz GROUP BY ALL
  UNION ALL SELECT z.series, z.segment_id, z.n, z.bar, a.act, CASE a.act WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE d.position END
  FROM dec d JOIN hz z ON z.series = d.series AND z.segment_id = d.segment_id AND z.n = d.n + 1,
  LATERAL (SELECT CASE WHEN NOT z.observed THEN 0 WHEN d.position = 0 AND greatest(z.h0, z.h1) >= 0.6 THEN CASE WHEN z.h0 >= z.h1 THEN 1 ELSE 2 END WHEN d.position = 1 AND z.h2 >= 0.6 THEN 3 WHEN d.position = -1 AND z.h3 >= 0.6 THEN 4 ELSE 0 END AS act) a)"""


@P.add(f"WITH RECURSIVE {DECODED} SELECT series, segment_id, bar, CAST(action AS INTEGER) AS action, CAST(position AS INTEGER) AS position FROM dec WHERE n > 0")
def decode_actions(spark: SparkSession, sf: str) -> DataFrame:
    return L.decode(hazards(spark, sf), SEG, "bar", 0.6)


LIKELIEST = DECODED.replace("d.position = 0 AND greatest(z.h0, z.h1) >= 0.6", "d.position = 0 AND z.h0 + z.h1 > 0 AND greatest(z.h0, z.h1) * (1 - exp(-(z.h0 + z.h1))) / nullif(z.h0 + z.h1, 0) > exp(-(z.h0 + z.h1))").replace("z.h2 >= 0.6", "z.h2 > ln(2)").replace("z.h3 >= 0.6", "z.h3 > ln(2)")


@P.add(f"WITH RECURSIVE {LIKELIEST} SELECT series, segment_id, bar, CAST(action AS INTEGER) AS action, CAST(position AS INTEGER) AS position FROM dec WHERE n > 0")
def decode_likeliest(spark: SparkSession, sf: str) -> DataFrame:
    """The decoder without a threshold: the likeliest event of the hazards."""
    return L.decode(hazards(spark, sf), SEG, "bar")


def acted(spark: SparkSession, sf: str) -> DataFrame:
    rows = hazards(spark, sf)
    return L.decode(rows, SEG, "bar", 0.6).drop("position").join(rows.select(*SEG, "bar", "bid", "ask", "valid"), [*SEG, "bar"])


@P.add(f"""WITH RECURSIVE {DECODED}, a AS (SELECT d.*, b.last_bid AS bid, b.last_ask AS ask, last_value(d.bar) OVER w AS z_bar, last_value(b.last_bid) OVER w AS z_bid, last_value(b.last_ask) OVER w AS z_ask FROM dec d JOIN bars b USING (series, segment_id, bar) WHERE n > 0 WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT *, lead(bar) OVER w AS x_bar, lead(bid) OVER w AS x_bid, lead(ask) OVER w AS x_ask FROM a WHERE action > 0 WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar))
SELECT series, segment_id, bar AS entry_at, coalesce(x_bar, z_bar) AS exit_at, CASE WHEN action = 1 THEN 1 ELSE -1 END AS side,
  (CASE WHEN action = 1 THEN coalesce(x_bid, z_bid) - ask - 2 ELSE bid - coalesce(x_ask, z_ask) - 2 END - 6)::DOUBLE AS net_ticks, x_bar IS NULL AS terminal FROM p WHERE action IN (1, 2)""")
def action_ledger(spark: SparkSession, sf: str) -> DataFrame:
    out = L.action_ledger(acted(spark, sf), SEG, "bar", 1.0, 3.0, 1.0)
    return out.select(*SEG, "entry_at", "exit_at", "side", "net_ticks", "terminal")


@P.add(f"""WITH RECURSIVE {DECODED}, a AS (SELECT d.*, b.last_bid AS bid, b.last_ask AS ask, b.observed FROM dec d JOIN bars b USING (series, segment_id, bar) WHERE n > 0),
c AS (SELECT *, sum(CASE WHEN action IN (2, 3) THEN bid - 4 WHEN action IN (1, 4) THEN -(ask + 4) ELSE 0 END) OVER w AS cash FROM a WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT *, coalesce(last_value(CASE WHEN observed THEN cash + CASE WHEN position > 0 THEN bid WHEN position < 0 THEN -ask ELSE 0 END END IGNORE NULLS) OVER (PARTITION BY series, segment_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS equity FROM c)
SELECT series, bar, CAST(cash AS DOUBLE) AS cash, CAST(equity AS DOUBLE) AS equity, CAST(equity - coalesce(lag(equity) OVER (PARTITION BY series, segment_id ORDER BY bar), 0) AS DOUBLE) AS reward FROM e""")
def env_equity(spark: SparkSession, sf: str) -> DataFrame:
    return L.equity(acted(spark, sf), SEG, "bar", 3.0, 1.0).select("series", "bar", "cash", "equity", "reward")


@P.add(f"""WITH RECURSIVE {DECODED}, a AS (SELECT d.*, b.last_bid AS bid, b.last_ask AS ask, b.observed FROM dec d JOIN bars b USING (series, segment_id, bar) WHERE n > 0),
s AS (SELECT series, segment_id, sum(CASE WHEN action IN (2, 3) THEN bid - 4 WHEN action IN (1, 4) THEN -(ask + 4) ELSE 0 END) AS cash, arg_max(position, bar) AS position, arg_max(bid, bar) FILTER (observed) AS bid, arg_max(ask, bar) FILTER (observed) AS ask FROM a GROUP BY ALL)
SELECT series, segment_id, CAST(cash + CASE WHEN position > 0 THEN bid - 4 WHEN position < 0 THEN -(ask + 4) ELSE 0 END AS DOUBLE) AS net FROM s""")
def env_final(spark: SparkSession, sf: str) -> DataFrame:
    """Net cash of every segment after the forced close."""
    return L.final_cash(acted(spark, sf), SEG, "bar", 3.0, 1.0)


@P.add(f"""WITH {HAZARDS} SELECT series, bar, CASE WHEN observed THEN CASE WHEN gap_rows = 0 AND ticks % 3 = 0 THEN CASE WHEN h0 >= h1 THEN 0 ELSE 1 END WHEN ticks % 3 = 1 THEN 2 ELSE 3 END END AS choice FROM hz""")
def masked_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """The best event among those that a position allows."""
    position = F.when(F.pmod("ticks", F.lit(3)) == 0, 0).when(F.pmod("ticks", F.lit(3)) == 1, 1).otherwise(-1)
    mask = L.allowed(position, F.col("observed"))
    return hazards(spark, sf).select("series", "bar", L.best_allowed([F.col(f"h{i}") for i in range(4)], mask).alias("choice"))


def averaged_sides(spark: SparkSession, sf: str) -> DataFrame:
    avg = lambda c: T.weighted_average(F.col(c), F.col("weight"), SEG, ["bar"], 12)
    return hazards(spark, sf).withColumns({"avg_bid": avg("last_bid"), "avg_ask": avg("last_ask")})


CROSSED = HAZARDS + f""", av AS (SELECT *, {average_sql('last_bid', 'weight', 12)} AS avg_bid, {average_sql('last_ask', 'weight', 12)} AS avg_ask FROM hz),
cut0 AS (SELECT series, segment_id, max(CASE WHEN observed THEN n END) AS last_n, count(CASE WHEN observed THEN 1 END) AS seen FROM av GROUP BY ALL),
m AS (SELECT av.*, c.last_n, CAST(sign(last_bid - avg_bid) AS INTEGER) AS sl, CAST(sign(last_ask - avg_ask) AS INTEGER) AS ss, lead(observed) OVER w AS fill, lead(first_bid) OVER w AS nb, lead(first_ask) OVER w AS na, lead(bar) OVER w AS nbar, lead(CAST(sign(last_bid - avg_bid) AS INTEGER)) OVER w AS nsl, lead(CAST(sign(last_ask - avg_ask) AS INTEGER)) OVER w AS nss
  FROM av JOIN cut0 c USING (series, segment_id) WHERE seen >= 2 AND last_n >= 3 AND n <= last_n WINDOW w AS (PARTITION BY series, segment_id ORDER BY n)),
st(series, segment_id, n, pos, entry, price, side, cnt, pend, x_at, x_price, x_pos, x_entry, x_in, x_cnt, term) AS (
  SELECT DISTINCT series, segment_id, 0::BIGINT, 0, 0::BIGINT, 0::DOUBLE, 0, 0, false, NULL::BIGINT, NULL::DOUBLE, NULL::INTEGER, NULL::BIGINT, NULL::DOUBLE, NULL::INTEGER, false FROM m
  UNION ALL
  SELECT m.series, m.segment_id, m.n,
    CASE WHEN m.n = m.last_n THEN 0 WHEN m.n > m.last_n - 2 THEN s.pos WHEN s.pos <> 0 THEN CASE WHEN q.closing AND m.fill THEN 0 ELSE s.pos END WHEN m.fill AND greatest(h0, h1) >= 0.6 THEN CASE WHEN h0 >= h1 THEN 1 ELSE -1 END ELSE 0 END,
    CASE WHEN s.pos = 0 AND m.fill AND greatest(h0, h1) >= 0.6 AND m.n <= m.last_n - 2 THEN m.nbar ELSE s.entry END,
    CASE WHEN s.pos = 0 AND m.fill AND greatest(h0, h1) >= 0.6 AND m.n <= m.last_n - 2 THEN CASE WHEN h0 >= h1 THEN m.na + 1 ELSE m.nb - 1 END ELSE s.price END,
    CASE WHEN s.pos <> 0 THEN CASE WHEN q.now <> 0 AND NOT s.pend THEN q.now ELSE s.side END WHEN h0 >= h1 THEN m.nsl ELSE m.nss END,
    CASE WHEN s.pos <> 0 THEN q.c ELSE 0 END, CASE WHEN s.pos <> 0 THEN q.closing AND NOT m.fill ELSE false END,
    CASE WHEN s.pos <> 0 AND m.n = m.last_n THEN m.bar WHEN s.pos <> 0 AND m.n <= m.last_n - 2 AND q.closing AND m.fill THEN m.nbar END,
    CASE WHEN s.pos <> 0 AND m.n = m.last_n THEN CASE WHEN s.pos > 0 THEN m.first_bid - 1 ELSE m.first_ask + 1 END WHEN s.pos > 0 THEN m.nb - 1 ELSE m.na + 1 END,
    s.pos, s.entry, s.price, CASE WHEN m.n = m.last_n THEN s.cnt ELSE q.c END, m.n = m.last_n
  FROM st s JOIN m ON m.series = s.series AND m.segment_id = s.segment_id AND m.n = s.n + 1,
  LATERAL (SELECT CASE WHEN s.pos > 0 THEN m.sl ELSE m.ss END AS now, CASE WHEN m.n > m.last_n - 2 THEN s.cnt ELSE s.cnt + CASE WHEN NOT s.pend AND s.side <> 0 AND (CASE WHEN s.pos > 0 THEN m.sl ELSE m.ss END) NOT IN (0, s.side) THEN 1 ELSE 0 END END AS c,
    s.pend OR s.cnt + CASE WHEN s.side <> 0 AND (CASE WHEN s.pos > 0 THEN m.sl ELSE m.ss END) NOT IN (0, s.side) THEN 1 ELSE 0 END >= 1 AS closing) q)"""


@P.add(f"""WITH RECURSIVE {CROSSED} SELECT series, segment_id, x_entry AS entry_at, x_at AS exit_at, x_pos AS side, x_in AS entry_price, x_price AS exit_price, (x_price - x_in) * x_pos - 6 AS net_ticks, x_cnt AS crossings, term AS terminal FROM st WHERE x_at IS NOT NULL""")
def vwap_cross_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Opens on hazards, closes at the first crossing of the average."""
    return L.cross_ledger(averaged_sides(spark, sf), SEG, "bar", 1, 0.6, 1.0, 3.0, 1.0)


@P.add(f"""WITH RECURSIVE {CROSSED.replace(">= 1 AS closing", ">= 2 AS closing")} SELECT series, segment_id, x_entry AS entry_at, x_at AS exit_at, x_pos AS side, x_in AS entry_price, x_price AS exit_price, (x_price - x_in) * x_pos - 6 AS net_ticks, x_cnt AS crossings, term AS terminal FROM st WHERE x_at IS NOT NULL""")
def vwap_cross_second(spark: SparkSession, sf: str) -> DataFrame:
    """The variant that waits for the second crossing."""
    return L.cross_ledger(averaged_sides(spark, sf), SEG, "bar", 2, 0.6, 1.0, 3.0, 1.0)


def curves(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda c: F.pmod(F.col(c), F.lit(101)) / 101.0
    return bars(spark, sf).where("last_bid > 0").select(*SEG, "bar", F.col("observed").alias("valid"), F.col("last_bid").alias("bid"), F.col("last_ask").alias("ask"), part("open").alias("long_back"), part("high").alias("long_fwd"), part("low").alias("short_back"), part("close").alias("short_fwd"))


CURVES = BARS + ", cv AS (SELECT series, segment_id, bar, observed AS valid, CAST(last_bid AS DOUBLE) AS bid, CAST(last_ask AS DOUBLE) AS ask, open % 101 / 101.0::DOUBLE AS lb, high % 101 / 101.0::DOUBLE AS lf, low % 101 / 101.0::DOUBLE AS sb, close % 101 / 101.0::DOUBLE AS sf, row_number() OVER w AS n, bar - lag(bar) OVER w AS step, coalesce(lag(segment_id) OVER w <> segment_id, false) AS cut FROM bars WHERE last_bid > 0 WINDOW w AS (PARTITION BY series ORDER BY bar))"


@P.add(f"""WITH RECURSIVE {CURVES}, bt(series, n, state, entry, price, o_state, o_entry, o_price, o_exit, o_leave, lost) AS (
  SELECT DISTINCT series, 0::BIGINT, 0, 0::BIGINT, 0::DOUBLE, 0, 0::BIGINT, 0::DOUBLE, NULL::BIGINT, NULL::DOUBLE, false FROM cv
  UNION ALL SELECT c.series, c.n, z.st, CASE WHEN z.opened THEN c.bar ELSE b.entry END, CASE WHEN z.opened THEN CASE WHEN z.st = 1 THEN c.ask ELSE c.bid END ELSE b.price END, b.state, b.entry, b.price,
    CASE WHEN z.closed THEN c.bar END, CASE WHEN z.closed THEN CASE WHEN b.state = 1 THEN c.bid ELSE c.ask END END, z.reset AND b.state <> 0
  FROM bt b JOIN cv c ON c.series = b.series AND c.n = b.n + 1,
  LATERAL (SELECT *, CASE WHEN NOT c.valid THEN s0 WHEN s0 = 0 THEN CASE WHEN greatest(le, se) > 0 THEN CASE WHEN le >= se THEN 1 ELSE -1 END ELSE 0 END WHEN (s0 = 1 AND c.lb > 0.6) OR (s0 = -1 AND c.sb > 0.6) THEN 0 ELSE s0 END AS st,
      c.valid AND s0 = 0 AND greatest(le, se) > 0 AS opened, c.valid AND ((s0 = 1 AND c.lb > 0.6) OR (s0 = -1 AND c.sb > 0.6)) AS closed
    FROM (SELECT c.cut OR coalesce(c.step > {4 * HOUR}, false) AS reset, CASE WHEN c.cut OR coalesce(c.step > {4 * HOUR}, false) THEN 0 ELSE b.state END AS s0, CASE WHEN c.lb <= 0.6 THEN (c.lf - 0.5) / 0.5 ELSE -1e9 END AS le, CASE WHEN c.sb <= 0.6 THEN (c.sf - 0.5) / 0.5 ELSE -1e9 END AS se)) z)
SELECT series, o_state AS side, o_entry AS entry_at, o_exit AS exit_at, o_price AS entry_price, o_leave AS exit_price, round(CASE WHEN o_exit IS NOT NULL THEN 10000 * (CASE WHEN o_state = 1 THEN o_leave / o_price ELSE o_price / o_leave END - 1) - 10 END, 5) AS net_bps, lost AS unresolved FROM bt WHERE o_exit IS NOT NULL OR lost
UNION ALL SELECT series, state, entry, NULL, price, NULL, NULL, true FROM (SELECT *, max(n) OVER (PARTITION BY series) AS top FROM bt) WHERE n = top AND state <> 0""")
def curve_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Trades of the four-curve rule per venue, with resets at segments and gaps."""
    out = L.curve_backtest(curves(spark, sf), ["series"], "bar", "segment_id", (0.6, 0.5, 0.6, 0.5), 10.0, 4 * HOUR)
    return out.select("series", "side", "entry_at", "exit_at", "entry_price", "exit_price", r6(F.col("net_bps"), "net_bps", 5), "unresolved")


@P.add(f"""WITH {CURVES} SELECT series, bar, CASE WHEN n % 3 = 0 THEN CASE WHEN greatest(CASE WHEN lb <= 0.6 THEN (lf - 0.5) / 0.5 ELSE -1e9 END, CASE WHEN sb <= 0.6 THEN (sf - 0.5) / 0.5 ELSE -1e9 END) <= 0 THEN 'skip' WHEN CASE WHEN lb <= 0.6 THEN (lf - 0.5) / 0.5 ELSE -1e9 END >= CASE WHEN sb <= 0.6 THEN (sf - 0.5) / 0.5 ELSE -1e9 END THEN 'open_long' ELSE 'open_short' END
  WHEN n % 3 = 1 THEN CASE WHEN lb > 0.6 THEN 'close_long' ELSE 'hold' END ELSE CASE WHEN sb > 0.6 THEN 'close_short' ELSE 'hold' END END AS action FROM cv""")
def curve_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The four-curve rule for given positions."""
    n = F.row_number().over(Window.partitionBy("series").orderBy("bar"))
    rows = curves(spark, sf).withColumn("position", F.when(F.pmod(n, F.lit(3)) == 0, 0).when(F.pmod(n, F.lit(3)) == 1, 1).otherwise(-1))
    return rows.select("series", "bar", L.decide(F.col("position"), (0.6, 0.5, 0.6, 0.5)).alias("action"))


@P.add(f"""WITH RECURSIVE {HAZARDS}, lz AS (SELECT series, segment_id, bar, n - 1 AS i, count(*) OVER (PARTITION BY series, segment_id) AS n, first_bid, first_ask, lead(first_bid) OVER w AS nb, lead(first_ask) OVER w AS na, observed, CASE WHEN h0 > 0.6 THEN 1 WHEN h1 > 0.6 THEN -1 ELSE 0 END AS want FROM hz WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar)),
ls(series, segment_id, i, side, cash, swaps, seen, run, delay) AS (
  SELECT series, segment_id, i, 1, CAST(-(na + 4) AS DOUBLE), 0, 0, 0, -1 FROM lz WHERE i = 0 AND n >= 3
  UNION ALL
  SELECT z.series, z.segment_id, z.i, CASE WHEN q.turn THEN z.want ELSE s.side END, s.cash + CASE WHEN q.turn THEN 2 * CASE WHEN s.side > 0 THEN z.nb - 4 ELSE -(z.na + 4) END ELSE 0 END, s.swaps + CASE WHEN q.turn THEN 1 ELSE 0 END,
    CASE WHEN q.turn OR NOT q.other THEN 0 ELSE z.want END, CASE WHEN q.turn OR NOT q.other THEN 0 ELSE q.r END, CASE WHEN q.turn AND s.delay < 0 THEN CAST(z.i AS INTEGER) ELSE s.delay END
  FROM ls s JOIN lz z ON z.series = s.series AND z.segment_id = s.segment_id AND z.i = s.i + 1 AND z.i <= z.n - 3,
  LATERAL (SELECT *, other AND r >= 2 AND s.swaps < 3 AS turn FROM (SELECT z.observed AND z.want <> 0 AND z.want <> s.side AS other, CASE WHEN z.want = s.seen THEN s.run + 1 ELSE 1 END AS r)) q),
fin AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY series, segment_id ORDER BY i DESC) = 1)
SELECT f.series, f.segment_id, a.bar AS entry_at, 1 AS initial_side, CAST(f.side AS INTEGER) AS final_side, CAST(f.swaps AS INTEGER) AS swaps, CAST(f.delay AS INTEGER) AS first_delay, f.cash + CASE WHEN f.side > 0 THEN z.first_bid - 4 ELSE -(z.first_ask + 4) END AS pnl
FROM fin f JOIN lz a ON a.series = f.series AND a.segment_id = f.segment_id AND a.i = 0 JOIN lz z ON z.series = f.series AND z.segment_id = f.segment_id AND z.i = z.n - 1""")
def live_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Positions that turn on confirmed evidence, each segment taken as one event."""
    rows = hazards(spark, sf).withColumns({"desired": F.when(F.col("h0") > 0.6, 1).when(F.col("h1") > 0.6, -1).otherwise(0), "usable": F.col("observed"), "side": F.lit(1)})
    return L.live_swaps(rows, SEG, "bar", 2, 3, 4.0)


@P.add(f"""WITH {BARS}, p AS (SELECT *, first_value(last_ask) OVER w AS entry, row_number() OVER w - 1 AS age FROM bars WHERE last_bid > 0 WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar)),
g AS (SELECT *, CASE WHEN entry > 0 THEN (last_bid / entry - 1) * 10000 ELSE 0 END AS pnl FROM p),
r AS (SELECT *, greatest(max(pnl) OVER w, 0) AS mfe, least(min(pnl) OVER w, 0) AS mae FROM g WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT series, bar, round(ln(1 + age * 3600.0), 6) AS age_log, round(pnl, 4) AS pnl_bps, round(mfe, 4) AS mfe, round(mae, 4) AS mae, round(mfe - pnl, 4) AS giveback FROM r""")
def position_path(spark: SparkSession, sf: str) -> DataFrame:
    """Features of a long held from the start of each segment."""
    rows = bars(spark, sf).where("last_bid > 0").withColumns({"bid": F.col("last_bid"), "ask": F.col("last_ask")})
    rows = rows.withColumn("entry", F.first("last_ask").over(T.over(SEG, ["bar"])))
    out = L.position_path(rows, SEG, "bar", 3600.0, F.lit(1), F.col("entry"))
    return out.select("series", "bar", r6(F.col("age_log"), "age_log"), *[r6(F.col(c), c, 4) for c in ("pnl_bps", "mfe", "mae", "giveback")])


@P.add(f"""WITH {BARS}, s AS (SELECT quantile_cont(CASE WHEN close > 0 THEN close::DOUBLE END, 0.95) AS a, quantile_cont(CASE WHEN high > 0 THEN high::DOUBLE END, 0.95) AS b, quantile_cont(CASE WHEN low > 0 THEN low::DOUBLE END, 0.95) AS c FROM bars WHERE observed),
n AS (SELECT series, bar, close / a AS x, high / b AS y, low / c AS z FROM bars, s)
SELECT series, bar, CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END AS dominant, round(greatest(x, y, z), 6) AS dominant_score FROM n""")
def scaled_horizons(spark: SparkSession, sf: str) -> DataFrame:
    """Scores over their upper quantile, and the dominant one of a row."""
    rows = bars(spark, sf).select("series", "bar", "observed", *[F.col(c).cast("double").alias(c) for c in ("close", "high", "low")])
    out = L.scaled_horizons(rows, ["close", "high", "low"], F.col("observed"))
    return out.select("series", "bar", "dominant", r6(F.col("dominant_score"), "dominant_score"))


@P.add(f"""WITH {BARS}, p AS (SELECT series, segment_id, bar // {HOUR} AS place, close, observed FROM bars), e AS (SELECT series, segment_id, arg_min(place, (close, place)) AS entry FROM p WHERE observed GROUP BY ALL),
s AS (SELECT e.series, e.segment_id, e.entry, p.place, p.close AS v, coalesce(p.close >= lag(p.close) OVER w AND p.close > lead(p.close) OVER w, false) AS peak FROM e JOIN p ON p.series = e.series AND p.segment_id = e.segment_id AND p.place > e.entry AND p.place <= e.entry + 12 WINDOW w AS (PARTITION BY e.series, e.segment_id ORDER BY p.place)),
b AS (SELECT series, segment_id, v AS top, place AS best FROM s QUALIFY row_number() OVER (PARTITION BY series, segment_id ORDER BY peak DESC, v DESC, place) = 1)
SELECT s.series, s.segment_id, s.entry AS place, coalesce(max(CASE WHEN v < top * 0.75 AND s.place < best THEN s.place END) + 1, min(s.place)) AS close_start, coalesce(min(CASE WHEN v < top * 0.75 AND s.place > best THEN s.place END), max(s.place) + 1) AS close_end, best AS close_peak, top AS close_score
FROM s JOIN b USING (series, segment_id) WHERE top > 0 GROUP BY s.series, s.segment_id, s.entry, best, top""")
def oracle_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Entries where the close is highest in its segment, with the zone in which the open peaks afterwards."""
    rows = bars(spark, sf).withColumn("place", (F.col("bar") / HOUR).cast("long"))
    entries = rows.where("observed").groupBy(*SEG).agg(F.min_by("place", F.struct("close", "place")).alias("place"))
    return L.close_zones(entries, rows, SEG, "place", "close", 12, 0.75)


@P.add("""WITH t AS (SELECT l_orderkey AS k, l_extendedprice - 20000 AS pnl, f.fee, s.slip FROM lineitem, (SELECT unnest([0.0, 15.0])::DOUBLE AS fee) f, (SELECT unnest([0.0, 1.0, 5.0])::DOUBLE AS slip) s)
SELECT fee, slip, count(*) AS trades, round(avg(pnl - 2 * (fee + slip)), 4) AS mean, count(CASE WHEN pnl - 2 * (fee + slip) > 0 THEN 1 END) AS wins FROM t GROUP BY ALL""")
def stress_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Profit under a grid of fees and slippages: the grid is an array on the row, not a join."""
    grid = F.array(*[F.struct(F.lit(f).alias("fee"), F.lit(s).alias("slip")) for f in (0.0, 15.0) for s in (0.0, 1.0, 5.0)])
    rows = table(spark, sf, "lineitem").select((F.col("l_extendedprice") - 20000).alias("pnl"), F.explode(grid).alias("g"))
    net = F.col("pnl") - 2 * (F.col("g.fee") + F.col("g.slip"))
    return rows.groupBy(F.col("g.fee").alias("fee"), F.col("g.slip").alias("slip")).agg(F.count("*").alias("trades"), F.round(F.avg(net), 4).alias("mean"), F.count_if(net > 0).alias("wins"))
