"""Frames, versions, grids, summaries and soft labels on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bars as B
from ..operators import frames as R
from ..operators import ledgers as L
from ..operators import scores as C
from ..operators import temporal as T
from ..sources import files
from .base import BARS, DAY, HOUR, QUOTE, SECOND, SEG, TICK, Plans, average_sql, averaged, averaged_sql, bars, quotes, r6, table, ticks
from .events import FILLS, FOUND, fills, found_events, sided, sided_sql
from .execution import CROSSED, DECODED, acted, averaged_sides
from .labels import LINES, PEAK_RUN, RUN, RUNS, peaks_sql, placed, quoted, run_rows

P = Plans()
QUERIES, SQL = P.QUERIES, P.SQL


@P.add(f"""WITH {QUOTE}, bounds AS (SELECT series, min(ts) // {HOUR} AS lo, max(ts) // {HOUR} AS hi FROM quote GROUP BY series), grid AS (SELECT series, h FROM bounds, LATERAL (SELECT unnest(range(lo, hi + 1)) AS h)),
lasts AS (SELECT series, ts // {HOUR} AS h, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask, arg_max(k, seq) AS k, max(ts) AS seen FROM quote GROUP BY ALL),
st AS (SELECT g.series, g.h, last_value(l.bid IGNORE NULLS) OVER p AS bid, last_value(l.ask IGNORE NULLS) OVER p AS ask, last_value(l.k IGNORE NULLS) OVER p AS k, last_value(l.seen IGNORE NULLS) OVER p AS seen FROM grid g LEFT JOIN lasts l ON g.series = l.series AND g.h = l.h WINDOW p AS (PARTITION BY g.series ORDER BY g.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (bid + ask) * 0.5::DOUBLE AS mid, coalesce(bid > 0 AND bid < ask AND h * {HOUR} - seen <= {2 * HOUR}, false) AS valid FROM st)
SELECT series, h, valid, round(coalesce(CASE WHEN bid > 0 THEN 10000 * (ask - bid) / mid END, 0), 5) AS spread_bps, round(ln(1 + coalesce(k, 0)), 6) AS log_qty, {', '.join(f'round(coalesce(CASE WHEN valid AND lag(valid, {k}) OVER w THEN 10000 * (mid / lag(mid, {k}) OVER w - 1) END, 0), 4) AS return_{k}_bps' for k in (1, 5))} FROM f WINDOW w AS (PARTITION BY series ORDER BY h)""")
def historical_day(spark: SparkSession, sf: str) -> DataFrame:
    """Frames from archives: the state of earlier cells on a dense grid, validity by age, and returns between valid cells."""
    q = quotes(spark, sf).withColumn("h", F.floor(F.col("ts") / HOUR))
    grid = T.grid(q.groupBy("series").agg(F.min("h").alias("lo"), F.max("h").alias("hi")), ["series"], "lo", "hi", 1, "h")
    lasts = q.groupBy("series", "h").agg(F.max_by(F.struct("bid", "ask", "k"), "seq").alias("s"), F.max("ts").alias("at"))
    rows = T.forward_fill(grid.join(lasts, ["series", "h"], "left"), ["series"], ["h"], ["s", "at"])
    w = Window.partitionBy("series").orderBy("h")
    rows = rows.withColumns({"s": F.lag("s").over(w), "at": F.lag("at").over(w)}).select("series", "h", "s.*", "at")
    rows = rows.withColumns({"mid": (F.col("bid") + F.col("ask")) * 0.5, "valid": F.coalesce((F.col("bid") > 0) & (F.col("bid") < F.col("ask")) & (F.col("h") * HOUR - F.col("at") <= 2 * HOUR), F.lit(False))})
    back = R.grid_returns(rows, ["series"], "h", "mid", "valid", (1, 5))
    return rows.select("series", "h", "valid", r6(F.coalesce(F.when(F.col("bid") > 0, S.spread_bps(F.col("bid").cast("double"), F.col("ask").cast("double"))), F.lit(0.0)), "spread_bps", 5), r6(F.log1p(F.coalesce("k", F.lit(0))), "log_qty"), *[r6(x, n, 4) for n, x in back.items()])


VALUES = ("book_valid", "mid", "spread_bps", "bid_log_qty")


@P.add(f"""WITH {QUOTE}, b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM quote), grid AS (SELECT v AS series, t AS tick FROM b, LATERAL (SELECT unnest(range(lo // {6 * HOUR} * {6 * HOUR} + {6 * HOUR}, hi + 1, {6 * HOUR})) AS t), (SELECT unnest(range(9)) AS v)),
s AS (SELECT g.series, g.tick, CAST(q.bid AS DOUBLE) AS bid, CAST(q.ask AS DOUBLE) AS ask, q.k FROM grid g ASOF LEFT JOIN quote q ON g.series = q.series AND g.tick >= q.ts), f AS (SELECT *, coalesce(bid > 0 AND bid < ask, false) AS ok FROM s)
SELECT tick, {', '.join(f"coalesce(max(CASE WHEN series = {i} THEN CAST(ok AS DOUBLE) END), 0) AS {v}__book_valid, coalesce(max(CASE WHEN series = {i} AND ok THEN (bid + ask) * 0.5 END), 0) AS {v}__mid, round(coalesce(max(CASE WHEN series = {i} AND ok THEN (ask - bid) * 10000 / ((bid + ask) * 0.5) END), 0), 5) AS {v}__spread_bps, round(coalesce(max(CASE WHEN series = {i} THEN ln(1 + coalesce(k, 0)) END), 0), 6) AS {v}__bid_log_qty" for i, v in enumerate(S.VENUES))} FROM f GROUP BY tick""".replace("THEN CAST(ok AS DOUBLE) END), 0)", "THEN CAST(CAST(ok AS INTEGER) AS DOUBLE) END), 0)"))
def market_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Wide frames: the venues' features of each tick in a fixed order of columns."""
    q = quotes(spark, sf)
    step = 6 * HOUR
    bounds = q.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).withColumn("lo", S.bucket(F.col("lo"), step) + step)
    grid = T.grid(bounds, [], "lo", "hi", step, "tick").withColumn("series", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    st = T.asof_last(grid, q, ["series"], ["bid", "ask", "k"], at="tick", order=["seq"])
    st = st.select("tick", F.element_at(F.array(*map(F.lit, S.VENUES)), (F.col("series") + 1).cast("int")).alias("venue"), F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"), F.col("k").cast("double").alias("bid_qty"), F.col("k").cast("double").alias("ask_qty"), ((F.col("tick") - F.col("asof_ts")) / 1000.0).alias("stale_ms"))
    out = R.wide(R.venue_features(st), "tick", S.VENUES, VALUES)
    return out.select("tick", *[r6(F.col(c), c, 5) if c.endswith("spread_bps") else r6(F.col(c), c) if c.endswith("qty") else F.col(c) for c in out.columns if c != "tick"])


NEAR, FAR = (5, 10, 15, 30), (60, 120, 300)
HS = NEAR + FAR


@P.add(f"""WITH {sided_sql(*HS)}, g AS (SELECT series, segment_id, event, bar, observed, {', '.join(f'avg_{h} - mid AS g{h}' for h in HS)} FROM sided),
w AS (SELECT series, bar, {', '.join(f'coalesce(avg(CASE WHEN observed THEN g{h} END) OVER e, g{h}) AS w{h}' for h in HS)} FROM g WINDOW e AS (PARTITION BY series, segment_id, event ORDER BY bar ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT series, bar, round(({' + '.join(f'sign(w{h})' for h in HS)}) / 7.0, 6) AS consensus, round(({' + '.join(f'w{h}' for h in HS)}) / 7.0, 3) AS gap_mean, round(({' + '.join(f'w{h}' for h in FAR)}) / 3.0 - ({' + '.join(f'w{h}' for h in NEAR)}) / 4.0, 3) AS gap_long_short FROM w""")
def hierarchy_features(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics across averages, over trailing rows that stay within the event."""
    rows = sided(spark, sf, *HS)
    rows = rows.withColumns({f"g{h}": F.col(f"avg_{h}") - F.col("mid") for h in HS})
    rows = R.entry_windows(rows, [*SEG, "event"], "bar", [f"g{h}" for h in HS], F.col("observed"), (3,))
    out = R.hierarchy([F.col(f"g{h}_w3") for h in HS], [F.col(f"g{h}_w3") for h in HS], HS, len(NEAR), len(NEAR))
    return rows.select("series", "bar", r6(out["consensus"], "consensus"), r6(out["gap_mean"], "gap_mean", 3), r6(out["gap_long_short"], "gap_long_short", 3))


@P.add(f"""WITH {TICK}, a AS (SELECT seq, px FROM tick WHERE seq % 10 <> 3), b AS (SELECT seq, px + CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS px FROM tick WHERE seq % 10 <> 4)
SELECT coalesce(a.seq, b.seq) AS seq, CASE WHEN b.seq IS NULL THEN 'left_only' WHEN a.seq IS NULL THEN 'right_only' WHEN a.px = b.px THEN 'same' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.seq = b.seq""")
def version_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions on aligned keys: only in one, different or same."""
    t = ticks(spark, sf)
    digit = F.pmod("seq", F.lit(10))
    return R.compare(t.where(digit != 3).select("seq", "px"), t.where(digit != 4).select("seq", (F.col("px") + F.when(F.pmod("seq", F.lit(7)) == 0, 1).otherwise(0)).alias("px")), ["seq"], ["px"])


@P.add(f"""WITH {TICK}, c AS (SELECT (min(ts) + max(ts)) // 2 AS cut FROM tick) SELECT seq, ts, px FROM tick""")
def extend_frozen(spark: SparkSession, sf: str) -> DataFrame:
    """A frozen prefix and its extension, checked to agree where they overlap."""
    t = ticks(spark, sf).select("seq", "ts", "px")
    low, high = t.agg(F.min("ts"), F.max("ts")).first()
    return R.extended(t.where(F.col("ts") <= (low + high) // 2), t.where(F.col("ts") > low + (high - low) // 3), ["seq"], "ts", ["px"])


@P.add(f"""WITH RECURSIVE {DECODED}, a AS (SELECT count(*) AS ticks, {', '.join(f'count(CASE WHEN action = {k} THEN 1 END) AS action_{k}' for k in range(5))} FROM dec WHERE n > 0),
x AS (SELECT d.*, b.last_bid AS bid, b.last_ask AS ask FROM dec d JOIN bars b USING (series, segment_id, bar) WHERE n > 0 AND action > 0), p AS (SELECT *, lead(bar) OVER w AS xb, lead(bid) OVER w AS xbid, lead(ask) OVER w AS xask FROM x WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar)),
t AS (SELECT (xb - bar) / {SECOND} AS hold, (CASE WHEN action = 1 THEN xbid - ask ELSE bid - xask END)::DOUBLE AS pnl FROM p WHERE action IN (1, 2) AND xb IS NOT NULL)
SELECT a.*, s.* FROM a, (SELECT count(*) AS trades, round(avg(pnl), 4) AS mean, quantile_cont(pnl, 0.5) AS median, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, quantile_cont(hold, 0.5) AS hold_p50, round(quantile_cont(hold, 0.9), 3) AS hold_p90, max(hold)::DOUBLE AS hold_max FROM t) s""")
def policy_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of actions, profit and holding times of the closed trades."""
    a = acted(spark, sf)
    trades = L.action_ledger(a, SEG, "bar").where("NOT terminal").select(F.col("net_ticks").alias("pnl"), ((F.col("exit_at") - F.col("entry_at")) / float(SECOND)).alias("hold"))
    out = R.policy_summary(a, trades, range(5))
    return out.select(*[r6(F.col(c), c, d) if (d := {"mean": 4, "win_rate": 6, "hold_p90": 3}.get(c)) else F.col(c) for c in out.columns])


@P.add(f"""WITH {FOUND}, s AS (SELECT *, CASE WHEN "end" // {DAY} % 3 = 0 THEN 'a' ELSE 'b' END AS split, least(amplitude, 30000) AS gate FROM found)
SELECT split, count(*) AS events, count(DISTINCT "end" // {DAY}) AS days, count(CASE WHEN gated THEN 1 END) AS gated, round(count(CASE WHEN gated THEN 1 END) / count(DISTINCT "end" // {DAY}), 6) AS gated_per_day, round(quantile_cont(gate, 0.1), 4) AS gate_p10, round(quantile_cont(gate, 0.5), 4) AS gate_p50, round(quantile_cont(gate, 0.9), 4) AS gate_p90 FROM s GROUP BY split""")
def gate_rates(spark: SparkSession, sf: str) -> DataFrame:
    found = found_events(spark, sf).withColumn("gate", F.least("amplitude", F.lit(30_000.0)))
    split = F.when(F.pmod(F.floor(F.col("end") / DAY), F.lit(3)) == 0, "a").otherwise("b")
    out = R.gate_rates(found, split, "end", "gated", "gate", DAY)
    return out.select("split", "events", "days", "gated", r6(F.col("gated_per_day"), "gated_per_day"), *[r6(F.col(c), c, 4) for c in ("gate_p10", "gate_p50", "gate_p90")])


@P.add(f"""WITH {LINES}, t AS (SELECT a.*, sigma, lag(slope) OVER (PARTITION BY series, segment_id ORDER BY bar) AS p FROM ahead a JOIN v USING (series, segment_id, bar) WHERE sigma IS NOT NULL),
r AS (SELECT atan(slope * sqrt(6.0) / sigma) AS truth, atan(p * sqrt(6.0) / sigma) AS pred, sigma, fit AS line_end, CAST(actual AS DOUBLE) AS actual_end FROM t WHERE p IS NOT NULL), e AS (SELECT *, tan(pred) * sigma / sqrt(6.0) * 6 AS guess FROM r)
SELECT round(degrees(avg(abs(pred - truth))), 5) AS mae_degrees, round(1 - avg(abs(pred - truth)) / avg(abs(truth)), 6) AS gain_vs_zero, round(corr(pred, truth), 5) AS corr, round(avg(CASE WHEN abs(truth) >= radians(10) THEN CASE WHEN (pred < 0) = (truth < 0) THEN 1.0 ELSE 0.0 END END), 6) AS material_accuracy, round(avg(CASE WHEN abs(truth) >= radians(10) THEN 1.0 ELSE 0.0 END), 6) AS material_share,
  round(1 - avg(abs(guess - line_end)) / avg(abs(line_end)), 5) AS line_gain, round(1 - avg(abs(guess - actual_end)) / avg(abs(actual_end)), 5) AS actual_gain FROM e""")
def angle_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A persistence guess of the angle, measured."""
    rows = placed(spark, sf)
    rows = rows.withColumn("d", T.lag_delta(F.col("mid"), SEG, ["bar"]).cast("double"))
    sigma = T.full_rms(F.col("d"), SEG, ["bar"], 4)
    rows = rows.withColumns(C.line("mid", "place", SEG, ["bar"], 6) | {"sigma": F.when(sigma.isNotNull(), F.greatest(sigma, F.lit(100.0)))}).where("slope IS NOT NULL AND sigma IS NOT NULL")
    rows = rows.withColumn("p", F.lag("slope").over(Window.partitionBy(*SEG).orderBy("bar"))).where("p IS NOT NULL")
    rows = rows.select(C.angle(F.col("slope"), F.col("sigma"), 6.0).alias("truth"), C.angle(F.col("p"), F.col("sigma"), 6.0).alias("pred"), "sigma", F.col("end").alias("line_end"), F.col("actual").cast("double").alias("actual_end"))
    out = R.angle_metrics(rows, 6.0)
    return out.select(*[r6(F.col(c), c, 6 if c in ("gain_vs_zero", "material_accuracy", "material_share") else 5) for c in out.columns])


@P.add(f"""WITH {averaged_sql(60, 120, 300)}, g AS (SELECT *, avg_60 - mid AS gap, avg_120 - mid AS g120, avg_300 - mid AS g300, avg_120 - lag(avg_120) OVER w AS s120, avg_300 - lag(avg_300) OVER w AS s300, bar // {DAY} AS day, lead(first_bid) OVER w - last_ask AS long_pnl, last_bid - lead(first_ask) OVER w AS short_pnl FROM averaged WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar)),
r AS (SELECT * FROM g WHERE long_pnl IS NOT NULL), c AS (SELECT a, d, CAST(row_number() OVER (ORDER BY a, d) - 1 AS INTEGER) AS setting FROM (SELECT unnest([0.5, 1.0])::DOUBLE AS a), (SELECT unnest([0.0, 2000.0])::DOUBLE AS d)),
e AS (SELECT setting, day, gap <> 0 AND abs(gap) >= d AND ((CASE WHEN sign(g120) = sign(gap) THEN 1 ELSE 0 END + CASE WHEN sign(g300) = sign(gap) THEN 1 ELSE 0 END) / 2.0) >= a AND ((CASE WHEN -sign(gap) * s120 >= 0 THEN 1 ELSE 0 END + CASE WHEN -sign(gap) * s300 >= 0 THEN 1 ELSE 0 END) / 2.0) >= 0.5 AND sign(gap) = 1 AS swap, long_pnl, short_pnl FROM r, c),
p AS (SELECT setting, coalesce(swap, false) AS swap, CAST(CASE WHEN coalesce(swap, false) THEN short_pnl ELSE long_pnl END AS DOUBLE) AS pnl FROM e)
SELECT setting, count(CASE WHEN swap THEN 1 END) AS swaps, count(*) AS trades, sum(pnl) AS total, min(pnl) AS worst FROM p GROUP BY setting""")
def override_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of the dominance override, each with its swaps and profit."""
    rows = averaged(spark, sf, 60, 120, 300)
    w = Window.partitionBy(*SEG).orderBy("bar")
    rows = rows.withColumns({"gap": F.col("avg_60") - F.col("mid"), "g120": F.col("avg_120") - F.col("mid"), "g300": F.col("avg_300") - F.col("mid"), "s120": T.lag_delta(F.col("avg_120"), SEG, ["bar"]), "s300": T.lag_delta(F.col("avg_300"), SEG, ["bar"]), "day": F.floor(F.col("bar") / DAY), "long_pnl": F.lead("first_bid").over(w) - F.col("last_ask"), "short_pnl": F.col("last_bid") - F.lead("first_ask").over(w), "side": F.lit(1)}).where("long_pnl IS NOT NULL")
    out = R.override_grid(rows, "gap", [(120, 300)], (0.5, 1.0), (0.5,), (0.0,), (0.0, 2000.0), "side", "day")
    return out.select("setting", "swaps", "trades", "total", "worst")


@P.add("""WITH p AS (SELECT l_discount * 10 AS side_probability, l_extendedprice / 1000 AS vl, l_quantity AS vs, l_tax * 10 AS tl, l_discount AS tsh, l_extendedprice - 30000 AS long_pnl, 30000 - l_extendedprice AS short_pnl FROM lineitem), s AS (SELECT *, CASE WHEN vl - 25 * tl >= vs - 25 * tsh THEN 1 ELSE -1 END AS side FROM p),
c AS (SELECT CASE WHEN side > 0 THEN long_pnl ELSE short_pnl END AS pnl, greatest(long_pnl, short_pnl) AS best, CASE WHEN side > 0 THEN tl ELSE tsh END AS tail, CASE WHEN side > 0 THEN vl ELSE vs END AS v FROM s)
SELECT count(*) AS trades, round(avg(pnl), 3) AS mean, round(quantile_cont(pnl, 0.5), 3) AS median, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(quantile_cont(pnl, 0.05), 3) AS p05, round(avg(CASE WHEN best > 0 THEN 1.0 ELSE 0 END), 6) AS oracle_win_rate, round(avg(tail), 6) AS mean_tail FROM c WHERE v - 25 * tail >= 30.0001""")
def risk_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates at or above a cutoff of the risk edge."""
    c = F.col
    zero = {f"{n}_std": F.lit(0.0) for n in ("side_probability", "long_tail_probability", "short_tail_probability", "predicted_long_pnl", "predicted_short_pnl")}
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select((c("l_discount") * 10).alias("side_probability"), (c("l_extendedprice") / 1000).alias("predicted_long_pnl"), c("l_quantity").alias("predicted_short_pnl"), (c("l_tax") * 10).alias("long_tail_probability"), c("l_discount").alias("short_tail_probability"), (c("l_extendedprice") - 30000).alias("long_pnl"), (30000 - c("l_extendedprice")).alias("short_pnl"), F.lit(0.5).alias("opportunity_probability")).withColumns(zero)
    out = R.risk_summary(rows, "risk", 25.0, "risk_edge", 30.0001)
    return out.select("trades", r6(c("mean"), "mean", 3), r6(c("median"), "median", 3), r6(c("win_rate"), "win_rate"), r6(c("p05"), "p05", 3), r6(c("oracle_win_rate"), "oracle_win_rate"), r6(c("mean_tail"), "mean_tail"))


@P.add(f"""WITH {FILLS} SELECT series, event, segment_id, CASE WHEN side <= 0 THEN 1 ELSE -1 END AS local_side, CASE WHEN side <= 0 THEN x1_first_bid - e_first_ask ELSE e_first_bid - x1_first_ask END AS local_pnl, CASE WHEN side <= 0 THEN e_first_bid - x1_first_ask ELSE x1_first_bid - e_first_ask END AS continuation_pnl FROM fills WHERE x1_first_bid IS NOT NULL""")
def entry_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with the profit of the local side and of the continuation."""
    f = fills(spark, sf).where("x1_first_bid IS NOT NULL")
    long, short = F.col("x1_first_bid") - F.col("e_first_ask"), F.col("e_first_bid") - F.col("x1_first_ask")
    local = F.col("side") <= 0
    return f.select("series", "event", "segment_id", F.when(local, 1).otherwise(-1).alias("local_side"), F.when(local, long).otherwise(short).alias("local_pnl"), F.when(local, short).otherwise(long).alias("continuation_pnl"))


@P.add(f"""WITH {BARS}, f AS (SELECT series, segment_id, bar // {HOUR} AS place, CAST(CASE WHEN ticks = 0 THEN 0 WHEN close % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS action, row_number() OVER (PARTITION BY series, segment_id ORDER BY bar) - 1 AS seg_place FROM bars)
SELECT series, segment_id, place, 0 AS state, action, CAST(-1 AS BIGINT) AS entry, CASE WHEN action = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM f WHERE (action <> 0 OR place % 3 = 0) AND seg_place + 1 >= 4""")
def example_table(spark: SparkSession, sf: str) -> DataFrame:
    """Examples of the flat state, skips thinned out, with a full context."""
    flat = bars(spark, sf).select(*SEG, F.floor(F.col("bar") / HOUR).alias("place"), F.when(F.col("ticks") == 0, 0).when(F.pmod("close", F.lit(4)) == 0, 1).otherwise(0).alias("action"), (F.row_number().over(Window.partitionBy(*SEG).orderBy("bar")) - 1).alias("seg_place"))
    none = flat.limit(0).select(*SEG, F.col("place").alias("entry"), F.col("place").alias("close_start"), F.col("place").alias("close_end"))
    return R.examples(flat, none, SEG, "place", 4, 3, 2, 0, 4, 3)


SOFT = C.gaussian(1.0, 1.0, 2.0)


@P.add(f"""WITH RECURSIVE {RUNS}, o AS (SELECT unnest(range(-2, 3)) AS i, unnest([{', '.join(map(repr, SOFT))}]::DOUBLE[]) AS w),
sm AS (SELECT a.series, a.segment_id, a.run, a.bar, a.p, a.n, sum(b.x * w) AS m FROM rr a CROSS JOIN o JOIN rr b ON b.series = a.series AND b.segment_id = a.segment_id AND b.run = a.run AND b.p = least(greatest(a.p + i, 1), a.n) GROUP BY ALL),
{peaks_sql('sm', 'm', 250.0, 4)},
zone AS (SELECT *, coalesce(max(CASE WHEN q < p AND v <= 25 THEN q END) OVER w + 1, lo) AS za, coalesce(min(CASE WHEN q > p AND v <= 25 THEN q END) OVER w, hi) AS zz FROM halves WINDOW w AS (PARTITION BY {PEAK_RUN}, p)),
val AS (SELECT {PEAK_RUN}, t, CASE WHEN q - p BETWEEN -6 AND 3 THEN (0.2 + 0.8 * least(greatest((top - 250) / 150, 0), 1)) * pow(least(greatest(v / top, 0), 1), 2) * CASE WHEN q <= p THEN exp((q - p) / 2.0) ELSE exp(-(q - p) / 1.0) END ELSE 0 END AS soft FROM zone WHERE q >= za AND q < zz)
SELECT s.series, s.segment_id, CAST(s.run AS BIGINT) AS run, s.bar, round(coalesce(max(soft), 0), 6) AS target FROM sm s LEFT JOIN val z ON z.series = s.series AND z.segment_id = s.segment_id AND z.run = s.run AND z.t = s.bar GROUP BY s.series, s.segment_id, s.run, s.bar""")
def soft_peak_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Soft targets around separated peaks of the smoothed series."""
    rows = C.smoothed(run_rows(spark, sf), "x", RUN, ["bar"], SOFT, "m")
    return R.soft_peaks(rows, "m", RUN, "bar", 1.0, 12.0, 250.0, 400.0).withColumn("target", F.round("target", 6))


@P.add(f"""WITH {BARS} SELECT series, bar, round(CASE WHEN close >= 25000 THEN 0.2 + 0.8 * least(greatest((close - 25000) / 15000.0::DOUBLE, 0), 1) ELSE 0 END, 6) AS target, round(ln(1 + greatest(close, 0)), 6) AS auxiliary FROM bars""")
def dense_edge_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Dense targets from a score, and the logarithmic auxiliary one."""
    return bars(spark, sf).select("series", "bar", r6(R.dense_edge(F.col("close").cast("double"), 25_000.0, 40_000.0), "target"), r6(F.log1p(F.greatest("close", F.lit(0))), "auxiliary"))


@P.add(f"""WITH {BARS}, b AS (SELECT series, segment_id, bar // {HOUR} AS i, bar, CAST(last_bid AS DOUBLE) AS bid, CAST(last_ask AS DOUBLE) AS ask FROM bars WHERE last_bid > 0), x AS (SELECT a.series, a.bar, greatest(1e4 * (c.bid / a.ask - 1), 0) AS e, c.i - a.i AS lag FROM b a JOIN b c ON c.series = a.series AND c.segment_id = a.segment_id AND c.i > a.i AND c.i <= a.i + 2)
SELECT x.series, x.bar, count(*) AS good, round(avg(e) + 1.23e-6, 5) AS fwd_long FROM x JOIN b ON b.series = x.series AND b.bar = x.bar JOIN b z ON z.series = b.series AND z.segment_id = b.segment_id AND z.i = b.i + 2 GROUP BY x.series, x.bar""")
def rounded_score_cube(spark: SparkSession, sf: str) -> DataFrame:
    """The older grid: 0.7 of a cadence of 0.3 is rounded to two whole steps."""
    steps = R.rounded_steps([0.7])[0]
    rows = quoted(spark, sf).where("valid")
    out = C.score_cube(rows, SEG, "bar", HOUR, [float(steps * HOUR)], 0.0, 0.0, chunk=128).where("fwd_long IS NOT NULL")
    w = Window.partitionBy(*SEG).orderBy("bar").rangeBetween(1, steps * HOUR)
    counts = rows.select(*SEG, "bar", F.count("*").over(w).alias("good"))
    return out.join(counts, [*SEG, "bar"]).select("series", "bar", "good", r6(F.col("fwd_long") + 1.23e-6, "fwd_long", 5))


@P.add(f"""WITH {BARS} SELECT series, bar, open - close AS open_ticks, high - close AS high_ticks, high - low AS range_ticks, close - lag(close) OVER w AS close_change_ticks, last_bid - close AS bid_ticks, last_ask - last_bid AS spread_ticks,
  lag(close) OVER w IS NOT NULL AND row_number() OVER w >= 3 AS valid FROM bars WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar)""")
def tick_features(spark: SparkSession, sf: str) -> DataFrame:
    """Distances in ticks from the close, and which rows have all features and enough history."""
    rows = B.tick_features(bars(spark, sf), SEG, ["bar"])
    enough = F.row_number().over(Window.partitionBy(*SEG).orderBy("bar")) >= 3
    whole = [F.col(c).cast("long").alias(c) for c in ("open_ticks", "high_ticks", "range_ticks", "close_change_ticks", "bid_ticks", "spread_ticks")]
    return rows.select("series", "bar", *whole, (F.col("close_change_ticks").isNotNull() & enough).alias("valid"))


@P.add("""WITH e AS (SELECT DISTINCT o_orderkey % 40 AS epoch FROM orders) SELECT epoch, round(0.2 + (0.01 - 0.2) * least(greatest((epoch - 5) / 20.0, 0), 1), 6) AS rate, round((1 - 0.1) * (epoch / 40.0) + 0.05, 6) AS mixed, round(greatest(epoch - 20.0, 0) + ln(1 + exp(-abs(epoch - 20.0))), 6) AS soft FROM e""")
def schedules(spark: SparkSession, sf: str) -> DataFrame:
    """Warm-up and decay, a probability with an exploration floor, and softplus hazards."""
    e = table(spark, sf, "orders").select(F.pmod("o_orderkey", F.lit(40)).alias("epoch")).distinct()
    return e.select("epoch", r6(S.schedule(F.col("epoch"), 5, 20, 0.2, 0.01), "rate"), r6(S.floored(F.col("epoch") / 40.0, 0.1), "mixed"), r6(S.softplus(F.col("epoch") - 20.0), "soft"))


@P.add(f"""WITH {TICK}, t AS (SELECT series % 3 AS connection, series % 2 AS segment, ts // {HOUR} AS bar, seq, px FROM tick), n AS (SELECT *, CAST(dense_rank() OVER (ORDER BY connection, segment) - 1 AS INTEGER) AS id FROM t), k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY connection, id, bar ORDER BY seq DESC) = 1)
SELECT bar, connection, id AS segment, seq FROM k QUALIFY row_number() OVER (PARTITION BY bar ORDER BY connection DESC, seq DESC) = 1""")
def renumbered_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of several connections under one numbering, the last connection's row of each time."""
    t = ticks(spark, sf).select(F.pmod("series", F.lit(3)).alias("connection"), F.pmod("series", F.lit(2)).alias("segment"), F.floor(F.col("ts") / HOUR).alias("bar"), "seq")
    rows = T.keep_last(t, ["connection", "segment", "bar"], ["seq"])
    out = files.renumbered(rows, "connection", "segment", "bar", ["seq"])
    return out.select("bar", "connection", "segment", "seq")


TIMES = average_sql("mid", "weight", 60), average_sql("mid", "weight", 300), average_sql("mid", "weight", None, f"series, segment_id, bar // {DAY}"), average_sql("last_bid", "weight", 60), average_sql("last_ask", "weight", 60)


@P.add(f"""WITH {BARS}, m AS (SELECT *, last_bid + last_ask AS mid FROM bars), a AS (SELECT *, {TIMES[0]} / 2 AS a60, {TIMES[1]} / 2 AS a300, {TIMES[2]} / 2 AS day_avg, {TIMES[3]} AS b60, {TIMES[4]} AS k60 FROM m)
SELECT series, bar, low - close AS low_ticks, last_ask - close AS ask_ticks, mid - 2 * close AS twice_book, CAST(floor((day_avg - close) * 10000 + 0.5) AS BIGINT) AS daily_average_ticks, CAST(floor((a60 - close) * 10000 + 0.5) AS BIGINT) AS average_60_ticks, CAST(floor((a300 - close) * 10000 + 0.5) AS BIGINT) AS average_300_ticks, CAST(floor((b60) * 10000 + 0.5) AS BIGINT) AS bid_average_60, CAST(floor((k60) * 10000 + 0.5) AS BIGINT) AS ask_average_60, CAST(floor((b60 - last_bid) * 10000 + 0.5) AS BIGINT) AS bid_average_60_ticks, CAST(floor((k60 - last_ask) * 10000 + 0.5) AS BIGINT) AS ask_average_60_ticks FROM a""")
def tick_distances(spark: SparkSession, sf: str) -> DataFrame:
    """The other distances in ticks: to the book's, the day's and the rolling averages, and of the sided averages to their quotes; averages in ten-thousandths."""
    rows = bars(spark, sf).withColumns({"mid": F.col("last_bid") + F.col("last_ask"), "day": F.floor(F.col("bar") / DAY)})
    avg = lambda c, n, keys=SEG: T.weighted_average(F.col(c), F.col("weight"), keys, ["bar"], n)
    rows = rows.withColumns({"book_average": F.col("mid") / 2, "daily_average": avg("mid", None, [*SEG, "day"]) / 2, "average_60": avg("mid", 60) / 2, "average_300": avg("mid", 300) / 2, "bid_average_60": avg("last_bid", 60), "ask_average_60": avg("last_ask", 60)})
    out = B.tick_features(rows, SEG, ["bar"], averages=True)
    four = ("daily_average_ticks", "average_60_ticks", "average_300_ticks", "bid_average_60", "ask_average_60", "bid_average_60_ticks", "ask_average_60_ticks")
    return out.select("series", "bar", *[F.col(c).cast("long").alias(c) for c in ("low_ticks", "ask_ticks")], (F.col("book_average_ticks") * 2).cast("long").alias("twice_book"), *[F.floor(F.col(c) * 10000 + 0.5).alias(c) for c in four])


@P.add(f"""WITH {LINES}, h AS (SELECT unnest([1, 3, 6])::INTEGER AS steps) SELECT series, bar, steps, round(fit / 6 * steps, 4) AS guess FROM ahead, h""")
def persistence_line(spark: SparkSession, sf: str) -> DataFrame:
    """A line that goes on as it was, at several horizons."""
    rows = placed(spark, sf)
    rows = rows.withColumns(C.line("mid", "place", SEG, ["bar"], 6)).where("slope IS NOT NULL")
    steps = (1, 3, 6)
    ends = F.arrays_zip(F.array(*map(F.lit, steps)).alias("steps"), C.persistence(F.col("end"), 6.0, steps).alias("guess"))
    out = rows.select("series", "bar", F.explode(ends).alias("x"))
    return out.select("series", "bar", F.col("x.steps").alias("steps"), r6(F.col("x.guess"), "guess", 4))


@P.add(f"""WITH {TICK}, v AS (SELECT seq, ts // {7 * DAY} AS block, px AS truth, px + k AS a, px - k // 2 AS b FROM tick)
SELECT block, count(*) AS rows, round(avg(abs(a - truth)), 6) AS mae_left, round(avg(abs(b - truth)), 6) AS mae_right, round(avg(abs(a - truth)) - avg(abs(b - truth)), 6) AS gain FROM v GROUP BY block""")
def weekly_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a prediction against the truth, by weeks."""
    t = ticks(spark, sf).withColumns({"a": F.col("px") + F.col("k"), "b": F.col("px") - F.floor(F.col("k") / 2)})
    out = R.block_comparison(t.select("seq", "ts", "px", F.col("a").alias("guess")), t.select("seq", "ts", F.col("b").alias("guess")), ["seq", "ts"], F.floor(F.col("ts") / (7 * DAY)), "px", "guess")
    return out.select("block", "rows", *[r6(F.col(c), c) for c in ("mae_left", "mae_right", "gain")])


@P.add(f"""WITH RECURSIVE {CROSSED}, t AS (SELECT series, segment_id, x_entry AS entry_at, x_at AS exit_at, x_pos AS side, (x_price - x_in) * x_pos - 6 AS pnl, term AS terminal, (x_at - x_entry) / {HOUR}.0::DOUBLE AS hold FROM st WHERE x_at IS NOT NULL),
r AS (SELECT sum(pnl) OVER (ORDER BY exit_at, entry_at, series, segment_id) AS total FROM t), d AS (SELECT total, greatest(max(total) OVER (ORDER BY i), 0) - total AS fall FROM (SELECT total, row_number() OVER () AS i FROM (SELECT sum(pnl) OVER w AS total, row_number() OVER w AS n FROM t WINDOW w AS (ORDER BY exit_at, entry_at, series, segment_id) ORDER BY n)))
SELECT count(*) AS trades, count(CASE WHEN side > 0 THEN 1 END) AS long_trades, count(CASE WHEN side < 0 THEN 1 END) AS short_trades, count(CASE WHEN NOT terminal THEN 1 END) AS crossed, count(CASE WHEN terminal THEN 1 END) AS forced, sum(pnl) AS total, round(avg(pnl), 5) AS mean, median(pnl) AS median, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
  round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / -sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END), 6) AS profit_factor, (SELECT max(fall) FROM d) AS max_drawdown, round(avg(hold), 6) AS hold_mean, median(hold) AS hold_median,
  count(CASE WHEN hold <= 2 THEN 1 END) AS hold_0, count(CASE WHEN hold > 2 AND hold <= 6 THEN 1 END) AS hold_1, count(CASE WHEN hold > 6 AND hold <= 24 THEN 1 END) AS hold_2, count(CASE WHEN hold > 24 THEN 1 END) AS hold_3 FROM t""")
def exit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger's metrics with holding buckets."""
    trades = L.cross_ledger(averaged_sides(spark, sf), SEG, "bar", 1, 0.6, 1.0, 3.0, 1.0).withColumn("hold", (F.col("exit_at") - F.col("entry_at")) / float(HOUR))
    out = L.exit_metrics(trades, "net_ticks", "hold", (2.0, 6.0, 24.0), ["exit_at", "entry_at", "series", "segment_id"])
    return out.withColumns({"mean": F.round("mean", 5), "hit_rate": F.round("hit_rate", 6), "profit_factor": F.round("profit_factor", 6), "hold_mean": F.round("hold_mean", 6)})
