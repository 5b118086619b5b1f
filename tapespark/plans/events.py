"""Excursion events, gates, rate control, entries and exits, targets and decisions on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import decisions as D
from ..operators import excursions as X
from ..operators import temporal as T
from .base import DAY, HOUR, SECOND, SEG, Plans, averaged, averaged_sql, r6

P = Plans()
QUERIES, SQL = P.QUERIES, P.SQL
#: Amplitudes are in half cents.
THRESHOLD, GATE = 20_000.0, 0.75
SEGMENT = "(PARTITION BY series, segment_id ORDER BY bar"


def sided(spark: SparkSession, sf: str, *horizons: int) -> DataFrame:
    rows = averaged(spark, sf, 60, *[h for h in horizons if h != 60]).withColumn("delta", F.col("mid") - F.col("avg_60"))
    return X.events(X.sides(rows, "delta", SEG, "bar"), SEG, "bar")


def sided_sql(*horizons: int) -> str:
    return averaged_sql(60, *[h for h in horizons if h != 60]) + f""", deltas AS (SELECT *, mid - avg_60 AS delta FROM averaged),
signed AS (SELECT *, CAST(coalesce(last_value(nullif(sign(delta), 0) IGNORE NULLS) OVER {SEGMENT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS side FROM deltas),
crossed AS (SELECT *, coalesce(lag(side) OVER {SEGMENT}) <> side, true) AS crossing FROM signed),
sided AS (SELECT *, CAST(sum(CASE WHEN crossing THEN 1 ELSE 0 END) OVER {SEGMENT} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS event FROM crossed)"""


def found_events(spark: SparkSession, sf: str) -> DataFrame:
    return X.excursions(sided(spark, sf), "delta", ["series"], "segment_id", "bar", SECOND, THRESHOLD, GATE, 2 * 3600.0)


FOUND = sided_sql() + f""", grouped AS (
  SELECT series, segment_id, event, min(bar) AS start, max(bar) AS "end", any_value(side) AS side, max(abs(delta)) AS amplitude, count(*) AS rows,
         min(CASE WHEN abs(delta) >= {THRESHOLD * GATE} THEN bar END) AS gate_at FROM sided GROUP BY ALL),
led AS (SELECT *, lead(start, 1) OVER w AS crossing_1, lead(start, 2) OVER w AS crossing_2 FROM grouped WINDOW w AS (PARTITION BY series, segment_id ORDER BY event)),
found AS (SELECT *, (crossing_1 - start) / {SECOND}.0::DOUBLE AS duration_s, gate_at IS NOT NULL AS gated,
          (crossing_1 - start) / {SECOND}.0::DOUBLE >= 7200.0 AND amplitude >= {THRESHOLD} AS good FROM led WHERE crossing_2 IS NOT NULL)"""


@P.add(f"WITH {sided_sql()} SELECT series, segment_id, bar, side, crossing, event FROM sided")
def carry_sign(spark: SparkSession, sf: str) -> DataFrame:
    return sided(spark, sf).select("series", "segment_id", "bar", "side", "crossing", "event")


@P.add(f"""WITH {FOUND} SELECT series, segment_id, event, start, "end", side, amplitude, rows, gate_at, crossing_1, crossing_2, duration_s, gated, good FROM found""")
def excursions(spark: SparkSession, sf: str) -> DataFrame:
    return found_events(spark, sf)


@P.add(f"""WITH {sided_sql()}, g AS (SELECT *, row_number() OVER w - 1 AS age, max(abs(delta)) OVER w AS running_max, sum(abs(delta)) OVER w AS running_area
  FROM sided WINDOW w AS (PARTITION BY series, segment_id, event ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT series, segment_id, bar, CAST(age AS INTEGER) AS age, running_max, round(running_area, 4) AS running_area, round(running_area / greatest((age + 1) * running_max, 1e-6), 6) AS fill_ratio,
       round(abs(delta) / greatest(running_max, 1e-6), 6) AS current_ratio, running_max >= {THRESHOLD * GATE} AS gate_open FROM g""")
def event_geometry(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.geometry(sided(spark, sf), "delta", SEG, "bar", THRESHOLD * GATE)
    return rows.select("series", "segment_id", "bar", "age", "running_max", r6(F.col("running_area"), "running_area", 4), r6(F.col("fill_ratio"), "fill_ratio"), r6(F.col("current_ratio"), "current_ratio"), "gate_open")


@P.add(f"""WITH {averaged_sql(*B.HORIZONS)}, r AS (SELECT *, ({' + '.join(f'avg_{h}' for h in B.RIBBON)}) / 6.0 AS ribbon, greatest({', '.join(f'avg_{h}' for h in B.RIBBON)}) - least({', '.join(f'avg_{h}' for h in B.RIBBON)}) AS ribbon_width FROM averaged),
b AS (SELECT ln(h) AS l FROM (SELECT unnest([{', '.join(map(str, B.HORIZONS))}]) AS h)), c AS (SELECT avg(l) AS m, count(*) AS n FROM b), d AS (SELECT sum((l - m) * (l - m)) AS ss FROM b, c)
SELECT series, segment_id, bar, round(ribbon, 4) AS ribbon, round(ribbon_width, 4) AS ribbon_width, round(coalesce(ribbon - lag(ribbon) OVER w, 0), 4) AS ribbon_slope, round(coalesce(ribbon_width - lag(ribbon_width) OVER w, 0), 4) AS ribbon_width_change,
       round(ribbon - mid, 4) AS ribbon_gap, round(({' + '.join(f'(avg_{h} - mid) * (ln({h}) - m) / ss' for h in B.HORIZONS)}), 3) AS scale_slope,
       round(({' + '.join(f'sign(avg_{h} - mid)' for h in B.HORIZONS)}) / 9.0, 6) AS scale_consensus
FROM r, c, d WINDOW w AS {SEGMENT})""")
def ribbon_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """The ribbon of the shorter averages, and contrasts of the gaps over the logarithms of all horizons."""
    rows = B.scale_stats(B.ribbon(averaged(spark, sf, *B.HORIZONS), SEG, ["bar"]))
    keep = [r6(F.col(c), c, 4) for c in ("ribbon", "ribbon_width", "ribbon_slope", "ribbon_width_change", "ribbon_gap")]
    return rows.select("series", "segment_id", "bar", *keep, r6(F.col("scale_slope"), "scale_slope", 3), r6(F.col("scale_consensus"), "scale_consensus"))


@P.add(f"""WITH {FOUND}, binned AS (SELECT series, "end", amplitude, CAST(least(greatest(round_even(amplitude, 0), 0), 100000) AS BIGINT) AS bin,
   least(("end" - lag("end") OVER w) / {SECOND}.0::DOUBLE, 21600.0) AS gap0, lag("end") OVER w AS prev FROM found WINDOW w AS (PARTITION BY series ORDER BY "end")),
gaps AS (SELECT *, CASE WHEN prev IS NOT NULL THEN gap0 END AS gap FROM binned),
past AS (SELECT *, list(bin) OVER h AS bins, count(bin) OVER h AS n, sum(gap) OVER h AS span, first_value(gap) OVER h AS oldest FROM gaps
   WINDOW h AS (PARTITION BY series ORDER BY "end" ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
rated AS (SELECT *, CASE WHEN n < 2 OR NOT coalesce((span - coalesce(oldest, 0)) > 0, false) THEN CAST(n AS DOUBLE) ELSE (n - 1) / ((span - coalesce(oldest, 0)) / 86400.0) END AS rate FROM past),
lev AS (SELECT *, CASE WHEN rate = 0 THEN NULL ELSE least(greatest(1 - 3.0 / rate, 0), 1) END AS level FROM rated)
SELECT series, "end", n AS history, CASE WHEN n >= 10 THEN CAST(list_sort(bins)[CAST(floor(level * (n - 1)) AS INTEGER) + 1] AS DOUBLE) ELSE {THRESHOLD * GATE} END AS gate FROM lev""")
def adaptive_gate(spark: SparkSession, sf: str) -> DataFrame:
    found = found_events(spark, sf)
    out = X.adaptive_gate(found, ["series"], "end", "amplitude", 3.0, SECOND, THRESHOLD, history=50, least=10, gap_s=21_600.0, gate_fraction=GATE)
    return out.select("series", "end", "history", "gate")


@P.add(f"""WITH {FOUND}, q AS (SELECT series, start, start // {DAY} AS day, amplitude, count(amplitude) OVER h AS n, quantile_cont(amplitude, 0.8) OVER h AS cut FROM found
  WINDOW h AS (PARTITION BY series ORDER BY start ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN n >= 10 THEN cut ELSE {THRESHOLD} END AS cutoff FROM q)
SELECT series, start, round(cutoff, 4) AS cutoff, amplitude >= cutoff AS qualified,
       amplitude >= cutoff AND sum(CASE WHEN amplitude >= cutoff THEN 1 ELSE 0 END) OVER (PARTITION BY series, day ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 2 AS accepted FROM c""")
def rate_controller(spark: SparkSession, sf: str) -> DataFrame:
    found = found_events(spark, sf).withColumn("day", F.floor(F.col("start") / DAY))
    out = X.rate_control(found, ["series"], ["start"], "amplitude", "day", 0.8, 2, THRESHOLD, history=50, least=10)
    return out.select("series", "start", r6(F.col("cutoff"), "cutoff", 4), "qualified", "accepted")


ENTRY_SCORE = 15_000.0


@P.add(f"""WITH {sided_sql()}, nxt AS (SELECT *, coalesce(lead(observed) OVER {SEGMENT}), false) AS ok FROM sided)
SELECT series, segment_id, event, min(bar) AS entry FROM nxt WHERE ok AND abs(delta) >= {ENTRY_SCORE} GROUP BY ALL""")
def first_entry(spark: SparkSession, sf: str) -> DataFrame:
    return X.first_entries(sided(spark, sf), [*SEG, "event"], "bar", F.abs(F.col("delta")), ENTRY_SCORE)


def fills(spark: SparkSession, sf: str) -> DataFrame:
    """Entered events with the quotes of the rows after the entry and after both crossings."""
    rows = sided(spark, sf)
    entries = X.first_entries(rows, [*SEG, "event"], "bar", F.abs(F.col("delta")), ENTRY_SCORE)
    out = found_events(spark, sf).join(entries, [*SEG, "event"])
    for decision, prefix in (("entry", "e_"), ("crossing_1", "x1_"), ("crossing_2", "x2_")):
        out = X.exit_quotes(out, rows, SEG, decision, "bar", HOUR, prefix, ["first_bid", "first_ask", "observed"])
    return out


FILLS = FOUND + f""", nxt AS (SELECT *, coalesce(lead(observed) OVER {SEGMENT}), false) AS ok FROM sided),
entries AS (SELECT series, segment_id, event, min(bar) AS entry FROM nxt WHERE ok AND abs(delta) >= {ENTRY_SCORE} GROUP BY ALL),
fills AS (SELECT f.*, entry, e.first_bid AS e_first_bid, e.first_ask AS e_first_ask, e.observed AS e_observed, a.first_bid AS x1_first_bid, a.first_ask AS x1_first_ask, a.observed AS x1_observed,
  b.first_bid AS x2_first_bid, b.first_ask AS x2_first_ask, b.observed AS x2_observed
  FROM found f JOIN entries USING (series, segment_id, event)
  LEFT JOIN sided e ON e.series = f.series AND e.segment_id = f.segment_id AND e.bar = entry + {HOUR}
  LEFT JOIN sided a ON a.series = f.series AND a.segment_id = f.segment_id AND a.bar = crossing_1 + {HOUR}
  LEFT JOIN sided b ON b.series = f.series AND b.segment_id = f.segment_id AND b.bar = crossing_2 + {HOUR})"""
COST = 14


@P.add(f"""WITH {FILLS} SELECT series, segment_id, event, entry, x1_first_bid - e_first_ask - {COST} AS long_1, e_first_bid - x1_first_ask - {COST} AS short_1, x2_first_bid - e_first_ask - {COST} AS long_2,
  CASE WHEN side < 0 THEN x1_first_bid - e_first_ask - {COST} ELSE e_first_bid - x1_first_ask - {COST} END AS event_pnl,
  greatest(x1_first_bid - e_first_ask, e_first_bid - x1_first_ask) - {COST} AS best_pnl, round(asinh((x1_first_bid - e_first_ask - {COST}) / 100.0), 6) AS long_value,
  round(least(greatest(abs((x1_first_bid - e_first_ask) - (e_first_bid - x1_first_ask)) / 100.0, 0.25), 10.0), 6) AS weight,
  gated AND coalesce(x1_observed, false) AS eligible_1, gated AND coalesce(x1_observed AND x2_observed, false) AS eligible_both FROM fills""")
def side_pnl(spark: SparkSession, sf: str) -> DataFrame:
    """Executable ticks of both sides after costs, the event's own side, weights and eligibility."""
    f = fills(spark, sf)
    c = F.col
    long_1, short_1 = c("x1_first_bid") - c("e_first_ask") - COST, c("e_first_bid") - c("x1_first_ask") - COST
    return f.select(
        "series", "segment_id", "event", "entry", long_1.alias("long_1"), short_1.alias("short_1"), (c("x2_first_bid") - c("e_first_ask") - COST).alias("long_2"),
        F.when(c("side") < 0, long_1).otherwise(short_1).alias("event_pnl"), F.greatest(long_1, short_1).alias("best_pnl"), r6(F.asinh(long_1 / 100.0), "long_value"), r6(D.pair_weight(long_1, short_1), "weight"),
        (c("gated") & F.coalesce("x1_observed", F.lit(False))).alias("eligible_1"), (c("gated") & F.coalesce(c("x1_observed") & c("x2_observed"), F.lit(False))).alias("eligible_both"),
    )


@P.add(f"""WITH {FILLS} SELECT s.series, s.segment_id, s.event, s.bar, CAST(-f.side * (c.mid - s.mid) > f.side * (c.avg_60 - s.avg_60) AS INTEGER) AS price_dominates,
  CASE WHEN f.side < 0 THEN CAST(a.first_bid - e.first_ask > e.first_bid - a.first_ask AS INTEGER) ELSE CAST(NOT (a.first_bid - e.first_ask > e.first_bid - a.first_ask) AS INTEGER) END AS reversion,
  CAST((CASE WHEN a.first_bid - e.first_ask >= e.first_bid - a.first_ask THEN 1 ELSE -1 END) = -sign(s.avg_60 - s.mid) AS INTEGER) AS entry_dominance
FROM sided s JOIN found f ON s.series = f.series AND s.segment_id = f.segment_id AND s.event = f.event
JOIN sided c ON c.series = f.series AND c.bar = f.crossing_1
JOIN sided e ON e.series = s.series AND e.segment_id = s.segment_id AND e.bar = s.bar + {HOUR}
JOIN sided a ON a.series = f.series AND a.segment_id = f.segment_id AND a.bar = f.crossing_1 + {HOUR}""")
def side_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of every row of an event: dominance of the price, reversion and entry dominance."""
    rows = sided(spark, sf)
    found = found_events(spark, sf).select(*SEG, "event", "crossing_1", F.col("side").alias("event_side"))
    at = rows.select("series", F.col("bar").alias("crossing_1"), F.col("mid").alias("mid_at"), F.col("avg_60").alias("average_at"))
    out = rows.select(*SEG, "event", "bar", "mid", "avg_60").join(found, [*SEG, "event"]).join(at, ["series", "crossing_1"])
    out = X.exit_quotes(X.exit_quotes(out, rows, SEG, "bar", "bar", HOUR, "e_", ["first_bid", "first_ask"]), rows, SEG, "crossing_1", "bar", HOUR, "x_", ["first_bid", "first_ask"])
    c = F.col
    out = out.where(c("e_first_bid").isNotNull() & c("x_first_bid").isNotNull())
    long, short = c("x_first_bid") - c("e_first_ask"), c("e_first_bid") - c("x_first_ask")
    return out.select(*SEG, "event", "bar", D.dominance_target(c("event_side"), c("mid"), c("avg_60"), c("mid_at"), c("average_at")).alias("price_dominates"), D.reversion_target(c("event_side"), long, short).alias("reversion"), D.entry_dominance_target(c("avg_60") - c("mid"), long, short).alias("entry_dominance"))


VOTE = (120, 300, 900)


@P.add(f"""WITH {averaged_sql(60, *VOTE)}, g AS (SELECT *, avg_60 - mid AS g60, {', '.join(f'avg_{h} - mid AS g{h}' for h in VOTE)} FROM averaged),
s AS (SELECT *, [{', '.join(f'CASE WHEN abs(g{h}) >= 500 THEN sign(g{h}) END' for h in VOTE)}] AS signs FROM g),
v AS (SELECT *, CASE WHEN g60 > 0 THEN 1 ELSE -1 END AS loc, coalesce(list_avg(signs), 0) AS score FROM s)
SELECT series, bar, CASE WHEN score <> 0 AND abs(score) >= 0.6 THEN CASE WHEN score > 0 THEN 1 ELSE -1 END ELSE loc END AS side,
       score <> 0 AND abs(score) >= 0.6 AND (CASE WHEN score > 0 THEN 1 ELSE -1 END) <> loc AS inverted, round(abs(score), 6) AS strength FROM v""")
def multivwap_vote(spark: SparkSession, sf: str) -> DataFrame:
    rows = averaged(spark, sf, 60, *VOTE)
    side, inverted, strength = X.vote(F.col("avg_60") - F.col("mid"), [F.col(f"avg_{h}") - F.col("mid") for h in VOTE], 500.0, 0.6)
    return rows.select("series", "bar", side.alias("side"), inverted.alias("inverted"), r6(strength, "strength"))


@P.add(f"""WITH {averaged_sql(60, *VOTE)}, g AS (SELECT *, avg_60 - mid AS g60, {', '.join(f'avg_{h} - mid AS g{h}, avg_{h} - lag(avg_{h}) OVER {SEGMENT}) AS s{h}' for h in VOTE)} FROM averaged),
e AS (SELECT series, bar, CAST(sign(g60) AS INTEGER) AS relation, g60 <> 0 AND abs(g60) >= 1000 AS far,
  ({' + '.join(f'CASE WHEN sign(g{h}) = sign(g60) THEN 1 ELSE 0 END' for h in VOTE)}) / 3.0::DOUBLE AS al, ({' + '.join(f'CASE WHEN -sign(g60) * s{h} >= 0 THEN 1 ELSE 0 END' for h in VOTE)}) / 3.0::DOUBLE AS sl FROM g)
SELECT series, bar, relation, far AND al >= 0.6 AND sl >= 0.6 AS dominant, round(CASE WHEN far THEN al ELSE 0 END, 6) AS alignment, round(CASE WHEN far THEN sl ELSE 0 END, 6) AS slopes,
  CASE WHEN relation <> 0 AND al >= 0.5 THEN -relation WHEN relation <> 0 THEN relation ELSE 1 END AS swapped, CASE WHEN relation <> 0 AND al >= 0.5 THEN -relation ELSE 1 END AS vetoed FROM e""")
def dominance_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence that the price dominates the averages, and the sides that swap and veto rules make of it."""
    rows = averaged(spark, sf, 60, *VOTE)
    rows = rows.withColumns({f"s{h}": T.lag_delta(F.col(f"avg_{h}"), SEG, ["bar"]) for h in VOTE})
    gap = F.col("avg_60") - F.col("mid")
    dominant, relation, aligned, sloped = X.evidence(gap, [F.col(f"avg_{h}") - F.col("mid") for h in VOTE], [F.col(f"s{h}") for h in VOTE], 1000.0, 0.6, 0.6)
    share = sum((F.coalesce(F.signum(F.col(f"avg_{h}") - F.col("mid")) == F.signum(gap), F.lit(False)).cast("double") for h in VOTE[1:]), F.coalesce(F.signum(F.col(f"avg_{VOTE[0]}") - F.col("mid")) == F.signum(gap), F.lit(False)).cast("double")) / 3.0
    return rows.select("series", "bar", relation.alias("relation"), dominant.alias("dominant"), r6(aligned, "alignment"), r6(sloped, "slopes"), D.swapped_side(gap, share, 0.5, F.lit(1)).alias("swapped"), D.vetoed_side(gap, share, 0.5, F.lit(1)).alias("vetoed"))


@P.add(f"""WITH {averaged_sql(60)}, g AS (SELECT *, lag(avg_60 - mid) OVER {SEGMENT}) AS gap, mid - lag(mid) OVER {SEGMENT}) AS move FROM averaged),
s AS (SELECT series, bar, sum(round(gap, 3) * move) OVER w AS num, sum(round(gap, 3) * round(gap, 3)) OVER w AS den FROM g WINDOW w AS {SEGMENT} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT series, bar, round(CASE WHEN den > 0 THEN num / den ELSE 0 END, 5) AS alpha_24 FROM s""")
def dominance_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Error correction of the price towards the average over a rolling window."""
    rows = averaged(spark, sf, 60).withColumns({"gap": F.round(F.col("avg_60") - F.col("mid"), 3), "price": F.col("mid")})
    return rows.select("series", "bar", r6(X.dominance("gap", [24], SEG, ["bar"])["alpha_24"], "alpha_24", 5))


THRESHOLDS = (1_000.0, 5_000.0, 10_000.0, 20_000.0, 40_000.0, 90_000.0)


@P.add(f"""WITH {FILLS}, t AS (SELECT amplitude, CAST(x1_first_bid - e_first_ask AS DOUBLE) AS pnl_1, CAST(x2_first_bid - e_first_ask AS DOUBLE) AS pnl_2 FROM fills WHERE x1_first_bid IS NOT NULL AND x2_first_bid IS NOT NULL),
g AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}])::DOUBLE AS threshold),
a AS (SELECT threshold, count(pnl_1) AS trades, coalesce(avg(pnl_1), 0) AS m1, coalesce(avg(pnl_2), 0) AS m2, coalesce(sum(pnl_1), 0) AS t1 FROM g LEFT JOIN t ON amplitude >= threshold GROUP BY threshold)
SELECT threshold, trades, round(m1, 6) AS mean_pnl_1, round(m2, 6) AS mean_pnl_2, t1 AS total_pnl_1, trades >= 20 AS eligible, row_number() OVER (ORDER BY trades >= 20 DESC, (m1 + m2) / 2 DESC, threshold) = 1 AS best FROM a""")
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Trades and mean profit at each threshold, and the best that has enough trades."""
    c = F.col
    rows = fills(spark, sf).where(c("x1_first_bid").isNotNull() & c("x2_first_bid").isNotNull())
    rows = rows.select("amplitude", (c("x1_first_bid") - c("e_first_ask")).cast("double").alias("pnl_1"), (c("x2_first_bid") - c("e_first_ask")).cast("double").alias("pnl_2"))
    out = D.threshold_grid(rows, THRESHOLDS, "amplitude", ["pnl_1", "pnl_2"], 0)
    return out.select("threshold", "trades", r6(c("mean_pnl_1"), "mean_pnl_1"), r6(c("mean_pnl_2"), "mean_pnl_2"), "total_pnl_1", "eligible", "best")


@P.add(f"""WITH {FOUND}, s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY start) AS n, count(*) OVER (PARTITION BY series) AS total FROM found),
c AS (SELECT series, q, quantile_cont(amplitude, q) AS cutoff FROM s, (SELECT unnest([0.5, 0.8, 0.95])::DOUBLE AS q) WHERE n <= total * 0.6 GROUP BY ALL)
SELECT series, q, round(cutoff, 4) AS cutoff, count(CASE WHEN amplitude >= cutoff THEN 1 END) AS chosen, round(coalesce(avg(CASE WHEN amplitude >= cutoff THEN duration_s END), 0), 4) AS mean_duration
FROM s JOIN c USING (series) WHERE n > total * 0.6 GROUP BY series, q, cutoff""".replace("quantile_cont(amplitude, q) AS cutoff FROM s, (SELECT unnest([0.5, 0.8, 0.95])::DOUBLE AS q) WHERE n <= total * 0.6 GROUP BY ALL", "cutoff FROM (SELECT series, unnest([0.5, 0.8, 0.95])::DOUBLE AS q, unnest(quantile_cont(amplitude, [0.5, 0.8, 0.95])) AS cutoff FROM s WHERE n <= total * 0.6 GROUP BY series)"))
def cutoff_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Cutoffs from quantiles of the earlier events of a series, applied to its later ones."""
    w = Window.partitionBy("series")
    rows = found_events(spark, sf).withColumns({"n": F.row_number().over(w.orderBy("start")), "total": F.count("*").over(w)})
    early = F.col("n") <= F.col("total") * 0.6
    qs = (0.5, 0.8, 0.95)
    cuts = rows.where(early).groupBy("series").agg(F.percentile("amplitude", F.array(*map(F.lit, qs))).alias("c"))
    cuts = cuts.select("series", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("c").alias("cutoff"))).alias("x")).select("series", "x.q", "x.cutoff")
    hit = F.col("amplitude") >= F.col("cutoff")
    out = rows.where(~early).join(cuts, "series").groupBy("series", "q", "cutoff").agg(F.count_if(hit).alias("chosen"), F.coalesce(F.avg(F.when(hit, F.col("duration_s"))), F.lit(0.0)).alias("mean_duration"))
    return out.select("series", "q", r6(F.col("cutoff"), "cutoff", 4), "chosen", r6(F.col("mean_duration"), "mean_duration", 4))


PREDICTIONS = """p AS (SELECT l_orderkey AS id, l_linenumber AS line, l_discount * 10 AS side_probability, l_extendedprice / 1000 AS predicted_long_pnl, l_quantity AS predicted_short_pnl,
  l_tax * 10 AS long_tail_probability, l_discount AS short_tail_probability, l_tax AS side_probability_std, l_discount AS long_tail_probability_std, l_tax AS short_tail_probability_std,
  l_quantity / 10 AS predicted_long_pnl_std, l_tax AS predicted_short_pnl_std, l_discount * 5 AS opportunity_probability FROM lineitem)"""


@P.add(f"""WITH {PREDICTIONS}, s AS (SELECT *, CASE WHEN side_probability >= 0.5 THEN 1 ELSE -1 END AS by_class, CASE WHEN predicted_long_pnl >= predicted_short_pnl THEN 1 ELSE -1 END AS by_value,
  CASE WHEN predicted_long_pnl - 25.0 * long_tail_probability >= predicted_short_pnl - 25.0 * short_tail_probability THEN 1 ELSE -1 END AS by_risk,
  sqrt(predicted_long_pnl_std ** 2 + predicted_short_pnl_std ** 2 + 625.0 * (long_tail_probability_std ** 2 + short_tail_probability_std ** 2)) AS doubt FROM p)
SELECT id, line, by_class, by_value, by_risk, round(-(CASE WHEN by_risk > 0 THEN long_tail_probability ELSE short_tail_probability END), 6) AS negative_tail,
  round((CASE WHEN by_risk > 0 THEN predicted_long_pnl ELSE predicted_short_pnl END) - 25.0 * (CASE WHEN by_risk > 0 THEN long_tail_probability ELSE short_tail_probability END) + 1.23e-6, 5) AS risk_edge,
  round(-doubt + 1.23e-6, 5) AS negative_doubt, round(abs((predicted_long_pnl - 25.0 * long_tail_probability) - (predicted_short_pnl - 25.0 * short_tail_probability)) / (1 + doubt) + 1.23e-6, 5) AS evidence FROM s""")
def decision_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Sides by the three modes, and the scores by which candidates are filtered, on made-up predictions."""
    c = F.col
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), (c("l_discount") * 10).alias("side_probability"), (c("l_extendedprice") / 1000).alias("predicted_long_pnl"), c("l_quantity").alias("predicted_short_pnl"),
        (c("l_tax") * 10).alias("long_tail_probability"), c("l_discount").alias("short_tail_probability"), c("l_tax").alias("side_probability_std"), c("l_discount").alias("long_tail_probability_std"), c("l_tax").alias("short_tail_probability_std"),
        (c("l_quantity") / 10).alias("predicted_long_pnl_std"), c("l_tax").alias("predicted_short_pnl_std"), (c("l_discount") * 5).alias("opportunity_probability"),
    )
    side = D.side_by("risk", 25.0)
    s = D.scores(side, 25.0)
    return rows.select("id", "line", D.side_by("classifier").alias("by_class"), D.side_by("value").alias("by_value"), side.alias("by_risk"), r6(s["negative_tail_probability"], "negative_tail"), r6(s["risk_edge"] + 1.23e-6, "risk_edge", 5), r6(s["negative_risk_uncertainty"] + 1.23e-6, "negative_doubt", 5), r6(s["risk_evidence"] + 1.23e-6, "evidence", 5))


@P.add(f"""WITH {FILLS}, t AS (SELECT series, start // {DAY} AS day, start, CAST(CASE WHEN side < 0 THEN x1_first_bid - e_first_ask ELSE e_first_bid - x1_first_ask END AS DOUBLE) AS pnl FROM fills WHERE x1_first_bid IS NOT NULL),
c AS (SELECT series, quantile_cont(pnl, 0.05) AS p05 FROM t GROUP BY series)
SELECT series, count(pnl) AS trades, round(avg(pnl), 5) AS mean, round(median(pnl), 5) AS median, sum(pnl) AS total, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(any_value(p05), 5) AS p05,
  round(avg(CASE WHEN pnl <= p05 THEN pnl END), 5) AS cvar05, min(pnl) AS worst, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END), 0), 5) AS profit_factor,
  round(coalesce(stddev_samp(pnl) / sqrt(count(pnl)), 0), 4) AS standard_error, count(DISTINCT day) AS days, round(avg(pnl) + 0.1 * avg(CASE WHEN pnl <= p05 THEN pnl END) - 0.5 * coalesce(stddev_samp(pnl) / sqrt(count(pnl)), 0), 4) AS robust_score
FROM t JOIN c USING (series) GROUP BY series""")
def trade_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = D.summary(event_trades(spark, sf), "pnl", "day", ["series"])
    places = {"win_rate": 6, "standard_error": 4, "robust_score": 4}
    return out.select(*[c if c in ("series", "trades", "total", "worst", "days") else r6(F.col(c), c, places.get(c, 5)) for c in out.columns])


def event_trades(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    pnl = F.when(c("side") < 0, c("x1_first_bid") - c("e_first_ask")).otherwise(c("e_first_bid") - c("x1_first_ask"))
    return fills(spark, sf).where(c("x1_first_bid").isNotNull()).select("series", F.floor(c("start") / DAY).alias("day"), "start", pnl.cast("double").alias("pnl"))


@P.add(f"""WITH {FILLS}, t AS (SELECT series, start, CASE WHEN side < 0 THEN x1_first_bid - e_first_ask ELSE e_first_bid - x1_first_ask END AS pnl FROM fills WHERE x1_first_bid IS NOT NULL),
r AS (SELECT *, sum(pnl) OVER (PARTITION BY series ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM t),
m AS (SELECT *, greatest(max(run) OVER (PARTITION BY series ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS top FROM r)
SELECT series, CAST(max(top - run) AS DOUBLE) AS max_drawdown, CAST(arg_max(run, start) AS DOUBLE) AS total FROM m GROUP BY series""")
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return D.drawdown(event_trades(spark, sf), "pnl", ["series"], ["start"])
