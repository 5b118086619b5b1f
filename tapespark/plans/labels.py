"""Scores, consensus, smoothing, peaks, lines, splits and normalisers on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import scores as C
from ..operators import temporal as T
from .base import BARS, HOUR, SEG, Plans, averaged, averaged_sql, bars, r6

P = Plans()
QUERIES, SQL = P.QUERIES, P.SQL
HORIZONS = (2.5 * 3600, 4 * 3600.0, 6 * 3600.0)
COST = 10.0


def quoted(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("series", "segment_id", "bar", "observed", F.col("last_bid").cast("double").alias("bid"), F.col("last_ask").cast("double").alias("ask"), (F.col("last_bid") > 0).alias("valid"))


def cube(spark: SparkSession, sf: str, cost: float = COST) -> DataFrame:
    return C.score_cube(quoted(spark, sf), SEG, "bar", HOUR, [h * 1e6 for h in HORIZONS], cost, 0.6, chunk=128).withColumn("horizon", F.col("horizon") / 1e6)


CUBE = BARS + f""", b AS (SELECT series, segment_id, bar // {HOUR} AS i, bar, CAST(last_bid AS DOUBLE) AS bid, CAST(last_ask AS DOUBLE) AS ask, last_bid > 0 AS valid FROM bars),
hz AS (SELECT unnest([9000.0, 14400.0, 21600.0])::DOUBLE AS horizon, unnest([2, 4, 6]) AS s, unnest([3, 4, 6]) AS c),
pairs AS (SELECT x.series, x.segment_id, x.bar AS a, y.bar AS z, y.i - x.i AS lag, greatest(1e4 * (y.bid / x.ask - 1) - {COST}, 0) AS l, greatest(1e4 * (x.bid / y.ask - 1) - {COST}, 0) AS sh
  FROM b x JOIN b y ON x.series = y.series AND x.segment_id = y.segment_id AND y.i > x.i AND y.i <= x.i + 6 WHERE x.valid AND y.valid),
f AS (SELECT series, a AS bar, horizon, sum(l) AS sl, sum(sh) AS ss, count(*) AS n FROM pairs JOIN hz ON lag <= s GROUP BY ALL),
r AS (SELECT series, z AS bar, horizon, sum(l) AS sl, sum(sh) AS ss, count(*) AS n FROM pairs JOIN hz ON lag <= s GROUP BY ALL),
cube AS (SELECT b.series, b.segment_id, b.bar, hz.horizon,
  CASE WHEN e.bar IS NOT NULL AND f.n >= greatest(1, ceil(0.6 * s)) THEN f.sl / f.n END AS fwd_long, CASE WHEN e.bar IS NOT NULL AND f.n >= greatest(1, ceil(0.6 * s)) THEN f.ss / f.n END AS fwd_short,
  CASE WHEN o.bar IS NOT NULL AND r.n >= greatest(1, ceil(0.6 * s)) THEN r.sl / r.n END AS bwd_long, CASE WHEN o.bar IS NOT NULL AND r.n >= greatest(1, ceil(0.6 * s)) THEN r.ss / r.n END AS bwd_short
  FROM b CROSS JOIN hz LEFT JOIN f ON f.series = b.series AND f.bar = b.bar AND f.horizon = hz.horizon LEFT JOIN r ON r.series = b.series AND r.bar = b.bar AND r.horizon = hz.horizon
  LEFT JOIN b e ON e.series = b.series AND e.segment_id = b.segment_id AND e.i = b.i + c LEFT JOIN b o ON o.series = b.series AND o.segment_id = b.segment_id AND o.i = b.i - c)"""
FOUR = ("fwd_long", "fwd_short", "bwd_long", "bwd_short")
#: Added before rounding, so that values halfway between two don't fall either way by the last bit.
NUDGE = 1.23e-6
ROUNDED = ", ".join(f"round({c} + {NUDGE}, 5) AS {c}" for c in FOUR)


@P.add(f"WITH {CUBE} SELECT series, bar, horizon, {ROUNDED} FROM cube")
def score_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Mean clipped edges ahead and behind for each horizon, null where censored."""
    return cube(spark, sf).select("series", "bar", "horizon", *[r6(F.col(c) + NUDGE, c, 5) for c in FOUR])


@P.add(f"""WITH {CUBE.replace(f'- {COST}', '- cost').replace('WHERE x.valid AND y.valid)', 'CROSS JOIN (SELECT unnest([0.0, 25.0])::DOUBLE AS cost) WHERE x.valid AND y.valid)').replace('lag, greatest', 'lag, cost, greatest').replace('SELECT series, a AS bar, horizon', 'SELECT cost, series, a AS bar, horizon').replace('SELECT series, z AS bar, horizon', 'SELECT cost, series, z AS bar, horizon')}
SELECT cost, f.series, f.bar, round(sl / n + {NUDGE}, 5) AS mean_long FROM f JOIN b USING (series, bar) JOIN b e ON e.series = b.series AND e.segment_id = b.segment_id AND e.i = b.i + 4 WHERE horizon = 14400""")
def cost_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """The same scores under several costs (no coverage needed here)."""
    out = None
    for cost in (0.0, 25.0):
        rows = C.score_cube(quoted(spark, sf), SEG, "bar", HOUR, [4 * 3600e6], cost, 0.0, chunk=128)
        part = rows.select(F.lit(cost).alias("cost"), "series", "segment_id", "bar", "fwd_long")
        out = part if out is None else out.unionByName(part)
    return out.where("fwd_long IS NOT NULL").select("cost", "series", "bar", r6(F.col("fwd_long") + NUDGE, "mean_long", 5))


KIND = "CASE WHEN [{}][series + 1] LIKE '%\\_spot' ESCAPE '\\' THEN 'spot' ELSE 'derivative' END".format(", ".join(f"'{v}'" for v in S.VENUES))


def kinds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kind", S.market_kind(F.element_at(F.array(*map(F.lit, S.VENUES)), (F.col("series") + 1).cast("int"))))


def agreed(spark: SparkSession, sf: str) -> DataFrame:
    return C.consensus(kinds(cube(spark, sf)), ["bar", "horizon"], "kind", require_all=False)


def _centre(c: str, kind: str) -> str:
    d = c[:3]
    return f"median(CASE WHEN kind = '{kind}' AND {d}_long IS NOT NULL THEN {c} END)"


AGREED = CUBE + f""", k AS (SELECT *, {KIND} AS kind FROM cube),
agreed AS (SELECT bar, horizon, {', '.join(f"0.5 * ({_centre(c, 'spot')} + {_centre(c, 'derivative')}) AS {c}" for c in FOUR)} FROM k GROUP BY ALL)"""


@P.add(f"WITH {AGREED} SELECT bar, horizon, {ROUNDED} FROM agreed")
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Half the sum of the spot and derivative medians, where any venue of each is valid."""
    return agreed(spark, sf).select("bar", "horizon", *[r6(F.col(c) + NUDGE, c, 5) for c in FOUR])


@P.add(f"""WITH {CUBE}, k AS (SELECT *, {KIND} AS kind FROM cube),
a AS (SELECT bar, horizon, count(*) AS n, count(fwd_long) AS ok, count(DISTINCT kind) AS kinds, {', '.join(f"0.5 * ({_centre(c, 'spot')} + {_centre(c, 'derivative')}) AS {c}" for c in FOUR[:2])} FROM k GROUP BY ALL)
SELECT bar, horizon, round(CASE WHEN n = ok AND kinds = 2 THEN fwd_long END, 5) AS fwd_long, round(CASE WHEN n = ok AND kinds = 2 THEN fwd_short END, 5) AS fwd_short FROM a""")
def consensus_all(spark: SparkSession, sf: str) -> DataFrame:
    """The strict form: one invalid venue of those with rows invalidates the consensus."""
    out = C.consensus(kinds(cube(spark, sf)), ["bar", "horizon"], "kind", require_all=True)
    return out.select("bar", "horizon", r6(F.col("fwd_long"), "fwd_long", 5), r6(F.col("fwd_short"), "fwd_short", 5))


WEIGHTS = C.horizon_weights([h / 3600 for h in HORIZONS], 4.0)


def _blend(c: str) -> str:
    return f"""(SELECT CASE WHEN count(*) > 0 THEN 0.7 * arg_min(x, (x, h)) FILTER (run >= 0.5 * total - 1e-12) + 0.3 * sum(w * x) / sum(w) END FROM (
  SELECT x, w, h, sum(w) OVER (ORDER BY x, h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(w) OVER () AS total FROM (SELECT a.{c} AS x, a.horizon AS h, list_extract([{', '.join(map(repr, WEIGHTS))}]::DOUBLE[], list_position([9000, 14400, 21600], CAST(a.horizon AS INTEGER))) AS w FROM agreed a WHERE a.bar = t.bar AND a.{c} IS NOT NULL)))"""


@P.add(f"WITH {AGREED}, t AS (SELECT DISTINCT bar FROM agreed) SELECT bar, {', '.join(f'round({_blend(c)}, 4) AS {c}' for c in FOUR[:2])} FROM t")
def horizon_blend(spark: SparkSession, sf: str) -> DataFrame:
    """0.7 weighted median + 0.3 weighted mean over the horizons with any valid, by Gaussian weights."""
    out = C.over_horizons(agreed(spark, sf), ["bar"], HORIZONS, WEIGHTS, require_all=False)
    return out.select("bar", r6(F.col("fwd_long"), "fwd_long", 4), r6(F.col("fwd_short"), "fwd_short", 4))


@P.add(f"""WITH {BARS}, b AS (SELECT *, last_bid > 0 AS valid FROM bars), e AS (SELECT series, bar, {', '.join(f"valid AND coalesce(lead(valid, {k}) OVER w, false) AS valid_{k}, 1e4 * (CAST(lead(last_bid, {k}) OVER w AS DOUBLE) / CASE WHEN last_ask <> 0 THEN last_ask END - 1) - 10 AS l{k}, 1e4 * (CAST(last_bid AS DOUBLE) / nullif(lead(last_ask, {k}) OVER w, 0) - 1) - 10 AS s{k}" for k in (1, 4))} FROM b WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar))
SELECT series, bar, {', '.join(f"valid_{k}, round(CASE WHEN valid_{k} THEN least(greatest(l{k} / 10, -8), 8) ELSE 0 END, 6) AS long_{k}, round(CASE WHEN valid_{k} THEN least(greatest(s{k} / 10, -8), 8) ELSE 0 END, 6) AS short_{k}" for k in (1, 4))} FROM e""")
def forward_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Dense executable edges ahead, scaled and clipped."""
    out = C.dense_edges(quoted(spark, sf).withColumn("ask", F.nullif("ask", F.lit(0.0))), SEG, ["bar"], (1, 4), 10.0)
    return out.select("series", "bar", *[x for k in (1, 4) for x in (F.col(f"valid_{k}"), r6(F.col(f"long_{k}"), f"long_{k}"), r6(F.col(f"short_{k}"), f"short_{k}"))])


@P.add(f"""WITH {CUBE.replace('0.6 * s', '0.95 * s')} SELECT series, bar, horizon, round(coalesce(bwd_long, 0) + {NUDGE}, 5) AS long_edge, round(coalesce(bwd_short, 0) + {NUDGE}, 5) AS short_edge, bwd_long IS NOT NULL AS valid FROM cube""")
def backward_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Realised edges as features: nearly full coverage, 0 and a flag where there are none."""
    rows = C.score_cube(quoted(spark, sf), SEG, "bar", HOUR, [h * 1e6 for h in HORIZONS], COST, 0.95, chunk=128)
    zero = lambda c, n: F.round(F.coalesce(F.col(c), F.lit(0.0)) + NUDGE, 5).alias(n)
    return rows.select("series", "bar", (F.col("horizon") / 1e6).alias("horizon"), zero("bwd_long", "long_edge"), zero("bwd_short", "short_edge"), F.col("bwd_long").isNotNull().alias("valid"))


@P.add(f"""WITH {BARS}, m AS (SELECT series, bar, last_bid + last_ask AS mid, last_bid > 0 AS valid FROM bars),
p AS (SELECT bar, lead(mid, 1) OVER w AS now, lead(mid, 4) OVER w AS later, coalesce(lead(valid, 1) OVER w AND lead(valid, 4) OVER w, false) AS ok FROM m WINDOW w AS (PARTITION BY series ORDER BY bar))
SELECT bar, round(0.5 + 0.5 * count(CASE WHEN ok AND later > now THEN 1 END) / greatest(count(CASE WHEN ok THEN 1 END), 1), 6) AS up, round(0.5 + 0.5 * count(CASE WHEN ok AND later < now THEN 1 END) / greatest(count(CASE WHEN ok THEN 1 END), 1), 6) AS down FROM p GROUP BY bar""")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of venues that rise and fall together after the latency."""
    rows = bars(spark, sf).select("series", "bar", (F.col("last_bid") + F.col("last_ask")).alias("mid"), (F.col("last_bid") > 0).alias("valid"))
    return C.agreement(rows, "series", "bar", "bar", 3, 1).select("bar", r6(F.col("up"), "up"), r6(F.col("down"), "down"))


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).withColumns({"mid": F.col("last_bid") + F.col("last_ask"), "place": (F.col("bar") / HOUR).cast("long") - 470_000})


LINES = BARS + f""", m AS (SELECT series, segment_id, bar, bar // {HOUR} AS i, last_bid + last_ask AS mid FROM bars),
j AS (SELECT x.series, x.segment_id, x.bar, count(*) AS n, sum((y.i - x.i) * (y.mid - x.mid)) AS ty, sum((y.mid - x.mid) * (y.mid - x.mid)) AS yy, arg_max(y.mid, y.i) - max(x.mid) AS actual
  FROM m x JOIN m y ON x.series = y.series AND x.segment_id = y.segment_id AND y.i > x.i AND y.i <= x.i + 6 GROUP BY ALL),
ahead AS (SELECT series, segment_id, bar, CAST(ty AS DOUBLE) / 91.0 AS slope, CAST(ty AS DOUBLE) / 91.0 * 6 AS fit, CAST(actual AS BIGINT) AS actual, sqrt(greatest(CAST(yy AS DOUBLE) - CAST(ty AS DOUBLE) * ty / 91.0, 0) / 6) AS rmse FROM j WHERE n = 6),
d AS (SELECT series, segment_id, bar, CAST(mid - lag(mid) OVER w AS DOUBLE) AS r FROM m WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar)),
v AS (SELECT *, CASE WHEN count(r) OVER w = 4 THEN greatest(sqrt(sum(r * r) OVER w / 4.0), 100.0) END AS sigma FROM d WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


@P.add(f"""WITH {LINES} SELECT series, bar, round(slope, 5) AS slope, round(fit, 5) AS fit, actual, round(rmse, 2) AS rmse, round(sigma, 5) AS sigma, round(atan(slope * sqrt(6.0) / sigma), 6) AS angle,
  round(sqrt(least(greatest(abs(slope) * sqrt(91.0 / 6) / (abs(slope) * sqrt(91.0 / 6) + rmse + 1e-6) * abs(fit) / (abs(fit) + sigma * sqrt(6.0)), 0), 1)), 5) AS quality, round(tan(atan(slope * sqrt(6.0) / sigma)) * sigma / sqrt(6.0), 4) AS slope_again
FROM ahead JOIN v USING (series, segment_id, bar) WHERE sigma IS NOT NULL""")
def ols_line(spark: SparkSession, sf: str) -> DataFrame:
    """Lines anchored at each row over the next six, their angle against past volatility, and quality."""
    rows = placed(spark, sf)
    rows = rows.withColumn("d", T.lag_delta(F.col("mid"), SEG, ["bar"]).cast("double"))
    sigma = T.full_rms(F.col("d"), SEG, ["bar"], 4)
    rows = rows.withColumns(C.line("mid", "place", SEG, ["bar"], 6) | {"sigma": F.when(sigma.isNotNull(), F.greatest(sigma, F.lit(100.0)))})
    rows = rows.where(F.col("slope").isNotNull() & F.col("sigma").isNotNull()).withColumn("angle", C.angle(F.col("slope"), F.col("sigma"), 6.0))
    quality = C.line_quality(F.col("slope"), F.col("end"), F.col("rmse"), F.col("sigma") * 6.0**0.5, 6)
    return rows.select("series", "bar", r6(F.col("slope"), "slope", 5), r6(F.col("end"), "fit", 5), "actual", r6(F.col("rmse"), "rmse", 2), r6(F.col("sigma"), "sigma", 5), r6(F.col("angle"), "angle"), r6(quality, "quality", 5), r6(C.angle_to_slope(F.col("angle"), F.col("sigma"), 6.0), "slope_again", 4))


@P.add(f"""WITH {LINES}, bj AS (SELECT y.series, y.segment_id, y.bar, count(*) AS n, x.i AS x0, sum((z.i - x.i) * (z.mid - x.mid)) AS ty, sum((z.mid - x.mid) * (z.mid - x.mid)) AS yy FROM m y JOIN m x ON x.series = y.series AND x.segment_id = y.segment_id AND x.i = y.i - 6 JOIN m z ON z.series = y.series AND z.segment_id = y.segment_id AND z.i > x.i AND z.i <= y.i GROUP BY ALL),
past AS (SELECT series, segment_id, bar, CAST(ty AS DOUBLE) / 91.0 * 6 AS fit, CAST(ty AS DOUBLE) / 91.0 AS slope, sqrt(greatest(CAST(yy AS DOUBLE) - CAST(ty AS DOUBLE) * ty / 91.0, 0) / 6) AS rmse, sqrt(CAST(yy AS DOUBLE) / 6) AS path FROM bj WHERE n = 6),
q AS (SELECT series, segment_id, bar, fit, sqrt(least(greatest(abs(slope) * sqrt(91.0 / 6) / (abs(slope) * sqrt(91.0 / 6) + rmse + 1e-6) * abs(fit) / (abs(fit) + path + 1e-6), 0), 1)) AS quality FROM past)
SELECT a.series, a.bar, round(q.fit, 5) AS past_fit, round(q.quality, 5) AS past_quality, CASE WHEN q.quality < 0.25 THEN 'friction' WHEN (q.fit < 0) = (a.fit < 0) THEN 'continuation' ELSE 'reversal' END AS regime FROM ahead a JOIN q USING (series, segment_id, bar)""")
def regime(spark: SparkSession, sf: str) -> DataFrame:
    """Past lines against those ahead: friction, continuation or reversal."""
    rows = placed(spark, sf).withColumns({f"a_{k}": v for k, v in C.line("mid", "place", SEG, ["bar"], 6).items()} | {f"p_{k}": v for k, v in C.line("mid", "place", SEG, ["bar"], 6, backward=True).items()})
    rows = rows.where("a_slope IS NOT NULL AND p_slope IS NOT NULL")
    quality = C.line_quality(F.col("p_slope"), F.col("p_end"), F.col("p_rmse"), F.col("p_path_rms") + 1e-6, 6)
    kind = F.when(quality < 0.25, "friction").when((F.col("p_end") < 0) == (F.col("a_end") < 0), "continuation").otherwise("reversal")
    return rows.select("series", "bar", r6(F.col("p_end"), "past_fit", 5), r6(quality, "past_quality", 5), kind.alias("regime"))


@P.add(f"""WITH {BARS} SELECT series, bar, round(CASE WHEN count(CASE WHEN observed THEN 1 END) OVER w = 3 THEN avg(close) OVER w END, 6) AS future_mean FROM bars WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""")
def future_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over the next rows where all of them are valid."""
    w = T.ahead(SEG, ["bar"], 1, 3)
    return bars(spark, sf).select("series", "bar", r6(F.when(F.sum(F.col("observed").cast("int")).over(w) == 3, F.avg("close").over(w)), "future_mean"))


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    """close in units of 100 within runs of bars whose ticks aren't all one: valid stretches inside segments."""
    rows = bars(spark, sf).withColumn("x", F.col("close") / 100.0)
    return C.runs(rows, SEG, ["bar"], F.col("low") > 300).where("run IS NOT NULL")


RUN = [*SEG, "run"]
RUNS = BARS + """, flagged AS (SELECT *, close / 100.0::DOUBLE AS x, sum(CASE WHEN low > 300 THEN 0 ELSE 1 END) OVER (PARTITION BY series, segment_id ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM bars),
rr AS (SELECT *, row_number() OVER (PARTITION BY series, segment_id, run ORDER BY bar) AS p, count(*) OVER (PARTITION BY series, segment_id, run) AS n FROM flagged WHERE low > 300)"""
KERNEL = C.gaussian(1.0, 1.5, 2.0)


@P.add(f"""WITH {RUNS}, o AS (SELECT unnest(range(-2, 3)) AS k), j AS (SELECT a.series, a.bar, median(b.x) AS m FROM rr a CROSS JOIN o JOIN rr b ON b.series = a.series AND b.segment_id = a.segment_id AND b.run = a.run AND b.p = least(greatest(a.p + k, 1), a.n) GROUP BY ALL)
SELECT series, bar, round(m, 6) AS smooth FROM j""")
def rolling_median(spark: SparkSession, sf: str) -> DataFrame:
    """Centred median of five within valid runs, ends repeated."""
    return C.centred_median(run_rows(spark, sf), "x", RUN, ["bar"], 5, "m").select("series", "bar", r6(F.col("m"), "smooth"))


@P.add(f"""WITH {RUNS}, o AS (SELECT unnest(range(-{len(KERNEL) // 2}, {len(KERNEL) // 2 + 1})) AS k, unnest([{', '.join(map(repr, KERNEL))}]::DOUBLE[]) AS w), j AS (SELECT a.series, a.bar, sum(b.x * w) AS m FROM rr a CROSS JOIN o JOIN rr b ON b.series = a.series AND b.segment_id = a.segment_id AND b.run = a.run AND b.p = least(greatest(a.p + k, 1), a.n) GROUP BY ALL)
SELECT series, bar, round(m, 5) AS smooth FROM j""")
def gauss_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return C.smoothed(run_rows(spark, sf), "x", RUN, ["bar"], KERNEL, "m").select("series", "bar", r6(F.col("m"), "smooth", 5))


@P.add(f"""WITH {RUNS}, l AS (SELECT *, x > 50 AS up, sum(CASE WHEN x > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY series, segment_id, run ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lobe FROM rr),
s AS (SELECT *, max(x) OVER w AS top, count(*) OVER w AS width, sum(CAST(close AS BIGINT)) OVER w AS area FROM l WINDOW w AS (PARTITION BY series, segment_id, run, lobe, up))
SELECT series, bar, CASE WHEN up AND (top < 300 OR width < 2 OR area < 60000) THEN 0 ELSE x END AS kept FROM s""")
def hump_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Lobes that are too low, too short or too small become 0."""
    rows = run_rows(spark, sf).withColumn("c", F.col("close").cast("double"))
    out = C.without_humps(rows, "c", RUN, ["bar"], 1.0, 30_000.0, 2.0, 60_000.0, 5_000.0, "kept")
    return out.select("series", "bar", F.when(F.col("kept") == 0, 0.0).otherwise(F.col("x")).alias("kept"))


@P.add(f"""WITH {RUNS}, z AS (SELECT *, sum(CASE WHEN x <= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY series, segment_id, run ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zone FROM rr),
t AS (SELECT *, max(x) OVER (PARTITION BY series, segment_id, run, zone) AS top FROM z WHERE x > 100)
SELECT series, segment_id, run, min(bar) AS start, max(bar) AS "end", min(CASE WHEN x = top THEN bar END) AS peak, max(x) AS score, min(CASE WHEN x / top >= 0.75 THEN bar END) AS core_start, max(CASE WHEN x / top >= 0.75 THEN bar END) AS core_end FROM t WHERE top >= 300 GROUP BY series, segment_id, run, zone""")
def peak_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches above a low level that reach a high one, with peak and core."""
    return C.peak_zones(run_rows(spark, sf), "x", RUN, "bar", 300.0, 100.0, 0.75).withColumn("run", F.col("run").cast("decimal(38,0)"))


PEAK_RUN = "series, segment_id, run"


def peaks_sql(rows: str, x: str, high: float, apart: int) -> str:
    """chosen: greedy suppression as a recursion over the candidates of a run, the best first; halves: the rows that belong to each."""
    same = lambda a, b: f"{a}.series = {b}.series AND {a}.segment_id = {b}.segment_id AND {a}.run = {b}.run"
    return f"""cand AS (SELECT *, row_number() OVER (PARTITION BY {PEAK_RUN} ORDER BY {x} DESC, p) AS o FROM (SELECT *, lag({x}) OVER w AS before, lead({x}) OVER w AS after FROM {rows} WINDOW w AS (PARTITION BY {PEAK_RUN} ORDER BY bar)) WHERE {x} >= {high} AND {x} >= before AND {x} > after),
taken({PEAK_RUN}, o, found) AS (
  SELECT DISTINCT {PEAK_RUN}, 0::BIGINT, []::BIGINT[] FROM cand
  UNION ALL SELECT c.series, c.segment_id, c.run, c.o, CASE WHEN len(list_filter(t.found, lambda f: abs(f - c.p) <= {apart})) = 0 THEN list_append(t.found, c.p) ELSE t.found END FROM taken t JOIN cand c ON {same('c', 't')} AND c.o = t.o + 1),
last AS (SELECT {PEAK_RUN}, found FROM taken QUALIFY row_number() OVER (PARTITION BY {PEAK_RUN} ORDER BY o DESC) = 1),
chosen AS (SELECT *, coalesce((lag(p) OVER w + p - 2) // 2 + 2, 1) AS lo, coalesce((p + lead(p) OVER w - 2) // 2 + 2, n + 1) AS hi FROM (SELECT l.series, l.segment_id, l.run, r.p, r.n, r.bar, r.{x} AS top FROM last l JOIN {rows} r ON {same('r', 'l')} AND list_contains(l.found, r.p)) WINDOW w AS (PARTITION BY {PEAK_RUN} ORDER BY p)),
halves AS (SELECT c.*, r.p AS q, r.bar AS t, r.{x} AS v FROM chosen c JOIN {rows} r ON {same('r', 'c')} AND r.p >= c.lo AND r.p < c.hi)"""


@P.add(f"""WITH RECURSIVE {RUNS}, {peaks_sql('rr', 'x', 100.0, 3)},
zone AS (SELECT *, coalesce(max(CASE WHEN q < p AND v <= 20 THEN q END) OVER w + 1, lo) AS za, coalesce(min(CASE WHEN q > p AND v <= 20 THEN q END) OVER w, hi) AS zz FROM halves WINDOW w AS (PARTITION BY {PEAK_RUN}, p)),
core AS (SELECT *, coalesce(max(CASE WHEN q < p AND v < top * 0.75 THEN q END) OVER w + 1, za) AS ca, coalesce(min(CASE WHEN q > p AND v < top * 0.75 THEN q END) OVER w, zz) AS cz FROM zone WHERE q >= za AND q < zz WINDOW w AS (PARTITION BY {PEAK_RUN}, p))
SELECT series, segment_id, CAST(run AS BIGINT) AS run, bar AS peak, max(CASE WHEN q = za THEN t END) AS start, max(CASE WHEN q = zz - 1 THEN t END) AS "end", max(CASE WHEN q = ca THEN t END) AS core_start, max(CASE WHEN q = cz - 1 THEN t END) AS core_end, top AS score FROM core GROUP BY {PEAK_RUN}, p, bar, top""")
def nms_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks by greedy suppression, with zones that end halfway to the next."""
    return C.separated_peaks(run_rows(spark, sf), "x", RUN, "bar", 100.0, 20.0, 0.75, 3)


def sampled(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).where("observed").select("series", "bar", "segment_id", "close", F.col("last_bid").alias("bid"), "weight")


@P.add(f"""WITH {BARS}, s AS (SELECT series, bar FROM bars WHERE observed), n AS (SELECT count(*) AS n FROM s), o AS (SELECT bar, row_number() OVER (ORDER BY bar) - 1 AS i FROM s),
b AS (SELECT max(CASE WHEN i = greatest(1, least(n - 2, round_even(n * 0.6, 0))) THEN bar END) AS b1, max(CASE WHEN i = greatest(2, least(n - 1, round_even(n * (0.6 + 0.2), 0))) THEN bar END) AS b2 FROM o, n)
SELECT series, bar, CASE WHEN bar < b1 - {2 * HOUR} THEN 'train' WHEN bar >= b1 + {2 * HOUR} AND bar < b2 - {2 * HOUR} THEN 'validation' WHEN bar >= b2 + {2 * HOUR} THEN 'holdout' END AS split FROM s, b""")
def splits_purged(spark: SparkSession, sf: str) -> DataFrame:
    return C.chronological(sampled(spark, sf), "bar", 2 * HOUR, F.lit(True)).select("series", "bar", "split")


@P.add(f"""WITH {BARS}, s AS (SELECT series, bar FROM bars WHERE observed), n AS (SELECT count(*) AS n, CAST(round_even(count(*) * (1 - 0.2), 0) AS BIGINT) AS h FROM s), o AS (SELECT bar, row_number() OVER (ORDER BY bar) - 1 AS i FROM s),
e AS (SELECT h, h * 2 // 8 AS a2, greatest(h * 2 // 8 + 1, h * 3 // 8 - 1) AS z2, h * 5 // 8 AS a5, greatest(h * 5 // 8 + 1, h * 6 // 8 - 1) AS z5 FROM n),
b AS (SELECT max(CASE WHEN i = h THEN bar END) AS held, max(CASE WHEN i = a2 THEN bar END) AS a2, max(CASE WHEN i = z2 THEN bar END) AS z2, max(CASE WHEN i = a5 THEN bar END) AS a5, max(CASE WHEN i = z5 THEN bar END) AS z5 FROM o, e)
SELECT series, bar, CASE WHEN (bar >= a2 + {HOUR} AND bar <= z2 - {HOUR}) OR (bar >= a5 + {HOUR} AND bar <= z5 - {HOUR}) THEN 'validation'
  WHEN bar < held - {HOUR} AND NOT (bar >= a2 - {HOUR} AND bar <= z2 + {HOUR}) AND NOT (bar >= a5 - {HOUR} AND bar <= z5 + {HOUR}) THEN 'train' WHEN bar >= held + {HOUR} THEN 'holdout' END AS split FROM s, b""")
def splits_blocked(spark: SparkSession, sf: str) -> DataFrame:
    return C.blocked(sampled(spark, sf), "bar", HOUR, F.lit(True)).select("series", "bar", "split")


@P.add(f"""WITH {BARS}, t AS (SELECT *, CAST(close AS DOUBLE) AS x, CAST(weight AS DOUBLE) AS y FROM bars WHERE observed), h AS (SELECT quantile_cont(bar, 0.6) AS cut FROM t),
f AS (SELECT series, quantile_cont(x, 0.5) AS xm, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349 AS xs, quantile_cont(y, 0.5) AS ym, (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.349 AS ys FROM t, h WHERE bar <= cut GROUP BY series)
SELECT t.series, t.bar, round(least(greatest((x - xm) / CASE WHEN xs <= 1e-6 THEN 1 ELSE xs END, -8), 8) + {NUDGE}, 5) AS x, round(least(greatest((y - ym) / CASE WHEN ys <= 1e-6 THEN 1 ELSE ys END, -8), 8) + {NUDGE}, 5) AS y FROM t JOIN f USING (series)""")
def robust_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Median and IQR per venue, fitted on the earlier rows, applied to all."""
    rows = sampled(spark, sf).select("series", "bar", F.col("close").cast("double").alias("x"), F.col("weight").cast("double").alias("y"))
    cut = rows.agg(F.percentile("bar", F.lit(0.6)).alias("cut")).first()["cut"]
    fit = C.robust_fit(rows.where(F.col("bar") <= cut), ["x", "y"], ["series"])
    return C.robust_apply(rows, fit, ["x", "y"], ["series"]).select("series", "bar", r6(F.col("x") + NUDGE, "x", 5), r6(F.col("y") + NUDGE, "y", 5))


@P.add(f"""WITH {BARS}, t AS (SELECT series, bar, CAST(close AS DOUBLE) AS x FROM bars WHERE observed), f AS (SELECT quantile_cont(x, 0.5) AS m, greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1e-6) AS s FROM t)
SELECT series, bar, round(least(greatest((x - m) / s, -12), 12), 6) AS x FROM t, f""")
def plain_norm(spark: SparkSession, sf: str) -> DataFrame:
    """The other contract: plain IQR with a floor, clipped at 12."""
    rows = sampled(spark, sf).select("series", "bar", F.col("close").cast("double").alias("x"))
    fit = C.robust_fit(rows, ["x"], divisor=1.0, replace=False)
    return C.robust_apply(rows, fit, ["x"], clip=12.0).select("series", "bar", r6(F.col("x"), "x"))


@P.add(f"""WITH {averaged_sql(60)} SELECT series, bar, round(CASE WHEN last_bid > 0 AND avg_60 > 0 THEN 10000 * (last_bid / (avg_60 / 2) - 1) ELSE 0 END, 4) AS bid_bps, round(CASE WHEN last_ask > 0 AND avg_60 > 0 THEN 10000 * (last_ask / (avg_60 / 2) - 1) ELSE 0 END, 4) AS ask_bps FROM averaged""")
def stationary(spark: SparkSession, sf: str) -> DataFrame:
    """Prices as distances from a reference, which carry no price level."""
    rows = averaged(spark, sf, 60)
    ref = F.col("avg_60") / 2
    return rows.select("series", "bar", r6(C.relative_bps(F.col("last_bid").cast("double"), ref), "bid_bps", 4), r6(C.relative_bps(F.col("last_ask").cast("double"), ref), "ask_bps", 4))


@P.add(f"""WITH {BARS}, s AS (SELECT *, row_number() OVER (PARTITION BY series, segment_id ORDER BY bar) AS p, count(CASE WHEN observed THEN NULL ELSE 1 END) OVER (PARTITION BY series, segment_id ORDER BY bar ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS bad FROM bars)
SELECT series, bar, p >= 4 AND bad = 0 AS eligible, CAST((p - 1) // 6 AS BIGINT) AS episode, p % 6 = 1 AS starts FROM s""")
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a full valid context in their segment, and episodes of fixed length."""
    place = F.row_number().over(Window.partitionBy(*SEG).orderBy("bar"))
    bad = F.sum((~F.col("observed")).cast("int")).over(T.over(SEG, ["bar"], 3))
    return bars(spark, sf).select("series", "bar", ((place >= 4) & (bad == 0)).alias("eligible"), F.floor((place - 1) / 6).alias("episode"), (F.pmod(place, F.lit(6)) == 1).alias("starts"))
