"""Streams and models on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..streaming import streams as S
from .base import BARS, DAY, HOUR, SEG, TICK, VENUES, Plans, bars, cents, micros, r6, table
from .books import LEVELS
from .ingest import scratch

P = Plans()
QUERIES, SQL = P.QUERIES, P.SQL


def live_ticks(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    e = S.source(spark, sf, "events", schema)
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), micros(F.col("ts")).alias("ts"), F.pmod("user_id", F.lit(VENUES)).alias("series"), cents(F.col("value")).alias("px"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")


def processed(spark: SparkSession, stream: DataFrame, tag: str) -> DataFrame:
    return S.run(stream, scratch(spark, tag), scratch(spark, f"{tag}-state"))


@P.add(f"""WITH {TICK}, m AS (SELECT max(ts) - 2000000 AS settled FROM tick), b AS (SELECT series, ts // {HOUR} * {HOUR} AS bar, arg_min(px, seq) AS open, max(px) AS high, min(px) AS low, arg_max(px, seq) AS close, count(*) AS ticks FROM tick GROUP BY ALL)
SELECT b.* FROM b, m WHERE bar + {HOUR} <= settled""")
def stream_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars of a stream; those that the watermark hasn't passed wait."""
    return processed(spark, S.bars(live_ticks(spark, sf), "1 hour", "px", ["ts", "seq"]), "bars")


@P.add(f"""WITH {LEVELS}, e AS (SELECT *, CAST(sum(CASE WHEN is_snapshot THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS epoch FROM lvl),
ends AS (SELECT series, epoch, lead(min(ts)) OVER (PARTITION BY series ORDER BY epoch) AS over FROM e GROUP BY series, epoch),
v AS (SELECT e.*, lead(ts) OVER (PARTITION BY series, epoch, side, price ORDER BY ts, seq) AS nxt FROM e WHERE side IS NOT NULL),
a AS (SELECT e.series, e.ts, e.seq, e.epoch, max(CASE WHEN v.side = 'bid' THEN v.price END) AS b, min(CASE WHEN v.side = 'ask' THEN v.price END) AS a FROM e LEFT JOIN v ON v.series = e.series AND v.epoch = e.epoch AND v.ts <= e.ts AND (v.nxt IS NULL OR v.nxt > e.ts) AND v.quantity > 0 GROUP BY ALL)
SELECT series, ts, seq, epoch, CASE WHEN epoch > 0 AND b < a THEN b END AS bid, CASE WHEN epoch > 0 AND b < a THEN a END AS ask FROM a""")
def stream_book(spark: SparkSession, sf: str) -> DataFrame:
    """The best bid and ask after every update, from a book kept as keyed state."""
    t = live_ticks(spark, sf)
    kind, px = F.col("event_type"), F.col("px")
    side = F.when(kind.isin("click", "view"), "bid").when(kind.isin("signup", "purchase"), "ask")
    price = F.when(side == "bid", 100_000 - F.pmod(px, F.lit(50))).when(side == "ask", 100_001 + F.pmod(px, F.lit(50)))
    rows = t.select("series", "ts", "seq", side.alias("side"), price.alias("price"), F.col("k").alias("quantity"), (kind == "error").alias("is_snapshot"))
    return processed(spark, S.book(rows), "book")


@P.add(f"""WITH {TICK}, q AS (SELECT series, ts, ts // {DAY} AS day, CAST(px AS DOUBLE) AS score, count(*) OVER h AS n, quantile_cont(CAST(px AS DOUBLE), 0.9) OVER h AS cut FROM tick WINDOW h AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN n >= 20 THEN cut ELSE 25000 END AS cutoff FROM q)
SELECT series, ts AS at_us, round(cutoff, 4) AS cutoff, score >= cutoff AS qualified, score >= cutoff AND sum(CASE WHEN score >= cutoff THEN 1 ELSE 0 END) OVER (PARTITION BY series, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 2 AS accepted FROM c""")
def stream_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The rate controller as state agrees with the declarative form."""
    rows = live_ticks(spark, sf).select("series", F.col("ts").alias("at_us"), F.floor(F.col("ts") / DAY).alias("day"), F.col("px").cast("double").alias("score"))
    return processed(spark, S.rate(rows, 0.9, 2, 25_000.0, 200, 20), "rate").withColumn("cutoff", F.round("cutoff", 4))


@P.add(f"""WITH {TICK} SELECT count(DISTINCT (series, ts // 1000)) AS rows FROM tick""")
def stream_once(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated rows within the settling time count once (here: rows of one millisecond)."""
    rows = live_ticks(spark, sf).withColumn("ms", F.floor(F.col("ts") / 1000))
    return processed(spark, S.once(rows, ["series", "ms"]), "once").agg(F.count("*").alias("rows"))


def lstm_sql(weights: dict, rows: str, keys: str) -> str:
    """A recurrent cell as a recursion over rows (keys, n from 1 on, a, b): rec has the state and the probability p after each."""
    lists = lambda x: "[" + ", ".join(lists(v) if getattr(v, "ndim", 0) else repr(float(v)) for v in x) + "]"
    n = weights["u"].shape[1]
    on = " AND ".join(f"z.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    sig = lambda z: f"(1 / (1 + exp(-least(greatest({z}, -30), 30))))"
    return f"""net AS (SELECT {lists(weights['w'])}::DOUBLE[][] AS w, {lists(weights['u'])}::DOUBLE[][] AS u, {lists(weights['b'])}::DOUBLE[] AS b, {lists(weights['v'][0])}::DOUBLE[] AS v, {float(weights['c'][0])!r}::DOUBLE AS c0),
rec({keys}, n, h, c, p) AS (
  SELECT DISTINCT {keys}, 0::BIGINT, {[0.0] * n}::DOUBLE[], {[0.0] * n}::DOUBLE[], 0::DOUBLE FROM {rows}
  UNION ALL SELECT {', '.join('r.' + k.strip() for k in keys.split(','))}, z.n, t.h, t.c, {sig('list_dot_product(net.v, t.h) + net.c0')}
  FROM rec r JOIN {rows} z ON {on} AND z.n = r.n + 1, net,
  LATERAL (SELECT list_transform(range(1, {4 * n + 1}), lambda i: net.b[i] + net.w[i][1] * z.a + net.w[i][2] * z.b + list_dot_product(net.u[i], r.h)) AS g) q,
  LATERAL (SELECT list_transform(range(1, {n + 1}), lambda j: {sig(f'q.g[{n} + j]')} * r.c[j] + {sig('q.g[j]')} * tanh(q.g[{2 * n} + j])) AS c) s,
  LATERAL (SELECT s.c AS c, list_transform(range(1, {n + 1}), lambda j: {sig(f'q.g[{3 * n} + j]')} * tanh(s.c[j])) AS h) t)"""


CELL = M.lstm_weights(2, 8)


@P.add(f"""WITH RECURSIVE {TICK}, x AS (SELECT series, ts // {DAY} AS event, ts AS at_us, px / 50000.0::DOUBLE AS a, k / 100.0::DOUBLE AS b, row_number() OVER (PARTITION BY series, ts // {DAY} ORDER BY ts) AS n FROM tick), {lstm_sql(CELL, 'x', 'series, event')}
SELECT x.series, x.event, x.at_us, round(rec.p, 7) AS probability FROM rec JOIN x USING (series, event, n)""")
def stream_recurrent(spark: SparkSession, sf: str) -> DataFrame:
    """Row-by-row inference with carried state; an event is a day of a series."""
    rows = live_ticks(spark, sf).select("series", F.floor(F.col("ts") / DAY).alias("event"), F.col("ts").alias("at_us"), (F.col("px") / 50_000.0).alias("a"), (F.col("k") / 100.0).alias("b"))
    return processed(spark, S.recurrent(rows, ["a", "b"], CELL), "recurrent").withColumn("probability", F.round("probability", 7))


@P.add(f"""WITH {BARS}, w AS (SELECT series, segment_id, bar, list([CAST(close AS DOUBLE), CAST(weight AS DOUBLE)]) OVER (PARTITION BY series, segment_id ORDER BY bar ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x, row_number() OVER (PARTITION BY series, segment_id ORDER BY bar) AS n FROM bars)
SELECT series, segment_id, bar, array_to_string(list_transform(flatten(x), lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS cells FROM w WHERE n >= 6 AND (n - 6) % 2 = 0""")
def window_tensors(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of features, as training data for sequence models."""
    rows = M.windows(bars(spark, sf), SEG, ["bar"], ["close", "weight"], 6, 2)
    cells = F.transform(F.flatten("window"), lambda v: v.cast("long").cast("string"))
    return rows.select(*SEG, "bar", F.array_join(cells, ",").alias("cells"))


@P.add(f"""WITH RECURSIVE {BARS}, x AS (SELECT series, segment_id, bar, close / 50000.0::DOUBLE AS a, weight / 100.0::DOUBLE AS b, row_number() OVER (PARTITION BY series, segment_id ORDER BY bar) AS n FROM bars), {lstm_sql(CELL, 'x', 'series, segment_id')}
SELECT x.series, x.segment_id, x.bar, round(rec.p, 7) AS probability FROM rec JOIN x USING (series, segment_id, n)""")
def lstm_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities of a recurrent policy at every row of a segment."""
    rows = bars(spark, sf).withColumns({"a": F.col("close") / 50_000.0, "b": F.col("weight") / 100.0})
    return M.lstm_scores(rows, SEG, "bar", ["a", "b"], CELL).withColumn("probability", F.round("probability", 7))


def examples(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("z"), (F.col("l_quantity") * (1 + F.col("l_discount")) > 26).cast("double").alias("label"), F.lit(1.0).alias("w"))


@P.add()
def logistic_model(spark: SparkSession, sf: str) -> DataFrame:
    """Robust scaling and weighted logistic regression."""
    rows = examples(spark, sf)
    model = M.logistic(rows, ["x", "y", "z"], "label", "w")
    return M.probabilities(model, rows).select("l_orderkey", "l_linenumber", "probability_1")


@P.add()
def boosted_trees(spark: SparkSession, sf: str) -> DataFrame:
    rows = examples(spark, sf)
    model = M.boosted(rows, ["x", "y", "z"], "label", rounds=3, depth=3)
    return M.probabilities(model, rows).select("l_orderkey", "l_linenumber", "probability_1")


@P.add("""WITH q AS (SELECT l_linenumber AS member, quantile_cont(l_extendedprice, 0.995) AS q FROM lineitem GROUP BY 1) SELECT member, round(q, 4) AS q, round(avg(q) OVER () / q, 6) AS factor FROM q""")
def ensemble_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Factors that bring the members' upper quantiles together."""
    out = M.calibration(table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "member"), "member", "l_extendedprice")
    return out.select("member", r6(F.col("q"), "q", 4), r6(F.col("factor"), "factor"))
