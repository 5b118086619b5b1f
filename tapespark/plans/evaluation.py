"""Evaluation metrics, retrieval, vocabularies and scalar functions on the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from .base import BARS, HOUR, QUOTE, SEG, TICK, Plans, bars, cents, quotes, r6, table, ticks

P = Plans()
QUERIES, SQL = P.QUERIES, P.SQL


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", F.col("n_chars").cast("double").alias("score"), "quality", "toxic", (F.col("n_chars") > 1500).cast("int").alias("pred"))


PRED = "pred AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, quality, toxic, CAST(n_chars > 1500 AS INTEGER) AS pred FROM documents JOIN labels USING (doc_id))"


@P.add(f"""WITH {PRED}, c AS (SELECT quality, count(*) AS n, count(CASE WHEN quality = pred THEN 1 END) AS hit FROM pred GROUP BY quality)
SELECT round(sum(hit) / sum(n), 6) AS accuracy, round(avg(hit / n), 6) AS macro_recall, round(max(n) / sum(n), 6) AS majority FROM c""")
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.class_metrics(predictions(spark, sf), "quality", "pred").select(*[r6(F.col(c), c) for c in ("accuracy", "macro_recall", "majority")])


@P.add(f"WITH {PRED} SELECT quality, pred, count(*) AS n FROM pred GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(predictions(spark, sf), "quality", "pred")


@P.add(f"""WITH {PRED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM pred), h AS (SELECT place, row_number() OVER (ORDER BY place) AS k FROM r WHERE quality = 1)
SELECT round(avg(k / place), 6) AS average_precision, count(*) AS positives FROM h""")
def avg_precision(spark: SparkSession, sf: str) -> DataFrame:
    out = M.average_precision(predictions(spark, sf), "score", F.col("quality") == 1, ["doc_id"])
    return out.select(r6(F.col("average_precision"), "average_precision"), "positives")


@P.add(f"""WITH {PRED}, p AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS s, count(*) AS n FROM pred a, pred b WHERE a.quality = 1 AND b.quality = 0)
SELECT round(s / n, 6) AS auc FROM p""")
def auc(spark: SparkSession, sf: str) -> DataFrame:
    return M.auc(predictions(spark, sf), "score", F.col("quality") == 1).select(r6(F.col("auc"), "auc"))


@P.add(f"""WITH {PRED}, r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS a, row_number() OVER (ORDER BY CAST(quality + 2 * toxic AS DOUBLE) DESC, doc_id) AS b FROM pred) SELECT round(corr(a, b), 6) AS spearman FROM r""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).withColumn("y", (F.col("quality") + 2 * F.col("toxic")).cast("double"))
    return M.spearman(rows, "score", "y", ["doc_id"]).select(r6(F.col("spearman"), "spearman"))


@P.add(f"""WITH {PRED}, s AS (SELECT avg(CASE WHEN quality = 1 THEN score END) AS a, avg(CASE WHEN quality <> 1 THEN score END) AS b, stddev_pop(score) AS d, avg(CASE WHEN quality = 1 THEN toxic END) AS ta, avg(CASE WHEN quality <> 1 THEN toxic END) AS tb, stddev_pop(toxic) AS td FROM pred)
SELECT 'score' AS feature, round((a - b) / d, 6) AS shift FROM s UNION ALL SELECT 'toxic', round((ta - tb) / td, 6) FROM s""")
def trade_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised shift of features between two groups."""
    rows = predictions(spark, sf).withColumn("toxic", F.col("toxic").cast("double"))
    return M.standardised_shift(rows, F.col("quality") == 1, ["score", "toxic"]).select("feature", r6(F.col("shift"), "shift"))


def moves(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(*SEG).orderBy("bar")
    return bars(spark, sf).withColumns({"truth": (F.lead("close").over(w) - F.col("close")).cast("double"), "guess": (F.col("open") - F.col("close")).cast("double")}).where("truth IS NOT NULL")


MOVES = BARS + ", mv AS (SELECT series, bar, CAST(lead(close) OVER w - close AS DOUBLE) AS truth, CAST(open - close AS DOUBLE) AS guess FROM bars WINDOW w AS (PARTITION BY series, segment_id ORDER BY bar)), moves AS (SELECT * FROM mv WHERE truth IS NOT NULL)"


@P.add(f"""WITH {MOVES} SELECT series, count(*) AS rows, round(avg(abs(truth - guess)), 5) AS mae, round(avg(abs(truth)), 5) AS zero_mae, round(sqrt(avg((truth - guess) * (truth - guess))), 4) AS rmse, round(CASE WHEN stddev_pop(truth) > 0 AND stddev_pop(guess) > 0 THEN corr(truth, guess) ELSE 0 END, 6) AS corr,
  round(avg(CASE WHEN abs(truth) >= 5000 THEN CASE WHEN sign(truth) = sign(guess) THEN 1.0 ELSE 0.0 END END), 6) AS material_accuracy, round(avg(CASE WHEN abs(truth) >= 5000 THEN 1.0 ELSE 0.0 END), 6) AS material_share FROM moves GROUP BY series""")
def line_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = M.line_metrics(moves(spark, sf), "truth", "guess", 5000.0, ["series"])
    return out.select("series", "rows", r6(F.col("mae"), "mae", 5), r6(F.col("zero_mae"), "zero_mae", 5), r6(F.col("rmse"), "rmse", 4), *[r6(F.col(c), c) for c in ("corr", "material_accuracy", "material_share")])


SHARES = (0.05, 0.2, 0.5, 1.0)


@P.add(f"""WITH {MOVES}, c AS (SELECT unnest([{', '.join(map(str, SHARES))}])::DOUBLE AS share, unnest(quantile_cont(abs(guess), [{', '.join(str(1 - s) for s in SHARES)}])) AS cutoff FROM moves)
SELECT share, round(cutoff, 4) AS cutoff, count(*) AS rows, round(avg(CASE WHEN sign(truth) = sign(guess) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(abs(truth)), 4) AS mean_size FROM c JOIN moves ON abs(guess) >= cutoff GROUP BY share, cutoff""")
def coverage_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = M.coverage_curve(moves(spark, sf), "truth", "guess", SHARES)
    return out.select("share", r6(F.col("cutoff"), "cutoff", 4), "rows", r6(F.col("accuracy"), "accuracy"), r6(F.col("mean_size"), "mean_size", 4))


@P.add("""SELECT 'l_discount' AS curve, round(avg(abs(l_discount * 10 - l_tax * 12)), 6) AS mae, round(corr(l_discount * 10, l_tax * 12), 6) AS corr, round(count(CASE WHEN l_discount * 10 >= 0.45 AND l_tax * 12 >= 0.45 THEN 1 END) / count(CASE WHEN l_tax * 12 >= 0.45 THEN 1 END), 6) AS precision,
  round(count(CASE WHEN l_discount * 10 >= 0.45 AND l_tax * 12 >= 0.45 THEN 1 END) / count(CASE WHEN l_discount * 10 >= 0.45 THEN 1 END), 6) AS recall FROM lineitem""")
def curve_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("l_discount"), (F.col("l_tax") * 12).alias("p"))
    return M.curve_metrics(rows, [("l_discount", "p")], 0.45).select("curve", *[r6(F.col(c), c) for c in ("mae", "corr", "precision", "recall")])


@P.add("""WITH ref AS (SELECT l_extendedprice AS s FROM lineitem), q AS (SELECT o_orderkey, o_totalprice AS s FROM orders), n AS (SELECT count(*) AS n FROM ref),
b AS (SELECT s, o_orderkey FROM q UNION ALL SELECT s, NULL FROM ref), c AS (SELECT *, count(CASE WHEN o_orderkey IS NULL THEN 1 END) OVER (ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM b)
SELECT o_orderkey, round(k / n, 8) AS share FROM c, n WHERE o_orderkey IS NOT NULL""")
def percentile_score(spark: SparkSession, sf: str) -> DataFrame:
    """The share of all lines' prices that is at most an order's."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("s"))
    lines = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("s"))
    return M.percentile_scores(o, lines, "s", "o_orderkey").select("o_orderkey", r6(F.col("share"), "share", 8))


@P.add("""WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)
SELECT label, n, round(least(sqrt(max(n) OVER () / n), 8), 6) AS root_weight, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS inverse_weight FROM c""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return M.class_weights(table(spark, sf, "events").select(F.col("event_type").alias("label")), "label").select("label", "n", r6(F.col("root_weight"), "root_weight"), r6(F.col("inverse_weight"), "inverse_weight"))


@P.add("""WITH d AS (SELECT l_orderkey, CAST(round_even(l_discount * 100, 0) AS BIGINT) AS d FROM lineitem), s AS (SELECT l_orderkey, CAST(sum(d) AS BIGINT) AS total, CAST(sum(d * d) AS BIGINT) AS squares, count(d) AS members FROM d GROUP BY l_orderkey)
SELECT l_orderkey, total, members, members * squares - total * total AS spread FROM s""")
def ensemble_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of the members in whole hundredths: members times the mean, and members squared times the variance, are whole numbers."""
    out = M.ensemble(table(spark, sf, "lineitem").select("l_orderkey", cents(F.col("l_discount")).alias("d")), ["l_orderkey"], "d")
    n = F.col("members")
    return out.select("l_orderkey", F.rint(F.col("mean") * n).cast("long").alias("total"), n, F.rint(F.col("std") * F.col("std") * n * n).cast("long").alias("spread"))


def vectors(spark: SparkSession, sf: str, odd: bool) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.pmod("vec_id", F.lit(2)) == int(odd)).select(F.col("vec_id").alias("id"), "embedding", "label")


NEAR = """near AS (SELECT q.vec_id AS query, r.vec_id AS reference, r.label, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS sim FROM embeddings q, embeddings r WHERE q.vec_id % 2 = 1 AND r.vec_id % 2 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, reference) AS place FROM near QUALIFY place <= 8)"""


@P.add(f"WITH {NEAR} SELECT query, reference, round(sim, 6) AS sim, CAST(place AS INTEGER) AS place FROM top")
def cosine_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The eight nearest references of every query by cosine, in blocks of queries."""
    out = M.cosine_knn(vectors(spark, sf, True), vectors(spark, sf, False), 8)
    return out.select("query", "reference", r6(F.col("sim"), "sim"), "place")


@P.add(f"WITH {NEAR}, w AS (SELECT query, label, exp((sim - max(sim) OVER (PARTITION BY query)) / 0.08) AS w FROM top) SELECT query, round(sum(w * label) / sum(w), 5) AS prediction FROM w GROUP BY query")
def retrieval_prediction(spark: SparkSession, sf: str) -> DataFrame:
    near = M.cosine_knn(vectors(spark, sf, True), vectors(spark, sf, False), 8)
    labels = vectors(spark, sf, False).select(F.col("id").alias("reference"), "label")
    return M.softmax_predict(near.join(labels, "reference"), "label").select("query", r6(F.col("prediction"), "prediction", 5))


@P.add(f"""WITH {TICK} SELECT series, seq, CAST(sum(px) OVER (PARTITION BY series, ts // {24 * HOUR} ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS suffix FROM tick""")
def reverse_returns(spark: SparkSession, sf: str) -> DataFrame:
    rows = ticks(spark, sf).withColumn("day", F.floor(F.col("ts") / (24 * HOUR)))
    return rows.select("series", "seq", M.reverse_sum(F.col("px"), ["series", "day"], ["ts", "seq"]).alias("suffix"))


@P.add(f"""WITH {TICK}, l AS (SELECT series, seq, list(CAST(px AS DOUBLE)) OVER (PARTITION BY series, ts // {24 * HOUR} ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM tick)
SELECT series, seq, round(list_reduce(list_reverse(x), lambda a, b: a * 0.96875 + b), 3) AS returns FROM l""")
def discounted_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Returns to the end of the day; the factor is a binary fraction, so that short sums are exact and round alike everywhere."""
    rows = ticks(spark, sf).withColumn("day", F.floor(F.col("ts") / (24 * HOUR)))
    return M.discounted(rows, "px", ["series", "day"], ["ts", "seq"], 0.96875, chunk=32).select("series", "seq", r6(F.col("returns"), "returns", 3))


GRID = (0.5, 1.0, 2.0, 4.0)


@P.add(f"""WITH {PRED}, z AS (SELECT (score - 1500) / 1000 AS z, quality AS y FROM pred), t AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS temperature),
l AS (SELECT temperature, avg(-CASE WHEN y = 1 THEN ln(least(greatest(1 / (1 + exp(-z / temperature)), 1e-7), 1 - 1e-7)) ELSE ln(1 - least(greatest(1 / (1 + exp(-z / temperature)), 1e-7), 1 - 1e-7)) END) AS loss FROM z, t GROUP BY 1)
SELECT temperature, round(loss, 6) AS loss, row_number() OVER (ORDER BY loss, temperature) = 1 AS best FROM l""")
def temperature_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).withColumn("z", (F.col("score") - 1500) / 1000)
    return M.temperature(rows, "z", "quality", GRID).select("temperature", r6(F.col("loss"), "loss"), "best")


@P.add("SELECT CAST(min(v) AS DOUBLE) AS threshold FROM (SELECT l_extendedprice AS v FROM lineitem ORDER BY v DESC LIMIT 250)")
def nth_largest(spark: SparkSession, sf: str) -> DataFrame:
    return M.nth_largest(table(spark, sf, "lineitem"), "l_extendedprice", 250)


def boot_sql(block: str) -> str:
    return f"""WITH m AS (SELECT {block} AS block, avg(value) AS m FROM events GROUP BY 1), o AS (SELECT m, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS n FROM m),
d AS (SELECT draw, (('0x' || substr(md5(concat('7:', draw, ':', k)), 1, 8))::BIGINT) % n AS i FROM (SELECT unnest(range(400)) AS draw), (SELECT DISTINCT n FROM o), LATERAL (SELECT unnest(range(n)) AS k)),
w AS (SELECT draw, avg(m) AS mean FROM d JOIN o USING (i) GROUP BY draw)
SELECT (SELECT round(avg(m), 6) FROM m) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM w"""


@P.add(boot_sql("CAST(ts AS DATE)"))
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the mean by drawing whole days."""
    rows = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return M.block_bootstrap(rows, "day", "value", 400).select(*[r6(F.col(c), c) for c in ("mean", "low", "high")])


@P.add(boot_sql("date_trunc('week', ts)"))
def weekly_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The same with whole weeks."""
    rows = table(spark, sf, "events").withColumn("week", F.date_trunc("week", F.col("ts").cast("timestamp")))
    return M.block_bootstrap(rows, "week", "value", 400).select(*[r6(F.col(c), c) for c in ("mean", "low", "high")])


@P.add("""SELECT DISTINCT event_type, CASE lower(event_type) WHEN 'click' THEN 'x' ELSE 'y' END AS k, 'bid' AS a, '' AS b, 'ask' AS c, 'book' AS d, 'l3' AS e, 'liquidation' AS f, 'binance_perpetual' AS g, 'kraken_spot' AS h, 'okx' AS i, 'BTC-USDT-SWAP' AS j, 'books' AS l, CAST(NULL AS VARCHAR) AS m FROM events""")
def vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    """Sides, stream kinds, venues and streams of file names."""
    f = S.stream_of_file(F.lit("OKX_swap_btc_usdt_swap_books"))
    lit = F.lit
    rows = table(spark, sf, "events").select("event_type").distinct()
    return rows.select("event_type", F.when(F.lower("event_type") == "click", "x").otherwise("y").alias("k"), S.side(lit("Buy")).alias("a"), S.side(lit("?")).alias("b"), S.side(lit("offer")).alias("c"), S.stream_kind(lit("LEVEL2")).alias("d"), S.stream_kind(lit("level3")).alias("e"), S.stream_kind(lit("allLiquidation")).alias("f"), S.venue(lit("binance"), lit("um_futures")).alias("g"), S.venue(lit("kraken"), lit("spot")).alias("h"), f["exchange"].alias("i"), f["symbol"].alias("j"), f["channel"].alias("l"), S.stream_kind(lit("other")).alias("m"))


@P.add(f"""WITH {QUOTE}, q AS (SELECT seq, CAST(bid AS DOUBLE) AS b, CAST(ask AS DOUBLE) AS a, CAST(k AS DOUBLE) AS x, CAST(100 - k AS DOUBLE) AS y, ts, px FROM quote)
SELECT seq, round(coalesce((a * x + b * y) / nullif(x + y, 0), 0), 6) AS microprice, round((a - b) / 5, 6) AS spread_ticks, round((a - b) * 10000 / ((a + b) * 0.5), 5) AS spread_bps, round((x - y) / greatest(x + y, 1e-12), 6) AS imbalance,
  round(sin((ts % {24 * HOUR}) * (2 * pi() / {24 * HOUR})), 6) AS day_sin, round(cos((ts % {24 * HOUR}) * (2 * pi() / {24 * HOUR})), 6) AS day_cos, round(ln(1 + x), 6) AS log_x, round(atan(b / 1000), 6) AS atan_b, round(asinh(px / 100.0), 6) AS asinh_px,
  round_even(px / 8.0, 0) AS rint, ts // 1000 * 1000 AS cell, -(-(ts // 7)) AS sevenths, round(1 / (1 + exp(-least(greatest((x - 50) / 10, -30), 30))), 6) AS sigmoid, b > 0 AND b <= a AS valid, round(CASE WHEN x > 50 THEN a / b - 1 ELSE b / a - 1 END * 10000, 4) AS ret
FROM q WHERE b > 0""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Prices, ticks, time and the usual transforms as plain expressions."""
    c = F.col
    rows = quotes(spark, sf).select("seq", c("bid").cast("double").alias("b"), c("ask").cast("double").alias("a"), c("k").cast("double").alias("x"), (100 - c("k")).cast("double").alias("y"), "ts", "px").where("b > 0")
    sin, cos = S.cycle(c("ts"), 24 * HOUR)
    out = {
        "microprice": F.coalesce(S.microprice(c("b"), c("a"), c("x"), c("y")), F.lit(0.0)), "spread_ticks": S.spread_ticks(c("b"), c("a"), 5.0), "imbalance": S.imbalance(c("x"), c("y")), "day_sin": sin, "day_cos": cos,
        "log_x": F.log1p("x"), "atan_b": F.atan(c("b") / 1000), "asinh_px": F.asinh(c("px") / 100.0), "sigmoid": S.sigmoid((c("x") - 50) / 10),
    }
    return rows.select("seq", *[r6(v, k) for k, v in out.items()], r6(S.spread_bps(c("b"), c("a")), "spread_bps", 5), F.rint(c("px") / 8.0).alias("rint"), S.bucket(c("ts"), 1000).alias("cell"), F.floor(c("ts") / 7).alias("sevenths"), S.quote_valid(c("b"), c("a")).alias("valid"), r6(S.return_bps(c("b"), c("a"), c("x") > 50), "ret", 4))


@P.add(f"""WITH {TICK} SELECT seq, ts * 1000 AS iso_ns, ts // 1000000 AS seconds, ts // {24 * HOUR} AS day FROM tick""")
def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Times written as text and read back: ISO with a zone, seconds since the epoch, dates."""
    at = F.timestamp_micros("ts")
    iso = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.pmod("seq", F.lit(2)) == 0, "Z").otherwise("+00:00"))
    days = F.datediff(F.to_date(F.date_format(at, "yyyy-MM-dd")), F.lit("1970-01-01").cast("date")).cast("long")
    return ticks(spark, sf).select("seq", S.iso_to_ns(iso).alias("iso_ns"), F.unix_timestamp(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss").alias("seconds"), days.alias("day"))
