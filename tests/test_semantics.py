"""Hand-computed values of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapespark.functions import scalars as S
from tapespark.operators import bars as B
from tapespark.operators import book as K
from tapespark.operators import decisions as D
from tapespark.operators import excursions as X
from tapespark.operators import ledgers as L
from tapespark.operators import metrics as M
from tapespark.operators import models as N
from tapespark.operators import scores as C
from tapespark.operators import temporal as T

NS = 1_000_000_000


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_snapshots_and_second_bars(spark):
    rows = []
    for ts, bid, ask, b, a in ((100_000_000, 100, 102, 2, 1), (900_000_000, 101, 103, 1, 3), (1_100_000_000, 102, 104, 2, 2), (2_100_000_000, 105, 104, 1, 1)):
        for i in range(3):
            rows += [(ts, float(bid - i), 0.0, b if i == 0 else 1, "new"), (ts, 0.0, float(ask + i), a if i == 0 else 1, "new")]
    quotes = spark.createDataFrame(rows, "ts long, bid double, ask double, size long, type string")
    snaps = B.snapshots(quotes, tick=1.0)
    assert snaps.count() == 3  # the crossed one is not accepted
    bars = B.ohlc(snaps.withColumn("k", F.lit(1)), ["k"], "ts", NS, "mid", ["ts"], carry=("best_bid", "best_ask")).orderBy("bar").collect()
    assert [(r.open, r.high, r.low, r.close, r.first_best_bid, r.last_best_bid, r.ticks) for r in bars] == [(101, 102, 101, 102, 100, 101, 2), (103, 103, 103, 103, 102, 102, 1)]
    assert [r.microprice for r in snaps.orderBy("ts").collect()][1] == (103 * 1 + 101 * 3) / 4


def test_gap_filling_and_weighted_average(spark):
    bars = spark.createDataFrame([("x", 0, 100.0, 4), ("x", 3 * NS, 103.0, 4), ("x", 7 * NS, 107.0, 4)], "k string, bar long, close double, w long")
    out = T.gap_fill(bars, ["k"], "bar", NS, 2).orderBy("bar").collect()
    assert [r.bar // NS for r in out] == [0, 1, 2, 3, 4, 5, 7]
    assert [r.observed for r in out] == [True, False, False, True, False, False, True]
    assert [r.segment_id for r in out] == [0] * 6 + [1]
    rows = spark.createDataFrame([(i, float(v), w) for i, (v, w) in enumerate([(10, 2), (20, 0), (30, 1), (40, -5), (50, None)])], "ts long, v double, w long").withColumn("k", F.lit(0))
    avg = rows.withColumn("a", T.weighted_average(F.col("v"), F.col("w"), ["k"], ["ts"], 2))
    assert column(avg, "a") == [10.0, 10.0, 30.0, 30.0, 50.0]  # no weight in the window: the row's own value


def test_rolling_contracts_differ(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0), (3, 5.0)], "ts long, v double").withColumn("k", F.lit(0))
    out = rows.withColumns({"full": T.full_mean(F.col("v"), ["k"], ["ts"], 2), "part": T.partial_mean(F.col("v"), ["k"], ["ts"], 2)})
    assert column(out, "full") == [None, None, None, 4.0] and column(out, "part") == [1.0, 1.0, 3.0, 4.0]


def test_asof_counts_events_at_the_tick(spark):
    ticks = spark.createDataFrame([("a", 5), ("a", 10), ("b", 10)], "k string, ts long")
    events = spark.createDataFrame([("a", 6, 1), ("a", 10, 2), ("a", 10, 3), ("a", 11, 4)], "k string, ts long, v int")
    got = {(r.k, r.ts): (r.v, r.asof_ts) for r in T.asof_last(ticks, events, ["k"], ["v"], order=["v"]).collect()}
    assert got == {("a", 5): (None, None), ("a", 10): (3, 10), ("b", 10): (None, None)}


def test_excursions_need_two_crossings_in_their_segment(spark):
    deltas = [0, 1, 3, 0, -2, -1, 4, 4, -1, 5, -5]
    rows = spark.createDataFrame([("x", 0 if i < 9 else 1, i, float(d)) for i, d in enumerate(deltas)], "k string, segment_id int, ts long, delta double")
    sided = X.events(X.sides(rows, "delta", ["k", "segment_id"], "ts"), ["k", "segment_id"], "ts")
    assert column(sided, "side") == [0, 1, 1, 1, -1, -1, 1, 1, -1, 1, -1]
    found = X.excursions(sided, "delta", ["k"], "segment_id", "ts", 1, 3.0, 1.0, 2.0).orderBy("start").collect()
    assert [(r.start, r.end, r.crossing_1, r.crossing_2, r.side, r.amplitude, r.duration_s, r.gate_at, r.good) for r in found] == [(0, 0, 1, 4, 0, 0.0, 1.0, None, False), (1, 3, 4, 6, 1, 3.0, 3.0, 2, True), (4, 5, 6, 8, -1, 2.0, 2.0, None, False)]


@pytest.mark.parametrize("cadence,horizon,cost,prices,fl,fv", [(NS, 2 * NS, 10.0, [100, 110, 90, 120], (990 + 0) / 2, [True, True, False, False]), (NS // 10, NS // 4, 0.0, [100, 110, 90, 100], 500.0, [True, False, False, False])])
def test_score_cube_by_hand(spark, cadence, horizon, cost, prices, fl, fv):
    rows = spark.createDataFrame([(0, i * cadence, float(p), float(p), True) for i, p in enumerate(prices)], "seg int, ts long, bid double, ask double, valid boolean")
    for chunk in (2, 4096):
        out = C.score_cube(rows, ["seg"], "ts", cadence, [float(horizon)], cost, chunk=chunk).orderBy("ts").collect()
        assert [r.fwd_long is not None for r in out] == fv
        assert out[0].fwd_long == pytest.approx(fl)
        assert [r.bwd_long is not None for r in out] == fv[::-1]
    if cost:
        assert out[0].fwd_short == pytest.approx((0 + (10_000 / 9 - 10)) / 2)
        assert out[2].bwd_long == 0 and out[2].bwd_short == pytest.approx(((10_000 / 9 - 10) + (20_000 / 9 - 10)) / 2)


def test_cross_ledger_by_hand(spark):
    bid = [99, 99, 100, 101, 100, 99, 98, 98, 98, 98, 98, 98]
    base = [(0, i, float(b), b + 0.2, float(b), b + 0.2, 100.0, 100.2, 0.03 if i == 0 else 0.001, 0.001) for i, b in enumerate(bid)]
    schema = "seg int, ts long, first_bid double, first_ask double, last_bid double, last_ask double, avg_bid double, avg_ask double, h0 double, h1 double, observed boolean"
    seen = lambda hidden: spark.createDataFrame([(*r, r[1] not in hidden) for r in base], schema)
    exits = lambda rows, n: [(r.entry_at, r.exit_at, r.terminal) for r in L.cross_ledger(rows, ["seg"], "ts", n, 0.02, 0.1).collect()]
    assert exits(seen(()), 1) == [(1, 4, False)] and exits(seen(()), 2) == [(1, 6, False)]
    assert exits(seen((4,)), 1) == [(1, 5, False)]


def test_order_book_keeps_missing_fields():
    b = K.OrderBook(2)
    b.update("1", False, ["bid", 10.0, 5.0])
    b.update("1", False, [None, None, 3.0])
    b.update("2", False, ["ask", 11.0, 1.0])
    assert b.orders == {"1": ["bid", 10.0, 3.0], "2": ["ask", 11.0, 1.0]} and (b.counts["adds"], b.counts["modifies"], b.counts["add_qty"]) == (2, 1, 6.0)
    b.update("1", True, [None, None, None])
    b.update("9", True, [None, None, None])
    b.update("3", False, [None, 5.0, 1.0])
    assert (b.counts["deletes"], b.counts["delete_qty"], b.total["bid"], set(b.orders)) == (2, 3.0, 0.0, {"2"})
    for i in range(4):
        b.update(f"b{i}", False, ["bid", float(i), 1.0])
    b.truncate()
    assert sorted(b.levels["bid"]) == [2.0, 3.0]  # the worst levels go for good


def test_packets_of_type_snapshot_clear_the_order_book(spark):
    rows = [("v", 10, 1, 0, "a", "buy", 5.0, 2.0, "add", False, "update"), ("v", 10, 1, 1, "b", "offer", 6.0, 1.0, "add", False, "update"), ("v", 20, 2, 0, "c", "bid", 4.0, 3.0, "add", False, "Snapshot"), ("v", 30, 3, 0, "c", None, float("nan"), 1.0, "modify", None, None)]
    frame = spark.createDataFrame(rows, "venue string, ts long, event_id long, row_idx int, order_id string, side string, price double, quantity double, action string, is_snapshot boolean, event_type string")
    got = {r.tick: r for r in K.l3_features(frame, "venue", 10).collect()}
    assert [(got[t].orders, got[t].bid_qty, got[t].ask_qty, got[t].best_bid, got[t].best_ask) for t in (10, 20, 30)] == [(2, 2.0, 1.0, 5.0, 6.0), (1, 3.0, 0.0, 4.0, None), (1, 1.0, 0.0, 4.0, None)]
    assert [(got[t].adds, got[t].modifies, got[t].deletes) for t in (10, 20, 30)] == [(2, 0, 0), (1, 0, 0), (0, 1, 0)]


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_parts_change_nothing(spark, width):
    """Windows over a whole key and by stretches of time agree, with ties, nulls, empty stretches and keys of one row."""
    rng = np.random.default_rng(width)
    rows = [(k, int(t), i, None if rng.random() < 0.4 else int(rng.integers(0, 9)), bool(rng.random() < 0.2)) for k in range(3) for i, t in enumerate(np.sort(rng.integers(0, 300, (1, 60, 90)[k])))]
    frame = spark.createDataFrame(rows, "k long, ts long, seq long, v long, snap boolean").repartition(3)
    same = lambda f: sorted(map(str, f(None).collect())) == sorted(map(str, f(width).collect()))
    keys, order, v = ["k"], ["ts", "seq"], F.col("v")
    assert same(lambda w: T.forward_fill(frame, keys, order, ["v"], w).select("k", "seq", "v"))
    assert same(lambda w: T.running_total(frame, keys, order, F.coalesce(v, F.lit(0)), "x", w).select("k", "seq", "x"))
    assert same(lambda w: T.neighbours(frame, keys, order, ["ts", "v"], w, lead=True).select("k", "seq", "lag_ts", "lag_v", "lead_ts", "lead_v"))
    assert same(lambda w: T.islands(frame, keys, order, F.col("snap"), "x", w).select("k", "seq", "x"))
    assert same(lambda w: T.every_nth(frame, keys, order, 4, w).select("k", "seq"))
    assert same(lambda w: K.flagged_gaps(frame, keys, order, "v", "v", width=w).select("k", "seq", "stale", "gap", "run"))
    assert same(lambda w: K.versions(frame, keys, order, F.col("snap"), ("v",), width=w).select("k", "seq", "epoch", "valid_from", "valid_to"))
    bars = frame.groupBy("k", (F.floor(F.col("ts") / 5) * 5).alias("bar")).agg(F.count("*").alias("n"))
    assert same(lambda w: T.gap_fill(bars, keys, "bar", 5, 2, w).select("k", "bar", "observed", "segment_id"))


def test_rolling_windows_match_their_frames(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else float(rng.normal(100, 3)), float(rng.normal(0, 1)), bool(rng.random() < 0.7)) for i in range(200)]
    frame = spark.createDataFrame(rows, "t long, x double, y double, ok boolean").withColumn("k", F.lit(1))
    x, y = F.coalesce(F.nanvl("x", F.lit(0.0)), F.lit(0.0)), F.col("y")
    corr, beta = T.correlation(x, y, F.col("ok"), ["k"], ["t"], 30)
    out = frame.select("t", T.full_mean(F.col("x"), ["k"], ["t"], 3).alias("full"), T.partial_mean(F.col("x"), ["k"], ["t"], 5).alias("part"), corr.alias("corr"), beta.alias("beta")).orderBy("t").collect()
    seen = lambda lo, hi: [r[1] for r in rows[max(lo, 0) : hi] if r[1] is not None and r[1] == r[1]]
    for i, r in enumerate(out):
        three, five = seen(i - 2, i + 1), seen(i - 4, i + 1)
        assert r.full == (pytest.approx(np.mean(three)) if len(three) == 3 else None) and r.part == (pytest.approx(np.mean(five)) if five else None)
        pairs = np.array([(0.0 if a is None or a != a else a, b) for _, a, b, ok in rows[max(0, i - 29) : i + 1] if ok]).reshape(-1, 2)
        if len(pairs) > 2:
            assert r.corr == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=1e-6) and r.beta == pytest.approx(np.cov(pairs.T, bias=True)[0, 1] / pairs[:, 0].var(), abs=1e-6)


def test_book_versions_equal_a_replay(spark):
    import random

    rng = random.Random(5)
    events, t = [], 0
    for _ in range(400):
        t += rng.randint(1, 9)
        kind = rng.random()
        events.append((0, t, len(events), *(("x", None, 0, True) if kind < 0.03 else (rng.choice(["bid", "ask"]), rng.randint(1, 9), rng.randint(0, 3), False))))
    rows = spark.createDataFrame(events, "k int, ts long, seq long, side string, price int, quantity int, is_snapshot boolean")
    held = K.versions(rows.where("side != 'x' OR is_snapshot").withColumn("side", F.when(F.col("is_snapshot"), None).otherwise(F.col("side"))), ["k"], ["ts", "seq"], F.col("is_snapshot"), alive=F.col("quantity") > 0)
    got = {}
    for r in K.at_ticks(held, 7, F.lit(t)).collect():
        got.setdefault(r.tick, {})[r.side, r.price] = r.quantity
    book, i = {}, 0
    for tick in range(0, t + 1, 7):
        while i < len(events) and events[i][1] <= tick:
            _, _, _, side, price, q, snap = events[i]
            if snap:
                book = {}
            elif q:
                book[side, price] = q
            else:
                book.pop((side, price), None)
            i += 1
        assert got.get(tick, {}) == book


def test_trades_of_unknown_side_lift_the_average(spark):
    rows = spark.createDataFrame([("v", 10.0, 2.0, "buy", "1"), ("v", 20.0, 1.0, "?", "2"), ("v", 10.0, 2.0, "buy", "1")], "venue string, price double, quantity double, taker string, trade_id string")
    r = K.trades(rows, ["venue"]).first()
    assert (r.n, r.buy, r.sell, r.vwap) == (3, 4.0, 0.0, 60 / 4)
    assert K.trades(rows, ["venue"], dedupe=("trade_id",)).first().n == 2
    assert K.trades(rows, ["venue"], known_only=True).first().vwap == 10.0


def test_bounds_keep_nulls(spark):
    r = spark.range(1).select(S.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("a"), S.clip(F.lit(5.0), 0.0, 1.0).alias("b"), S.ceil_grid(F.lit(7), 5).alias("c"), S.bucket(F.lit(-7), 5).alias("d"), F.rint(F.lit(2.5)).alias("e"), S.softplus(F.lit(0.0)).alias("f")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (None, 1.0, 10, -10, 2.0) and r.f == pytest.approx(math.log(2))


def test_ranked_metrics(spark):
    rows = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)])], "id int, s double, y int")
    assert M.auc(rows, "s", F.col("y") == 1).first().auc == pytest.approx((3 + 0.5 + 1) / 6)
    assert M.average_precision(rows, "s", F.col("y") == 1, ["id"]).first().average_precision == pytest.approx((1 + 2 / 3) / 2)
    assert M.auc(rows.where("y = 0"), "s", F.col("y") == 1).first().auc is None


def test_summary_and_drawdown(spark):
    rows = spark.createDataFrame([(0, i, p) for i, p in enumerate([10.0, -4.0, -8.0, 6.0])], "k int, t int, pnl double").withColumn("day", F.lit(1))
    r = D.summary(rows, "pnl", "day", ["k"]).first()
    assert (r.trades, r.total, r.win_rate, r.worst, r.cvar05) == (4, 4.0, 0.5, -8.0, -8.0) and r.profit_factor == pytest.approx(16 / 12)
    assert M and D.drawdown(rows, "pnl", ["k"], ["t"]).first().max_drawdown == 12.0


def test_returns_to_the_end_of_a_long_key_are_one_pass(spark):
    n = 30_000
    x = np.random.default_rng(3).integers(-1000, 1000, n)
    rows = spark.createDataFrame([(0, i // 3, i, int(v)) for i, v in enumerate(x)], "k int, ts long, seq long, x long")
    out = rows.select("seq", M.reverse_sum(F.col("x"), ["k"], ["ts", "seq"]).alias("s"))
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()  # such a frame is summed anew for each row
    assert column(out, "s", "seq") == np.cumsum(x[::-1])[::-1].tolist()


def test_returns_to_the_end_take_nulls_as_sql_does(spark):
    rows = spark.createDataFrame([("a", 1, 1, 5), ("a", 1, None, 7), ("a", 2, 3, None), ("a", None, 4, 11), ("b", 1, 1, None)], "k string, ts long, seq long, x long")
    out = rows.select("k", "ts", "seq", M.reverse_sum(F.col("x"), ["k"], ["ts", "seq"]).alias("s"))
    assert {tuple(r) for r in out.collect()} == {("a", 1, 1, 23), ("a", 1, None, 18), ("a", 2, 3, 11), ("a", None, 4, 11), ("b", 1, 1, None)}


def test_weighted_median_takes_the_first_to_reach_half(spark):
    rows = spark.createDataFrame([(0, h, v, v, v, v) for h, v in ((1.0, 3.0), (2.0, 1.0), (3.0, 2.0))], "ts int, horizon double, fwd_long double, fwd_short double, bwd_long double, bwd_short double")
    r = C.over_horizons(rows, ["ts"], [1.0, 2.0, 3.0], [0.5, 0.25, 0.25]).first()
    assert r.fwd_long == pytest.approx(0.7 * 2 + 0.3 * (1.5 + 0.25 + 0.5))
    assert sum(C.horizon_weights([1, 5, 60], 5)) == pytest.approx(1)


def test_peaks_by_suppression(spark):
    values = [0, 5, 1, 4, 0, 0, 9, 0, 0]
    assert C.choose_peaks(__import__("numpy").array(values, float), 3.0, 2) == [1, 6]
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k int, ts long, x double")
    got = C.separated_peaks(rows, "x", ["k"], "ts", 3.0, 0.5, 0.5, 2).orderBy("peak").collect()
    assert [(r.peak, r.start, r.end, r.core_start, r.core_end) for r in got] == [(1, 1, 3, 1, 1), (6, 6, 6, 6, 6)]


def test_recurrent_state_goes_on():
    import numpy as np

    p = N.lstm_weights(3, 5)
    x = np.random.default_rng(1).standard_normal((7, 3))
    whole, _ = N.lstm(x, p)
    first, state = N.lstm(x[:4], p)
    rest, _ = N.lstm(x[4:], p, state)
    assert np.allclose(whole, np.vstack([first, rest]))
    text = N.freeze(p, ["a", "b", "c"])
    assert np.allclose(N.lstm(x, N.thaw(text, ["a", "b", "c"]))[0], whole)
    with pytest.raises(ValueError):
        N.thaw(text, ["b", "a", "c"])
    with pytest.raises(ValueError):
        N.thaw(text.replace("0.", "1.", 3), ["a", "b", "c"])


def test_backtest_resets_and_does_not_reopen(spark):
    rows = [(0, 0, i * 10, 100.0 + i, 101.0 + i, True, lb, 0.9, 0.9, 0.0) for i, lb in enumerate([0.1, 0.7, 0.1, 0.2])] + [(0, 1, 100, 100.0, 101.0, True, 0.7, 0.1, 0.9, 0.0)]
    frame = spark.createDataFrame(rows, "k int, seg int, ts long, bid double, ask double, valid boolean, long_back double, long_fwd double, short_back double, short_fwd double")
    got = L.curve_backtest(frame, ["k"], "ts", "seg", (0.5, 0.5, 0.5, 0.5), 0.0, 1000).orderBy("entry_at").collect()
    assert [(r.entry_at, r.exit_at, r.unresolved) for r in got] == [(0, 10, False), (20, None, True)]
    assert got[0].gross_bps == pytest.approx(0.0)


def test_buckets_and_chunks_change_nothing(spark):
    import random

    rng = random.Random(3)
    events = spark.createDataFrame([(rng.randint(0, 1), rng.randint(0, 500), i) for i in range(120)], "k long, ts long, v long")
    ticks = spark.createDataFrame([(k, t) for k in (0, 1, 2) for t in range(-20, 900, 13)], "k long, ts long")
    plain = T.asof_last(ticks, events, ["k"], ["v"], order=["v"]).collect()
    for width in (1, 7, 100, 10_000):
        assert sorted(map(str, T.asof_last(ticks, events, ["k"], ["v"], order=["v"], bucket_width=width).collect())) == sorted(map(str, plain))
    rows = spark.createDataFrame([(k, i, float(rng.randint(0, 9)), rng.randint(0, 2)) for k in (0, 1) for i in range(3, 200)], "k long, ts long, v double, w long")
    op = lambda part, keys: part.withColumn("a", T.weighted_average(F.col("v"), F.col("w"), keys, ["ts"], 10))
    whole = sorted(map(str, op(rows, ["k"]).collect()))
    for chunk in (4, 16, 1000):
        assert sorted(map(str, T.chunked(rows, ["k"], F.col("ts"), 9, chunk, op).collect())) == whole


def test_tabular_models_tell_held_out_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(a * (1 + b) > 26), 1.0 + i % 2) for i, (a, b) in enumerate(zip(rng.uniform(1, 50, 1500), rng.uniform(0, 0.1, 1500), strict=True))]
    frame = spark.createDataFrame(rows, "i long, x double, y double, label double, w double").cache()
    learn, held = frame.where("i < 1000"), frame.where("i >= 1000")
    for model in (N.logistic(learn, ["x", "y"], "label", "w"), N.boosted(learn, ["x", "y"], "label", rounds=3, depth=3)):
        out = N.probabilities(model, held).collect()
        assert len(out) == 500 and all(0 <= r.probability_1 <= 1 for r in out)
        right = [(r.probability_1 >= 0.5) == (r.label == 1) for r in out]
        assert sum(right) >= 0.95 * len(right) and 0.3 < sum(r.label for r in out) / len(out) < 0.7
