"""Positions over time: decoders, ledgers, equity, backtests. Sequential rules run once per segment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import temporal as T

DAY_US = 86_400_000_000
NOOP, OPEN_LONG, OPEN_SHORT, CLOSE_LONG, CLOSE_SHORT = range(5)
FLAT, LONG, SHORT = 0, 1, -1


def _kinds(rows: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def per_segment(rows: DataFrame, keys: Sequence[str], order: str, work: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """Runs work on each segment's rows in order; a task holds one segment at a time. work gives rows without the keys."""
    names = [*keys, *[x.strip().split()[0] for x in schema.split(",")]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        head = tuple(pdf[list(keys)].iloc[0])
        return pd.DataFrame([(*head, *r) for r in work(pdf)], columns=names)

    return rows.groupBy(*keys).applyInPandas(run, f"{_kinds(rows, keys)}, {schema}")


def decode(rows: DataFrame, keys: Sequence[str], order: str, threshold: float | None = None) -> DataFrame:
    """(order, action, position after it) from hazards h0..h3 (open long, open short, close long, close short).

    With a threshold the larger opening hazard fires once it reaches it (long on ties), and a position's own
    closing hazard likewise. Without, the likeliest event does: an opening beats none if its share of
    1 - exp(-total) exceeds exp(-total), a closing if its hazard exceeds ln 2. Rows that aren't valid do nothing.
    """

    def work(pdf: pd.DataFrame) -> list[tuple]:
        h, valid, at = pdf[["h0", "h1", "h2", "h3"]].to_numpy(float), pdf["valid"].to_numpy(bool), pdf[order].to_numpy()
        position, out = FLAT, []
        for i in range(len(at)):
            action = NOOP
            if valid[i] and position == FLAT:
                side = 0 if h[i, 0] >= h[i, 1] else 1
                total = h[i, 0] + h[i, 1]
                if threshold is not None:
                    fires = h[i, side] >= threshold
                else:
                    fires = total > 0 and h[i, side] * -np.expm1(-total) / total > np.exp(-total)
                action = (OPEN_LONG, OPEN_SHORT)[side] if fires else NOOP
            elif valid[i]:
                mine = h[i, 2] if position == LONG else h[i, 3]
                if mine >= threshold if threshold is not None else mine > np.log(2):
                    action = CLOSE_LONG if position == LONG else CLOSE_SHORT
            position = {OPEN_LONG: LONG, OPEN_SHORT: SHORT, CLOSE_LONG: FLAT, CLOSE_SHORT: FLAT}.get(action, position)
            out.append((at[i], action, position))
        return out

    return per_segment(rows, keys, order, work, f"{order} long, action int, position int")


def allowed(position: Column, valid: Column) -> Column:
    """Which of the four events a position allows, as an array of booleans; none where execution isn't valid."""
    return F.array(valid & (position == FLAT), valid & (position == FLAT), valid & (position == LONG), valid & (position == SHORT))


def best_allowed(values: Sequence[Column], mask: Column) -> Column:
    """Place of the first largest value that is allowed, null if none is."""
    shown = F.array(*[F.when(mask[i], v) for i, v in enumerate(values)])
    return F.when(F.array_max(shown).isNotNull(), F.array_position(shown, F.array_max(shown)) - 1).cast("int")


def action_ledger(rows: DataFrame, keys: Sequence[str], order: str, tick: float = 1.0, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """Trades of alternating openings and closings (action at a row fills at that row's bid and ask).

    Actions alternate, so an opening pairs with the next action; one without ends at the segment's last row.
    """
    c = F.col
    rows = rows.withColumn("_last", F.max(F.struct(order, "bid", "ask")).over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy(order)
    acts = rows.where(c("action") != NOOP).withColumn("_exit", F.lead(F.struct(order, "bid", "ask")).over(w))
    opened = acts.where(c("action").isin(OPEN_LONG, OPEN_SHORT)).withColumns({"terminal": c("_exit").isNull(), "_exit": F.coalesce("_exit", "_last"), "side": F.when(c("action") == OPEN_LONG, 1).otherwise(-1)})
    slip = slippage * tick
    long = c("side") == 1
    entry, leave = F.when(long, c("ask") + slip).otherwise(c("bid") - slip), F.when(long, c("_exit.bid") - slip).otherwise(c("_exit.ask") + slip)
    out = opened.withColumns({"entry_at": c(order), "exit_at": c(f"_exit.{order}"), "entry_price": entry, "exit_price": leave})
    return out.select(*keys, "entry_at", "exit_at", "side", "entry_price", "exit_price", ((c("exit_price") - c("entry_price")) * c("side") / tick - 2 * commission).alias("net_ticks"), "terminal")


def equity(rows: DataFrame, keys: Sequence[str], order: str, commission: float, slippage: float, tick: float = 1.0) -> DataFrame:
    """Cash, position, marked equity and reward after each row's action at its bid and ask.

    Equity and quotes stand still on invalid rows; the reward is the change of equity. All running sums, as
    the actions are given.
    """
    c = F.col
    bid, ask = c("bid") / tick, c("ask") / tick
    flow = F.when(c("action").isin(OPEN_SHORT, CLOSE_LONG), bid - slippage - commission).when(c("action").isin(OPEN_LONG, CLOSE_SHORT), -(ask + slippage + commission)).otherwise(0.0)
    change = F.when(c("action") == OPEN_LONG, 1).when(c("action") == OPEN_SHORT, -1).when(c("action") == CLOSE_LONG, -1).when(c("action") == CLOSE_SHORT, 1).otherwise(0)
    w = T.over(keys, [order])
    rows = rows.withColumns({"cash": F.sum(flow).over(w), "position": F.sum(change).over(w)})
    marked = c("cash") + F.when(c("position") > 0, bid).when(c("position") < 0, -ask).otherwise(0.0)
    rows = rows.withColumn("equity", F.coalesce(F.last(F.when(c("valid"), marked), ignorenulls=True).over(w), F.lit(0.0)))
    before = F.coalesce(F.lag("equity").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0.0))
    return rows.withColumn("reward", c("equity") - before)


def final_cash(rows: DataFrame, keys: Sequence[str], order: str, commission: float, slippage: float, tick: float = 1.0) -> DataFrame:
    """Per key the cash after closing what is open at the last valid quote."""
    w = F.max_by(F.struct("cash", "position"), order)
    quote = F.max_by(F.struct("bid", "ask"), F.when(F.col("valid"), F.col(order)))
    out = equity(rows, keys, order, commission, slippage, tick).groupBy(*keys).agg(w.alias("s"), quote.alias("q"))
    close = F.when(F.col("s.position") > 0, F.col("q.bid") / tick - slippage - commission).when(F.col("s.position") < 0, -(F.col("q.ask") / tick + slippage + commission)).otherwise(0.0)
    return out.select(*keys, (F.col("s.cash") + close).alias("net"))


CROSS = "entry_at long, exit_at long, side int, entry_price double, exit_price double, net_ticks double, crossings int, terminal boolean"


def cross_ledger(rows: DataFrame, keys: Sequence[str], order: str, crossing: int, threshold: float, tick: float = 1.0, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """Opens on hazards, closes at the first or second crossing of the price over its average.

    rows of a segment: first_bid, first_ask, last_bid, last_ask, avg_bid, avg_ask, h0, h1, observed. A decision
    at a row fills at the next one, if that is observed. The larger hazard opens from threshold on (long on
    ties). The side of the spread that the position would leave by is followed from the fill on, touches
    ignored; when it has changed `crossing` times the position closes at the next observed fill. What is open
    at the end closes at the last observed row; decisions end two rows before it. Segments need three rows
    and two observed ones.
    """

    def work(pdf: pd.DataFrame) -> list[tuple]:
        seen = pdf["observed"].to_numpy(bool)
        if seen.sum() < 2:
            return []
        pdf = pdf.iloc[: np.flatnonzero(seen)[-1] + 1]
        n = len(pdf)
        if n < 3:
            return []
        g = {k: pdf[k].to_numpy(float) for k in ("first_bid", "first_ask", "last_bid", "last_ask", "avg_bid", "avg_ask", "h0", "h1")}
        at = pdf[order].to_numpy()
        slip, out = slippage * tick, []
        position, entry, price, side, count, pending = 0, -1, 0.0, 0, 0, False

        def spread(i: int) -> int:
            gap = g["last_bid"][i] - g["avg_bid"][i] if position > 0 else g["last_ask"][i] - g["avg_ask"][i]
            return int(np.sign(gap))

        def close(i: int, terminal: bool) -> None:
            leave = g["first_bid"][i] - slip if position > 0 else g["first_ask"][i] + slip
            out.append((at[entry], at[i], position, price, leave, (leave - price) * position / tick - 2 * commission, count, terminal))

        for i in range(n - 2):
            fill = bool(seen[i + 1])
            if position:
                if not pending:
                    now = spread(i)
                    if now and side and now != side:
                        count += 1
                    side = now or side
                    pending = count >= crossing
                if pending and fill:
                    close(i + 1, False)
                    position, pending = 0, False
                continue
            long = g["h0"][i] >= g["h1"][i]
            if fill and max(g["h0"][i], g["h1"][i]) >= threshold:
                position, entry, count, pending = 1 if long else -1, i + 1, 0, False
                price = g["first_ask"][entry] + slip if long else g["first_bid"][entry] - slip
                side = spread(entry)
        if position:
            close(n - 1, True)
        return out

    return per_segment(rows, keys, order, work, CROSS)


BACKTEST = "side int, entry_at long, exit_at long, entry_price double, exit_price double, gross_bps double, net_bps double, unresolved boolean"


def excess(forward: Column, backward: Column, open_at: float, close_at: float) -> Column:
    """How far above its threshold the forward curve is, null while the backward one is above its own."""
    return F.when(backward <= close_at, (forward - open_at) / max(1 - open_at, 1e-9))


def decide(position: Column, thresholds: Sequence[float] = (0.5, 0.5, 0.5, 0.5)) -> Column:
    """The four-curve rule as an expression over long_back, long_fwd, short_back, short_fwd."""
    c = F.col
    low = F.lit(float("-inf"))
    long = F.coalesce(excess(c("long_fwd"), c("long_back"), thresholds[1], thresholds[0]), low)
    short = F.coalesce(excess(c("short_fwd"), c("short_back"), thresholds[3], thresholds[2]), low)
    flat = F.when(F.greatest(long, short) <= 0, "skip").when(long >= short, "open_long").otherwise("open_short")
    held = lambda back, limit, name: F.when(c(back) > limit, name).otherwise("hold")
    return F.when(position == FLAT, flat).when(position == LONG, held("long_back", thresholds[0], "close_long")).otherwise(held("short_back", thresholds[2], "close_short"))


def curve_backtest(rows: DataFrame, keys: Sequence[str], order: str, segment: str, thresholds: Sequence[float], fee_bps: float, reset_gap: int) -> DataFrame:
    """Trades of the four-curve rule; a new segment or a long gap drops an open position as unresolved.

    Invalid rows do nothing but end a gap. A position never reopens at the row that closed it. Unresolved
    positions are rows without an exit.
    """
    tb, tf, sb, sf = thresholds

    def work(pdf: pd.DataFrame) -> list[tuple]:
        at, seg, valid = pdf[order].to_numpy(), pdf[segment].to_numpy(), pdf["valid"].to_numpy(bool)
        bid, ask = pdf["bid"].to_numpy(float), pdf["ask"].to_numpy(float)
        curves = pdf[["long_back", "long_fwd", "short_back", "short_fwd"]].to_numpy(float)
        state, entry, price, out = FLAT, -1, 0.0, []
        lost = lambda: out.append((state, at[entry], None, price, None, None, None, True))
        for i in range(len(at)):
            if i and (seg[i] != seg[i - 1] or at[i] - at[i - 1] > reset_gap):
                if state:
                    lost()
                state = FLAT
            if not valid[i]:
                continue
            lb, lf, xb, xf = curves[i]
            if state == FLAT:
                long = (lf - tf) / max(1 - tf, 1e-9) if lb <= tb else -np.inf
                short = (xf - sf) / max(1 - sf, 1e-9) if xb <= sb else -np.inf
                if max(long, short) > 0:
                    state, entry = (LONG if long >= short else SHORT), i
                    price = ask[i] if state == LONG else bid[i]
            elif (lb > tb) if state == LONG else (xb > sb):
                leave = bid[i] if state == LONG else ask[i]
                gross = 1e4 * ((leave / price if state == LONG else price / leave) - 1)
                out.append((state, at[entry], at[i], price, leave, gross, gross - fee_bps, False))
                state = FLAT
        if state:
            lost()
        return out

    return per_segment(rows, keys, order, work, BACKTEST)


SWAPS = "entry_at long, initial_side int, final_side int, swaps int, first_delay int, pnl double"


def live_swaps(rows: DataFrame, keys: Sequence[str], order: str, confirm: int, most: int, cost: float, tick: float = 1.0) -> DataFrame:
    """Positions of events that turn when evidence for the other side is confirmed on rows in a row.

    rows of an event from its entry row on, then two more: first_bid, first_ask, desired (-1, 0, 1), usable,
    side (of the entry row). The last row fills the exit, the one before it is the crossing.
    """

    def work(pdf: pd.DataFrame) -> list[tuple]:
        n = len(pdf)
        if n < 3:
            return []
        bid, ask = pdf["first_bid"].to_numpy(float) / tick, pdf["first_ask"].to_numpy(float) / tick
        desired, usable = pdf["desired"].to_numpy(), pdf["usable"].to_numpy(bool)
        side = first = int(pdf["side"].iloc[0])
        buy, sell = lambda i: -(ask[i] + cost), lambda i: bid[i] - cost
        cash = buy(1) if side > 0 else sell(1)
        swaps, seen, run, delay = 0, 0, 0, -1
        for i in range(1, n - 2):
            want = int(desired[i])
            if not (usable[i] and want and want != side):
                seen, run = 0, 0
                continue
            run = run + 1 if want == seen else 1
            seen = want
            if run >= confirm and swaps < most:
                cash += 2 * (sell(i + 1) if side > 0 else buy(i + 1))
                side, swaps, seen, run = want, swaps + 1, 0, 0
                delay = i if delay < 0 else delay
        cash += sell(n - 1) if side > 0 else buy(n - 1)
        return [(pdf[order].iloc[0], first, side, swaps, delay, cash)]

    return per_segment(rows, keys, order, work, SWAPS)


def exit_metrics(trades: DataFrame, pnl: str, hold: str, edges: Sequence[float], order: Sequence[str]) -> DataFrame:
    """Counts by side and kind of exit, profit, profit factor, deepest fall and holding times of a ledger, with a count for each holding bucket. One row.

    Buckets end at the edges, which belong to them; the last one has what is longer. Without losses the profit
    factor is infinite, or 0 without gains either. An empty ledger gives zeros.
    """
    c, p = F.col, F.col(pnl)
    zero = lambda x, n: F.coalesce(x, F.lit(0.0)).alias(n)
    gains, losses = F.sum(F.when(p > 0, p).otherwise(0.0)), -F.sum(F.when(p < 0, p).otherwise(0.0))
    factor = F.when(losses > 0, gains / losses).when(gains > 0, F.lit(float("inf"))).otherwise(0.0)
    lows = [None, *edges]
    counts = [F.count_if((F.lit(True) if a is None else c(hold) > a) & (F.lit(True) if b is None else c(hold) <= b)).alias(f"hold_{i}") for i, (a, b) in enumerate(zip(lows, [*edges, None], strict=True))]
    out = trades.agg(F.count("*").alias("trades"), F.count_if(c("side") > 0).alias("long_trades"), F.count_if(c("side") < 0).alias("short_trades"), F.count_if(~c("terminal")).alias("crossed"), F.count_if("terminal").alias("forced"), zero(F.sum(p), "total"), zero(F.avg(p), "mean"), zero(F.median(p), "median"), zero(F.avg((p > 0).cast("double")), "hit_rate"), zero(factor, "profit_factor"), zero(F.avg(c(hold)), "hold_mean"), zero(F.median(c(hold)), "hold_median"), *counts)
    # The running total over all trades is taken by days, so that no task sorts them all.
    day = F.floor(F.col(order[0]) / DAY_US)
    rows = trades.select(pnl, *order, day.alias("_day"), F.lit(0).alias("_all"))
    inside = Window.partitionBy("_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(pnl).over(inside)).withColumn("_top", F.greatest(F.max("_sum").over(inside), F.lit(0.0)))
    days = rows.groupBy("_day").agg(F.sum(pnl).alias("_total"), F.max("_sum").alias("_high"), F.max(F.col("_top") - F.col("_sum")).alias("_fall"), F.min("_sum").alias("_low"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    days = days.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    days = days.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_before") + F.greatest("_high", F.lit(0.0))).over(earlier), F.lit(0.0)), F.lit(0.0)))
    fall = days.agg(F.coalesce(F.max(F.greatest("_fall", F.col("_peak") - F.col("_before") - F.col("_low"))), F.lit(0.0)).alias("max_drawdown"))
    return out.crossJoin(fall)  # one row each


def position_path(rows: DataFrame, keys: Sequence[str], order: str, cadence: float, side: Column, entry_price: Column, bid: str = "bid", ask: str = "ask") -> DataFrame:
    """Per row of a trade: log age, profit in bps, its running extremes and what was given back."""
    leave = F.when(side > 0, F.col(bid)).otherwise(F.col(ask))
    gain = F.when((leave > 0) & (entry_price > 0), F.when(side > 0, leave / entry_price - 1).otherwise(entry_price / leave - 1) * 1e4).otherwise(0.0)
    w = T.over(keys, [order])
    rows = rows.withColumns({"age_log": F.log1p((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) * cadence), "pnl_bps": gain})
    rows = rows.withColumns({"mfe": F.greatest(F.max("pnl_bps").over(w), F.lit(0.0)), "mae": F.least(F.min("pnl_bps").over(w), F.lit(0.0))})
    return rows.withColumn("giveback", F.col("mfe") - F.col("pnl_bps"))


CLOSE = "close_start long, close_end long, close_peak long, close_score double"


def close_zones(entries: DataFrame, rows: DataFrame, keys: Sequence[str], place: str, value: str, reach: int, ratio: float) -> DataFrame:
    """For each entry the best local peak of value within reach rows after it, and the zone at or above ratio of it.

    The largest inner local peak counts, else the largest value. Rows after the entry are joined by place, at
    most reach of them an entry. Entries without a positive peak give nothing.
    """
    ahead = entries.select(*keys, F.col(place).alias("_entry"), F.explode(F.sequence(F.col(place) + 1, F.col(place) + reach)).alias(place))
    seen = ahead.join(rows.select(*keys, place, value), [*keys, place])
    w = Window.partitionBy(*keys, "_entry").orderBy(place)
    seen = seen.withColumns({"_p": F.lag(value).over(w), "_n": F.lead(value).over(w)})
    seen = seen.withColumn("_peak", F.coalesce((F.col(value) >= F.col("_p")) & (F.col(value) > F.col("_n")), F.lit(False)))
    best = F.max(F.struct(F.col("_peak").alias("inner"), F.col(value).alias("v"), (-F.col(place)).alias("at"))).over(Window.partitionBy(*keys, "_entry"))
    seen = seen.withColumn("_best", best).where(F.col("_best.v") > 0)
    low = F.col(value) < F.col("_best.v") * ratio
    peak = -F.col("_best.at")
    out = seen.groupBy(*keys, "_entry").agg(F.max(F.when(low & (F.col(place) < peak), F.col(place))).alias("_l"), F.min(F.when(low & (F.col(place) > peak), F.col(place))).alias("_r"), F.min(place).alias("_a"), F.max(place).alias("_z"), F.max(peak).alias("close_peak"), F.max("_best.v").alias("close_score"))
    return out.select(*keys, F.col("_entry").alias(place), F.coalesce(F.col("_l") + 1, "_a").alias("close_start"), F.coalesce(F.col("_r"), F.col("_z") + 1).alias("close_end"), "close_peak", "close_score")


def scaled_horizons(rows: DataFrame, columns: Sequence[str], fit: Column, quantile: float = 0.95) -> DataFrame:
    """Columns over their quantile of positive fitted values (1 without any), the largest and its place (first on ties)."""
    q = rows.where(fit).agg(*[F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(quantile)).alias(c) for c in columns]).first()
    scale = {c: max(q[c], 1e-6) if q and q[c] is not None else 1.0 for c in columns}
    rows = rows.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) / scale[c] for c in columns})
    every = F.array(*columns)
    return rows.withColumns({"dominant": (F.array_position(every, F.array_max(every)) - 1).cast("int"), "dominant_score": F.array_max(every)})
