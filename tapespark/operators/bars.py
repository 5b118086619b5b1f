"""Depth quotes to snapshots, snapshots to bars, and their averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import temporal as T

#: Rows of the multi-horizon averages; the first six make the ribbon.
HORIZONS = (5, 10, 15, 30, 45, 60, 120, 300, 900)
RIBBON = HORIZONS[:6]


def to_ns(ts: Column) -> Column:
    """Nanoseconds of an epoch time in s, ms, us or ns, told by its magnitude."""
    return F.when(F.abs(ts) < 10**11, ts * 10**9).when(F.abs(ts) < 10**14, ts * 10**6).when(F.abs(ts) < 10**17, ts * 1000).otherwise(ts)


def snapshots(quotes: DataFrame, keys: Sequence[str] = (), tick: float = 0.01, levels: int = 3, most_new: int = 20, max_spread: float = 500.0) -> DataFrame:
    """One row per exact time from new quotes (ts, bid, ask, size, type), accepted ones only.

    best bid and ask with the size there, sizes of the best three levels a side and the third price, level and
    row counts. Accepted: at least `levels` a side, at most most_new rows, 0 < spread <= max_spread ticks.
    """
    rows = quotes.where((F.col("type") == "new") & (F.col("size") > 0))
    by = [*keys, "ts"]
    out = rows.groupBy(*by).agg(
        F.max(F.when(F.col("bid") > 0, F.col("bid"))).alias("best_bid"),
        F.min(F.when(F.col("ask") > 0, F.col("ask"))).alias("best_ask"),
        F.max_by("size", F.when(F.col("bid") > 0, F.struct("bid", "size"))).alias("bid_size"),
        F.min_by("size", F.when(F.col("ask") > 0, F.struct("ask", -F.col("size")))).alias("ask_size"),
        F.count_if(F.col("bid") > 0).alias("bid_levels"),
        F.count_if(F.col("ask") > 0).alias("ask_levels"),
        F.count("*").alias("new_quotes"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("bid") > 0, F.struct("bid", "size"))), asc=False), 1, 3).alias("_bids"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("ask") > 0, F.struct("ask", F.col("size").alias("size"))))), 1, 3).alias("_asks"),
    )
    spread = S.spread_ticks(F.col("best_bid"), F.col("best_ask"), tick)
    out = out.where((F.col("bid_levels") >= levels) & (F.col("ask_levels") >= levels) & (F.col("new_quotes") <= most_new) & (spread > 0) & (spread <= max_spread))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["size"])
    return out.withColumns(
        {
            "spread_ticks": spread,
            "mid": S.mid(F.col("best_bid"), F.col("best_ask")),
            "microprice": S.microprice(F.col("best_bid"), F.col("best_ask"), F.col("bid_size"), F.col("ask_size")),
            "imbalance1": S.imbalance(F.col("bid_size"), F.col("ask_size")),
            "bid_depth3": total("_bids"),
            "ask_depth3": total("_asks"),
            "imbalance3": S.imbalance(total("_bids"), total("_asks")),
            "bid_width3": (F.col("best_bid") - F.try_element_at("_bids", F.lit(3))["bid"]) / tick,
            "ask_width3": (F.try_element_at("_asks", F.lit(3))["ask"] - F.col("best_ask")) / tick,
        }
    ).drop("_bids", "_asks")


def first_last(value: str, order: Sequence[str]) -> tuple[Column, Column]:
    """The value at the first and the last row in order; a total order, so ties can't change it."""
    return F.min_by(value, F.struct(*order)), F.max_by(value, F.struct(*order))


def ohlc(rows: DataFrame, keys: Sequence[str], at: str, width: int, price: str, order: Sequence[str], carry: Sequence[str] = (), totals: Sequence[str] = ()) -> DataFrame:
    """Bars of width: open, high, low, close, first_ and last_ of carry, sums of totals, count, last time."""
    opened, closed = first_last(price, order)
    aggs = [opened.alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), closed.alias("close"), F.count("*").alias("ticks"), F.max(at).alias("last_ts")]
    for c in carry:
        a, b = first_last(c, order)
        aggs += [a.alias(f"first_{c}"), b.alias(f"last_{c}")]
    aggs += [F.sum(c).alias(c) for c in totals]
    return rows.groupBy(*keys, S.bucket(F.col(at), width).alias("bar")).agg(*aggs)


def last_of_bars(rows: DataFrame, keys: Sequence[str], at: str, width: int, order: Sequence[str], state: Sequence[str], totals: Sequence[str], price: str) -> DataFrame:
    """Longer bars: the last row's state (as last_<column>), sums of totals (<column>_total), rows, and the price's range and change."""
    by = F.struct(*order)
    first, last = first_last(price, order)
    out = rows.groupBy(*keys, S.bucket(F.col(at), width).alias("bar")).agg(F.max_by(F.struct(*state), by).alias("_last"), *[F.sum(c).alias(f"{c}_total") for c in totals], F.count("*").alias("n"), (F.max(price) - F.min(price)).alias("mid_range"), (last - first).alias("mid_change"))
    return out.select(*keys, "bar", *[F.col(f"_last.{c}").alias(f"last_{c}") for c in state], *[f"{c}_total" for c in totals], "n", "mid_range", "mid_change")


def regular(bars: DataFrame, keys: Sequence[str], width: int, carry: int, per_ms: int = 1000, part: int | None = None) -> DataFrame:
    """gap_fill for bars: carried rows are flat at the close, have no ticks or weight, and their quotes age."""
    out = T.gap_fill(bars, keys, "bar", width, carry, part)
    flat = ~F.col("observed")
    cols = {c: F.when(flat, F.col("close")).otherwise(F.col(c)) for c in ("open", "high", "low")}
    cols |= {c: F.when(flat, F.col("last_" + c.removeprefix("first_"))).otherwise(F.col(c)) for c in bars.columns if c.startswith("first_")}
    cols |= {"ticks": F.when(flat, 0).otherwise(F.col("ticks")), "age_ms": F.when(flat, F.greatest(F.col("bar") - F.col("last_ts"), F.lit(0)) / float(per_ms)).otherwise(0.0)}
    return out.withColumns(cols)


def averages(bars: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, weight: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Adds avg_<h>, the causal weighted average over h rows, for each horizon."""
    return bars.withColumns({f"avg_{h}": T.weighted_average(F.col(value), F.col(weight), keys, order, h) for h in horizons})


def ribbon(bars: DataFrame, keys: Sequence[str], order: Sequence[str], mid: str = "mid", tick: float = 1.0) -> DataFrame:
    """Centre, width and their change of the averages of the ribbon's horizons, and the gap of centre and mid."""
    cols = [F.col(f"avg_{h}") for h in RIBBON]
    centre = sum(cols[1:], cols[0]) / float(len(cols))
    out = bars.withColumns({"ribbon": centre, "ribbon_width": (F.greatest(*cols) - F.least(*cols)) / tick})
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.withColumns({"ribbon_gap": (F.col("ribbon") - F.col(mid)) / tick, "ribbon_slope": zero(T.lag_delta(F.col("ribbon"), keys, order)) / tick, "ribbon_width_change": zero(T.lag_delta(F.col("ribbon_width"), keys, order))})


def contrasts(horizons: Sequence[int] = HORIZONS) -> tuple[list[float], list[float]]:
    """Linear and quadratic contrasts over the logarithms of the horizons, each scaled to give a slope."""
    import numpy as np

    linear = np.log(np.array(sorted(horizons), dtype=float))
    linear -= linear.mean()
    linear /= linear @ linear
    curved = linear**2 - (linear**2).mean()
    curved -= (curved @ linear) / (linear @ linear) * linear
    return linear.tolist(), (curved / (curved @ curved)).tolist()


def scale_stats(bars: DataFrame, mid: str = "mid", horizons: Sequence[int] = HORIZONS, tick: float = 1.0) -> DataFrame:
    """scale_slope, scale_curvature and scale_consensus (mean sign) of the gaps of the averages to mid."""
    gaps = [(F.col(f"avg_{h}") - F.col(mid)) / tick for h in sorted(horizons)]
    linear, curved = contrasts(horizons)
    dot = lambda w: sum((g * k for g, k in zip(gaps[1:], w[1:], strict=True)), gaps[0] * w[0])
    signs = [F.signum(g) for g in gaps]
    return bars.withColumns({"scale_slope": dot(linear), "scale_curvature": dot(curved), "scale_consensus": sum(signs[1:], signs[0]) / float(len(signs))})


def tick_features(bars: DataFrame, keys: Sequence[str], order: Sequence[str], tick: float = 1.0, averages: bool = False) -> DataFrame:
    """Distances in ticks from the close to the bar's other prices and quotes, and the close's change.

    With averages also those to book_average, daily_average, average_60 and average_300, and of the sided
    averages bid_average_60 and ask_average_60 to their quotes, beside these averages themselves.
    """
    c = F.col("close")
    more = {f"{n}_ticks": (F.col(n) - c) / tick for n in ("book_average", "daily_average", "average_60", "average_300")}
    more |= {f"{s}_average_60_ticks": (F.col(f"{s}_average_60") - F.col(f"last_{s}")) / tick for s in ("bid", "ask")}
    return bars.withColumns(
        (more if averages else {})
        | {
            "open_ticks": (F.col("open") - c) / tick,
            "high_ticks": (F.col("high") - c) / tick,
            "low_ticks": (F.col("low") - c) / tick,
            "range_ticks": (F.col("high") - F.col("low")) / tick,
            "close_change_ticks": T.lag_delta(c, keys, order) / tick,
            "bid_ticks": (F.col("last_bid") - c) / tick,
            "ask_ticks": (F.col("last_ask") - c) / tick,
            "spread_ticks": (F.col("last_ask") - F.col("last_bid")) / tick,
        }
    )


def candle_features(candles: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Log geometry of candles in basis points. Rolling columns run across gaps, as masks apply later."""
    o, h, low, c = (F.log(F.col(x)) for x in ("open", "high", "low", "close"))
    size = F.greatest(h - low, F.lit(1e-9))
    upper, lower = h - F.greatest(o, c), F.least(o, c) - low
    before = F.lag(c).over(Window.partitionBy(*keys).orderBy(*order))
    return candles.withColumns(
        {
            "return_bps": F.coalesce(c - before, F.lit(0.0)) * 1e4,
            "open_gap_bps": (o - F.coalesce(before, o)) * 1e4,
            "body_bps": (c - o) * 1e4,
            "range_bps": size * 1e4,
            "upper_wick_bps": upper * 1e4,
            "lower_wick_bps": lower * 1e4,
            "body_fraction": (c - o) / size,
            "upper_fraction": upper / size,
            "lower_fraction": lower / size,
            "log_volume": F.log1p(F.greatest(F.col("volume"), F.lit(0.0))),
        }
    )


def sane_candle() -> Column:
    """Positive prices with high above and low below the others."""
    return (F.least("open", "high", "low", "close") > 0) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
