"""Composed tables: frames of features, version checks, examples, override grids, soft labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import decisions as D
from . import excursions as X
from . import metrics as M
from . import scores as C
from . import temporal as T


def venue_features(rows: DataFrame, most_stale: float = 60_000.0) -> DataFrame:
    """Per tick and venue the quote features of a frame: zeros where the book isn't valid, age capped."""
    ok = S.quote_valid(F.col("bid"), F.col("ask"), strict=True)
    mid = S.mid(F.col("bid"), F.col("ask"))
    micro = S.microprice(F.col("bid"), F.col("ask"), F.col("bid_qty"), F.col("ask_qty"))
    zero = lambda x: F.when(ok, F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    return rows.withColumns(
        {
            "book_valid": ok.cast("double"),
            "stale_ms": F.least(F.coalesce("stale_ms", F.lit(most_stale)), F.lit(most_stale)),
            "mid": zero(mid),
            "spread_bps": zero(S.spread_bps(F.col("bid"), F.col("ask"))),
            "micro_bps": zero(1e4 * (micro / mid - 1)),
            "bid_log_qty": F.log1p(F.coalesce("bid_qty", F.lit(0.0))),
            "ask_log_qty": F.log1p(F.coalesce("ask_qty", F.lit(0.0))),
            "bid": zero(F.col("bid")),
            "ask": zero(F.col("ask")),
        }
    )


def wide(rows: DataFrame, tick: str, venues: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per tick with <venue>__<value> columns in a fixed order, 0 where a venue has no row."""
    aggs = [F.coalesce(F.max(F.when(F.col("venue") == v, F.col(x))), F.lit(0.0)).alias(f"{v}__{x}") for v in venues for x in values]
    return rows.groupBy(tick).agg(*aggs)


def grid_returns(rows: DataFrame, keys: Sequence[str], order: str, mid: str, valid: str, lags: Sequence[int]) -> dict[str, Column]:
    """return_<k>_bps over k rows where both ends are valid, else 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return {f"return_{k}_bps": F.coalesce(F.when(F.col(valid) & F.lag(valid, k).over(w), 1e4 * (F.col(mid) / F.lag(mid, k).over(w) - 1)), F.lit(0.0)) for k in lags}


def hierarchy(gaps: Sequence[Column], slopes: Sequence[Column], horizons: Sequence[int], short: int, long: int) -> dict[str, Column]:
    """Statistics of the gaps and slopes of several averages: consensus, level, spread, change over the log of the horizon.

    short: the number of horizons that count as short, long: the place from which they count as long.
    """
    x = np.log(np.array(horizons, float))
    x = (x - x.mean()) / ((x - x.mean()) @ (x - x.mean()))
    mean = lambda cols: sum(cols[1:], cols[0]) / float(len(cols))
    spread = lambda cols: F.sqrt(F.greatest(mean([c * c for c in cols]) - mean(cols) * mean(cols), F.lit(0.0)))
    tilt = lambda cols: sum((c * float(k) for c, k in zip(cols[1:], x[1:], strict=True)), cols[0] * float(x[0]))
    out = {"consensus": mean([F.signum(g) for g in gaps]), "positive": mean([(g > 0).cast("double") for g in gaps])}
    for name, cols in (("gap", gaps), ("slope", slopes)):
        a, b = mean(cols[:short]), mean(cols[long:])
        out |= {f"{name}_mean": mean(cols), f"{name}_std": spread(cols), f"{name}_tilt": tilt(cols), f"{name}_short": a, f"{name}_long": b, f"{name}_long_short": b - a}
    return out


def entry_windows(rows: DataFrame, event: Sequence[str], order: str, columns: Sequence[str], valid: Column, windows: Sequence[int]) -> DataFrame:
    """Adds <column>_w<k>: the mean over the valid ones of the last k rows within the event, the row's own value if none is."""
    cols = {}
    for k in windows:
        w = T.over(event, [order], k - 1)
        for c in columns:
            cols[f"{c}_w{k}"] = F.coalesce(F.avg(F.when(valid, F.col(c))).over(w), F.col(c))
    return rows.withColumns(cols)


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows by how two versions differ: left_only, right_only, differs or same. Nulls equal nulls."""
    a = left.select(*keys, F.struct(*values).alias("_a"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.struct(*values).alias("_b"), F.lit(True).alias("_r"))
    same = F.lit(True)
    for v in values:
        same = same & (F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}")) | F.coalesce(F.abs(F.col(f"_a.{v}") - F.col(f"_b.{v}")) <= tolerance, F.lit(False)))
    out = a.join(b, list(keys), "full_outer")
    return out.select(*keys, F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(same, "same").otherwise("differs").alias("state"))


def block_comparison(left: DataFrame, right: DataFrame, keys: Sequence[str], block: Column, truth: str, guess: str) -> DataFrame:
    """Two versions of predictions on the keys that both have, by blocks (weeks): rows, mean errors of both, and the gain of the second."""
    a = left.select(*keys, F.col(truth).alias("_t"), F.col(guess).alias("_a"))
    b = right.select(*keys, F.col(guess).alias("_b"))
    both = a.join(b, list(keys)).withColumn("block", block)
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("_t")))
    out = both.groupBy("block").agg(F.count("*").alias("rows"), err("_a").alias("mae_left"), err("_b").alias("mae_right"))
    return out.withColumn("gain", F.col("mae_left") - F.col("mae_right"))


def extended(base: DataFrame, extension: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """base and the rows after it; raises unless the extension repeats none of base's times with other values, and starts after it."""
    last = base.agg(F.max(at)).first()[0]
    if extension.columns != base.columns:
        raise ValueError("the schemas differ")
    overlap = extension.where(F.col(at) <= last)
    if compare(overlap, base.join(overlap.select(*keys), list(keys), "left_semi"), keys, values).where("state != 'same'").limit(1).count():
        raise ValueError("the extension changes rows that were frozen")
    return base.unionByName(extension.where(F.col(at) > last))


def override_grid(rows: DataFrame, gap: str, families: Sequence[Sequence[int]], alignments: Sequence[float], shares: Sequence[float], slopes: Sequence[float], least_gaps: Sequence[float], side: str, day: str) -> DataFrame:
    """Per setting of the override the swaps and the summary of the trades, the best (largest robust score, first on ties) flagged.

    rows: long_pnl, short_pnl, side, gap, g<h>, s<h>. The grid is an array on each row, so nothing is joined.
    """
    settings, i = [], 0
    for family in families:
        for a in alignments:
            for b in shares:
                for c in slopes:
                    for d in least_gaps:
                        dominant, relation, _, _ = X.evidence(F.col(gap), [F.col(f"g{h}") for h in family], [F.col(f"s{h}") for h in family], d, a, b, c)
                        swap = dominant & (F.col(side) == relation)
                        now = F.when(swap, -F.col(side)).otherwise(F.col(side))
                        pnl = F.when(now > 0, F.col("long_pnl")).otherwise(F.col("short_pnl"))
                        settings.append(F.struct(F.lit(i).alias("setting"), F.lit(len(family)).alias("horizons"), F.lit(a).alias("alignment"), F.lit(b).alias("share"), F.lit(c).alias("slope"), F.lit(d).alias("least_gap"), swap.alias("swap"), pnl.cast("double").alias("pnl")))
                        i += 1
    long = rows.select(day, F.explode(F.array(*settings)).alias("x")).select(day, "x.*")
    keys = ["setting", "horizons", "alignment", "share", "slope", "least_gap"]
    out = D.summary(long, "pnl", day, keys).join(long.groupBy("setting").agg(F.count_if("swap").alias("swaps")), "setting")
    return out.withColumn("best", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("robust_score"), "setting")) == 1)  # one row per setting


def risk_summary(rows: DataFrame, mode: str, penalty: float, score: str, cutoff: float) -> DataFrame:
    """Of the candidates at or above a cutoff: trades, profit of the chosen side, how often the better side wins, mean tail. One row."""
    side = D.side_by(mode, penalty)
    value = D.scores(side, penalty)[score]
    tail = F.when(side > 0, F.col("long_tail_probability")).otherwise(F.col("short_tail_probability"))
    pnl = F.when(side > 0, F.col("long_pnl")).otherwise(F.col("short_pnl"))
    chosen = rows.where(value >= cutoff).select(pnl.alias("pnl"), F.greatest("long_pnl", "short_pnl").alias("best"), tail.alias("tail"))
    zero = lambda x, n: F.coalesce(x, F.lit(0.0)).alias(n)
    return chosen.agg(F.count("*").alias("trades"), zero(F.avg("pnl"), "mean"), zero(F.percentile("pnl", F.lit(0.5)), "median"), zero(F.avg((F.col("pnl") > 0).cast("double")), "win_rate"), zero(F.percentile("pnl", F.lit(0.05)), "p05"), zero(F.sum("pnl"), "total"), zero(F.avg((F.col("best") > 0).cast("double")), "oracle_win_rate"), zero(F.avg("tail"), "mean_tail"))


def policy_summary(actions: DataFrame, trades: DataFrame, kinds: Sequence[int]) -> DataFrame:
    """Counts of the actions and the trades' profit and holding times. One row."""
    a = actions.agg(F.count("*").alias("ticks"), *[F.count_if(F.col("action") == k).alias(f"action_{k}") for k in kinds])
    zero = lambda x, n: F.coalesce(x, F.lit(0.0)).alias(n)
    b = trades.agg(F.count("*").alias("trades"), zero(F.avg("pnl"), "mean"), zero(F.percentile("pnl", F.lit(0.5)), "median"), zero(F.avg((F.col("pnl") > 0).cast("double")), "win_rate"), zero(F.percentile("hold", F.lit(0.5)), "hold_p50"), zero(F.percentile("hold", F.lit(0.9)), "hold_p90"), zero(F.max("hold").cast("double"), "hold_max"))
    return a.crossJoin(b)  # one row each


def angle_metrics(rows: DataFrame, horizon_s: float, material_degrees: float = 10.0) -> DataFrame:
    """Errors of predicted angles and of the end points they imply, against the truth and against flat. One row.

    rows: pred, truth (radians), sigma, line_end, actual_end.
    """
    c = F.col
    end = C.angle_to_slope(c("pred"), c("sigma"), horizon_s) * horizon_s
    big = F.abs(c("truth")) >= math.radians(material_degrees)
    mae = lambda a, b: F.avg(F.abs(a - b))
    gain = lambda err, flat: 1 - err / F.greatest(flat, F.lit(1e-12))
    zero = F.lit(0.0)
    return rows.agg(
        F.degrees(mae(c("pred"), c("truth"))).alias("mae_degrees"),
        gain(mae(c("pred"), c("truth")), mae(c("truth"), zero)).alias("gain_vs_zero"),
        F.coalesce(M.correlation("pred", "truth"), zero).alias("corr"),
        F.coalesce(F.avg(F.when(big, ((c("pred") < 0) == (c("truth") < 0)).cast("double"))), zero).alias("material_accuracy"),
        F.avg(big.cast("double")).alias("material_share"),
        gain(mae(end, c("line_end")), mae(c("line_end"), zero)).alias("line_gain"),
        gain(mae(end, c("actual_end")), mae(c("actual_end"), zero)).alias("actual_gain"),
    )


def gate_rates(found: DataFrame, split: Column, end: str, gated: str, gate: str, per_day: int) -> DataFrame:
    """Per split: events, active days, gated events a day, and quantiles of the gate."""
    rows = found.withColumns({"split": split, "_day": F.floor(F.col(end) / per_day)}).where("split IS NOT NULL")
    out = rows.groupBy("split").agg(F.count("*").alias("events"), F.greatest(F.countDistinct("_day"), F.lit(1)).alias("days"), F.count_if(gated).alias("gated"), F.percentile(gate, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_q"))
    return out.select("split", "events", "days", "gated", (F.col("gated") / F.col("days")).alias("gated_per_day"), *[F.col("_q")[i].alias(f"gate_p{p}") for i, p in enumerate((10, 50, 90))])


def examples(flat: DataFrame, episodes: DataFrame, keys: Sequence[str], place: str, context: int, skip_stride: int, hold_stride: int, skip: int, close: int, hold: int) -> DataFrame:
    """Training examples of a flat state (skips thinned out) and of positions (holds thinned out, closings in full).

    flat: place, action, seg_place (from 0 in the segment). episodes: entry, close_start, close_end. A row
    needs a full context. Openings and closings weigh 2.
    """
    a = flat.where((F.col("action") != skip) | (F.pmod(place, F.lit(skip_stride)) == 0)).where(F.col("seg_place") + 1 >= context)
    a = a.select(*keys, place, F.lit(0).alias("state"), "action", F.lit(-1).cast("long").alias("entry"), F.when(F.col("action") == skip, 1.0).otherwise(2.0).alias("weight"))
    b = episodes.withColumn(place, F.explode(F.sequence(F.col("entry") + 1, F.col("close_end") - 1)))
    closing = F.col(place) >= F.col("close_start")
    b = b.where(closing | (F.pmod(F.col(place) - F.col("entry"), F.lit(hold_stride)) == 0)).join(flat.select(*keys, place, "seg_place"), [*keys, place]).where(F.col("seg_place") + 1 >= context)
    return a.unionByName(b.select(*keys, place, F.lit(1).alias("state"), F.when(closing, close).otherwise(hold).alias("action"), "entry", F.when(closing, 2.0).otherwise(1.0).alias("weight")))


def soft_peaks(rows: DataFrame, x: str, keys: Sequence[str], order: str, cadence_s: float, focus_s: float, high: float, full: float, floor: float = 0.2) -> DataFrame:
    """Adds target in [0, 1]: around each separated peak, its quality times the squared ratio to it and a decay in time.

    Before the peak the decay is slow (up to half the focus), after it fast. A run (keys) is one group.
    """
    apart = max(1, round(focus_s / (3 * cadence_s)))
    early, late = min(45.0, focus_s / 2), 3.0
    tau = max(cadence_s, early / 3), max(cadence_s, late / 3)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*keys, order])
    low = max(1e-12, 0.1 * high)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        s = pdf[x].to_numpy(float)
        out = np.zeros(len(s))
        found = C.choose_peaks(s, high, apart) if len(s) >= 3 else []
        for k, i in enumerate(found):
            a = 0 if k == 0 else (found[k - 1] + i) // 2 + 1
            b = len(s) if k + 1 == len(found) else (i + found[k + 1]) // 2 + 1
            below = np.flatnonzero(s[a:b] <= low) + a
            a, b = max([a, *(below[below < i] + 1)]), min([b, *below[below > i]])
            t = (np.arange(a, b) - i) * cadence_s
            quality = floor + (1 - floor) * min(max((s[i] - high) / max(full - high, 1e-12), 0), 1)
            value = quality * np.clip(s[a:b] / max(s[i], 1e-12), 0, 1) ** 2 * np.where(t <= 0, np.exp(t / tau[0]), np.exp(-t / tau[1]))
            out[a:b] = np.maximum(out[a:b], np.where((t >= -early) & (t <= late), value, 0))
        return pdf[[*keys, order]].assign(target=np.clip(out, 0, 1))

    return rows.select(*keys, order, x).groupBy(*keys).applyInPandas(run, f"{kinds}, target double")


def dense_edge(x: Column, high: float, full: float, floor: float = 0.2) -> Column:
    """Scores at or above high on a scale from floor to 1, 0 below."""
    return F.coalesce(F.when(x >= high, floor + (1 - floor) * S.clip((x - high) / max(full - high, 1e-12), 0.0, 1.0)), F.lit(0.0))


def rounded_steps(horizons: Sequence[float], cadence: float = 0.3) -> list[int]:
    """Whole steps of older score grids: rounded half to even, one at least."""
    return [max(1, round(h / cadence)) for h in horizons]
