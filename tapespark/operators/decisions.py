"""Targets, decision rules and selection of trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("classifier", "value", "risk")


def dominance_target(side: Column, mid: Column, average: Column, mid_at: Column, average_at: Column) -> Column:
    """1 where the price closes more of the gap up to the crossing than the average does."""
    return ((-side * (mid_at - mid)) > (side * (average_at - average))).cast("int")


def reversion_target(event_side: Column, long_pnl: Column, short_pnl: Column) -> Column:
    """1 where the side against the event pays more at the crossing."""
    wins = long_pnl > short_pnl
    return F.when(event_side < 0, wins.cast("int")).otherwise((~wins).cast("int"))


def entry_dominance_target(gap: Column, long_pnl: Column, short_pnl: Column) -> Column:
    """1 where the better side (long on ties) is against mean reversion, the sign of average minus price."""
    return (F.when(long_pnl >= short_pnl, 1).otherwise(-1) == -F.signum(gap).cast("int")).cast("int")


def swapped_side(gap: Column, probability: Column, threshold: float, base: Column) -> Column:
    """Against mean reversion from threshold on, with it below; the base side where the gap is 0."""
    relation = F.signum(gap).cast("int")
    return F.when(relation == 0, base).when(probability >= threshold, -relation).otherwise(relation)


def vetoed_side(gap: Column, probability: Column, threshold: float, base: Column) -> Column:
    """The base side, unless the probability reaches threshold: then against mean reversion."""
    relation = F.signum(gap).cast("int")
    return F.when((relation != 0) & (probability >= threshold), -relation).otherwise(base)


def pair_weight(long_pnl: Column, short_pnl: Column, scale: float = 100.0, low: float = 0.25, high: float = 10.0) -> Column:
    return F.least(F.greatest(F.abs(long_pnl - short_pnl) / scale, F.lit(low)), F.lit(high))


def side_by(mode: str, penalty: float = 0.0) -> Column:
    """1 or -1 by the classifier, the predicted values, or the values less a penalty on their tails; long on ties."""
    c = F.col
    if mode == "classifier":
        test = c("side_probability") >= 0.5
    elif mode == "value":
        test = c("predicted_long_pnl") >= c("predicted_short_pnl")
    elif mode == "risk":
        test = c("predicted_long_pnl") - penalty * c("long_tail_probability") >= c("predicted_short_pnl") - penalty * c("short_tail_probability")
    else:
        raise ValueError(f"mode must be one of {MODES}")
    return F.when(test, 1).otherwise(-1)


def scores(side: Column, penalty: float) -> dict[str, Column]:
    """The scores by which candidates may be ranked, each for the chosen side."""
    c = F.col
    of = lambda long, short: F.when(side > 0, c(long)).otherwise(c(short))
    tail, value = of("long_tail_probability", "short_tail_probability"), of("predicted_long_pnl", "predicted_short_pnl")
    doubt = F.sqrt(c("predicted_long_pnl_std") ** 2 + c("predicted_short_pnl_std") ** 2 + penalty**2 * (c("long_tail_probability_std") ** 2 + c("short_tail_probability_std") ** 2))
    gap = F.abs((c("predicted_long_pnl") - penalty * c("long_tail_probability")) - (c("predicted_short_pnl") - penalty * c("short_tail_probability")))
    return {
        "opportunity_probability": c("opportunity_probability"),
        "negative_tail_probability": -tail,
        "risk_edge": value - penalty * tail,
        "negative_side_disagreement": -c("side_probability_std"),
        "negative_tail_disagreement": -of("long_tail_probability_std", "short_tail_probability_std"),
        "negative_risk_uncertainty": -doubt,
        "risk_evidence": gap / (1 + doubt),
    }


def summary(trades: DataFrame, pnl: str, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: count, mean, median, total, win rate, p05 and the mean at or below it, worst, profit factor, standard error, days, and a robust score."""
    cut = trades.groupBy(*keys).agg(F.percentile(pnl, F.lit(0.05)).alias("p05"))
    rows = trades.join(cut, list(keys)) if keys else trades.crossJoin(cut)  # one row of cut
    x = F.col(pnl)
    out = rows.groupBy(*keys).agg(
        F.count(pnl).alias("trades"),
        F.avg(x).alias("mean"),
        F.median(x).alias("median"),
        F.sum(x).alias("total"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.max("p05").alias("p05"),
        F.avg(F.when(x <= F.col("p05"), x)).alias("cvar05"),
        F.min(x).alias("worst"),
        F.try_divide(F.sum(F.when(x > 0, x).otherwise(0)), -F.sum(F.when(x < 0, x).otherwise(0))).alias("profit_factor"),
        F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0)).alias("standard_error"),
        F.countDistinct(day).alias("days"),
    )
    return out.withColumn("robust_score", F.col("mean") + 0.1 * F.coalesce("cvar05", F.lit(0.0)) - 0.5 * F.col("standard_error"))


def drawdown(trades: DataFrame, pnl: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the largest fall of the running total from its highest value so far, which is at least 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("_sum", F.sum(pnl).over(w))
    rows = rows.withColumn("_top", F.greatest(F.max("_sum").over(w), F.lit(0)))
    return rows.groupBy(*keys).agg(F.max(F.col("_top") - F.col("_sum")).alias("max_drawdown"), F.max_by("_sum", F.struct(*order)).alias("total"))


def threshold_grid(entries: DataFrame, thresholds: Sequence[float], score: str, values: Sequence[str], events: int, least: int = 20, share: float = 0.05) -> DataFrame:
    """Per threshold: trades with score at or above it and mean values, eligible, best (first of the largest mean).

    Each row is dealt to the thresholds that it reaches; a threshold without trades has zeros.
    """
    grid = entries.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    rows = entries.select(F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(score) >= t)).alias("threshold"), *values)
    found = rows.groupBy("threshold").agg(F.count("*").alias("trades"), *[F.avg(v).alias(f"mean_{v}") for v in values], *[F.sum(v).alias(f"total_{v}") for v in values])
    out = grid.join(F.broadcast(found), "threshold", "left").fillna(0)
    out = out.withColumn("eligible", F.col("trades") >= max(least, int(events * share)))
    mean = sum((F.col(f"mean_{v}") for v in values[1:]), F.col(f"mean_{values[0]}")) / len(values)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("eligible"), mean.desc(), "threshold")  # one row per threshold
    return out.withColumn("best", F.row_number().over(w) == 1)
