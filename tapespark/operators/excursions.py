"""Excursions of a price around its average: events, geometry, gates, rate control, entries, exits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import temporal as T


def sides(rows: DataFrame, delta: str, segment: Sequence[str], at: str) -> DataFrame:
    """Adds side (last sign of delta that wasn't zero, 0 at first) and crossing (segment start or change of side)."""
    rows = rows.withColumn("side", T.carried_sign(F.col(delta), segment, [at]))
    before = F.lag("side").over(Window.partitionBy(*segment).orderBy(at))
    return rows.withColumn("crossing", before.isNull() | (before != F.col("side")))


def events(rows: DataFrame, segment: Sequence[str], at: str) -> DataFrame:
    """Numbers the events of a segment from 0; with the segment, the number is the event's name."""
    return rows.withColumn("event", F.sum(F.col("crossing").cast("int")).over(T.over(segment, [at])) - 1)


def geometry(rows: DataFrame, delta: str, segment: Sequence[str], at: str, gate: float | None = None) -> DataFrame:
    """Within each event up to the row: age, running maximum and area of |delta|, fill and current ratios, gate."""
    w = T.over([*segment, "event"], [at])
    size = F.abs(F.col(delta))
    rows = rows.withColumns({"age": F.row_number().over(Window.partitionBy(*segment, "event").orderBy(at)) - 1, "running_max": F.max(size).over(w), "running_area": F.sum(size).over(w)})
    rows = rows.withColumns({"fill_ratio": F.col("running_area") / F.greatest((F.col("age") + 1) * F.col("running_max"), F.lit(1e-6)), "current_ratio": size / F.greatest(F.col("running_max"), F.lit(1e-6))})
    return rows if gate is None else rows.withColumn("gate_open", F.col("running_max") >= gate)


def excursions(rows: DataFrame, delta: str, keys: Sequence[str], segment: str, at: str, per_second: int, threshold: float, gate_fraction: float = 0.75, least_seconds: float = 30.0) -> DataFrame:
    """One row per completed event: start, end, both crossings, side, duration, amplitude, gate, good.

    The crossings are the starts of the next two events; only events whose next two are in the same segment
    stay. end is the row before crossing_1, duration runs to crossing_1, amplitude is the largest |delta| up
    to end, gate_at the first row whose running maximum reaches gate_fraction of threshold.
    """
    size = F.abs(F.col(delta))
    by = [*keys, segment, "event"]
    first_hit = F.min(F.when(size >= threshold * gate_fraction, F.col(at)))
    found = rows.groupBy(*by).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.first("side").alias("side"), F.max(size).alias("amplitude"), F.count("*").alias("rows"), first_hit.alias("gate_at"))
    w = Window.partitionBy(*keys, segment).orderBy("event")
    found = found.withColumns({"crossing_1": F.lead("start", 1).over(w), "crossing_2": F.lead("start", 2).over(w)}).where(F.col("crossing_2").isNotNull())
    found = found.withColumn("duration_s", (F.col("crossing_1") - F.col("start")) / float(per_second))
    return found.withColumns({"gated": F.col("gate_at").isNotNull(), "good": (F.col("duration_s") >= least_seconds) & (F.col("amplitude") >= threshold)})


def adaptive_gate(found: DataFrame, keys: Sequence[str], end: str, amplitude: str, target_per_day: float, per_second: int, fallback: float, history: int = 2000, least: int = 200, gap_s: float = 300.0, gate_fraction: float = 0.75, top: int = 100_000) -> DataFrame:
    """Adds gate and threshold: a lower order statistic of the earlier events' binned amplitudes.

    Its level follows the rate of earlier events per active day, gaps capped: q = clip(1 - target / rate), and
    the statistic is that of rank floor(q (n - 1)) among at most history earlier events. With fewer than least
    of them the fallback stands. Only events that end before count.
    """
    w = Window.partitionBy(*keys).orderBy(end)
    past = w.rowsBetween(-history, -1)
    bins = F.least(F.greatest(F.rint(F.col(amplitude)), F.lit(0.0)), F.lit(float(top))).cast("long")
    step = F.col(end) - F.lag(end).over(w)
    rows = found.withColumns({"_bin": bins, "_gap": F.when(step.isNotNull(), F.least(step / float(per_second), F.lit(gap_s)))})
    n = F.count("_bin").over(past)
    # The gap into the oldest event kept is no gap among the kept ones.
    inside = F.sum("_gap").over(w.rowsBetween(-history, -1)) - F.coalesce(F.first("_gap").over(past), F.lit(0.0))
    rows = rows.withColumns({"_n": n, "_span": inside / 86400.0, "_past": F.array_sort(F.collect_list("_bin").over(past))})
    rate = F.when((F.col("_n") < 2) | ~(F.col("_span") > 0), F.col("_n").cast("double")).otherwise((F.col("_n") - 1) / F.col("_span"))
    q = F.least(F.greatest(1 - F.try_divide(F.lit(float(target_per_day)), rate), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("level", q)
    pick = F.try_element_at("_past", (F.floor(F.col("level") * (F.col("_n") - 1)) + 1).cast("int")).cast("double")
    gate = F.when(F.col("_n") >= least, pick).otherwise(F.lit(fallback * gate_fraction))
    return rows.withColumn("gate", gate).withColumn("threshold", F.col("gate") / gate_fraction).drop("_bin", "_gap", "_span", "_past").withColumnRenamed("_n", "history")


def rate_control(found: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, day: str, quantile: float, cap: int, fallback: float, history: int = 2000, least: int = 100) -> DataFrame:
    """Adds cutoff and accepted: scores at or above a quantile of earlier ones, the first cap of each day.

    Every score joins the history whether or not it is accepted, so acceptance needs no state.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    past = w.rowsBetween(-history, -1)
    rows = found.withColumns({"_n": F.count(score).over(past), "_q": F.percentile(score, F.lit(quantile)).over(past)})
    rows = rows.withColumn("cutoff", F.when(F.col("_n") >= least, F.col("_q")).otherwise(F.lit(fallback)))
    rows = rows.withColumn("qualified", F.col(score) >= F.col("cutoff"))
    number = F.sum(F.col("qualified").cast("int")).over(T.over([*keys, day], list(order)))
    return rows.withColumn("accepted", F.col("qualified") & (number <= cap)).drop("_n", "_q")


def first_entries(rows: DataFrame, keys: Sequence[str], at: str, score: Column, threshold: Column | float, observed: str = "observed") -> DataFrame:
    """Per event the first row with score >= threshold whose next row in the segment is observed."""
    nxt = F.lead(observed).over(Window.partitionBy(*keys[:-1]).orderBy(at))
    ok = rows.withColumn("_ok", (score >= threshold) & F.coalesce(nxt, F.lit(False)))
    return ok.groupBy(*keys).agg(F.min(F.when(F.col("_ok"), F.col(at))).alias("entry")).where("entry IS NOT NULL")


def exit_quotes(found: DataFrame, rows: DataFrame, keys: Sequence[str], decision: str, at: str, width: int, prefix: str, values: Sequence[str]) -> DataFrame:
    """Adds values of the row after the decision's, with a prefix: a decision fills at the next row."""
    nxt = rows.select(*keys, (F.col(at) - width).alias(decision), *[F.col(v).alias(prefix + v) for v in values])
    return found.join(nxt, [*keys, decision], "left")


def vote(local_gap: Column, gaps: Sequence[Column], neutral: float, consensus: float) -> tuple[Column, Column, Column]:
    """(side, inverted, strength) from several gaps of averages to the price.

    Of the gaps that reach neutral, the mean sign is the vote. If it reaches consensus and points away from the
    local side, the side is inverted; otherwise the local side (long if its average is above the price) stays.
    """
    local = F.when(local_gap > 0, 1).otherwise(-1)
    signs = F.array_compact(F.array(*[F.when(F.abs(g) >= neutral, F.signum(g)) for g in gaps]))
    total = F.aggregate(signs, F.lit(0.0), lambda a, x: a + x)
    score = F.when(F.size(signs) > 0, total / F.size(signs)).otherwise(0.0)
    sure = (score != 0) & (F.abs(score) >= consensus)
    world = F.when(score > 0, 1).otherwise(-1)
    return F.when(sure, world).otherwise(local), sure & (world != local), F.abs(score)


def evidence(local_gap: Column, gaps: Sequence[Column], slopes: Sequence[Column], least_gap: float, alignment: float, slope_share: float, least_slope: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """(dominant, relation, alignment, slope consensus) of the price over the averages.

    relation is the sign of the local gap; alignment the share of gaps with that sign; slope consensus the
    share of slopes that, against the relation, reach least_slope. Gaps below least_gap give no evidence.
    """
    relation = F.signum(local_gap).cast("int")
    some = (relation != 0) & (F.abs(local_gap) >= least_gap)
    share = lambda tests: sum((F.coalesce(t, F.lit(False)).cast("double") for t in tests[1:]), F.coalesce(tests[0], F.lit(False)).cast("double")) / float(len(tests))
    aligned = F.when(some, share([F.signum(g) == relation for g in gaps])).otherwise(0.0)
    sloped = F.when(some, share([-relation * s >= least_slope for s in slopes])).otherwise(0.0)
    return some & (aligned >= alignment) & (sloped >= slope_share), relation, aligned, sloped


def dominance(gap: str, horizons: Sequence[int], keys: Sequence[str], order: Sequence[str]) -> dict[str, Column]:
    """alpha_<h> = sum(gap * change of price) / sum(gap^2) over h rows, and the closure share; 0 where undefined."""
    before = F.lag(gap).over(Window.partitionBy(*keys).orderBy(*order))
    move = T.lag_delta(F.col("price"), keys, order)
    out: dict[str, Column] = {}
    for h in horizons:
        w = T.over(keys, order, h - 1)
        den = F.sum(before * before).over(w)
        out[f"alpha_{h}"] = F.when(den > 0, F.sum(before * move).over(w) / den).otherwise(0.0)
    return out
