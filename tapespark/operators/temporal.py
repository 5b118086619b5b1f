"""Temporal operators: grids, as-of state, segments and the rolling contracts.

All take a DataFrame with an explicit partition key and order; nothing sorts rows across keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import bucket, ceil_grid

Keys = Sequence[str]


def over(keys: Keys, order: Keys, first: int | None = None, last: int = 0) -> WindowSpec:
    """Rows from first before (None: all) to last after, within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding if first is None else -first, last)


def ahead(keys: Keys, order: Keys, first: int, last: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, last)


def grid(bounds: DataFrame, keys: Keys, start: str, end: str, cadence: int, name: str = "ts") -> DataFrame:
    """One row per key and tick from ceil(start) to floor(end), both included."""
    low, high = ceil_grid(F.col(start), cadence), bucket(F.col(end), cadence)
    return bounds.where(low <= high).select(*keys, F.explode(F.sequence(low, high, F.lit(cadence).cast("long"))).alias(name))


def asof_last(ticks: DataFrame, events: DataFrame, keys: Keys, values: Keys, at: str = "ts", event_at: str = "ts", order: Keys = (), bucket_width: int | None = None) -> DataFrame:
    """ticks with each value's last row at or before the tick, and asof_ts, its time.

    Both sides are united and one window carries the last event forward, so the join is a sort per key, not a
    product; an event at the tick itself counts. order breaks ties between events of one time. With a
    bucket_width (of time) the window runs within each bucket, and what was last before a bucket comes from
    the buckets' last events, so a hot key is as many tasks as it has buckets.
    """
    event = F.struct(F.col(event_at).alias("asof_ts"), *values)
    left = ticks.select(*ticks.columns, F.lit(None).cast(events.select(event.alias("e")).schema["e"].dataType).alias("_e"), F.col(at).alias("_at"), F.lit(1).alias("_late"), *[F.lit(None).cast(events.schema[c].dataType).alias(f"_o_{c}") for c in order])
    right = events.select(*keys, event.alias("_e"), F.col(event_at).alias("_at"), F.lit(0).alias("_late"), *[F.col(c).alias(f"_o_{c}") for c in order])
    rows = left.unionByName(right, allowMissingColumns=True)
    inside = ["_at", "_late", *[f"_o_{c}" for c in order]]
    if bucket_width is None:
        rows = rows.withColumn("_e", F.last("_e", ignorenulls=True).over(over(keys, inside)))
    else:
        rows = rows.withColumn("_bucket", F.floor(F.col("_at") / bucket_width))
        rows = rows.withColumn("_e", F.last("_e", ignorenulls=True).over(over([*keys, "_bucket"], inside)))
        tail = F.struct("_at", *inside[2:])
        ends = rows.groupBy(*keys, "_bucket").agg(F.max_by("_e", F.when(F.col("_late") == 0, tail)).alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")  # one row per key and bucket
        rows = rows.join(ends, [*keys, "_bucket"]).withColumn("_e", F.coalesce("_e", "_before")).drop("_bucket", "_before")
    return rows.where("_late = 1").select(*ticks.columns, "_e.*")


def chunked(rows: DataFrame, keys: Keys, place: Column, reach: int, chunk: int, op: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """op over chunks of each key, for windows that look at most reach rows back.

    place numbers the rows of a key (a regular grid's time over its step). A row also goes to the next chunk if
    it is within reach of it, and only a chunk's own rows are kept, so the result is that over whole keys while
    a long key is many tasks. op gets the rows and the keys to partition by.
    """
    rows = rows.withColumn("_place", place)
    own = F.floor(F.col("_place") / chunk)
    rows = rows.withColumn("_chunk", F.explode(F.sequence(own, F.floor((F.col("_place") + reach) / chunk))))
    return op(rows, [*keys, "_chunk"]).where(own == F.col("_chunk")).drop("_place", "_chunk")


def merged(streams: Sequence[DataFrame], order: Keys) -> DataFrame:
    """Rows of several streams in one order, with serial, the stream's place: the tie-break after order.

    A range exchange deals the rows to sorted partitions that follow one another, so no task merges all.
    """
    out = None
    for i, s in enumerate(streams):
        s = s.withColumn("serial", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out.orderBy(*order, "serial")


def shifted(grid: DataFrame, sums: DataFrame, keys: Keys, at: str, columns: Keys) -> DataFrame:
    """On a dense grid the sums of the cell before: what was known when a cell began. 0 without rows."""
    rows = grid.join(sums, [*keys, at], "left")
    w = Window.partitionBy(*keys).orderBy(at)
    zero = F.lit(0).cast("long")
    return rows.select(*keys, at, *[F.coalesce(F.lag(F.coalesce(F.col(c), zero)).over(w), zero).alias(c) for c in columns])


def in_parts(rows: DataFrame, at: str, width: int) -> DataFrame:
    """rows with _part, the stretch of time of that width: what a hot key is split by."""
    return rows.withColumn("_part", F.floor(F.col(at) / width))


def carried_in(rows: DataFrame, keys: Keys, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, following: dict[str, Column] | None = None) -> DataFrame:
    """rows (with _part) and what the other parts of their key leave to them, one aggregate of a part for each name.

    last: that of the last earlier part in which it isn't null; total: the sum over the earlier parts, 0 without
    any; following: that of the first later part in which it isn't null. Only one row per key and part is sorted
    by key; the rows themselves stay in tasks of their own parts.
    """
    last, total, following = last or {}, total or {}, following or {}
    rows = rows.repartition(*keys, "_part")  # one exchange for the ends and for the rows
    ends = rows.groupBy(*keys, "_part").agg(*[x.alias(n) for n, x in (last | total | following).items()])
    w = Window.partitionBy(*keys).orderBy("_part")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    cols = [F.last(n, ignorenulls=True).over(before).alias(n) for n in last]
    cols += [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in total]
    cols += [F.first(n, ignorenulls=True).over(after).alias(n) for n in following]
    return rows.join(ends.select(*keys, "_part", *cols), [*keys, "_part"])


def running_total(rows: DataFrame, keys: Keys, order: Keys, x: Column, name: str, width: int | None = None) -> DataFrame:
    """Adds the sum of x from the start of the key to the row; with a width (of order's first column, a time) by parts."""
    if width is None:
        return rows.withColumn(name, F.sum(x).over(over(keys, order)))
    rows = carried_in(in_parts(rows.withColumn("_x", x), order[0], width), keys, total={"_sum": F.sum("_x")})
    return rows.withColumn(name, F.coalesce(F.sum("_x").over(over([*keys, "_part"], order)), F.lit(0)) + F.col("_sum")).drop("_x", "_part", "_sum")


def neighbours(rows: DataFrame, keys: Keys, order: Keys, columns: Keys, width: int | None = None, lead: bool = False) -> DataFrame:
    """Adds lag_<column> (and with lead lead_<column>), the values of the rows before and after within the key; with a width by parts."""
    row = F.struct(*columns)
    if width is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumn("_lag", F.lag(row).over(w))
        rows = rows.withColumn("_lead", F.lead(row).over(w)) if lead else rows
    else:
        at = F.struct(*order)
        rows = carried_in(in_parts(rows, order[0], width), keys, last={"_in": F.max_by(row, at)}, following={"_out": F.min_by(row, at)} if lead else None)
        w = Window.partitionBy(*keys, "_part").orderBy(*order)
        rows = rows.withColumn("_lag", F.coalesce(F.lag(row).over(w), "_in"))
        rows = rows.withColumn("_lead", F.coalesce(F.lead(row).over(w), "_out")).drop("_out") if lead else rows
        rows = rows.drop("_in", "_part")
    return rows.withColumns({f"{kind}_{c}": F.col(f"_{kind}.{c}") for kind in ("lag", *(["lead"] if lead else [])) for c in columns}).drop("_lag", "_lead")


def forward_fill(rows: DataFrame, keys: Keys, order: Keys, values: Keys, width: int | None = None) -> DataFrame:
    """Each value's last one that isn't null; with a width (of order's first column, a time) by parts."""
    if width is None:
        w = over(keys, order)
        return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in values})
    ends = {f"_in_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))) for c in values}
    rows = carried_in(in_parts(rows, order[0], width), keys, last=ends)
    w = over([*keys, "_part"], order)
    return rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), f"_in_{c}") for c in values}).drop("_part", *ends)


def islands(rows: DataFrame, keys: Keys, order: Keys, starts: Column, name: str = "island", width: int | None = None) -> DataFrame:
    """Numbers runs from 0: a new one begins where starts holds; the first row begins one either way."""
    rows = neighbours(rows.withColumns({"_start": F.coalesce(starts, F.lit(False)).cast("long"), "_any": F.lit(1)}), keys, order, ["_any"], width)
    new = F.when(F.col("lag__any").isNull(), 0).otherwise(F.col("_start"))
    rows = running_total(rows.withColumn("_new", new.cast("long")), keys, order, F.col("_new"), name, width)
    return rows.withColumn(name, F.col(name).cast("long")).drop("_start", "_any", "lag__any", "_new")


def changed(column: str, keys: Keys, order: Keys) -> Column:
    return ~F.col(column).eqNullSafe(F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def gap_fill(bars: DataFrame, keys: Keys, at: str, width: int, carry: int, part: int | None = None) -> DataFrame:
    """Regularises bars: up to carry rows after each bar before the next one, then a new segment.

    Adds observed, gap_rows (0 for the bar itself) and segment_id; a hole of more than carry rows ends the
    segment. The last bar of a key is not carried. With part (a time) a long key is worked off by parts: one
    row of a part tells where it begins and ends and how many holes it has.
    """
    own = [*keys] if part is None else [*keys, "_part"]
    w = Window.partitionBy(*own).orderBy(at)
    rows = bars if part is None else in_parts(bars, at, part)
    rows = rows.withColumns({"_lag": F.lag(at).over(w), "_lead": F.lead(at).over(w)})
    holes = lambda back: F.when(back > (carry + 1) * width, 1).otherwise(0).cast("long")
    inside = F.sum(holes(F.col(at) - F.col("_lag"))).over(over(own, [at]))
    if part is None:
        rows = rows.withColumn("segment_id", inside)
    else:
        ends = rows.groupBy(*own).agg(F.min(at).alias("_a"), F.max(at).alias("_z"), F.sum(holes(F.col(at) - F.col("_lag"))).alias("_holes"))
        k = Window.partitionBy(*keys).orderBy("_part")  # one row per key and part
        ends = ends.withColumns({"_in": F.lag("_z").over(k), "_out": F.lead("_a").over(k)}).withColumn("_first", holes(F.col("_a") - F.col("_in")))
        upto = lambda c, last: F.coalesce(F.sum(c).over(k.rowsBetween(Window.unboundedPreceding, last)), F.lit(0))
        ends = ends.select(*own, "_in", "_out", (upto("_first", 0) + upto("_holes", -1)).alias("_before"))
        rows = rows.join(ends, own).withColumns({"_lead": F.coalesce("_lead", "_out"), "segment_id": inside + F.col("_before")}).drop("_part", "_in", "_out", "_before")
    gap = ((F.col("_lead") - F.col(at)) / F.lit(width)).cast("long")
    last = F.when(gap.isNull(), 0).otherwise(F.least(gap - 1, F.lit(carry)))
    rows = rows.withColumn("gap_rows", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return rows.withColumns({at: F.col(at) + F.col("gap_rows") * width, "observed": F.col("gap_rows") == 0}).drop("_lag", "_lead")


def rolling_sum(x: Column, keys: Keys, order: Keys, window: int | None) -> Column:
    """Sum over the last window rows as a difference of two running sums: linear whatever the width.

    Exact for whole numbers; null counts as zero.
    """
    total = F.sum(F.coalesce(x, F.lit(0))).over(over(keys, order))
    if window is None:
        return total
    before = F.sum(F.coalesce(x, F.lit(0))).over(over(keys, order, None, -window))
    return total - F.coalesce(before, F.lit(0))


def weighted_average(value: Column, weight: Column, keys: Keys, order: Keys, window: int | None) -> Column:
    """Causal weighted average over the last window rows (None: since the start of the key).

    Weights that are null or not positive and null values count for nothing; with no weight in the window the
    row's own value is returned, not null.
    """
    w = F.when((weight > 0) & value.isNotNull(), weight).otherwise(0)
    num = rolling_sum(value * w, keys, order, window)
    den = rolling_sum(w, keys, order, window)
    return F.when(den > 0, num / den).otherwise(value)


def _seen(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def full_mean(x: Column, keys: Keys, order: Keys, window: int) -> Column:
    """Mean over exactly window values, null with fewer; values that aren't finite are none. By running sums."""
    n = rolling_sum(_seen(x).isNotNull().cast("long"), keys, order, window)
    return F.when(n == window, rolling_sum(_seen(x), keys, order, window) / float(window))


def full_rms(x: Column, keys: Keys, order: Keys, window: int) -> Column:
    n = rolling_sum(_seen(x).isNotNull().cast("long"), keys, order, window)
    return F.when(n == window, F.sqrt(F.greatest(rolling_sum(_seen(x * x), keys, order, window).cast("double"), F.lit(0.0)) / float(window)))


def partial_mean(x: Column, keys: Keys, order: Keys, window: int) -> Column:
    """Mean over what there is of the last window rows."""
    return F.try_divide(rolling_sum(_seen(x), keys, order, window), rolling_sum(_seen(x).isNotNull().cast("long"), keys, order, window))


def lag_delta(x: Column, keys: Keys, order: Keys, k: int = 1) -> Column:
    return x - F.lag(x, k).over(Window.partitionBy(*keys).orderBy(*order))


def correlation(x: Column, y: Column, valid: Column, keys: Keys, order: Keys, window: int, floor: float = 1e-12) -> tuple[Column, Column]:
    """Causal correlation and beta of y on x over the valid rows of the window; 0 where a variance is at most floor.

    By running sums; over chunked keys their rounding stays that of a chunk.
    """
    total = lambda c: rolling_sum(F.when(valid, c), keys, order, window)
    n = F.nullif(total(F.lit(1)), F.lit(0))
    ex, ey = total(x) / n, total(y) / n
    vx = total(x * x) / n - ex * ex
    vy = total(y * y) / n - ey * ey
    cov = total(x * y) / n - ex * ey
    return F.when((vx > floor) & (vy > floor), cov / F.sqrt(vx * vy)).otherwise(0.0), F.when(vx > floor, cov / vx).otherwise(0.0)


def carried_sign(x: Column, keys: Keys, order: Keys) -> Column:
    """The last sign that wasn't zero, 0 before any."""
    return F.coalesce(F.last(F.nullif(F.signum(x), F.lit(0.0)), ignorenulls=True).over(over(keys, order)), F.lit(0.0)).cast("int")


def keep_last(rows: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """The last row of each key in the order given (dropDuplicates would keep any)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def every_nth(rows: DataFrame, keys: Keys, order: Keys, stride: int, width: int | None = None) -> DataFrame:
    """Every stride-th row of a key from the first on; with a width by parts."""
    rows = running_total(rows, keys, order, F.lit(1).cast("long"), "_rank", width)
    return rows.where(F.pmod(F.col("_rank") - 1, F.lit(stride)) == 0).drop("_rank")
