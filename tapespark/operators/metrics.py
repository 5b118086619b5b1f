"""Evaluation: classification, ranking, correlation, coverage, bootstrap, retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlation(x: Column | str, y: Column | str) -> Column:
    """Correlation of two columns, null where one of them doesn't vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def confusion(rows: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, true, pred).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """Accuracy, macro recall over the true classes, and the share of the largest class. One row."""
    cells = confusion(rows, true, pred)
    per = cells.groupBy(true).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"))
    return per.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("macro_recall"), (F.max("n") / F.sum("n")).alias("majority"))


def value_buckets(rows: DataFrame, score: str, buckets: int = 64) -> Column:
    """A bucket number that grows with the score, from approximate quantiles; equal scores share a bucket.

    The cuts are literals, so every use of the column agrees, whatever the partitions.
    """
    cuts = rows.agg(F.percentile_approx(score, [k / buckets for k in range(1, buckets)], 1000)).first()[0] or []
    return sum(((F.col(score) >= c).cast("int") for c in sorted({c for c in cuts if c is not None})), F.lit(0))


def ranked(rows: DataFrame, score: str, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds a rank from 1, the best score first (order breaks ties), without sorting all rows in one task.

    Rows are dealt to buckets of the score and ranked there; a bucket's ranks start at the number of rows in
    the better ones.
    """
    dealt = rows.withColumn("_part", value_buckets(rows, score))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(score), *order))
    out = dealt.withColumn("_in", inside).join(F.broadcast(before), "_part")  # one row per bucket
    return out.withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def tied_counts(rows: DataFrame, score: str, positive: Column, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(score).agg(F.sum(F.when(positive, w).otherwise(0.0)).alias("p"), F.sum(F.when(positive, 0.0).otherwise(w)).alias("n"))


def auc(rows: DataFrame, score: str, positive: Column, weight: Column | None = None) -> DataFrame:
    """Area under the ROC curve: pairs in the right order, ties a half; null without both classes. One row."""
    t = tied_counts(rows, score, positive, weight)
    below = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0.0)))
    return t.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("n"))), F.sum("p") * F.sum("n")).alias("auc"))


def average_precision(rows: DataFrame, score: str, positive: Column, order: Sequence[str]) -> DataFrame:
    """Mean precision at the positives in rank order. One row."""
    r = ranked(rows.withColumn("_y", positive.cast("int")), score, order)
    hits = r.where("_y = 1").select((-F.col("rank")).alias("_s"), F.col("rank").alias("place"))
    hits = ranked(hits, "_s", [])
    return hits.agg(F.avg(F.col("rank") / F.col("place")).alias("average_precision"), F.count("*").alias("positives"))


def spearman(rows: DataFrame, x: str, y: str, order: Sequence[str]) -> DataFrame:
    """Correlation of ordinal ranks; order breaks ties. One row."""
    b = ranked(ranked(rows, x, order, "_x"), y, order, "_y")
    return b.agg(correlation(F.col("_x").cast("double"), F.col("_y").cast("double")).alias("spearman"))


def standardised_shift(rows: DataFrame, group: Column, columns: Sequence[str], top: int = 20) -> DataFrame:
    """Difference of the group's mean from the others' over the standard deviation, the largest first."""
    aggs = [x for c in columns for x in (F.avg(F.when(group, F.col(c))).alias(f"{c}_in"), F.avg(F.when(~group, F.col(c))).alias(f"{c}_out"), F.stddev_pop(c).alias(f"{c}_sd"))]
    one = rows.agg(*aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.try_divide(F.col(f"{c}_in") - F.col(f"{c}_out"), F.nullif(F.col(f"{c}_sd"), F.lit(0.0))).alias("shift")) for c in columns])
    return one.select(F.explode(parts).alias("x")).select("x.*").orderBy(F.abs("shift").desc_nulls_last(), "feature").limit(top)


def line_metrics(rows: DataFrame, true: str, pred: str, material: float, keys: Sequence[str] = ()) -> DataFrame:
    """Errors against the truth and against zero, correlation, and sign accuracy on material truths."""
    t, p = F.col(true), F.col(pred)
    big = F.abs(t) >= material
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(F.abs(t - p)).alias("mae"), F.avg(F.abs(t)).alias("zero_mae"), F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"), F.coalesce(correlation(t, p), F.lit(0.0)).alias("corr"), F.avg(F.when(big, (F.signum(t) == F.signum(p)).cast("double"))).alias("material_accuracy"), F.avg(big.cast("double")).alias("material_share"))


def coverage_curve(rows: DataFrame, true: str, pred: str, shares: Sequence[float]) -> DataFrame:
    """Sign accuracy and mean |truth| of the rows whose |prediction| is in the top share. One row per share."""
    size = F.abs(F.col(pred))
    cuts = rows.agg(F.percentile(size, F.array(*[F.lit(1 - s) for s in shares])).alias("c")).first()["c"]
    hit = F.signum(F.col(true)) == F.signum(F.col(pred))
    aggs = []
    for i, cut in enumerate(cuts):
        aggs += [F.count_if(size >= cut).alias(f"n{i}"), F.avg(F.when(size >= cut, hit.cast("double"))).alias(f"a{i}"), F.avg(F.when(size >= cut, F.abs(F.col(true)))).alias(f"m{i}")]
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(float(c)).alias("cutoff"), F.col(f"n{i}").alias("rows"), F.col(f"a{i}").alias("accuracy"), F.col(f"m{i}").alias("mean_size")) for i, (s, c) in enumerate(zip(shares, cuts, strict=True))])).alias("x")).select("x.*")


def curve_metrics(rows: DataFrame, pairs: Sequence[tuple[str, str]], half: float = 0.5) -> DataFrame:
    """Per (true, pred) pair: MAE, correlation, precision and recall at half. One row per pair."""
    aggs = []
    for i, (t, p) in enumerate(pairs):
        a, b = F.col(t) >= half, F.col(p) >= half
        aggs.append(F.struct(F.lit(t).alias("curve"), F.avg(F.abs(F.col(t) - F.col(p))).alias("mae"), F.coalesce(correlation(t, p), F.lit(0.0)).alias("corr"), F.coalesce(F.try_divide(F.count_if(a & b), F.count_if(b)), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.count_if(a & b), F.count_if(a)), F.lit(0.0)).alias("recall")).alias(f"c{i}"))
    return rows.agg(*aggs).select(F.explode(F.array(*[f"c{i}" for i in range(len(pairs))])).alias("x")).select("x.*")


def percentile_scores(rows: DataFrame, reference: DataFrame, score: str, key: str) -> DataFrame:
    """Adds share: how many reference scores are at most the row's, over all of them.

    Both sides are united and counted in buckets of the score, so neither is broadcast.
    """
    total = reference.count()
    both = rows.select(key, F.col(score).alias("_s"), F.lit(1).alias("_row")).unionByName(reference.select(F.col(score).alias("_s"), F.lit(0).alias("_row")), allowMissingColumns=True)
    dealt = both.withColumn("_part", value_buckets(both, "_s"))
    sizes = dealt.groupBy("_part").agg(F.count_if(F.col("_row") == 0).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum((F.col("_row") == 0).cast("long")).over(Window.partitionBy("_part").orderBy("_s", "_row").rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_in", inside).join(F.broadcast(before), "_part").where("_row = 1")
    return out.select(key, F.col("_s").alias(score), ((F.col("_in") + F.col("_before")) / float(max(total, 1))).alias("share"))


def class_weights(rows: DataFrame, label: str, cap: float = 8.0) -> DataFrame:
    """Per class: min(sqrt(largest / n), cap), and the inverse frequency with mean one over rows."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row per class
    return counts.withColumns({"root_weight": F.least(F.sqrt(F.max("n").over(w) / F.col("n")), F.lit(cap)), "inverse_weight": F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))})


def ensemble(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation of the members' predictions per key."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("members"))


def nth_largest(rows: DataFrame, value: str, n: int) -> DataFrame:
    """The n-th largest value as threshold, or the least if there are fewer. One row."""
    top = rows.select(value).where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(n)
    return top.agg(F.min(value).cast("double").alias("threshold"))


def block_bootstrap(rows: DataFrame, block: str, value: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """mean of the blocks' (days, weeks) means, and low and high, a 95 % interval by drawing whole blocks. One row.

    The place of draw d's k-th block is a hash of (seed, d, k), so that a rerun draws the same. There is one
    row per block, and draws times as many are drawn.
    """
    means = rows.groupBy(block).agg(F.avg(value).alias("_m"))
    place = F.row_number().over(Window.orderBy(block)) - 1  # one row per block
    means = means.select("_m", place.cast("long").alias("_i"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("_n"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "_d", "_k")), 1, 8), 16, 10).cast("long")
    drawn = means.agg(F.max("_n").alias("_n")).select("_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_d"))
    drawn = drawn.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select("_d", F.pmod(hashed, F.col("_n")).alias("_i"))
    of_draw = drawn.join(F.broadcast(means.select("_m", "_i")), "_i").groupBy("_d").agg(F.avg("_m").alias("_m"))  # one row per block
    interval = of_draw.agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    return means.agg(F.avg("_m").alias("mean")).crossJoin(interval)  # one row each


def _nearest(ids: np.ndarray, q: np.ndarray, ref: np.ndarray, x: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (references, similarities) of each query among those so far and x; smaller id on ties. Zero vectors count as infinitely far."""
    with np.errstate(invalid="ignore", divide="ignore"):
        sim = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
    sim = np.concatenate([best[1], np.where(np.isnan(sim), -np.inf, sim)], axis=1)
    refs = np.concatenate([best[0], np.broadcast_to(ref, (len(ids), len(ref)))], axis=1)
    top = np.lexsort((refs, -sim), axis=1)[:, :k]
    return np.take_along_axis(refs, top, 1), np.take_along_axis(sim, top, 1)


def _vectors(ids: pa.ChunkedArray | pa.Array, values: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kept = [(i, v) for i, v in zip(ids.to_pylist(), values.to_pylist(), strict=True) if v is not None]
    return np.array([i for i, _ in kept], dtype=np.int64), np.array([v for _, v in kept], dtype=np.float64).reshape(len(kept), -1)


def _neighbour_rows(ids: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    real = np.isfinite(best[1])
    return [pa.array(np.repeat(ids, real.sum(axis=1))), pa.array(best[0][real]), pa.array(best[1][real])]


def cosine_knn(queries: DataFrame, references: DataFrame, k: int, vector: str = "embedding", block: int = 2048, reference_block: int = 20_000) -> DataFrame:
    """(query, reference, sim, place) for the k references of each query with the largest cosine, smaller id on ties.

    Up to a block of queries is sent to all tasks, and each keeps its own k best of its references. More queries
    are cut into blocks, as are the references, and each block of the one meets each of the other in a task of
    its own: nothing passes the driver, and k rows a query and task are left to rank, never all pairs. Null
    and zero vectors are left out.
    """
    spark = references.sparkSession
    rows, others = queries.select("id", vector), references.select("id", vector)
    names, parts = ["query", "reference", "sim"], -(-rows.count() // block)
    if parts <= 1:
        ids, q = _vectors(*rows.toArrow().columns)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))
            for batch in batches:
                ref, x = _vectors(*batch.columns)
                if len(ref) and len(ids):
                    best = _nearest(ids, q, ref, x, best, k)
            yield pa.RecordBatch.from_arrays(_neighbour_rows(ids, best), names=names)

        out = others.mapInArrow(run, "query long, reference long, sim double")
    else:
        cells = max(1, -(-others.count() // reference_block))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.select("id", vector, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("a")).withColumn("b", each(cells))
        right = others.select("id", vector, F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("b")).withColumn("a", each(parts))

        def work(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            (ids, q), (ref, x) = (_vectors(t.column("id"), t.column(vector)) for t in (mine, theirs))
            best = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))
            for at in range(0, len(ref) if len(ids) else 0, 4096):
                best = _nearest(ids, q, ref[at : at + 4096], x[at : at + 4096], best, k)
            return pa.table(_neighbour_rows(ids, best), names=names)

        out = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(work, "query long, reference long, sim double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "reference"))
    return out.withColumn("place", place).where(F.col("place") <= k)


def softmax_predict(neighbours: DataFrame, value: str, temperature: float = 0.08) -> DataFrame:
    """Per query the neighbours' value weighted by exp((sim - best) / temperature)."""
    best = F.max("sim").over(Window.partitionBy("query"))
    w = F.exp((F.col("sim") - best) / temperature)
    return neighbours.withColumn("_w", w).groupBy("query").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("prediction"))


def reverse_sum(x: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Sum from the row to the end of its key: returns without discount. Null times and numbers come last, as in SQL.

    The rows are taken from the last to the first with a running sum: a frame that ends with its key would be
    summed anew for each row, so that a key would cost the square of its rows.
    """
    backwards = [F.col(c).desc_nulls_first() for c in order]
    return F.sum(x).over(Window.partitionBy(*keys).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, 0))


def discounted(rows: DataFrame, x: str, keys: Sequence[str], order: Sequence[str], gamma: float, name: str = "returns", chunk: int = 256) -> DataFrame:
    """x_t + gamma x_{t+1} + ... within the key, for gamma below 1 (reverse_sum is the form without discount).

    The ordered rows of a key are cut into chunks. A row folds what follows it in its chunk, and adds what the
    next chunks hold, discounted to the chunk's end; chunks beyond those whose weight is under 2^-64 add
    nothing that a double could show. So a row costs at most a chunk, whatever the length of its key.
    """
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).withColumn("_c", F.floor(F.col("_n") / chunk))
    fold = lambda a, g: F.aggregate(F.reverse(a), F.lit(0.0), lambda s, v: s * g + v)
    inside = Window.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"_own": fold(F.collect_list(F.col(x).cast("double")).over(inside), gamma), "_left": F.count(F.lit(1)).over(inside)})
    reach = max(1, math.ceil(64 * math.log(2) / (-math.log(gamma) * chunk))) if gamma > 0 else 1
    heads = rows.where(F.col("_n") == F.col("_c") * chunk).select(*keys, "_c", F.col("_own").alias("_head"))
    after = Window.partitionBy(*keys).orderBy("_c").rowsBetween(1, reach)
    heads = heads.select(*keys, "_c", fold(F.collect_list("_head").over(after), gamma**chunk).alias("_next"))  # one row per chunk
    out = rows.join(heads, [*keys, "_c"]).withColumn(name, F.col("_own") + F.pow(F.lit(float(gamma)), F.col("_left")) * F.col("_next"))
    return out.drop("_n", "_c", "_own", "_left", "_next")


def temperature(rows: DataFrame, logit: str, label: str, grid: Sequence[float]) -> DataFrame:
    """Log loss at each temperature, the best flagged (the first on ties)."""
    losses = []
    for t in grid:
        p = 1 / (1 + F.exp(-F.col(logit) / t))
        p = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
        losses.append(F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))))
    one = rows.agg(*[x.alias(f"l{i}") for i, x in enumerate(losses)])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"l{i}").alias("loss")) for i, t in enumerate(grid)])).alias("x")).select("x.*")
    return long.withColumn("best", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("loss", "temperature")) == 1)
