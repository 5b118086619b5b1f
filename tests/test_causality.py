"""What comes later never changes what came before."""

import pytest
from pyspark.sql import functions as F

from tapespark.operators import bars as B
from tapespark.operators import excursions as X
from tapespark.operators import metrics as M
from tapespark.operators import temporal as T
from tapespark.plans import events as E
from tapespark.plans.base import SEG, averaged, bars, quotes

SF = "/root/testdata/sf0.001"


def assert_prefix_invariant(op, rows, at, cut, change):
    """op(rows) up to the cut is the same after the later rows are changed."""
    later = rows.withColumns({c: F.when(F.col(at) > cut, x).otherwise(F.col(c)) for c, x in change.items()})
    a, b = (sorted(map(str, op(r).where(F.col(at) <= cut).collect())) for r in (rows, later))
    assert a == b and a


@pytest.fixture(scope="module")
def prepared(spark):
    rows = averaged(spark, SF, 60).cache()
    cut = rows.agg(F.percentile("bar", F.lit(0.6)).alias("c")).first()["c"]
    return rows, int(cut)


OPS = {
    "weighted": lambda r: r.withColumn("y", T.weighted_average(F.col("close"), F.col("weight"), SEG, ["bar"], 12)),
    "full": lambda r: r.withColumn("y", T.full_rms(F.col("close").cast("double"), SEG, ["bar"], 5)),
    "correlation": lambda r: r.withColumn("y", T.correlation(F.col("close").cast("double"), F.col("mid").cast("double"), F.col("observed"), SEG, ["bar"], 20)[0]),
    "sides": lambda r: X.geometry(X.events(X.sides(r.withColumn("d", F.col("mid") - F.col("avg_60")), "d", SEG, "bar"), SEG, "bar"), "d", SEG, "bar", 100.0),
    "ribbon": lambda r: B.averages(r, SEG, ["bar"], "mid", "weight", (5, 10)),
}


@pytest.mark.parametrize("name", OPS)
def test_rolling_operators(prepared, name):
    rows, cut = prepared
    assert_prefix_invariant(OPS[name], rows, "bar", cut, {"close": F.col("close") * 3 + 7, "mid": F.col("mid") - 999, "weight": F.lit(1).cast("long")})


def test_rate_and_gate(spark):
    found = E.found_events(spark, SF).cache()
    cut = int(found.agg(F.percentile("start", F.lit(0.6)).alias("c")).first()["c"])
    day = found.withColumn("day", F.floor(F.col("start") / 86_400_000_000))
    assert_prefix_invariant(lambda r: X.rate_control(r, ["series"], ["start"], "amplitude", "day", 0.8, 2, 1.0, least=3), day, "start", cut, {"amplitude": F.col("amplitude") * 10})
    gate = lambda r: X.adaptive_gate(r, ["series"], "end", "amplitude", 3.0, 1_000_000, 100.0, least=3).select("series", "start", "gate", "threshold")
    assert_prefix_invariant(gate, found, "start", cut, {"amplitude": F.col("amplitude") * 10})


def test_asof(spark):
    q = quotes(spark, SF).cache()
    lo, hi = q.agg(F.min("ts"), F.max("ts")).first()
    cut = (lo + hi) // 2
    ticks = spark.range(lo, hi, (hi - lo) // 50).select(F.col("id").alias("ts"), F.lit(1).cast("long").alias("series"))
    assert_prefix_invariant(lambda r: T.asof_last(ticks, r, ["series"], ["bid"], order=["seq"]), q, "ts", cut, {"bid": F.col("bid") + 5})


def test_segments_stay_apart(spark):
    rows = bars(spark, SF)
    first = rows.where("segment_id = 0").withColumn("y", T.weighted_average(F.col("close"), F.col("weight"), SEG, ["bar"], 60))
    both = rows.withColumn("y", T.weighted_average(F.col("close"), F.col("weight"), SEG, ["bar"], 60)).where("segment_id = 0")
    assert sorted(map(str, first.collect())) == sorted(map(str, both.collect()))


def test_returns_look_ahead_only(spark):
    rows = spark.createDataFrame([(0, i, float(i)) for i in range(6)], "k int, t int, x double")
    out = M.discounted(rows, "x", ["k"], ["t"], 0.5).orderBy("t").collect()
    assert out[4].returns == 4 + 0.5 * 5 and out[5].returns == 5
